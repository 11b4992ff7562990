from pyspark.sql import functions as F

from peakloom.config import MixtureConfig
from peakloom.operators import mixture


def test_both_ways_agree(spark, monkeypatch):
    rows = [("a", float(v)) for v in (1, 1.1, 1.2, 0.9, 20, 21, 22, 19, 18.5)] + [("b", float(i)) for i in range(1, 30)]
    values = spark.createDataFrame(rows, "sample_id string, intensity double")
    config = MixtureConfig(max_components=3)
    small = {r.sample_id: r for r in mixture.fit(values, ["sample_id"], config).collect()}
    monkeypatch.setattr(mixture, "SMALL_GROUP", 0)
    large = {r.sample_id: r for r in mixture.fit(values, ["sample_id"], config).collect()}
    assert small.keys() == large.keys()
    for key, model in small.items():
        assert model.k == large[key].k
        assert abs(model.bic - large[key].bic) < 1e-6
        for p, q in zip(model.parts, large[key].parts):
            assert all(abs(x - y) < 1e-6 for x, y in zip(p, q))
    assert small["a"].k >= 2


def test_labels_follow_the_means(spark):
    values = spark.createDataFrame([("a", v) for v in (1.0, 1.1, 0.9, 50.0, 55.0, 45.0)], "sample_id string, intensity double")
    config = MixtureConfig(min_components=2, max_components=2)
    model = mixture.fit(values, ["sample_id"], config)
    out = mixture.label(values, model, ["sample_id"], config).orderBy("intensity").collect()
    assert [r.cluster_id for r in out] == [0, 0, 0, 1, 1, 1]
    assert mixture.label(values, model, ["sample_id"], config).select(F.count_distinct("cluster_id")).first()[0] == 2
