from pyspark.sql import functions as F

from peakloom.config import PackConfig
from peakloom.operators import packing
from peakloom.session import cut_lineage


def test_packing_computes_its_tracks_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def weigh(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(1, f"t{i}", [(i,), (i + 1,)], 1.0 + i % 3) for i in range(0, 40, 2)]
    rows += [(1, f"u{i}", [(i,), (i + 2,)], 1.1) for i in range(0, 40, 4)]
    schema = "series_id long, track_id string, members array<struct<peak_id:long>>, weight double"
    tracks = spark.createDataFrame(rows, schema).mapInArrow(weigh, schema)
    out = packing.pack_tracks(tracks, ["series_id"], PackConfig())
    assert out.select(F.sum("weight")).first()[0] > 0
    assert seen.value == len(rows)


def test_cut_carries_no_constraints(spark):
    wide = spark.range(10).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(4)])
    kept = cut_lineage(wide.filter("c0 > 2 AND c1 > 3 AND c2 = c3 - 1"))
    assert kept._jdf.queryExecution().optimizedPlan().constraints().size() == 0
    assert sorted(r["c0"] for r in kept.collect()) == list(range(3, 10))
