"""Tables written between the steps of the near-duplicate stage."""

import re

from peakloom.llm import simhash
from peakloom.llm.common import FREE_SHUFFLES, written


def _shuffles(spark):
    """Numbers of the shuffles with files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {m[1] for m in (re.match(r"shuffle_(\d+)_.*\.data$", n) for n in names) if m}


def test_a_written_table_keeps_no_shuffle(spark):
    before, setting = _shuffles(spark), spark.conf.get(FREE_SHUFFLES)
    out = written(spark.range(3_000).groupBy("id").count())
    left = _shuffles(spark) - before
    assert not left
    assert spark.conf.get(FREE_SHUFFLES) == setting
    assert out.count() == 3_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Aggregate" not in plan


def test_near_dedup_writes_tables(spark, monkeypatch):
    """No step goes through an uncompressed checkpoint, whose shuffles stay."""

    def no_checkpoint(df):
        raise AssertionError("checkpoint")

    monkeypatch.setattr(simhash, "settle", no_checkpoint)
    texts = [" ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(41)), "another text of its own", "ANOTHER text  of its own"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == [0, 2]
