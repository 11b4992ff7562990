"""Written tables: shuffles are freed, and a compressed table is not broadcast by its size on disk."""

from pyspark.sql import functions as F

from peakloom import session


def test_large_table_is_not_broadcast(spark, monkeypatch):
    rows = spark.range(200_000).select((F.col("id") % 50_000).alias("key"), F.col("id").alias("x"))
    written = session.cut_lineage(rows)
    keys = session.cut_lineage(rows.select("key").distinct())
    joined = written.groupBy("key").agg(F.max("x").alias("x")).join(keys, "key")
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joined.count() == 50_000
    few = session.cut_lineage(rows.filter("key < 5").select("key").distinct())
    assert "Broadcast" in rows.join(few, "key")._jdf.queryExecution().sparkPlan().toString()
    named = session.broadcast_if_small(keys.filter("key < 10"))
    assert "Broadcast" in written.join(named, "key")._jdf.queryExecution().sparkPlan().toString()


def test_shuffles_are_freed_while_a_table_is_written(spark, monkeypatch):
    seen, real = [], session.written
    monkeypatch.setattr(session, "written", lambda df: seen.append(spark.conf.get(session.FREE_SHUFFLES)) or real(df))
    before = spark.conf.get(session.FREE_SHUFFLES, None)
    assert session.cut_lineage(spark.range(10)).count() == 10
    assert seen == ["true"] and spark.conf.get(session.FREE_SHUFFLES, None) == before
