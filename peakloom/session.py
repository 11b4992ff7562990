"""Session-level helpers: lineage cuts, size-checked broadcasts, table loading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after a count shows that it has at most this many rows.
BROADCAST_MAX_ROWS = 20_000
# Frees the shuffle files of a query when it ends; else they stay on disk until the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Written tables above this many bytes are never broadcast by their size on disk; see ``cut_lineage``.
BROADCAST_MAX_BYTES = 128 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_folder(spark: SparkSession) -> None:
    """Set the checkpoint folder if none is set.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a
    local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="peakloom-checkpoint-")
        context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the files.

    The result keeps the plan constraints and size estimates of ``df``, which grow in loops; see ``cut_lineage``.
    """
    cut_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path beside the checkpoints, seen by driver and executors alike."""
    cut_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table beside the checkpoints and continue from its files.

    Unlike a checkpoint the table is compressed, has its real size, and carries no constraints of the former plan.
    With checkpoints the time of a round was seen to double from one to the next; with tables it stays the same.
    """
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is planned inside frees its shuffle files when it ends; the setting of the session is put back."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``written`` with its shuffle files freed, and joins of the table are shuffled unless it is small on disk
    or the other side has a broadcast hint.

    A compressed table of a few megabytes may hold millions of rows; taken for small by its size, it would be
    collected in the driver.
    """
    with shuffles_freed(df.sparkSession):
        table = written(df)
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return table.hint("merge") if size > BROADCAST_MAX_BYTES else table


settle = cut_lineage


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast only when the side is proven to be small.

    Larger sides are returned without a hint, so Catalyst plans a shuffled join.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute rows by a key as fine as the rows before CPU-heavy expressions.

    Without it a hot coarse key, or AQE merging partitions that are small in bytes,
    would leave the work to a few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
