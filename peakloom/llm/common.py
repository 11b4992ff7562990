"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.session import checkpointed, table
from peakloom.session import written as cut_lineage

__all__ = ["GAP", "WORD", "ascii_lower", "broadcast_checked", "chunks", "load", "packed", "settle", "shuffle_partitions", "text_of", "tokens_of", "unpacked", "with_row", "words_of", "written"]

# Words are runs of anything but space and the controls 09 to 0D.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Python kernels work on slices of a batch of about this many bytes of text, or on one longer text.
CHUNK_BYTES = 8 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def settle(df: DataFrame) -> DataFrame:
    """Write to the reliable checkpoint folder and go on from there; survives lost executors."""
    return checkpointed(df)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Like ``settle``, but as a compressed table, and the shuffle files of the write are freed when it ends.

    Shuffles otherwise stay on disk until the driver happens to collect garbage.  The setting of the
    session is put back after the write.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        # Planned with the setting: a plan that was made before keeps its shuffles.
        return cut_lineage(df)
    finally:
        if before is None:
            conf.unset(FREE_SHUFFLES)
        else:
            conf.set(FREE_SHUFFLES, before)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number for each row, so repeated ids stay apart.

    Apply it to a table scan or a settled frame: there the numbers are the same whenever
    a lost task is run again.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def packed(df: DataFrame, *extra: str | Column) -> DataFrame:
    """All columns of ``df`` as one struct ``_all``, so that no name of its own meets theirs."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("_all"), *extra)


def unpacked(columns: list[str], **changed: Column) -> list[Column]:
    """The columns of ``_all``, some of them changed."""
    return [changed[c].alias(c) if c in changed else F.col("_all").getField(c).alias(c) for c in columns]


def text_of(column: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def words_of(text: Column) -> Column:
    """Words in order; gaps at both ends go first, so no part of the split is empty."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; bytes methods touch ASCII only, as the word rule asks."""
    return (text or "").encode("utf-8").lower().split()


def chunks(texts: list[str | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each, so a batch of long texts stays small in memory."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def broadcast_checked(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast narrow, fixed-width rows if there are at most ``most_rows``; otherwise the join is shuffled."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
