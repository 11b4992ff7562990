"""WARC archives: writing with payload deduplication, reading back, and a merged capture index.

Writing.  Records are text rows, written by Spark with the record terminator as line separator, so a
part file is a gzip-compressed WARC file.  Of records with equal payloads of at least ``least`` bytes
the one with the smallest page_id is a response; the others are revisits without payload.

Reading.  Files come through Spark's binary reader, are unpacked as a stream and cut by
Content-Length.  Each file gives a run of captures sorted by url key and time.  Runs are dealt to key
ranges; each range merges its runs with a loser tree, so the ranges in order are the capture history
of the whole archive.

A null html is an empty payload, a null url an empty one.  Pages have no capture time: it counts
seconds of page_id from a fixed day.  Rows with equal id and payload are all responses when the id is
the smallest.  Null ids sort last.  An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.llm.common import settle, shuffle_partitions

BREAK = "\r\n"
END = BREAK * 2
FIRST_DAY = "2024-01-01 00:00:00"
_NONE = "none"
# Key ranges of the merged index, and so rows of its table of range sizes.
MAX_RANGES = 4_096


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 5 hex digits are 4 base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One text column: the WARC record of each row of (page_id, url, html), without its terminator."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select(
        "page_id",
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("size"),
        base32_sha1(html.cast("binary")).alias("digest"),
    )
    first = own.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    joined = own.join(first, "digest", "left")
    revisit = F.coalesce((F.col("size") >= least) & (F.col("first") != F.coalesce("page_id", F.col("first") - 1)), F.lit(False))
    joined = joined.withColumn("revisit", revisit)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(_NONE))
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_DAY)) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("size").cast("string"), F.lit(END)
    )
    body = F.when(F.col("revisit"), http).otherwise(F.concat(http, "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))
    head = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Date", when),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(
            F.col("revisit"),
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(BREAK),
    )
    return joined.select(F.concat(head, body).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes gzip-compressed WARC files into a new folder."""
    records(pages, least).write.option("lineSep", END).option("compression", "gzip").text(path)


def _bytes_of(data: bytes) -> Iterator[bytes]:
    unpack = zlib.decompressobj(31)
    for at in range(0, len(data), 1 << 18):
        yield unpack.decompress(data[at : at + (1 << 18)])
    yield unpack.flush()


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record; only the record at hand is unpacked in full."""
    parts, buffer, at = _bytes_of(data), bytearray(), 0

    def need(size: int) -> bool:
        while len(buffer) - at < size:
            more = next(parts, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        del buffer[:at]
        at = 0
        while (stop := buffer.find(END.encode(), at)) < 0:
            if not need(len(buffer) - at + 1):
                return
        lines = buffer[at:stop].decode().split(BREAK)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        at = stop + len(END)
        if not need(size + len(END)):
            raise ValueError("record is cut short")
        yield headers, bytes(buffer[at : at + size])
        at += size + len(END)


def url_key(url: str) -> str:
    """Sortable key: reversed host words, then the path in lower case."""
    match = re.match(r"[^:]*://([^/?#]*)([^#]*)", url)
    if not match:
        return url.lower()
    return ",".join(reversed(match[1].lower().split("."))) + ")" + match[2].lower()


CAPTURE = "url_key string, warc_date string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_NAMES = [f.split()[0] for f in CAPTURE.split(", ")]
_KINDS = [{"string": pa.string(), "bigint": pa.int64()}[f.split()[1]] for f in CAPTURE.split(", ")]


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").rstrip(">")
    return int(number) if number and number != _NONE else None


def _capture(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(END.encode())
    kind = headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        size = len(payload)
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not have its digest")
    else:
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), size, digest, kind, _page(headers.get("WARC-Refers-To"))


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives; those of one file come as one sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = sorted((_capture(h, b) for h, b in read_records(content.as_py())), key=_order)
                for at in range(0, len(rows), 10_000):
                    yield _batch(rows[at : at + 10_000])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, CAPTURE)


def loser_tree_merge(runs: list[list[tuple]], key=_order) -> Iterator[tuple]:
    """K-way merge: inner nodes hold the loser of their match, the winner moves up."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    head = [(False, key(r[0])) if r else (True,) for r in runs]
    beats = lambda a, b: (head[a], a) < (head[b], b)
    tree = [-1] * k
    for leaf in range(k):
        node, winner = (leaf + k) // 2, leaf
        while node > 0:
            if tree[node] < 0:
                tree[node] = winner
                winner = -1
                break
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        if winner >= 0:
            tree[0] = winner
    while True:
        leaf = tree[0]
        if head[leaf] == (True,):
            return
        yield runs[leaf][at[leaf]]
        at[leaf] += 1
        head[leaf] = (False, key(runs[leaf][at[leaf]])) if at[leaf] < len(runs[leaf]) else (True,)
        node, winner = (leaf + k) // 2, leaf
        while node > 0:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def natural_runs(rows: Iterator[tuple], key=_order) -> list[list[tuple]]:
    """Rows as they come, cut where the order breaks: the sorted runs that reached this range."""
    runs: list[list[tuple]] = []
    last = None
    for row in rows:
        now = key(row)
        if last is None or now < last:
            runs.append([])
        runs[-1].append(row)
        last = now
    return runs


def merge_runs(captures: DataFrame) -> DataFrame:
    """The captures in global order: by range (merge_part), then by place in it (merge_seq)."""
    ranges = max(1, min(shuffle_partitions(captures), MAX_RANGES))
    dealt = captures.repartitionByRange(ranges, "url_key", "warc_date", F.col("page_id").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out, n = [], 0
        for row in loser_tree_merge(natural_runs(rows)):
            out.append((*row, n))
            n += 1
            if len(out) == 10_000:
                yield _numbered(out)
                out = []
        if out:
            yield _numbered(out)

    merged = dealt.mapInArrow(run, f"{CAPTURE}, merge_seq bigint")
    return merged.withColumn("merge_part", F.spark_partition_id())


def capture_places(merged: DataFrame) -> DataFrame:
    """Adds ``capture_place``: the place in the whole history, counted from 0.

    The sizes of the ranges give the offsets; they are at most ``MAX_RANGES`` rows of two numbers.
    """
    rows = settle(merged)
    sizes = rows.groupBy("merge_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("merge_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("merge_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))
    return rows.join(offsets, "merge_part").withColumn("capture_place", F.col("_before") + F.col("merge_seq")).drop("_before")


def _numbered(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*_KINDS, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*_NAMES, "merge_seq"])
