"""Benchmark decontamination by winnowing.

Words are lower-cased runs of digits, ASCII letters and everything beyond ASCII.  A window of ``window``
words is covered by w = window - k + 1 hashed k-grams; the least of each w (the rightmost of equals) is a
fingerprint.  Equal windows choose the same place, so every shared span of ``window`` words shares a
fingerprint at the same place.  Fingerprints of documents and benchmark are joined, and each hit is
extended word by word in both directions; spans of a whole window or more stay, so results are exact.

An item of fewer words is one window of its own length: it is winnowed with that length, and documents
are winnowed once for each of the (at most ``window``) lengths in use.  Two bit sets of fixed size,
of the fingerprints and of the windows of the benchmark, keep most document fingerprints out of the
shuffle; they lose none.  Documents never meet in one task: a fingerprint that a third of them
holds is dealt over ``SALTS`` parts, before adaptive execution splits further.

Items with equal words are compared once.  Nulls and texts without words have no windows; null and
repeated document ids keep rows of their own; items are told apart by id, a null item id hits words but
is not listed.  An empty benchmark gives no hits, an empty document table no rows.  Columns besides id
and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import chunks, settle, with_row

SALTS = 16
SLICE_BYTES = 1 << 20
# Letters in lower case, digits and bytes beyond ASCII stay; the rest parts words.
_CLASS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_STEP, _MIX, _GRAM = (np.uint64(x) for x in (0x100000001B3, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_SEED = "at int, t int, h bigint, words array<string>"
_SEED_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("t", pa.int32()), ("h", pa.int64()), ("words", pa.list_(pa.string()))]))


@dataclass(frozen=True)
class WinnowConfig:
    window: int = 10
    # Size of each of the two bit sets that go to the workers: 2 MB.
    filter_bits: int = 24


def gram_size(t: int) -> int:
    """Words of a hashed gram of a window of t words."""
    return (t + 1) // 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


class _Words:
    """The words of some texts, in one flat array of hashes."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "replace").translate(_CLASS) for t in texts]
        self.blob = b" ".join(parts) + b" "
        flat = np.frombuffer(self.blob, np.uint8)
        inside = flat != 32
        edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
        self.begin, self.stop = edge[0::2], edge[1::2]
        # Texts begin after the separator of the one before.
        text_at = np.r_[0, np.cumsum([len(p) + 1 for p in parts])]
        self.first = np.searchsorted(self.begin, text_at)
        self.count = np.diff(self.first)
        size = self.stop - self.begin
        n = len(size)
        self.hash = np.zeros(n, np.uint64)
        if n:
            power = np.cumprod(np.full(int(size.max()), _STEP))
            chars = flat[inside].astype(np.uint64) + np.uint64(1)
            start = np.cumsum(size) - size
            chars *= power[np.arange(len(chars)) - np.repeat(start, size)]
            self.hash = _mix(np.add.reduceat(chars, start))
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.left = self.first[self.text + 1] - np.arange(n) if n else np.zeros(0, np.int64)

    def grams(self, k: int, t: int) -> np.ndarray:
        """Hash of the k words from each place on; windows of different lengths never share one."""
        m = max(0, len(self.hash) - k + 1)
        out = np.full(m, np.uint64(t))
        for j in range(k):
            out = out * _GRAM + self.hash[j : j + m]
        return _mix(out)

    def fingerprints(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the chosen grams, and the hashes of all grams."""
        k = gram_size(t)
        h, m = self.grams(k, t), len(self.hash) - t + 1
        if m <= 0:
            return np.zeros(0, np.int64), h
        least, at = h[:m].copy(), np.arange(m)
        for j in range(1, t - k + 1):
            later = h[j : j + m]
            take = later <= least
            least[take] = later[take]
            at[take] = np.flatnonzero(take) + j
        chosen = np.zeros(len(self.hash), bool)
        chosen[at[self.left[:m] >= t]] = True
        return np.flatnonzero(chosen), h

    def near_window(self, places: np.ndarray, t: int, held: np.ndarray, bits: int) -> np.ndarray:
        """Whether one of the windows around a gram is in the bit set."""
        hashes = self.grams(t, t)
        found = _held(hashes, held, bits) & (self.left[: len(hashes)] >= t)
        run = np.r_[0, np.cumsum(found)]
        low = np.maximum(places - (t - gram_size(t)), 0)
        return run[np.minimum(places + 1, len(hashes))] > run[np.minimum(low, len(hashes))]

    def around(self, place: int, t: int) -> list[str | None]:
        """The words that a window over the gram can reach; None beyond the text."""
        a, b = self.first[self.text[place]], self.first[self.text[place] + 1]
        reach = range(place - (t - gram_size(t)), place + t)
        return [self.blob[self.begin[i] : self.stop[i]].decode("utf-8", "replace") if a <= i < b else None for i in reach]

    def digest(self, i: int) -> str | None:
        """Names the word sequence of a text."""
        if not self.count[i]:
            return None
        a, b = self.first[i], self.first[i + 1]
        return hashlib.sha256(b" ".join(self.blob[self.begin[a] : self.stop[b - 1]].split())).hexdigest()


def _held(hashes: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _item_seeds(items: DataFrame, window: int) -> DataFrame:
    """_row, _item, key, t, windows, seeds: all fingerprints and window hashes of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, SLICE_BYTES):
                own = [_Words([t]) for t in texts[a:b]]
                span = [min(window, int(w.count[0])) for w in own]
                seeds, windows = [], []
                for words, t in zip(own, span, strict=True):
                    places, h = words.fingerprints(t) if t else ((), ())
                    seeds.append([{"at": int(p), "t": t, "h": int(h[p].view(np.int64)), "words": words.around(int(p), t)} for p in places])
                    windows.append(words.grams(t, t).view(np.int64) if t else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_row").slice(a, b - a),
                        batch.column("_item").slice(a, b - a),
                        pa.array([w.digest(0) for w in own], pa.string()),
                        pa.array(span, pa.int32()),
                        pa.array(windows, pa.list_(pa.int64())),
                        pa.array(seeds, _SEED_TYPE),
                    ],
                    ["_row", "_item", "key", "t", "windows", "seeds"],
                )

    return items.mapInArrow(run, f"_row bigint, _item string, key string, t int, windows array<bigint>, seeds array<struct<{_SEED}>>")


def _bit_set(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bit set of a column ``h``, put together by Spark; at most 2 ** bits / 32 rows come to the driver."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    parts = hashes.groupBy(F.shiftright(slot, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int"))).alias("mask"))
    found = parts.toArrow()
    out = np.zeros(1 << (bits - 5), "<u4")
    out[found["at"].to_numpy()] = found["mask"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _document_seeds(docs: DataFrame, spans: list[int], prints: np.ndarray, windows: np.ndarray, bits: int) -> DataFrame:
    """_row, _id, n_words, seeds: the fingerprints of every document that the benchmark may hold."""
    held = docs.sparkSession.sparkContext.broadcast((prints, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, whole = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, SLICE_BYTES):
                words = _Words(texts[a:b])
                seeds: list[list[dict]] = [[] for _ in range(b - a)]
                for t in spans:
                    places, h = words.fingerprints(t)
                    places = places[_held(h[places], known, bits)]
                    for p in places[words.near_window(places, t, whole, bits)].tolist():
                        i = int(words.text[p])
                        seeds[i].append({"at": p - int(words.first[i]), "t": t, "h": int(h[p].view(np.int64)), "words": words.around(p, t)})
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("_row", "_id")), pa.array(words.count, pa.int64()), pa.array(seeds, _SEED_TYPE)],
                    ["_row", "_id", "n_words", "seeds"],
                )

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_row bigint, _id {kind}, n_words bigint, seeds array<struct<{_SEED}>>")


def _salted_join(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join that deals the rows of a hot key of ``many`` over SALTS parts."""
    left = many.withColumn("_salt", F.pmod(F.hash("_row"), F.lit(SALTS)))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def _extend(t: Column, at: Column, own: Column, other: Column) -> Column:
    """Struct (start, stop) in words of the document: the equal words around the gram of ``t`` at ``at``."""
    lead = t - F.ceil(t / 2).cast("int")
    wrong = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: ~F.coalesce(F.get(own, i) == F.get(other, i), F.lit(False)))
    before = F.coalesce(F.array_max(F.filter(wrong, lambda i: i < lead)), F.lit(-1))
    after = F.coalesce(F.array_min(F.filter(wrong, lambda i: i >= lead)), F.size(own))
    return F.struct((at - lead + before + 1).alias("start"), (at - lead + after).alias("stop"))


def _merged(spans: DataFrame) -> DataFrame:
    """_row, spans: the ranges of each row joined where they touch or overlap."""
    order = Window.partitionBy("_row").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")
    numbered = spans.withColumn("_new", begins).withColumn("_part", F.sum("_new").over(order))
    parts = numbered.groupBy("_row", "_part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return parts.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def overlaps(docs: DataFrame, benchmark: DataFrame, config: WinnowConfig = WinnowConfig(), doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """doc id, n_words, spans, items of every document.

    ``spans``: the hit word ranges (start, stop), apart and in order; ``items``: the ids of the items with
    a window in the document, as strings, sorted; ``n_items`` counts them, a null id included.
    """
    rows = with_row(docs.select(F.col(doc_id).alias("_id"), "text")).select("_row", "_id", "text")
    items = with_row(benchmark.select(F.col(item_id).cast("string").alias("_item"), "text")).select("_row", "_item", "text")
    own = settle(_item_seeds(items, config.window).filter(F.col("key").isNotNull()))
    heads = own.groupBy("key").agg(F.min("_row").alias("_row")).select("_row")
    one = settle(own.join(heads, "_row", "left_semi"))
    grams = one.select("key", F.inline("seeds")).select("key", "h", F.col("words").alias("other")).distinct()
    prints = _bit_set(grams.select("h"), config.filter_bits)
    windows = _bit_set(one.select(F.explode("windows").alias("h")), config.filter_bits)
    spans = sorted(r["t"] for r in one.select("t").distinct().collect())
    found = settle(_document_seeds(rows, spans, prints, windows, config.filter_bits))

    met = _salted_join(found.select("_row", F.inline("seeds")), grams, "h")
    hits = met.withColumn("_hit", _extend(F.col("t"), F.col("at"), F.col("words"), F.col("other")))
    hits = settle(hits.filter(F.col("_hit.stop") - F.col("_hit.start") >= F.col("t")).select("_row", "key", "_hit.start", "_hit.stop").distinct())
    ids = own.select("key", "_item").distinct()
    listed = _salted_join(hits.select("_row", "key").distinct(), ids, "key").select("_row", "_item").distinct()
    listed = listed.groupBy("_row").agg(F.array_sort(F.collect_list("_item")).alias("items"), F.count("*").alias("n_items"))
    full = found.select("_row", "_id", "n_words").join(_merged(hits.select("_row", "start", "stop").distinct()), "_row", "left").join(listed, "_row", "left")
    return full.select(
        F.col("_id").alias(doc_id),
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
    )
