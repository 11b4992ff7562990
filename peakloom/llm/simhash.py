"""SimHash fingerprints and near duplicates by anchor-point covering.

A fingerprint bit is 1 if it is set in more than half of the XXH64 hashes of the word shingles.

Linking.  The anchors are the words of a covering code: a perfect Hamming code on all but one bit
of the fingerprint (covering radius 1), times that one free bit (radius 0).  Two fingerprints that
differ in at most two bits have a midpoint within one bit of both, and the midpoint has an anchor
within the covering radius.  So both copies sent to every anchor within radius plus half the
threshold meet; that takes 33 copies of a 64-bit fingerprint, where sending one side to radius plus
the whole threshold would take 653.  At most 2,081 different fingerprints lie that near to one
anchor, so no anchor group grows with the data; equal fingerprints are merged first.

Nulls: a null text has no words.  Rows without words have fingerprint zero.  Repeated rows are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom import session
from peakloom.llm.common import GAP, ascii_lower, broadcast_checked, packed, settle, shuffle_partitions, tokens_of, unpacked, with_row, written
from peakloom.operators.components import connected_components

SEED = 42
REACH_BITS = 2


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; the whole sequence if there are fewer words."""
    words = tokens_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits from the same hashes; lane 0 keeps them."""
    if not lane:
        return hashes
    x = hashes ^ np.uint64((lane * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprints(df: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """Replaces ``text`` by ``fp``: a long, or with several lanes an array of longs (signed 64 bits)."""
    rest = [c for c in df.columns if c != "text"]
    kind = "bigint" if lanes == 1 else "array<bigint>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = np.zeros((len(texts), lanes), np.uint64)
            for i, text in enumerate(texts):
                hashes = shingle_hashes(text.as_py(), shingle)
                for lane in range(lanes):
                    found[i, lane] = majority(mixed(hashes, lane))
            signed = found.view(np.int64)
            fp = pa.array(signed[:, 0]) if lanes == 1 else pa.array(list(signed), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), fp], [*rest, "fp"])

    return df.select(*rest, "text").mapInArrow(run, f"{fields}, fp {kind}")


def _pairs_of(width: int) -> np.ndarray:
    """For each syndrome the bit patterns, of at most two bits, that lead to an anchor near enough."""
    out = []
    for s in range(width):
        if s == 0:
            near = [0, 1]
        else:
            near = [1 << s] + [(1 << i) | (1 << (i ^ s)) for i in range(width) if i < i ^ s]
        out.append(near + [near[0]] * (width // 2 + 1 - len(near)))
    return np.array(out, np.uint64)


def anchors(values: np.ndarray, width: int = 64) -> np.ndarray:
    """Anchors of each value, one row each; ``width`` is a power of two, bit 0 is the free bit.

    The syndrome is the XOR of the places of the set bits.  Rows of fewer anchors repeat one.
    """
    syndrome = np.zeros(len(values), np.int64)
    for j in range(width.bit_length() - 1):
        mask = np.uint64(sum(1 << i for i in range(width) if i >> j & 1))
        syndrome |= (np.bitwise_count(values & mask) & 1).astype(np.int64) << j
    return values[:, None] ^ _pairs_of(width)[syndrome]


def _group_roots(values: np.ndarray, most: int) -> np.ndarray:
    """Smallest value of each value's component, where links join values that differ in at most ``most`` bits."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= most
    root = np.arange(len(values))
    while True:
        low = np.where(near, root[None, :], len(values)).min(axis=1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def link_fingerprints(distinct: DataFrame, bits: int = REACH_BITS) -> DataFrame:
    """src, dst: star links inside each anchor group of a table of different ``fp``.

    Their components are those of all pairs that differ in at most ``bits`` (0 to 2) bits.
    """
    if not 0 <= bits <= REACH_BITS:
        raise ValueError("anchors reach pairs of at most two differing bits")

    @F.pandas_udf("array<bigint>")
    def near(fp: pd.Series) -> pd.Series:
        rows = anchors(fp.to_numpy(np.int64).view(np.uint64)).view(np.int64)
        return pd.Series([np.unique(r) for r in rows])

    @F.pandas_udf("array<struct<src:bigint,dst:bigint>>")
    def stars(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            values = np.unique(np.asarray(group, np.int64))
            root = values[_group_roots(values.view(np.uint64), bits)]
            out.append([{"src": int(v), "dst": int(r)} for v, r in zip(values, root, strict=True) if v != r])
        return pd.Series(out)

    placed = distinct.select("fp", F.explode(near("fp")).alias("anchor"))
    groups = placed.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    return groups.select(F.inline(stars("fps"))).distinct()


def near_components(docs: DataFrame, shingle: int = 3, bits: int = REACH_BITS) -> DataFrame:
    """doc_id, fp, component_id for every row of (doc_id, text): components of linked fingerprints.

    ``component_id`` is the smallest doc_id reachable; null only where every reachable id is null.
    """
    prints = settle(fingerprints(docs.select("doc_id", "text"), shingle))
    least = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(settle(link_fingerprints(least, bits)), cut=session.written)
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = settle(named)
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = named.join(lowest, "component").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


# --- near duplicates by similarity ---------------------------------------------------------
#
# At a similarity of 0.8 fingerprints differ in 15 % of their bits, too many for the reach of the
# anchors above.  So 32-bit samples are taken from a long fingerprint, and each is sent to the
# anchor nearest to it.  Texts that share an anchor and agree in most of one lane are compared exactly.
# That joins most of a large group by few links.  What it misses is found by an exact join: shingles
# stand in one order for all texts, frequent ones last, and two sets of similarity t share one of the
# first n - ceil(t n) + 1 of both.  Texts that share one and are not yet joined are compared exactly.

LANES = 10
BANDS = 32
# Shingles met this often in a batch are put last in the order; only the most frequent ones are sent.
FREQUENT = 3
MAX_FREQUENT = 500_000
BAND_BITS = 32
CHECK_BITS = 21
# Row numbers are broadcast up to this many (8 bytes each); beyond it the join is shuffled.
MAX_BROADCAST_ROWS = 200_000


def _band_places(lanes: int, bands: int) -> np.ndarray:
    return np.stack([np.random.default_rng(b).permutation(64 * lanes)[:BAND_BITS] for b in range(bands)])


def _homes(prints: DataFrame, lanes: int, bands: int) -> DataFrame:
    """key, member, check: the home anchor of each band of each row (_row, fp)."""
    places = _band_places(lanes, bands)
    weights = np.uint64(1) << np.arange(BAND_BITS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row").to_numpy(zero_copy_only=False)
            flat = batch.column("fp").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), lanes)
            for at in range(0, len(rows), 2_048):
                some = np.ascontiguousarray(flat[at : at + 2_048])
                bits = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little")
                for band, place in enumerate(places):
                    sample = (bits[:, place].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
                    home = anchors(sample, BAND_BITS)[:, 0] | np.uint64(band << BAND_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(home.view(np.int64)), pa.array(rows[at : at + 2_048]), pa.array(some[:, 0])], ["key", "member", "check"])

    return prints.select("_row", "fp").mapInArrow(run, "key bigint, member bigint, check bigint")


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star links from rows sorted by (key, member): each member to the first leader it agrees with.

    A member that agrees with no leader becomes one.  A group that runs over several batches keeps
    only its leaders between them.
    """
    key_now, leaders, checks = None, [], np.empty(0, np.uint64)
    for batch in batches:
        key, member, check = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        check = check.view(np.uint64)
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
        src, dst = [], []
        for a, b in zip(starts, ends, strict=True):
            if key[a] != key_now:
                key_now, leaders, checks = key[a], [], np.empty(0, np.uint64)
                if b - a == 1 and b < len(key):
                    continue
            left = np.arange(a, b)
            tried = 0
            while len(left):
                if tried == len(leaders):
                    leaders.append(member[left[0]])
                    checks = np.append(checks, check[left[0]])
                    left = left[1:]
                near = np.bitwise_count(check[left] ^ checks[tried]) <= CHECK_BITS
                src.append(member[left[near]])
                dst.append(np.full(int(near.sum()), leaders[tried]))
                left = left[~near]
                tried += 1
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src).astype(np.int64)), pa.array(np.concatenate(dst).astype(np.int64))], ["src", "dst"])


def similar_enough(pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (src, dst) of (src, dst, src_text, dst_text) whose shingle sets have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("src_text"), batch.column("dst_text"), strict=True):
                x, y = (set(shingle_hashes(t.as_py(), shingle).tolist()) for t in (a, b))
                keep.append(len(x & y) >= similarity * len(x | y))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "src bigint, dst bigint")


def frequent_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of frequent shingles: a summary of bounded size that decides speed, never results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column("text")]
            value, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            often = n >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

    counts = texts.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top["n"].to_numpy(np.int64)[order]


def prefix(hashes: np.ndarray, similarity: float, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set of hashes that a set of that similarity must share one of; frequent ones come last."""
    hashes = np.unique(hashes)
    weight = np.zeros(len(hashes), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
        weight = np.where(tokens[at] == hashes, counts[at], 0)
    # The guard keeps float noise from raising the number of shared shingles.
    keep = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    return hashes[np.lexsort((hashes, weight))][:keep]


def _prefix_rows(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """token, size, place, member, part: a row for each prefix shingle of (_row, part, text)."""
    frequent = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "size", "place", "member", "part"]
        for batch in batches:
            for a in range(0, batch.num_rows, 1_024):
                out = []
                some = batch.slice(a, 1_024)
                for row, part, text in zip(some.column("_row").to_pylist(), some.column("part").to_pylist(), some.column("text"), strict=True):
                    hashes = np.unique(shingle_hashes(text.as_py(), shingle))
                    first = prefix(hashes, similarity, *frequent.value).view(np.int64)
                    n = len(first)
                    out.append((first, np.full(n, len(hashes), np.int32), np.arange(n, dtype=np.int32), np.full(n, row), np.full(n, part)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return texts.select("_row", "part", "text").mapInArrow(run, "token bigint, size int, place int, member bigint, part bigint")


def _cross_pairs(similarity: float):
    """src, dst from rows sorted by (token, size): members of different parts whose sizes and places allow the similarity.

    Of a token that runs over several batches only the members that are not too small for the next ones are kept.
    """
    share = similarity / (1 + similarity)

    def meet(token, size, place, member, part) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one token, in tiles."""
        src, dst = [], []
        low = np.searchsorted(size, np.ceil(similarity * size - 1e-9))
        for a in range(0, len(size), 256):
            b, start = min(a + 256, len(size)), low[a]
            here, there = np.arange(a, b)[:, None], np.arange(start, b)[None, :]
            rest = np.minimum(size[here] - place[here], size[there] - place[there])
            ok = (there < here) & (part[here] != part[there]) & (rest >= share * (size[here] + size[there]) - 1e-9)
            x, y = np.nonzero(ok)
            src.append(member[x + a])
            dst.append(member[y + start])
        return np.concatenate(src), np.concatenate(dst)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None and len(cols[0]) and held[0][0] == cols[0][0]:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            cuts = np.flatnonzero(np.diff(cols[0])) + 1
            src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(cols[0])]
            for a, b in zip(starts, ends, strict=True):
                if b - a > 1 and (cols[4][a:b] != cols[4][a]).any():
                    x, y = meet(*(c[a:b] for c in cols))
                    src.append(x)
                    dst.append(y)
            last, size = starts[-1], cols[1]
            near = size[last:] >= similarity * size[-1] - 1e-9
            held = [c[last:][near] for c in cols]
            x, y = np.concatenate(src), np.concatenate(dst)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["src", "dst"])

    return run


def _checked(links: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (src, dst) of candidate links that are similar enough; only texts with a candidate are moved."""
    linked = broadcast_checked(links.select(F.explode(F.array("src", "dst")).alias("_row")).distinct(), MAX_BROADCAST_ROWS)
    texts = written(rows.select("_row", "text").join(linked, "_row", "left_semi"))
    a = texts.select(F.col("_row").alias("src"), F.col("text").alias("src_text"))
    b = texts.select(F.col("_row").alias("dst"), F.col("text").alias("dst_text"))
    return written(similar_enough(links.join(a, "src").join(b, "dst"), shingle, similarity))


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = LANES, bands: int = BANDS) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``: the smallest doc_id.

    Rows whose lower-cased words are equal are one text.  Links between different texts are checked
    on their shingle sets; groups are the components of the links.  Sampled bands join most of a group,
    the exact join of prefixes finds every other pair, so the components are those of all links.
    """
    rows = with_row(packed(docs, "doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), GAP, " "))
    same = F.md5(ascii_lower(words))
    prints = written(fingerprints(rows.select("_row", "doc_id", same.alias("same"), "text"), shingle, lanes))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")).alias("h")
    heads = written(prints.groupBy("same").agg(head)).select(F.col("h._row").alias("_row"), F.col("h.doc_id").alias("_id"))
    placed = _homes(prints.join(heads, "_row", "left_semi"), lanes, bands)
    placed = placed.repartition(shuffle_partitions(docs), "key").sortWithinPartitions("key", "member")
    links = written(placed.mapInArrow(_leaders, "src bigint, dst bigint").distinct())
    quick = _checked(links, rows, shingle, similarity)
    parts = connected_components(quick, cut=written).withColumnRenamed("node", "_row").withColumnRenamed("component", "part")
    of_head = heads.select("_row").join(parts, "_row", "left").select("_row", F.coalesce("part", "_row").alias("part"))
    told = rows.select("_row", "text").join(written(of_head), "_row")
    tokens = _prefix_rows(told, shingle, similarity)
    tokens = tokens.repartition(shuffle_partitions(docs), "token").sortWithinPartitions("token", "size")
    others = written(tokens.mapInArrow(_cross_pairs(similarity), "src bigint, dst bigint").distinct())
    true = quick.unionByName(_checked(others, rows, shingle, similarity))
    roots = connected_components(true, cut=written).withColumnRenamed("node", "_row")
    grouped = heads.join(roots, "_row").groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_row")).alias("h"))
    near = roots.join(grouped.select(F.col("h._row").alias("_row")), "_row", "left_anti").select("_row")
    copies = prints.select("_row").join(heads.select("_row"), "_row", "left_anti")
    gone = broadcast_checked(written(copies.unionByName(near)), MAX_BROADCAST_ROWS)
    return rows.join(gone, "_row", "left_anti").select(*unpacked(docs.columns))
