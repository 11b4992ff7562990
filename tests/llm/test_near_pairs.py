import random

import numpy as np
import pyarrow as pa

from peakloom.llm import simhash


def _sets(texts, shingle=5):
    return [set(simhash.shingle_hashes(t, shingle).tolist()) for t in texts]


def _kept(texts, similarity=0.8):
    """Smallest id of each component of all pairs, by brute force."""
    sets, root = _sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def _texts():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5_000)}"
    line = [word() for _ in range(12)]
    texts = []
    for _ in range(40):
        base = line + [word() for _ in range(rng.randrange(20, 120))]
        texts.append(" ".join(base))
        for _ in range(4):
            # One word changed touches five shingles: similarities about the limit.
            some = list(base)
            for _ in range(max(1, len(base) // 47)):
                some[rng.randrange(len(some))] = word()
            texts.append(" ".join(some))
    return texts


def test_no_pair_is_left(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"] for r in simhash.near_dedup(docs).collect()}
    assert out == _kept(texts)


def test_no_pair_is_left_without_bands(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"] for r in simhash.near_dedup(docs, bands=1).collect()}
    assert out == _kept(texts)


def test_pairs_over_batches():
    rows = [(1, s, 0, i, i) for i, s in enumerate([10, 10, 11, 12, 13, 40])] + [(2, 10, 9, 20, 20), (2, 10, 0, 21, 21)]
    cols = [np.array(c, t) for c, t in zip(zip(*rows), (np.int64, np.int32, np.int32, np.int64, np.int64))]
    names = ["token", "size", "place", "member", "part"]

    def pairs(step):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + step]) for c in cols], names) for a in range(0, len(rows), step)]
        return {(a, b) for o in simhash._cross_pairs(0.8)(iter(batches)) for a, b in zip(o.column(0).to_pylist(), o.column(1).to_pylist())}

    want = {(i, j) for i in range(5) for j in range(i + 1, 5) if rows[i][1] >= 0.8 * rows[j][1]}
    assert pairs(len(rows)) == pairs(1) == pairs(3) == want
