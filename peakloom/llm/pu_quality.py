"""Quality classifier learned from trusted positives and unlabelled text.

The classifier minimises the non-negative unbiased risk: with class prior p, the risk of positives
counts p times, and the risk of negatives is that of unlabelled text less p times that of positives
taken as negatives; where this falls below zero the step goes the other way.  The prior is estimated from
the scores of positives and unlabelled texts alone: a first model is fitted on half of them, and on the other half
the share of unlabelled texts above a score is held against that of positives, at the score where the upper bound
of their ratio is least.  Inputs are shares of character classes and
other figures of the text, cut into quantile bins.

Fitting uses a bounded sample (``positives`` and ``unlabelled`` rows, chosen by a hash of the id);
scoring covers every text.  Texts that are null or empty get the score of the empty text.  Without
trusted positives nothing is learned: every score is 0.5, and the filter keeps all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import packed, unpacked

LIMIT = 0.7


@dataclass(frozen=True)
class PuConfig:
    positives: int = 5_000
    unlabelled: int = 10_000
    steps: int = 1_000
    rate: float = 0.005
    decay: float = 1e-4
    # Chance that a bound of the prior's estimate fails.
    doubt: float = 0.1


# Bins are finer at both ends, where unusual texts stand out.
SHARES = (0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.3, 0.5, 0.7, 0.84, 0.92, 0.96, 0.98, 0.99, 0.995)

# Classes of bytes; each listed character is a class of its own.
_OWN = b".,;:!?#$%&*|<>@/\\'\"()-_=+~^[]{}"
_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _HIGH, _REST = range(7)


def _classes() -> np.ndarray:
    table = np.full(256, _REST, np.int64)
    table[ord("a") : ord("z") + 1] = _LOWER
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[[9, 11, 12, 13, 32]] = _BLANK
    table[10] = _LINE
    table[128:] = _HIGH
    for i, c in enumerate(_OWN):
        table[c] = _REST + 1 + i
    return table


CLASSES = _classes()
N_CLASSES = _REST + 1 + len(_OWN)
N_FEATURES = 3 * N_CLASSES + 12


def features(text: str | None) -> np.ndarray:
    """Figures of a text; all zero for an empty one."""
    out = np.zeros(N_FEATURES, np.float32)
    data = (text or "").encode("utf-8")
    if not data:
        return out
    kind = CLASSES[np.frombuffer(data, np.uint8)]
    gap = (kind == _BLANK) | (kind == _LINE)
    out[:N_CLASSES] = np.bincount(kind, minlength=N_CLASSES) / len(kind)
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    ends = np.flatnonzero(~gap & np.r_[gap[1:], True])
    n = len(starts)
    lines = data.split(b"\n")
    full = [x for x in lines if x.strip()]
    at = 3 * N_CLASSES
    if n:
        out[N_CLASSES : 2 * N_CLASSES] = np.bincount(kind[starts], minlength=N_CLASSES) / n
        out[2 * N_CLASSES : at] = np.bincount(kind[ends], minlength=N_CLASSES) / n
        size = ends - starts + 1
        words = data.lower().split()
        out[at : at + 12] = (
            size.mean(),
            size.std(),
            (size <= 3).mean(),
            (size >= 12).mean(),
            np.log1p(n),
            len(set(words)) / n,
            len(full) / n,
            1 - len(set(full)) / len(full),
            ((size == 1) & (kind[starts] > _REST)).mean(),
            np.log1p(size.max()),
            len(set(zip(words, words[1:], strict=False))) / n,
            sum(map(bytes.__eq__, words, words[1:])) / n,
        )
    return out


@dataclass
class Model:
    places: np.ndarray
    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(binned(x, self.places, self.edges) @ self.weights + self.bias, -30, 30)))


def binned(x: np.ndarray, places: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For every bin edge whether the feature at its place exceeds it."""
    return (x[:, places] > edges).astype(np.float32)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, config: PuConfig = PuConfig()) -> Model:
    """Full-batch Adam on the non-negative risk with the sigmoid loss; late steps are averaged.

    Many bins of a feature move together, so the rate is small and falls to zero.
    """
    found = [np.unique(e) for e in np.quantile(unlabelled, SHARES, axis=0).T.astype(np.float32)]
    places, edges = np.repeat(np.arange(len(found)), [len(e) for e in found]), np.concatenate(found)
    p, u = binned(positive, places, edges), binned(unlabelled, places, edges)
    w = np.zeros(p.shape[1] + 1)
    m, v, mean = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    late = config.steps - config.steps // 2

    def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean of the sigmoid of the margins, and its gradient."""
        s = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -60, 60)))
        each = s * (1 - s)
        return s.mean(), np.append(each.astype(np.float32) @ x, each.sum()) / len(x)

    for step in range(1, config.steps + 1):
        # The sigmoid loss of a row taken as negative is s, taken as positive 1 - s.
        (of_p, up), (of_u, all_up) = slope(p), slope(u)
        down = all_up - prior * up
        grad = down - prior * up if of_u - prior * of_p >= 0 else -down
        grad[:-1] += config.decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w -= config.rate * (1 - (step - 1) / config.steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if step > config.steps - late:
            mean += w / late
    return Model(places, edges, mean[:-1].astype(np.float32), float(mean[-1]), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, config: PuConfig = PuConfig()) -> float:
    """Share of positives among unlabelled rows, by the best top bin of a first model's scores."""
    first = fit(positive[::2], unlabelled[::2], 0.5, config)
    of_p, of_u = (np.sort(first.scores(x)) for x in (positive[1::2], unlabelled[1::2]))
    if not len(of_p) or not len(of_u):
        return 0.5
    at = np.unique(of_p)
    share_p = 1 - np.searchsorted(of_p, at) / len(of_p)
    share_u = 1 - np.searchsorted(of_u, at) / len(of_u)
    doubt = sum(math.sqrt(math.log(4 / config.doubt) / (2 * len(x))) for x in (of_p, of_u))
    best = int(np.argmin((share_u + doubt) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _feature_rows(df: DataFrame, keep: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(rows, pa.list_(pa.float32()))], [keep, "x"])

    return df.select(keep, "text").mapInArrow(run, f"{keep} {kind}, x array<float>")


def learn(docs: DataFrame, labels: DataFrame, config: PuConfig = PuConfig()) -> Model | None:
    """Fits on a bounded sample; labels come only from rows that are not held out."""
    known = labels.filter(~held_out() & (F.col("quality") == 1)).select("doc_id").distinct()
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = known.orderBy(order).limit(config.positives)
    total = docs.count()
    share = min(1.0, config.unlabelled / max(total, 1))
    sampled = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 24)) < int(share * (1 << 24)) if share < 1 else F.lit(True)
    # At most ``positives`` ids are broadcast.
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumn("_p", F.lit(True))), "doc_id", "left")
    marked = marked.withColumn("_u", F.coalesce(sampled, F.lit(False))).filter("_p OR _u")
    kinds = marked.select(F.concat(F.when(F.col("_p"), "p").otherwise(""), F.when(F.col("_u"), "u").otherwise("")).alias("kind"), "text")
    rows = _feature_rows(kinds, "kind", "string").limit(2 * (config.positives + config.unlabelled)).toArrow()
    x = rows.column("x").combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    kind = np.array(rows.column("kind").to_pylist())
    positive = x[np.char.find(kind, "p") >= 0]
    unlabelled = x[np.char.find(kind, "u") >= 0]
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled, config), config)


def add_scores(df: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``score`` to rows with a ``text``; other columns stay."""
    if model is None:
        return df.withColumn("score", F.lit(0.5))
    sent = df.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            score = sent.value.scores(np.stack(x)).astype(np.float64) if x else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return df.mapInArrow(run, f"{fields}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, config: PuConfig = PuConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = add_scores(docs.select("doc_id", "text"), learn(docs, labels, config)).select("doc_id", "score")
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= LIMIT).cast("int")})


def keep_good(docs: DataFrame, labels: DataFrame, config: PuConfig = PuConfig()) -> DataFrame:
    """The rows whose score reaches the limit, with their own columns."""
    model = learn(docs, labels, config)
    if model is None:
        return docs
    scored = add_scores(packed(docs, "text"), model).filter(F.col("score") >= LIMIT)
    return scored.select(*unpacked(docs.columns))
