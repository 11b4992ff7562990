"""Quality rules whose cutoffs are certified on labelled holdouts.

Every rule is a ratio of two counts with a sequence of cutoffs from lenient to strict.  For each
language the labelled good documents show how many a cutoff would reject.  A cutoff passes when an
exact binomial test says that its false rejection rate is below the rule's share of the risk; the
sequence stops at the first cutoff that does not pass (fixed-sequence testing), and rules and
languages share the error level (Bonferroni).  Without enough labels nothing passes and only the
base rule rejects.

Only DataFrame functions are used.  Nulls: a null text has no words, a null language is a stratum
of its own.  Repeated rows are judged one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import WORD, broadcast_checked, packed, settle, text_of, unpacked, words_of

SYMBOLS = "#*$%&|<>"

MEASURES = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_capitals")

# More strata than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_STRATA = 1_000


@dataclass(frozen=True)
class Rule:
    """Rejects a document when 100 * part > cutoff * whole; cutoffs run from lenient to strict."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (60, 50, 40, 30, 20, 15, 10, 8, 6, 4, 3)),
    Rule("capitals", "n_capitals", "word_chars", (90, 80, 70, 60, 50, 40, 30, 25, 20)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (90, 80, 70, 60, 50, 40, 30, 20)),
    Rule("repeats", "n_repeat_words", "n_words", (50, 45, 40, 35, 30, 25, 20, 15)),
    Rule("word_length", "word_chars", "n_words", (2000, 1800, 1600, 1500, 1400, 1300, 1200, 1100, 1000)),
)


@dataclass(frozen=True)
class RiskConfig:
    """``risk``: share of good documents that may be lost per stratum; ``error``: chance that this is exceeded."""

    risk: float = 0.05
    error: float = 0.05
    rules: tuple[Rule, ...] = RULES


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, the four contract counts, n_lines, n_capitals and ``_mark``.

    ``_mark`` is not deterministic, so Catalyst evaluates the counts once and does not copy their
    expressions into a filter above.
    """
    own = df.withColumn("_t", text_of(text)).withColumn("_w", words_of(F.col("_t")))
    windows = F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    own = own.withColumn("_h", F.when(F.size("_w") >= 3, F.slice(windows, F.lit(1), F.size("_w") - 2)))
    own = own.withColumn("_l", F.filter(F.split("_t", "\n"), lambda line: line.rlike(WORD)))
    own = own.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda e, j: F.coalesce(e["h"] == F.get("_s", j)["h"], F.lit(False))
    own = own.withColumn("_d", F.filter("_s", lambda e, j: same(e, j - 1) | same(e, j + 1)))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_d", lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    # What is not counted goes in whole runs, and the rest is measured.
    only = lambda kept: F.char_length(F.regexp_replace("_t", f"[^{kept}]+", "")).cast("long")
    return own.select(
        *df.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        only(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        only("A-Z").alias("n_capitals"),
        F.monotonically_increasing_id().alias("_mark"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _exceeds(rule: Rule, cutoff: int | Column) -> Column:
    return 100 * F.col(rule.part) > cutoff * F.col(rule.whole)


def _at_most(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed downwards from the largest term; 1 where k is not below the mean."""
    odds = p / (1 - p)
    first = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")),
        n * math.log1p(-p),
        lambda s, i: s + F.log((n - i + 1) / i * odds),
    )
    total = F.aggregate(
        F.when(k >= 1, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct(
            (a["t"] * i / (n - i + 1) / odds).alias("t"),
            (a["s"] + a["t"] * i / (n - i + 1) / odds).alias("s"),
        ),
        lambda a: a["s"],
    )
    return F.when(k >= n * p, 1.0).otherwise(F.exp(first) * total)


def certified_cutoffs(good: DataFrame, stratum: str, config: RiskConfig = RiskConfig()) -> DataFrame:
    """One row per stratum with the certified cutoff of every rule, null where none passes.

    ``good``: measured documents that are labelled good and have not failed the base rule.
    """
    sums = [F.sum(_exceeds(rule, c).cast("long")).alias(f"{rule.name}_{c}") for rule in config.rules for c in rule.cutoffs]
    counts = settle(good.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), *sums))
    # One row of one number: the number of strata.
    strata = F.broadcast(counts.agg(F.count("*").alias("strata")))
    share = config.risk / len(config.rules)
    level = F.lit(config.error / len(config.rules)) / F.col("strata")
    tests = F.array(
        *[
            F.struct(F.lit(rule.name).alias("rule"), F.lit(step).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{rule.name}_{c}").alias("k"))
            for rule in config.rules
            for step, c in enumerate(rule.cutoffs)
        ]
    )
    tested = counts.crossJoin(strata).select("stratum", "n", "strata", F.inline(tests))
    tested = tested.withColumn("ok", _at_most(F.col("k"), F.col("n"), share) <= level)
    # The strictest cutoff before the first one that does not pass.
    first = Window.partitionBy("stratum", "rule")
    passed = tested.withColumn("stop", F.min(F.when(~F.col("ok"), F.col("step"))).over(first)).filter("stop IS NULL OR step < stop")
    best = passed.groupBy("stratum", "rule").agg(F.max_by("cutoff", "step").alias("cutoff"))
    chosen = [F.max(F.when(F.col("rule") == rule.name, F.col("cutoff"))).alias(f"cut_{rule.name}") for rule in config.rules]
    return settle(best.groupBy("stratum").agg(*chosen))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Adds base_failed and kept; a document of a stratum without certified cutoffs faces the base rule only."""
    cuts = [f"cut_{rule.name}" for rule in config.rules]
    side = broadcast_checked(cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(c).alias(f"_{c}") for c in cuts]), MAX_BROADCAST_STRATA)
    rejected = F.lit(False)
    for rule in config.rules:
        rejected = rejected | F.coalesce(_exceeds(rule, F.col(f"_cut_{rule.name}")), F.lit(False))
    joined = measured.join(side, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~rejected}).drop("_stratum", *[f"_{c}" for c in cuts])


def good_labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Measured rows whose document is labelled good and passes the base rule."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    return measured.join(good, F.col("doc_id") == F.col("_id"), "left_semi").filter(~base_failed())


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", config: RiskConfig = RiskConfig()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The counts are taken twice, once to set the cutoffs and once while the texts pass, instead of
    joining the texts to them.
    """
    measured = settle(measures(docs.select("doc_id", "text", stratum)).drop("text", "_mark"))
    cutoffs = certified_cutoffs(good_labelled(measured, labels), stratum, config)
    judged = judge(measures(packed(docs, "text", stratum)), cutoffs, stratum, config)
    return judged.filter(F.col("kept") & (F.col("_mark") >= 0)).select(*unpacked(docs.columns))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", config: RiskConfig = RiskConfig()) -> DataFrame:
    """doc_id, stratum, measures, base_failed and kept of every row."""
    measured = settle(measures(docs.select("doc_id", "text", stratum)).drop("text", "_mark"))
    cutoffs = certified_cutoffs(good_labelled(measured, labels), stratum, config)
    return judge(measured, cutoffs, stratum, config)
