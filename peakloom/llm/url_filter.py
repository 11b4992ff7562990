"""URL filter: curated host and path rules, and association rules mined from what they judge.

The curated list labels every page that one of its rules fits.  FP-growth over the url tokens and
labels of those pages finds frequent token combinations; combinations that name a label with enough
confidence become mined rules.  An inverted index keeps each mined rule under its rarest token, so
a common host or domain word leads to few rules.  Pages without a curated rule follow their best
mined rule, and are allowed where none matches.

Only DataFrame functions and Spark's own FPGrowth are used.  A null url, or one without ``://``, has
empty host and path and is allowed.  Repeated urls get the same verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import ascii_lower, settle

# The curated list, as (rule, verdict).
CURATED = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
LABELS = ("allow", "block")


@dataclass(frozen=True)
class MiningConfig:
    """``support`` is a share of the labelled pages; antecedents have at most ``most_tokens`` tokens."""

    support: float = 0.01
    confidence: float = 0.8
    most_tokens: int = 2


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def curated_rule(host: Column, path: Column, curated=CURATED) -> Column:
    """Struct of the longest fitting rule and its verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(curated, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct sorted tokens: host words, path words with numbers replaced, query keys, fragment."""
    words = lambda text, sep: F.filter(F.split(text, sep), lambda w: w != "")
    number = lambda w: F.regexp_replace(w, "[0-9]+", "0")
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    return F.sort_array(
        F.array_distinct(
            F.concat(
                F.transform(words(host, r"\."), lambda w: F.concat(F.lit("h:"), w)),
                F.transform(words(path, "/"), lambda w: F.concat(F.lit("p:"), number(w))),
                F.transform(keys, lambda w: F.concat(F.lit("q:"), number(w))),
                F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
            )
        )
    )


def mine_rules(labelled: DataFrame, config: MiningConfig = MiningConfig()) -> DataFrame:
    """tokens, verdict, rule_support, confidence: the rules of a table (tokens, verdict)."""
    spark = labelled.sparkSession
    if labelled.isEmpty():
        return spark.createDataFrame([], "tokens array<string>, verdict string, rule_support bigint, confidence double")
    items = labelled.select(F.concat(F.col("tokens"), F.array(F.concat(F.lit("y:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=config.support, minConfidence=1.0).fit(items)
    found = settle(model.freqItemsets.filter(F.size("items") <= config.most_tokens + 1))
    label = F.array_join(F.filter("items", lambda x: x.startswith("y:")), "")
    parts = found.select(
        F.sort_array(F.filter("items", lambda x: ~x.startswith("y:"))).alias("tokens"), label.alias("label"), F.col("freq")
    )
    whole = parts.filter("label = ''").select("tokens", F.col("freq").alias("all_freq"))
    rules = parts.filter("label <> '' AND size(tokens) > 0").join(whole, "tokens")
    confidence = F.col("freq") / F.col("all_freq")
    return rules.select(
        "tokens", F.substring("label", 3, 5).alias("verdict"), F.col("freq").alias("rule_support"), confidence.alias("confidence")
    ).filter(F.col("confidence") >= config.confidence)


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, verdict: the best rule of each distinct token set; more confidence, then support, then allow first."""
    seen = rules.select(F.explode("tokens").alias("token"), "rule_support")
    rarity = seen.groupBy("token").agg(F.max("rule_support").alias("common"))
    keyed = (
        rules.withColumn("token", F.explode("tokens"))
        .join(rarity, "token")
        .groupBy("tokens", "verdict", "rule_support", "confidence")
        .agg(F.min(F.struct("common", "token"))["token"].alias("token"))
        .withColumnRenamed("tokens", "needs")
    )
    hits = (
        sets.select("tokens", F.explode("tokens").alias("token"))
        .join(keyed, "token")
        .filter(F.size(F.array_except("needs", "tokens")) == 0)
    )
    rank = F.struct("confidence", "rule_support", (F.col("verdict") == "allow").alias("first"), "verdict")
    return hits.groupBy("tokens").agg(F.max(rank)["verdict"].alias("mined"))


def judge_urls(pages: DataFrame, curated=CURATED, config: MiningConfig = MiningConfig()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (verdict of the mined rules, or null) for every row."""
    own = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    own = own.select(
        "page_id",
        "host",
        "path",
        url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"),
        curated_rule(F.col("host"), F.col("path"), curated).alias("_c"),
    ).select("page_id", "host", "path", "tokens", F.col("_c.rule").alias("rule"), F.col("_c.verdict").alias("given"))
    own = settle(own)
    rules = mine_rules(own.filter("given IS NOT NULL").select("tokens", F.col("given").alias("verdict")), config)
    # Token sets without rules are few: numbers are replaced and equal sets merge before the join.
    mined = match_rules(own.filter("rule IS NULL").select("tokens").distinct(), rules)
    joined = own.join(mined, "tokens", "left")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("given", "mined", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined")).alias("mined")
    )
