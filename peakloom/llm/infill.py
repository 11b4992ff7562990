"""Fill-in-middle transformation, cut with an indexable skip list.

A text is a sequence of units: runs of ASCII letters and single other characters.  The skip list over
its units has express lanes: lane 0 links every unit, and each lane above links every fourth node of the
one below.  A link carries how many units and how many code points it spans.  A cut is a rank in units:
the search goes down from the highest lane, takes links while their units fit into the rank and adds up
their code points, so it reaches the place of the cut after a few links of each lane.

Cuts and form come from the digest of a seed and the id, so they are the same whenever a lost task is run
again.  Only the text goes to the Python workers and only three numbers come back; texts are cut, put
together and restored by Spark.

A null text is empty; a null id counts as the empty string.  Empty texts and texts that contain a
sentinel stay plain.  Repeated rows are cut alike.  Very long texts are worked on alone.  An empty table
gives no rows.  The results are n_units, form, prefix_chars, middle_chars and output; columns of the
input with these names (in any case) are replaced, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from peakloom.llm.common import text_of

RESULTS = ("n_units", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class InfillConfig:
    seed: int = 1
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    # Of 100 texts so many are cut, and of 100 cut texts so many put the suffix first.
    cut_percent: int = 90
    suffix_first_percent: int = 20


class UnitSkipList:
    """Units of one text with express lanes; links know their width in units and in code points."""

    FAN = 4

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        low = points | 32
        letter = (low >= 97) & (low <= 122)
        begins = ~letter
        begins[1:] |= ~letter[:-1]
        begins[:1] = True
        at = np.flatnonzero(begins)
        self.units = len(at)
        width = np.diff(np.append(at, len(points)))
        # Of each lane: units and code points from every node to the next.
        self.lanes: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(len(at), np.int64), width)]
        while len(self.lanes[-1][0]) > self.FAN:
            units, chars = self.lanes[-1]
            nodes = np.arange(0, len(units), self.FAN)
            self.lanes.append((np.add.reduceat(units, nodes), np.add.reduceat(chars, nodes)))

    def offset(self, rank: int) -> int:
        """Code points before the unit of this rank; the rank of the end is the number of units."""
        node = chars = 0
        for units, width in reversed(self.lanes):
            while node < len(units) and units[node] <= rank:
                rank -= int(units[node])
                chars += int(width[node])
                node += 1
            node *= self.FAN
        return chars


def _cut(text: str, first: int, second: int) -> tuple[int, int, int]:
    units = UnitSkipList(text)
    low, high = sorted((first % (units.units + 1), second % (units.units + 1)))
    return units.units, units.offset(low), units.offset(high)


@F.pandas_udf(StructType([StructField(name, LongType()) for name in ("n_units", "low", "high")]))
def _cuts(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    found = [_cut(t or "", a, b) for t, a, b in zip(text, first, second, strict=True)]
    return pd.DataFrame(found, columns=["n_units", "low", "high"])


def draws(key: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, config: InfillConfig = InfillConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` with n_units, form, prefix_chars, middle_chars and output."""
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    h1, h2, h3, h4 = draws(docs[key], config.seed)
    whole = text_of(docs[text])
    marked = F.lit(False)
    for mark in (config.prefix, config.suffix, config.middle):
        marked = marked | F.contains(whole, F.lit(mark))
    plain = (whole == "") | marked | (h3 % 100 >= config.cut_percent)
    form = F.when(plain, "plain").when(h4 % 100 < config.suffix_first_percent, "spm").otherwise("psm")
    own = docs.select(
        F.struct(*[docs[c] for c in kept]).alias("kept"), whole.alias("whole"), form.alias("form"), _cuts(whole, h1, h2).alias("cut")
    )
    low, high = F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    before, after = F.substring("whole", F.lit(1), low), F.substring("whole", high + 1, F.char_length("whole"))
    inside = F.substring("whole", low + 1, high - low)
    p, s, m = (F.lit(x) for x in (config.prefix, config.suffix, config.middle))
    output = (
        F.when(F.col("form") == "plain", F.col("whole"))
        .when(F.col("form") == "psm", F.concat(p, before, s, after, m, inside))
        .otherwise(F.concat(s, after, p, before, m, inside))
    )
    cut = F.col("form") != "plain"
    return own.select(
        *[F.col("kept").getField(c).alias(c) for c in kept],
        F.col("cut.n_units").alias("n_units"),
        "form",
        F.when(cut, F.col("cut.low")).alias("prefix_chars"),
        F.when(cut, F.col("cut.high") - F.col("cut.low")).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column, config: InfillConfig = InfillConfig()) -> Column:
    """The text, from output and form alone.

    Cut texts hold no sentinel, and none can arise across a cut, so the first sentinel of each kind
    after the leading one is the true one.
    """

    def parts(lead: str, then: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(lead) + 1), F.char_length(output))
        one = F.substring_index(rest, then, 1)
        rest = F.substring(rest, F.char_length(one) + len(then) + 1, F.char_length(rest))
        two = F.substring_index(rest, config.middle, 1)
        return one, two, F.substring(rest, F.char_length(two) + len(config.middle) + 1, F.char_length(rest))

    prefix, suffix, middle = parts(config.prefix, config.suffix)
    suffix_, prefix_, middle_ = parts(config.suffix, config.prefix)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)
