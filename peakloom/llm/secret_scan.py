"""Secret scan: base patterns, and weak parts that count only as members of a multipart credential.

Base spans (assign, access, hex) always count.  Weak parts are account names, random-looking
strings and endpoints; each is reported only if a complementary part lies within ``scope`` characters
of it: a secret beside an access identifier or an endpoint, an identifier or an endpoint beside a secret.  The interval join runs on cells of the
text, so one join group holds the parts of a few hundred characters whatever the document's size,
and a semi join returns each weak part once.

Only DataFrame functions are used.  Positions are code points, end exclusive.  A null text is
empty.  Repeated rows are scanned one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import broadcast_checked, packed, settle, text_of, unpacked, with_row

# Base patterns, the group that must be long enough, and its least length.
# [0-9a-f]+ of 32 or more and AKIA[A-Z0-9]+ of 16 or more take whole runs, so the length can stand
# in the pattern; an assignment that is too short still uses up its text, so it is dropped later.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

WEAK_ID = r"(?i:(user|username|login|client_?id|account))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._+-]{3,})"
WEAK_SECRET = r"(?<![A-Za-z0-9+/=])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{20,}={0,2}"
WEAK_ENDPOINT = r"(?i:https?|ftp|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"

# Kinds in listed order; the number of a kind is its place.
KINDS = ("assign", "access", "hex", "identifier", "value", "endpoint")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "identifier": "id", "value": "secret", "endpoint": "endpoint"}

SCOPE = 200
CELL = 256
# Matches whose places are added up together.
BLOCK = 256
MASK = "[SECRET]"
MAX_BROADCAST_ROWS = 50_000

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Matches of a pattern as (start, kind, end).

    Each match is wrapped in marks, the text is cut at the opening mark, and lengths are added up.
    Marks that stand in the text are first replaced by DEL, which no pattern accepts.  Lengths are added up in
    blocks, so that a long list of matches is not copied for each of them.
    """
    clean = F.translate(text, "\u0001\u0002\u0003", "\u007f\u007f\u007f")
    inner = f"\u0001$0\u0003${group}\u0002" if group else "\u0001$0\u0003\u0002"
    pieces = F.split(F.regexp_replace(clean, pattern, inner), "\u0001")
    parts = F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces) - 1),
        lambda p: F.struct(
            F.char_length(F.substring_index(p, "\u0003", 1)).alias("own"),
            F.char_length(F.substring_index(F.substring_index(p, "\u0002", 1), "\u0003", -1)).alias("value"),
            F.char_length(F.substring_index(p, "\u0002", -1)).alias("rest"),
        ),
    )
    none = F.array().cast(_SPANS)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.char_length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("found"))
    step = lambda a, p: F.struct(
        (a["at"] + p["own"] + p["rest"]).alias("at"),
        F.when(
            p["value"] >= least,
            F.array_append(a["found"], F.struct(a["at"].alias("start"), F.lit(kind).alias("kind"), (a["at"] + p["own"]).alias("end"))),
        )
        .otherwise(a["found"])
        .alias("found"),
    )

    def block_step(a: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(a["at"].alias("at"), none.alias("found")), step)
        joined = F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.array_append(a["found"], x["found"]).alias("found")))
        return F.get(joined, F.lit(0))

    return F.when(text.rlike(pattern), F.flatten(F.aggregate(blocks, start, block_step, lambda a: a["found"]))).otherwise(none)


def scan_rows(df: DataFrame) -> DataFrame:
    """Keeps the columns of ``df``, which hold ``text``; adds base and weak spans of each row."""
    text = text_of("text")
    base = df.withColumns(
        {
            "_assign": _spans(text, ASSIGN, 0, 2, LEAST_VALUE),
            "_access": F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1)).otherwise(F.array().cast(_SPANS)),
            "_hex": _spans(text, HEX, 2),
            "_endpoint": F.when(F.contains(text, F.lit("://")), _spans(text, WEAK_ENDPOINT, 5)).otherwise(F.array().cast(_SPANS)),
        }
    )
    base = base.withColumns(
        {
            "_base": F.sort_array(F.concat("_assign", "_access", "_hex")),
            "_weak": F.concat(_spans(text, WEAK_ID, 3), _spans(text, WEAK_SECRET, 4), "_endpoint"),
        }
    )
    # A weak part inside a base span adds nothing.
    free = F.filter("_weak", lambda w: ~F.exists("_base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    base = base.withColumn("_weak", free).drop("_assign", "_access", "_hex", "_endpoint")
    # Without a secret and a part of another role no weak part of the row can count.
    is_secret = lambda p: _role(p["kind"]) == "secret"
    secret = F.exists("_base", is_secret) | F.exists("_weak", is_secret)
    other = F.exists("_base", lambda p: ~is_secret(p)) | F.exists("_weak", lambda p: ~is_secret(p))
    return base.withColumn("_weak", F.when(secret & other, F.col("_weak")).otherwise(F.array().cast(_SPANS)))


def _role(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), kind + 1)


def link_parts(found: DataFrame, scope: int = SCOPE, cell: int = CELL) -> DataFrame:
    """_row, _linked: weak spans with a complementary part within the scope.

    ``found`` has _row, _base, _weak.  Interval join on (row, cell, role) with an overlap test.
    """
    some = found.filter("size(_weak) > 0")
    span = F.col("_p")
    parts = some.select("_row", F.explode(F.concat("_base", "_weak")).alias("_p")).select(
        "_row",
        _role(span["kind"]).alias("role"),
        span["start"].alias("p_start"),
        span["end"].alias("p_end"),
        F.explode(F.sequence(F.floor(span["start"] / cell), F.floor(span["end"] / cell))).alias("cell"),
    )
    weak = some.select("_row", F.explode("_weak").alias("_p"))
    need = weak.select(
        "_row",
        "_p",
        F.explode(F.when(_role(span["kind"]) == "secret", F.array(F.lit("id"), F.lit("endpoint"))).otherwise(F.array(F.lit("secret")))).alias("role"),
    ).withColumn("cell", F.explode(F.sequence(F.floor((span["start"] - scope) / cell), F.floor((span["end"] + scope) / cell))))
    a, b = need.alias("a"), parts.alias("b")
    hit = a.join(
        b,
        (F.col("a._row") == F.col("b._row"))
        & (F.col("a.role") == F.col("b.role"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("b.p_start") < F.col("a._p.end") + scope)
        & (F.col("b.p_end") > F.col("a._p.start") - scope),
        "left_semi",
    )
    return hit.select("_row", "_p").distinct().groupBy("_row").agg(F.sort_array(F.collect_list("_p")).alias("_linked"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
    )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base (array), linked (array), spans (array) for every row of (doc_id, text)."""
    found = settle(scan_rows(with_row(docs.select("doc_id", "text"))).select("_row", "doc_id", "_base", "_weak"))
    out = found.join(link_parts(found), "_row", "left")
    linked = F.coalesce("_linked", F.array().cast(_SPANS))
    return out.select("doc_id", F.col("_base").alias("base"), linked.alias("linked"), F.sort_array(F.concat("_base", linked)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _masked(text: Column, spans: Column) -> Column:
    out = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["end"] <= a["at"], a
        ).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    a["out"],
                    F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(MASK))).otherwise(F.lit("")),
                ).alias("out"),
            )
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(out["out"], F.substring(text, out["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span masked; other columns stay, null texts stay null."""
    rows = with_row(packed(docs, "text"))
    found = settle(scan_rows(rows.select("_row", "text")).select("_row", "_base", "_weak").filter("size(_base) > 0 OR size(_weak) > 0"))
    spans = found.join(link_parts(found), "_row", "left").select(
        "_row", F.sort_array(F.concat("_base", F.coalesce("_linked", F.array().cast(_SPANS)))).alias("_spans")
    )
    spans = broadcast_checked(settle(spans.filter("size(_spans) > 0")), MAX_BROADCAST_ROWS)
    masked = rows.join(spans, "_row", "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(_masked(F.col("text"), F.col("_spans")))
    return masked.select(*unpacked(docs.columns, text=text))
