"""Decontamination, conversation repair and infilling against plain versions, on tables and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from peakloom.llm import infill, turn_repair, winnowing
from peakloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- conversation repair ----------------------------------------------------------------------


def plain_script(rows):
    """Least (cost, audit, roles) over all scripts, by recursion over rows and role string."""
    done = re.compile(r"(s?(ua)+)?\Z")
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def rest(i, last, inserts):
        best = []
        if i == len(rows) and last in ("", "a"):
            best.append((0, "", ()))
        if inserts < 2:
            for role in set(step[last]) & set("ua"):
                cost, audit, roles = rest(i, role, inserts + 1)
                best.append((cost + 3, "I" + audit, ((role, None), *roles)))
        if i < len(rows):
            initial, fault = rows[i]
            cost, audit, roles = rest(i + 1, last, 0)
            best.append((cost + 4, "D" + audit, roles))
            if fault not in ("blank", "duplicate"):
                for role, edit in [(initial, "K"), ("u", "R"), ("a", "R")]:
                    if role in step[last] and role:
                        cost, audit, roles = rest(i + 1, role, 0)
                        best.append((cost + 3 * (edit == "R") + 3 * (fault == "truncated"), edit + audit, ((role, (i, edit)), *roles)))
        return min(best, key=lambda b: b[:2], default=(1 << 50, "", ()))

    found = rest(0, "", 0)
    assert done.match("".join(role for role, _ in found[2]))
    return found


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_digest(rows):
    by_conv = defaultdict(list)
    for row in damaged(rows):
        by_conv[row[0]].append(row)
    want = []
    for conv in {r[0] for r in rows}:
        own = sorted(by_conv[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            inner = text.strip("\x20\t\n\x0b\x0c\r")
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "none"
            seen.add((role, text))
            faults.append(fault)
        initials = [r[2][:1] for r in own]
        cost, audit, roles = plain_script(tuple(zip((i or "-" for i in initials), faults, strict=True)))
        name = {"u": "user", "a": "assistant"}
        lines = [f"{name[role]}:" if at is None else f"{own[at[0]][2] if at[1] == 'K' else name[role]}:{own[at[0]][3]}" for role, at in roles]
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        n = Counter(faults)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        want.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha))
    return sorted(want, key=repr)


TURNS = "conv_id long, turn long, role string, text string"
ODD_TURNS = [
    (1, None, None, None),
    (1, None, "user", "A b."),
    (1, 3, "user", "A b."),
    (1, 3, "assistant", "c"),
    (1, 3, "assistant", "c"),
    (1, 7, "", "é 😀!  \n"),
    (None, 1, "user", "x."),
    (None, None, "system", "s."),
    (2, 5, "tool", "\t\n "),
    (3, 0, "system", "q."),
    (3, 1, "assistant", "w" * 50_000),
    (3, 2, "user", "You!"),
    *[(9, i, ("user", "assistant", "system")[i * i % 3], ("a.", "b", "", "c?")[i % 4]) for i in range(60)],
    *[(10, i % 2, "user", "same.") for i in range(9)],
]


def digest_of(df, block_bits=turn_repair.BLOCK_BITS):
    script = turn_repair.edit_script(turn_repair.damage(df), block_bits)
    return sorted((tuple(r) for r in turn_repair.digest(script, df).collect()), key=repr)


@pytest.mark.parametrize("block_bits", [1, 3, 16])
def test_repair_odd_rows(spark, block_bits):
    df = spark.createDataFrame(ODD_TURNS, TURNS).repartition(3)
    assert digest_of(df, block_bits) == plain_digest(ODD_TURNS)


def test_repair_table(spark):
    got = sorted((tuple(r) for r in QUERIES["op12_turn_repair"](spark, SF).collect()), key=repr)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == plain_digest(rows)


def test_repair_empty_and_clashing(spark):
    df = spark.createDataFrame(ODD_TURNS, TURNS)
    wide = df.select("*", *[F.lit("x").alias(c) for c in ("_key", "_at", "rows", "edit", "place", "audit", "_row", "digest", "cost")])
    assert digest_of(wide) == plain_digest(ODD_TURNS)
    assert digest_of(df.limit(0)) == []
    empty = turn_repair.edit_script(df.limit(0))
    assert empty.count() == 0 and turn_repair.apply_script(empty).count() == 0


def test_repaired_turns(spark):
    df = spark.createDataFrame(ODD_TURNS, TURNS)
    turns = turn_repair.apply_script(turn_repair.edit_script(df)).orderBy("conv_id", "place", "slot").collect()
    roles = defaultdict(str)
    for r in turns:
        roles[r["conv_id"]] += r["role"][:1]
    assert roles and all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())


def test_walk_keeps_few_vectors():
    rng = random.Random(5)
    for n in (1, 2, 7, 40):
        codes = [rng.randrange(4) + 4 * rng.choice([0, 0, 1, 2, 3]) for _ in range(n)]
        audit, cost = "", 0
        for edit, opened, _, price, state in turn_repair.walk(codes, turn_repair.END, 0):
            audit, cost = audit + "I" * len(opened) + edit, cost + price
        closed = turn_repair.closing(state)
        rows = tuple(("sua-"[c & 3], turn_repair.FAULTS[c >> 2]) for c in codes)
        assert (cost + 3 * len(closed), audit + "I" * len(closed)) == plain_script(rows)[:2]
        # Cutting the rows anywhere gives the same costs from state to state.
        for cut in range(n):
            whole, a, b = (turn_repair.transfer(x) for x in (codes, codes[:cut], codes[cut:]))
            joined = [min(a[4 * q + m] + b[4 * m + e] for m in range(4)) for q in range(4) for e in range(4)]
            assert [min(x, turn_repair.NEVER) for x in whole] == [min(x, turn_repair.NEVER) for x in joined]


# --- decontamination --------------------------------------------------------------------------


def plain_overlaps(docs, items, window=10):
    words = lambda t: ITEM_WORD.findall((t or "").translate(UPPER))
    runs = defaultdict(set)
    for item, text in items:
        w = words(text)
        t = min(window, len(w))
        for i in range(len(w) - t + 1 if t else 0):
            runs[tuple(w[i : i + t])].add(item)
    sizes = {len(r) for r in runs}
    want = Counter()
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for t in sizes:
            for i in range(len(w) - t + 1):
                if (run := tuple(w[i : i + t])) in runs:
                    hit.update(range(i, i + t))
                    found |= runs[run]
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        want[doc, len(w), len(hit), len(found), listed] += 1
    return want


def overlaps_of(docs, items, config=winnowing.WinnowConfig()):
    rows = winnowing.overlaps(docs, items, config).collect()
    for r in rows:
        assert all(a["stop"] < b["start"] for a, b in itertools.pairwise(r["spans"]))
    return Counter((r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["n_items"], ",".join(r["items"])) for r in rows)


LONG = " ".join(f"w{i % 97}x{i * i % 31}" for i in range(200))
ITEMS = [
    (1, "The quick-brown FOX"),
    (2, "fox"),
    (3, LONG),
    (4, "a " * 30),
    (5, None),
    (6, " .,- "),
    (7, "the QUICK brown fox"),
    (None, "null item here"),
    (8, "É ß 日本 été über"),
    (8, "É ß 日本 été über"),
    (9, LONG.split(" ", 60)[60]),
    (10, "b c " * 6),
]
WORDS = LONG.split()
TEXTS = [
    (1, "see the quick brown fox run"),
    (2, None),
    (3, ""),
    (4, "x " + " ".join(WORDS[20:45]) + " y " + " ".join(WORDS[100:109]) + " z " + " ".join(WORDS[100:110])),
    (4, "x " + " ".join(WORDS[20:45]) + " y " + " ".join(WORDS[100:109]) + " z " + " ".join(WORDS[100:110])),
    (None, "NULL,item,here " + "a " * 9),
    (7, "a " * 5_000 + "b c b c b c b c b c b c b"),
    (8, "é ß 日本 été über - É ß 日本 été über"),
    (9, " ".join(WORDS[:10])),
    (10, " ".join(WORDS[1:10])),
    (11, "no words in common " * 2_000),
    (12, "c b c b c b c b c b c b c b c"),
]


@pytest.mark.parametrize("bits", [10, 24])
def test_overlaps_odd_rows(spark, bits):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert overlaps_of(docs, items, winnowing.WinnowConfig(filter_bits=bits)) == plain_overlaps(TEXTS, ITEMS)


@pytest.mark.parametrize("window", [1, 2, 3, 7])
def test_overlaps_of_other_windows(spark, window):
    rng = random.Random(window)
    say = lambda n: " ".join(rng.choice("ab cd ef gh".split()) for _ in range(n))
    texts = [(i, say(rng.randrange(60))) for i in range(40)]
    own = [(i, say(rng.randrange(1, 12))) for i in range(15)]
    got = overlaps_of(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(own, "item_id long, text string"), winnowing.WinnowConfig(window=window))
    assert got == plain_overlaps(texts, own, window)


def test_overlaps_empty_and_clashing(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = Counter({(i, n, 0, 0, ""): c for (i, n, *_), c in plain_overlaps(TEXTS, []).items()})
    assert overlaps_of(docs, items.limit(0)) == none
    assert overlaps_of(docs.limit(0), items) == Counter()
    clash = [F.lit("x").alias(c) for c in ("_row", "key", "seeds", "spans", "items", "h", "t", "_id", "_item", "n_words")]
    assert overlaps_of(docs.select("*", *clash), items.select("*", *clash)) == plain_overlaps(TEXTS, ITEMS)


# --- infilling --------------------------------------------------------------------------------


def plain_infill(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return len(units), form, len(p), len(m), out, text


FIM = [
    (1, None),
    (2, ""),
    (3, "a <P> b"),
    (4, "ab\ncd  é😀x1<S"),
    (4, "ab\ncd  é😀x1<S"),
    (None, "null id text <<>><P"),
    *[(i, "<" * (i % 5) + "S>P>M>" * (i % 3) + "word é " * (i % 7) + "<P"[: i % 3]) for i in range(5, 80)],
    (90, "long " * 60_000),
    (91, "x" * 200_000),
    (92, "é" * 100_000),
]


def test_infill_odd_rows(spark):
    df = spark.createDataFrame(FIM, "doc_id long, text string")
    made = infill.fill_in_middle(df.withColumn("kept", F.lit(1)).withColumn("Form", F.lit("x")).withColumn("output", F.lit(2)))
    assert made.columns == ["doc_id", "text", "kept", *infill.RESULTS]
    rows = made.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    got = Counter((r["doc_id"], r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in rows)
    assert got == Counter((doc, *plain_infill(doc, text)) for doc, text in FIM)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_skip_list_reaches_every_rank():
    rng = random.Random(3)
    for n in [*range(9), 15, 16, 17, 63, 64, 65, 300]:
        text = "".join(rng.choice("abZ 1é😀\n@[`{") for _ in range(n))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        lanes = infill.UnitSkipList(text)
        ends = [0, *itertools.accumulate(map(len, units))]
        assert lanes.units == len(units) and [lanes.offset(r) for r in range(len(ends))] == ends


# --- columns of other operators' names, and what was wrong before -------------------------------

NAMES = ("_row", "_all", "score", "bucket", "batch", "n_words", "ids", "_own_score", "same", "kept", "_mark", "_spans", "_base", "_h")


@pytest.fixture(scope="module")
def wide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return docs, docs.select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in NAMES])


@pytest.mark.parametrize("stage", ["rules", "classifier", "near", "secrets", "packing", "pieces"])
def test_clashing_columns_keep_their_values(spark, wide, stage):
    import public_tokenizers

    from peakloom.llm import packing, pu_quality, risk_rules, secret_scan, sentencepiece_codec, simhash

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = public_tokenizers.path("piece_bpe_32k.model")
    run = {
        "rules": lambda d: risk_rules.keep_good(d, labels),
        "classifier": lambda d: pu_quality.keep_good(d, labels),
        "near": simhash.near_dedup,
        "secrets": secret_scan.redact,
        "packing": lambda d: packing.pack(d.withColumn("n_tokens", F.length("text").cast("long"))),
        "pieces": lambda d: sentencepiece_codec.encode(d, model),
    }[stage]
    plain, clashing = (run(d) for d in wide)
    key = [c for c in plain.columns if c in ("doc_id", "text", "padding")]
    assert Counter(map(tuple, plain.select(key).collect())) == Counter(map(tuple, clashing.select(key).collect()))
    own = [c for c in NAMES if c not in plain.columns]
    rows = clashing.select("doc_id", *own).collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in own)


def test_neighbours_of_wide_vectors(spark):
    import numpy as np

    from peakloom.llm import block_ann

    rng = np.random.default_rng(3)
    base = rng.integers(90, 128, 4_096)
    rows = np.tile(base, (80, 1))
    for r in rows:
        r[rng.integers(0, 4_096, 3)] = 127
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in block_ann.search(df, every=20, k=10, block_rows=30).collect()}
    for q in range(0, 80, 20):
        score = rows @ rows[q]
        want = sorted((i for i in range(80) if i != q), key=lambda i: (-score[i], i))[:10]
        assert [got[q, n + 1] for n in range(10)] == want


def test_many_matches_and_marks(spark):
    from peakloom.llm import secret_scan

    text = " ".join(f"{i:032x}" for i in range(3_000))
    found = secret_scan.scan_secrets(spark.createDataFrame([(1, text), (2, "https://h.example\x01/tail password=abcdefgh12")], "doc_id long, text string"))
    spans = {r["doc_id"]: r["base"] for r in found.collect()}
    assert [(s["start"], s["end"]) for s in spans[1]] == [(33 * i, 33 * i + 32) for i in range(3_000)]
    # A mark in the text ends an endpoint.
    ends = found.sparkSession.createDataFrame([("https://h.example\x01/tail",)], "t string").select(
        secret_scan._spans(F.col("t"), secret_scan.WEAK_ENDPOINT, 5).alias("s")
    )
    assert [(s["start"], s["end"]) for s in ends.first()["s"]] == [(0, 17)]


# --- quality classifier ---------------------------------------------------------------------------


def plain_features(text):
    """The figures of a text, counted one by one."""
    import math

    from peakloom.llm import pu_quality as pu

    data = (text or "").encode()
    out = [0.0] * pu.N_FEATURES
    if not data:
        return out
    n_classes = pu.N_CLASSES

    def kind(byte):
        return int(pu.CLASSES[byte])

    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", data)
    for c, n in Counter(map(kind, data)).items():
        out[c] = n / len(data)
    for c, n in Counter(kind(w[0]) for w in words).items():
        out[n_classes + c] = n / len(words)
    for c, n in Counter(kind(w[-1]) for w in words).items():
        out[2 * n_classes + c] = n / len(words)
    if words:
        sizes, low, n = [len(w) for w in words], [w.lower() for w in words], len(words)
        mean = sum(sizes) / n
        lines = [x for x in data.split(b"\n") if x.strip()]
        out[3 * n_classes :] = [
            mean,
            math.sqrt(sum((s - mean) ** 2 for s in sizes) / n),
            sum(s <= 3 for s in sizes) / n,
            sum(s >= 12 for s in sizes) / n,
            math.log(1 + n),
            len(set(low)) / n,
            len(lines) / n,
            1 - len(set(lines)) / len(lines),
            sum(len(w) == 1 and kind(w[0]) > 6 for w in words) / n,
            math.log(1 + max(sizes)),
            len(set(itertools.pairwise(low))) / n,
            sum(a == b for a, b in itertools.pairwise(low)) / n,
        ]
    return out


def test_classifier_scores_against_plain_version(spark):
    import math

    from peakloom.llm import pu_quality

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, "Ab,  é😀\n\nAb,")], "doc_id long, text string")
    model = pu_quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.unionByName(odd)
    got = {r["doc_id"]: r["score"] for r in pu_quality.add_scores(rows, model).collect()}
    import numpy as np

    for doc, text in rows.collect():
        # The bins compare 32-bit figures, as the features are stored.
        x = [float(np.float32(v)) for v in plain_features(text)]
        margin = model.bias + sum(float(w) for at, edge, w in zip(model.places, model.edges, model.weights, strict=True) if x[at] > edge)
        assert got[doc] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-3)


@pytest.mark.parametrize("prior", [0.25, 0.6, 0.9])
def test_prior_is_estimated_without_negatives(prior):
    import numpy as np

    from peakloom.llm import pu_quality

    rng = np.random.default_rng(11)
    draw = lambda n, at: rng.normal(at, 1.0, (n, 4)).astype(np.float32)
    n = 4_000
    positive = draw(2_000, 1.5)
    unlabelled = rng.permutation(np.concatenate([draw(int(n * prior), 1.5), draw(n - int(n * prior), -1.5)]))
    assert pu_quality.estimated_prior(positive, unlabelled) == pytest.approx(prior, abs=0.08)
