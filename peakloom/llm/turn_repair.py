"""Conversation structure repair by a shortest edit script with square-root checkpoints.

The rows of a conversation are in the order of turn (nulls first), role, text; a blank row, a row whose
role and text came before and a row that does not end its sentence are faults (the first of these
counts).  The script keeps (K), reroles (R), deletes (D) or inserts (I) turns so that the role initials
read ``(s?(ua)+)?`` at the least cost; of the cheapest scripts the one with the least string is taken.

Program.  Four states (start, after system, after user, after assistant) and, before each row, the cost
of the best way to the end from each.  Vectors are computed backward and stored at every
sqrt(n)-th row only; walking forward, the rows of a block are computed again from its checkpoint, so
n rows take memory for about 2 * sqrt(n) vectors.

Scale.  Rows are sorted over the whole table by range, and numbered in that order.  The program works on
pieces of at most 2 ** block_bits rows with consecutive numbers, so a conversation with a third of all rows
is spread over many tasks.  Only pieces of conversations that run over a boundary need more: each gives a
4 x 4 table of costs from state to state, these give the vector at the end of each piece, and then
a table of exit states gives the state at its start.  Texts move only in the sort and when edits are put beside them.

A null role or text is one space; a null turn sorts first; rows with a null conversation id are one
conversation.  Roles are told apart by their first character, an empty role by none.  Repeated rows are
duplicates.  An empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import settle, shuffle_partitions, with_row

BLOCK_BITS = 16
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
START, OPENED, ASKED, ANSWERED = range(4)
NEVER = 1 << 60
FAULTS = ("none", "blank", "duplicate", "truncated")
INITIALS = "sua"
_GAP = " \t\n\x0b\x0c\r"
# The state after an inserted or reroled turn, its role, and the state after a kept turn by its initial.
_ON = (ASKED, ASKED, ANSWERED, ASKED)
_ROLE = ("user", "user", "assistant", "user")
_KEEP = {(START, 0): OPENED, (START, 1): ASKED, (OPENED, 1): ASKED, (ASKED, 2): ANSWERED, (ANSWERED, 1): ASKED}
_LEGAL = {(0, 1), (1, 2), (2, 1)}

Vector = tuple[int, int, int, int]


def _with_inserts(base: list[int]) -> Vector:
    """Best cost when turns may be inserted first; more than two in a row lead back to where one was."""
    asked, answered = min(base[ASKED], INSERT + base[ANSWERED]), min(base[ANSWERED], INSERT + base[ASKED])
    return min(base[START], INSERT + asked), min(base[OPENED], INSERT + asked), asked, answered


END = _with_inserts([0, NEVER, NEVER, 0])


def _options(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edit, cost, next state of the row in ascending order of the edit; codes are initial + 4 * fault."""
    initial, fault = code & 3, code >> 2
    yield "D", DELETE, state
    if fault in (1, 2):
        return
    extra = TRUNCATED if fault == 3 else 0
    after = _KEEP.get((state, initial))
    if after is not None:
        yield "K", extra, after
    yield "R", REROLE + extra, _ON[state]


# By code, and state: the options of a row.
_MOVES = [[list(_options(code, state)) for state in range(4)] for code in range(16)]


def back(code: int, later: Vector) -> Vector:
    """The vector before a row from the one behind it."""
    return _with_inserts([min(cost + later[after] for _, cost, after in moves) for moves in _MOVES[code]])


def transfer(codes: list[int]) -> list[int]:
    """Least cost from each state before the rows to each state behind them, row by row."""
    columns = []
    for end in range(4):
        vector = tuple(0 if s == end else NEVER for s in range(4))
        for code in reversed(codes):
            vector = back(code, vector)
        columns.append(vector)
    return [columns[end][start] for start in range(4) for end in range(4)]


def walk(codes: list[int], tail: Vector, state: int) -> Iterator[tuple[str, list[str], str | None, int, int]]:
    """For each row: its edit, roles of the turns inserted before it, its new role, cost of all, state behind it.

    ``tail`` is the vector behind the rows.
    """
    n = len(codes)
    step = max(1, math.isqrt(n))
    stored, vector = {n: tail}, tail
    for i in range(n - 1, -1, -1):
        vector = back(codes[i], vector)
        if i % step == 0:
            stored[i] = vector
    for begin in range(0, n, step):
        stop = min(begin + step, n)
        block = [stored[stop]]
        for i in range(stop - 1, begin - 1, -1):
            block.append(back(codes[i], block[-1]))
        block.reverse()
        for i, here, later in zip(range(begin, stop), block, block[1:], strict=False):
            inserted: list[str] = []
            while True:
                fits = [m for m in _MOVES[codes[i]][state] if m[1] + later[m[2]] == here[state]]
                if fits and (fits[0][0] == "D" or INSERT + here[_ON[state]] != here[state]):
                    break
                inserted.append(_ROLE[state])
                state = _ON[state]
            edit, cost, after = fits[0]
            role = _ROLE[state] if edit == "R" else None
            state = after
            yield edit, inserted, role, cost + INSERT * len(inserted), state


def closing(state: int) -> list[str]:
    """Roles of the turns to insert behind the last row."""
    return ["user", "assistant"] if state == OPENED else ["assistant"] if state == ASKED else []


# --- rows, faults and places ------------------------------------------------------------------


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _rows(turns: DataFrame) -> DataFrame:
    fill = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return with_row(turns.select("conv_id", _key("conv_id").alias("_key"), "turn", fill("role"), fill("text")))


def _placed(rows: DataFrame) -> DataFrame:
    """_key, _row, _at, digest, initial, fault: rows numbered in the order of the whole table."""
    order = [F.col("_key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]
    ordered = rows.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order)
    inner = F.rtrim(F.col("text"), F.lit(_GAP))
    initial = F.lit(3)
    for i, name in enumerate(INITIALS):
        initial = F.when(F.substring("role", 1, 1) == name, i).otherwise(initial)
    fault = F.when(inner == "", 1).when(~F.right(inner, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    narrow = ordered.select(
        "_key",
        "_row",
        F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text").cast("binary"), 256).alias("digest"),
        initial.alias("initial"),
        fault.alias("fault"),
    )
    return settle(narrow.withColumn("_at", F.monotonically_increasing_id()))


def _pieces(placed: DataFrame, block_bits: int) -> DataFrame:
    """_key, _block, rows (_at, _row, code), in order; at most 2 ** block_bits rows each.

    The first of equal rows is found by an aggregate and marked by its place, which no two rows share.
    """
    first = placed.groupBy("_key", "digest").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") != 1) & F.col("first").isNull(), 2).otherwise(F.col("fault"))
    marked = placed.join(first, "_at", "left").withColumn("code", F.col("initial") + 4 * fault)
    block = F.shiftright("_at", block_bits)
    grouped = marked.groupBy("_key", block.alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_at", "_row", "code"))).alias("rows"))
    return settle(grouped)


# --- conversations over more than one piece -----------------------------------------------------


def _per_piece(pieces: DataFrame, extra: list[str], fields: str, values) -> DataFrame:
    """_key, _block and what ``values`` gives for the codes and the extra columns of each piece."""
    names = [f.split()[0] for f in fields.split(", ")]
    schema = f"_key string, _block long, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                found = dict(zip(names, values(piece["codes"], *(piece[c] for c in extra)), strict=True))
                yield pa.RecordBatch.from_pylist([{"_key": piece["_key"], "_block": piece["_block"], **found}])

    return pieces.select("_key", "_block", F.col("rows.code").alias("codes"), *extra).mapInArrow(run, schema)


def _exits(codes: list[int], tail: list[int]) -> tuple[list[int]]:
    out = []
    for state in range(4):
        last = state
        for *_, last in walk(codes, tuple(tail), state):
            pass
        out.append(last)
    return (out,)


def _tails(group: pd.DataFrame) -> pd.DataFrame:
    """Vector behind each piece of one conversation, from the cost tables of the later ones."""
    group = group.sort_values("_block")
    vector, tails = END, []
    for costs in reversed(group["costs"].tolist()):
        tails.append(list(vector))
        vector = tuple(min(int(costs[4 * q + e]) + vector[e] for e in range(4)) for q in range(4))
    return pd.DataFrame(
        {
            "_key": group["_key"],
            "_block": group["_block"],
            "tail": tails[::-1],
            "before": [None, *group["last"].tolist()[:-1]],
            "ends": [False] * (len(group) - 1) + [True],
        }
    )


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    """State before each piece of one conversation."""
    group = group.sort_values("_block")
    state, entries = START, []
    for exits in group["exits"].tolist():
        entries.append(state)
        state = int(exits[state])
    return pd.DataFrame({"_key": group["_key"], "_block": group["_block"], "entry": entries})


def _known(pieces: DataFrame) -> DataFrame:
    """_key, _block, tail, before, ends, entry of all pieces that are not a whole conversation.

    At most one conversation runs over each boundary; a group is its pieces, narrow rows of 16 numbers.
    """
    many = pieces.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1").select("_key")
    many = settle(pieces.join(many, "_key", "left_semi"))
    costs = _per_piece(many, [], "costs array<long>, last long", lambda codes: (transfer(codes), codes[-1] & 3))
    tails = settle(costs.groupBy("_key").applyInPandas(_tails, "_key string, _block long, tail array<long>, before long, ends boolean"))
    exits = _per_piece(many.join(tails.select("_key", "_block", "tail"), ["_key", "_block"]), ["tail"], "exits array<long>", _exits)
    entries = exits.groupBy("_key").applyInPandas(_entries, "_key string, _block long, entry long")
    return settle(tails.join(entries, ["_key", "_block"]))


_EDIT = "_at long, _row long, fault int, edit string, opened array<string>, closed array<string>, new_role string, cost long, illegal boolean"
_EDIT_SCHEMA = pa.schema(
    [("_at", pa.int64()), ("_row", pa.int64()), ("fault", pa.int32()), ("edit", pa.string()), ("opened", pa.list_(pa.string()))]
    + [("closed", pa.list_(pa.string())), ("new_role", pa.string()), ("cost", pa.int64()), ("illegal", pa.bool_())]
)
# Edits in one batch on their way back to Spark.
_BATCH = 50_000


def _edits_of(piece: dict) -> Iterator[tuple]:
    rows, before, whole = piece["rows"], piece["before"], piece["tail"] is None
    codes = [r["code"] for r in rows]
    tail = END if whole else tuple(piece["tail"])
    ends = len(rows) - 1 if whole or piece["ends"] else None
    for i, (edit, opened, role, cost, state) in enumerate(walk(codes, tail, piece["entry"] or START)):
        initial = codes[i] & 3
        closed = closing(state) if i == ends else []
        illegal = before is not None and (before, initial) not in _LEGAL
        yield rows[i]["_at"], rows[i]["_row"], codes[i] >> 2, edit, opened, closed, role, cost + INSERT * len(closed), illegal
        before = initial


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edits = (edit for batch in batches for at in range(batch.num_rows) for edit in _edits_of(batch.slice(at, 1).to_pylist()[0]))
    while some := list(itertools.islice(edits, _BATCH)):
        columns = zip(zip(*some, strict=True), _EDIT_SCHEMA, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=_EDIT_SCHEMA)


def edit_script(turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): its place in the order of the table, and its edit.

    ``opened`` and ``closed``: roles of the turns inserted before and behind it; ``new_role``: the role of a reroled
    row; ``fault``; ``illegal``: its role may not follow the one before; ``cost`` of all this.  Apply it to
    narrow steps over a table scan, or to a settled frame.
    """
    rows = _rows(turns)
    pieces = _pieces(_placed(rows), block_bits)
    told = pieces.join(_known(pieces), ["_key", "_block"], "left").select("rows", "tail", "before", "ends", "entry")
    edits = settle(told.mapInArrow(_edit_rows, _EDIT))
    fault = F.element_at(F.array(*[F.lit(f) for f in FAULTS]), F.col("fault") + 1)
    return edits.withColumn("fault", fault).join(rows, "_row").select(
        "conv_id", F.col("_at").alias("place"), "turn", "role", "text", "fault", "edit", "opened", "closed", "new_role", "cost", "illegal"
    )


def _turns_of() -> Column:
    """The repaired turns (role, text) of a row of the script, in order."""
    empty = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))
    return F.concat(empty(F.col("opened")), F.when(F.col("edit") == "D", F.slice(own, 1, 0)).otherwise(own), empty(F.col("closed")))


def apply_script(script: DataFrame) -> DataFrame:
    """conv_id, place, slot, role, text: the repaired turns, ordered by place and slot."""
    return script.select("conv_id", "place", F.posexplode(_turns_of()).alias("slot", "turn")).select("conv_id", "place", "slot", "turn.role", "turn.text")


# --- damage and digest --------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """Planted faults, by the checksum of id and turn modulo 20: 0 drops the row, 1 empties its text, 2 takes
    its sentence ends, 3 repeats it, 4 makes it a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return turns.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


_DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ZERO = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


class _Tally:
    """What is reported of one conversation, from its rows in order."""

    def __init__(self, key: str):
        self.key, self.low, self.high, self.turns = key, None, None, 0
        self.counts, self.illegal, self.cost, self.audit = dict.fromkeys(FAULTS, 0), 0, 0, []
        self.sha, self.lines = hashlib.sha256(), 0

    def add(self, row: dict) -> None:
        turn = row["turn"]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.counts[row["fault"]] += 1
        self.illegal += row["illegal"]
        self.cost += row["cost"]
        self.audit.append(row["audit"])
        for line in row["lines"]:
            self.sha.update((("\n" if self.lines else "") + line).encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        faults = [self.counts[f] for f in FAULTS[1:]]
        return self.key, gaps, *faults, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_key", *(f.split()[0] for f in _DIGEST.split(", "))]
    now, done = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                if now is None or row["_key"] != now.key:
                    if now is not None:
                        done.append(now.row())
                    now = _Tally(row["_key"])
                now.add(row)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(now.row(), strict=True)], names)


def digest(script: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation of ``ids`` (conv_id): gaps, faults, cost, audit and the hash of its repaired turns.

    The hash of a conversation is a chain over its turns, so its rows pass through one task, sorted by Spark and read
    as a stream; only the audit is held.
    """
    closed = F.concat(F.repeat(F.lit("I"), F.size("opened")), F.col("edit"), F.repeat(F.lit("I"), F.size("closed")))
    lines = F.transform(_turns_of(), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    rows = script.select(_key("conv_id").alias("_key"), "place", "turn", "fault", "illegal", "cost", closed.alias("audit"), lines.alias("lines"))
    rows = rows.repartition(shuffle_partitions(rows), "_key").sortWithinPartitions("_key", "place")
    found = rows.mapInArrow(_tallies, f"_key string, {_DIGEST}")
    every = ids.select("conv_id").distinct().withColumn("_key", _key("conv_id"))
    names = [f.split()[0] for f in _DIGEST.split(", ")]
    values = [F.coalesce(F.col(n), F.lit(z)).alias(n) for n, z in zip(names, _ZERO, strict=True)]
    return every.join(found, "_key", "left").select("conv_id", *values)
