"""Conversation structure repair: the cheapest edits that make a conversation's roles follow a grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from harborlens.llm.common import WHITE, dealt, own_hashes, ship_package, stored

#: The role grammar (s?(ua)+)? as an acceptor: what each state (0 start, 1 after s, 2 after u, 3 after a) goes to by a symbol.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: The cost of each edit (Keep, Rerole, Delete, Insert), and what a truncated row adds that isn't deleted.
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
NEVER = 1 << 40
ROLES = {"u": "user", "a": "assistant"}


def _made(state: int) -> str:
    """The one role that an edit may make in a state: the grammar takes u or a there, never both."""
    return next(x for x in GRAMMAR[state] if x in ROLES)


def arcs(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in the composition of input, edits and grammar, made as they are asked for.

    A code is d where the row must go, else the role's symbol (o: none of the grammar's), in upper case for a truncated row.
    """
    yield "D", COST["D"], state
    if code != "d":
        more, symbol = TRUNCATED * code.isupper(), code.lower()
        if symbol in GRAMMAR[state]:
            yield "K", COST["K"] + more, GRAMMAR[state][symbol]
        yield "R", COST["R"] + more, GRAMMAR[state][_made(state)]


def _inserted(state: int) -> Iterator[tuple[str, int, int]]:
    """No insert, one, or two. Three come back to a state that one has reached, and cost more."""
    edits, cost = "", 0
    for _ in range(3):
        yield edits, cost, state
        edits, cost, state = edits + "I", cost + COST["I"], GRAMMAR[state][_made(state)]


#: What it costs to end in each state, and by which inserts.
END = tuple(min((c, e) for e, c, to in _inserted(q) if to in FINAL) for q in range(4))


@cache
def step(code: str, after: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """The least (cost, edits) from each state before a row, and the state after it, where ``after`` has the costs from there on.

    Weights are pairs of cost and label string. In a state each label leads one way only, and edits of a row end
    with the row's own, so none begins another: the least string is found from the row's edits alone, whatever follows.
    """
    found = []
    for q in range(4):
        ways = ((c + c2 + after[to], e + e2, to) for e, c, mid in _inserted(q) for e2, c2, to in arcs(code, mid))
        found.append(min(ways))
    return tuple(found)


def _back(codes: str, after: Sequence[int]) -> tuple[list[tuple], tuple[int, ...]]:
    """The steps of a run of rows, from its last to its first, and the costs before it. Costs are kept as differences, so that few steps differ."""
    steps, low, now = [], 0, tuple(after)
    for code in reversed(codes):
        least = min(now)
        low += least
        steps.append(step(code, tuple(c - least if c < NEVER // 2 else NEVER for c in now)))
        now = tuple(c for c, _, _ in steps[-1])
    return steps, tuple(c + low if c < NEVER // 2 else NEVER for c in now)


def costs_through(codes: str) -> list[int]:
    """The least cost from each state before a run of rows to each after it, 16 in all: the run as one arc."""
    each = [_back(codes, [0 if q == to else NEVER for q in range(4)])[1] for to in range(4)]
    return [each[to][q] for q in range(4) for to in range(4)]


def edits_through(codes: str, after: Sequence[int], state: int) -> tuple[list[str], int]:
    """The edits of each row (inserts before it, and its own) on the least path from a state, and the state that it ends in."""
    steps, out = _back(codes, after)[0], []
    for s in reversed(steps):
        _, edits, state = s[state]
        out.append(edits)
    return out, state


def audit(codes: str) -> str:
    """The edits of a whole conversation."""
    out, state = edits_through(codes, [c for c, _ in END], 0)
    return "".join(out) + END[state][1]


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The same columns with faults that hang on a CRC-32 of ``conv:turn`` alone, of 20 kinds: 0 drops a row, 1 empties its text, 2 removes its
    signs of an ended sentence, 3 repeats it, 4 makes it the user's; the others leave it. A null is one space, but a null turn stays."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    rows = turns.select(F.col(conv_col), F.col(turn_col), F.when(kind == 4, "user").otherwise(said(role_col)).alias(role_col), text.alias(text_col), kind.alias("_kind"))
    return rows.where("_kind <> 0").withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, piece_bits: int) -> DataFrame:
    """The rows with fault and code, written in ranges of their order: _key, conv, known, turn, role, text, fault, code, _id, _range (of 2 to the ``piece_bits`` rows at most)."""
    key = F.when(F.col(conv_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(conv_col).cast("string")))
    rows = turns.select(
        key.alias("_key"), F.col(conv_col).alias("conv"), F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    # Rows that are all equal are counted first and told out again by number, so that a range can end between them.
    names = ["_key", "known", "turn", "role", "text"]
    rows = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.first("conv").alias("conv")).withColumns(dict(zip(("_own1", "_own2"), own_hashes(F.col("text")), strict=True)))
    said = ["_key", "role", "_own1", "_own2"]
    firsts = rows.groupBy(*said).agg(F.min(F.struct("known", "turn")).alias("first"), F.count(F.lit(1)).alias("rows"))
    rows, firsts = dealt(rows, firsts, said, "rows", rows.count(), ["known", "turn"])
    rows = rows.join(firsts, [*said, "_part"])
    block = 10_000
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.col("_block") * block, F.least(F.col("n"), (F.col("_block") + 1) * block) - 1)))
    ended = F.rtrim("text", F.lit(WHITE))
    again = (F.col("_copy") > 0) | (F.col("first") < F.struct("known", "turn"))
    fault = F.when(ended == "", "blank").when(again, "duplicate").when(~F.substring(ended, -1, 1).isin(".", "!", "?"), "truncated")
    symbol = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(symbol)).otherwise(symbol)
    order = ["_key", "known", "turn", "role", "_own1", "_own2", "_copy"]
    rows = rows.withColumn("fault", fault).withColumn("code", code).select(*order, "conv", "text", "fault", "code")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return stored(rows.withColumn("_range", F.shiftright("_id", piece_bits)).drop("_own1", "_own2", "_copy"), "turns")


def _paths(rows: DataFrame) -> DataFrame:
    """(_key, _range, _id, edits): for each piece of a conversation the edits of its rows in order, blank-separated; the last piece's end with those after its last row.

    A piece is what one range of the order holds of a conversation. Nearly all conversations are one piece; of the others there are fewer than two pieces a range.
    Such a piece becomes one arc, 16 costs from state to state, and a conversation's pieces meet by these alone: once from the end, for the
    costs after each piece, and once from the start, for the state before it.
    """
    pieces = rows.groupBy("_key", "_range").agg(F.min("_id").alias("_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", "code"))), lambda x: x["code"]), "").alias("codes"))
    pieces = stored(pieces, "pieces")
    cut = F.broadcast(pieces.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"))  # at most one for each border of two ranges
    end = F.array(*(F.lit(c).cast("long") for c, _ in END))
    whole = pieces.join(cut, "_key", "left_anti").select("*", end.alias("after"), F.lit(0).alias("state"), F.lit(True).alias("last"))
    some = stored(_with(pieces.join(cut, "_key"), "costs", "array<long>", pa.list_(pa.int64()), lambda r: costs_through(r["codes"])), "costs")

    def from_end(group: pa.Table) -> pa.Table:
        found, after = [], [c for c, _ in END]
        for i, r in enumerate(sorted(group.to_pylist(), key=lambda r: -r["_range"])):
            found.append({"_key": r["_key"], "_range": r["_range"], "after": after, "last": i == 0})
            after = [min(r["costs"][4 * q + to] + after[to] for to in range(4)) for q in range(4)]
        return pa.Table.from_pylist(found, pa.schema([("_key", pa.string()), ("_range", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())]))

    def from_start(group: pa.Table) -> pa.Table:
        found, state = [], 0
        for r in sorted(group.to_pylist(), key=lambda r: r["_range"]):
            found.append({"_key": r["_key"], "_range": r["_range"], "state": state})
            state = r["ends"][state]
        return pa.Table.from_pylist(found, pa.schema([("_key", pa.string()), ("_range", pa.int64()), ("state", pa.int32())]))

    slim = some.select("_key", "_range", "costs").groupBy("_key").applyInArrow(from_end, "_key string, _range long, after array<long>, last boolean")
    some = stored(_with(some.drop("costs").join(slim, ["_key", "_range"]), "ends", "array<int>", pa.list_(pa.int32()), lambda r: [edits_through(r["codes"], r["after"], q)[1] for q in range(4)]), "ends")
    states = some.select("_key", "_range", "ends").groupBy("_key").applyInArrow(from_start, "_key string, _range long, state int")
    both = whole.unionByName(some.drop("ends").join(states, ["_key", "_range"]).select(*whole.columns))

    def told(r: dict) -> str:
        edits, state = edits_through(r["codes"], r["after"], r["state"])
        return " ".join([*edits, END[state][1]] if r["last"] else edits)

    return _with(both, "edits", "string", pa.string(), told).select("_key", "_range", "_id", "state", "last", "edits")


def _with(df: DataFrame, name: str, kind: str, arrow: pa.DataType, f: Callable[[dict], object]) -> DataFrame:
    """``df`` with a column that a function makes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f(r) for r in b.to_pylist()], arrow)], names=[*b.schema.names, name])

    ship_package(df.sparkSession)
    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields]))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_bits: int = 20
) -> DataFrame:
    """One row for each row of ``turns`` and each insert: conv, place, sub, turn, old_role, fault, edit, role, text.

    Rows stand in the order of (place, sub) in their conversation; edit is K, R, D or I; role and text are those of the repaired conversation,
    which is made of the rows whose edit isn't D. Fault is a row's first of blank (no sign but white space), duplicate (role and text seen earlier), truncated
    (ends on none of ``.!?``), else null; an insert has no fault, turn or old role. Edits are the cheapest that make the roles' initials match
    ``(s?(ua)+)?`` (see ``COST``); blank rows and duplicates must go; of equally cheap edits those whose string of initials is the least in ASCII.

    A conversation is cut where a range of the sorted rows ends, of which none has more than 2 to the ``piece_bits`` rows; so a conversation of any length is dealt to many tasks (see ``_paths``). Null ids are one
    conversation; null turns come first; null roles and texts are one space. Rows of one turn stand by role, then by a hash of their text. Repeated rows are duplicates. A role that
    is empty, or begins with none of s, u, a, can't be kept. Columns other than the four are ignored; an empty table gives no rows.
    """
    rows = _ordered(turns, conv_col, turn_col, role_col, text_col, piece_bits)
    # A piece's edits travel to its rows as a row before the first of them; both then stream by.
    paths = _paths(rows).select("_key", "_range", "_id", F.lit(0).alias("_after"), F.col("state").alias("_state"), F.col("last").alias("_last"), F.col("edits").alias("_edits"))
    mixed = rows.select("_key", "_range", "_id", F.lit(1).alias("_after"), "conv", "turn", "role", "text", "fault").unionByName(paths, allowMissingColumns=True)
    mixed = mixed.repartition("_key", "_range").sortWithinPartitions("_key", "_range", "_id", "_after")
    out = StructType([
        rows.schema["conv"], StructField("place", LongType()), StructField("sub", LongType()), rows.schema["turn"],
        *(StructField(c, StringType()) for c in ("old_role", "fault", "edit", "role", "text")), StructField("_key", StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, state, last, left = iter(()), 0, False, 0
        for b in batches:
            found, kind = [], b.schema.field
            for r in b.to_pylist():
                if not r["_after"]:
                    split = r["_edits"].split(" ")
                    tail, left = (split.pop(), len(split)) if r["_last"] else ("", len(split))
                    edits, state, last = iter(split), r["_state"], r["_last"]
                    continue
                conv, own, sub = r["conv"], next(edits), 0
                left -= 1
                for e in own:
                    fault, turn, old, text = (None, None, None, "") if e == "I" else (r["fault"], r["turn"], r["role"], r["text"])
                    role = r["role"] if e in "KD" else ROLES[_made(state)]
                    found.append((conv, r["_id"], sub, turn, old, fault, e, role, text, r["_key"]))
                    sub += 1
                    if e != "D":
                        state = GRAMMAR[state][role[0]]
                if last and not left:
                    for e in tail:
                        role = ROLES[_made(state)]
                        found.append((conv, r["_id"], sub, None, None, None, e, role, "", r["_key"]))
                        sub, state = sub + 1, GRAMMAR[state][role[0]]
            yield _batch(found, out.names, [kind("conv").type, pa.int64(), pa.int64(), kind("turn").type, *[pa.string()] * 6])

    ship_package(turns.sparkSession)
    return mixed.mapInArrow(run, out)


def _report(repaired: DataFrame) -> DataFrame:
    """(_key, counts, audit, repaired_sha256) of each conversation, whose rows stream through one task in order: a digest of a whole conversation is a
    sequence by nature. The task holds its running digest and counts, and the audit's letters."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = StructType([StructField("_key", StringType()), *(StructField(c, LongType()) for c in names), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds = None, [pa.string(), *[pa.int64()] * len(names), pa.string(), pa.string()]

        def ended(c: dict) -> tuple:
            gaps = c["high"] - c["low"] + 1 - c["turns"] if c["turns"] else 0
            return c["key"], gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"], c["audit"].decode(), c["sha"].hexdigest()

        for b in batches:
            found = []
            for r in b.to_pylist():
                if now is None or now["key"] != r["_key"]:
                    if now is not None:
                        found.append(ended(now))
                    now = {"key": r["_key"], "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": bytearray(), "sha": hashlib.sha256(), "said": False, "before": None}
                e = r["edit"]
                if e != "I":
                    if r["turn"] is not None and r["turn"] != now["high"]:  # in order: a turn not seen before
                        now["turns"] += 1
                        now["low"], now["high"] = r["turn"] if now["low"] is None else now["low"], r["turn"]
                    if r["fault"]:
                        now[r["fault"]] += 1
                    initial = r["old_role"][:1]
                    now["illegal"] += now["before"] is not None and now["before"] + initial not in ("su", "ua", "au")
                    now["before"] = initial
                now["audit"] += e.encode()
                now["cost"] += COST[e] + TRUNCATED * (r["fault"] == "truncated" and e != "D")
                if e != "D":
                    now["sha"].update(f"{chr(10) if now['said'] else ''}{r['role']}:{r['text']}".encode())
                    now["said"] = True
            yield _batch(found, schema.names, kinds)
        if now is not None:
            yield _batch([ended(now)], schema.names, kinds)

    ship_package(repaired.sparkSession)
    return repaired.repartition("_key").sortWithinPartitions("_key", "place", "sub").mapInArrow(run, schema)


def repair_report(turns: DataFrame, originals: DataFrame, conv_col: str = "conv_id", **how: str | int) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that has rows in ``originals``.

    gaps are the turns missing between the least and the greatest; blank, duplicate, truncated count rows by their first fault; illegal counts
    neighbours whose roles' initials are none of su, ua, au; cost and audit tell the edits of ``repair``; the digest is that of the
    repaired rows, ``role:text`` a line. A conversation without rows in ``turns`` has zeros, an empty audit and the digest of an empty text.
    """
    found = _report(repair(turns, conv_col, **how))
    key: Column = F.when(F.col(conv_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(conv_col).cast("string")))
    all_of = originals.groupBy(conv_col).agg(F.lit(1).alias("_one")).select(conv_col, key.alias("_key"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = hashlib.sha256(b"").hexdigest()
    return all_of.join(found, "_key", "left").select(
        conv_col, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
