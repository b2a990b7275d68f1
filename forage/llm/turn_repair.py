"""Repair of conversation structure by a checkpointed shortest path.

A conversation is in order when the initials of its roles read ``(s?(ua)+)?``.
Its rows, by turn, are edited from first to last: Keep (0), Rerole to user or
assistant (1), Delete (2); Insert (5) puts a user or assistant turn without
text anywhere.  Blank rows and repeats must go; a truncated row that stays
costs 5 more.  Of the cheapest edits, those whose initials are ASCII-least are
made.

1. Rows become narrow ones (hash of role and text, one code byte); equal rows
   of a turn are one with a count.  A repeat is a row whose hash has an earlier
   turn, found by an aggregate and a join.
2. A sort by range puts the rows of all conversations in order, so that a large
   conversation is spread over many tasks; each task sends the code bytes of
   its stretch as one value.
3. A conversation is then one string of code bytes, as long as its audit.
   Backward, the cost from every state of the pattern to the end is kept only
   at each square root of n rows; forward, one block of costs after the other
   is computed anew, and the least letter that lies on a cheapest path is taken
   from the set of states that the letters so far can be in.  Costs count from
   their minimum, so few vectors exist and steps are looked up.
4. The audit meets the texts in a sorted stream per conversation, which writes
   the repaired turns; nothing but the audit and a batch is held.

Null role or text counts as one space, a null ``conv_id`` is a conversation, a
null turn comes first.  Rows of one turn are ordered by role, then by the MD5
of their text.  An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forage.session import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 40
#: Code byte of a row: class of its role in the low bits, then flags.
S, U, A, OTHER = range(4)
GONE, SHORT, BLANK = 4, 8, 16
#: Where a role leads from each state: start, after s, after u, after a.
NEXT = {S: (1, None, None, None), U: (2, 2, None, 2), A: (None, None, 3, None), OTHER: (None,) * 4}
ENDS = (0, NEVER, NEVER, 0)
LEGAL = {(S, U), (U, A), (A, U)}
_INITIALS = "sua"
BLANKS = " \t\n\v\f\r"


def _edits(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Letters with cost and next state by which a row can be passed from a state."""
    yield "D", DELETE, state
    if code & GONE:
        return
    extra = TRUNCATED if code & SHORT else 0
    if (after := NEXT[code & 3][state]) is not None:
        yield "K", KEEP + extra, after
    for role in (U, A):
        if (after := NEXT[role][state]) is not None:
            yield "R", REROLE + extra, after


def _inserts(state: int) -> list[int]:
    return [after for role in (U, A) if (after := NEXT[role][state]) is not None]


def _with_inserts(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """Costs where turns may be put in first, counted from the least, and that least."""
    for _ in range(2):
        costs = [min([c, *(INSERT + costs[a] for a in _inserts(q))]) for q, c in enumerate(costs)]
    least = min(costs)
    return tuple(c - least for c in costs), least


END, END_LEAST = _with_inserts(list(ENDS))


@lru_cache(maxsize=1 << 16)
def before(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs from each state before a row to the end, from those after it."""
    return _with_inserts([min(cost + after[to] for _, cost, to in _edits(code, q)) for q in range(4)])


@lru_cache(maxsize=1 << 16)
def advance(states: frozenset[int], code: int, after: tuple[int, ...]) -> tuple[str, frozenset[int]]:
    """Least letters on cheapest paths, through one row, from any of the states."""
    here, least = before(code, after)
    letters = ""
    while True:
        ways = {("I", to) for q in states for to in _inserts(q) if INSERT + here[to] == here[q]}
        ways |= {(letter, to) for q in states for letter, cost, to in _edits(code, q) if cost + after[to] == here[q] + least}
        letter = min(ways)[0]
        letters += letter
        states = frozenset(to for way, to in ways if way == letter)
        if letter != "I":
            return letters, states


@lru_cache(maxsize=1 << 10)
def finish(states: frozenset[int]) -> str:
    """Turns put in after the last row."""
    letters = ""
    while not any(ENDS[q] == END[q] + END_LEAST for q in states):
        states = frozenset(to for q in states for to in _inserts(q) if INSERT + END[to] == END[q])
        letters += "I"
    return letters


def solve(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation of code bytes."""
    n, costs, total = len(codes), END, END_LEAST
    size = isqrt(n) + 1
    checkpoints = {n: END}
    for i in range(n - 1, -1, -1):
        costs, least = before(codes[i], costs)
        total += least
        if i % size == 0:
            checkpoints[i] = costs
    total += costs[0]
    states, audit = frozenset([0]), []
    for start in range(0, n, size):
        end = min(n, start + size)
        block = [checkpoints[end]]
        for i in range(end - 1, start, -1):
            block.append(before(codes[i], block[-1])[0])
        letters = []
        for code, after in zip(codes[start:end], reversed(block)):
            some, states = advance(states, code, after)
            letters.append(some)
        audit.append("".join(letters))
    return total, "".join(audit) + finish(states)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with text for nulls and their order: conv_id, turn, role, text, _dated, _mark."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role, text)
    return rows.select("*", F.col("turn").isNotNull().alias("_dated"), F.unhex(F.md5("text")).alias("_mark"))


ORDER = ["_dated", "turn", "role", "_mark"]


def _code() -> Column:
    """Code byte of a row without regard to repeats."""
    initial = F.substring("role", 1, 1)
    kind = F.lit(OTHER)
    for k, letter in enumerate(_INITIALS):
        kind = F.when(initial == letter, k).otherwise(kind)
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(last == "", GONE | BLANK).when(last.isin(*".!?"), 0).otherwise(SHORT)
    return kind + fault


def _coded(rows: DataFrame) -> DataFrame:
    """One row per different row of a turn: order columns, code, copies, and whether an earlier turn has its role and text."""
    conversation = [F.col("conv_id").isNull().cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))]
    parts = F.to_json(F.array(*conversation, "role"))
    rows = _ordered(rows).select("conv_id", *ORDER, _code().alias("code"), F.unhex(F.md5(F.concat(F.hex("_mark"), parts))).alias("_same"))
    # written, because both sides of the join below read it
    rows = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "coded")
    first = rows.groupBy("_same").agg(F.min("_dated").alias("_any"), F.min("turn").alias("_first"), F.count(F.lit(1)).alias("_turns")).filter("_turns > 1")
    rows = rows.join(first.drop("_turns"), "_same", "left")
    # _any is false where an undated row has this role and text; that one comes first.
    earlier = F.when(F.col("_any").isNull(), False).when(F.col("_any"), F.col("turn") > F.col("_first")).otherwise(F.col("_dated"))
    return rows.withColumn("again", earlier).drop("_same", "_any", "_first")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, one per conversation in this task: its first row's order, turn figures and code bytes."""
    names = ["conv_id", *ORDER, "first_turn", "last_turn", "turns", "codes"]
    open_: list = []

    def closed(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip([*found[:-1], bytes(found[-1])], types)], names=names)

    types: list[pa.DataType] = []
    for batch in batches:
        types = [*(batch.schema.field(c).type for c in names[:5]), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [batch.column(c).to_pylist() for c in ("conv_id", *ORDER, "code", "copies", "again")]
        done = []
        for conversation, dated, turn, role, mark, code, copies, again in zip(*columns):
            if not open_ or open_[0] != conversation:
                if open_:
                    done.append(open_)
                open_ = [conversation, dated, turn, role, mark, None, None, 0, bytearray()]
            if turn is not None and turn != open_[6]:
                open_[5:8] = [turn if open_[5] is None else open_[5], turn, open_[7] + 1]
            repeat = code if code & BLANK else code & 3 | GONE
            open_[8] += bytes([repeat if again else code]) + bytes([repeat]) * (copies - 1)
        yield from map(closed, done)
    if open_:
        yield closed(open_)


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures and audit of conversations, from their stretches in order."""
    legal = np.zeros((4, 4), dtype=bool)
    for pair in LEGAL:
        legal[pair] = True
    for batch in batches:
        found = []
        for stretches in batch.column("stretches").to_pylist():
            codes = b"".join(s["codes"] for s in stretches)
            dated = [s for s in stretches if s["turns"]]
            split = sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:]))
            gaps = dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - sum(s["turns"] for s in dated) + split if dated else 0
            flags = np.frombuffer(codes, dtype=np.uint8)
            roles = flags & 3
            blank, gone, short = (int(np.count_nonzero(flags & f)) for f in (BLANK, GONE, SHORT))
            illegal = int(np.count_nonzero(~legal[roles[:-1], roles[1:]]))
            found.append((gaps, blank, gone - blank, short, illegal, *solve(codes)))
        columns = [pa.array(c, type=pa.int64()) for c in list(zip(*found))[:6]] + [pa.array([f[6] for f in found], type=pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", *FIGURES, "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, the FIGURES and the audit of every conversation in ``rows`` (conv_id, turn, role, text)."""
    coded = _coded(rows)
    order = ["conv_id", *ORDER]
    kinds = {f.name: f for f in coded.schema.fields}
    figures = [T.StructField(c, T.LongType()) for c in ("first_turn", "last_turn", "turns")]
    schema = T.StructType([*(kinds[c] for c in order), *figures, T.StructField("codes", T.BinaryType())])
    pieces = coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stretches, schema)
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*ORDER, "first_turn", "last_turn", "turns", "codes"))).alias("stretches"))
    result = T.StructType([kinds["conv_id"], *(T.StructField(c, T.LongType()) for c in FIGURES), T.StructField("audit", T.StringType())])
    return whole.mapInArrow(_audited, result)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position (from 1), edit, turn, role, text.

    ``found`` has the audits of ``rows``.  Turns put in have no turn number.
    Partitions hold whole conversations, one after the other, by position.
    """
    heads = found.select("conv_id", F.lit(False).alias("_row"), F.col("audit").alias("text"))
    both = heads.unionByName(_ordered(rows).withColumn("_row", F.lit(True)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "_row", *ORDER).select("conv_id", "_row", "turn", "role", "text")
    kinds = {f.name: f for f in both.schema.fields}
    schema = T.StructType([kinds["conv_id"], T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()), *(kinds[c] for c in ("turn", "role", "text"))])
    return both.mapInArrow(_edited, schema)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply audits to the rows that follow them."""
    audit, at, position, system, conversation = "", 0, 0, 0, None
    found: list[tuple] = []

    def added(letter: str, own: str | None, place: int | None) -> None:
        nonlocal position
        position += 1
        role = own if letter == "K" else ("assistant", "user")[(position - system) % 2]
        found.append((conversation, position, letter, role, place))

    def inserted() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            added("I", None, None)
            at += 1

    kinds = None
    for batch in batches:
        kinds = (batch.schema.field("conv_id").type, batch.column("turn"), batch.column("text"))
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "_row", "role"))
        for place, (conv_id, is_row, role) in enumerate(zip(*columns)):
            if not is_row:
                inserted()
                conversation, audit, at, position = conv_id, batch.column("text")[place].as_py(), 0, 0
                system = (len(audit) - audit.count("D")) % 2
                continue
            inserted()
            if audit[at] != "D":
                added(audit[at], role, place)
            at += 1
        yield _batch(found, *kinds)
        found.clear()
    if kinds:
        inserted()
        yield _batch(found, *kinds)


def _batch(found: list[tuple], kind: pa.DataType, turns: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    conversations, positions, edits, roles, places = zip(*found) if found else ((),) * 5
    take = pa.array(places, type=pa.int64())
    text = texts.take(take).fill_null("")
    columns = [pa.array(conversations, type=kind), pa.array(positions, type=pa.int64()), pa.array(edits, type=pa.string()), turns.take(take), pa.array(roles, type=pa.string()), text]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "position", "edit", "turn", "role", "text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, as they stream by."""
    state, conversation, kind = None, None, None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        done = []
        for conv_id, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
            if position == 1:
                if state:
                    done.append((conversation, state.hexdigest()))
                state, conversation = hashlib.sha256(), conv_id
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=kind), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([conversation], type=kind), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows as the contract damages them: by ``crc32('conv_id:turn') % 20``."""
    space = F.lit(" ")
    conv_id, turn, role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text"))
    kind = F.pmod(F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")), F.lit(20)).cast("int")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).filter("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, the FIGURES, audit and repaired_sha256 of every conversation after damage."""
    rows = damaged(conversations)
    found = cut(audits(rows), "audits")
    kind = found.schema["conv_id"]
    lines = repaired(rows, found).mapInArrow(_hashed, T.StructType([kind, T.StructField("repaired_sha256", T.StringType())]))
    every = conversations.select("conv_id").distinct().alias("e")
    same = lambda name: F.col("e.conv_id").eqNullSafe(F.col(f"{name}.conv_id"))
    joined = every.join(found.alias("f"), same("f"), "left").join(lines.alias("l"), same("l"), "left")
    figures = [F.coalesce(F.col(f"f.{c}"), F.lit(0).cast("bigint")).alias(c) for c in FIGURES]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("e.conv_id", *figures, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("l.repaired_sha256", empty).alias("repaired_sha256"))
