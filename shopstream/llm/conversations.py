"""Repair of conversation structure by the cheapest edits.

A conversation's rows are read by a small automaton of roles (begin, after system, after user, after
assistant). Going backwards, each row turns the least costs to the end from each state into those from the
row before. These vectors are kept at checkpoints only, some square root of the rows apart: the rows between
two checkpoints are a block. A block's effect on the vectors is a four by four matrix, so blocks are made
in parallel, wherever a conversation's rows are, and only matrices are passed along the conversation. Then
each block makes its own vectors again and walks forward from each state it may be entered in, taking of all
edits on a cheapest path the one whose letter is least; a last pass along the conversation takes the walk of
the state that the block before ends in. What is in one task's memory is a block.

Only the last pass sees a whole conversation, row by row, as the hash of the repaired text is a chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A block has at least so many rows, if its texts stay below the bytes; block k of a task has k rows if that is more.
LEAST_ROWS, BLOCK_BYTES = 64, 1 << 18
#: States: begin, after system, after user, after assistant.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept role, a role that is set, or an inserted row leads.
KEPT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
TURNED = [USER, USER, ASSISTANT, USER]
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Least costs when no row is left: nothing, or user and assistant, or assistant are missing.
END = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 60
BLANK, DUPLICATE, CUT = 1, 2, 3
_SPACE = r"[\x20\x09-\x0D]"


def key_of(column: str) -> Column:
    """A conversation's id as text, a null apart from all of them."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the crc32 of ``conv_id:turn`` modulo 20 gives them; a null counts as one space.

    0 drops a row, 1 empties its text, 2 takes out its ``.``, ``!`` and ``?``, 3 doubles it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), kind.alias("_kind"))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def _faults(rows: DataFrame, tables: Scratch) -> DataFrame:
    """key, turn, role, text, n (equal rows) and fault of the first of them; rows are different from each other."""
    text = F.col("text")
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    own = rows.groupBy(key_of("conv_id").alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumn("same", F.unhex(F.sha2("text", 256))).withColumn("blank", blank).withColumn("cut", ~text.rlike(rf"[.!?]{_SPACE}*\z"))
    own = tables.put(own, "different")
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    # rows of one text and role, but not blank, that have several turns: the first turn of each
    again = own.where("not blank").groupBy("key", "role", "same").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    later = F.col("first").isNotNull() & (place > F.col("first"))
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(F.col("cut"), CUT).otherwise(0).cast("int")
    return own.join(again, ["key", "role", "same"], "left").select("key", "turn", "role", "text", "n", fault.alias("fault"))


def _step(costs: list[int], initial: str, fault: int, n: int) -> list[int]:
    """Least costs to the end before ``n`` equal rows, from those after them."""
    if fault in (BLANK, DUPLICATE):
        return [c + DELETE * n for c in costs]
    costs = [c + DELETE * (n - 1) for c in costs]
    more = TRUNCATED if fault == CUT else 0
    own = []
    for state in range(4):
        best = min(costs[state] + DELETE, costs[TURNED[state]] + REROLE + more)
        if initial in KEPT[state]:
            best = min(best, costs[KEPT[state][initial]] + KEEP + more)
        own.append(best)
    user, assistant = min(own[USER], own[ASSISTANT] + INSERT), min(own[ASSISTANT], own[USER] + INSERT)
    return [min(own[BEGIN], user + INSERT), min(own[SYSTEM], user + INSERT), user, assistant]


def _matrix(initials: str, faults: bytes, ns: list[int]) -> list[int]:
    """Least costs from each state before a block to each state after it, row by row."""
    columns = []
    for end in range(4):
        costs = [0 if state == end else FAR for state in range(4)]
        for i in range(len(ns) - 1, -1, -1):
            costs = _step(costs, initials[i], faults[i], ns[i])
        columns.append(costs)
    return [columns[end][state] for state in range(4) for end in range(4)]


def _walk(state: int, costs: list[list[int]], initials: str, faults: bytes, ns: list[int], last: bool) -> tuple[int, str]:
    """The state behind a block and the least of its cheapest edits, from the costs before each row."""
    out: list[str] = []
    for i, n in enumerate(ns):
        fault = faults[i]
        if fault in (BLANK, DUPLICATE):  # equal rows that must go, go first: D is the least letter
            out.append("D" * n)
            continue
        after = [c + DELETE * (n - 1) for c in costs[i + 1]]
        more = TRUNCATED if fault == CUT else 0
        while True:
            left = costs[i][state]
            if after[state] + DELETE == left:
                out.append("D")
            elif costs[i][TURNED[state]] + INSERT == left:
                out.append("I")
                state = TURNED[state]
                continue
            elif initials[i] in KEPT[state] and after[KEPT[state][initials[i]]] + KEEP + more == left:
                out.append("K")
                state = KEPT[state][initials[i]]
            else:
                out.append("R")
                state = TURNED[state]
            break
        out.append("D" * (n - 1))
    while last and state not in (BEGIN, ASSISTANT):
        out.append("I")
        state = TURNED[state]
    return state, "".join(out)


_SCHEMA = pa.schema([
    ("key", pa.string()), ("part", pa.int32()), ("k", pa.int32()), ("initials", pa.string()), ("faults", pa.binary()), ("ns", pa.list_(pa.int64())),
    ("matrix", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("illegal", pa.int64()),
])
_BLOCKS = "key string, part int, k int, initials string, faults binary, ns array<long>, matrix array<long>, roles array<string>, texts array<string>, turns long, first_turn long, last_turn long, illegal long"


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _block(key: str, part: int, k: int, rows: list[tuple]) -> dict:
    """A block's rows and what its conversation needs of it; a role without a letter has the initial ``?``, as good as any wrong one."""
    initials = "".join((r[1] or "?")[0] for r in rows)
    faults, ns = bytes(r[4] for r in rows), [r[3] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:])) + sum(ns) - len(ns)
    return {
        "key": key, "part": part, "k": k, "initials": initials, "faults": faults, "ns": ns, "matrix": _matrix(initials, faults, ns), "roles": [r[1] for r in rows], "texts": [r[2] for r in rows],
        "turns": len(set(turns)), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "illegal": illegal,
    }


def _blocks(rows: DataFrame, least_rows: int, most_bytes: int) -> DataFrame:
    """Blocks of consecutive rows of a conversation, numbered by task and in it."""
    order = ["key", "turn", "role", F.substring("text", 1, 64)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions("key", "turn", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, key = TaskContext.get().partitionId(), 0, None
        held: list[tuple] = []
        ready: list[dict] = []
        size = total = 0
        for b in batches:
            for own, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (own != key or len(held) >= max(least_rows, k) or size >= most_bytes):
                    ready.append(_block(key, part, k, held))
                    total += size
                    held, size, k = [], 0, k + 1 if own == key else 0
                    if total > 1 << 20:
                        yield pa.RecordBatch.from_pylist(ready, _SCHEMA)
                        ready, total = [], 0
                key = own
                held.append(tuple(row))
                size += len(row[1]) + len(row[2])
        if held:
            ready.append(_block(key, part, k, held))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, _SCHEMA)

    return rows.mapInArrow(work, _BLOCKS)


def _checkpoints(blocks: DataFrame) -> DataFrame:
    """The costs behind each block, and whether it is its conversation's first or last."""
    rows = blocks.select("key", "part", "k", "matrix").repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("k"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, costs, held = None, END, None  # one row waits to learn whether it is the first
        for b in batches:
            out = []
            for own, part, k, matrix in zip(*(c.to_pylist() for c in b.columns)):
                last = own != key
                if held is not None:
                    out.append((*held, last))
                key, costs = own, END if last else costs
                held = own, part, k, costs, last
                costs = [min(matrix[4 * s + e] + costs[e] for e in range(4)) for s in range(4)]
            if out:
                yield batch(out)
        if held is not None:
            yield batch([(*held, True)])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["key", "part", "k", "costs", "last", "first"])

    return rows.mapInArrow(work, "key string, part int, k int, costs array<long>, last boolean, first boolean")


def _walks(blocks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Of each block and state it may be entered in: the state behind it, the edits, and the cost to the end."""
    rows = blocks.select("key", "part", "k", "initials", "faults", "ns").join(checkpoints, ["key", "part", "k"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, part, k, initials, faults, ns, costs, last, first in zip(*(c.to_pylist() for c in b.columns)):
                each = [costs]
                for i in range(len(ns) - 1, -1, -1):
                    each.append(_step(each[-1], initials[i], faults[i], ns[i]))
                each.reverse()
                found = [_walk(s, each, initials, faults, ns, last) for s in ([BEGIN] if first else range(4))]
                out.append((key, part, k, [f[0] for f in found], [f[1] for f in found], each[0][BEGIN]))
            if out:
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "part", "k", "ends", "edits", "cost"])

    return rows.mapInArrow(work, "key string, part int, k int, ends array<int>, edits array<string>, cost long")


def repaired_rows(state: int, edits: str, roles: list[str], texts: list[str], ns: list[int]) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that a block's edits leave."""
    i, used = 0, 0
    for edit in edits:
        if edit == "I":
            state = TURNED[state]
            yield NAMES[state], ""
            continue
        if edit == "K":
            state = KEPT[state][roles[i][0]]
            yield roles[i], texts[i]
        elif edit == "R":
            state = TURNED[state]
            yield NAMES[state], texts[i]
        used += 1
        if used == ns[i]:
            i, used = i + 1, 0


_RESULT = [("key", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


class _Conversation:
    """What is known of one conversation while its blocks pass."""

    def __init__(self, key: str):
        self.key, self.state, self.cost, self.hash, self.any = key, BEGIN, None, hashlib.sha256(), False
        self.turns, self.least, self.most, self.illegal, self.initial = 0, None, None, 0, None
        self.faults, self.audit, self.walk = [0, 0, 0, 0], [], None

    def add(self, x: dict) -> None:
        if x["ends"] is not None:
            self.walk = x
            self.cost = x["cost"] if self.cost is None else self.cost
            return
        place = self.state if len(self.walk["ends"]) > 1 else 0
        edits = self.walk["edits"][place]
        rows = "\n".join(f"{role}:{text}" for role, text in repaired_rows(self.state, edits, x["roles"], x["texts"], x["ns"]))
        if rows:  # a row has a colon at least
            self.hash.update(("\n" if self.any else "").encode() + rows.encode())
            self.any = True
        self.state = self.walk["ends"][place]
        self.audit.append(edits)
        for fault, n in zip(x["faults"], x["ns"]):
            self.faults[fault] += n if fault in (BLANK, DUPLICATE) else 1
            self.faults[DUPLICATE] += n - 1 if fault in (0, CUT) else 0
        self.illegal += x["illegal"] + (self.initial is not None and not _legal(self.initial, x["initials"][0]))
        self.initial = x["initials"][-1]
        if x["turns"]:
            self.turns += x["turns"] - (x["first_turn"] == self.most)
            self.least = x["first_turn"] if self.least is None else self.least
            self.most = x["last_turn"]

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return self.key, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _joined(blocks: DataFrame, walks: DataFrame) -> DataFrame:
    """A row for each conversation: blocks pass in order, each behind its walks."""
    texts = blocks.select("key", "part", "k", F.lit(None).cast("array<int>").alias("ends"), F.lit(None).cast("array<string>").alias("edits"), F.lit(None).cast("long").alias("cost"), "initials", "faults", "ns", "roles", "texts", "turns", "first_turn", "last_turn", "illegal")
    rows = texts.unionByName(walks, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "part", "k", F.col("ends").isNull())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Conversation | None = None
        for b in batches:
            out = []
            for at in range(0, len(b), 64):
                for x in b.slice(at, 64).to_pylist():
                    if own is None or own.key != x["key"]:
                        if own is not None:
                            out.append(own.row())
                        own = _Conversation(x["key"])
                    own.add(x)
            if out:
                yield batch(out)
        if own is not None:
            yield batch([own.row()])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _RESULT)], names=[n for n, _ in _RESULT])

    return rows.mapInArrow(work, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repair(rows: DataFrame, conversations: DataFrame | None = None, *, least_rows: int = LEAST_ROWS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Faults of each conversation and the cheapest edits that mend its structure.

    ``rows`` has conv_id, turn, role and text. Returns a row for each conv_id of ``conversations`` (or of
    ``rows``): gaps in the turns, blank, duplicate, truncated and illegal (neighbours whose initials are not
    su, ua or au), cost, audit (the edits' initials in order: Delete, Insert, Keep, Rerole) and
    repaired_sha256 (of the lines ``role:text``). Of all cheapest edits those with the least audit are taken.

    Rows are in order of turn, nulls first; rows of one turn in order of role and text. A null role or text
    is one space; an empty role has no letter and must be changed. Rows with a null conv_id are one
    conversation. Equal rows are one row with a number, so copies don't come together. A conversation
    without rows has zeros, an empty audit and the hash of nothing; empty tables give an empty result.
    Turns are integers; other columns are not looked at. The texts of one conversation pass through one
    task in bounded memory, for their hash; its audit is one value, a letter for each edit.
    """
    tables = Scratch(rows.sparkSession, "conversations")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    blocks = tables.put(_blocks(_faults(rows, tables), least_rows, most_bytes), "blocks")
    tables.drop("different")
    checkpoints = tables.put(_checkpoints(blocks), "checkpoints")
    walks = tables.put(_walks(blocks, checkpoints), "walks")
    found = tables.put(_joined(blocks, walks), "found")
    all_ids = (conversations if conversations is not None else rows).select("conv_id").distinct().withColumn("key", key_of("conv_id"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = all_ids.join(tables.keep(found, "found"), "key", "left")
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
