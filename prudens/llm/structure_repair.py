"""Operator 13: cheapest repair of a conversation's structure by rank-convergence parallel Viterbi.

A conversation is a path through four states (nothing yet, after the system turn, after a user turn, after an
assistant turn); keeping, retyping, deleting and inserting turns have costs, and the cheapest path to an allowed
end is wanted, of equal ones that whose edits read ASCII-least. Costs run backwards: a vector of four costs to
the end at each turn. Long conversations are cut into chunks that all begin at once from a speculative vector.
A fix-up pass gives each chunk the vector its successor arrived at and reruns it, but only until its vectors
differ from the earlier ones by a constant: from there on everything before differs by that constant too, and
choices depend on differences alone. Passes repeat until no chunk gets another vector than it was computed
from; after pass k the last k + 1 chunks of every conversation are exact, so they end. Each chunk is then traced
from all four states at once, the exits are chained, and the edits of the true entry state are taken.

Spark range-partitions the turns by (conversation, turn), so a conversation of any length spreads over many
tasks; within a task turns stream by, at most CHUNK of them (or CHUNK_BYTES) in memory. A conversation that
lies whole in one chunk has its true end vector at once and is finished there; chunks travel only of the others.
What is sequential by nature, one SHA-256 over a conversation's repaired turns, streams over its chunks.

Defined cases: null conv_id is one conversation of its own; null roles and texts are one space; turns without
a number come first; turns that share a number stand in the order of the MD5 of role and text. A conversation
whose turns are all dropped has zeros and an empty audit. An empty table gives an empty result. Further columns
are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prudens.llm.common import Scratch
from prudens.llm.lookup import BROADCAST_ROWS, attach

CHUNK, CHUNK_BYTES = 256, 4_000_000
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
# states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
#: Role code (system, user, assistant, other) -> state -> state; None where the turn can't stand.
STEP = [[SYSTEM, None, None, None], [USER, USER, None, USER], [None, None, ASSISTANT, None], [None] * 4]
#: The turn that can be inserted or retyped to in each state, as the state after it.
NEXT = [USER, USER, ASSISTANT, USER]
NAMES = {USER: "user", ASSISTANT: "assistant"}
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Faults in a turn's code, times four.
FINE, CUT_SHORT, UNFIT = range(3)


# ---------------------------------------------------------------- turns and faults
def damage(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone): damaged turns; dropped ones stay as markers with ``gone`` set."""
    blank = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))
    kind = F.pmod(F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")), F.lit(20))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    hurt = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), hurt.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "col")


def plain(conversations: DataFrame) -> DataFrame:
    """The same columns of undamaged turns."""
    blank = F.lit(" ")
    return conversations.select(F.coalesce(F.col("conv_id").cast("string"), blank).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.lit(False).alias("gone"))


def _faulted(rows: DataFrame, scratch: Scratch, broadcast_rows: int) -> DataFrame:
    """Adds the turn's digest, its own fault and, for contents that recur, the first turn that has them."""
    end = F.rtrim("text", F.lit(SPACES))
    own = F.when(F.col("gone"), "gone").when(end == "", "blank").when(F.right(end, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = rows.select("conv", "turn", digest.alias("digest"), "role", F.when(~F.col("gone"), F.col("text")).alias("text"), own.alias("fault"))
    seen = rows.where("fault <> 'gone'").groupBy("conv", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")).alias("first")).where("n > 1")
    total = rows.count()
    return attach(rows, scratch.write(seen, "seen"), ["conv", "digest"], "n", total, ["conv", "turn"], broadcast_rows)


# ---------------------------------------------------------------- Viterbi
def _closed(costs: tuple) -> tuple:
    """Costs with up to two inserted turns first; more would come back to the same state."""
    return tuple(min(costs[q], INSERT + costs[NEXT[q]], 2 * INSERT + costs[NEXT[NEXT[q]]]) for q in range(4))


def _less(vector: tuple) -> tuple:
    low = min(vector)
    return tuple(v - low for v in vector)


_FAR = 1 << 20
END = _less(_closed((0, _FAR, _FAR, 0)))
#: What a chunk starts from when its successor's costs are not known yet.
GUESS = (0, 0, 0, 0)
_known: dict[tuple, tuple] = {}


def _ways(code: int, after, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a turn in a state: (edit, cost to the end, state after it), by edit."""
    role, more = code & 3, TRUNCATED if code >> 2 == CUT_SHORT else 0
    out = [("D", DELETE + after[state], state)]
    if code >> 2 != UNFIT:
        to = STEP[role][state]
        if to is not None:
            out.append(("K", more + after[to], to))
        out.append(("R", RETYPE + more + after[NEXT[state]], NEXT[state]))
    return out


def back(code: int, after: tuple) -> tuple[tuple, int]:
    """Costs before a turn from those after it, less their minimum, and that minimum; there are few different ones."""
    if (code, after) not in _known:
        costs = _closed(tuple(min(w[1] for w in _ways(code, after, q)) for q in range(4)))
        _known[code, after] = _less(costs), min(costs)
    return _known[code, after]


def sweep(codes: bytes, right: tuple, before: bytes | None = None) -> bytes:
    """Cost vectors at all turns and the end, four bytes each. With earlier vectors ``before``, stops at the first that agrees."""
    out = bytearray(before or bytes(4 * (len(codes) + 1)))
    v = right
    for i in range(len(codes), -1, -1):
        if i < len(codes):
            v = back(codes[i], v)[0]
        if before and out[4 * i:4 * i + 4] == bytes(v):
            break
        out[4 * i:4 * i + 4] = bytes(v)
    return bytes(out)


def trace(codes: bytes, vectors: bytes, state: int, last: bool) -> tuple[str, int, int, list[tuple[int, int]]]:
    """The ASCII-least of the cheapest edits from ``state``: audit, cost, state at the end, and what stands:
    (turn, or -1 for an inserted one; the state a retyped or inserted turn leads to, or -1)."""
    audit, paid, stands, at, n = [], 0, [], 0, len(codes)
    here = tuple(vectors[:4])
    while at < n or last and not (here[state] == 0 and state in (START, ASSISTANT)):
        choice = None
        if at < n:
            after = tuple(vectors[4 * at + 4:4 * at + 8])
            goal = here[state] + back(codes[at], after)[1]
            choice = next(((e, to) for e, cost, to in _ways(codes[at], after, state) if cost == goal), None)
        if choice is None or choice[0] > "I" and INSERT + here[NEXT[state]] == here[state]:
            choice = "I", NEXT[state]
        edit, to = choice
        audit.append(edit)
        paid += {"D": DELETE, "I": INSERT, "K": 0, "R": RETYPE}[edit] + (TRUNCATED if edit in "KR" and codes[at] >> 2 == CUT_SHORT else 0)
        if edit != "D":
            stands.append((-1 if edit == "I" else at, -1 if edit == "K" else to))
        state = to
        if edit != "I":
            at, here = at + 1, after
    return "".join(audit), paid, state, stands


def repaired(stands: list[tuple[int, int]], roles: list[str], texts: list[str]) -> str:
    """Turns after the edits, ``role:text`` joined by line breaks."""
    return "\n".join(f"{roles[i] if to < 0 else NAMES[to]}:{'' if i < 0 else texts[i]}" for i, to in stands)


# ---------------------------------------------------------------- chunks
_COUNTS = ["illegal", "blank", "duplicate", "truncated", "distinct"]
_CHUNK = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), ("codes", pa.binary()), *[(c, pa.int64()) for c in _COUNTS],
                    ("low", pa.int64()), ("high", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_CHUNK_DDL = "conv string, part int, seq int, whole boolean, codes binary, illegal long, blank long, duplicate long, truncated long, distinct long, low long, high long, cost long, audit string, sha string, roles array<string>, texts array<string>"
_PAIRS = {(0, 1), (1, 2), (2, 1)}


class _Chunk:
    def __init__(self, conv: str, seq: int):
        self.conv, self.seq, self.size = conv, seq, 0
        self.codes, self.roles, self.texts = bytearray(), [], []
        self.counts, self.low, self.high = dict.fromkeys(_COUNTS, 0), None, None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        code = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
        if self.codes and (self.codes[-1] & 3, code) not in _PAIRS:
            self.counts["illegal"] += 1
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.high:
            self.counts["distinct"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.codes.append(code + 4 * {"": FINE, "truncated": CUT_SHORT}.get(fault, UNFIT))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text) + 100

    def row(self, part: int, whole: bool) -> dict:
        out = {"conv": self.conv, "part": part, "seq": self.seq, "whole": whole, "codes": bytes(self.codes), **self.counts, "low": self.low, "high": self.high,
               "cost": None, "audit": None, "sha": None, "roles": None, "texts": None}
        if not whole:
            return out | {"roles": self.roles, "texts": self.texts}
        audit, paid, _, stands = trace(out["codes"], sweep(out["codes"], END), START, True)
        return out | {"codes": None, "cost": paid, "audit": audit, "sha": hashlib.sha256(repaired(stands, self.roles, self.texts).encode()).hexdigest()}


def _cutter(most: int):
    def cut(batches: Iterator[pa.RecordBatch]):
        """Sorted turns to chunks. Conversations that begin or end a partition may go on in another one."""
        part, chunk, first, seen = TaskContext.get().partitionId(), None, True, None
        out, size = [], 0
        for b in batches:
            for conv, turn, digest, role, text, fault, n, origin in zip(*(c.to_pylist() for c in b.columns)):
                if chunk is None or conv != chunk.conv:
                    if chunk is not None:
                        out.append(chunk.row(part, whole=not first and chunk.seq == 0))
                        size += chunk.size
                        first = False
                    chunk, seen = _Chunk(conv, 0), None
                elif len(chunk.codes) >= most or chunk.size >= CHUNK_BYTES:
                    out.append(chunk.row(part, False))
                    size += chunk.size
                    chunk = _Chunk(conv, chunk.seq + 1)
                if fault != "gone":
                    if fault != "blank" and n is not None and (turn != origin["turn"] or (turn, digest) == seen):
                        fault = "duplicate"
                    seen = turn, digest
                    chunk.add(turn, role, text, fault)
                if len(out) >= 1000 or size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(out, _CHUNK)
                    out, size = [], 0
        if chunk is not None:
            out.append(chunk.row(part, False))
        yield pa.RecordBatch.from_pylist(out, _CHUNK)
    return cut


# ---------------------------------------------------------------- passes over open chunks
_STATE = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("codes", pa.binary()), ("last", pa.bool_()), ("vectors", pa.binary()), ("changed", pa.bool_())])
_STATE_DDL = "conv string, part int, seq int, codes binary, last boolean, vectors binary, changed boolean"


def _speculate(batches):
    for b in batches:
        vectors = [sweep(c, END if last else GUESS) for c, last in zip(b["codes"].to_pylist(), b["last"].to_pylist())]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("conv", "part", "seq", "codes", "last")), pa.array(vectors, pa.binary()), pa.array([True] * b.num_rows)], schema=_STATE)


def _fix_up(batches):
    """Chunks rerun from what their successor arrived at; ``changed`` tells whether what they hand on is another vector."""
    for b in batches:
        vectors, changed = [], []
        for codes, old, right in zip(*(b[c].to_pylist() for c in ("codes", "vectors", "right"))):
            new = old if right is None or right == old[-4:] else sweep(codes, tuple(right), old)
            vectors.append(new)
            changed.append(new[:4] != old[:4])
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("conv", "part", "seq", "codes", "last")), pa.array(vectors, pa.binary()), pa.array(changed)], schema=_STATE)


def _exits(batches):
    for b in batches:
        found = [bytes(trace(c, v, q, last)[2] for q in range(4)) for c, v, last in zip(*(b[x].to_pylist() for x in ("codes", "vectors", "last")))]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("conv", "part", "seq", "codes", "last", "vectors")), pa.array(found, pa.binary())], names=["conv", "part", "seq", "codes", "last", "vectors", "exits"])


def _chained(batches):
    """Per conversation: chunks in order with the state each is entered in."""
    for b in batches:
        out = []
        for chunks in b["chunks"].to_pylist():
            state, entries = START, []
            for c in chunks:
                entries.append({"part": c["part"], "seq": c["seq"], "entry": state})
                state = c["exits"][state]
            out.append(entries)
        yield pa.RecordBatch.from_arrays([b["conv"], pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int32()), ("entry", pa.int32())])))], names=["conv", "chunks"])


_PIECE = pa.schema([f for f in _CHUNK if f.name not in ("whole", "sha", "roles", "texts")] + [pa.field("text", pa.string())])


def _edited(batches):
    for b in batches:
        rows = []
        for r in b.to_pylist():
            audit, paid, _, stands = trace(r["codes"], r["vectors"], r["entry"], r["last"])
            rows.append({f.name: r.get(f.name) for f in _PIECE} | {"cost": paid, "audit": audit, "text": repaired(stands, r["roles"], r["texts"]) if stands else None})
        yield pa.RecordBatch.from_pylist(rows, _PIECE)


_RESULT = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in (*_COUNTS, "low", "high", "cost")], ("audit", pa.string()), ("sha", pa.string())])
_RESULT_DDL = "conv string, illegal long, blank long, duplicate long, truncated long, distinct long, low long, high long, cost long, audit string, sha string"


def _assembled(batches):
    """Pieces of a conversation in order to its row; what two pieces share at their border is settled here."""
    out, row, digest, audit, edge = [], None, None, [], None

    def close():
        out.append(row | {"audit": "".join(audit), "sha": digest.hexdigest()})

    for b in batches:
        for r in b.to_pylist():
            if row is None or r["conv"] != row["conv"]:
                if row is not None:
                    close()
                row = {f.name: 0 for f in _RESULT} | {"conv": r["conv"], "low": None, "high": None}
                digest, audit, edge, begun = hashlib.sha256(), [], None, False
            for c in (*_COUNTS, "cost"):
                row[c] += r[c]
            if r["codes"]:
                row["illegal"] += edge is not None and (edge, r["codes"][0] & 3) not in _PAIRS
                edge = r["codes"][-1] & 3
            if r["low"] is not None:
                row["distinct"] -= row["high"] == r["low"]
                row["low"], row["high"] = r["low"] if row["low"] is None else row["low"], r["high"]
            if r["text"] is not None:
                digest.update((("\n" if begun else "") + r["text"]).encode())
                begun = True
            audit.append(r["audit"])
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, _RESULT)
                out.clear()
    if row is not None:
        close()
    yield pa.RecordBatch.from_pylist(out, _RESULT)


def repair(turns: DataFrame, scratch: Scratch, chunk: int = CHUNK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each conversation of ``damage(…)`` or ``plain(…)``: faults, cost, audit, digest of the repaired turns."""
    rows = _faulted(turns, scratch, broadcast_rows)
    order = ["conv", F.col("turn").asc_nulls_first(), "digest"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "digest", "role", "text", "fault", "n", "first")
    cut = scratch.write(placed.mapInArrow(_cutter(chunk), _CHUNK_DDL), "chunks")
    opened = cut.where("not whole")
    key = ["conv", "part", "seq"]
    line = Window.partitionBy("conv").orderBy("part", "seq")
    state = opened.select(*key, "codes").withColumn("last", F.lead("seq").over(line).isNull())
    state = scratch.write(state.mapInArrow(_speculate, _STATE_DDL), "pass-0")
    k = 0
    while not state.where("changed").isEmpty():
        k += 1
        told = state.withColumn("right", F.when(~F.col("last"), F.substring(F.lead("vectors").over(line), 1, 4)))
        state = scratch.write(told.mapInArrow(_fix_up, _STATE_DDL), f"pass-{k}")
    left = scratch.write(state.mapInArrow(_exits, "conv string, part int, seq int, codes binary, last boolean, vectors binary, exits binary"), "exits")
    chained = left.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "exits"))).alias("chunks")).mapInArrow(_chained, "conv string, chunks array<struct<part:int,seq:int,entry:int>>")
    entries = chained.select("conv", F.inline("chunks"))
    whole = opened.drop("cost", "audit", "sha", "codes").join(left.drop("exits"), key).join(entries, key)
    ddl = "conv string, part int, seq int, codes binary, illegal long, blank long, duplicate long, truncated long, distinct long, low long, high long, cost long, audit string, text string"
    pieces = whole.mapInArrow(_edited, ddl)
    joined = pieces.repartition("conv").sortWithinPartitions(*key).mapInArrow(_assembled, _RESULT_DDL)
    every = cut.where("whole").select(*[f.name for f in _RESULT]).union(joined.select(*[f.name for f in _RESULT]))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0))
    return every.select(F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id"), gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
