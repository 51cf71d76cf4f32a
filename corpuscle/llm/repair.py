"""Repair of conversation structure by iterative-deepening A*.

Rows of a conversation are taken by turn (nulls first, then role, then text).  The cheapest edits (Keep 0, Rerole 2, Delete 3, Insert 2, and 1 for a truncated row that stays) that leave role
initials ``(s?(ua)+)?`` are searched depth-first, edits in ASCII order, under a bound on the cost that rises to the least cost found beyond it.  The table of failed states
keeps, for every (row, state of the grammar), a proven lower bound of the cost still to come; with it no state is searched twice under the same budget.  The first
accepting path under the first sufficient bound is the cheapest and, among the cheapest, the ASCII-least.

Scale.  Equal rows of a turn are one row with a number of copies before anything is sorted.  Rows are dealt by ranges of (conversation, turn, beginnings of role and text), so a conversation of any length
spreads over tasks, and are cut into blocks of at most ``BLOCK`` rows.  A block inside a long conversation is searched for every state before and after it; audits of a block are
prefix-free (inserted turns belong to the row behind them), hence the least audit is the concatenation of least audits.  Two passes over the small table of block costs, last block to first and first to last,
choose the states in between; both hold one block at a time.  Only the digest of a conversation has to read its blocks one after another.

Edge cases: null role or text is one space, a null turn sorts first and counts in no gap, a null conversation is a conversation of its own; an empty role has no initial and must be reroled
or deleted; without rows everything is 0 or empty; extra columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..scratch import materialize
from .frames import col

BLOCK = 64
START, SYSTEM, USER, ASSISTANT, DONE = range(5)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
WANTED = ["u", "u", "a", "u"]                       # what Rerole and Insert give in each state
NAMES = {"u": "user", "a": "assistant"}
AT_END = [0, 2 * INSERT, INSERT, 0]                 # cost of the inserts that complete a conversation
_NEVER = 1 << 60
_SPACES = " \t\n\x0b\x0c\r"


class Searcher:
    """Search over one block: rows (initial, truncated, copies), initial None for rows that must go."""

    def __init__(self, rows: list[tuple[str | None, bool, int]]):
        self.rows, n = rows, len(rows)
        self.rest, self.bad, self.head, self.last = [0] * (n + 1), [0] * (n + 1), [None] * (n + 1), ""
        for i in range(n - 1, -1, -1):
            c, cut, copies = rows[i]
            if c is None:
                self.rest[i], self.bad[i], self.head[i] = self.rest[i + 1] + DELETE * copies, self.bad[i + 1], self.head[i + 1]
            else:
                after = self.head[i + 1]
                self.last = self.last if after is not None else c
                self.rest[i], self.head[i] = self.rest[i + 1] + TRUNCATED * cut, c
                self.bad[i] = self.bad[i + 1] + (after is not None and c + after not in ("su", "ua", "au"))
        self.proven: list[dict[tuple[int, int], int]] = [{} for _ in range(5)]

    def least(self, i: int, state: int, goal: int) -> int:
        """A lower bound: forced deletions, truncated rows, and 1 for every adjacent pair out of order (an edit of cost c mends at most c of those)."""
        head = self.head[i]
        if head is None:
            return self.rest[i] + (AT_END[state] if goal == DONE else 0 if state == goal else _NEVER)
        return self.rest[i] + self.bad[i] + (head not in NEXT[state]) + (goal == DONE and self.last != "a")

    def _try(self, i: int, state: int, goal: int, left: int) -> list[str] | None:
        """Edits from here at a cost of at most ``left``; None, and a larger proven bound in the table, if there are none."""
        table = self.proven[goal]
        bound = max(self.least(i, state, goal), table.get((i, state), 0))
        if bound > left:
            table[i, state] = bound
            return None
        if i == len(self.rows):
            return ["I" * (AT_END[state] // INSERT if goal == DONE else 0)]
        c, cut, copies = self.rows[i]
        beyond = _NEVER
        for letters, cost, after in self._edits(c, cut, copies, state):
            rest = self._try(i + 1, after, goal, left - cost)
            if rest is not None:
                rest.append(letters)
                return rest
            beyond = min(beyond, cost + table[i + 1, after])
        table[i, state] = max(bound, beyond)
        return None

    @staticmethod
    def _edits(c: str | None, cut: bool, copies: int, state: int) -> Iterator[tuple[str, int, int]]:
        """What can be done with the next row, in ASCII order.  An Insert stands directly before a row that stays: before a deleted one it is never ASCII-least, two in a row never cheapest."""
        yield "D" * copies, DELETE * copies, state
        if c is None:
            return
        for letters, cost, before in (("I", INSERT, NEXT[state][WANTED[state]]), ("", 0, state)):
            if c in NEXT[before]:
                yield letters + "K", cost + KEEP + TRUNCATED * cut, NEXT[before][c]
            if c != WANTED[before]:
                yield letters + "R", cost + REROLE + TRUNCATED * cut, NEXT[before][WANTED[before]]

    def cheapest(self, state: int, goal: int) -> tuple[int, str] | None:
        """Cost and edits from ``state`` before the block to ``goal`` behind it (DONE: complete), None if there is no way."""
        bound = self.least(0, state, goal)
        while bound < _NEVER:
            found = self._try(0, state, goal, bound)
            if found is not None:
                return bound, "".join(reversed(found))
            bound = self.proven[goal][0, state]
        return None


def _turns(rows: list[dict], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of a block; the rows are as in the table of blocks."""
    edits = iter(audit)
    for r in rows:
        for _ in range(r["copies"]):
            for e in edits:
                if e == "I":
                    yield NAMES[WANTED[state]], ""
                    state = NEXT[state][WANTED[state]]
                    continue
                if e == "K":
                    yield r["role"], r["text"]
                    state = NEXT[state][r["role"][:1]]
                elif e == "R":
                    yield NAMES[WANTED[state]], r["text"]
                    state = NEXT[state][WANTED[state]]
                break
    for _ in edits:
        yield NAMES[WANTED[state]], ""
        state = NEXT[state][WANTED[state]]


_STATS = ["turns", "blank", "duplicate", "truncated", "illegal"]
_ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())])
_MOVE = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_BLOCKS = {"part": pa.int32(), "seq": pa.int64(), "opens": pa.bool_(), "closes": pa.bool_(), "rows": pa.list_(_ROW), "moves": pa.list_(_MOVE), "low": pa.int64(), "high": pa.int64(),
           "first_turn": pa.int64(), "last_turn": pa.int64(), "head": pa.string(), "tail": pa.string(), **{s: pa.int64() for s in _STATS}}
_BLOCKS_DDL = ("part int, seq long, opens boolean, closes boolean, rows array<struct<role:string,text:string,copies:long>>, "
               "moves array<struct<before:int,after:int,cost:long,audit:string>>, low long, high long, first_turn long, last_turn long, head string, tail string, "
               + ", ".join(f"{s} long" for s in _STATS))


def _block(rows: list[dict], part: int, seq: int, opens: bool, closes: bool) -> dict:
    """Summary of consecutive rows of a conversation and the cheapest edits between all states before and after them."""
    search, kept = [], []
    out = {"part": part, "seq": seq, "opens": opens, "closes": closes, "low": None, "high": None, "first_turn": None, "last_turn": None, "head": None, "tail": None, **dict.fromkeys(_STATS, 0)}
    for r in rows:
        copies = r["copies"]
        if not copies:
            continue                                # stands for a conversation whose rows are gone
        stripped, c, turn = r["text"].rstrip(_SPACES), r["role"][:1], r["turn"]
        blank, cut = not stripped, stripped[-1:] not in (".", "!", "?")
        fresh = not blank and not r["repeated"]
        out["blank"] += blank * copies
        out["duplicate"] += (not blank) * (copies - fresh)
        out["truncated"] += fresh and cut
        if fresh:
            search.append((c, cut, 1))
        if copies > fresh:
            search.append((None, False, copies - fresh))
        kept.append({"role": r["role"], "text": r["text"] if fresh else "", "copies": copies})
        out["illegal"] += copies - 1 + (out["tail"] is not None and out["tail"] + c not in ("su", "ua", "au"))
        out["tail"], out["head"] = c, c if out["head"] is None else out["head"]
        if turn is not None:
            out["turns"] += turn != out["last_turn"]
            out["low"] = out["first_turn"] = turn if out["low"] is None else out["low"]
            out["high"] = out["last_turn"] = turn
    searcher = Searcher(search)
    ends = [DONE] if closes else [*range(4), DONE]
    moves = [(x, y, searcher.cheapest(x, y)) for x in ([START] if opens else range(4)) for y in ends]
    return {**out, "rows": kept, "moves": [{"before": x, "after": y, "cost": m[0], "audit": m[1]} for x, y, m in moves if m]}


def _arrow(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()], list(kinds))


def _batched(rows: Iterator[dict], kinds: dict[str, pa.DataType], size: int = 256) -> Iterator[pa.RecordBatch]:
    waiting: list[dict] = []
    for r in rows:
        waiting.append(r)
        if len(waiting) == size:
            yield _arrow(waiting, kinds)
            waiting = []
    if waiting:
        yield _arrow(waiting, kinds)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from batch.slice(start, 256).to_pylist()


def _with_conv(frame: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([frame.schema["conv"], *T.StructType.fromDDL(ddl).fields])


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of the rows (conv, turn, role, text, weight): see ``_block``; written to the shared folder, since their numbers depend on how rows were dealt."""
    least = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least")
    single = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("weight").alias("copies")).withColumn("digest", F.md5(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text")))
    again = single.groupBy("conv", "digest").agg(least, F.count(F.lit(1)).alias("places")).filter("places > 1").select(F.col("conv").alias("conv2"), F.col("digest").alias("digest2"), "least")
    marked = single.join(again, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("digest") == F.col("digest2")), "left")
    marked = marked.select("conv", "turn", "role", "text", "copies",
                           (F.col("least").isNotNull() & ~F.col("least").eqNullSafe(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))).alias("repeated"))
    dealt = (marked.repartitionByRange("conv", "turn", F.substring("role", 1, 8), F.substring("text", 1, 16))
             .sortWithinPartitions("conv", "turn", "role", "text"))
    part = dealt.withColumn("part", F.spark_partition_id())

    def run(batches):
        def cut():
            held, conv, seq, opens, known = [], None, 0, False, False
            for r in _rows_of(batches):
                other = not known or r["conv"] != conv
                if held and (other or len(held) >= size):
                    yield {"conv": conv, **_block(held, held[0]["part"], seq, opens, other)}
                    held, seq, opens = [], seq + 1, False
                if other:
                    opens, conv, known = known, r["conv"], True
                held.append(r)
            if held:
                yield {"conv": conv, **_block(held, held[0]["part"], seq, opens, False)}
        return _batched(cut(), {"conv": kind, **_BLOCKS})

    kind = _arrow_kind(rows)
    return materialize(part.mapInArrow(run, _with_conv(rows, _BLOCKS_DDL)), "blocks")


def _arrow_kind(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv"].dataType)


def _groups(rows: Iterator[dict]) -> Iterator[tuple[bool, dict]]:
    """Rows with whether they are the first of their conversation."""
    conv, known = None, False
    for r in rows:
        yield not known or r["conv"] != conv, r
        conv, known = r["conv"], True


def _costs_behind(found: DataFrame) -> DataFrame:
    """Of every block of a conversation in several blocks: cost of all that follows, by state behind the block; empty for the last one."""
    slim = found.filter("NOT (opens AND closes)").select("conv", "part", "seq", F.transform("moves", lambda m: F.struct(m.before.alias("before"), m.after.alias("after"), m.cost.alias("cost"))).alias("moves"))
    slim = slim.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seq"))

    def run(batches):
        def walk():
            behind: list[int] = []
            for last, r in _groups(_rows_of(batches)):
                behind = [] if last else behind
                yield {"part": r["part"], "seq": r["seq"], "behind": behind}
                best = [_NEVER] * 4
                for m in r["moves"]:
                    if (m["after"] == DONE) == last:
                        best[m["before"]] = min(best[m["before"]], m["cost"] + (0 if last else behind[m["after"]]))
                behind = best
        return _batched(walk(), {"part": pa.int32(), "seq": pa.int64(), "behind": pa.list_(pa.int64())})

    return slim.mapInArrow(run, "part int, seq long, behind array<long>")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict, dict, int]]:
    """Blocks in order with the edits chosen for them: (first of its conversation, block, move, state before)."""
    state = START
    for first, r in _groups(_rows_of(batches)):
        state = START if first else state
        behind = r["behind"] or None
        moves = [m for m in r["moves"] if m["before"] == state and (m["after"] == DONE) == (behind is None)]
        move = min(moves, key=lambda m: (m["cost"] + (behind[m["after"]] if behind else 0), m["audit"]))
        yield first, r, move, state
        state = move["after"]


def _in_order(found: DataFrame) -> DataFrame:
    behind = _costs_behind(found).select(F.col("part").alias("p"), F.col("seq").alias("s"), "behind")
    joined = found.join(behind, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")), "left").drop("p", "s")
    return joined.repartition("conv").sortWithinPartitions("conv", "part", "seq")


def prepared(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", weight: Column | None = None) -> DataFrame:
    """Rows (conv, turn, role, text, weight) for the functions of this module; a weight of 0 keeps a conversation without its row."""
    weight = F.lit(1) if weight is None else weight
    rows = conversations.select(col(conv).alias("conv"), col(turn).cast("long").alias("turn"), F.coalesce(col(role), F.lit(" ")).alias("role"), F.coalesce(col(text), F.lit(" ")).alias("text"),
                                weight.cast("long").alias("weight"))
    gone = F.col("weight") == 0
    return rows.select("conv", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(F.col("text")).alias("text"), "weight")


def repaired(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """The repaired turns, from ``prepared`` rows: conv, part, seq and number within the block (together their order), role, text."""
    ordered, kind = _in_order(blocks(rows, size)), _arrow_kind(rows)

    def run(batches):
        def turns():
            for _, r, move, state in _decided(batches):
                for k, (role, text) in enumerate(_turns(r["rows"], move["audit"], state)):
                    yield {"conv": r["conv"], "part": r["part"], "seq": r["seq"], "number": k, "role": role, "text": text}
        return _batched(turns(), {"conv": kind, "part": pa.int32(), "seq": pa.int64(), "number": pa.int32(), "role": pa.string(), "text": pa.string()}, 1024)

    return ordered.mapInArrow(run, _with_conv(rows, "part int, seq long, number int, role string, text string"))


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per conversation, from ``prepared`` rows: conv, faults, cost of the cheapest repair, its edits, digest of what it gives."""
    ordered, kind = _in_order(blocks(rows, size)), _arrow_kind(rows)

    def run(batches):
        def whole():
            out: dict = {}
            for first, r, move, state in _decided(batches):
                if first:
                    if out:
                        yield finished(out)
                    out = {"conv": r["conv"], **dict.fromkeys([*_STATS, "cost"], 0), "low": None, "high": None, "last_turn": None, "tail": None, "edits": [], "digest": hashlib.sha256(), "any": False}
                for s in _STATS:
                    out[s] += r[s]
                if r["head"] is not None:
                    out["illegal"] += out["tail"] is not None and out["tail"] + r["head"] not in ("su", "ua", "au")
                    out["tail"] = r["tail"]
                if r["low"] is not None:
                    out["turns"] -= r["first_turn"] == out["last_turn"]
                    out["low"], out["high"], out["last_turn"] = r["low"] if out["low"] is None else out["low"], r["high"], r["last_turn"]
                out["cost"] += move["cost"]
                out["edits"].append(move["audit"])
                for role, text in _turns(r["rows"], move["audit"], state):
                    out["digest"].update((("\n" if out["any"] else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                    out["any"] = True
            if out:
                yield finished(out)

        def finished(out):
            gaps = out["high"] - out["low"] + 1 - out["turns"] if out["low"] is not None else 0
            return {**out, "gaps": gaps, "audit": "".join(out["edits"]), "repaired_sha256": out["digest"].hexdigest()}

        return _batched(whole(), {"conv": kind, **{s: pa.int64() for s in _REPORT}, "audit": pa.string(), "repaired_sha256": pa.string()})

    return ordered.mapInArrow(run, _with_conv(rows, ", ".join(f"{s} long" for s in _REPORT) + ", audit string, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``prepared`` rows of a conversations table after damage by crc32 of ``conv_id:turn``: 0 drops a row, 1 empties its text, 2 takes its stops, 3 repeats it, 4 makes it the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = (F.crc32(key.cast("binary")) % 20).alias("kind")
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                                F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("weight"))
    return prepared(rows, weight=F.col("weight"))
