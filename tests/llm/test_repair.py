"""Conversation repair against a plain search over all edits, and over block borders."""

import hashlib
import heapq
import random

import duckdb

from corpuscle.llm import repair
from corpuscle.llm.queries import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """Least cost and ASCII-least audit for rows (initial, must go, truncated), Inserts allowed anywhere."""
    def edges(i, s):
        if i < len(rows):
            c, gone, cut = rows[i]
            yield "D", 3, i + 1, s
            if not gone:
                if c in STEP[s]:
                    yield "K", int(cut), i + 1, c
                for t in set("ua") & set(STEP[s]):
                    yield "R", 2 + int(cut), i + 1, t
        for t in set("ua") & set(STEP[s]):
            yield "I", 2, i, t

    most = 3 * len(rows)
    done, queue = {}, [(0, "", 0, "")]
    while queue:
        cost, audit, i, s = heapq.heappop(queue)
        if (i, s) in done or cost > most:
            continue
        done[i, s] = cost, audit
        for letter, c, j, t in edges(i, s):
            heapq.heappush(queue, (cost + c, audit + letter, j, t))
    return min(done[k] for k in ((len(rows), ""), (len(rows), "a")) if k in done)


def plain(rows):
    """The report of one conversation, from its rows (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    seen, marks, counts = set(), [], dict.fromkeys(["blank", "duplicate", "truncated"], 0)
    for _, _, r, x in rows:
        end = x.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((r, x))
        if fault:
            counts[fault] += 1
        marks.append((r[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = cheapest(marks)
    out, last, at = [], "", 0
    for e in audit:
        if e == "K":
            last = marks[at][0]
            out.append(f"{rows[at][2]}:{rows[at][3]}")
        elif e != "D":
            last = "a" if last == "u" else "u"
            out.append({"u": "user", "a": "assistant"}[last] + ":" + (rows[at][3] if e == "R" else ""))
        at += e != "I"
    turns = [t for known, t, _, _ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def compare(spark, rows, size=repair.BLOCK):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in repair.report(repair.prepared(frame), size).collect()}
    groups = {}
    for c, *rest in rows:
        groups.setdefault(c, []).append(rest)
    assert got == {c: plain(g) for c, g in groups.items()}


def drawn(random, conv, n):
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", "Zoë said so.", "two\nlines", None]
    roles = ["user", "assistant", "user", "assistant", "system", "unknown", "tool", "", None]
    return [(conv, random.choice([None, *range(n)]), random.choice(roles), random.choice(texts) if random.random() < 0.5 else f"text {random.randint(0, 3 * n)}.") for _ in range(n)]


def test_search_against_all_edits():
    r = random.Random(7)
    for _ in range(1500):
        rows = [(r.choice(["u", "a", "s", "u", "a", "x", ""]), r.random() < 0.15, r.random() < 0.3) for _ in range(r.randint(0, 9))]
        search = [(None, False, 1) if gone else (c, cut, 1) for c, gone, cut in rows]
        assert repair.Searcher(search).cheapest(repair.START, repair.DONE) == cheapest([(c, gone, cut and not gone) for c, gone, cut in rows])


def test_conversations(spark):
    r = random.Random(11)
    compare(spark, [row for c in range(60) for row in drawn(r, c, r.randint(1, 9))] + [row for row in drawn(r, None, 7)])


def test_long_conversations_in_blocks(spark):
    r = random.Random(12)
    rows = [row for c, n in ((1, 150), (2, 40), (3, 3)) for row in drawn(r, c, n)]
    for size in (4, 16):
        compare(spark, rows, size)


def test_copies_stay_one_row(spark):
    rows = [(1, 0, "user", "Hello there.")] * 5000 + [(1, 1, "assistant", "Hello.")] + [(2, None, "user", "")] * 300
    compare(spark, rows)


def test_repaired_rows_give_the_digest(spark):
    r = random.Random(13)
    rows = [row for c in range(10) for row in drawn(r, c, 12)]
    frame = repair.prepared(spark.createDataFrame(rows, SCHEMA))
    turns = repair.repaired(frame, 5).orderBy("conv", "part", "seq", "number").toPandas()
    digests = {r["conv"]: r["repaired_sha256"] for r in repair.report(frame, 5).collect()}
    for conv, group in turns.groupby("conv"):
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in zip(group.role, group.text)).encode()).hexdigest() == digests[conv]
        initials = "".join(role[:1] for role in group.role).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)


def test_damage_and_sql_on_awkward_rows(spark):
    r = random.Random(14)
    rows = [row for c in range(80) for row in drawn(r, c, r.randint(1, 6))] + [(None, t, "user", "Null conversation.") for t in range(5)]
    frame = spark.createDataFrame([(*row, "k", 1) for row in rows], SCHEMA + ", conv string, copies int")
    got = repair.report(repair.damaged(frame)).withColumnRenamed("conv", "conv_id")
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, SCHEMA).toArrow())
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op11_conversation_repair']})").fetchall()
    rows = [tuple(row) for row in got.collect()]
    assert len(rows) == 81 and sorted(map(str, rows)) == sorted(map(str, want))


def test_very_long_text_and_empty_table(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "end."), (1, 1, "assistant", "x" * 500_000), (1, 1, "assistant", "x" * 500_000)]
    compare(spark, rows)
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.damaged(none)).count() == 0 and repair.repaired(repair.prepared(none)).count() == 0
