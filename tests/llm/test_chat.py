"""Chat formatting: round trips of awkward texts."""

import random

from pyspark.sql import functions as F

from corpuscle.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = [*chat.CONTROL, "\\", "\\\\", "\\:", "\\n", "\n", "a", "é", " ", "<", "[", "<|im_", "end|>\n", "INST]"]


def test_round_trip(spark):
    r = random.Random(6)
    rows = []
    for c in range(300):
        for t in range(r.randint(1, 5)):
            rows.append((c, t, r.choice(["user", "assistant", "a\nb", "<s>", "x\\n"]), "".join(r.choice(PARTS) for _ in range(r.randint(0, 8)))))
    done = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    out = {x.conv_id: x for x in done.withColumn("loss", chat.masked(done.formatted, done.loss_spans)).collect()}
    for c in range(300):
        want = [(x[2], x[3]) for x in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert out[c].identical and [(t.role, t.text) for t in out[c].turns] == want
        assert out[c].loss == [t for role, t in want if role == "assistant"]
        body = out[c].formatted.replace(chat.BEGIN, "", len(want)).replace(chat.END, "", len(want))
        assert not any(x in body for x in chat.CONTROL)


def test_plain_text_stays(spark):
    rows = [(1, 0, "user", "hello \\ there"), (1, 1, "assistant", "hi")]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.formatted == "<|im_start|>user\nhello \\ there<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n" and got.escaped_turns == 0
    assert [got.formatted[s.start:s.end] for s in got.loss_spans] == ["hi"]


def test_grammar_decides(spark, monkeypatch):
    raw = ["<|im_start|>a\nb", "no turn", "<|im_start|>a", "<|im_start|>a\nb<s>", "<|im_start|>a\n<|im_start|>b"]
    turns = chat.parse(F.lit("".join(x + "<|im_end|>\n" for x in raw)))
    assert [t and (t.role, t.text) for t in spark.range(1).select(turns).first()[0]] == [("a", "b"), None, None, None, None]
    # a grammar that reads nothing back has everything escaped
    monkeypatch.setattr(chat, "parse", lambda formatted: F.array(F.struct(F.lit("-").alias("role"), F.lit("-").alias("text"))))
    got = chat.format_chats(spark.createDataFrame([(1, 0, "user", "a \\ b")], SCHEMA)).first()
    assert got.formatted == "<|im_start|>user\na \\\\ b<|im_end|>\n" and got.escaped_turns == 1 and not got.identical


def test_edges(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", None), (2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (2, 1, "user", "a"), (2, None, "user", "first")]
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {None: [("", ""), ("assistant", "")], 2: [("user", "first"), ("user", "a"), ("assistant", "b"), ("assistant", "b")]}
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
