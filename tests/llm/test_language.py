"""Language identification: held-out accuracy, Viterbi against plain Python, spans of mixed texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import language
from corpuscle.llm.queries import QUERIES

from . import helpers as h


def slow_viterbi(scores, penalty):
    best, back = list(scores[0]), []
    for row in scores[1:]:
        arg = int(np.argmax(best))
        came = [k if best[k] >= best[arg] - penalty else arg for k in range(len(row))]
        best = [max(best[k], best[arg] - penalty) + row[k] for k in range(len(row))]
        back.append(came)
    label = [int(np.argmax(best))]
    for came in reversed(back):
        label.append(came[label[-1]])
    return label[::-1]


def test_viterbi():
    r = np.random.default_rng(2)
    lengths = [0, 1, 7, 0, 40, 3, 40, 0]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = r.normal(0, 3, (first[-1], 4))
    scores[r.random(scores.shape) < 0.1] = -np.inf
    scores[:, 2] = np.where(np.isinf(scores).all(axis=1), 0, scores[:, 2])
    got = language.viterbi(scores, first, 4.0)
    for a, b in zip(first[:-1], first[1:]):
        if a < b:
            assert got[a:b].tolist() == slow_viterbi(scores[a:b], 4.0)


def test_words_break_at_scripts_and_texts():
    w = language.read(["Ab cd", "", "привет мир mixedслово", "1 2 3"], 16)
    assert w.first.tolist() == [0, 2, 2, 6, 6]
    assert list(zip(w.start.tolist(), w.end.tolist())) == [(0, 2), (3, 5), (0, 6), (7, 10), (11, 16), (16, 21)]
    names = ["" if s == 0 else language.NAMES[s - 1] for s in w.script]
    assert names == ["Latin", "Latin", "Cyrillic", "Cyrillic", "Latin", "Cyrillic"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    alphabets = {"aa": "abcdefgh", "bb": "hgklmnop", "ru": "абвгдежз", "uk": "жзіїєбвг"}
    texts = {k: [" ".join("".join(r.choice(v) for _ in range(r.randint(3, 7))) for _ in range(40)) + "." for _ in range(60)] for k, v in alphabets.items()}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)]
    return texts, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op12_language_id"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id").toPandas()
    assert len(found) > 250 and (found.lang == found.lang_pred).mean() >= 0.98


def test_scripts_narrow_and_spans(spark, corpus):
    texts, docs = corpus
    model = language.learn(docs)
    latin, cyrillic = language.NAMES.index("Latin") + 1, language.NAMES.index("Cyrillic") + 1
    assert model.languages == ["aa", "bb", "ru", "uk"]
    assert model.allowed[latin].tolist() == [True, True, False, False] and model.allowed[cyrillic].tolist() == [False, False, True, True]
    mixed = texts["aa"][0] + " " + texts["bb"][1] + " " + texts["uk"][2]
    row = language.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    edges = [(0, len(texts["aa"][0]) - 1, "aa"), (len(texts["aa"][0]) + 1, len(texts["aa"][0] + texts["bb"][1]), "bb"), (len(mixed) - len(texts["uk"][2]), len(mixed) - 1, "uk")]
    assert [(s.start, s.end, s.lang) for s in row.spans] == edges and 0.3 < row.score < 0.5


def test_labels_and_ids_do_not_enter(spark, corpus):
    _, docs = corpus
    model = language.learn(docs)
    one = language.identify(docs, model, ["doc_id"]).selectExpr("row.doc_id", "lang_pred", "score").toPandas()
    other = language.identify(docs.selectExpr("doc_id + 5000 AS doc_id", "text", "'zz' AS lang"), model, ["doc_id"]).selectExpr("row.doc_id - 5000 AS doc_id", "lang_pred", "score").toPandas()
    assert one.sort_values("doc_id").values.tolist() == other.sort_values("doc_id").values.tolist()


def test_awkward(spark):
    rows = language.predict(h.awkward(spark).unionByName(h.awkward(spark).filter("doc_id = 6").withColumn("doc_id", F.lit(7).cast("long")))).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"} and {r["lang_pred"] for r in rows if r["doc_id"] == 6} == {"en"}
    assert language.predict(h.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(0, "some text", None)], "doc_id long, text string, lang string")
    assert language.predict(nothing).first()["lang_pred"] == "und"
    kept = language.identify(h.awkward(spark), language.learn(h.awkward(spark)))
    assert set(kept.select("row.*").columns) == set(h.awkward(spark).columns)


def test_reruns_and_partitions_agree(spark, corpus):
    _, docs = corpus
    a, b = language.learn(docs.repartition(1)), language.learn(docs.repartition(7))
    assert np.array_equal(a.logs, b.logs) and np.array_equal(a.allowed, b.allowed)
