"""The registered text queries against their SQL, and the pipeline stage by stage."""

import re

import duckdb
import pytest

import corpus_pipeline
from corpuscle.llm.queries import ORACLES, QUERIES

from . import helpers as h

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    columns = sorted(df.columns)
    return sorted(str(tuple(None if v != v else v for v in r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


ON_DOCUMENTS = sorted(set(QUERIES) - set(ORACLES) - {"op13_embedding_whitening"})


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_others_return_every_document(spark, name):
    assert QUERIES[name](spark, FOLDER).count() == 200


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        steps.append(docs.toPandas())
    source, ruled, unique, clean, mixed, sharded = steps
    kept = QUERIES["op8_quality_rules"](spark, FOLDER).filter("kept").toPandas()
    assert sorted(ruled.doc_id) == sorted(kept.doc_id)
    near = h.near_components(list(zip(ruled.doc_id, ruled.text)))
    assert sorted(unique.doc_id) == sorted(set(near))
    items = list(spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").toPandas().itertuples(index=False, name=None))
    grams = set()
    for _, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        grams.update(tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9)))
    def hit(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t))
        return any(tuple(w[i:i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
    assert sorted(clean.doc_id) == sorted(i for i, t in zip(unique.doc_id, unique.text) if not hit(t))
    words = clean.text.map(lambda t: len(h.WORD.findall(t)))
    assert set(mixed.doc_id) <= set(clean.doc_id) and mixed.doc_id.value_counts().max() <= 2
    assert abs(mixed.text.map(lambda t: len(h.WORD.findall(t))).sum() - 1.5 * words.sum()) <= words.max() * clean.source.nunique()
    assert sorted(sharded.doc_id) == sorted(mixed.doc_id) and sharded.groupby("doc_id").shard.nunique().max() == 1
    for step in steps[:-1]:
        assert list(step.columns) == list(source.columns)
