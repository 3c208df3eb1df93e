import random

import pytest
from pyspark.sql import functions as F

from marrow.operators import bm25, forward

SCHEMA = "doc_id long, part int, text string, terms string, dl int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(rng.choice([3, 90]))}" for _ in range(rng.choice([0, 1, 8, 70]))) for _ in range(120)]
    return spark.createDataFrame([(i // 2, i % 2, t, "x", 1) for i, t in enumerate([*texts, None, "", "É w1 w1"])], SCHEMA)


def test_the_index_has_all_postings(spark, docs, monkeypatch):
    monkeypatch.setattr(forward, "SLICE_WORDS", 100)
    index = forward.build(docs, ("doc_id", "part"), bm25.plain(F.col("text")))
    assert index.count() == docs.count()
    rows = index.select("doc_id", "part", "dl", F.explode("terms").alias("t")).select("doc_id", "part", "dl", "t.term", "t.tf")
    assert rows_of(rows) == rows_of(bm25.term_counts(docs, ("doc_id", "part"), bm25.plain(F.col("text"))))


@pytest.mark.parametrize("most", [0, 10**6])
def test_scores_are_those_of_a_search(spark, docs, monkeypatch, most):
    monkeypatch.setattr(forward, "MAX_BROADCAST_PAIRS", most)
    key = ("doc_id", "part")
    plain = bm25.build(docs, key, bm25.plain(F.col("text")))
    index = forward.build(docs, key, bm25.plain(F.col("text")))
    queries = spark.createDataFrame([(1, "w1 w2 w1"), (2, "nowhere"), (3, ""), (4, None), (5, "É w80")], "query_id long, query string")
    every = queries.select("query_id").crossJoin(docs.select(*key))
    got = forward.score(index, key, plain.terms, plain.stats, queries, every)
    assert got.count() == 5 * docs.count()
    assert rows_of(got.where("score > 0").drop("parts")) == rows_of(bm25.search(plain, queries, 1000).select("query_id", *key, "score"))
    for r in got.collect():
        assert abs(sum(p["part"] for p in r["parts"]) - r["score"]) < 1e-6
        assert [p["part"] for p in r["parts"]] == sorted((p["part"] for p in r["parts"]), reverse=True)


def test_pairs_that_are_not_there_or_repeat(spark, docs):
    key = ("doc_id", "part")
    plain = bm25.build(docs, key, bm25.plain(F.col("text")))
    index = forward.build(docs, key, bm25.plain(F.col("text")))
    queries = spark.createDataFrame([(1, "w1")], "query_id long, query string")
    pairs = spark.createDataFrame([(1, 61, 0), (1, 61, 0), (9, 61, 0), (1, 999, 0), (None, 1, 0), (1, None, 0)], "query_id long, doc_id long, part int")
    got = forward.score(index, key, plain.terms, plain.stats, queries, pairs).collect()
    assert [(r["query_id"], r["doc_id"], r["part"], [(p["term"], p["tf"]) for p in r["parts"]]) for r in got] == [(1, 61, 0, [("w1", 2)])] * 2
    assert forward.score(index, key, plain.terms, plain.stats, queries, pairs.limit(0)).count() == 0
