import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marrow.functions import text as X
from marrow.operators import bm25, dense, fuse


def index(spark, docs):
    return bm25.build(spark.createDataFrame(docs, "k int, text string"), ("k",), bm25.plain(F.col("text")))


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")


def test_tokens(spark):
    rows = spark.createDataFrame([("École_Été camelCase-x 日本 42",), ("",), (None,)], "t string").select(X.tokens(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["École", "Été", "camelcase", "x", "日本", "42"], [], []]


def test_bm25_ranks_and_repeats(spark):
    docs = [(0, "the quick brown fox"), (1, "lazy dog sleeps"), (2, "quick fox jumps"), (3, ""), (4, None)]
    one = {r["k"]: r["score"] for r in bm25.search(index(spark, docs), ask(spark, "fox"), 10).collect()}
    two = {r["k"]: r["score"] for r in bm25.search(index(spark, docs), ask(spark, "fox fox"), 10).collect()}
    assert set(one) == {0, 2}
    assert all(math.isclose(two[k], 2 * one[k], abs_tol=2e-6) for k in one)
    best = bm25.search(index(spark, docs), ask(spark, "quick fox", "nothing", None, ""), 1).collect()
    assert [(r["query_id"], r["k"], r["rank"]) for r in best] == [(0, 2, 0)]


def test_bm25_against_the_formula(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    words = [d[1].split() for d in docs]
    mean, df = sum(map(len, words)) / len(docs), Counter(t for w in words for t in set(w))
    score = lambda q, w: sum(math.log((60 - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in q.split() if t in w)
    want = sorted(((-round(score("a b b", w), 6), k) for k, w in enumerate(words)))
    got = [(-r["score"], r["k"]) for r in sorted(bm25.search(index(spark, docs), ask(spark, "a b b"), 20).collect(), key=lambda r: r["rank"])]
    assert got == [w for w in want if w[0] < 0][:20]


def test_texts_without_an_index_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(80, None), (81, "")]
    asked = ask(spark, "a b b", "zz", None, "h", "")
    want = sorted(map(tuple, bm25.search(index(spark, docs), asked, 20).collect()))
    df = spark.createDataFrame(docs, "k int, text string")
    assert want
    for most in (bm25.MAX_BROADCAST_TERMS, 0):
        monkeypatch.setattr(bm25, "MAX_BROADCAST_TERMS", most)
        assert sorted(map(tuple, bm25.search_texts(df, ("k",), F.col("text"), asked, 20).collect())) == want
    assert bm25.search_texts(df.limit(0), ("k",), F.col("text"), asked, 20).count() == 0


def test_texts_are_scanned_and_exchanged_once(spark):
    df = spark.range(50).selectExpr("id AS k", "concat('a b ', id) AS text")
    found = bm25.search_texts(df, ("k",), F.col("text"), ask(spark, "a 7"), 5)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2


def test_idf_of_one_in_two(spark):
    assert spark.range(1).select(bm25.idf(F.lit(2), F.lit(1))).first()[0] == pytest.approx(math.log(2))


def test_empty_corpus(spark):
    assert bm25.search(index(spark, []), ask(spark, "a"), 5).count() == 0
    assert index(spark, []).stats.first()["avgdl"] == 0


def test_field_weights_equal_repeated_text(spark):
    fields = {"body": "a b", "parent_folder": "p", "heading_trail": ["H", "I"], "name": "n a", "title": None, "h1": "h", "aliases": ["x y", "z"], "tags": ["t", "t"]}
    df = spark.createDataFrame([tuple(fields.values())], "body string, parent_folder string, heading_trail array<string>, name string, title string, h1 string, aliases array<string>, tags array<string>")
    got = {r["term"]: r["tf"] for r in bm25.term_counts(df.withColumn("k", F.lit(1)), ("k",), X.weighted_tokens(X.sparse_fields())).collect()}
    want = Counter("a b p".split() + ["h", "i"] * 2 + ["n", "a"] * 3 + ["h"] * 3 + ["x", "y", "z"] * 3 + ["t"] * 6)
    assert got == want


def test_dense_topk(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(50)] + [(90, rows_ := [1.0] * 8), (91, rows_), (92, None)]
    vectors = spark.createDataFrame(rows, "k int, embedding array<float>")
    got = dense.topk(vectors, spark.createDataFrame([(7, [1.0] * 8)], "query_id bigint, embedding array<float>"), 5, ("k",)).orderBy("rank").collect()
    want = sorted(((-round(sum(v), 5), k) for k, v in rows if v))[:5]
    assert [r["k"] for r in got] == [k for _, k in want]
    assert dense.topk(vectors.limit(0), vectors.limit(0).select(F.col("k").cast("long").alias("query_id"), "embedding"), 5, ("k",)).count() == 0


def test_boosts(spark):
    rows = [("Garden", 1.5), ("#gardening", 1.25), ("tomatoes", 1.0), ("garden", 1.0), ("see #gardening now", 1.25), ("x#gardening", 1.0), ("#gardening-x #gardening", 1.0), ("Plot", 1.5), ("Title", 1.5), ("#a.b", 1.25), ("#axb", 1.0)]
    df = spark.createDataFrame(rows, "q string, want double")
    factor = fuse.boost(F.col("q"), F.lit("Garden"), F.lit("Title"), F.lit(None).cast("string"), F.array(F.lit("Plot")), F.array(F.lit("gardening"), F.lit("a.b")))
    assert df.where(factor.cast("double") != F.col("want")).count() == 0


def test_rrf(spark):
    leg = lambda rows: spark.createDataFrame(rows, "query_id int, k int, rank int")
    got = {r["k"]: r["score"] for r in fuse.rrf(fuse.union(leg([(0, 1, 0), (0, 2, 1)]), leg([(0, 1, 4)]), ("k",))).collect()}
    assert got[1] == pytest.approx(1 / 60 + 1 / 64)
    assert got[2] == pytest.approx(1 / 61)


def test_saturation_is_the_greedy_choice(spark):
    rng = random.Random(9)
    rows = [(q, rng.choice("abcd"), k, float(rng.choice([1, 2, 3, 4, 6, 8]))) for q in range(40) for k in range(rng.randint(1, 15))]
    got = {}
    for r in fuse.saturate(spark.createDataFrame(rows, "query_id int, note string, k int, score float"), "note", ("k",), 6).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["note"], r["k"], r["score"]))
    for q in range(40):
        left, hits, want = [r[1:] for r in rows if r[0] == q], Counter(), []
        while left and len(want) < 6:
            best = min(left, key=lambda r: (-r[2] * 0.5 ** hits[r[0]], r[0], r[1]))
            want.append((best[0], best[1], best[2] * 0.5 ** hits[best[0]]))
            hits[best[0]] += 1
            left.remove(best)
        assert got[q] == want


def test_snippets(spark):
    df = spark.createDataFrame([("abc😀def", 5, "abc"), ("abc😀def", 4, "abc"), (" \t x \n", 5, "x"), (None, 5, ""), ("éé", 3, "é"), ("日本", 6, "日本")], "t string, n int, want string")
    for r in df.collect():
        assert df.sparkSession.createDataFrame([(r["t"],)], "t string").select(X.snippet(F.col("t"), r["n"])).first()[0] == r["want"]


def test_dense_text_skips_empty_parts(spark):
    df = spark.createDataFrame([("n", None, ["", "a"], "h", ["A", "B"], "body")], "name string, title string, aliases array<string>, h1 string, trail array<string>, body string")
    assert df.select(X.dense_text(*(F.col(c) for c in df.columns))).first()[0] == "n a h A > B body"


def test_words_are_counted_inside_each_text(spark):
    """No exchange and no table of all words in a task: what a task holds does not grow with its texts."""
    df = spark.range(300).selectExpr("id AS k", "if(id = 7, null, concat('a b a ', id % 5, ' c')) AS text")
    for words in (bm25.plain(F.col("text")), X.tokens(F.col("text"))):
        found = bm25.term_counts(df, ("k",), words)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "HashAggregate" not in plan
        got = sorted(map(tuple, found.collect()))
        assert got == sorted((k, 5, t, n) for k in range(300) if k != 7 for t, n in (("a", 2), ("b", 1), ("c", 1), (str(k % 5), 1)))


def test_texts_without_an_index_are_met_in_segments(spark, monkeypatch, tmp_path):
    from marrow.operators import blockmax

    monkeypatch.setattr(blockmax, "SEGMENT", 40)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, None if i % 50 == 9 else " ".join(rng.choices(vocabulary, range(1, 31), k=rng.randrange(40)))) for i in range(400)] + [(None, "w1 w29")]
    df = spark.createDataFrame(rows, "k int, text string")
    asked = spark.createDataFrame([(1, "w29 w3 w29"), (2, "W0 none"), (3, None), (4, "none"), (None, "w1 w1 w2")], "query_id long, query string")
    made = iter(range(100))

    def settle(df, name):
        df.write.parquet(path := f"{tmp_path}/{name}-{next(made)}")
        return df.sparkSession.read.schema(df.schema).parquet(path)

    want = sorted(map(str, bm25.search(bm25.build(df, ("k",), bm25.plain(F.col("text"))), asked, 20).collect()))
    assert len(want) > 40
    for most in (bm25.MAX_BROADCAST_TERMS, 0):
        monkeypatch.setattr(bm25, "MAX_BROADCAST_TERMS", most)
        got = blockmax.search_texts(df, ("k",), F.col("text"), asked, 20, settle)
        assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
        assert sorted(map(str, got.collect())) == want
    assert blockmax.search_texts(df.limit(0), ("k",), F.col("text"), asked, 20, settle).count() == 0
