import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marrow.operators import dense

SCHEMA = "vec_id long, name string, v array<float>, query_id int, c0 int"


def brute(rows, queries, limit):
    out = []
    for q, a in queries:
        if a is None:
            continue
        met = [(round(sum(float(np.float32(x)) * float(np.float32(y)) for x, y in zip(a, v, strict=True)), 5), i, n) for i, n, v in rows if v is not None and len(v) == len(a)]
        met.sort(key=lambda m: (-m[0], m[1], m[2]))
        out += [(q, i, n, s, k) for k, (s, i, n) in enumerate(met[:limit])]
    return sorted(out)


def vectors(rng, n, dim, scale):
    return [(i // 2, f"n{i % 2}", [rng.gauss(0, 1) * scale(i) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("limit", [1, 10, 1000])
def test_all_rows_as_queries(spark, monkeypatch, limit):
    for name, value in (("CELL_ROWS", 60), ("CELL_QUERIES", 40), ("PACK", 16), ("BLOCK_ROWS", 20), ("STEP", 7)):
        monkeypatch.setattr(dense, name, value)
    rng = random.Random(limit)
    rows = vectors(rng, 200, 8, lambda i: rng.choice([0.1, 1, 10]))
    rows += [(500 + i, "copy", [0.5] * 8) for i in range(90)] + [(900, "null", None), (901, "short", [1.0]), (902, "empty", []), (903, "zero", [0.0] * 8)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    queries = [(k, v) for k, (_, _, v) in enumerate(rows)]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = dense.block_topk(df, asked, limit, ("vec_id", "name"), "v")
    assert got.columns == ["query_id", "vec_id", "name", "score", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, queries, limit)


def test_many_queries_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(dense, "MAX_QUERY_FLOATS", 10)
    rows = vectors(random.Random(1), 50, 4, lambda i: 1)
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    queries = [(k, v) for k, (_, _, v) in enumerate(rows)]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = dense.topk(df, asked, 3, ("vec_id", "name"), "v")
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, queries, 3)


def test_short_vectors_are_left_out_unread():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(5000, 16)) * np.exp(rng.normal(size=5000) * 2)[:, None]
    q = rng.normal(size=(20, 16))
    of, row, score, blocks = dense.foremost(v, np.arange(5000), q, 5)
    assert blocks < 5
    whole = np.round(q @ v.T, dense.DIGITS)
    want = np.argsort(-whole, axis=1, kind="stable")[:, :5]
    assert (row.reshape(20, 5) == want).all()
    assert (score.reshape(20, 5) == np.take_along_axis(whole, want, 1)).all()
    assert (of == np.repeat(np.arange(20), 5)).all()


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", [1.0], 0, 0), (2, "b", None, 0, 0)], SCHEMA)
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("v").alias("embedding"))
    assert dense.block_topk(df.limit(0), asked, 3, ("vec_id",), "v").count() == 0
    assert dense.block_topk(df, asked.limit(0), 3, ("vec_id",), "v").count() == 0
    assert [tuple(r) for r in dense.block_topk(df, asked, 3, ("vec_id",), "v").collect()] == [(1, 1, 1.0, 0)]


def test_the_query_with_all_vectors_against_sql(spark):
    import duckdb

    from marrow.plans import catalog

    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    sql = catalog.dense_sql("SELECT vec_id AS query_id, embedding AS q FROM embeddings", 10)
    want = con.sql(f"WITH {sql} SELECT query_id, vec_id, score, rank FROM dense").fetchall()
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = dense.block_topk(df, df.select(F.col("vec_id").alias("query_id"), "embedding"), 10, ("vec_id",))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_sent_queries_meet_bounded_blocks(spark, monkeypatch):
    for name, value in (("HELD_FLOATS", 300), ("BLOCK_ROWS", 20), ("STEP", 7)):
        monkeypatch.setattr(dense, name, value)
    rng = random.Random(4)
    rows = vectors(rng, 200, 8, lambda i: rng.choice([0.1, 1, 10]))
    rows += [(500 + i, "copy", [0.5] * 8) for i in range(90)] + [(900, "null", None), (901, "short", [1.0]), (902, "empty", []), (903, "zero", [0.0] * 8)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    queries = [(k, v) for k, (_, _, v) in enumerate(rows)]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    for limit in (1, 10, 1000):
        got = dense.topk(df, asked, limit, ("vec_id", "name"), "v")
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, queries, limit)


def test_memory_of_sent_queries_does_not_grow_with_them(spark, tmp_path):
    """4,000 queries against a batch of 10,000 rows: one matrix of all their scores would be 320 MB, and several were made of it."""
    made = "transform(sequence(1, 16), k -> cast(pmod(xxhash64(id, k), 1000) / 1000 as float))"
    df = spark.range(0, 10_000, 1, 1).selectExpr("id AS vec_id", f"{made} AS v")
    asked = spark.range(4_000).selectExpr("id AS query_id", f"{made} AS embedding")
    real = dense.foremost

    def told(*args):
        import resource

        out = real(*args)
        with open(f"{tmp_path}/peak", "a") as f:
            f.write(f"{resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024}\n")
        return out

    dense.foremost = told
    try:
        assert dense.topk(df, asked, 3, ("vec_id",), "v").count() == 12_000
    finally:
        dense.foremost = real
    peaks = [int(x) for x in open(f"{tmp_path}/peak")]
    assert peaks[-1] - peaks[0] < 100


def test_scores_that_are_no_numbers(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 2)
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [-inf, 1.0]), (5, [2.0, 0.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    for how in (dense.topk, dense.block_topk):
        got = [(r["vec_id"], str(r["score"])) for r in how(df, asked, 6, ("vec_id",), "v").orderBy("rank").collect()]
        assert got == [(2, "nan"), (6, "nan"), (3, "inf"), (5, "2.0"), (1, "1.0"), (4, "-inf")]
