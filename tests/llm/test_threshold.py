import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marrow.llm import threshold
from marrow.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, v string, id string, n int, row long, score double"


def brute(rows, limit, step=50):
    """(query_id, rank, vec_id, score) of rows (vec_id, vector)."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i is not None and i % step == 0}:
        others = list(good)
        others.remove((q, list(a)))
        met = [(sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in others if len(v) == len(a)]
        met.sort(key=lambda m: (-m[0], m[1] is None, m[1] or 0))
        out += [(q, k + 1, i, s) for k, (s, i) in enumerate(met[:limit])]
    return sorted(out, key=str)


def found(df, limit=5, **more):
    got = threshold.topk(df, F.col("vec_id") % 50 == 0, limit, **more)
    assert got.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:bigint>"
    return sorted((tuple(r) for r in got.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1, 2, 0.5) for i, v in rows], SCHEMA)


def cloud(rng, n, dim):
    mids = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, [m / 4 + rng.gauss(0, 0.1) for m in mids[i % 4]]) for i in range(n)]


@pytest.mark.parametrize(("lists", "limit"), [(1, 5), (2, 5), (5, 3), (20, 40)])
def test_against_all_pairs(spark, monkeypatch, lists, limit):
    monkeypatch.setattr(threshold, "ROWS", 70)  # many cells
    monkeypatch.setattr(threshold, "ASKED", 2)
    monkeypatch.setattr(threshold, "BLOCK", 16)
    monkeypatch.setattr(threshold, "PAIRS", 100)
    rows = cloud(random.Random(lists), 300, 12)
    assert found(frame(spark, rows), limit, lists=lists) == brute(rows, limit)


def test_copies_ties_and_odd_rows(spark):
    rng = random.Random(5)
    rows = cloud(rng, 120, 6)
    rows += [(i, [0.25] * 6) for i in range(200, 330)]  # a third are copies, queries among them
    rows += [(i, [round(rng.random()) / 8 for _ in range(6)]) for i in range(400, 460)]  # ties of different vectors
    rows += [(500, None), (501, [None] * 6), (550, [float("nan")] + [1.0] * 5), (600, [float("inf")] * 6), (-50, [0.5] * 6)]
    rows += [(None, [3.0] * 6), (None, [0.25] * 6), (650, [3.0] * 6), (650, [3.0] * 6), (650, [2.0] * 6), (700, []), (701, []), (750, [0.5] * 3), (751, [1.0] * 3), (800, [9.0])]
    rng.shuffle(rows)
    assert found(frame(spark, rows)) == brute(rows, 5)
    assert found(frame(spark, rows), 1) == brute(rows, 1)


def test_great_numbers(spark):
    rows = [(50 * i, [(-1) ** i * 10.0 ** (3 * i), 1.0, 0.5, 2.0**i]) for i in range(3)]
    assert found(frame(spark, rows)) == brute(rows, 5)
    far = frame(spark, [(0, [3e38, 1.0]), (50, [-3e38, 2.0])])  # counts as the greatest
    assert [(q, v, abs(s)) for q, _, v, s in found(far)] == [(0, 50, abs(found(far)[0][3])), (50, 0, abs(found(far)[0][3]))]


def test_an_empty_table(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, [1.0])])) == []
    assert found(frame(spark, [(50, [1.0])])) == []


def test_the_cutoff_leaves_most_rows_where_they_are(spark, tmp_path, monkeypatch):
    rows = cloud(random.Random(1), 2000, 32)
    counts = []
    kept = threshold.settled

    def counting(df, name):
        out = kept(df, name)
        counts.append((name, out.count()))
        return out

    monkeypatch.setattr(threshold, "settled", counting)
    assert found(frame(spark, rows)) == brute(rows, 5)
    assert dict(counts)["topk-entries"] < 0.5 * 2 * 40 * 2000


def test_the_query_against_its_sql(spark, tmp_path):
    import duckdb

    rows = cloud(random.Random(3), 400, 8) + [(700, None), (None, [0.1] * 8), (750, [0.5] * 8), (751, [0.5] * 8), (750, [0.5] * 8), (750, [0.25] * 8)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_topk"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(ORACLES["op12_topk"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
