import json
import logging

import duckdb
import pytest

from jobs import queries, refresh_index
from marrow.operators import bm25

SCHEMA = "doc_id long, text string, source string, extra int"
CONFIG = {"schema": "doc_id long, text string, source string", "id": "doc_id", "text": "text", "folder": "source", "files_a_batch": 1}
FIRST = [(1, "the cat sat", "a", 0), (2, "the dog", "a", 0), (3, None, "b", 0), (4, "", "", 0), (None, "no id", "a", 0), (5, "cat cat cat", None, 0)]
SECOND = [(2, "a bird sings", "c", 0), (6, "the cat", "2024", 0), (3, "words now", "b", 0)]
THIRD = [(2, None, "c", 0), (1, "the cat sat", "a", 0)]


@pytest.fixture
def paths(tmp_path):
    return [f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint")]


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def whole(spark, *parts):
    """What a single index of the last version of each document has."""
    last = {r[0]: r for part in parts for r in part if r[0] is not None}
    docs = spark.createDataFrame([(i, t, s or None) for i, t, s, _ in last.values()], "id long, text string, folder string")
    return bm25.build(docs, ("id", "folder"), bm25.plain(docs["text"]))


def test_growing_input_is_taken_once(spark, paths, caplog):
    caplog.set_level(logging.INFO)
    source, out, checkpoint = paths
    parts = []
    for new in (FIRST, SECOND, THIRD):
        parts.append(new)
        arrive(spark, source, new)
        caplog.clear()
        got = refresh_index.run(spark, source, out, checkpoint, CONFIG)
        assert f"read {len(new)} rows" in caplog.text  # only what is new
        want = whole(spark, *parts)
        assert rows_of(got) == rows_of(want.postings.join(want.terms, "term").select("id", "folder", "dl", "term", "tf", "df"))
        index = refresh_index.open_index(spark, out)
        assert rows_of(index.stats) == rows_of(want.stats)
        asked = spark.createDataFrame([(1, "the cat"), (2, "bird sings now")], "query_id long, query string")
        assert rows_of(bm25.search(index, asked, 3).select("query_id", "id", "score", "rank")) == rows_of(bm25.search(want, asked, 3).select("query_id", "id", "score", "rank"))
        caplog.clear()
        assert rows_of(refresh_index.run(spark, source, out, checkpoint, CONFIG)) == rows_of(got)  # nothing new
        assert "read 0 new rows" in caplog.text


def test_a_batch_that_is_run_again_leaves_the_same(spark, paths):
    source, out, checkpoint = paths
    for new in (FIRST, SECOND):
        arrive(spark, source, new)
        refresh_index.run(spark, source, out, checkpoint, CONFIG)
    before = {name: rows_of(refresh_index.load(spark, out, name)) for name in refresh_index.SCHEMAS}
    again = spark.createDataFrame([(i, (0, t or ""), t, s or None) for i, t, s, _ in SECOND], "id long, version struct<a: int, text: string>, text string, folder string")
    assert refresh_index.take(again, 1, out) == len(SECOND)
    assert {name: rows_of(refresh_index.load(spark, out, name)) for name in refresh_index.SCHEMAS} == before


def test_versions_in_one_batch(spark, paths):
    import os

    source, out, checkpoint = paths
    for i, text in enumerate(["old words", "newer words", "newest of all"]):
        arrive(spark, f"{source}/{2 - i}", [(1, text, "a", 0), (2, "same", "a", 0)])
        for d, _, names in os.walk(f"{source[7:]}/{2 - i}"):
            for n in names:
                os.utime(f"{d}/{n}", (1_000_000_000 + i, 1_000_000_000 + i))
    got = refresh_index.run(spark, f"{source}/*", out, checkpoint, CONFIG | {"files_a_batch": 100})
    assert rows_of(got) == [(1, "a", 3, t, 1, 1) for t in ("all", "newest", "of")] + [(2, "a", 1, "same", 1, 1)]


def test_an_empty_source(spark, paths):
    source, out, checkpoint = paths
    arrive(spark, source, [])
    got = refresh_index.run(spark, source, out, checkpoint, CONFIG)
    assert rows_of(got) == []
    assert refresh_index.open_index(spark, out).stats.first()["doc_count"] == 0


def test_the_command(spark, paths, monkeypatch, tmp_path):
    source, out, checkpoint = paths
    arrive(spark, source, FIRST)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)  # the tests' session
    (tmp_path / "config.json").write_text(json.dumps(CONFIG))
    refresh_index.main([source, out, checkpoint, "--config", str(tmp_path / "config.json")])
    assert refresh_index.load(spark, out, "documents").count() == 5
    assert queries.config(refresh_index)["files_a_batch"] > 0


@pytest.mark.parametrize("parts", [1, 3])
def test_the_query_against_its_sql(spark, tmp_path, parts):
    rows = [(i, f"w{i % 7} w{i % 3} and the", f"src{i % 3}" if i % 5 else "", i) for i in range(60)] + [(100, None, None, 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["job1_refresh_index"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["job1_refresh_index"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_two_runs_over_a_growing_copy_of_the_documents(spark, tmp_path, caplog):
    """Half of the given documents, then the other half: the index is that of all of them, and the second run reads the second half only."""
    caplog.set_level(logging.INFO)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    config = queries.config(refresh_index)
    for part in (0, 1):
        half = docs.where(f"doc_id % 2 = {part}")
        half.repartition(3).write.mode("append").parquet(source)
        caplog.clear()
        got = refresh_index.run(spark, source, out, checkpoint, config)
        assert f"read {half.count()} new rows" in caplog.text
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(queries.ORACLES["job1_refresh_index"])
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert {r["batch"] for r in refresh_index.load(spark, out, "documents").select("batch").distinct().collect()} == {0, 1}


def test_batches_of_few_files(spark, tmp_path):
    """As many files at a time as the config says; a run that takes several batches gives the same index."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs.repartition(5).write.parquet(f"{tmp_path}/in")
    found = []
    for files in (1, 100):
        out = f"file://{tmp_path}/out{files}"
        got = refresh_index.run(spark, f"file://{tmp_path}/in", out, f"file://{tmp_path}/checkpoint{files}", queries.config(refresh_index) | {"files_a_batch": files})
        found.append((rows_of(got), refresh_index.load(spark, out, "documents").select("batch").distinct().count()))
    assert found[0][0] == found[1][0]
    assert [n for _, n in found] == [5, 1]
