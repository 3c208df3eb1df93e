import json
import logging
import uuid

import duckdb
import pytest

from jobs import answers, queries

DOCS = "doc_id long, text string, lang string, source string, extra int"
ITEMS = "item_id long, text string, other string"
CONFIG = {"label": "saved", "id": "doc_id", "text": "text", "folder": "source", "tags": ["lang"], "question_id": "item_id", "question": "text", "top_k": 3, "snippet_bytes": 20}


@pytest.fixture
def tables(spark, tmp_path):
    docs = [(i, f"{'retion ' * (i % 9)}the words of text {i} é", ["en", "fr", None][i % 3], [f"src{i % 4}", "", None][0 if i % 6 else i % 4 // 2 + 1], 1) for i in range(80)]
    docs += [(100, None, "en", "src1", 1), (101, "  ", None, None, 1)]
    items = [(1, "the retion", "x"), (2, "retion #fr", "x"), (3, "#en", "x"), (4, "src2", "x"), (5, "x#fr retion", "x"), (6, "nothing here", "x"), (7, "", "x"), (8, None, "x"), (9, "words #fr-de", "x")]
    for name, rows, schema in (("documents", docs, DOCS), ("benchmark", items, ITEMS)):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture
def settle(tmp_path):
    def run(df, name):
        path = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return run


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_query_against_its_sql(spark, tables):
    got = queries.QUERIES["job2_answers"](spark, tables)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["job2_answers"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_a_label_is_written_anew_and_others_stay(spark, tables, caplog):
    caplog.set_level(logging.INFO)
    out = f"{tables}/out"
    args = (spark, f"{tables}/documents.parquet", f"{tables}/benchmark.parquet", out, CONFIG)
    first = rows_of(answers.run(*args))
    assert rows_of(answers.run(*args)) == first
    assert "read 82 documents" in caplog.text
    assert f"wrote {len(first)} answers" in caplog.text
    spark.createDataFrame([(1, "text", "x")], ITEMS).write.parquet(f"{tables}/one.parquet")
    few = answers.run(spark, f"{tables}/documents.parquet", f"{tables}/one.parquet", out, CONFIG, "other")
    assert {r["question_id"] for r in few.collect()} == {1}
    assert rows_of(spark.read.schema(answers.ANSWERS).parquet(f"{out}/run=saved")) == first
    again = answers.run(spark, f"{tables}/documents.parquet", f"{tables}/one.parquet", out, CONFIG)  # fewer folders than before
    assert rows_of(again) == rows_of(few)


def test_both_joins_give_the_same(spark, tables, monkeypatch, settle):
    docs, asked = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "benchmark"))
    small = rows_of(answers.answers(docs, asked, CONFIG, settle))
    monkeypatch.setattr(answers, "MAX_BROADCAST_ROWS", 0)
    assert rows_of(answers.answers(docs, asked, CONFIG, settle)) == small
    assert max(len(r[5].encode()) for r in small) <= 20


def test_empty_tables(spark, tables, settle):
    docs, asked = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "benchmark"))
    assert rows_of(answers.answers(docs.limit(0), asked, CONFIG, settle)) == []
    assert rows_of(answers.answers(docs, asked.limit(0), CONFIG, settle)) == []


def test_the_command(spark, tables, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)  # the tests' session
    with open(f"{tables}/config.json", "w") as f:
        json.dump(CONFIG, f)
    answers.main([f"{tables}/documents.parquet", f"{tables}/benchmark.parquet", f"{tables}/out", "--config", f"{tables}/config.json", "--label", "mine"])
    assert spark.read.parquet(f"{tables}/out/run=mine").count() > 5


def test_only_asked_words_are_indexed(spark, tables, settle):
    docs, asked = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "benchmark"))
    written = []

    def keep(df, name):
        written.append(settle(df, name))
        return written[-1]

    assert rows_of(answers.answers(docs, asked, CONFIG, keep))
    terms = {r["term"] for t in written if "tfs" in t.columns for r in t.select("term").collect()}
    assert {"the", "retion"} <= terms and not {"of", "text"} & terms
