import json

from pyspark.sql import functions as F

from marrow.sources import sinks

SCHEMA = "query_id long, place int, path string, heading_trail array<string>, start_line int, end_line int, score float, snippet string"
EVERY = "".join(map(chr, range(1, 128))) + "é日 \x7f\U0001f600"
ROWS = [
    (1, 2, 'a"b.md', ["Community Garden", EVERY], 1, 2, 0.5, EVERY),
    (1, 1, "\\n.md", [], 3, 30, 0.0163934, "one\ntwo"),
    (2, 1, "x", [""], 1, 1, 1234.5678912, ""),
    (3, 1, "y", ["\\"], 1, 1, 1e-7, "\\\\"),
]


def test_columns_are_what_the_driver_writes(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    by_query = {q: [r for r in df.where(F.col("query_id") == q).orderBy("place").collect()] for q in (1, 2, 3)}
    got = sinks.gathered(df).select("query_id", sinks.json_line(F.col("results")).alias("line"), sinks.text_block(F.col("results")).alias("block")).collect()
    assert {r["query_id"]: r["line"] + "\n" for r in got} == {q: sinks.result_json(rows) for q, rows in by_query.items()}
    assert {r["query_id"]: r["block"] for r in got} == {q: sinks.result_text(rows) for q, rows in by_query.items()}
    sinks.write_json(df, f"{tmp_path}/out")
    sinks.write_json(df, f"{tmp_path}/out")  # again: the same
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect())
    assert lines == sorted(sinks.result_json(rows)[:-1] for rows in by_query.values())
    assert json.loads(next(x for x in lines if "Garden" in x))["results"][1]["snippet"] == EVERY


def test_no_results(spark):
    df = spark.createDataFrame([([],)], "results array<struct<path: string, heading_trail: array<string>, start_line: int, end_line: int, score: float, snippet: string>>")
    assert df.select(sinks.json_line(F.col("results")), sinks.text_block(F.col("results"))).first() == ('{"results":[]}', "(no results)\n")
