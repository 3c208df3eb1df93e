"""The jobs as registered queries: each runs twice into one new folder, the second time with nothing new."""

from __future__ import annotations

import json
import uuid
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import answers, refresh_index
from marrow.plans.catalog import COUNTS, bm25_sql
from marrow.session import shared_dir


def config(job: ModuleType) -> dict:
    return json.loads(job.CONFIG.read_text(encoding="utf-8"))


def job1_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    source = f"{sf_dir}/documents.parquet*"  # a pattern: the table may be one file or a folder of files
    for _ in range(2):
        found = refresh_index.run(spark, source, f"{base}/index", f"{base}/checkpoint", config(refresh_index))
    return found


def job2_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        found = answers.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", base, config(answers))
    return found.withColumn("score", F.round(F.col("score").cast("double"), 9))


QUERIES = {f.__name__: f for f in (job1_refresh_index, job2_answers)}

_NAMED = "strpos(question, '#' || lang)"
ORACLES = {
    "job1_refresh_index": f"""
WITH {COUNTS} SELECT doc_id AS id, nullif(source, '') AS folder, dl, term, tf, df
FROM tf JOIN lengths USING (doc_id) JOIN df USING (term) JOIN documents USING (doc_id) WHERE doc_id IS NOT NULL
""".strip(),
    "job2_answers": f"""
WITH {bm25_sql("SELECT item_id AS query_id, text AS query FROM benchmark WHERE text IS NOT NULL", 100)},
hits AS (
    SELECT query_id AS question_id, b.text AS question, d.doc_id AS id, nullif(source, '') AS folder, coalesce(lang, '') AS lang, trim(coalesce(d.text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS b, rank
    FROM sparse JOIN documents d USING (doc_id) JOIN benchmark b ON query_id = item_id
), boosted AS (
    SELECT *, ((1::FLOAT / (60 + rank)::FLOAT)::FLOAT * (CASE WHEN question = folder THEN 1.5 WHEN lang <> '' AND (question = '#' || lang OR ({_NAMED} > 0
        AND NOT regexp_full_match(substr(question, {_NAMED} - 1, CASE WHEN {_NAMED} > 1 THEN 1 ELSE 0 END), '[A-Za-z0-9]')
        AND NOT regexp_full_match(substr(question, {_NAMED} + 1 + len(lang), 1), '[A-Za-z0-9_/-]'))) THEN 1.25 ELSE 1 END)::FLOAT)::FLOAT AS score FROM hits
), halved AS (
    SELECT *, (score * power(0.5, row_number() OVER (PARTITION BY question_id, folder ORDER BY score DESC, id) - 1)::FLOAT)::FLOAT AS adjusted FROM boosted
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY adjusted DESC, folder NULLS FIRST, id)::INTEGER AS place FROM halved
)
SELECT question_id, question, place, id, round(adjusted::DOUBLE, 9) AS score, folder,
       CASE WHEN strlen(b) <= 240 THEN b ELSE b[1 : list_max(list_filter(range(0, 241), lambda i: strlen(b[1:i]) <= 240))] END AS snippet
FROM placed WHERE place <= 10
""".strip(),
}
