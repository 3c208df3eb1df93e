"""Answer a table of saved questions over a corpus, for a report that is made again and again.

    python -m jobs.answers DOCUMENTS QUESTIONS OUT [--config FILE] [--label NAME]

Every question gets its `top_k` best documents: BM25 over whole texts, as deep as the fusion asks, from postings of the asked words, in blocks
that are written to OUT/index by every run; then reciprocal rank, then the boosts for a question that names the document's folder or one of its tags, then halving of further hits of a folder.
The report is OUT/run=LABEL, one folder of files for each folder of documents, and is written anew by every run of a label; other
labels stay. Questions that are null or have no word have no answers; questions of one id are answered one by one.
Null texts have no words but count as documents. An empty folder name counts as null.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions.text import snippet
from marrow.operators import blockmax, fuse
from marrow.session import ship

log = logging.getLogger("jobs.answers")

CONFIG = Path(__file__).with_suffix(".json")
ANSWERS = "question_id long, question string, place int, id long, score float, snippet string, folder string"


#: Rows of hits that may be broadcast to the scan of the documents, some 50 bytes each.
MAX_BROADCAST_ROWS = 400_000


def answers(documents: DataFrame, questions: DataFrame, config: dict, settle: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(question_id, question, place, id, score, snippet, folder). settle: writes a table and reads it back."""
    tags = F.array_compact(F.array(*[F.col(c).cast("string") for c in config["tags"]]))
    folder = F.nullif(F.col(config["folder"]), F.lit(""))
    docs = documents.select(F.col(config["id"]).cast("long").alias("id"), F.col(config["text"]).alias("text"), folder.alias("folder"), tags.alias("tags"))
    asked = questions.select(F.col(config["question_id"]).cast("long").alias("question_id"), F.col(config["question"]).alias("question"))
    asked = asked.where("question IS NOT NULL").distinct().withColumn("query_id", F.md5(F.to_json(F.struct("question_id", "question"))))
    depth = fuse.over_fetch(sys.maxsize, config["top_k"])
    queries = asked.select("query_id", F.col("question").alias("query"))
    hits = blockmax.search_texts(docs.select("id", "text"), ("id",), F.col("text"), queries, depth, settle).select("query_id", "id", "rank")
    # the texts stay where they are read: of those that are hit the snippet goes on
    rows = docs.join(F.broadcast(hits) if asked.count() * depth <= MAX_BROADCAST_ROWS else hits, "id")
    rows = rows.select("query_id", "id", "rank", "folder", "tags", snippet(F.col("text"), config["snippet_bytes"]).alias("snippet")).join(asked, "query_id")
    nothing = F.lit(None).cast("string")
    factor = fuse.boost(F.col("question"), F.coalesce("folder", F.lit("")), nothing, nothing, F.array().cast("array<string>"), F.col("tags"))
    rows = rows.withColumn("score", fuse.boosted(fuse.reciprocal(F.col("rank")), factor))
    best = fuse.saturate(rows, "folder", ("id",), config["top_k"])
    return best.select("question_id", "question", "place", "id", "score", "snippet", "folder")


def run(spark: SparkSession, documents: str, questions: str, out: str, config: dict, label: str | None = None) -> DataFrame:
    """Write the report of a label and give all that is in it."""
    ship(spark)
    folder = f"{out}/run={label or config['label']}"
    docs, asked = spark.read.parquet(documents), spark.read.parquet(questions)

    def settle(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/index/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/index/{name}")

    answers(docs, asked, config, settle).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("folder").parquet(folder)
    wrote = spark.read.schema(ANSWERS).parquet(folder)
    log.info("read %d documents of %s and %d questions of %s", docs.count(), documents, asked.count(), questions)
    log.info("wrote %d answers to %s", wrote.count(), folder)
    return wrote


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m jobs.answers", description="Answer a table of saved questions.")
    parser.add_argument("documents")
    parser.add_argument("questions")
    parser.add_argument("out")
    parser.add_argument("--config", default=str(CONFIG))
    parser.add_argument("--label")
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("answers").getOrCreate()
    try:
        run(spark, given.documents, given.questions, given.out, json.loads(Path(given.config).read_text(encoding="utf-8")), given.label)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
