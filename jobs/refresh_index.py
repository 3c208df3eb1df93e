"""Keep the lexical index of a growing corpus up to date: only files that no earlier run has taken are read.

    python -m jobs.refresh_index SOURCE OUT CHECKPOINT [--config FILE]

SOURCE is a folder or pattern of Parquet files of documents. A run takes the new ones as a file stream, `files_a_batch`
at a time, and ends. Every batch has its own folder in each table below OUT, overwritten if the batch is run again:

    postings/batch=N/folder=  id, dl (words), term, tf; a row without a term for every document
    documents/batch=N         id, dl, folder
    terms/batch=N             term, df: by how many documents the batch changes what the term has

A document that comes again replaces its earlier version: readers take the last batch of each id, and the batch takes the
earlier version's words out of `terms`. Of several versions in one batch the one of the newest file holds, then of the last
path, then the last text, then the last folder. A null or empty text is a document without words; rows without an id are left out and counted in the log.
An empty folder name counts as null. `open_index` gives what marrow.operators.bm25 searches.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marrow.functions.text import tokens
from marrow.operators import bm25, forward
from marrow.session import ship

log = logging.getLogger("jobs.refresh_index")

CONFIG = Path(__file__).with_suffix(".json")
SCHEMAS = {
    "documents": "id long, dl long, folder string, batch long",
    "postings": "id long, dl long, term string, tf long, folder string, batch long",
    "terms": "term string, df long, batch long",
}


def load(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table as all batches have left it; the types of partition columns are given, not guessed. Before the first batch it is empty."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{out}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def write(df: DataFrame, path: str, *parts: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*parts).parquet(path)


def versions(stream: DataFrame, config: dict) -> DataFrame:
    """(id, version, folder) of all rows of a stream of files; the version has the text, which is held once."""
    text, folder = F.coalesce(F.col(config["text"]), F.lit("")), F.nullif(F.col(config["folder"]), F.lit(""))
    version = F.struct("_metadata.file_modification_time", "_metadata.file_path", text.alias("text"))
    return stream.select(F.col(config["id"]).cast("long").alias("id"), version.alias("version"), folder.alias("folder"))


def take(rows: DataFrame, batch_id: int, out: str) -> int:
    """Write one batch; how many rows it had. Of the tables it reads earlier batches only, so that a second try gives the same.

    The files are read once: postings have a row without a term for every document, and the rest is made from them.
    """
    spark, seen = rows.sparkSession, Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id").isNull()).alias("bare"))
    newest = rows.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("version", "folder")).alias("row")).select("id", "row.version.text", "row.folder")
    # words are counted inside each text, so that no task holds the words of many
    counted = forward.build(newest, ("id", "folder"), tokens(F.col("text")))
    no_term = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))
    rows_of = counted.select("id", "dl", F.explode(F.array_append("terms", no_term)).alias("x"), "folder")
    write(rows_of.select("id", "dl", "x.term", "x.tf", "folder"), f"{out}/postings/batch={batch_id}", "folder")
    mine = load(spark, out, "postings").where(F.col("batch") == batch_id)
    write(mine.where("term IS NULL").select("id", "dl", "folder"), f"{out}/documents/batch={batch_id}")
    change = mine.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    documents = load(spark, out, "documents").select("id", "batch")
    earlier = documents.where(F.col("batch") < batch_id).groupBy("id").agg(F.max("batch").alias("batch"))
    old = earlier.join(documents.where(F.col("batch") == batch_id).select("id"), "id", "left_semi")
    batches = [r["batch"] for r in old.select("batch").distinct().collect()] if batch_id else []  # folders to read
    if batches:
        gone = load(spark, out, "postings").where(F.col("batch").isin(batches) & F.col("term").isNotNull()).join(old, ["id", "batch"])
        change = change.unionByName(gone.groupBy("term").agg((-F.count("*")).alias("df")))
    write(change.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), f"{out}/terms/batch={batch_id}")
    wrote = {name: load(spark, out, name).where(F.col("batch") == batch_id).count() for name in SCHEMAS}
    log.info("batch %d: read %d rows (%d without an id), with newer versions of documents of %d batches; wrote %s rows", batch_id, seen.get["rows"], seen.get["bare"], len(batches), wrote)
    return seen.get["rows"]


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Take what is new in source, wait for the end, and give the index: (id, folder, dl, term, tf, df) of all current documents."""
    ship(spark)
    stream = spark.readStream.schema(config["schema"]).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(source)
    taken: list[int] = []
    batches = versions(stream, config).writeStream.foreachBatch(lambda rows, n: taken.append(take(rows, n, out)))
    batches.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("read %d new rows of %s in %d batches; the index is in %s", sum(taken), source, len(taken), out)
    index = open_index(spark, out)
    return index.postings.join(index.terms, "term").select("id", "folder", "dl", "term", "tf", "df")


def open_index(spark: SparkSession, out: str) -> bm25.Postings:
    """The index as it stands: of each document the last version."""
    documents = load(spark, out, "documents")
    last = documents.groupBy("id").agg(F.max("batch").alias("batch"))
    doc_len = documents.join(last, ["id", "batch"]).select("id", "dl")
    postings = load(spark, out, "postings").where("term IS NOT NULL").join(last, ["id", "batch"]).select("id", "folder", "dl", "term", "tf")
    terms = load(spark, out, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return bm25.Postings(("id",), postings, doc_len, terms, bm25.corpus_stats(doc_len))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m jobs.refresh_index", description="Add new files of documents to a lexical index.")
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("checkpoint")
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("refresh_index").getOrCreate()
    try:
        run(spark, given.source, given.out, given.checkpoint, json.loads(Path(given.config).read_text(encoding="utf-8")))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
