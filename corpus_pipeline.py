"""A training corpus from the table documents, in five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes it as Parquet in the
shared folder and reads it again for the next. All but the last return the columns of documents.
Columns are handled by place, so that further ones may have any names. Nulls, empty tables and
repeated rows: as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.llm import bpe, decontaminate, jaccard, langid, quality
from marrow.llm.common import fold, settled, table
from marrow.session import ship


def placed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns k0, k1 and so on, and which of them have the names that the stages use."""
    names = docs.columns
    return docs.toDF(*[f"k{i}" for i in range(len(names))]), {c: f"k{names.index(c)}" for c in ("doc_id", "text", "lang")}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those near no learned language: further from all than labelled texts of their length are from what the others teach."""
    ship(spark)
    df, at = placed(docs)
    halves = [df.where(fold(at["text"], 2) == k) for k in (0, 1)]  # by text, so that no copy of a text is in the other half
    profiles = [langid.learn(x, at["text"], at["lang"]) for x in halves]
    least = langid.cutoffs(*zip(halves, reversed(profiles), strict=True), text_col=at["text"], lang_col=at["lang"])
    rest = tuple(c for c in df.columns if c != at["doc_id"])
    found = langid.predict(df, langid.added(*profiles), at["doc_id"], at["text"], keep=rest, size_col="size")
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= F.get(F.array(*map(F.lit, least)), langid.length_of(F.col("size")))))
    return kept.select(*df.columns).toDF(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the certified thresholds reject."""
    df, at = placed(docs)
    return quality.accept(df, table(spark, sf_dir, "labels"), at["doc_id"], at["text"], at["lang"]).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component: five words and a similarity of 0.8 within a pipeline."""
    ship(spark)
    df, at = placed(docs)
    return jaccard.representatives(df, at["doc_id"], at["text"], size=5, percent=80).toDF(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that hold a window of a benchmark item."""
    ship(spark)
    df, at = placed(docs)
    rest = tuple(c for c in df.columns if c != at["doc_id"])
    found = decontaminate.scan(df, table(spark, sf_dir, "benchmark"), at["doc_id"], at["text"], keep=rest)
    return found.where("n_hit = 0").select(*df.columns).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the length of the text that the ids decode to."""
    ship(spark)
    df, at = placed(docs)
    coded = bpe.encode(df, None, at["doc_id"], at["text"], decoded="decoded")
    return coded.select(F.col(at["doc_id"]).alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.char_length("decoded").cast("long").alias("n_chars"))


STAGES = [("language", language), ("quality", rules), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("bpe", tokens)]

#: BPE has no SQL; tests/llm compares the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
