"""Reciprocal rank fusion, boosts and per-note saturation, for many queries at once.

Sums are of single precision, as ranks are compared on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions.text import explicit_tag

RRF_K = 60
TITLE_BOOST, TAG_BOOST = 1.5, 1.25
DECAY = 0.5


def over_fetch(chunks: int, top_k: int) -> int:
    """How many each leg sends to the fusion."""
    return min(chunks, max(50, 10 * top_k))


def reciprocal(rank: Column) -> Column:
    """1 / (60 + rank), single precision; 0 for an absent leg."""
    return F.coalesce((F.lit(1).cast("float") / (rank + RRF_K).cast("float")).cast("float"), F.lit(0).cast("float"))


def union(dense: DataFrame, sparse: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(query_id, key, dense_rank, sparse_rank) of all that either leg has."""
    on = ["query_id", *key]
    return dense.select(*on, F.col("rank").alias("dense_rank")).join(sparse.select(*on, F.col("rank").alias("sparse_rank")), on, "full_outer")


def rrf(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("score", (reciprocal(F.col("dense_rank")) + reciprocal(F.col("sparse_rank"))).cast("float"))


def boost(query: Column, name: Column, title: Column, h1: Column, aliases: Column, tags: Column) -> Column:
    """1.5 if the query is one of the note's names, else 1.25 if it names a tag, else 1. Exact, case and blanks count."""
    exact = (query == name) | query.eqNullSafe(title) | query.eqNullSafe(h1) | F.coalesce(F.array_contains(aliases, query), F.lit(False))
    return F.when(exact, TITLE_BOOST).when(explicit_tag(query, tags), TAG_BOOST).otherwise(1.0).cast("float")


def boosted(score: Column, factor: Column) -> Column:
    return (score * factor).cast("float")


def saturate(candidates: DataFrame, note: str, order: tuple[str, ...], top_k: Column | int) -> DataFrame:
    """The top_k of each query after halving the score of every further hit of a note.

    All candidates of a note carry the same factor at any time, so picking greedily is a merge of
    sorted lists: the n-th pick of a note is its n-th best. Needs scores above 0.
    """
    within = Window.partitionBy("query_id", note).orderBy(F.desc("score"), *order)
    df = candidates.withColumn("n", F.row_number().over(within) - 1)
    df = df.withColumn("score", (F.col("score") * F.pow(F.lit(DECAY), F.col("n")).cast("float")).cast("float")).drop("n")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), note, *order)
    return df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top_k)
