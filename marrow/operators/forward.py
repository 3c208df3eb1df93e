"""Scores of given pairs of a query and a text, told term by term, from a forward index.

A row of the index is a text with its length and its terms, so that a pair needs that row alone: no postings are read for the
terms of the query. The index is made where the texts are read, without an exchange, and the pairs meet it by the texts' keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.operators import bm25
from marrow.operators.counts import SLICE_WORDS, per_text

#: Pairs that may be broadcast.
MAX_BROADCAST_PAIRS = 200_000


def build(docs: DataFrame, key: tuple[str, ...], words: Column) -> DataFrame:
    """(key, dl, terms array<struct<term, tf>>) of texts given as array<string> or array<struct<term, weight>>: a row each."""
    return per_text(docs, key, words, SLICE_WORDS)


def score(index: DataFrame, key: tuple[str, ...], terms: DataFrame, stats: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, key, score, parts array<struct<part, term, tf>>) of pairs (query_id, key), the greatest part first; 0 and no part where nothing is shared.

    Scores are those of bm25.search. Pairs of a query or text that is not there have no row; pairs that repeat have one each.
    """
    known = bm25.query_terms(queries).join(terms, "term").crossJoin(F.broadcast(stats))  # stats is one row
    weight = bm25.idf(F.col("doc_count"), F.col("df")) * F.col("times")
    weights = known.groupBy("query_id", "avgdl").agg(F.map_from_entries(F.collect_list(F.struct("term", weight.alias("weight")))).alias("weights"))  # a query's words
    asked = pairs.join(queries.select("query_id").distinct(), "query_id").join(weights, "query_id", "left")
    few = asked.limit(MAX_BROADCAST_PAIRS + 1).count() <= MAX_BROADCAST_PAIRS
    rows = index.join(F.broadcast(asked) if few else asked, list(key))

    def part(x: Column) -> Column:
        tf = x["tf"]
        held = F.col("weights")[x["term"]] * tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * F.col("dl") / F.col("avgdl")))
        return F.struct(held.alias("part"), x["term"].alias("term"), tf.alias("tf"))

    shared = F.transform(F.filter("terms", lambda x: F.map_contains_key("weights", x["term"])), part)
    parts = F.sort_array(F.coalesce(shared, F.array().cast("array<struct<part: double, term: string, tf: bigint>>")), asc=False)
    scored = rows.select("query_id", *key, parts.alias("parts"))
    return scored.withColumn("score", F.round(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]), 6)).select("query_id", *key, "score", "parts")
