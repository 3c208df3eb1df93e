"""Hybrid search: both legs, fusion, boosts and saturation as one plan, for a table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.functions.text import snippet
from marrow.operators import blockmax, dense, embed, fuse
from marrow.plans.index import KEY, Index


def search(index: Index, queries: DataFrame, top_k: int, embedder: embed.Embedder, settle: Callable = lambda df, name: df) -> DataFrame:
    """(query_id, place, path, chunk_seq, heading_trail, start_line, end_line, score, body) for queries (query_id, query).

    A null or empty query has no rows, nor has an index without chunks. settle: writes a small table and reads it back, so
    that the queries are not worked out again for each leg.
    """
    asked = settle(queries.where("query IS NOT NULL AND query <> ''"), "asked")
    limit = fuse.over_fetch(index.chunk_count, top_k)
    vectors = settle(embed.embed(asked, ("query_id",), F.col("query"), embedder), "asked-vectors")
    near = dense.topk(index.vectors, vectors, limit, KEY)
    found = fuse.rrf(fuse.union(near, blockmax.search(index.blocks, asked, limit, settle), KEY))
    # Candidates are at most twice the limit a query; chunks and notes are looked up for those alone.
    rows = index.chunks.join(F.broadcast(found) if limit <= 500 and asked.count() <= 1000 else found, list(KEY)).join(index.notes, "path").join(asked, "query_id")
    factor = fuse.boost(*(F.col(c) for c in ("query", "name", "title", "h1", "aliases", "tags")))
    rows = rows.withColumn("score", fuse.boosted(F.col("score"), factor))
    best = fuse.saturate(rows, "path", ("start_line", "chunk_seq"), top_k)
    return best.select("query_id", "place", "path", "chunk_seq", "heading_trail", "start_line", "end_line", "score", "body").orderBy("query_id", "place")


def with_snippets(results: DataFrame, most: int) -> DataFrame:
    return results.withColumn("snippet", snippet(F.col("body"), most)).drop("body")
