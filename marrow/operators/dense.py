"""Exact dense top-k of any number of query vectors.

Few queries are broadcast to the scan of the vectors, which are met a bounded number at a time. More are joined with them in blocks: both sides are dealt to
cells, and a cell multiplies its rows with its queries a block at a time, in order of falling length, until no further block
can give any query more than its last place has. A cell or task sends on its best `limit` rows a query only, and
those meet in the rank. Products are summed in double precision and rounded, so that ties are ties anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marrow.operators.bm25 import ranked

MAX_QUERY_FLOATS = 4_000_000
#: Numbers of the vectors that a task multiplies with the queries it was sent, STEP queries and BLOCK_ROWS rows at a time.
HELD_FLOATS = 4_000_000
#: Vectors in a block as it is dealt, rows and queries of a cell, and how many of either are multiplied at a time.
PACK, CELL_ROWS, CELL_QUERIES, BLOCK_ROWS, STEP = 256, 16_384, 4_096, 1_024, 256
DIGITS = 5
#: Stands for an infinite score where infinity stands for one that is no number.
MOST = np.finfo(np.float64).max


def topk(vectors: DataFrame, queries: DataFrame, limit: int, key: tuple[str, ...], embedding: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank) from vectors (key, embedding) and queries (query_id, embedding). Null vectors match nothing."""
    rows = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id"), F.col("embedding").cast("array<float>"))
    size = rows.agg(F.sum(F.size("embedding"))).first()[0] or 0
    if size > MAX_QUERY_FLOATS:
        return block_topk(vectors, rows, limit, key, embedding)
    asked: dict[int, tuple[list, list]] = {}
    for r in rows.collect():
        ids, vectors_of = asked.setdefault(len(r["embedding"]), ([], []))
        ids.append(r["query_id"])
        vectors_of.append(r["embedding"])
    sent = vectors.sparkSession.sparkContext.broadcast({dim: (pa.array(ids, to_arrow_type(rows.schema["query_id"].dataType)), np.array(v, np.float64)) for dim, (ids, v) in asked.items()})
    names = ["query_id", *key, "score"]
    held_floats, step = HELD_FLOATS, STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, held_floats):
            sizes = np.asarray(pa.compute.list_value_length(table["v"]))
            for dim in np.unique(sizes).tolist():
                ids, matrix = sent.value.get(dim, ((), ()))
                if not len(ids):
                    continue
                some = table.take(pa.array(np.flatnonzero(sizes == dim))).combine_chunks()
                v = np.asarray(some["v"].combine_chunks().flatten(), np.float64).reshape(some.num_rows, dim)
                order = places(some, [f"c{i}" for i in range(len(key))])
                for i in range(0, len(ids), step):  # all that is made of a task's queries at a time is bounded
                    of, row, score, _ = foremost(v, order, matrix[i : i + step], limit)
                    kept = [some[f"c{k}"].combine_chunks().take(pa.array(row)) for k in range(len(key))]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of + i)), *kept, pa.array(score)], names=names)

    schema = T.StructType([T.StructField("query_id", rows.schema["query_id"].dataType), *(vectors.schema[c] for c in key), T.StructField("score", T.DoubleType())])
    cols = [F.col(c).alias(f"c{i}") for i, c in enumerate(key)]
    read = vectors.where(F.col(embedding).isNotNull()).select(*cols, F.col(embedding).cast("array<float>").alias("v"))
    return ranked(read.mapInArrow(run, schema), key, limit)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about `most` numbers of the vectors v, one batch at least."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column("v").flatten())
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n or held:
        yield pa.Table.from_batches(held)


def places(keys: pa.Table, names: list[str]) -> np.ndarray:
    """Where each row stands in the order of its key, nulls first."""
    order = np.empty(keys.num_rows, np.int64)
    order[np.asarray(pa.compute.sort_indices(keys.select(names), sort_keys=[(n, "ascending") for n in names], null_placement="at_start"))] = np.arange(keys.num_rows)
    return order


def packed(df: DataFrame, names: tuple[str, ...], rows: int) -> DataFrame:
    """Vectors (names, v) of one length in blocks: their keys and numbers, and a number to deal the block by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column("v")))
            for dim in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == dim)
                for part in (batch.take(pa.array(of[i : i + rows])) for i in range(0, len(of), rows)):
                    at += 1
                    whole = pa.array([0, part.num_rows], pa.int32())
                    keys = pa.ListArray.from_arrays(whole, pa.StructArray.from_arrays(part.columns[:-1], names=list(names)))
                    numbers = np.asarray(part.column("v").flatten(), np.float32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([dim], pa.int32()), keys, pa.array([numbers], pa.binary())], names=["block", "dim", "keys", "numbers"])

    keys = T.ArrayType(T.StructType([df.schema[n] for n in names]))
    fields = [("block", T.LongType()), ("dim", T.IntegerType()), ("keys", keys), ("numbers", T.BinaryType())]
    return df.select(*names, "v").mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def foremost(vectors: np.ndarray, order: np.ndarray, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of each query's best rows, equal scores by order, and how many blocks of rows were multiplied.

    Whole blocks of the rows, longest vectors first, are left out as soon as length times length is below every query's last place.
    A score that is no number stands above all others, as Spark has it.
    """
    length, reach = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    by_length = np.argsort(-np.where(np.isnan(length), np.inf, length), kind="stable")
    odd = not (np.isfinite(length).all() and np.isfinite(reach).all())
    n = len(queries)
    score, row = np.full((n, limit), -np.inf), np.full((n, limit), len(vectors))
    place = np.append(order, np.iinfo(np.int64).max)  # of no row
    blocks = 0
    for i in range(0, len(vectors), BLOCK_ROWS):
        some = by_length[i : i + BLOCK_ROWS]
        if not odd and (length[some[0]] * reach * (1 + 1e-9) + 10.0**-DIGITS < score[:, -1]).all():
            break
        blocks += 1
        some = some[np.argsort(order[some])]
        new = np.round(queries @ vectors[some].T, DIGITS)
        if odd:
            new = np.where(np.isnan(new), np.inf, np.minimum(new, MOST))
        if len(some) > limit:  # the best of the block, of equal ones the first by order
            edge = np.partition(new, len(some) - limit, axis=1)[:, len(some) - limit, None]
            tied, room = new == edge, limit - (new > edge).sum(axis=1, keepdims=True)
            of, at = np.nonzero((new > edge) | (tied & (np.cumsum(tied, axis=1) <= room)))
            new, some = new[of, at].reshape(n, limit), some[at].reshape(n, limit)
        else:
            some = np.broadcast_to(some, new.shape)
        score, row = np.c_[score, new], np.c_[row, some]
        best = np.lexsort((place[row], -score), axis=1)[:, :limit]
        score, row = np.take_along_axis(score, best, 1), np.take_along_axis(row, best, 1)
    of, at = np.nonzero(row < len(vectors))
    row, score = row[of, at], score[of, at]
    if odd:
        top = np.flatnonzero(score >= MOST)
        score[top] = np.round((queries[of[top]] * vectors[row[top]]).sum(axis=1), DIGITS)
    return of, row, score, blocks


def block_topk(vectors: DataFrame, queries: DataFrame, limit: int, key: tuple[str, ...], embedding: str = "embedding") -> DataFrame:
    """topk() of any number of queries, as a join of blocks. Vectors of different length do not meet."""
    names = tuple(f"c{i}" for i in range(len(key)))
    left = vectors.where(F.col(embedding).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)], F.col(embedding).cast("array<float>").alias("v"))
    right = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<float>").alias("v"))
    b, g = (max(1, -(-df.count() // most)) for df, most in ((left, CELL_ROWS), (right, CELL_QUERIES)))
    deal = lambda df, of, n, other, m: df.withColumn(of, F.pmod(F.xxhash64("block"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    rows, asked = deal(packed(left, names, PACK), "b", b, "g", g), deal(packed(right, ("query_id",), PACK), "g", g, "b", b)
    schema = T.StructType([queries.schema["query_id"], *(T.StructField(n, left.schema[n].dataType) for n in names), T.StructField("score", T.DoubleType())])
    types = {f.name: to_arrow_type(f.dataType) for f in schema}

    def unpack(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        keys = table["keys"].combine_chunks().flatten()
        numbers = np.frombuffer(b"".join(table["numbers"].to_pylist()), np.float32).reshape(len(keys), -1 if len(keys) and table["dim"][0].as_py() else 0)
        return pa.Table.from_arrays(keys.flatten(), names=[f.name for f in keys.type]), numbers.astype(np.float64)

    def run(cell: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], t) for n, t in types.items()})
        (keys, v), (ids, q) = unpack(rows), unpack(asked)
        order = places(keys, list(names))
        out = []
        for i in range(0, len(q), STEP):
            of, row, score, _ = foremost(v, order, q[i : i + STEP], limit)
            out.append((of + i, row, score))
        of, row, score = (np.concatenate(x) for x in zip(*out, strict=True))
        found = {"query_id": ids["query_id"].take(pa.array(of)), **{n: keys[n].take(pa.array(row)) for n in names}, "score": pa.array(score)}
        return pa.table({n: found[n].cast(t) for n, t in types.items()})

    cell = ["dim", "b", "g"]
    best = rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(run, schema)
    return ranked(best.select("query_id", *[F.col(n).alias(c) for c, n in zip(key, names, strict=True)], "score"), key, limit)
