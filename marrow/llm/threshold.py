"""Exact top k by inner product, by uniform thresholds in three phases.

The components of the vectors are dealt to `lists` groups. A list has the partial score of every pair of
a query and a row; the score is their sum. No list is ever written down: pairs are met in cells, one
block of rows and one of queries of one list, as a matrix product.

1. Each list sends its foremost rows of every query, DEPTH times as many as are to be listed. The rows sent are
   scored in full, and the k-th best of them is a score that the true k-th best reaches.
2. From the last partial score that each list has sent, all go down (or up) by the same amount, so that they add up
   to that score: who is below in every list is below it in all. These are the cutoffs; they are sent out with the
   queries, and every list sends all its entries that reach them.
3. For the rows so met, the lists that have not sent theirs are asked for it, and the sums rank.

Equal vectors, known by two 64-bit hashes, are one row of the lists, with the few smallest ids that can ever be listed, and one
query, so that copies cost nothing; the ids of the queries come back at the end. Between stages tables are in the shared
folder. A cell has about ROWS rows and ASKED queries at most, whatever the size of the input.

Vectors that are null or hold a null or non-finite component take no part; those of different length do not meet;
empty ones score 0 among themselves. A query lists every row but its own, repeated ones as often as they stand; rows
that repeat a query in whole are one query. A null id is no query and comes last in a
tie. Sums beyond 60 bits in a list count as 2**60. An empty table has an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.llm.common import settled

#: Rows in a block as written, rows and queries of a cell, queries multiplied at a time, pairs asked for in a cell.
BLOCK, ROWS, ASKED, STEP, PAIRS = 256, 16384, 4096, 256, 1_000_000
DEPTH = 8
LIMIT = 1 << 60
BLOCKS = "dim int, list int, block long, rows binary, top long, kind string, values binary"
CELL = ["dim", "list", "g", "b"]


def whole(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))


def blocks(classes: DataFrame, lists: int) -> DataFrame:
    """classes (row, v) in blocks of one length and list: the rows' numbers, and their components in the fewest bytes that hold them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, v = np.asarray(batch.column("row")), batch.column("v")
            sizes = np.asarray(v.value_lengths())
            for dim in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == dim)
                for at in (of[i : i + BLOCK] for i in range(0, len(of), BLOCK)):
                    x = np.asarray(v.take(pa.array(at)).flatten(), np.int64).reshape(len(at), dim)
                    out = []
                    for k, part in enumerate(np.array_split(x, lists, axis=1)):
                        top = int(max(np.abs(part.astype(float)).max(initial=0), 0))
                        kind = "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "i8"
                        out.append((dim, k, int(row[at[0]]), row[at].tobytes(), min(top, (1 << 63) - 1), kind, np.ascontiguousarray(part).astype(kind).tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["dim", "list", "block", "rows", "top", "kind", "values"])

    return classes.select("row", "v").mapInArrow(pack, BLOCKS)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Numbers of the rows, the block of each, their components and the greatest of these."""
    ids = [np.frombuffer(x, np.int64) for x in table["rows"].to_pylist()]
    values = [np.frombuffer(x, kind).reshape(len(i), -1) if len(x) else np.zeros((len(i), 0), np.int16) for x, kind, i in zip(table["values"].to_pylist(), table["kind"].to_pylist(), ids, strict=True)]
    return np.concatenate(ids), np.repeat(np.asarray(table["block"]), [len(i) for i in ids]), np.concatenate(values), max(table["top"].to_pylist())


def number_type(a: int, b: int, width: int) -> type:
    """What holds every sum of products exactly."""
    most = a * b * max(width, 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -LIMIT, LIMIT).astype(np.int64) if x.dtype == object else x.astype(np.int64)


ENTRY = {"query": pa.int64(), "q_block": pa.int64(), "row": pa.int64(), "block": pa.int64(), "dim": pa.int32(), "list": pa.int32(), "part": pa.int64()}
ENTRIES = "query long, q_block long, row long, block long, dim int, list int, part long"


def entries(key: tuple = (), *columns: np.ndarray) -> pa.Table:
    """query, q_block, row, block and part of a cell's entries, with the cell's dim and list."""
    *columns, part = columns or [[]] * 5
    same = [[k.as_py()] * len(part) for k in key[:2]] or [[], []]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(ENTRY.items(), (*columns, *same, part), strict=True)})


def foremost(most: int) -> Callable:
    """Of a cell, each query's `most` best rows in the cell's list."""

    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return entries()
        row, block, v, top = unpacked(rows)
        query, q_block, q, q_top = unpacked(asked)
        kind = number_type(top, q_top, v.shape[1])
        v, n, out = v.astype(kind).T, min(most, len(row)), []
        for i in range(0, len(query), STEP):
            p = q[i : i + STEP].astype(kind) @ v
            p = whole_numbers(p) if kind is object else p
            best = np.argpartition(p, p.shape[1] - n, axis=1)[:, p.shape[1] - n :]
            of = np.repeat(np.arange(len(p)), n)
            out.append((query[i + of], q_block[i + of], row[best.ravel()], block[best.ravel()], whole_numbers(p[of, best.ravel()])))
        return entries(key, *(np.concatenate(x) for x in zip(*out, strict=True)))

    return run


def above(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """Of a cell, all entries that reach the query's cutoff."""
    asked, cuts = asked.filter(pa.compute.is_valid(asked["rows"])), asked.filter(pa.compute.is_null(asked["rows"]))
    if not rows.num_rows or not asked.num_rows:
        return entries()
    row, block, v, top = unpacked(rows)
    query, q_block, q, q_top = unpacked(asked)
    order = np.argsort(cut_of := np.asarray(cuts["query"]))
    cut = np.asarray(cuts["cut"])[order][np.searchsorted(cut_of, query, sorter=order)]
    kind = number_type(top, q_top, v.shape[1])
    v, out = v.astype(kind).T, []
    for i in range(0, len(query), STEP):
        p = q[i : i + STEP].astype(kind) @ v
        p = whole_numbers(p) if kind is object else p
        of, at = np.nonzero(p >= cut[i : i + STEP, None])
        out.append((query[i + of], q_block[i + of], row[at], block[at], whole_numbers(p[of, at])))
    return entries(key, *(np.concatenate(x) for x in zip(*out, strict=True)))


def answered(key: tuple, held: pa.Table, pairs: pa.Table) -> pa.Table:
    """Of a cell, the partial scores of the pairs asked for. held: blocks of rows, and of queries."""
    if not pairs.num_rows:
        return entries()
    row, _, v, top = unpacked(held.filter(pa.compute.invert(held["asked"])))
    query, _, q, q_top = unpacked(held.filter(held["asked"]))
    rows, queries = np.argsort(row), np.argsort(query)
    kind = number_type(top, q_top, v.shape[1])
    out = []
    for i in range(0, pairs.num_rows, 65536):
        some = pairs.slice(i, 65536)
        a = v[rows[np.searchsorted(row, np.asarray(some["row"]), sorter=rows)]].astype(kind)
        b = q[queries[np.searchsorted(query, np.asarray(some["query"]), sorter=queries)]].astype(kind)
        out.append(whole_numbers((a * b).sum(axis=1)))
    return entries(key, *(np.asarray(pairs[c]) for c in ("query", "q_block", "row", "block")), np.concatenate(out))


class Search:
    """Rows and queries in blocks, and the cells in which they meet."""

    def __init__(self, rows: DataFrame, asked: DataFrame, n_rows: int, n_asked: int):
        self.rows, self.asked, self.b, self.g = rows, asked, max(1, -(-n_rows // ROWS)), max(1, -(-n_asked // ASKED))

    def place(self, df: DataFrame, block: str, of: str, n: int) -> DataFrame:
        return df.withColumn(of, F.pmod(F.xxhash64(block), F.lit(n)).cast("int"))

    def everywhere(self, df: DataFrame, of: str, n: int) -> DataFrame:
        return df.withColumn(of, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def dealt(self) -> tuple[DataFrame, DataFrame]:
        rows = self.everywhere(self.place(self.rows, "block", "b", self.b), "g", self.g)
        return rows, self.everywhere(self.place(self.asked, "block", "g", self.g), "b", self.b)

    def first(self, most: int) -> DataFrame:
        rows, asked = self.dealt()
        return rows.groupBy(*CELL).cogroup(asked.groupBy(*CELL)).applyInArrow(foremost(most), ENTRIES)

    def reach(self, cuts: DataFrame) -> DataFrame:
        """cuts (query, q_block, dim, list, cut)."""
        rows, asked = self.dealt()
        told = self.everywhere(self.place(cuts, "q_block", "g", self.g), "b", self.b)
        both = asked.unionByName(told.drop("q_block"), allowMissingColumns=True)
        return rows.groupBy(*CELL).cogroup(both.groupBy(*CELL)).applyInArrow(above, ENTRIES)

    def scores(self, entries: DataFrame, lists: int, n: int) -> DataFrame:
        """(query, row, score) of every pair in entries; the lists that it has no entry of are asked. n: at most so many entries."""
        pairs = entries.groupBy("query", "q_block", "row", "block", "dim").agg(F.sum("part").alias("sum"), F.collect_set("list").alias("seen"))
        pairs = pairs.withColumn("wanted", F.array_except(F.array(*[F.lit(i) for i in range(lists)]), "seen"))
        pairs = settled(pairs.drop("seen"), "topk-pairs")
        parts = max(1, -(-n * lists // (PAIRS * self.b * self.g)))  # of a cell, so that none has too many pairs
        asks = pairs.withColumn("list", F.explode("wanted")).drop("wanted", "sum").withColumn("part", F.pmod(F.xxhash64("row", "query"), F.lit(parts)).cast("int"))
        asks = self.place(self.place(asks, "q_block", "g", self.g), "block", "b", self.b)
        rows, asked = self.dealt()
        held = self.everywhere(rows.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True))), "part", parts)
        cell = [*CELL, "part"]
        told = held.groupBy(*cell).cogroup(asks.groupBy(*cell)).applyInArrow(answered, ENTRIES)
        each = pairs.select("query", "row", F.col("sum").alias("part")).unionByName(told.select("query", "row", "part"))
        return each.groupBy("query", "row").agg(F.sum("part").alias("score"))


def topk(vectors: DataFrame, asked: Column, limit: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, lists: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that is asked for, the `limit` best of all other ids by the inner product of floor(scale * x)."""
    v = F.col(vector_col)
    rows = vectors.where(whole(v)).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), F.coalesce(asked & F.col(id_col).isNotNull(), F.lit(False)).alias("asked"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    most = limit + 1  # one of them may be the query itself
    by_id = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last()))
    few = rows.drop("asked").withColumn("n", by_id).where(F.col("n") <= most)  # the smallest ids of equal vectors; each task cuts its own first
    classes = few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct(F.isnull("id").alias("none"), "id"))).alias("ids"))
    classes = settled(classes.withColumn("row", F.monotonically_increasing_id()), "topk-classes")
    queries = settled(rows.where("asked").select("h1", "h2", F.col("id").alias("query_id")).distinct(), "topk-asked")
    known = settled(classes.join(queries.select("h1", "h2").distinct(), ["h1", "h2"]).select("h1", "h2", "v", "row"), "topk-queries")
    search = Search(settled(blocks(classes, lists), "topk-rows"), settled(blocks(known, lists), "topk-query-rows"), classes.count(), known.count())

    # 1
    best = F.row_number().over(Window.partitionBy("query", "list").orderBy(F.desc("part"), "row"))
    first = search.first(DEPTH * most).withColumn("n", best).where(F.col("n") <= DEPTH * most).drop("n")
    first = settled(first, "topk-first")
    exact = search.scores(first, lists, first.count())
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row"))
    reached = settled(exact.withColumn("n", nth).where(F.col("n") == most).select("query", F.col("score").alias("least")), "topk-least")

    # 2: a query that has met fewer rows than it may list takes all
    last = first.groupBy("query", "q_block", "dim", "list").agg(F.min("part").alias("last"))
    down = F.sum("last").over(Window.partitionBy("query")) - F.col("least")
    cut = F.coalesce(F.expr(f"last - down DIV {lists} - 1"), F.lit(-LIMIT))
    cuts = last.join(reached, "query", "left").withColumn("down", down).select("query", "q_block", "dim", "list", cut.alias("cut"))
    reaching = settled(search.reach(cuts), "topk-entries")

    # 3
    scored = search.scores(reaching, lists, reaching.count()).join(reached, "query", "left").where("least IS NULL OR score >= least")
    named = scored.join(classes.select("row", "ids"), "row")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.element_at("ids", 1)))
    found = named.withColumn("n", place).where(F.col("n") <= most).select("query", "score", "ids", (F.col("query") == F.col("row")).alias("same"))
    met = queries.join(found.join(known.select(F.col("row").alias("query"), "h1", "h2"), "query"), ["h1", "h2"])
    own = F.when(F.col("same"), F.array_position(F.col("ids.id"), F.col("query_id")) - 1).otherwise(-1)  # the query's own row
    met = met.withColumn("own", own).select("query_id", "h1", "h2", "score", F.explode(F.filter("ids", lambda x, i: i != F.col("own"))).alias("x"))
    rank = F.row_number().over(Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "x"))
    return met.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", F.col("x.id").alias("vec_id"), "score")
