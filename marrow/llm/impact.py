"""Ranked lexical search over a bit-sliced impact index.

Documents are dealt to segments as they are read, in ascending order of their ids within each. The impact of a
term in a document is a whole number below 2**20; of each term in a segment the index holds 20 bitmaps over the
segment's documents, one for each bit of the impacts, without the bytes that are zero in all of them. No posting
moves for that: a segment is made where its texts are read.

A search meets each segment with a block of items. The bitmaps of the items' terms are multiplied by the terms'
weights and added up for each item bit by bit with carries, eight documents to a byte, so that the sums stand in
bitmaps too. The best of a segment are told from the most significant bitmap down: a bitmap either parts more than
`limit` documents from the rest, and these alone go on, or all that it parts are among the best. The best of all segments
meet in one rank, of which each task sends on `limit` an item at most.

Terms are known by 64-bit numbers, as in words.py. A null text has no term and counts for nothing, as has an empty
one; neither is ever listed. Texts of any length are read whole. Rows that repeat are documents of their own; equal
scores go by ascending id, a null one last. Rows of one item are one item with all their terms, null ids too. An item
without a term, or an empty table on either side, has no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrow.operators import words
from marrow.llm.common import settled, slices

#: Documents and bytes of text in a segment, items in a block, pairs of item and term that may be broadcast.
SEGMENT_DOCS, SEGMENT_BYTES, BLOCK, MAX_PAIRS = 16_384, 4_000_000, 256, 500_000
#: Bytes of text whose words are told apart at a time.
PIECE_BYTES = 500_000
#: Bits of an impact.
BITS = 20


@dataclass(frozen=True)
class Index:
    """postings (segment, term, places, slices), documents (segment, ids), terms (term, df), and how many documents and words there are."""

    postings: DataFrame
    documents: DataFrame
    terms: DataFrame
    n_docs: int
    n_words: int


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by term and row: the number of each term of each row, the row, how often it stands there; and the words of every row."""
    parts = []
    for part in slices(iter([pa.record_batch([column], names=["text"])]), "text", PIECE_BYTES):  # the numbers of a piece take many times its bytes
        number, _, _, starts = words.numbers(*words.raw(part.column(0)), blank=words.NO_LETTER)
        parts.append((number, np.diff(starts)))
    number, sizes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (row[1:] != row[:-1])]) if len(number) else np.zeros(0, np.int64)
    return number[first].view(np.int64), row[first], np.diff(np.r_[first, len(number)]), sizes


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, n) of each slice of texts; under the null term its documents with a word, and its words."""
    for batch in slices(batches, "text", SEGMENT_BYTES):
        term, _, _, sizes = counted(batch.column("text"))
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        df = np.diff(np.r_[first, len(term)])
        none = pa.array([None], pa.int64())
        columns = [pa.concat_arrays([pa.array(term[first]), none]), pa.array(np.r_[df, (sizes > 0).sum()]), pa.array(np.r_[np.zeros(len(first), np.int64), sizes.sum()])]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "df", "n"])


def segments(n_docs: int, n_words: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEGMENT_BYTES):
            for i in range(0, batch.num_rows, SEGMENT_DOCS):
                yield batch.slice(i, SEGMENT_DOCS)

    def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(segment, term, places, slices, ids). slices: BITS bytes for each of the term's places. The row without a term has the ids."""
        name = TaskContext.get().partitionId() << 32
        for batch in cut(batches):
            batch = batch.take(pa.compute.sort_indices(batch.column("id"), null_placement="at_end"))
            term, row, tf, sizes = counted(batch.column("text"))
            if not len(term):
                continue
            m = 50 + (50 * sizes.astype(np.int64) * n_docs) // n_words
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
            byte, bit = row >> 3, (row & 7).astype(np.uint8)
            new = np.r_[True, term[1:] != term[:-1]]
            at = np.flatnonzero(new | np.r_[True, byte[1:] != byte[:-1]])  # where a byte of a term begins
            held = np.empty((len(at), BITS), np.uint8)
            for s in range(BITS):
                held[:, s] = np.bitwise_or.reduceat(((impact >> s) & 1).astype(np.uint8) << bit, at)
            ends = np.r_[np.flatnonzero(new[at]), len(at)]
            n = len(ends) - 1
            name += 1
            ids = pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [batch.num_rows], pa.int32()), batch.column("id"))
            more = pa.array([None], pa.binary())
            columns = [
                pa.array(np.full(n + 1, name)),
                pa.concat_arrays([pa.array(term[at[ends[:-1]]]), pa.array([None], pa.int64())]),
                pa.concat_arrays([binary(byte[at].astype(np.uint16), ends * 2), more]),
                pa.concat_arrays([binary(held, ends * BITS), more]),
                ids,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "term", "places", "slices", "ids"])

    return run


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents, in the shared folder."""
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    terms = settled(read.select("text").mapInArrow(frequencies, "term long, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")), "impact-terms")
    n_docs, n_words = terms.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = settled(read.mapInArrow(segments(n_docs, n_words), "segment long, term long, places binary, slices binary, ids array<long>"), "impact-index")
    return Index(rows.where("term IS NOT NULL").drop("ids"), rows.where("term IS NULL").select("segment", "ids"), terms.where("term IS NOT NULL").select("term", "df"), n_docs, n_words)


def multiplied(bits: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The bitmaps of impact times weight: bits (BITS, bytes), one weight a byte. The multiples by powers of two are added with carries."""
    wide = int(weight.max(initial=0)).bit_length()
    out = np.zeros((BITS + wide, bits.shape[1]), np.uint8)
    for j in range(wide):
        taken = (-((weight >> j) & 1)).astype(np.uint8)  # all ones where this bit of the weight is set
        carry = np.zeros(bits.shape[1], np.uint8)
        for s in range(BITS):
            a, x = out[j + s], bits[s] & taken
            either = a ^ x
            out[j + s], carry = either ^ carry, (a & x) | (carry & either)
        out[j + BITS] = carry
    return out


def added(sums: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Add bitmaps to the bytes `at` of the bitmaps `sums`, which have room for the carries."""
    carry = np.zeros(len(at), np.uint8)
    for s in range(len(sums)):
        if s >= len(bits) and not carry.any():
            return
        a = sums[s][at]
        x = bits[s] if s < len(bits) else np.zeros(len(at), np.uint8)
        either = a ^ x
        sums[s][at] = either ^ carry
        carry = (a & x) | (carry & either)


def best(sums: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, document) of the highest sums above 0 of each item, ties to the first: sums (bits, items, bytes), bytes in eights."""
    wide = sums.view(np.uint64)
    maybe = np.bitwise_or.reduce(wide, axis=0)
    sure = np.zeros_like(maybe)
    for s in range(len(wide) - 1, -1, -1):
        parted = sure | (maybe & wide[s])
        n = np.bitwise_count(parted).sum(axis=1, dtype=np.int64)[:, None]
        sure = np.where(n > limit, sure, parted)
        maybe = np.where(n > limit, maybe & wide[s], np.where(n < limit, maybe & ~wide[s], np.uint64(0)))
    room = limit - np.bitwise_count(sure).sum(axis=1, dtype=np.int64)
    of, doc = np.nonzero(np.unpackbits(sure.view(np.uint8), axis=1, bitorder="little"))
    tied, other = np.nonzero(np.unpackbits(maybe.view(np.uint8), axis=1, bitorder="little"))
    place = np.arange(len(tied)) - np.searchsorted(tied, tied)
    fits = place < room[tied]
    return np.r_[of, tied[fits]], np.r_[doc, other[fits]]


def searched(limit: int) -> Callable:
    names = {"item": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The best documents of one segment for each item of a block. A row: a term's bitmaps and weight, and the items that have it."""
        ids = table.filter(pa.compute.is_valid(table["ids"]))["ids"].combine_chunks().flatten()
        rows = table.filter(pa.compute.is_valid(table["slices"]))
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        places = [np.frombuffer(x, np.uint16) for x in rows["places"].to_pylist()]
        size = np.array([len(x) for x in places])
        start, weight = np.cumsum(size) - size, np.asarray(rows["weight"])
        place = np.concatenate(places).astype(np.int64)
        bits = np.frombuffer(b"".join(rows["slices"].to_pylist()), np.uint8).reshape(-1, BITS).T
        product = multiplied(np.ascontiguousarray(bits), np.repeat(weight, size))
        lists = rows["items"].combine_chunks()
        named, item = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        term = np.repeat(np.arange(rows.num_rows), np.asarray(lists.value_lengths()))
        order = np.argsort(item, kind="stable")
        item, term = item[order], term[order]
        turn = np.arange(len(item)) - np.searchsorted(item, item)  # which of its item's terms it is
        width = -(-len(ids) // 64) * 8
        most = np.bincount(item, weight[term]).max() * 2.0**BITS
        sums = np.zeros((int(most).bit_length() + 1, len(named) * width), np.uint8)
        by_turn = np.argsort(turn, kind="stable")
        for group in np.split(by_turn, np.flatnonzero(np.diff(turn[by_turn])) + 1):  # one term of each item: no byte twice
            t = term[group]
            n = size[t]
            source = np.repeat(start[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            added(sums, np.repeat(item[group] * width, n) + place[source], product[:, source])
        sums = sums.reshape(len(sums), len(named), width)
        of, doc = best(sums, limit)
        score = np.zeros(len(of), np.int64)
        for s in range(len(sums)):
            score |= ((sums[s, of, doc >> 3] >> (doc & 7).astype(np.uint8)) & 1).astype(np.int64) << s
        return pa.table([pa.array(named[of]), ids.take(pa.array(doc)), pa.array(score)], names=list(names))

    return run


def search(index: Index, items: DataFrame, limit: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `limit` best documents of each item."""

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEGMENT_BYTES):
            term, row, _, _ = counted(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array(term)], names=["item", "term"])

    read = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = settled(read.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "impact-items")
    asked = read.join(named.withColumnRenamed("item_id", "i"), F.col("item_id").eqNullSafe(F.col("i"))).select("item", "text")
    blocks = max(1, -(-named.count() // BLOCK))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    pairs = asked.mapInArrow(terms_of, "item long, term long").distinct().join(index.terms, "term").withColumn("weight", weight)
    pairs = settled(pairs.where("weight > 0").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "impact-pairs")
    wanted = pairs.groupBy("block", "term").agg(F.first("weight").alias("weight"), F.collect_list("item").alias("items"))  # BLOCK items or so
    hits = index.postings.join(F.broadcast(wanted) if pairs.count() <= MAX_PAIRS else wanted, "term").drop("term")
    ids = index.documents.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    cells = hits.unionByName(ids, allowMissingColumns=True).groupBy("block", "segment")
    found = cells.applyInArrow(searched(limit), "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    top = found.withColumn("rank", rank).where(F.col("rank") <= limit)
    return top.join(named, "item").select("item_id", "rank", "doc_id", "score")
