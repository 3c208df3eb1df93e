"""Static vectors for the tokens of a given tokenizer, learned from a table of texts.

Texts become token ids once. Pairs of tokens at most `window` apart are counted by key, the nearer the more, whole numbers only, so
that their sums do not depend on any order. The counts make a symmetric matrix of positive pointwise mutual information, stored a
token a row. Its leading eigenvectors come from a randomised range finder: a product of the matrix with a narrow one is a pass
over the rows, in which each task has the narrow matrix. A vector is a token's row of the eigenvectors times the root of the
eigenvalues' sizes, and less the more frequent the token is; it is stored in bytes with a scale, as static models are.

What the driver holds is as wide as the vectors and as long as the tokenizer's vocabulary, which is checked against
MAX_NUMBERS, whatever the number of texts. Null and empty texts have no tokens and the zero vector.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.operators.batches import slices
from marrow.operators.embed import DIMENSIONS, unit
from marrow.operators.pieces import Words

#: Bytes of text and ids handled at a time, ids whose pairs are counted at a time, numbers in a matrix that is sent to tasks.
SLICE_BYTES, SLICE_IDS, PAIR_IDS, MAX_NUMBERS = 1_000_000, 250_000, 1_000_000, 40_000_000
#: Words whose ids a worker remembers.
MAX_WORDS = 200_000
WINDOW, EXTRA, ROUNDS, RARE = 4, 16, 2, 1e-3
Settle = Callable[[DataFrame, str], DataFrame]


def token_ids(df: DataFrame, keys: tuple[str, ...], text: str, tokenizer: str) -> DataFrame:
    """(keys, ids array<int>) by a tokenizer given as JSON, of those that drop white space: a text's ids are those of its words, so each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(tokenizer)
        made.no_padding()
        made.no_truncation()
        if made.encode("a b \n\tc", add_special_tokens=False).ids != [i for w in "abc" for i in made.encode(w, add_special_tokens=False).ids]:
            raise ValueError("the tokenizer keeps white space")
        known: dict[str, list[int]] = {}
        words = Words(tokenizer)
        for batch in slices(batches, "text", SLICE_BYTES):
            if words.by_piece:
                ids, row = words.encode(batch.column(len(keys)), None)
                found = pa.ListArray.from_arrays(pa.array(row.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], found], names=[*keys, "ids"])
                continue
            parts = pa.compute.split_pattern_regex(batch.column(len(keys)), "[ \t\n\r]+")
            words = pa.compute.dictionary_encode(parts.flatten())
            distinct = words.dictionary.to_pylist()
            if len(known) > MAX_WORDS:
                known.clear()
            new = [w for w in distinct if w not in known]
            for i in range(0, len(new), 4096):
                some = new[i : i + 4096]
                known.update(zip(some, (e.ids for e in made.encode_batch_fast(some, add_special_tokens=False)), strict=True))
            ids = pa.array([known[w] for w in distinct], pa.list_(pa.int32())).take(words.indices)  # of every word
            word_ends, id_ends = np.asarray(parts.offsets) - parts.offsets[0].as_py(), np.r_[0, np.cumsum(np.asarray(pa.compute.list_value_length(ids), np.int64))]
            found = pa.ListArray.from_arrays(pa.array(id_ends[word_ends].astype(np.int32)), ids.flatten())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], found], names=[*keys, "ids"])

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def id_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of about so many ids, one row at least."""
    for batch in batches:
        ends, at = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column(column)), np.int64)), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, before + most, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def pair_counts(coded: DataFrame, size: int, window: int = WINDOW) -> DataFrame:
    """(i, j, n) for i <= j of all pairs of tokens at most window apart in one text, in either order; n: window! / distance each, and twice that if i = j."""
    worth = np.array([math.factorial(window) // d for d in range(1, window + 1)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in id_slices(batches, "ids", PAIR_IDS):
            lists = batch.column("ids")
            ids = np.asarray(lists.flatten(), np.int64)
            of = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(lists)))
            keys = []
            for d in range(window):  # the distance goes along in the number that is sorted
                a, b = ids[: -d - 1], ids[d + 1 :]
                same = of[: -d - 1] == of[d + 1 :]
                a, b = a[same], b[same]
                keys.append((np.minimum(a, b) * size + np.maximum(a, b)) * window + d)
            key, d = np.divmod(np.sort(np.concatenate(keys)), window)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            if len(first):
                i, j = np.divmod(key[first], size)
                n = np.add.reduceat(worth.take(d), first) * np.where(i == j, 2, 1)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(n)], names=["i", "j", "n"])

    return coded.select("ids").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def information(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(i, js, weights) of the tokens' rows: ln(n * total / (n_i * n_j)) where that is above 0. totals (i, n, at): one row a token; here i and js are their places."""
    both = counts.select("n", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("p"))
    all_of = totals.agg(F.sum("n").alias("all"))
    rows = both.select("p.i", "p.j", "n").join(F.broadcast(totals.select("i", F.col("n").alias("n_i"), F.col("at").alias("at_i"))), "i").join(F.broadcast(totals.select(F.col("i").alias("j"), F.col("n").alias("n_j"), F.col("at").alias("at_j"))), "j").crossJoin(F.broadcast(all_of))  # a row a token; one row
    weight = F.ln(F.col("n").cast("double") * F.col("all") / (F.col("n_i").cast("double") * F.col("n_j")))
    held = rows.select(F.col("at_i").alias("i"), F.col("at_j").alias("j"), weight.alias("w")).where("w > 0")
    return held.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", F.col("w").cast("float").alias("w")))).alias("x")).select("i", F.col("x.j").alias("js"), F.col("x.w").alias("weights"))  # a row has at most the vocabulary


def token_totals(counts: DataFrame) -> DataFrame:
    """(i, n, at): each token's sum over its row of the symmetric matrix, and its place among the tokens that occur."""
    ends = counts.select("n", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("i"))
    place = F.row_number().over(Window.orderBy("i")) - 1  # of the vocabulary at most
    return ends.groupBy("i").agg(F.sum("n").alias("n")).withColumn("at", place)


def times(rows: DataFrame, x: np.ndarray) -> np.ndarray:
    """The matrix times x, of as many rows as x has."""
    sent = rows.sparkSession.sparkContext.broadcast(x.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            js, weights = (np.asarray(batch.column(c).flatten()) for c in (1, 2))
            sizes = np.asarray(pa.compute.list_value_length(batch.column(1)))
            ends = np.cumsum(sizes)
            y = np.empty((batch.num_rows, held.shape[1]), np.float32)
            for k, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
                y[k] = weights[a:b] @ held[js[a:b]]
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * held.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=["i", "y"])

    got = rows.select("i", "js", "weights").mapInArrow(run, "i int, y array<float>").toArrow()
    sent.destroy()
    out = np.zeros(x.shape, np.float32)
    for batch in got.to_batches():
        out[np.asarray(batch.column("i"))] = np.asarray(batch.column("y").flatten()).reshape(batch.num_rows, -1)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the columns of two tall matrices, in double precision."""
    parts = (slice(i, i + 4096) for i in range(0, len(a), 4096))
    return sum(a[p].T.astype(np.float64) @ b[p].astype(np.float64) for p in parts)


def orthonormal(x: np.ndarray) -> np.ndarray:
    """A basis of the columns of a tall matrix, by its small matrix of inner products, twice for precision."""
    for _ in range(2):
        value, vector = np.linalg.eigh(products(x, x))
        kept = value > 1e-9 * value.max(initial=1e-300)
        x = x @ (vector[:, kept] / np.sqrt(value[kept])).astype(np.float32)
    return x


def leading(rows: DataFrame, size: int, dims: int) -> np.ndarray:
    """(size, dims): leading eigenvectors of the matrix times the roots of the eigenvalues' sizes, the largest first; zeros beyond its rank."""
    wide = min(dims + EXTRA, size)
    x = np.random.default_rng(17).standard_normal((size, wide), np.float32)
    for _ in range(ROUNDS):
        x = orthonormal(times(rows, x))
    t = products(x, times(rows, x))
    value, vector = np.linalg.eigh((t + t.T) / 2)
    order = np.argsort(-np.abs(value))[:dims]
    out = x @ vector[:, order].astype(np.float32)
    if out.size:
        out *= np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])  # one of the two signs
    out *= np.sqrt(np.abs(value[order])).astype(np.float32)
    return np.pad(out, ((0, 0), (0, dims - out.shape[1])))


@dataclass
class Model:
    """A text's vector is the mean of its tokens' rows, each its bytes times its scale, to length one."""

    tokenizer: str
    matrix: np.ndarray
    scale: np.ndarray

    @property
    def name(self) -> str:
        """What StaticEmbedder calls itself with this model."""
        return f"static-{crc32(self.file()):08x}"

    def file(self) -> bytes:
        """What a safetensors file of the model has."""
        n, m = self.matrix.nbytes, self.scale.nbytes
        head = {"embeddings": {"dtype": "I8", "shape": list(self.matrix.shape), "data_offsets": [0, n]}, "scales": {"dtype": "F32", "shape": [len(self.scale)], "data_offsets": [n, n + m]}}
        text = json.dumps(head).encode()
        return len(text).to_bytes(8, "little") + text + self.matrix.tobytes() + self.scale.tobytes()

    def save(self, folder: str) -> None:
        """A folder as StaticEmbedder and `ask --model` take it."""
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/tokenizer.json", "w", encoding="utf-8") as f:
            f.write(self.tokenizer)
        with open(f"{folder}/model.safetensors", "wb") as f:
            f.write(self.file())

    def rows(self) -> np.ndarray:
        return self.matrix.astype(np.float32) * self.scale[:, None]

    def vectors(self, coded: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """(keys, embedding) of texts given as token ids."""
        sent, dims = coded.sparkSession.sparkContext.broadcast((self.matrix, self.scale)), self.matrix.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, scale = sent.value
            for batch in id_slices(batches, "ids", SLICE_IDS):
                lists = batch.column("ids")
                ids, sizes = np.asarray(lists.flatten()), np.asarray(pa.compute.list_value_length(lists))
                out = np.zeros((batch.num_rows, dims))
                ends = np.cumsum(sizes)
                for k, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
                    if b > a:  # each distinct token once
                        token, n = np.unique(ids[a:b], return_counts=True)
                        out[k] = (n * scale[token]).astype(np.float32) @ matrix[token].astype(np.float32)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dims)
                found = pa.ListArray.from_arrays(offsets, pa.array(unit(out).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], found], names=[*keys, "embedding"])

        schema = T.StructType([*(coded.schema[k] for k in keys), T.StructField("embedding", T.ArrayType(T.FloatType()))])
        return coded.select(*keys, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, schema)


def learn(coded: DataFrame, tokenizer: str, settle: Settle, dims: int = DIMENSIONS, window: int = WINDOW, rare: float = RARE) -> Model:
    """A model from texts given as token ids. settle: writes a table where all executors can read it, and reads it back.

    rare: a token that makes up this share of all counts has half the weight of a rare one.
    """
    from tokenizers import Tokenizer

    size = Tokenizer.from_str(tokenizer).get_vocab_size()
    if size * (dims + EXTRA) > MAX_NUMBERS:
        raise ValueError(f"{size} tokens of {dims} numbers are more than {MAX_NUMBERS}")
    counts = settle(pair_counts(coded, size, window), "learn-pairs")
    totals = settle(token_totals(counts), "learn-totals")
    rows = settle(information(counts, totals), "learn-rows")
    found = totals.toArrow().sort_by("at")  # a row a token
    token, n = np.asarray(found["i"]), np.asarray(found["n"], np.float64)
    out = np.zeros((size, dims), np.float32)
    if len(token):
        out[token] = leading(rows, len(token), dims) * (rare / (rare + n / n.sum())).astype(np.float32)[:, None]
    top = np.abs(out).max(axis=1)
    scale = np.where(top > 0, top / 127, 1).astype(np.float32)
    return Model(tokenizer, np.round(out / scale[:, None]).astype(np.int8), scale)
