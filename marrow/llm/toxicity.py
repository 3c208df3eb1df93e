"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = 1 / (1 + exp(w.x - cut_k)) with one weight a word, shared by all cuts, and rising
cuts. x says which words (runs of letters, digits and non-ASCII characters, A-Z in lower case), and
which starts of longer words, a text has. Words are told apart by 64-bit numbers, not buckets, so that a long text does not collect other
words' weights. The answer is the expected grade, the most probable grade and its probability.

Fitted on the driver on a sample of the labelled rows: in the order of a hash of their ids as many as `MAX_ROWS` and
`MAX_BYTES` of text allow, one row an id. Both bound what is gathered and broadcast; the features that `MIN_ROWS` of these rows
have are counted in Spark, and the driver gets those alone. Every row is then scored on its whole text, without a shuffle.

Nulls: a null text has no words and gets the cuts' own grade; labels without id or grade are left
out; of several grades of one id the highest counts. Without labels severity and grade are null. Repeated rows are
scored alike; of rows with one id the one whose features come first as bytes is fitted, whatever way they are dealt. Ties:
of equally probable grades the lowest. Empty tables: no rows. Texts of any length are read whole; one that alone
has more than `MAX_BYTES` is not fitted. Of documents only id and text are read, so further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.operators import words
from marrow.llm.common import settled, slices

MAX_ROWS, MAX_BYTES, MIN_ROWS = 20_000, 64_000_000, 4
ROUNDS, RATE = 200, 0.05
#: Bytes of a longer word's start, and those that end its last character.
PREFIX = 5
#: Weight of the absolute penalty, times one over the root of the number of rows, and of the square one.
SPARSE, SMALL = 0.2, 3e-5
SLICE_BYTES = 4_000_000


def features(column: pa.Array) -> list[np.ndarray]:
    """The distinct words of each row as numbers, and those of longer words' starts: `PREFIX` bytes, to the end of a character."""
    data, rows = words.raw(column)
    number, first, end, row = words.numbers(data, rows, blank=words.NO_LETTER)
    if not len(number):
        return [np.zeros(0, np.uint64) for _ in range(len(row) - 1)]
    start = np.zeros(len(number), np.uint64)
    with np.errstate(over="ignore"):
        part = words.byte_numbers(True)
        for k in range(PREFIX):
            start = start * words.BASE + part[data[np.minimum(first + k, len(data) - 1)]]
        stop, inside = first + PREFIX, np.ones(len(first), bool)
        for k in range(PREFIX, PREFIX + 3):
            byte = data[np.minimum(first + k, len(data) - 1)]
            inside &= (first + k < end) & (byte & 0xC0 == 0x80)
            start = np.where(inside, start * words.BASE + part[byte], start)
            stop += inside
        start = words.mixed(start + np.uint64(1))
    long = end > stop
    return [np.unique(np.concatenate([number[a:b], start[a:b][long[a:b]]])) for a, b in zip(row[:-1].tolist(), row[1:].tolist(), strict=True)]


def held(found: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a row's features are in word, which ascends, and their places in it; the time is that of the row, not of word."""
    at = np.searchsorted(word, found)
    known = at < len(word)
    known[known] = word[at[known]] == found[known]
    return known, at[known]


def sums(weight: np.ndarray, found: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The sum of the weights of each row's features."""
    total = np.r_[0.0, np.cumsum(weight[found])]
    return total[row[1:]] - total[row[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def at_most(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade <= k) for each row and each k from the first grade to the last but one, between 0 and 1 columns."""
    inner = sigmoid(cuts[None, :] - score[:, None])
    return np.hstack([np.zeros((len(score), 1)), inner, np.ones((len(score), 1))])


class Model:
    """Words in ascending order of their numbers, their weights, the cuts, and the grades as labelled."""

    def __init__(self, word: np.ndarray, weight: np.ndarray, cuts: np.ndarray, grades: list[int]):
        self.word, self.weight, self.cuts, self.grades = word, weight, cuts, grades

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(self.word, flat), max(0, len(self.word) - 1))
        weight = np.where(self.word[at] == flat, self.weight[at], 0.0) if len(self.word) else np.zeros(len(flat))
        row = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        total = np.r_[0.0, np.cumsum(weight)]
        return np.diff(at_most(total[row[1:]] - total[row[:-1]], self.cuts), axis=1)


def gradient(p: np.ndarray, k: int, flat: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the mean negative log likelihood; p: k weights, the first cut, the logarithms of the gaps between cuts."""
    c = at_most(sums(p[:k], flat, row), cuts_of(p[k:]))
    slope, each = c * (1 - c), np.arange(len(y))
    mass = np.maximum(c[each, y + 1] - c[each, y], 1e-12)
    up, down = slope[each, y + 1] / mass / len(y), slope[each, y] / mass / len(y)
    by_cut = np.bincount(y, weights=down, minlength=c.shape[1]) - np.bincount(y + 1, weights=up, minlength=c.shape[1])
    tail = np.cumsum(by_cut[1:-1][::-1])[::-1]  # a gap moves every later cut
    return np.r_[np.bincount(flat, weights=np.repeat(up - down, np.diff(row)), minlength=k), tail[:1], tail[1:] * np.exp(p[k + 1 :])]


def cuts_of(p: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[p[:1], np.exp(p[1:])])


def descend(p: np.ndarray, k: int, flat: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int, sparse: float, small: float) -> np.ndarray:
    """Gradient steps of adaptive size (Adam), each followed by the absolute penalty's shrinkage of the weights."""
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        g = gradient(p, k, flat, row, y) + np.r_[small * p[:k], np.zeros(len(p) - k)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE / (np.sqrt(v / (1 - 0.999**t)) + 1e-4)
        p = p - step * (m / (1 - 0.9**t))
        if sparse:
            p[:k] = np.sign(p[:k]) * np.maximum(0, np.abs(p[:k]) - sparse * step[:k])
    return p


def fit(rows: list[np.ndarray], labels: list[int], min_rows: int = MIN_ROWS, rounds: int = ROUNDS) -> Model:
    """First with an absolute penalty, which picks words; then those alone, with a small square one."""
    grades = sorted(set(labels))
    y = np.searchsorted(grades, labels)
    word, n = np.unique(np.concatenate(rows), return_counts=True)
    word = word[n >= min_rows]
    share = np.cumsum(np.bincount(y, minlength=len(grades)))[:-1] / len(y)
    start = np.log(share / (1 - share))
    weight, rest = np.zeros(len(word)), np.r_[start[:1], np.log(np.maximum(np.diff(start), 1e-3))]
    for sparse, small in ((SPARSE / np.sqrt(len(y)), 0.0), (0.0, SMALL)) if len(grades) > 1 else ():
        known = [held(r, word)[1] for r in rows]
        flat, row = np.concatenate(known).astype(np.int64), np.r_[0, np.cumsum([len(k) for k in known])].astype(np.int64)
        p = descend(np.r_[weight, rest], len(word), flat, row, y, rounds, sparse, small)
        weight, rest = p[: len(word)], p[len(word) :]
        word, weight = word[weight != 0], weight[weight != 0]
    return Model(word, weight, cuts_of(rest) if len(grades) > 1 else np.zeros(0), [int(x) for x in grades])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade_col: str, max_rows: int, max_bytes: int) -> DataFrame:
    """(id, grade, words) of the labelled rows to fit on, one an id: the same ones however the rows are dealt."""
    grades = labels.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.max("grade").alias("grade"))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # max_rows ids and grades at most: safe to broadcast, and to add up in one task
    some = settled(grades.join(text.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows), "graded")
    sizes = text.join(F.broadcast(some), "id").groupBy("id", "grade").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("bytes"))
    total = F.sum("bytes").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    some = settled(sizes.where(F.col("bytes") <= max_bytes).withColumn("total", total).where(F.col("total") <= max_bytes).select("id", "grade"), "graded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = pa.array([f.tobytes() for f in features(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), found], names=["id", "grade", "words"])

    chosen = text.join(F.broadcast(some), "id").select(F.col("id").cast("string").alias("id"), "grade", "text")
    return settled(chosen.mapInArrow(run, "id string, grade int, words binary").groupBy("id", "grade").agg(F.min("words").alias("words")), "graded-words")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, min_rows: int = MIN_ROWS) -> Model | None:
    """The model of the labelled rows of docs, or None without any."""
    rows = sample(docs, labels, id_col, text_col, grade_col, max_rows, max_bytes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", SLICE_BYTES):
            word, n = np.unique(np.frombuffer(b"".join(batch.column("words").to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    counts = rows.select("words").mapInArrow(counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # at most max_bytes / min_rows features
    often = np.array([r["word"] for r in counts.where(F.col("n") >= min_rows).select("word").toLocalIterator()], np.int64).view(np.uint64)
    often.sort()
    kept = []
    for r in rows.toLocalIterator():
        mine = np.frombuffer(r["words"], np.uint64)
        kept.append((r["id"], r["grade"], mine[held(mine, often)[0]]))
    kept.sort(key=lambda k: k[0])
    return fit([k[2] for k in kept], [k[1] for k in kept], min_rows) if kept else None


def rate(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, severity (the expected grade), grade (the most probable) and its probability, for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, "text", SLICE_BYTES):
            n = batch.num_rows
            if model is None:
                answers = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64())]
            else:
                p, grades = model.probabilities(features(batch.column("text"))), np.array(model.grades)
                best = p.argmax(axis=1)
                answers = [pa.array(p @ grades), pa.array(grades[best].astype(np.int32)), pa.array(p[np.arange(n), best])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *answers], names=[id_col, "severity", "grade", "probability"])

    schema = T.StructType([docs.schema[id_col], T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("probability", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
