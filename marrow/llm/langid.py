"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vectors of three neighbouring letters, the first
rotated by two places and the second by one, are multiplied into the vector of that trigram; a text
is the sum of its trigrams' vectors, a language the sum of its training texts, each scaled to the same
length so that no long one outweighs the others. The answer is the
language whose vector has the largest cosine with the text's.

Everything that is not a letter counts as one boundary symbol. Letters other than a-z share a fixed
number of vectors by a hash of their code point, so tables stay bounded in any script. All sums are
sums of integers (scaled texts are rounded): results do not depend on how rows are dealt out. Training gathers one row of
`DIMENSIONS` integers for each language and task; prediction broadcasts that for each language
(`MAX_LANGUAGES` at most, which is checked).

A text that is null or has no letter is `und` with score 0, as is every text if nothing was learned.
Ties go to the language that sorts first. Rows with a null language are not trained on. Repeated rows are predicted alike, and
trained on as often as they stand. Empty tables: no rows, or no language. Texts of any length are read whole. Letters beyond a-z
that share a vector look alike; there are 101 for all scripts together. Columns to keep may have any names but those of the answers.

`cutoffs` says which score a text of some length needs to be in a learned language at all: the score that all but
`MISSED` of the held-out labelled texts of that length reach, and in no case less than `FLOOR`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.llm.common import slices, texts

DIMENSIONS = 1024
SYMBOLS = 128
SEED = 20240611
SCALE = 1 << 20
SLICE_BYTES, SLICE_ROWS = 800_000, 200
MAX_LANGUAGES = 4096
UNKNOWN = "und"
#: Lengths count as powers of two of trigrams; each has a cutoff.
LENGTHS = 40
#: A cutoff loses so many of the labelled texts that it is taken from, which are so many at least (or all that are not longer).
MISSED, LEAST_HELD = 0.001, 200
#: Twice the standard deviation of the cosine of unrelated vectors.
FLOOR = 2 / DIMENSIONS**0.5
STEPS = 4096


@lru_cache(maxsize=1)
def symbol_of() -> np.ndarray:
    """For each code point: 0 if it is no letter, 1 to 26 for a to z, else one of the others."""
    out = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.uint64)
    out[letters.astype(np.int64)] = 27 + ((letters * np.uint64(2654435761)) >> np.uint64(13)) % np.uint64(SYMBOLS - 27)
    out[97:123] = np.arange(1, 27)
    return out


@lru_cache(maxsize=4)
def letter_vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols' vectors, rotated by two, one and no places."""
    own = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
    return np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own


def trigram_counts(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the trigram of each place, and the distinct trigrams to which the latter refers."""
    low = [f" {t.lower()} " for t in batch]
    codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
    sym = symbol_of()[codes].astype(np.int64)
    keep = np.r_[True, (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])] if len(sym) else np.zeros(0, bool)
    sym, doc = sym[keep], doc[keep]
    same = doc[2:] == doc[:-2]
    gram = ((sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:])[same]
    doc = doc[2:][same]
    seen = np.bincount(gram, minlength=SYMBOLS**3) > 0
    seen[: SYMBOLS] = False  # boundary, boundary, letter: where one text ends and none follows
    distinct = np.flatnonzero(seen)
    place = np.full(SYMBOLS**3, -1, np.int32)
    place[distinct] = np.arange(len(distinct))
    at = place[gram]
    return doc[at >= 0], at[at >= 0], distinct


def trigram_vectors(distinct: np.ndarray, dimensions: int) -> np.ndarray:
    a, b, c = letter_vectors(dimensions)
    return (a[distinct // SYMBOLS**2] * b[distinct // SYMBOLS % SYMBOLS] * c[distinct % SYMBOLS]).astype(np.float32)


def bundles(batch: list[str], group: np.ndarray, groups: int, dimensions: int) -> np.ndarray:
    """The sum of the trigram vectors of the texts of each group."""
    return bundled(*trigram_counts(batch), group, groups, dimensions)


def bundled(doc: np.ndarray, at: np.ndarray, distinct: np.ndarray, group: np.ndarray, groups: int, dimensions: int) -> np.ndarray:
    counts = np.bincount(group[doc] * len(distinct) + at, minlength=groups * len(distinct)).reshape(groups, -1)
    return counts.astype(np.float32) @ trigram_vectors(distinct, dimensions) if len(distinct) else np.zeros((groups, dimensions), np.float32)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, list[int]]:
    """The vector of each language of the labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in _small(batches):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            index = {x: i for i, x in enumerate(names)}
            each = bundles(texts(batch), np.arange(batch.num_rows), batch.num_rows, dimensions).astype(np.float64)
            size = np.linalg.norm(each, axis=1, keepdims=True)
            each = np.rint(each * (SCALE / np.where(size > 0, size, 1))).astype(np.int64)
            sums = np.zeros((len(names), dimensions), np.int64)
            np.add.at(sums, [index[x] for x in langs], each)
            for x, row in zip(names, sums, strict=True):
                total[x] = total.get(x, 0) + row
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "vector"])

    parts = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = parts.mapInArrow(run, "lang string, vector array<bigint>").select("lang", F.posexplode("vector").alias("k", "x"))
    sums = parts.groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vector")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    return {r["lang"]: r["vector"] for r in rows if any(r["vector"])}


def added(*parts: dict[str, list[int]]) -> dict[str, list[int]]:
    """The vectors learned from all rows from those learned from parts of them."""
    names = sorted({x for p in parts for x in p})
    return {x: [sum(v) for v in zip(*(p[x] for p in parts if x in p), strict=True)] for x in names}


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), size_col: str | None = None) -> DataFrame:
    """id_col, the columns to keep, lang_pred and score (the cosine, 0 at least) of each row's whole text; size_col: its number of trigrams."""
    names = sorted(profiles)
    matrix = np.array([profiles[x] for x in names], np.float64)
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True) if names else np.zeros((0, DIMENSIONS))
    sent = docs.sparkSession.sparkContext.broadcast(matrix)
    own = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in _small(batches):
            doc, at, distinct = trigram_counts(texts(batch))
            sums = bundled(doc, at, distinct, np.arange(batch.num_rows), batch.num_rows, known.shape[1]).astype(np.float64)
            size = np.linalg.norm(sums, axis=1)
            cosine = sums @ known.T / np.where(size > 0, size, 1)[:, None]
            some = (size > 0) & (len(names) > 0)
            best = cosine.argmax(axis=1) if names else np.zeros(batch.num_rows, int)
            lang = [names[k] if yes else UNKNOWN for k, yes in zip(best, some, strict=True)]
            score = np.where(some, np.clip(cosine[np.arange(len(best)), best] if names else 0.0, 0, 1), 0.0)
            kept = [batch.column(f"c{i}") for i in range(len(own))]
            more = [pa.array(np.bincount(doc, minlength=batch.num_rows), pa.int64())] if size_col else []
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), *more], names=[*own, "lang_pred", "score", *sized])

    sized = [size_col] if size_col else []
    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in sized)])
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]
    return docs.select(*cols, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def length_of(size: Column) -> Column:
    return F.least(F.floor(F.log2(size + 1)), F.lit(LENGTHS - 1)).cast("int")


def cutoffs(*held: tuple[DataFrame, dict[str, list[int]]], text_col: str = "text", lang_col: str = "lang") -> list[float]:
    """The least score of a text in a language, for each length, from labelled texts and profiles that have not learned them.

    A length with few texts takes the next shorter ones in, whose scores are lower.
    """
    seen = np.zeros((LENGTHS, STEPS + 1), np.int64)  # of fixed size, as are the rows that come back
    step = F.floor(F.col("score") * STEPS).cast("int")
    for docs, profiles in held:
        found = predict(docs.where(F.col(lang_col).isNotNull()), profiles, lang_col, text_col, size_col="size").where(F.col("lang_pred") != UNKNOWN)
        for r in found.groupBy(length_of(F.col("size")).alias("length"), step.alias("step")).agg(F.count("*").alias("k")).collect():
            seen[r["length"], r["step"]] += r["k"]
    out = []
    for i in range(LENGTHS):
        first = i
        while first and seen[first : i + 1].sum() < LEAST_HELD:
            first -= 1
        below = np.cumsum(seen[first : i + 1].sum(axis=0))
        reached = int(np.searchsorted(below, int(MISSED * below[-1]), side="right")) if below[-1] else 0
        out.append(max(FLOOR, reached / STEPS))
    return out
