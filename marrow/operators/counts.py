"""Counting words inside texts: each text by itself, a slice of an Arrow batch at a time, so that nothing is exchanged, sorted or hashed across texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words counted at a time.
SLICE_WORDS = 500_000


def counted(batch: pa.RecordBatch, column: int, only: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of a batch; of each term and text, in order of both, the numbers and how often; and the lengths of the texts.

    only: the terms that are wanted, which are then the first array whether they occur or not; the lengths are of all.
    """
    lists = batch.column(column)
    of = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(lists).fill_null(0)))
    flat = lists.flatten()
    words, times = (flat.field("term"), np.asarray(flat.field("weight"), np.int64)) if pa.types.is_struct(flat.type) else (flat, np.ones(len(flat), np.int64))
    dl = np.bincount(of, times, batch.num_rows).astype(np.int64)
    if only is None:
        coded = pa.compute.dictionary_encode(words)
        dictionary, code = coded.dictionary.cast(pa.string()), np.asarray(coded.indices, np.int64)
    else:
        dictionary, code = only, np.asarray(pa.compute.index_in(words, only).fill_null(-1), np.int64)
        wanted = np.flatnonzero(code >= 0)
        code, of, times = code[wanted], of[wanted], times[wanted]
    place = code * max(1, batch.num_rows) + of
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(place[order]) > 0][: len(place)])
    code, doc = np.divmod(place[order][first], max(1, batch.num_rows))
    tf = np.add.reduceat(times[order], first) if len(first) else times
    return dictionary, code, doc, tf, dl


def listed(docs: DataFrame, key: tuple[str, ...], words: Column) -> DataFrame:
    """(key, w): the words as they are, or with weights those that count for something."""
    read = docs.select(*key, words.alias("w"))
    if isinstance(read.schema["w"].dataType.elementType, T.StructType):
        read = read.withColumn("w", F.filter("w", lambda x: x["term"].isNotNull() & (x["weight"] > 0)))
    return read


def per_text(docs: DataFrame, key: tuple[str, ...], words: Column, most: int = SLICE_WORDS) -> DataFrame:
    """(key, dl, terms array<struct<term, tf>>) of texts given as array<string> or array<struct<term, weight>>: a row each, terms in the order in which they come first in a batch."""
    width = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends, at = np.cumsum(np.asarray(pa.compute.list_value_length(whole.column(width)).fill_null(0), np.int64)), 0
            while at < whole.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")) - at)
                batch, at = whole.slice(at, n), at + n
                dictionary, code, doc, tf, dl = counted(batch, width)
                order = np.argsort(doc, kind="stable")
                doc, code, tf = doc[order], code[order], tf[order]
                terms = pa.StructArray.from_arrays([dictionary.take(pa.array(code)), pa.array(tf)], names=["term", "tf"])
                starts = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(dl), pa.ListArray.from_arrays(starts, terms)], names=[*key, "dl", "terms"])

    term = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))
    schema = T.StructType([*(docs.schema[k] for k in key), T.StructField("dl", T.LongType()), T.StructField("terms", term)])
    return listed(docs, key, words).mapInArrow(run, schema)
