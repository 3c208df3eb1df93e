"""Embedders: texts to vectors of 256 single-precision numbers of length one (zero for an empty text)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.operators.batches import slices

DIMENSIONS = 256
SLICE_BYTES = 4_000_000


class Embedder(Protocol):
    """name identifies what the vectors depend on; an index built with another one is stale."""

    name: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(size > 0, size, 1)).astype(np.float32)


class HashEmbedder:
    """Sums of signed words in hashed places: deterministic, needs no model; for tests and where none is installed."""

    name = "hash-256"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSIONS))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = crc32(word.encode())
                row[h % DIMENSIONS] += 1 if h & 0x80000000 else -1
        return unit(out)


class StaticEmbedder:
    """The mean of a static vector for each token: tokenizer.json and a safetensors file with one matrix in a folder."""

    def __init__(self, folder: str):
        self.folder, self.loaded = folder, None
        tensors = next(Path(folder).glob("*.safetensors"))
        self.name = f"static-{crc32(tensors.read_bytes()):08x}"

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "name": self.name, "loaded": None}

    def load(self) -> tuple:
        if self.loaded is None:  # once a Python worker
            from tokenizers import Tokenizer

            raw = next(Path(self.folder).glob("*.safetensors")).read_bytes()
            head = 8 + int.from_bytes(raw[:8], "little")
            tensors = {k: v for k, v in json.loads(raw[8:head]).items() if k != "__metadata__"}
            kinds = {"F32": np.float32, "F16": np.float16, "I8": np.int8}
            arrays = {k: np.frombuffer(raw[head + v["data_offsets"][0] : head + v["data_offsets"][1]], kinds[v["dtype"]]).reshape(v["shape"]) for k, v in tensors.items()}
            matrix = next(a for a in arrays.values() if a.ndim == 2).astype(np.float32)
            for a in arrays.values():  # a scale for each row, of quantised matrices
                if a.ndim == 1 and len(a) == len(matrix):
                    matrix = matrix * a[:, None].astype(np.float32)
            self.loaded = Tokenizer.from_file(f"{self.folder}/tokenizer.json"), matrix
        return self.loaded

    def embed(self, texts: list[str]) -> np.ndarray:
        tokenizer, matrix = self.load()
        rows = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        return unit(np.stack([matrix[ids].mean(axis=0) if ids else np.zeros(matrix.shape[1], np.float32) for ids in rows]) if rows else np.zeros((0, matrix.shape[1])))


def embed(df: DataFrame, keys: tuple[str, ...], text: Column, embedder: Embedder) -> DataFrame:
    """(keys, embedding array<float>), a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            vectors = embedder.embed([x or "" for x in batch.column(len(keys)).to_pylist()])
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * vectors.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists], names=[*keys, "embedding"])

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return df.select(*keys, F.coalesce(text.cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)
