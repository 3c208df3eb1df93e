"""What the operators of this package share: tables, shared-folder tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.operators.batches import slices
from marrow.session import shared_dir

__all__ = ["fold", "settled", "shared_dir", "slices", "table", "texts", "tree_sum"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, each executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo of; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def tree_sum(parts: DataFrame, size: int, dtype: str = "f8", most: int | None = None) -> np.ndarray:
    """The sum of vectors of `size` numbers, one binary of `dtype` a row; sixteen tasks' rows are added up at a time.

    most: larger sums count as that (for numbers of few bytes). parts must be written already.
    """
    wide = "f8" if dtype[0] == "f" else "i8"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, wide)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), dtype)
        out = (total if most is None else np.minimum(total, most)).astype(dtype).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["x"])

    while (tasks := parts.rdd.getNumPartitions()) > 16:
        parts = settled(parts.coalesce(-(-tasks // 16)).mapInArrow(add, "x binary"), "sums")
    one = parts.coalesce(1).mapInArrow(add, "x binary").collect()
    return np.frombuffer(one[0]["x"], dtype).astype(wide) if one else np.zeros(size, wide)
