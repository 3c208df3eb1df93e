"""A folder of markdown notes as a Spark data source: spark.read.format("vault").load(folder).

The driver lists regular files (no links) whose names end in .md in any case, without descending into
skipped folders; executors read them, so the folder must be mounted on all of them. Unlike the built-in
file sources it includes names that begin with `_` or a dot. Files are grouped by size into partitions.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Fixed values.
MAX_FILE = 16 * 1024 * 1024
SKIPPED = frozenset((".obsidian", ".trash", ".git", "node_modules"))
PARTITION_BYTES = 32 * 1024 * 1024
SCHEMA = "path string, content binary, size bigint, mtime_ns bigint"


def skipped(path: str) -> bool:
    """Whether a part of a relative path has exactly a skipped name."""
    return any(part in SKIPPED for part in path.split("/"))


def is_note(path: str) -> bool:
    return path.lower().endswith(".md")


def snapshot(root: str) -> list[tuple[str, int, int]]:
    """(relative path, size, mtime in ns) of every note, in the order of the paths' bytes."""
    found = []

    def failed(e: OSError) -> None:
        raise e

    for folder, folders, names in os.walk(root, onerror=failed):
        folders[:] = [d for d in folders if d not in SKIPPED]
        for name in names:
            path = os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")
            if is_note(name) and not skipped(path):
                s = os.lstat(os.path.join(folder, name))
                if stat.S_ISREG(s.st_mode):
                    found.append((path, s.st_size, s.st_mtime_ns))
    return sorted(found, key=lambda f: os.fsencode(f[0]))


@dataclass
class Files(InputPartition):
    files: tuple[tuple[str, int, int], ...]


class VaultReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        groups: list[list] = [[]]
        total = 0
        for f in snapshot(self.root):
            if groups[-1] and total + f[1] > PARTITION_BYTES:
                groups.append([])
                total = 0
            groups[-1].append(f)
            total += f[1]
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size, mtime in partition.files:
            with open(os.path.join(self.root, path), "rb") as f:
                content = f.read(MAX_FILE + 1)
            if len(content) > MAX_FILE:
                raise ValueError(f"{path}: larger than {MAX_FILE} bytes")
            try:
                content.decode("utf-8")
            except UnicodeDecodeError:
                raise ValueError(f"{path}: not UTF-8") from None
            yield path, content, size, mtime


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str | StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return VaultReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VaultSource)
