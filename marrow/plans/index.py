"""The persisted index of a vault: Parquet tables, a manifest, and a pointer to the version in force.

A build writes a new version folder and then replaces the pointer file in one rename, so a reader sees
the old version or the new one. The cache folder is on a file system of the driver; the tables are
read by executors, so on a cluster it is a shared mount, as the vault itself.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import shutil
import sys
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions.text import dense_text, repeated_tokens, sparse_fields
from marrow.operators import blockmax, bm25, embed, notes
from marrow.sources import vault

SCHEMA_VERSION = 3
KEY = ("path", "chunk_seq")
TABLES = ("notes", "chunks", "vectors", "postings", "doc_len", "terms", "stats", "blocks")


class VaultError(ValueError):
    """A vault with a note that cannot be read."""


@dataclass(frozen=True)
class Index:
    notes: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    sparse: bm25.Postings
    blocks: blockmax.Blocks
    chunk_count: int


@dataclass(frozen=True)
class Status:
    """hit, or rebuild with a reason and the milliseconds it took."""

    kind: str
    reason: str | None = None
    ms: int = 0


def write(spark: SparkSession, files: DataFrame, folder: str, embedder: embed.Embedder) -> None:
    """Write all tables under folder; each is made from what the ones before have written. Raises VaultError."""
    uri = f"file://{folder}" if folder.startswith("/") else folder
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{uri}/{name}")
    get = lambda name: spark.read.parquet(f"{uri}/{name}")
    put(notes.parse(files), "parsed")
    parsed = get("parsed")
    if error := notes.first_error(parsed):
        raise VaultError(error)
    kept = parsed.drop("chunks", "error")
    put(kept, "notes")
    put(notes.chunk_rows(parsed), "chunks")
    enriched = get("chunks").join(get("notes"), "path")
    words = repeated_tokens(sparse_fields())
    text = dense_text(*(F.col(c) for c in ("name", "title", "aliases", "h1", "heading_trail", "body")))
    put(embed.embed(enriched, KEY, text, embedder), "vectors")
    # sorted by term, so that a query's terms read few row groups; a frequent term is dealt to many tasks
    put(bm25.term_counts(enriched, KEY, words).repartitionByRange("term", *KEY).sortWithinPartitions("term", *KEY), "postings")
    put(bm25.doc_lengths(enriched, KEY, words), "doc_len")
    put(bm25.document_frequency(get("postings")), "terms")
    put(bm25.corpus_stats(get("doc_len")), "stats")
    # in the order of the chunks, so that those of a note share their slabs
    put(blockmax.blocks(enriched, KEY, words), "blocks")
    shutil.rmtree(f"{folder}/parsed", ignore_errors=True)


def open_index(spark: SparkSession, folder: str) -> Index:
    """Raises if a table is missing or the tables disagree: one scan of a few columns each tells counts, sums and hashes of keys."""
    uri = f"file://{folder}" if folder.startswith("/") else folder
    get = lambda name: spark.read.parquet(f"{uri}/{name}")
    found = {name: get(name) for name in TABLES}
    keys = [F.count("*"), F.bit_xor(F.xxhash64(*KEY))]
    told = {name: found[name].agg(*keys, *more).first() for name, more in (("chunks", ()), ("vectors", ()), ("doc_len", (F.sum("dl"),)), ("postings", (F.sum("tf"),)))}
    held = found["blocks"].agg(F.sum(F.when(F.col("term").isNull(), F.col("df"))), F.sum(F.when(F.col("term").isNotNull(), F.col("df")))).first()
    terms = found["terms"].agg(F.sum("df")).first()
    stats = found["stats"].first()
    if (held[0] or 0, held[1] or 0) != (told["chunks"][0], told["postings"][0]):
        raise ValueError("index is damaged")
    whole = (tuple(told["chunks"]), tuple(told["chunks"]), told["doc_len"][2] or 0, told["postings"][0], told["chunks"][0])
    if not stats or whole != (tuple(told["vectors"]), tuple(told["doc_len"])[:2], told["postings"][2] or 0, terms[0] or 0, stats["doc_count"]):
        raise ValueError("index is damaged")
    if found["chunks"].join(found["notes"], "path", "left_anti").limit(1).count():
        raise ValueError("index is damaged")
    sparse = bm25.Postings(KEY, found["postings"], found["doc_len"], found["terms"], found["stats"])
    blocks = replace(blockmax.opened(found["blocks"], KEY), doc_len=found["doc_len"], stats=found["stats"])
    return Index(found["notes"], found["chunks"], found["vectors"], sparse, blocks, stats["doc_count"])


def cache_base() -> str:
    """Where each system keeps caches."""
    if sys.platform == "darwin":
        return os.path.expanduser("~/Library/Caches")
    return os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache")


def cache_key(path: str) -> str:
    return hashlib.sha256(os.fsencode(path)).hexdigest()


def manifest_of(root: str, files: list[tuple[str, int, int]], chunk_count: int, embedder: embed.Embedder, version: str) -> dict:
    listed = [{"path": p, "size": s, "mtime_ns": m} for p, s, m in files]
    return {"schema": SCHEMA_VERSION, "vault_path": root, "embedder": embedder.name, "note_count": len(files), "chunk_count": chunk_count, "version": version, "files": listed}


def read_manifest(path: str) -> dict | None:
    """The manifest, or None if any part of it is not as written."""
    try:
        with open(path, encoding="utf-8") as f:
            m = json.load(f)
        kinds = {"schema": int, "vault_path": str, "embedder": str, "note_count": int, "chunk_count": int, "version": str, "files": list}
        if not all(type(m[k]) is kind for k, kind in kinds.items()):
            return None
        if not all(type(f["path"]) is str and type(f["size"]) is int and type(f["mtime_ns"]) is int for f in m["files"]):
            return None
        return m
    except (OSError, ValueError, KeyError, TypeError):
        return None


def fresh(manifest: dict | None, root: str, embedder: embed.Embedder) -> bool:
    """Whether the vault's notes still are what the manifest lists."""
    if not manifest or (manifest["schema"], manifest["vault_path"], manifest["embedder"]) != (SCHEMA_VERSION, root, embedder.name):
        return False
    try:
        now = vault.snapshot(root)
    except OSError:
        return False
    return manifest["note_count"] == len(now) and [(f["path"], f["size"], f["mtime_ns"]) for f in manifest["files"]] == now


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two tables of files (path, size, mtime_ns): added, removed or changed."""
    a = before.select("path", F.struct("size", "mtime_ns").alias("a"))
    b = after.select("path", F.struct("size", "mtime_ns").alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change")).where("change IS NOT NULL")


@contextmanager
def locked(folder: str) -> Iterator[None]:
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def why(folder: str, manifest: dict | None) -> str:
    if not os.path.exists(f"{folder}/manifest.json"):
        return "missing manifest"
    if manifest and not os.path.isdir(f"{folder}/{manifest['version']}"):
        return "missing index.bin"
    return "stale or incompatible cache"


def load_or_build(spark: SparkSession, root: str, embedder: embed.Embedder, base: str | None = None) -> tuple[Index, Status]:
    """The index of a vault, from the cache if nothing has changed. A damaged cache is rebuilt; a failed build leaves the cache as it was."""
    root = os.path.realpath(root)
    folder = os.path.join(base or cache_base(), "marrow", cache_key(root))
    began = time.monotonic()
    with locked(folder):
        path = f"{folder}/manifest.json"
        manifest = read_manifest(path)
        if fresh(manifest, root, embedder):
            try:
                found = open_index(spark, f"{folder}/{manifest['version']}")
                if found.chunk_count == manifest["chunk_count"]:
                    return found, Status("hit")
            except Exception:  # noqa: BLE001  a damaged cache, whatever its damage, is rebuilt
                pass
        reason = why(folder, manifest)
        vault.register(spark)
        files = vault.snapshot(root)  # before reading: a note that changes meanwhile makes the index stale
        version = f"v-{uuid.uuid4().hex}"
        try:
            write(spark, spark.read.format("vault").load(root), f"{folder}/{version}", embedder)
            found = open_index(spark, f"{folder}/{version}")
        except Exception:
            shutil.rmtree(f"{folder}/{version}", ignore_errors=True)
            raise
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            json.dump(manifest_of(root, files, found.chunk_count, embedder, version), f)
        os.replace(f"{path}.new", path)
        for old in os.listdir(folder):
            if old.startswith("v-") and old != version:
                shutil.rmtree(f"{folder}/{old}", ignore_errors=True)
        return found, Status("rebuild", reason, int((time.monotonic() - began) * 1000))
