"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all benchmark items.

Texts are normalised byte by byte (A-Z to a-z, other ASCII that is no letter or digit to a blank), so
an offset in the normalised text is the offset in the original. The automaton's letters are words: those
of the benchmark have numbers. One scan of a text finds every occurrence of every window; stretches with fewer words of the
benchmark side by side than a window has are passed over. Runs of hit words come back as code point spans of the original text.

A node takes about `NODE_BYTES`, a word of a window is at most one, so a benchmark has at most ten times as many nodes
as words. Its words are counted first; beyond `max_nodes` the windows are dealt to
several automata, which scan the texts one after the other with the hits carried along, so that
memory stays bounded, on the driver as well, and the result is the same; long items are cut for that, with
overlapping ends, so that no window is lost. A worker builds an automaton once, whatever tasks it has.

Nulls: a null text has no words; an item with a null text or no word has no window; the hits of an
item with a null id count, its id is not listed. Repeated items count once, repeated rows stay; of a window that
several items have all are listed. Empty tables: no rows, or no hits. Texts of any length are scanned whole, one at a
time. Columns are handled by place, so those to keep may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.llm.common import settled, slices

WINDOW = 10
MAX_NODES, NODE_BYTES = 3_000_000, 48
#: Words of an item in one piece, and bytes of texts in one slice.
PIECE, SLICE_BYTES = 10_000, 4_000_000
#: What each byte becomes: letters in lower case, digits and bytes of other characters themselves, the rest a blank.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RUN = re.compile(rb"[^ ]+")
HITS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
PA_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
PA_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLDED).split()


class Machine:
    """Finds the windows of items in texts."""

    def __init__(self, pieces: list[tuple[str | None, str]], size: int):
        """pieces: an item's id and normalised words of its text; all its runs of `size` words are windows, or all words if they are fewer."""
        self.number: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in pieces if item is not None})
        which = {item: i for i, item in enumerate(self.items)}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        #: Of each word how many words the shortest window has that has it.
        self.least: dict[bytes, int] = {}
        #: Of each window how many words it has, and which items.
        self.words: list[int] = []
        self.of: list[tuple[int, ...]] = []
        for item, text in pieces:
            w = tuple(self.number.setdefault(x, len(self.number) + 1) for x in text.encode().split(b" "))
            own = () if item is None else (which[item],)
            n = min(255, len(w), size)
            for x in set(text.encode().split(b" ")):
                self.least[x] = min(n, self.least.get(x, n))
            for i in range(max(1, len(w) - size + 1)):
                window = w[i : i + size]
                at = self.found.get(window, -1)
                if at < 0:
                    self.found.add_word(window, len(self.of))
                    self.words.append(len(window))
                    self.of.append(own)
                elif own and own[0] not in self.of[at]:
                    self.of[at] += own
        if self.of:
            self.found.make_automaton()
        #: A window of n words stands where n words side by side have n or less.
        self.runs = [re.compile(b"[\\x01-\\x%02x]{%d,}" % (n, n)) for n in sorted({min(255, n) for n in self.words})]

    def stretches(self, folded: list[bytes]) -> list[tuple[int, int]]:
        """The stretches of words where a window can stand; all others have a word too few of the benchmark."""
        level = bytes(map(self.least.get, folded, repeat(0)))
        found = sorted(m.span() for run in self.runs for m in run.finditer(level))
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def find(self, folded: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, last, counted from 0) and the ids of the items that occur."""
        number, runs, which = self.number, [], set()
        for first, last in self.stretches(folded):
            for end, at in self.found.iter(tuple([number[w] for w in folded[first:last]])):
                runs.append((first + end - self.words[at] + 1, first + end))
                which.add(at)
        return merged(runs), {self.items[i] for at in which for i in self.of[at]}


_machines: dict[str, Machine] = {}


def machine(key: str, pieces: list, size: int) -> Machine:
    """The machine of a worker, built when the first of its tasks asks for it; only the last one is kept."""
    if key not in _machines:
        _machines.clear()
        _machines[key] = Machine(pieces, size)
    return _machines[key]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original of runs of words."""
    raw = text.encode()
    place = [m.span() for m in RUN.finditer(raw.translate(FOLDED))]
    chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return [(int(chars[place[a][0]]), int(chars[place[b][1]])) for a, b in runs]


def cut(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, text, n) of the normalised words of every item, long ones in pieces that overlap by all but one word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(text)
                for at in range(0, max(1, len(w) - size + 1) if w else 0, PIECE):
                    part = w[at : at + PIECE + size - 1]
                    out.append((item, b" ".join(part).decode(), len(part)))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["item", "text", "n"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return items.mapInArrow(run, "item string, text string, n bigint").distinct()


def _pass(df: DataFrame, kept: list, pieces: list, size: int, last: bool) -> tuple[DataFrame, Broadcast]:
    """df (the kept columns, text, hits, items) scanned for the items; the last pass gives spans instead of the text."""
    sent = df.sparkSession.sparkContext.broadcast(pieces)
    key = hashlib.sha256(repr((size, pieces)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = machine(key, sent.value, size)
        for batch in slices(batches, "text", SLICE_BYTES):
            counts, hits, ids, where = [], [], [], []
            old = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, (runs, known) in zip(batch.column("text").to_pylist(), old, strict=True):
                folded = words(text)
                new, items = found.find(folded)
                runs = merged([*((x["first"], x["last"]) for x in runs or []), *new])
                counts.append(len(folded))
                hits.append([{"first": a, "last": b} for a, b in runs])
                ids.append(sorted(items.union(known or [])))
                if last:
                    where.append([{"start": a, "end": b} for a, b in spans(text, runs)] if runs else [])
            columns = [pa.array(where, PA_SPANS) if last else batch.column("text"), pa.array(hits, PA_HITS), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k.name) for k in kept), pa.array(counts, pa.int64()), *columns], names=[*(k.name for k in kept), "n_words", "spans" if last else "text", "hits", "items"])

    text = T.StructField("spans", SPANS) if last else T.StructField("text", T.StringType())
    schema = [*kept, T.StructField("n_words", T.LongType()), text, T.StructField("hits", HITS), T.StructField("items", T.ArrayType(T.StringType()))]
    return df.select(*(k.name for k in kept), "text", "hits", "items").mapInArrow(run, T.StructType(schema)), sent


def scan(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, max_nodes: int = MAX_NODES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of docs: id_col, the columns to keep, n_words, n_hit, items (ids as text, sorted), spans (code points of the original)."""
    pieces = settled(cut(benchmark, item_col, item_text_col, size), "benchmark-words")
    total = size * (pieces.agg(F.sum("n")).first()[0] or 0)
    shards = 1 if total <= max_nodes else 2 * -(-total // max_nodes)
    own = [id_col, *keep]
    kept = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(own)]
    df = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.col(text_col).cast("string").alias("text"), F.lit(None).cast(HITS).alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for k in range(shards):
        part = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        # a shard has max_nodes / size words, about: safe to gather and broadcast
        df, sent = _pass(df, kept, sorted(((r["item"], r["text"]) for r in part.collect()), key=str), size, k == shards - 1)
        if k < shards - 1:
            df = settled(df, "decontaminate")
            sent.destroy()
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "n_words", hit.alias("n_hit"), "items", "spans")
