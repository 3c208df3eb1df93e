"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct words of a slice of a partition are laid end to end as one array of symbols. An index
maps the rank of every mergeable pair to all its positions; ranks are taken in ascending order from
a heap, each is applied at all its positions at once, and the lists of the pairs that this makes are
extended. Entries that an earlier merge has made stale are recognised when their rank comes up.

A slice holds a bounded number of bytes (one document at least), so memory does not grow with the
partition. There is no shuffle: both operators are narrow.

Nulls: a null text has no ids; null ids decode to the empty text; ids outside the vocabulary are
skipped. Empty tables give empty tables, repeated rows and extra columns pass through unharmed. Texts of any length are
encoded whole, a very long one alone in its slice. Ties: of equal pairs the one further left is merged first.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.llm.common import slices, texts
from marrow.operators.pieces import byte_letters

SLICE_BYTES, HELD = 4_000_000, 250_000
#: Texts of Latin letters and usual signs and blanks, where Python's own patterns find the same words, faster.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*")
# The word pattern of this family of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def latin(pattern: str) -> str:
    """A pattern with the letters and numbers of Latin texts spelt out."""
    for kind in "LN":
        found = "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)
        pattern = re.sub(rf"(\[[^\]]*)\\p\{{{kind}\}}", lambda m: m[1] + found, pattern).replace(rf"\p{{{kind}}}", f"[{found}]")
    return pattern


class Vocabulary:
    """Merges by rank, the bytes of each id, and the special texts of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = np.array([vocab[x] for x in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.size = 1 + max([*vocab.values(), *(x["id"] for x in spec.get("added_tokens", []))])
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        byte = {x: b for b, x in enumerate(letters)}
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[x] for x in token) if all(x in byte for x in token) else token.encode()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words, self.latin = regex.compile(WORDS), re.compile(latin(WORDS))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it does not merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Rank of a pair -> all positions where it may stand, over one array of symbols."""

    def __init__(self, v: Vocabulary, symbols: np.ndarray, ends: np.ndarray):
        """ends: for each word the position after its last symbol."""
        n = len(symbols)
        self.v, self.sym = v, symbols
        self.next = np.arange(1, n + 1)
        self.prev = np.arange(-1, n - 1)
        self.next[ends - 1] = -1
        self.prev[0] = -1
        self.prev[ends[:-1]] = -1
        self.alive = np.ones(n, bool)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.add(np.flatnonzero(self.next >= 0))

    def add(self, at: np.ndarray) -> None:
        if len(at) <= 4:
            for i in at.tolist():
                r = self.v.rank_of.get(int(self.sym[i]) * self.v.size + int(self.sym[self.next[i]]))
                if r is not None:
                    self.put(r, np.array([i]))
            return
        rank = self.v.rank(self.sym[at], self.sym[self.next[at]])
        known = rank >= 0
        at, rank = at[known], rank[known]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
            self.put(r, part)

    def put(self, rank: int, at: np.ndarray) -> None:
        if rank in self.lists:
            self.lists[rank].append(at)
        else:
            self.lists[rank] = [at]
            heapq.heappush(self.heap, rank)

    def run(self) -> np.ndarray:
        """Apply every active rank, lowest first; the positions that still hold a symbol."""
        sym, nxt, prev, alive = self.sym, self.next, self.prev, self.alive
        while self.heap:
            r = heapq.heappop(self.heap)
            lists = self.lists.pop(r)
            at = lists[0] if len(lists) == 1 and len(lists[0]) == 1 else np.unique(np.concatenate(lists))
            a, b = self.v.left[r], self.v.right[r]
            after = nxt[at]
            stands = alive[at] & (after >= 0) & (sym[at] == a) & (sym[after] == b)
            at, after = at[stands], after[stands]
            if a == b and len(at) > 1:  # of overlapping pairs every second one, from the left
                first = np.r_[True, after[:-1] != at[1:]]
                place = np.arange(len(at))
                keep = (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
                at, after = at[keep], after[keep]
            if not len(at):
                continue
            sym[at] = self.v.made[r]
            alive[after] = False
            beyond = nxt[after]
            nxt[at] = beyond
            more = beyond >= 0
            prev[beyond[more]] = at[more]
            before = prev[at]
            self.add(np.concatenate([before[before >= 0], at[more]]))
        return np.flatnonzero(alive)


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end, and where each word starts (one entry more than words). No word is empty."""
    raw = [w.encode() for w in words]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    if not len(ends):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    index = PairIndex(v, v.byte_id[np.frombuffer(b"".join(raw), np.uint8)], ends)
    left = index.run()
    return index.sym[left], np.r_[0, np.searchsorted(left, ends)]


class Encoder:
    """Encodes texts; keeps up to about HELD words that it has met, so that each is merged once."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.index: defaultdict = defaultdict()
        self.index.default_factory = self.index.__len__
        self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def words(self, text: str) -> list:
        """The words of a text; a special text is a tuple, which never equals a word."""
        find = (self.v.latin if PLAIN.fullmatch(text) else self.v.words).findall
        if not self.v.split or not any(s in text for s in self.v.special):
            return find(text)
        out: list = []
        for part in self.v.split.split(text):
            out += [(part,)] if part in self.v.special else find(part)
        return out

    def learn(self, new: list) -> None:
        plain = [w for w in new if isinstance(w, str)]
        ids, starts = encode_words(self.v, plain)
        size = np.diff(starts)
        if len(plain) < len(new):
            parts = iter(np.split(ids, starts[1:-1]) if plain else [])
            each = [next(parts) if isinstance(w, str) else np.array([self.v.special[w[0]]], np.int32) for w in new]
            ids, size = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        self.ids, self.size = np.r_[self.ids, ids], np.r_[self.size, size]

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text starts (one entry more than texts)."""
        if len(self.index) > HELD:
            self.forget()
        known, found, counts = len(self.index), [], []
        for text in batch:
            words = self.words(text)
            found.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
            counts.append(len(words))
        if len(self.index) > known:
            self.learn(list(islice(self.index, known, None)))
        where = np.concatenate(found) if found else np.zeros(0, np.int32)
        sizes = self.size[where]
        starts = np.cumsum(self.size) - self.size
        stops = np.cumsum(sizes)
        flat = self.ids[np.repeat(starts[where] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        return flat, np.r_[0, stops][np.r_[0, np.cumsum(counts)].astype(np.int64)]


def encode_texts(v: Vocabulary, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return Encoder(v).encode(batch)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) of each row's whole text; no special ids are added, special texts become their id.

    decoded: also this column, the text that the ids decode to, in the same pass.
    """
    path = path or tokenizer_path()
    names = [id_col, "ids", *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        coder = Encoder(v)
        for batch in slices(batches, "text", SLICE_BYTES):
            flat, bounds = coder.encode(texts(batch))
            columns = [batch.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))]
            if decoded:
                columns.append(pa.array([decode_ids(v, flat[a:b].tolist()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*fields, *([T.StructField(decoded, T.StringType())] if decoded else [])])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    known, n = v.bytes, v.size
    try:
        raw = b"".join([known[i] for i in ids])
        if ids and min(ids) < 0:
            raise IndexError
    except IndexError:
        raw = b"".join([known[i] for i in ids if 0 <= i < n])
    return raw.decode("utf-8", "replace")


def decode(coded: DataFrame, path: str | None = None, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """coded with the text that its ids stand for, special ids included; bytes that are no UTF-8 become U+FFFD."""
    path = path or tokenizer_path()
    names = coded.columns
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    schema = T.StructType([*coded.schema.fields, T.StructField(to, T.StringType())])
    at = f"c{names.index(ids_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = pa.array([decode_ids(v, x or []) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*names, to])

    return coded.select(*kept).mapInArrow(run, schema)
