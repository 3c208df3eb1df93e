"""Token ids in binary files: an adaptive context-mixing range coder in reset, checksummed blocks.

Ids are written in ascending order of document id. A file row is a frame of whole documents, up to
`BLOCK` times `LANES` ids (a longer document has a longer frame). A frame's head holds the alphabet of
its ids; its ids are cut into blocks. A block starts from the same model as every other, has its own crc32, and
can be decoded, and checked, alone. All blocks of a frame are coded side by side, a step of each at a
time, as vectors.

Three orders of context predict an id. The id last seen after the last two ids (order 2) and the one last
seen after the last id (order 1) are predictions with a confidence each; for every pair of confidences
the block mixes a distribution over "order 2 is right", "order 1 is right" and "neither", which adapts
with each id. Where neither is right, the ids' frequencies in the frame (order 0) are weighed by a
distribution over `CLASSES` classes of ids. That is a mixture of three which adapt within the block:
of order 0, of order 1 (given the class of the last id) and of order 2 (given the classes of the last two). Ids
often found side by side are in one class, so classes tell languages and parts of words apart. Only the lanes where
neither prediction is right go through the classes. Both choices together narrow the range of the block's coder
once, whose low end and span have 64 bits and which sends words of 16.

The rows are Parquet rows written by Spark (its commit makes a lost task harmless): shard, frame,
at (ids of the shard before the frame), doc_ids, sizes and the binary frame. Shards are ranges of
document ids, and of text hashes within one id, so that rows of one id can be dealt to many; the ids
before a shard are a sum over one row a shard.

Nulls: a null text is empty and has only the end id; null document ids come first. Rows with the same
id stand next to each other, in the order of a hash of their texts. An empty table gives no frame and
reads back empty. Very long texts are one frame. Only id and text are read, so further columns may have
any names. A block whose checksum differs, or a frame that is cut short, raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.llm.bpe import tokenizer_path
from marrow.llm.common import settled, slices
from marrow.operators.pieces import Words

#: Ids of a block at most, and blocks that a frame has where it can; a smaller frame has smaller blocks, of LEAST ids at least.
BLOCK, LANES, LEAST = 1024, 4096, 512
END = 1
SLICE_BYTES = 2_000_000
#: Places for predictions in a block (a power of two).
SLOTS = 512
CLASSES = 8
#: Totals of the three kinds of distributions; ids of a class share 2**INNER_BITS, or more where it has many ids.
EVENT_BITS, CLASS_BITS, INNER_BITS = 12, 13, 13
RATE = 4
#: Order 0, 1 and 2 count so many times in the mixture of classes; the sum is 4.
MIX_BITS = CLASS_BITS + 2
MAX_VOCABULARY = 1 << 22
#: Neighbours from which the order of the alphabet is found; any order decodes alike.
NEIGHBOURS, TURNS = 1 << 18, 8
MAGIC = b"MRWG"
HEAD = struct.Struct("<4sIIIIII")
MAX_BROADCAST_SHARDS = 1_000_000


def towards(size: int, width: int, total: int) -> np.ndarray:
    """Where a distribution (the starts of its parts) moves when a part has come: nearly all to it, one to every other."""
    out = np.zeros((size, width), np.int16)
    for s in range(size):
        out[s, :size] = [k if k <= s else total - size + k for k in range(size)]
    return out


EVENT = towards(3, 4, 1 << EVENT_BITS).view(np.int64).ravel()
CLASS = towards(CLASSES, CLASSES, 1 << CLASS_BITS).view(np.complex128).ravel()
EVENT_START = np.array([0, 1 << EVENT_BITS - 3, 1 << EVENT_BITS - 2, 0], np.int16).view(np.int64)[0]
CLASS_START = (np.arange(CLASSES) << CLASS_BITS - 3).astype(np.int16).view(np.complex128)[0]
SHIFT16, WORD = np.uint64(16), np.uint64(48)
SMALL = np.uint64(1 << 48)


def moved(rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Distributions, each in one number of rows, moved towards others."""
    a, b = rows.view(np.int16), target.view(np.int16)
    return (a + ((b - a) >> RATE)).view(rows.dtype)


class Alphabet:
    """The ids of a frame in an order where neighbours in texts are near each other, their classes, and where each stands in its class's share."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, count: np.ndarray):
        """count: how many ids each class has; size: the share of each id, which add up to one power of two in each class."""
        self.ids, self.size, self.count = ids, size, count
        self.klass = np.repeat(np.arange(CLASSES), count)
        self.bits = max(INNER_BITS, int(size[self.klass == self.klass[0]].sum()).bit_length() - 1) if len(ids) else INNER_BITS
        total = np.r_[0, np.cumsum(size)]
        self.start = total[:-1] - total[np.r_[0, np.cumsum(count)]][self.klass]

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Alphabet, np.ndarray]:
        """The alphabet of ids, and each id's place in it."""
        times = np.bincount(ids)
        own = np.flatnonzero(times)
        place = np.zeros(len(times), np.int32)
        place[own] = np.arange(len(own))
        n = times[own]
        every = max(1, len(ids) // NEIGHBOURS)
        a, b = place[ids[:-1:every]], place[ids[1::every]]
        # the slowest wave of a walk between neighbours: clusters of ids have values alike
        met = np.bincount(a, minlength=len(own)) + np.bincount(b, minlength=len(own)) + 1e-9
        wave = np.random.default_rng(1).standard_normal(len(own))
        for _ in range(TURNS):
            wave = (np.bincount(a, wave[b], len(own)) + np.bincount(b, wave[a], len(own))) / met
            wave -= (wave * met).sum() / met.sum()
            wave /= np.sqrt((wave * wave * met).sum() / met.sum()) + 1e-9
        order = np.argsort(wave, kind="stable")
        own, n = own[order], n[order]
        # by mass, and by number so that no class has most of the ids
        middle = (3 * (np.cumsum(n) - n / 2) / n.sum() + (np.arange(len(n)) + 0.5) / len(n)) / 4
        klass = np.minimum((middle * CLASSES).astype(np.int64), CLASSES - 1)
        count = np.bincount(klass, minlength=CLASSES)
        bits = max(INNER_BITS, int(count.max()).bit_length() + 1)
        mass = np.bincount(klass, n, CLASSES)
        free = (1 << bits) - count  # each id has 1, the rest goes by frequency
        size = 1 + np.floor(n * (free / np.maximum(mass, 1))[klass]).astype(np.int64)
        first = np.r_[0, np.cumsum(count)[:-1]]
        for k in np.flatnonzero(count):
            part = size[first[k] : first[k] + count[k]]
            part[n[first[k] : first[k] + count[k]].argmax()] += (1 << bits) - part.sum()
        place[own] = np.arange(len(own))
        return cls(own, size, count), place[ids]

    def packed(self) -> bytes:
        return zlib.compress(np.r_[self.count, self.ids, self.size].astype("<u4").tobytes())

    @classmethod
    def read(cls, data: bytes) -> Alphabet:
        numbers = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        count, rest = numbers[:CLASSES], numbers[CLASSES:]
        if int(count.sum()) * 2 != len(rest):
            raise ValueError("an alphabet is broken")
        ids, size = np.split(rest, 2)
        return cls(ids, size, count)


class Blocks:
    """The models of many blocks, one lane each; lanes are independent. What is done for several orders is done in one array."""

    def __init__(self, lanes: int):
        rows = 1 + CLASSES + CLASSES * CLASSES
        self.classes = np.full(lanes * rows, CLASS_START)
        self.events = np.full(lanes * 16, EVENT_START)
        self.guess = np.zeros(2 * lanes * SLOTS, np.int32)  # of order 2, then of order 1: a place in the alphabet, from 1, and in the last two bits the trust in it
        self.row, self.event_row = np.arange(lanes) * rows, np.arange(lanes) * 16
        self.two, self.one = np.arange(lanes) * SLOTS, (np.arange(lanes) + lanes) * SLOTS
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.context = np.zeros(lanes, np.int64)  # the class of the last id, times CLASSES, and that of the one before
        self.eights = np.arange(lanes + 1) * CLASSES
        self.fours = np.arange(lanes + 1) * 4

    def look(self, n: int) -> tuple[np.ndarray, ...]:
        """For the first n lanes the places of both predictions, what stands there, and the event distribution's row and itself."""
        at = np.empty(2 * n, np.int64)
        last = self.last[:n]
        np.add(self.two[:n], (last * 37 ^ self.before[:n] * 0x2F5) & (SLOTS - 1), out=at[:n])
        np.add(self.one[:n], last & (SLOTS - 1), out=at[n:])
        held = self.guess.take(at)
        trust = held & 3
        row = self.event_row[:n] + ((trust[:n] << 2) + trust[n:])
        return at, held, row, self.events.take(row)

    def happened(self, row: np.ndarray, dist: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Learn the events; where each one's part starts, and how wide it is."""
        flat, at = dist.view(np.int16), self.fours[: len(event)] + event
        start = flat.take(at).astype(np.int64)
        at += 1
        width = (flat.take(at) - start) & ((1 << EVENT_BITS) - 1)
        self.events[row] = moved(dist, EVENT.take(event))
        return start, width

    def mixture(self, lanes: np.ndarray) -> tuple[np.ndarray, ...]:
        """The rows of orders 0, 1 and 2 for some lanes, what they hold, and their mixture: the starts of the classes, and a last 0."""
        n, context = len(lanes), self.context.take(lanes)
        rows = np.empty(3 * n, np.int64)
        first = rows[:n]
        self.row.take(lanes, out=first)
        np.add(first, (context >> 3) + 1, out=rows[n : 2 * n])
        np.add(first, context + (1 + CLASSES), out=rows[2 * n :])
        held = self.classes.take(rows)
        zero, one, two = held.view(np.int16).reshape(3, -1)
        mixed = np.zeros(n * CLASSES + 1, np.int16)
        sums = mixed[:-1]
        np.add(one, one, out=sums)
        sums += zero
        sums += two
        return rows, held, mixed

    def part(self, mixed: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of each lane's class starts, and how wide it is."""
        at = self.eights[: len(klass)] + klass
        start = mixed.take(at).astype(np.int64)
        at += 1
        return start, (mixed.take(at) - start) & ((1 << MIX_BITS) - 1)

    def classed(self, rows: np.ndarray, held: np.ndarray, klass: np.ndarray) -> None:
        target = CLASS.take(klass).view(np.int16)
        a = held.view(np.int16).reshape(3, -1)
        self.classes[rows] = (a + ((target - a) >> RATE)).view(np.complex128).ravel()

    def learn(self, place: np.ndarray, klass: np.ndarray, mark: np.ndarray, hit: np.ndarray, at: np.ndarray, held: np.ndarray) -> None:
        """mark: the places as predictions have them, twice; hit: which predictions were right."""
        n = len(place)
        self.guess[at] = np.where(hit, np.minimum(held + 1, mark | 3), mark)
        self.before[:n] = self.last[:n]
        self.last[:n] = place
        self.context[:n] = (self.context[:n] >> 3) + (klass << 3)


def twice(x: np.ndarray) -> np.ndarray:
    out = np.empty((2, len(x)), np.int32)
    out[:] = x
    return out.ravel()


def lanes_of(n: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each block, and how many blocks have an id at each step: all but the last are full."""
    count = -(-n // block)
    size = np.full(count, block)
    if count:
        size[-1] = n - block * (count - 1)
    return size, np.where(np.arange(min(n, block)) < (size[-1] if count else 0), count, count - 1)


def block_of(n: int) -> int:
    return min(BLOCK, max(LEAST, -(-n // LANES)))


def encode_frame(ids: np.ndarray, vocabulary: int, block: int | None = None) -> bytes:
    """A frame of ids below `vocabulary`."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if vocabulary > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary has {MAX_VOCABULARY} ids at most")
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} is not below {vocabulary}")
    n = len(ids)
    block = block or block_of(n)
    size, active = lanes_of(n, block)
    lanes = len(size)
    alphabet, place = Alphabet.of(ids) if n else (Alphabet(*[np.zeros(0, np.int64)] * 2, np.zeros(CLASSES, np.int64)), np.zeros(0, np.int32))
    grid = np.zeros(lanes * block, np.int32)
    grid[:n] = place
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    del place
    m = Blocks(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    room = 64  # words that each lane has place for, from its second on: a carry into the first goes nowhere
    words, put = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room + 1
    limit = room - 8
    inner = alphabet.bits + MIX_BITS
    total = np.uint64(EVENT_BITS + inner)

    for t, k in enumerate(active.tolist()):
        here = grid[t, :k].astype(np.int64)
        klass = alphabet.klass.take(here)
        at, held, row, dist = m.look(k)
        mark = twice((grid[t, :k] + 1) << 2)
        hit = (held ^ mark) < 4
        right = hit.view(np.int8)
        event = (2 - right[k:]) * (1 - right[:k])  # 0: order 2 is right; 1: order 1 is
        begin, wide = m.happened(row, dist, event)
        start, width = begin << inner, wide << inner
        lane = np.flatnonzero(event == 2)
        if len(lane):
            rows, old, mixed = m.mixture(lane)
            what, its = here.take(lane), klass.take(lane)
            first, broad = m.part(mixed, its)
            each = wide.take(lane)
            start[lane] += each * ((first << alphabet.bits) + alphabet.start.take(what) * broad)
            width[lane] = each * (alphabet.size.take(what) * broad)
            m.classed(rows, old, its)
        m.learn(here, klass, mark, hit, at, held)
        l, s = low[:k], span[:k]
        step = s >> total
        move = step * start.view(np.uint64)
        l += move
        np.multiply(step, width.view(np.uint64), out=s)
        over = np.flatnonzero(l < move)
        if len(over):  # carries are added up and spread at the end
            words[put[over] - 1] += np.uint32(1)
        lane = np.flatnonzero(s < SMALL)
        while len(lane):
            mine, to = l[lane], put[lane]
            words[to] = mine >> WORD
            put[lane] = to + 1
            l[lane] = mine << SHIFT16
            narrow = s[lane] << SHIFT16
            s[lane] = narrow
            lane = lane[narrow < SMALL]
        if t % 2 == 1 and int((put - np.arange(lanes) * room).max()) > limit:  # a step sends three words at most
            words, put = np.hstack([words.reshape(lanes, room), np.zeros((lanes, room), np.uint32)]).ravel(), put + np.arange(lanes) * room
            room, limit = 2 * room, 2 * room - 8
    # a number of one word that lies in each range; zeros follow it
    last = low + (SMALL - np.uint64(1))
    words[put[last < low] - 1] += np.uint32(1)
    words[put] = last >> WORD
    while len(over := np.flatnonzero(words > 0xFFFF)):
        words[over - 1] += words[over] >> np.uint32(16)
        words[over] &= np.uint32(0xFFFF)
    words = words.astype("<u2")
    sums, bodies = [], []
    for i in range(lanes):
        sums.append(zlib.crc32(ids[i * block : i * block + int(size[i])].tobytes()))
        bodies.append(words[i * room + 1 : int(put[i]) + 1].tobytes())
    head = alphabet.packed()
    out = [HEAD.pack(MAGIC, n, vocabulary, block, lanes, len(head), zlib.crc32(head)), head]
    out.append(np.array([len(b) // 2 for b in bodies], "<u4").tobytes())
    out.append(np.array(sums, "<u4").tobytes())
    return b"".join(out + bodies)


def decode_frame(data: bytes) -> np.ndarray:
    """The ids of a frame; raises ValueError if it is cut short or a block's checksum is not that of its ids."""
    if len(data) < HEAD.size or data[:4] != MAGIC:
        raise ValueError("no frame")
    _, n, vocabulary, block, lanes, head, sum_of_head = HEAD.unpack_from(data)
    size, active = lanes_of(n, block)
    at = HEAD.size + head
    if lanes != len(size) or len(data) < at + 8 * lanes:
        raise ValueError("frame cut short")
    if zlib.crc32(data[HEAD.size : at]) != sum_of_head:
        raise ValueError("alphabet: its checksum differs")
    alphabet = Alphabet.read(data[HEAD.size : at])
    length = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
    sums = np.frombuffer(data, "<u4", lanes, at + 4 * lanes)
    start_of = at + 8 * lanes
    if len(data) != start_of + 2 * int(length.sum()):
        raise ValueError("frame cut short")
    words = np.r_[np.frombuffer(data, "<u2", -1, start_of), np.zeros(1, np.uint16)].astype(np.uint64)
    end = np.cumsum(length)
    at_word = end - length
    nothing = len(words) - 1  # past its end a block reads zeros

    def word(lane: np.ndarray) -> np.ndarray:
        place = at_word[lane]
        at_word[lane] = place + 1
        return words.take(np.where(place < end[lane], place, nothing))

    m = Blocks(lanes)
    every = np.arange(lanes)
    span, code = np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << SHIFT16) | word(every)
    grid = np.zeros((min(n, block), lanes), np.int32)
    inner = alphabet.bits + MIX_BITS
    total = np.uint64(EVENT_BITS + inner)
    most = np.uint64((1 << EVENT_BITS + inner) - 1)
    # which id has each place of the classes' shares
    share = np.zeros(CLASSES << alphabet.bits, np.int32)
    share_of = np.repeat(np.arange(len(alphabet.ids), dtype=np.int32), alphabet.size)
    share[np.repeat(np.arange(CLASSES)[alphabet.count > 0] << alphabet.bits, 1 << alphabet.bits) + np.tile(np.arange(1 << alphabet.bits), int((alphabet.count > 0).sum()))] = share_of

    for t, k in enumerate(active.tolist()):
        at, held, row, dist = m.look(k)
        c, s = code[:k], span[:k]
        step = s >> total
        value = np.minimum(c // step, most).view(np.int64)
        coarse = (value >> inner).astype(np.int16)
        parts = dist.view(np.int16).reshape(k, 4)
        event = (coarse >= parts[:, 1]).view(np.int8) + (coarse >= parts[:, 2]).view(np.int8)
        here = (np.where(event == 0, held[:k], held[k:]).astype(np.int64) >> 2) - 1
        begin, wide = m.happened(row, dist, event)
        start, width = begin << inner, wide << inner
        lane = np.flatnonzero(event == 2)
        if len(lane):
            rows, old, mixed = m.mixture(lane)
            each = wide.take(lane)
            # quotients below 2**40 by numbers of 15 bits at most: exact in doubles
            rest = ((value.take(lane) - start.take(lane)) / each).astype(np.int64)
            coarse = (rest >> alphabet.bits).astype(np.int16)
            its = np.bitwise_count((mixed[:-1].reshape(-1, CLASSES) <= coarse[:, None]).view(np.uint64).ravel()).astype(np.int64) - 1
            first, broad = m.part(mixed, its)
            base = first << alphabet.bits
            what = share.take((its << alphabet.bits) + ((rest - base) / broad).astype(np.int64)).astype(np.int64)
            here[lane] = what
            start[lane] += each * (base + alphabet.start.take(what) * broad)
            width[lane] = each * (alphabet.size.take(what) * broad)
            m.classed(rows, old, its)
        mark = twice((here + 1) << 2)
        m.learn(here, alphabet.klass.take(here, mode="clip"), mark, (held ^ mark) < 4, at, held)
        grid[t, :k] = here
        c -= step * start.view(np.uint64)
        np.multiply(step, width.view(np.uint64), out=s)
        lane = np.flatnonzero(s < SMALL)
        while len(lane):
            c[lane] = (c[lane] << SHIFT16) | word(lane)
            narrow = s[lane] << SHIFT16
            s[lane] = narrow
            lane = lane[narrow < SMALL]
    found = np.concatenate([grid[:, :-1].T.ravel(), grid[: size[-1], -1]]) if lanes else np.zeros(0, np.int32)
    found = alphabet.ids.astype(np.uint32).take(found, mode="clip") if len(alphabet.ids) else found.astype(np.uint32)
    for i in range(lanes):
        if zlib.crc32(found[i * block : i * block + int(size[i])].tobytes()) != sums[i]:
            raise ValueError(f"block {i}: its checksum differs")
    return found


# --- Ids of texts


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Words:
    with open(path, encoding="utf-8") as f:
        return Words(f.read())


def write(docs: DataFrame, path: str, tokenizer_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """Write the ids of every row's whole text, in ascending order of id, as frames under path."""
    vocabulary_file = tokenizer_file or tokenizer_path("word_bpe_49k.json")
    names = ["shard", "frame", "at", "doc_ids", "sizes", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary_file)
        shard, frame, at = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        total = 0

        def packed() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            data = encode_frame(ids, max(words.size, end + 1))
            columns = [[shard], [frame], [at], [[h[0] for h in held]], [[len(h[1]) for h in held]], [data]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in slices(batches, "text", SLICE_BYTES):
            ids, row = words.encode(batch.column("text"), end)
            for doc, a, b in zip(batch.column("id").to_pylist(), row[:-1].tolist(), row[1:].tolist(), strict=True):
                if held and total + b - a > BLOCK * LANES:
                    yield packed()
                    frame, at, held, total = frame + 1, at + total, [], 0
                held.append((doc, ids[a:b]))
                total += b - a
        if held:
            yield packed()

    schema = "shard bigint, frame bigint, at bigint, doc_ids array<bigint>, sizes array<bigint>, data binary"
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    dealt = df.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")
    dealt.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from its frames: id_col, start (ids of all documents before it), ids."""
    files = spark.read.schema("shard bigint, frame bigint, at bigint, doc_ids array<bigint>, sizes array<bigint>, data binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("shard", "at", "doc_ids", "sizes", "data")}
                ids = decode_frame(row["data"])
                bounds = np.r_[0, np.cumsum(row["sizes"])].astype(np.int64)
                if bounds[-1] != len(ids):
                    raise ValueError("a frame's sizes do not add up")
                n = len(row["doc_ids"])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["at"] + bounds[:-1]), lists], names=["shard", id_col, "at", "ids"])

    docs = files.mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in ("shard", id_col, "at")] + [T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    shards = files.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    shards = settled(shards.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")), "token-shards")
    shards = F.broadcast(shards) if shards.count() <= MAX_BROADCAST_SHARDS else shards
    return docs.join(shards, "shard").select(id_col, (F.col("base") + F.col("at")).alias("start"), "ids")


def digests(read_back: DataFrame) -> DataFrame:
    """read_back with n_tokens and the crc32 of the ids as little-endian 32-bit numbers instead of the ids."""
    names = [c for c in read_back.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = np.asarray(lists.flatten()).astype("<u4")
            bounds = np.r_[0, np.cumsum(np.asarray(pa.compute.list_value_length(lists)))]
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=[*names, "n_tokens", "ids_crc32"])

    kept = [read_back.schema[c] for c in names]
    return read_back.mapInArrow(run, T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]))
