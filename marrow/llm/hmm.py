"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihood by the scaled forward recursion.

A token is a word or the end of its text. A state emits a symbol: one of the `OWN` most frequent
words, the end, or one of `SHAPES` shapes (first and last two bytes) of all other words; a shape
emits its word by the word's count in the training texts, plus one, with one place for words it
never had. The score of a text is the log10 of its probability, summed over all sequences of states.

Counting words is a sum by key over all training texts. The most frequent `HEAD` words at most, a bounded
table, are broadcast with their counts; occurrences of others meet their counts in a shuffle join.
The first states come from a random projection of each text's symbols, then come `ROUNDS` rounds of
Baum-Welch over whole texts. So that many advance side by side, long ones are taken in runs of `RUN` tokens: the product
of a run's matrices carries the forward and the backward distribution over it, so that every run starts and ends
with what the text before and after it says, and the counts are those of the uncut text. Each task sends
one row of expected counts, of fixed size, and rows are added up sixteen at a time. Scoring takes whole
texts, however long.

Nulls: a null text is empty and has one token, its end. Repeated rows are scored alike, and counted
again in training. Ties: of equally frequent words the smaller number comes first. With no training text every known
count is 0 and the model is uniform. Empty tables: no rows. Columns to keep are handled by place, so they may have any
names but those of the answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.operators import words
from marrow.llm.common import settled, slices, tree_sum

STATES, ROUNDS, RUN = 8, 3, 1024
OWN, SHAPES, HEAD = 16_384, 1_024, 262_144
SLICE_BYTES, SCORED_BYTES = 2_000_000, 12_000_000
RUN_TOKENS = 400_000
#: Words that a counting task holds before it sends them on.
HELD = 1_000_000
PRIOR = 50.0
#: The number of the end token; no other word has it but by a chance of 2**-64.
END = 1


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and shape of every token, and where each row's tokens start (one entry more than rows)."""
    data, rows = words.raw(column)
    number, first, end, row = words.numbers(data, rows)
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    if len(number):
        with np.errstate(over="ignore"):
            shape = words.mixed(low[data[first]] << np.uint64(16) | low[data[np.maximum(first, end - 2)]] << np.uint64(8) | low[data[end - 1]]) % np.uint64(SHAPES)
    else:
        shape = np.zeros(0, np.uint64)
    ends = row[1:]
    return np.insert(number.view(np.int64), ends, END), np.insert(shape.astype(np.int64), ends, -1), row + np.arange(len(row))


def many(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens() of a larger batch, taken in parts."""
    parts = [tokens(x.column("text")) for x in slices(iter([batch]), "text", SLICE_BYTES)]
    rows = np.concatenate([np.diff(p[2]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.r_[0, np.cumsum(rows)]


def count(train: DataFrame) -> DataFrame:
    """(word, shape, n) of all tokens of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w, s, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            u, first, back = np.unique(w, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(back, weights=n).astype(np.int64)

        for batch in slices(batches, "text", SLICE_BYTES):
            number, shape, _ = tokens(batch.column("text"))
            u, first, n = np.unique(number, return_index=True, return_counts=True)
            held.append((u, shape[first], n))
            size += len(u)
            if size > 2 * HELD:
                held = [added()]
                size = len(held[0][0])
                if size > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["word", "shape", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()], names=["word", "shape", "n"])

    parts = train.select("text").mapInArrow(run, "word bigint, shape bigint, n bigint")
    return parts.groupBy("word").agg(F.max("shape").alias("shape"), F.sum("n").alias("n"))


class Lexicon:
    """The frequent words with counts and symbols, the shapes' totals, and the corpus totals: all of bounded size."""

    def __init__(self, counts: DataFrame):
        level = F.floor(F.log2("n") * 8).cast("int")
        steps = sorted(((r["level"], r["k"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
        total, least = 0, None
        for at, k in steps:
            if total + k > HEAD:
                break
            total, least = total + k, at
        rows = counts.where(level >= least).collect() if least is not None else []
        rows.sort(key=lambda r: (r["word"] != END, -r["n"], r["word"]))
        own = rows[: OWN + 1]
        word = np.array([r["word"] for r in rows] or [END], np.int64)
        n = np.array([r["n"] for r in rows] or [0], np.int64)
        symbol = np.array([SHAPES + i if i < max(1, len(own)) else r["shape"] for i, r in enumerate(rows)] or [SHAPES], np.int64)
        order = np.argsort(word)
        self.word, self.n, self.symbol = word[order], n[order], symbol[order]
        self.symbols = SHAPES + max(1, len(own))
        named = {r["word"] for r in own}
        held = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        sums = counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        for r in sums:
            if r["shape"] >= 0:
                held[0][r["shape"]], held[1][r["shape"]] = r["n"], r["v"]
        for r in own:
            if r["word"] in named and r["shape"] >= 0:
                held[0][r["shape"]] -= r["n"]
                held[1][r["shape"]] -= 1
        self.tokens, self.kinds = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
        self.within = np.log10(held[0] + held[1] + 1.0)

    def look(self, number: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbol and count of each token, and whether it is in the head; the count of others is 0 here."""
        at = np.minimum(np.searchsorted(self.word, number), len(self.word) - 1)
        head = self.word[at] == number
        symbol = np.where(head, self.symbol[at], np.where(number == END, SHAPES, shape))
        return symbol, np.where(head, self.n[at], 0), head


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        total = emit.sum(axis=0) + 1
        prior = total / total.sum()
        self.start = (start + 1) / (start + 1).sum()
        self.move = (move + 1) / (move + 1).sum(axis=1, keepdims=True)
        self.emit = np.ascontiguousarray(((emit + PRIOR * prior) / (emit.sum(axis=1, keepdims=True) + PRIOR)).T)  # symbols x states


def lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by length, longest first, and how many of them have a token at each step."""
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    return order, np.searchsorted(-sizes[order], -np.arange(longest), side="left")


def forward(model: Model, symbol: np.ndarray, start: np.ndarray) -> np.ndarray:
    """log10 of the probability of each row's symbols."""
    sizes = np.diff(start)
    order, active = lanes(sizes)
    at = start[:-1][order]
    out = np.zeros(len(sizes))
    a = np.zeros((0, len(model.start)))
    for t, n in enumerate(active.tolist()):
        seen = model.emit[symbol[at[:n] + t]]
        a = seen * model.start if t == 0 else (a[:n] @ model.move) * seen
        s = a.sum(axis=1)
        a /= s[:, None]
        out[:n] += np.log10(s)
    back = np.empty(len(sizes))
    back[order] = out
    return back


def expected(model: Model, symbol: np.ndarray, start: np.ndarray, first: np.ndarray, symbols: int, begin: np.ndarray | None = None, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions over runs of symbols; first: which runs begin a text.

    begin: the states' distribution before each run's first symbol, tail: what follows each run says of its last state (one if nothing does).
    """
    k = len(model.start)
    order, active = lanes(np.diff(start))
    at = start[:-1][order]
    begin = np.tile(model.start, (len(at), 1)) if begin is None else begin[order]
    tail = np.ones((len(at), k)) if tail is None else tail[order]
    steps = []
    a = begin
    for t, n in enumerate(active.tolist()):
        here = symbol[at[:n] + t]
        seen = model.emit[here]
        a = begin[:n] * seen if t == 0 else (a[:n] @ model.move) * seen
        s = a.sum(axis=1, keepdims=True)
        a = a / s
        steps.append((here, seen / s, a))
    moves, mass = np.zeros((k, k)), []
    back = np.ones((0, k))
    for t in range(len(steps) - 1, -1, -1):
        here, seen, a = steps[t]
        b = tail[: len(a)].copy()
        b[len(back) :] /= (a[len(back) :] * b[len(back) :]).sum(axis=1, keepdims=True)
        if len(back):
            b[: len(back)] = back @ model.move.T
            moves += a[: len(back)].T @ back
        mass.append(a * b)
        back = seen * b
    starts = mass[-1][first[order][: len(mass[-1])]].sum(axis=0) if mass else np.zeros(k)
    where, weight = np.concatenate([s[0] for s in steps[::-1]]), np.concatenate(mass)
    emissions = np.stack([np.bincount(where, weights=weight[:, i], minlength=symbols) for i in range(k)])
    return starts, moves * model.move, emissions


def products(model: Model, symbol: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each run the matrix from the states before its first symbol to those after its last, up to a factor."""
    order, active = lanes(size)
    at, k = begin[order], len(model.start)
    out = np.empty((len(at), k, k))
    a = np.tile(np.eye(k), (len(at), 1, 1))
    for t, n in enumerate(active.tolist()):
        out[n : len(a)] = a[n:]
        a = a[:n] if t == 0 else (a[:n].reshape(-1, k) @ model.move).reshape(-1, k, k)
        a = a * model.emit[symbol[at[:n] + t]][:, None, :]
        a /= a.sum(axis=(1, 2), keepdims=True)
    out[: len(a)] = a
    back = np.empty_like(out)
    back[order] = out
    return back


def whole_counts(model: Model, symbol: np.ndarray, row: np.ndarray, symbols: int, run: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions over whole texts, long ones in runs that are chained exactly."""
    run = run or RUN
    runs = -(-np.diff(row) // run)
    text = np.repeat(np.arange(len(runs)), runs)
    place = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = row[:-1][text] + place * run
    stop = np.minimum(at + run, row[1:][text])
    k = len(model.start)
    begin, tail = np.tile(model.start, (len(text), 1)), np.ones((len(text), k))
    crossing = np.zeros((k, k))
    long = np.flatnonzero(runs[text] > 1)
    if len(long):
        matrix = np.zeros((len(text), k, k))
        matrix[long] = products(model, symbol, at[long], (stop - at)[long])
        by_place = long[np.argsort(place[long], kind="stable")]
        steps = np.split(by_place, np.flatnonzero(np.diff(place[by_place])) + 1)
        after, before = np.zeros((len(text), k)), np.zeros((len(text), k))
        for here in steps:  # runs of one text stand side by side
            later = here[place[here] > 0]
            begin[later] = after[later - 1] @ model.move
            found = np.einsum("ni,nij->nj", begin[here], matrix[here])
            after[here] = found / found.sum(axis=1, keepdims=True)
        for here in reversed(steps):
            more = here[place[here] + 1 < runs[text[here]]]
            tail[more] = before[more + 1] @ model.move.T
            found = np.einsum("nij,nj->ni", matrix[here], tail[here])
            before[here] = found / found.sum(axis=1, keepdims=True)
        ends = long[place[long] + 1 < runs[text[long]]]
        both = after[ends][:, :, None] * model.move * before[ends + 1][:, None, :]
        crossing = (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    starts, moves, emissions = expected(model, symbol, np.r_[at, len(symbol)], place == 0, symbols, begin, tail)
    return starts, moves + crossing, emissions


def first_guess(symbol: np.ndarray, start: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts if each text had one state: the largest of random weights, summed over the symbols of the text."""
    weight = np.random.default_rng(11).standard_normal((symbols, STATES))
    sums = np.add.reduceat(weight[symbol], start[:-1], axis=0)
    state = (sums / np.sqrt((sums**2).sum(axis=0) + 1)).argmax(axis=1)
    size = np.diff(start)
    emissions = np.bincount(np.repeat(state, size) * symbols + symbol, minlength=STATES * symbols).reshape(STATES, symbols).astype(float)
    moves = np.diag(np.bincount(state, weights=size, minlength=STATES) + 1) * 0.95 + 0.05 / STATES * size.sum()
    return np.bincount(state, minlength=STATES).astype(float), moves, emissions


def train(texts: DataFrame, lexicon: Lexicon) -> Model:
    sent = texts.sparkSession.sparkContext.broadcast(lexicon)
    symbols = lexicon.symbols

    def symbolised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            number, shape, row = tokens(batch.column("text"))
            symbol = sent.value.look(number, shape)[0].astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([symbol[a:b].tobytes() for a, b in zip(row[:-1].tolist(), row[1:].tolist(), strict=True)], pa.binary())], names=["symbols"])

    coded = settled(texts.select("text").mapInArrow(symbolised, "symbols binary"), "lm-symbols")
    model = None
    for _ in range(ROUNDS + 1):
        known = texts.sparkSession.sparkContext.broadcast(model)

        def counted(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            total = np.zeros(STATES + STATES**2 + STATES * symbols)
            for batch in batches:
                for part in slices(iter([batch]), "symbols", 2 * RUN_TOKENS):
                    raw = part.column("symbols").to_pylist()
                    size = np.array([len(x) // 2 for x in raw])
                    flat = np.frombuffer(b"".join(raw), np.uint16).astype(np.int64)
                    row = np.r_[0, np.cumsum(size)]
                    if known.value is None:
                        found = first_guess(flat, row, symbols)
                    else:
                        found = whole_counts(known.value, flat, row, symbols)
                    total += np.concatenate([x.ravel() for x in found])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

        total = tree_sum(settled(coded.mapInArrow(counted, "x binary"), "lm-counts"), STATES + STATES**2 + STATES * symbols)
        start, move, emit = np.split(total, [STATES, STATES + STATES**2])
        model = Model(start, move.reshape(STATES, STATES), emit.reshape(STATES, symbols))
        known.unpersist()
    return model


def score(docs: DataFrame, training: str = "NOT held_out", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns to keep, n_tokens, n_known, train_tokens, base_score, score; learns from the rows that `training` picks."""
    learn = docs.where(training).select(F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = settled(count(learn), "lm-words")
    lexicon = Lexicon(counts)
    model = train(learn, lexicon)
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, model))
    own = [id_col, *keep]
    names = [f"c{i}" for i in range(len(own))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = sent.value
        row_id = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", SCORED_BYTES):
            number, shape, row = many(batch)
            symbol, n, head = lexicon.look(number, shape)
            shaped = symbol < SHAPES
            logs = np.log10(n + 1.0)
            base = np.add.reduceat(logs, row[:-1])
            inner = np.add.reduceat(np.where(shaped, logs - lexicon.within[np.where(shaped, symbol, 0)], 0.0), row[:-1])
            whole = forward(model, symbol, row) + inner
            known = np.add.reduceat((n > 0).astype(np.int64), row[:-1])
            rest = np.flatnonzero(~head)
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, row).astype(np.int32)), pa.array(number[rest]))
            kept = [batch.column(c) for c in names]
            ids = pa.array(row_id + np.arange(batch.num_rows))
            row_id += batch.num_rows
            yield pa.RecordBatch.from_arrays([*kept, ids, pa.array(np.diff(row)), pa.array(known), pa.array(base), pa.array(whole), tail], names=[*names, "row_id", "n", "known", "base", "whole", "tail"])

    fields = [T.StructField(c, k) for c, k in (("row_id", T.LongType()), ("n", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("whole", T.DoubleType()), ("tail", T.ArrayType(T.LongType())))]
    kinds = [T.StructField(c, docs.schema[o].dataType) for c, o in zip(names, own, strict=True)]
    cols = [F.col(f"`{o}`").alias(c) for c, o in zip(names, own, strict=True)]
    text = docs.select(*cols, F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = settled(text.mapInArrow(run, T.StructType([*kinds, *fields])), "lm-scores")
    rare = scored.select("row_id", F.explode("tail").alias("word")).join(counts.select("word", F.col("n").alias("c")), "word")
    rare = rare.groupBy("row_id").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    whole = scored.drop("tail").join(rare, "row_id", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    each = float(np.log10(lexicon.tokens + lexicon.kinds + 1))
    return whole.select(
        *[F.col(c).alias(o) for c, o in zip(names, own, strict=True)],
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(lexicon.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n") * F.lit(each)).alias("base_score"),
        (F.col("whole") + logs).alias("score"),
    )
