"""N-gram Jaccard join in the metric space of the Jaccard distance: which documents link up.

Documents with the same set of shingles are one class, and classes are joined. All shingles have one
order, rare ones first (a sketch of fixed size, summed over the corpus, tells frequent ones apart).
Two sets as similar as asked for share one of the first `n - ceil(t * n) + 1` shingles of each, so a
shingle is a place where sets can meet; there the set for which it stands foremost, which lacks
fewest of what the others share, is a pivot.

A pivot's region holds every set that meets it, nearest or not: sets at a boundary are in several
regions, and the nearest pivot is a set's home. The exact distances to the pivots are computed once.
A set within the radius of a pivot is linked to it, so two of those need no comparison. Of the other
pairs of a region, those in one component, or whose distances to the pivot differ by more than the
radius (triangle inequality), or whose sizes or places of the shared shingle rule a link out, are
left. While more pairs than a few times the rows could remain, regions are joined recursively, with
the next foremost set of the smaller components as pivot; then the rest is compared. Every link
between different components is thus found, nothing is capped, and components are exact.
`with_links` then compares all sets of each component, as no link leaves it, and counts every link.

Only numbers move: 64-bit shingles, and classes as (64-bit number, size). Texts are read where they
lie, once more for each round of comparisons. The table that says where which set goes is broadcast up to
`MAX_BROADCAST_BYTES`; beyond that a sieve of fixed size lets through the texts in question, and their sets meet the table in a
shuffle. Hot shingles, copies and pivots are summed before they are exchanged, or joined so that Spark can split them; a
hot region is dealt to several tasks by its bytes, its sets and its pairs.

Nulls: a text that is null or has no word has the empty set and links with nothing, its component is
its own id. A null id is never the smallest unless all are. Repeated rows are copies. Empty tables have no rows. Texts of any length
have all their shingles. Ties: of shingles that are equally rare the smaller number comes first, which no component depends
on; a similarity of just the share asked for is a link. Only id and text are read, so further columns may have any names;
`representatives` gives all columns back as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.operators import words
from marrow.llm.common import settled, slices, tree_sum
from marrow.llm.components import components

SIZE, PERCENT = 4, 85
SLICE_BYTES = 2_000_000
#: Larger counts are all as frequent. Any order of the shingles gives the same links, this one is fast.
MOST = (1 << 16) - 1
#: Of tables with a few numbers a row; bytes of those that say which sets go where, about 50 a row of them and 50 a place.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES, ROW_BYTES = 250_000, 24_000_000, 50
#: Bits of the sieve for ids where that table is larger.
SIEVE_BITS = 1 << 25
#: Of the sets of one task, about.
REGION_BYTES = 32_000_000
#: Sets of one part of a region, and pairs of one task, about; shingles that are compared at once.
REGION_SETS, REGION_PAIRS, COLUMNS = 1_000, 100_000, 4_096
#: Recursion goes on while so many times more pairs than rows might have to be compared.
PAIRS_A_ROW = 500

Content = Callable[[np.ndarray], bytes]
Compare = Callable[[bytes, bytes], tuple[int, int]]


def sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "text", SLICE_BYTES):
        number, _, _, row = words.numbers(*words.raw(batch.column("text")))
        yield batch, words.shingles(number, row, size)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def name_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0


def sketch_bits(rows: int) -> int:
    """Of the sketch's index: it grows with the rows, from 2**18 up to 2**24 counts of two bytes."""
    return min(24, max(18, rows.bit_length()))


def describe(docs: DataFrame, size: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, name) of each row, and the sketch: partial counts of shingles by their first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        names = ["id", "n", "name", "sketch"]
        kind = None
        for batch, found in sets(batches, size):
            kind = batch.column("id").type
            if found:
                counts += np.bincount((np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            n = pa.array([len(s) for s in found], pa.int64())
            name = signed(np.array([name_of(s) for s in found], np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), n, name, pa.nulls(len(found), pa.binary())], names=names)
        if kind is not None and counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([np.minimum(counts, MOST).astype(np.uint16).tobytes()], pa.binary())], names=names)

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("name", T.LongType()), T.StructField("sketch", T.BinaryType())])
    both = settled(docs.mapInArrow(run, schema), "jaccard-names")
    return both.where("n >= 0").select("id", "n", "name"), both.where("n < 0").select("sketch")


def ranks(parts: DataFrame, bits: int) -> np.ndarray:
    """For each first bits of a shingle how frequent its kind is, as half powers of two; a byte each, so of fixed size."""
    total = tree_sum(parts.select("sketch"), 1 << bits, "u2", MOST)
    return np.minimum(63, np.round(2 * np.log2(total + 1))).astype(np.uint8)


def foremost(s: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the common order, as many as sets that link must meet in, and their places in that order as numbers."""
    first = len(s) - (percent * len(s) + 99) // 100 + 1
    at = rank[(s >> np.uint64(65 - len(rank).bit_length())).astype(np.int64)].astype(np.uint64) << np.uint64(58) | (s >> np.uint64(6))
    order = np.argsort(at, kind="stable")[:first]
    return s[order], at[order]


def places(docs: DataFrame, sent: Broadcast, size: int, percent: int) -> DataFrame:
    """(key, name, size_place) of the foremost shingles of each row's set; a set that a task has had is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[int] = set()
        for _, found in sets(batches, size):
            keys, name, n, place = [], [], [], []
            for s in found:
                me = name_of(s)
                if not len(s) or me in had:
                    continue
                had.add(me)
                if len(had) > 1_000_000:
                    had.clear()
                first = foremost(s, sent.value, percent)[0]
                keys.append(first)
                name.append(np.full(len(first), me, np.uint64))
                n.append(np.full(len(first), len(s), np.int64))
                place.append(np.arange(len(first), dtype=np.int64))
            if keys:
                columns = [signed(np.concatenate(keys)), signed(np.concatenate(name)), pa.array(np.concatenate(n) << 32 | np.concatenate(place))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "name", "size_place"])

    return docs.mapInArrow(run, "key bigint, name bigint, size_place bigint")


def numbers(column: str) -> tuple:
    """Size and place from their common number."""
    return F.shiftright(column, 32), F.col(column).bitwiseAND(F.lit((1 << 32) - 1))


def may_link(n1, at1, n2, at2, percent: int):
    """Whether sets of these sizes can link if what stands at these places is the first they share."""
    return 100 * F.least(n1 - at1, n2 - at2) >= percent * F.greatest(n1 + at2, n2 + at1)


def sieve(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id, as numbers of 64 bits; of fixed size whatever the ids are."""
    at = hash_of("id")
    words = ids.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {SIEVE_BITS}) & 63 AS int))")).alias("x")).toArrow()
    out = np.zeros(SIEVE_BITS >> 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return out.view(np.uint64)


def hash_of(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS))


def deal(docs: DataFrame, mine: DataFrame, size: int, content: Content) -> DataFrame:
    """(region, p, q, own, name, content) of the sets of mine (id, name, region, parts, own): one row for each task of the region that the part takes part in.

    The texts of the ids are read where they lie. If the table that says what goes where is small it is broadcast, else the
    contents of the texts that a sieve lets through meet it in a shuffle.
    """
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    mine = settled(mine.select("id", "name", "region", "own", F.explode(tasks).alias("t")).select("id", "name", "region", "t.p", "t.q", "own"), "jaccard-wanted")
    names = ["region", "p", "q", "own", "name", "content"]
    if mine.count() * 2 * ROW_BYTES > MAX_BROADCAST_BYTES:
        sent = docs.sparkSession.sparkContext.broadcast(sieve(mine.select("id")))

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value
            for batch in batches:
                at = batch.column("at").to_numpy().astype(np.uint64)
                batch = batch.filter(pa.array((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1))
                for part, found in sets(iter([batch.select(["id", "text"])]), size):
                    yield pa.RecordBatch.from_arrays([part.column("id"), signed(np.array([name_of(s) for s in found], np.uint64)), pa.array([content(s) for s in found], pa.binary())], names=["of", "name", "content"])

        schema = T.StructType([T.StructField("of", docs.schema["id"].dataType), T.StructField("name", T.LongType()), T.StructField("content", T.BinaryType())])
        held = docs.select("id", "text", hash_of("id").alias("at")).mapInArrow(passed, schema).withColumnRenamed("name", "called")
        return held.join(mine, F.col("id").eqNullSafe(F.col("of")) & (F.col("name") == F.col("called"))).select(*names)
    # Rows may share an id, or have none: the set's name says which of them is meant.
    wanted = F.broadcast(mine.groupBy(F.col("id").alias("want")).agg(F.collect_list(F.struct("name", "region", "p", "q", "own")).alias("tasks")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in sets(batches, size):
            rows = []
            for tasks, s in zip(batch.column("tasks").to_pylist(), found, strict=True):
                me, what = name_of(s), None
                for t in tasks:
                    if t["name"] % (1 << 64) == me:
                        what = content(s) if what is None else what
                        rows.append((t["region"], t["p"], t["q"], t["own"], me, what))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            numbers = [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:4])]
            yield pa.RecordBatch.from_arrays([*numbers, signed(np.array(columns[4], np.uint64)), pa.array(columns[5], pa.binary())], names=names)

    return docs.join(wanted, F.col("id").eqNullSafe(F.col("want"))).select("tasks", "text").mapInArrow(send, "region bigint, p int, q int, own int, name bigint, content binary")


def meet(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, content: Content, compare: Compare) -> DataFrame:
    """(a, b, both, either) for pairs (a, b, region): compare() of what content() says of both sets.

    A set goes once to each region that it is in, not once for each pair. A region of more than
    REGION_BYTES of sets, REGION_SETS of them or many REGION_PAIRS is dealt to several tasks, each for the pairs between two of its parts.
    """
    pairs = settled(pairs, "jaccard-pairs")
    sides = pairs.select("region", F.col("a").alias("name")).union(pairs.select("region", F.col("b").alias("name"))).distinct()
    sides = settled(sides.join(classes, "name"), "jaccard-sides")
    held = sides.groupBy("region").agg(F.greatest(F.ceil(F.sum("n") * 8 / REGION_BYTES), F.ceil(F.count("*") / REGION_SETS)).alias("parts"))
    asked = pairs.groupBy("region").agg(F.ceil(F.sqrt(2 * F.count("*") / REGION_PAIRS)).alias("dealt"))
    parts = near(held.join(asked, "region").select("region", F.greatest("parts", "dealt").cast("int").alias("parts")))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
    dealt = pairs.join(parts, "region").withColumn("p", part("a")).withColumn("q", part("b"))
    dealt = dealt.select("a", "b", "region", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    mine = sides.join(parts, "region").withColumn("own", part("name"))
    sent = deal(docs, mine, size, content)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(right.column("name").to_pylist(), right.column("content").to_pylist(), strict=True))
        a, b = left.column("a").to_pylist(), left.column("b").to_pylist()
        found = [compare(held[x], held[y]) for x, y in zip(a, b, strict=True)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "both": pa.array([f[0] for f in found], pa.int64()), "either": pa.array([f[1] for f in found], pa.int64())})

    task = ["region", "p", "q"]
    return dealt.groupBy(*task).cogroup(sent.groupBy(*task)).applyInArrow(judge, "a bigint, b bigint, both bigint, either bigint")


def overlap(a: bytes, b: bytes) -> tuple[int, int]:
    """The size of the intersection and of the union of two sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def at_best(a: bytes, b: bytes) -> tuple[int, int]:
    """What two sets could share at most, and would then have together, from their sizes and foremost shingles.

    Of the stretch of the order that both foremost parts cover, all is known.
    """
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n, m, x, y = int(x[0]), int(y[0]), x[1:], y[1:]
    end = min(x[-1], y[-1])
    x, y = x[x <= end], y[y <= end]
    both = len(np.intersect1d(x, y))
    most = min(n - (len(x) - both), m - (len(y) - both))
    return most, n + m - most


def compared(docs: DataFrame, classes: DataFrame, pairs: DataFrame, sent: Broadcast, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, b, region) that may link, with the exact sizes of intersection and union. Most drop out by their foremost shingles."""

    def front(s: np.ndarray) -> bytes:
        return np.r_[np.uint64(len(s)), foremost(s, sent.value, percent)[1]].tobytes()

    each = pairs.groupBy("a", "b").agg(F.min("region").alias("region"))
    may = settled(meet(docs, classes, each, size, front, at_best).where(100 * F.col("both") >= percent * F.col("either")), "jaccard-candidates")
    exact = meet(docs, classes, may.join(each, ["a", "b"]).select("a", "b", "region"), size, lambda s: s.tobytes(), overlap)
    return settled(exact, "jaccard-known")


def near(df: DataFrame) -> DataFrame:
    """A table of few numbers a row for a join: broadcast while it has at most MAX_BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def links(docs: DataFrame, classes: DataFrame, rank: np.ndarray, size: int, percent: int) -> DataFrame:
    """Edges (a, b) between names of classes, which connect all that links connect."""
    sent = docs.sparkSession.sparkContext.broadcast(rank)
    rows = settled(places(docs, sent, size, percent), "jaccard-places")
    # The pivot of each place, where at least two sets meet (or two tasks have the same one).
    at = F.col("size_place").bitwiseAND(F.lit((1 << 32) - 1)) * (1 << 31) + F.shiftright("size_place", 32)  # by place, then size
    firsts = rows.groupBy("key").agg(F.min_by("name", at).alias("pivot"), F.min(at).alias("at"), F.count("*").alias("k")).where("k > 1")
    pivots = firsts.select("key", "pivot", "k", F.shiftleft(F.col("at").bitwiseAND(F.lit((1 << 31) - 1)), 32).bitwiseOR(F.shiftright("at", 31)).alias("pivot_at"))
    n1, at1 = numbers("size_place")
    n2, at2 = numbers("pivot_at")
    # What a set could share at most with another of its place: none has a place before the pivot's.
    met = rows.join(pivots, "key").where((F.col("name") != F.col("pivot")) & (100 * (n1 - at1) >= percent * (n1 + at2)))
    met = settled(met.distinct(), "jaccard-met")
    close = met.where(may_link(n1, at1, n2, at2, percent)).select(F.col("name").alias("a"), F.col("pivot").alias("b"), F.col("pivot").alias("region"))
    known = compared(docs, classes, close, sent, size, percent)
    edges = known.where(100 * F.col("both") >= percent * F.col("either")).select("a", "b")
    # The pivots are done; where three or more met, the others may link among themselves.
    others = met.where("k > 2").select("key", "name", "size_place", "pivot")
    radius = (100 - percent) / 100
    m1, p1 = numbers("size_place")
    m2, p2 = numbers("size_place2")
    close = (F.col("root") != F.col("root2")) & may_link(m1, p1, m2, p2, percent)
    # Distances to the common pivot bound the distance within a region from below.
    close = close & (F.col("d").isNull() | F.col("d2").isNull() | (F.abs(F.col("d") - F.col("d2")) <= radius + 1e-9))
    while True:
        labels = near(components(edges).select(F.col("node").alias("name"), "root"))
        far = near(known.select(F.col("a").alias("name"), F.col("b").alias("pivot"), (1 - F.col("both") / F.col("either")).alias("d")))
        here = others.join(labels, "name", "left").withColumn("root", F.coalesce("root", "name")).join(far, ["name", "pivot"], "left")
        stats = here.groupBy("key", "root").agg(F.count("*").cast("double").alias("k")).groupBy("key")
        stats = stats.agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"), F.max(F.struct("k", "root"))["root"].alias("main"))
        stats = settled(stats.where(F.col("all") * F.col("all") > F.col("same")), "jaccard-places")
        left, total = stats.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.lit(0.0)), F.coalesce(F.sum("all"), F.lit(0.0))).first()
        if not left:
            return edges
        here = settled(here.join(near(stats.select("key", "main")), "key"), "jaccard-open")
        other = here.select("key", *[F.col(c).alias(f"{c}2") for c in ("name", "size_place", "root", "d")])
        done = left <= PAIRS_A_ROW * total
        if done:
            pairs = here.join(other, "key").where(close & (F.col("name") < F.col("name2")))
        else:
            # The foremost set outside the largest component of each place becomes its pivot, and is then done there.
            pick = near(settled(here.where("root <> main").groupBy("key").agg(F.min(F.struct(p1.alias("at"), "name"))["name"].alias("next")), "jaccard-next"))
            pairs = here.join(other.join(pick, "key").where("name2 = next"), "key").where(close)
            others = settled(here.join(pick, "key", "left").where("next IS NULL OR name <> next").select("key", "name", "size_place", "pivot"), "jaccard-open")
        pairs = pairs.select(F.greatest("name", "name2").alias("a"), F.least("name", "name2").alias("b"), F.col("pivot").alias("region"))
        seen = known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        more = compared(docs, classes, pairs.join(seen, ["a", "b"], "left_anti"), sent, size, percent)
        edges = settled(edges.union(more.where(100 * F.col("both") >= percent * F.col("either")).select("a", "b")), "jaccard-edges")
        known = known.unionByName(more)
        if done:
            return edges


def shared(held: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each two sets, by products of the rows that say which shingles a set has."""
    out = np.zeros((len(held), len(held)), np.int64)
    who = np.repeat(np.arange(len(held)), [len(s) for s in held])
    _, column, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    order = np.argsort(column[times[column] > 1], kind="stable")
    who, column = who[times[column] > 1][order], column[times[column] > 1][order]
    at = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, [first, first + COLUMNS])
        has = np.zeros((len(held), int(at[b - 1]) + 1 - first), np.float32)
        has[who[a:b], at[a:b] - first] = 1
        out += np.rint(has @ has.T).astype(np.int64)
    return out


def link_counts(docs: DataFrame, classes: DataFrame, labels: DataFrame, size: int, percent: int) -> DataFrame:
    """(name, n_links) of the classes that link: with how many others each does. All pairs of a component are compared, those of a large one in several tasks."""
    sides = settled(classes.join(labels.select(F.col("node").alias("name"), F.col("root").alias("region")), "name"), "jaccard-members")
    parts = F.greatest(F.ceil(F.sum("n") * 8 / REGION_BYTES), F.ceil(F.count("*") / REGION_SETS)).cast("int")
    mine = sides.join(near(sides.groupBy("region").agg(parts.alias("parts"))), "region").withColumn("own", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))

    def count(members: pa.Table) -> pa.Table:
        first = members.column("name").to_numpy()
        _, once = np.unique(first, return_index=True)  # copies of a text may share an id
        name, own, both_parts = first[once], members.column("own").to_numpy()[once], members.column("p")[0].as_py() != members.column("q")[0].as_py()
        content = members.column("content")
        held = [np.frombuffer(content[int(i)].as_buffer(), np.uint64) for i in once]
        both = shared(held)
        n = np.array([len(s) for s in held])
        link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(link, False)
        if both_parts:
            link &= own[:, None] != own[None, :]
        return pa.table({"name": pa.array(name), "n_links": pa.array(link.sum(axis=1), pa.int64())})

    sent = deal(docs, mine, size, lambda s: s.tobytes())
    counts = sent.groupBy("region", "p", "q").applyInArrow(count, "name bigint, n_links bigint")
    return counts.groupBy("name").agg(F.sum("n_links").alias("n_links"))


def solved(df: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, n, name) of each row, the classes (name, n, id), and the component (node, root) of those that link."""
    bits = sketch_bits(df.count())
    named, sketch = describe(df, size, bits)
    classes = settled(named.where("n > 0").groupBy("name", "n").agg(F.min("id").alias("id")), "jaccard-classes")
    return named, classes, components(links(df, classes, ranks(sketch, bits), size, percent))


def told(named: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str, *more: str) -> DataFrame:
    """The columns of join() from what solved() gives, and more columns of classes."""
    rooted = classes.join(labels.select(F.col("node").alias("name"), "root"), "name")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = rooted.join(least, "root").select("name", "n", "component_id")
    places_of = classes.join(linked, ["name", "n"], "left").select("name", "n", F.col("id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"), *more)
    out = named.join(places_of, ["name", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"), *more)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row: id_col, n_shingles, class_id (smallest id with the same set), component_id (smallest id that links reach)."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return told(*solved(df, size, percent), id_col)


def with_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """join() with n_links: how many other classes the row's class links with, every one counted."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    named, classes, labels = solved(df, size, percent)
    counts = link_counts(df, classes, labels, size, percent)
    counted = settled(classes.join(counts, "name", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))), "jaccard-links")
    out = told(named, counted, labels, id_col, "n_links")
    return out.withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each component: that of the smallest id, and of its smallest name where sets share an id. Rows without an id stay, as do, once each, those without a word."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    named, _, labels = solved(df, size, percent)
    found = named.where("id IS NOT NULL").join(labels.select(F.col("node").alias("name"), F.col("root").alias("of")), "name", "left")
    found = settled(found.withColumn("of", F.coalesce("of", "name")), "jaccard-components")
    best = settled(found.where("n > 0").groupBy("of").agg(F.min(F.struct("id", "name")).alias("best")).select("best.id", "best.name"), "jaccard-best")
    each = found.groupBy("id").agg(F.count("*").alias("rows"), F.count_if(F.col("n") == 0).alias("empty"))
    each = each.join(best.groupBy("id").agg(F.count("*").alias("best")), "id", "left").withColumn("kept", F.coalesce("best", F.lit(0)) + F.col("empty"))
    each = settled(each.select("id", "rows", "kept"), "jaccard-ids")
    key, what = (f"{c}_{uuid.uuid4().hex}" for c in ("id", "text"))  # clash with no column of docs
    gone, again = (each.where(c).select(F.col("id").alias(key)) for c in ("kept = 0", "kept > 0 AND rows > 1"))

    def small(ids: DataFrame) -> DataFrame:
        return near(ids)

    same = F.col(f"`{id_col}`") == F.col(key)
    rest = docs.join(small(gone), same, "left_anti")
    if not again.limit(1).count():
        return rest
    # Where rows share an id, their sets' names tell which of them stay.
    ids = small(again)
    mine = df.join(ids.withColumnRenamed(key, "key"), F.col("id") == F.col("key"), "left_semi").distinct()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in sets(batches, size):
            columns = [batch.column("id"), batch.column("text"), pa.array([len(s) for s in found], pa.int64()), signed(np.array([name_of(s) for s in found], np.uint64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n", "name"])

    texts = mine.mapInArrow(name, T.StructType([df.schema["id"], df.schema["text"], T.StructField("n", T.LongType()), T.StructField("name", T.LongType())]))
    texts = settled(texts, "jaccard-texts")
    first = texts.where("n > 0").join(best, ["id", "name"], "left_semi").groupBy("id", "name").agg(F.min("text").alias("text"))
    stay = texts.where("n = 0").select("id", "text").union(first.select("id", "text")).toDF(key, what)
    row = same & F.col(f"`{text_col}`").cast("string").eqNullSafe(F.col(what))
    return rest.join(ids, same, "left_anti").union(rest.join(stay, row, "left_semi").dropDuplicates([id_col, text_col]))
