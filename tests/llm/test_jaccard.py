import random
import re

import pytest
from pyspark.sql import functions as F

from marrow.llm import jaccard
from marrow.llm.components import components

SCHEMA = "doc_id bigint, text string"


def brute(rows, size=4, percent=85):
    """Component of each id, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def clouds(seed, groups=6, members=25):
    """Texts around centres, with a word or more changed, some chained from one to the next; copies; a passage that many share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for g in range(groups):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 120]))]
        for m in range(members):
            mine = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                mine[rng.randrange(len(mine))] = f"e{rng.randrange(10**6)}"
            if m % 5 == 0:
                words = mine
            if rng.random() < 0.3:
                mine = passage + mine
            rows.append(" ".join(mine).upper() if m % 7 == 0 else "  ".join(mine))
    rows += [" ".join(passage)] * 5 + [None, "", " \n", "one", "one", "ONE", "a b c", "a b c d", "É b c d", "é b c d"] + [" ".join(passage + [f"u{i}"]) for i in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize(("seed", "size", "percent", "pairs"), [(1, 4, 85, 500), (2, 4, 85, -1), (3, 5, 80, -1)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, size, percent, pairs):
    """pairs -1: regions are joined recursively to the end."""
    monkeypatch.setattr(jaccard, "PAIRS_A_ROW", pairs)
    rows = clouds(seed, *((6, 25) if pairs > 0 else (4, 12)))
    got = jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(3), size=size, percent=percent)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, size, percent)


def test_joins_without_broadcast(spark, monkeypatch):
    for name in ("MAX_BROADCAST_BYTES", "MAX_BROADCAST_ROWS"):
        monkeypatch.setattr(jaccard, name, -1)
    rows = clouds(4, 3, 10)
    got = jaccard.join(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows)


def test_regions_dealt_to_many_tasks(spark, monkeypatch):
    for name, few in (("REGION_SETS", 3), ("REGION_PAIRS", 4), ("SIEVE_BITS", 256), ("MAX_BROADCAST_BYTES", -1)):
        monkeypatch.setattr(jaccard, name, few)
    rows = clouds(6, 3, 14)
    got = jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("most", [jaccard.MAX_BROADCAST_BYTES, -1])
def test_rows_without_or_with_the_same_id(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MAX_BROADCAST_BYTES", most)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in (0, 59)]
    rows = [(None, " ".join(base)), (None, near[0]), (None, near[1]), (None, "other words stand here"), (4, near[0]), (4, "unlike any of the rest")]
    got = jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["component_id"]), r["n_shingles"]) for r in got) == [("4", 2), ("4", 57), ("4", 57), ("4", 57), ("4", 57), ("None", 1)]


def test_edges(spark, check_sql):
    check_sql(spark, "op2_jaccard")
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e", 1), (7, "a b c d e", 1), (7, "a b c d e", 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, name int").withColumn("id", F.lit(0)).withColumn("n", F.lit(0))
    assert sorted(str(r["component_id"]) for r in jaccard.join(df).collect()) == ["7", "7", "7", "None"]
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["7", "None", "None"]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    nodes = rng.sample(range(10**6), 300)
    edges = [(nodes[i], nodes[i + 1]) for i in range(99)] + [(nodes[100], x) for x in nodes[101:200]] + [(nodes[i], nodes[i - 1]) for i in range(201, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    for part in (nodes[:100], nodes[100:200], nodes[200:]):
        assert {got[x] for x in part} == {min(part)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_links(rows, size=4, percent=85):
    """Of each id, with how many other sets its own links, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}))
    kinds = set(sets) - {frozenset()}
    counts = {a: sum(a != b and 100 * len(a & b) >= percent * len(a | b) for b in kinds) for a in kinds}
    return {doc: counts.get(s, 0) for (doc, _), s in zip(rows, sets, strict=True)}


@pytest.mark.parametrize(("seed", "sets", "columns"), [(1, 1000, 4096), (5, 3, 7)])
def test_every_link_is_counted(spark, monkeypatch, seed, sets, columns):
    """Links within one component too; components dealt to one task or to many."""
    monkeypatch.setattr(jaccard, "REGION_SETS", sets)
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    rows = clouds(seed, 4, 20)
    got = jaccard.with_links(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = plain_links(rows)
    assert {r["doc_id"]: r["n_links"] for r in got} == want
    assert max(want.values()) > 2
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_links_of_the_query_and_edges(spark, check_sql):
    got = check_sql(spark, "op2_links")
    assert got.where("n_links > 0").count()
    assert jaccard.with_links(spark.createDataFrame([], SCHEMA)).count() == 0
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(base)), (None, " ".join([*base, "x"])), (4, " ".join([*base, "x"])), (4, " ".join([*base, "x", "y"])), (4, "unlike the rest here"), (None, None)]
    got = jaccard.with_links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["n_shingles"], r["n_links"]) for r in got) == [(0, 0), (1, 0), (57, 2), (58, 2), (58, 2), (59, 2)]


def test_one_row_of_each_component_where_ids_clash(spark):
    base = [f"w{i}" for i in range(60)]
    b, near_b, alone = " ".join(base), " ".join([*base, "x"]), "a text that has no copy at all"
    rows = [(2, b), (5, alone), (5, near_b), (7, "one and the same here"), (7, "ONE and the same here"), (8, near_b), (9, " ".join(f"v{i}" for i in range(60))), (9, " ".join(f"v{i}" for i in range(61))), (11, None), (11, None), (11, ""), (None, b)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(0)).withColumn("best", F.lit(1))
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(str(i) for i, _ in got) == ["11", "11", "2", "5", "7", "9", "None"]
    assert (5, alone) in got
    assert (2, b) in got


def test_long_texts_and_clashing_columns(spark):
    """Two texts of a million words that differ in one, a third of them, and copies; a similarity of just what is asked for."""
    words = [f"w{i * i % 7919}x{i}" for i in range(200_000)]
    other = [*words[:100_000], "changed", *words[100_001:]]
    twenty = [f"t{i}" for i in range(20)]  # 17 shingles; 17 of 20 are 85 of 100
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:70_000])), (4, " ".join(words)), (5, " ".join(twenty)), (6, " ".join([*twenty, "u1", "u2", "u3"])), (7, " ".join([*twenty, "u1", "u2", "u3", "u4"]))]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id bigint, text string, class_id int, component_id int, n_shingles int")
    got = jaccard.join(df)
    assert got.columns.count("component_id") == 1
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got.collect()} == {1: (1, 199_997), 2: (1, 199_997), 3: (3, 69_997), 4: (1, 199_997), 5: (5, 17), 6: (5, 20), 7: (5, 21)}
