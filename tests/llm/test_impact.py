import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marrow.llm import impact
from marrow.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, term string, ids string, score int, segment int, weight double"
ITEMS = "item_id bigint, text string, item string, doc_id int"


def terms_of(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, limit):
    """(item_id, rank, doc_id, score), ties by id, a null one last."""
    held = [(i, Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, words in asked.items():
        scores = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * len(held) // total
            scores.append((sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if c[t]), d))
        scores = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item, k + 1, d, s) for k, (s, d) in enumerate(scores[:limit])]
    return sorted(out, key=str)


def found(spark, docs, items, limit):
    index = impact.build(spark.createDataFrame([(i, t, "x", "y", 1, 2, 0.5) for i, t in docs], DOCS))
    got = impact.search(index, spark.createDataFrame([(i, t, "z", 3) for i, t in items], ITEMS), limit)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ÀB", "naïve", "日本", "a-b", "X_y", "it's"]
    return [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 60, 307])]) for _ in range(rng.choice([0, 1, 7, 40, 200])))) for i in range(n)]


@pytest.mark.parametrize("limit", [1, 7, 50, 1000])
def test_against_all_scores(spark, monkeypatch, limit):
    monkeypatch.setattr(impact, "SEGMENT_DOCS", 70)
    monkeypatch.setattr(impact, "SEGMENT_BYTES", 20_000)
    monkeypatch.setattr(impact, "BLOCK", 3)
    rng = random.Random(limit)
    docs = corpus(rng, 400)
    items = [(i, " ".join(t for _, t in rng.sample(docs, 2))[: rng.choice([0, 10, 400])]) for i in range(12)]
    assert found(spark, docs, items, limit) == brute(docs, items, limit)


def test_odd_rows(spark):
    rng = random.Random(3)
    docs = corpus(rng, 100) + [(None, "w1 w2 w3"), (None, "w1"), (7, "w1 w2"), (7, "w1 w2"), (500, None), (501, ""), (502, " ,;\n"), (503, "W1 w1 W1 É é")]
    docs += [(i, "same words as all copies w1") for i in range(1000, 1060)] + [(2000, "w1 " * 60_000 + "rare")]
    rng.shuffle(docs)
    items = [(0, "w1 w2 w1 W2"), (0, "w3"), (1, None), (2, ""), (3, "--"), (None, "copies"), (None, "rare"), (4, "nowhere"), (5, "É"), (6, "w1 same copies rare " + " ".join(f"w{i}" for i in range(300)))]
    assert found(spark, docs, items, 50) == brute(docs, items, 50)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 5) == []
    assert found(spark, [(1, None), (2, "")], [(1, "a")], 5) == []
    assert found(spark, [(1, "a b"), (2, "b")], [], 5) == []


def test_the_bitmaps_are_sums_and_products():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << impact.BITS, 4096)
    weights = np.repeat(rng.integers(0, 23_000, 512), 8)
    slices = lambda x, n: np.stack([np.packbits((x >> s) & 1, bitorder="little") for s in range(n)])
    numbers = lambda bits: sum(np.unpackbits(b, bitorder="little").astype(np.int64) << s for s, b in enumerate(bits))
    product = impact.multiplied(slices(values, impact.BITS), weights[::8])
    assert (numbers(product) == values * weights).all()
    sums = slices(values, 40).copy()
    at = rng.permutation(512)[:300]
    impact.added(sums, at, product[:, at])
    want = values.reshape(-1, 8) + np.isin(np.arange(512), at)[:, None] * (values * weights).reshape(-1, 8)
    assert (numbers(sums).reshape(-1, 8) == want).all()


def test_the_query_against_its_sql(spark, tables, check_sql):
    assert check_sql(spark, "op11_impact").count() > 100
    assert "op11_impact" in ORACLES
    assert "op11_impact" in QUERIES
