from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from marrow.operators import fuse
from marrow.operators.notes import HARD_MAX, MERGE_UNDER, TARGET
from marrow.plans import catalog

BLANKS = b" \t\r\n"


def brute(text):
    """(first byte, end) of the chunks of a text without headings, by trying every place for a cut."""
    pieces, at = [], 0
    while len(text) - at > HARD_MAX:
        part = text[at : at + HARD_MAX]
        ends = [i + 1 for i in range(len(part)) if part[i : i + 1] == b"\n"]
        blank = [b for a, b in zip(ends, ends[1:]) if not part[a:b].strip(BLANKS)]
        near = lambda xs: min(xs, key=lambda x: (abs(x - TARGET), x))
        good, fair = [b for b in blank if 375 <= b <= 1125], [b for b in blank if b >= 250]
        lines = [b - 1 for b in ends if b - 1 >= 250]
        if good or fair:
            end = near(good or fair)
        elif lines:
            end = near(lines) + 1
        else:
            end = max(i for i in range(HARD_MAX + 1) if text[at + i] & 0xC0 != 0x80)
        pieces.append((at, at + end))
        at += end
        while text[at : at + 1] in (b"\r", b"\n"):
            at += 1
    return [*pieces, (at, len(text))]


def plain(text):
    """(body, first line, last line) of the chunks; the text begins on line 3 of its note."""
    raw = text.strip(" \t\r\n").encode()
    out = []
    for a, b in brute(raw):
        body = raw[a:b].rstrip(b"\r\n")
        cut = body.rstrip(b" \t")
        body = cut.rstrip(b"\r\n") if cut != body and cut[-1:] in (b"\r", b"\n", b"") else body
        first = 3 + raw[:a].count(b"\n")
        last = first + body.count(b"\n")
        if out and len(body) < MERGE_UNDER and len(out[-1][0]) + 1 + len(body) <= HARD_MAX:
            out[-1] = (out[-1][0] + b"\n" + body, out[-1][1], last)
        else:
            out.append((body, first, last))
    return [(b.decode(), x, y) for b, x, y in out]


def test_every_turn_is_cut_into_chunks(spark, tmp_path):
    texts = [
        "short",
        " two\nlines \n",
        "x" * 899,
        "x" * 900,
        "x" * 1000,
        "x" * 1001,
        "y" * 5000,
        "é" * 1234,
        "a" + "日本" * 700,
        "\n".join(f"line {i} " + "w" * (i % 50) for i in range(120)),
        "\n\n".join(f"paragraph {i} " + "word " * (i * 7 % 90) for i in range(60)),
        ("a" * 700 + "\r\n \r\n") * 4 + "tail",
        "b" * 990 + "\n" + "c" * 100,
    ]
    rows = [(i, 1, "user", t) for i, t in enumerate(texts)] + [(50, 1, "user", None), (51, 1, "user", ""), (52, 1, "user", " \n\t"), (53, 2, None, "no role"), (None, None, "user", "no id"), (0, 1, "user", "again")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["turn_sections"](spark, str(tmp_path))
    found = [(r["path"], r["body"], r["start_line"], r["end_line"]) for r in got.collect()]
    name = lambda conv, turn: f"conv-{'' if conv is None else conv}-{'' if turn is None else turn}.md"
    want = [(name(c, n), *chunk) for c, n, _, t in rows if (t or "").strip() for chunk in plain(t)]
    blank = [f for f in found if f[0] in ("conv-50-1.md", "conv-51-1.md", "conv-52-1.md")]
    assert sorted((f[0], f[1]) for f in blank) == [(name(c, 1), "") for c in (50, 51, 52)]
    assert Counter(f for f in found if f not in blank) == Counter(want)
    assert "turn_sections" not in catalog.ORACLES
    assert got.where(F.octet_length("body") > HARD_MAX).count() == 0


@pytest.mark.parametrize("name", ["saturation", "hybrid_search"])
def test_both_legs_send_what_the_reference_asks_for(spark, tmp_path, name):
    """Documents at rank 50 of both legs or deeper beat the first of one leg that is alone there, and those of a source that is halved."""
    import duckdb

    # the words' count falls with the id, so that the sparse rank is the id; the dense rank too, but for 0 to 49, which have no good vector
    n = 90
    docs = [(i, " ".join(["retion"] * (2 * n - i) + ["x"] * (i + 20)), "hot" if i < 50 else f"s{i}", "en") for i in range(n)]
    vectors = [(i, [1.0 if i == 0 else 0.0 if 0 < i < 50 else 1 - i / 100, 0.0]) for i in range(n)]
    vectors += [(1000 + i, [0.99 - i / 1000, 0.0]) for i in range(49)]  # of no document
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r["doc_id"], r["place"], r["score"]) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).orderBy("place").collect()]
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES[name]).order("place").fetchall()
    assert got == [(r[0], r[2], r[3]) for r in want]
    assert {d for d, *_ in got} > {50, 51, 52, 53}
    assert catalog.LIMIT == fuse.over_fetch(10**9, catalog.TOP) == 100


def test_chunks_against_sql(spark, tmp_path):
    """Texts of every kind of line, blank and character, in one section each."""
    import random

    import duckdb

    rng = random.Random(6)
    parts = ["word ", "é", "日本", "x" * 40, "\n", "\n\n", "\r\n", " \t", "\n \n", "end. ", "y" * 300, "\n" + "z" * 240]
    texts = ["".join(rng.choice(parts[: rng.choice([4, 8, 12])]) for _ in range(rng.choice([1, 20, 90, 400]))) for _ in range(250)]
    texts += ["a" * n for n in (249, 250, 999, 1000, 1001, 1002, 2000)] + ["é" * n for n in (499, 500, 501, 1500)] + ["b" * 990 + "\n" + "c" * 100, ("a" * 700 + "\r\n \r\n") * 4 + "tail", "q" * 740 + " \n\n" + "r" * 230, "s" * 700 + "\n\n\n" + "t" * 310 + " " * 200 + "\n\n u"]
    rows = [(i, 1, "user", t) for i, t in enumerate(texts)] + [(900, 1, "user", None), (901, 2, None, " \n "), (902, None, "x", "no turn"), (0, 1, "user", "the same id again")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["turn_chunks"])
    got = catalog.QUERIES["turn_chunks"](spark, str(tmp_path))
    found = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str)
    assert found == sorted(want.fetchall(), key=str)
    assert len(found) > 1.5 * len(texts)


def test_notes_of_a_small_table_are_parsed_by_many_tasks(spark):
    """A table of few bytes is read by one task; all that is made of its rows must not be."""
    files = catalog.customer_files(spark, "/root/testdata/sf0.01")
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = catalog.note_errors(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange hashpartitioning(c_custkey")
