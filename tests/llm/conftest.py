import random

import pytest

WORDS = {"en": "the of and reth inti ered hation wher".split(), "de": "der und nicht schung lichen über ßen".split(), "fr": "le des été ènement queaux oireé".split()}


def text_of(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "ing", "en", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels, benchmark and pages, and the documents: copies, near copies, junk, leaks, nulls."""
    rng = random.Random(12)
    rows, labels, items = [], [], [(i, text_of(rng, "en", 25)) for i in range(4)] + [(4, None), (5, ""), (6, "short one"), (6, "short one")]
    for i in range(160):
        lang = rng.choice(["en", "en", "de", "fr"])
        text = text_of(rng, lang, rng.choice([3, 12, 40, 90]))
        if i % 9 == 1:
            text = rows[-1][1] or text
        elif i % 9 == 2 and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[-1] = "changed"
            text = " ".join(words)
        elif i % 20 == 5:
            text = text + " " + items[i % 4][1]
        elif i % 20 == 7:
            text = "### " * 30 + text
        toxic = int(i % 6 == 0)
        if toxic:
            text += " idiot moron"
        text = None if i == 50 else "" if i == 51 else " \n\t " if i == 52 else text
        rows.append((i, text, None if i == 53 else lang, "src0" if i % 3 else f"src{i}", len(text or "")))
        if i % 2 == 0:
            labels.append((i, int(i % 20 != 7), toxic))
    rows.append((160, "word " * 20000 + "end", "en", "src1", 100003))
    pages = [(i, f"https://{'www.' if i % 2 else ''}h{i % 3}.example.com/en/{i}", f"<html><body><div class=x><p>Same on each</p></div><article><h1>T{i}</h1><p>Text &amp; {i}</article></body></html>") for i in range(60)]
    folder = tmp_path_factory.mktemp("tables")
    for name, data, schema in (
        ("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("labels", labels, "doc_id bigint, quality int, toxic int"),
        ("benchmark", items, "item_id bigint, text string"),
        ("pages", pages, "page_id bigint, url string, html string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]


@pytest.fixture(scope="session")
def check_sql(tables):
    """Rows of a query equal those of its SQL."""
    import duckdb

    from marrow.llm.queries import ORACLES, QUERIES

    path, _ = tables

    def run(spark, name):
        con = duckdb.connect()
        for t in ("documents", "labels", "benchmark", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
        want = con.sql(ORACLES[name])
        got = QUERIES[name](spark, path)
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda r: str(r)
        assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)
        return got

    return run
