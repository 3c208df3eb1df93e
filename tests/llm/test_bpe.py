import random

import pytest
from pyspark.sql import functions as F

from marrow.llm import bpe
from marrow.llm.queries import QUERIES

TEXTS = ["", "a<|endoftext|>b  <|endoftext|><|endoftext|>", "aaaaaaaaaaaaaaaa", "  \n\n\t x ", "日本語 😀😀😀 'll we'LL 123 4567", "abab" * 50, "\x00 \x7f", "x" * 5000, "the " * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def random_texts(n=300):
    rng = random.Random(4)
    parts = ["th", "e", " ", "  ", "\n", "é", "ß", "#", "12", "ing", "'s", "😀", "A", "\t", "’", "ion", "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_ids_and_text_are_the_librarys(library):
    texts = [*TEXTS, *random_texts()]
    v = bpe.vocabulary(bpe.tokenizer_path())
    flat, at = bpe.encode_texts(v, texts)
    for i, text in enumerate(texts):
        ids = flat[at[i] : at[i + 1]].tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode_ids(v, ids) == text == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode_as_the_library_does(library):
    v, rng = bpe.vocabulary(bpe.tokenizer_path()), random.Random(8)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(256), rng.randrange(50257)]) for _ in range(rng.randint(0, 12))]
        assert bpe.decode_ids(v, ids) == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode_ids(v, [-1, 50257, 999999, 64]) == library.decode([64])


def test_a_new_pair_never_ranks_before_its_parts():
    v = bpe.vocabulary(bpe.tokenizer_path())
    rank = {int(m): r for r, m in enumerate(v.made)}
    assert len(rank) == len(v.made)
    assert all(rank.get(int(x), -1) < r for side in (v.left, v.right) for r, x in enumerate(side))


def test_words_that_were_met_before(monkeypatch, library):
    """Slices after the first, and after the words have been forgotten, give the same ids."""
    coder = bpe.Encoder(bpe.vocabulary(bpe.tokenizer_path()))
    monkeypatch.setattr(bpe, "HELD", 60)
    texts = [*random_texts(60), *TEXTS[:5]]
    for i in range(0, len(texts), 7):
        flat, at = coder.encode(texts[i : i + 7])
        for text, a, b in zip(texts[i : i + 7], at, at[1:], strict=False):
            assert flat[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_tables(spark):
    rows = [(1, None, "z"), (2, "", "z"), (3, "ab", "z"), (3, "ab", "z"), (None, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumn("id", F.lit(7)).withColumn("decoded", F.lit("d"))
    got = bpe.decode(bpe.encode(df)).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]), r["decoded"]) for r in got) == [(0, 2, "x y"), (1, 0, ""), (2, 0, ""), (3, 1, "ab"), (3, 1, "ab")]
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0
    assert sorted(bpe.encode(df, decoded="decoded").collect(), key=str) == sorted(got, key=str)
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")).first()["decoded"] == ""


def test_query(spark, tables, library):
    import hashlib

    path, docs = tables
    got = {r["doc_id"]: r for r in QUERIES["op4_bpe"](spark, path).collect()}
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_a_very_long_text(spark, library):
    text = "The same sentence, and é日本 again. " * 40_000 + "x" * 20_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in bpe.encode(df, decoded="decoded").collect()}
    assert list(got[1]["ids"]) == library.encode(text, add_special_tokens=False).ids
    assert got[1]["decoded"] == text
