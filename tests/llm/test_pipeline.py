import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marrow.llm import bpe, jaccard, langid
from tests.llm.conftest import text_of
from tests.llm.test_jaccard import brute


def test_stages_are_the_five():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_against_a_plain_version(spark, tables):
    path, docs = tables
    plain = spark.read.parquet(f"{path}/documents.parquet")
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, plain, path)
        assert plain.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        plain = spark.createDataFrame(plain.collect(), plain.schema)
        steps.append({r["doc_id"]: r["text"] for r in plain.collect()})
    whole = {d["doc_id"]: d["text"] for d in docs}
    assert set(whole) - set(steps[0]) == {50, 51, 52, 160}  # none, and one word of no language
    assert all(len(t.split()) >= 10 for t in steps[1].values())
    # one document of each group
    groups = brute(sorted(steps[1].items()), 5, 80)
    assert set(steps[2]) == {root for _, _, root in groups}
    assert set(steps[3]) <= set(steps[2])
    items = [r["text"] for r in spark.read.parquet(f"{path}/benchmark.parquet").collect() if r["text"] and len(r["text"].split()) >= 10]
    assert all(item not in t for item in items for t in steps[3].values())
    assert any(item in t for item in items for t in steps[2].values())
    v = bpe.vocabulary(bpe.tokenizer_path())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(steps[3])
    for i, t in steps[3].items():
        assert bpe.decode_ids(v, got[i]["ids"]) == t
        assert (got[i]["n_tokens"], got[i]["n_chars"]) == (len(got[i]["ids"]), len(t))


def test_clashing_columns_nulls_and_repeats(spark, tables):
    path, docs = tables
    good = next(d["text"] for d in docs if d["doc_id"] not in (50, 51, 52) and len((d["text"] or "").split()) == 90)
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (None, None, None, None, None), (None, good + " more", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("score", "lang_pred", "kept", "k0", "id", "of", "n_hit", "row"):
        df = df.withColumn(c, F.lit(c))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, path)
    assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [r["doc_id"] for r in df.collect()].count(1) <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, df, path).columns == ["doc_id", "n_tokens", "ids", "n_chars"]


@pytest.mark.parametrize("name", ["documents"])
def test_an_empty_table(spark, tables, name):
    path, _ = tables
    df = spark.read.parquet(f"{path}/{name}.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, path)
        assert df.count() == 0


def test_representatives_of_repeated_rows(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (6, "z y x w v u")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in jaccard.representatives(df).collect()) == [3, 6]


def test_texts_in_no_learned_language_are_dropped(spark, tables):
    """Longer texts of unlearned scripts and gibberish go, texts in the learned languages stay."""
    path, _ = tables
    rng = random.Random(3)
    letters = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    letters += ["".join(map(chr, range(a, b))) for a, b in ((0x430, 0x450), (0x3B1, 0x3CA), (0x627, 0x64B), (0x4E00, 0x5E00))]
    made = lambda s, n: " ".join("".join(rng.choice(s) for _ in range(rng.randint(2, 9))) for _ in range(n))
    foreign = [(1000 + i, made(s, n), None, "s", 1) for i, (s, n) in enumerate((s, n) for s in letters for n in (100, 300) for _ in range(10))]
    own = [(i, text_of(rng, lang, n), lang, "s", 1) for i, (lang, n) in enumerate((lang, n) for lang in ("en", "de", "fr") for n in (12, 40, 100, 300) for _ in range(40))]
    df = spark.createDataFrame(own + foreign, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, df, path).collect()}
    assert not {i for i in kept if i >= 1000}
    assert len(kept) >= 0.99 * len(own)


def test_cutoffs_keep_all_but_few_of_the_held_out_texts(spark):
    rng = random.Random(4)
    rows = [(i, text_of(rng, "en", rng.choice([2, 20, 200])), "en") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = langid.learn(df.where("doc_id < 300"))
    least = langid.cutoffs((df.where("doc_id >= 300"), profiles))
    got = langid.predict(df.where("doc_id >= 300"), profiles, size_col="size").withColumn("length", langid.length_of(F.col("size"))).collect()
    assert all(r["score"] >= least[r["length"]] for r in got)  # one in a thousand of fewer than that is none
    assert min(least) >= langid.FLOOR
    assert least[max(r["length"] for r in got)] > 0.5
    assert set(langid.cutoffs((df.limit(0), {}))) == {langid.FLOOR}
    halves = [langid.learn(df.where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    assert langid.added(*halves) == langid.learn(df)
