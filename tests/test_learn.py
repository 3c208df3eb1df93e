import json
import math
import random

import numpy as np
import pytest

from marrow.operators import learn
from marrow.operators.embed import StaticEmbedder

WORDS = ["[UNK]", *[f"w{i}" for i in range(40)], "never"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({w: i for i, w in enumerate(WORDS)}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    return t.to_str()


@pytest.fixture
def settle(tmp_path):
    def run(df, name):
        path = f"{tmp_path}/{name}-{random.random()}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return run


def texts(n, seed=1):
    """Words of one of four topics in each text."""
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(10) + 10 * (i % 4) if rng.random() < 0.9 else rng.randrange(40)}" for _ in range(rng.choice([0, 1, 2, 9, 60]))) for i in range(n)]


def dense(rows, window):
    """The matrix by its definition."""
    c = np.zeros((len(WORDS), len(WORDS)))
    for text in rows:
        ids = [WORDS.index(w) if w in WORDS else 0 for w in (text or "").split()]
        for a in range(len(ids)):
            for d in range(1, window + 1):
                if a + d < len(ids):
                    c[ids[a], ids[a + d]] += math.factorial(window) // d
                    c[ids[a + d], ids[a]] += math.factorial(window) // d
    n = c.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.log(c * c.sum() / np.outer(n, n))
    return np.where(c > 0, np.maximum(m, 0), 0), n


def coded(spark, rows, tokenizer):
    df = spark.createDataFrame([(i, t, [9]) for i, t in enumerate(rows)], "doc_id long, text string, ids array<int>")
    return learn.token_ids(df, ("doc_id",), "text", tokenizer)


@pytest.mark.parametrize(("dims", "window"), [(42, 4), (8, 2)])
def test_against_a_dense_factorisation(spark, settle, tokenizer, monkeypatch, dims, window):
    monkeypatch.setattr(learn, "SLICE_IDS", 50)
    rows = [*texts(300), None, "", "stranger w1", "w1 w1 w1"]
    model = learn.learn(settle(coded(spark, rows, tokenizer), "ids"), tokenizer, settle, dims, window)
    m, n = dense(rows, window)
    value, vector = np.linalg.eigh(m)
    order = np.argsort(-np.abs(value))[:dims]
    want = vector[:, order] * np.sqrt(np.abs(value[order])) * (learn.RARE / (learn.RARE + n / n.sum()))[:, None]
    got = model.rows()
    # vectors are told up to a turn of equal eigenvalues: their products are not; bytes are within half a step
    assert np.abs(got @ got.T - want @ want.T).max() < 0.02 * np.abs(want @ want.T).max()
    assert not got[WORDS.index("never")].any()
    assert model.matrix.dtype == np.int8


def test_counts_are_whole_and_by_key(spark, settle, tokenizer):
    found = {(r["i"], r["j"]): r["n"] for r in learn.pair_counts(coded(spark, ["w0 w1 w0", None, "w2", "", "w3 w3"], tokenizer), len(WORDS), 2).collect()}
    assert found == {(1, 2): 4, (1, 1): 2, (4, 4): 4}


def test_the_model_folder(spark, settle, tokenizer, tmp_path):
    rows = texts(200, 3)
    ids = settle(coded(spark, rows, tokenizer), "ids")
    model = learn.learn(ids, tokenizer, settle, 16)
    model.save(str(tmp_path / "model"))
    loaded = StaticEmbedder(str(tmp_path / "model"))
    assert loaded.name == model.name
    want = loaded.embed(rows)
    got = {r["doc_id"]: r["embedding"] for r in model.vectors(ids, ("doc_id",)).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], want, atol=1e-5)
    assert json.loads((tmp_path / "model" / "tokenizer.json").read_text())["model"]["type"] == "WordLevel"
    # texts of one topic are nearer to each other than to those of another
    long = [i for i, t in enumerate(rows) if len(t.split()) == 60]
    near = want[long] @ want[long].T
    same = np.equal.outer(np.array(long) % 4, np.array(long) % 4)
    assert near[same].min() > near[~same].max()


def test_no_texts(spark, settle, tokenizer):
    none = learn.learn(settle(coded(spark, [None, ""], tokenizer), "ids"), tokenizer, settle, 4)
    assert not none.matrix.any()
    assert [r["embedding"] for r in none.vectors(coded(spark, ["w1", None], tokenizer), ("doc_id",)).collect()] == [[0.0] * 4] * 2


def test_the_size_is_checked(spark, settle, tokenizer, monkeypatch):
    monkeypatch.setattr(learn, "MAX_NUMBERS", 100)
    with pytest.raises(ValueError, match="more than"):
        learn.learn(coded(spark, ["w1"], tokenizer), tokenizer, settle, 4)


def test_ids_are_those_of_whole_texts(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(learn, "SLICE_BYTES", 300)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        given = f.read()
    library = Tokenizer.from_str(given)
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows += [None, "", " ", "\n\n", "It's  a\ttest, don't!\r\nUPPER Été 日本 a\u00a0b x\u2003y", "1234 5.6 #tag @x", "word " * 3000]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in learn.token_ids(df, ("doc_id",), "text", given).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(rows)}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        keeps = f.read()
    with pytest.raises(Exception, match="keeps white space"):
        learn.token_ids(df, ("doc_id",), "text", keeps).collect()


def test_words_of_the_given_tokenizer_are_encoded_once(spark):
    """token_ids are the library's, and a word that comes with other signs is not encoded again."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from marrow.operators.pieces import Words

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    rows = [" ".join(f"{w}{s}" for w in ("one", "Two", "éa") for s in ("", ",", ".", "!")), "", "it's 12 × <|endoftext|>,\x0bİ, b"]
    made = Words(tokenizer)
    ids, starts = made.encode(rows[:1], None)
    assert made.held.size == 1 + 3 + 3
    want = [Tokenizer.from_str(tokenizer).encode(t, add_special_tokens=False).ids for t in rows]
    assert ids.tolist() == want[0] and starts.tolist() == [0, len(want[0])]
    assert [r["ids"] for r in coded(spark, rows, tokenizer).orderBy("doc_id").collect()] == want
