import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marrow.llm import tokenfile
from marrow.llm.bpe import tokenizer_path
from marrow.llm.common import shared_dir
from marrow.llm.queries import QUERIES


@pytest.mark.parametrize("n", [0, 1, 2, 3, 63, 64, 65, 1000])
@pytest.mark.parametrize(("size", "block"), [(3, 64), (49408, 64), (1, 16), (1 << 20, 512)])
def test_round_trips(n, size, block):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, size, n), np.zeros(n, int), np.full(n, size - 1), np.arange(n) % min(size, 7)):
        assert (tokenfile.decode_frame(tokenfile.encode_frame(ids, size, block)) == ids).all()


def test_predictable_ids_are_small():
    ids = np.tile(np.arange(50), 400)
    assert len(tokenfile.encode_frame(ids, 49408, 20000)) < len(ids) // 4
    rng = np.random.default_rng(0)
    skew = np.minimum(rng.geometric(0.02, 20000), 49407)
    assert len(tokenfile.encode_frame(skew, 49408, 4096)) < 2 * len(skew)


def test_blocks_are_reset():
    """The same ids as two blocks have the same words twice."""
    rng = np.random.default_rng(5)
    one = rng.integers(0, 1000, 256)
    frame = tokenfile.encode_frame(np.r_[one, one], 1000, 256)
    start = tokenfile.HEAD.size + tokenfile.HEAD.unpack_from(frame)[5] + 16  # after the alphabet, lengths and checksums
    body = frame[start:]
    assert body[: len(body) // 2] == body[len(body) // 2 :]


def test_real_ids_beat_static_frequencies():
    """Fewer bits than the frequencies of the ids could give, alphabet and checksums included, and than order 0 over a blind order."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")
    ids, _ = tokenfile.tokenizer(tokenizer_path("word_bpe_49k.json")).encode([x or "" for x in table.column("text").to_pylist()], 1)
    frame = tokenfile.encode_frame(ids, 49408)
    assert (tokenfile.decode_frame(frame) == ids).all()
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert 8 * len(frame) / len(ids) < -(share * np.log2(share)).sum() - 0.3


def test_damage_is_found():
    rng = np.random.default_rng(6)
    frame = bytearray(tokenfile.encode_frame(rng.integers(0, 500, 900), 500, 128))
    for at in (*range(tokenfile.HEAD.size + 70, len(frame) - 8, 97),):
        bad = bytearray(frame)
        bad[at] ^= 0x55
        with pytest.raises(ValueError, match="checksum|cut short"):
            tokenfile.decode_frame(bytes(bad))
    for cut in (frame[:-2], frame[:30], b"", b"XXXX" + frame[4:]):
        with pytest.raises(ValueError, match="cut short|no frame"):
            tokenfile.decode_frame(bytes(cut))
    with pytest.raises(ValueError, match="not below"):
        tokenfile.encode_frame(np.array([500]), 500)


def test_ids_are_the_librarys():
    rng = random.Random(1)
    parts = ["th", "É", " ", "ß", "#$", "12", "ing", "'s", "'LL", "😀", "A", "\t", "\xa0", "\u0301", "İ", "ŉ", "<|endoftext|>", "ª²", "日", "\x85", "ǅ", "."]
    texts = ["", *("".join(rng.choice(parts[: rng.choice([8, 9, 22])]) for _ in range(rng.randint(0, 60))) for _ in range(400)), "x" * 3000]
    w = tokenfile.tokenizer(tokenizer_path("word_bpe_49k.json"))
    ids, at = w.encode(texts, 1)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*w.whole.encode(t, add_special_tokens=False).ids, 1], repr(t)


def test_signs_behind_words_are_pieces_of_their_own():
    """A word is learned once, whatever signs follow it, and the ids are the library's."""
    words, signs = [a + b for a in "tabcé" for b in ("and", "xq", "ßa")], ["", ",", ".", "?!", "'", ".'", "<|>"]
    w = tokenfile.tokenizer.__wrapped__(tokenizer_path("word_bpe_49k.json"))
    texts = [f"{a}{b} {a.upper()}{b}" for a in words for b in signs]
    w.encode(texts, 1)
    assert w.held.size <= 1 + 2 * len(words) + len(signs)  # é and É are two
    rng = random.Random(2)
    odd = ["×", "÷", "İ", "'", "s", "É", "µ", "ª", "́", "ﬁ", "7", ",", "<|endoftext|>", "|>", "Ⱥ", "ǅ", " ", "\xa0", "=", "\u0338"]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    ids, at = w.encode(texts, 1)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*w.whole.encode(t, add_special_tokens=False).ids, 1], repr(t)


def test_files_in_order_of_ids(spark, tables):
    from tokenizers import Tokenizer

    path, docs = tables
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = sorted(QUERIES["op6_tokenfile"](spark, path).collect(), key=lambda r: r["doc_id"])
    start = 0
    for d, r in zip(sorted(docs, key=lambda d: d["doc_id"]), got, strict=True):
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_rows_of_one_id_are_dealt(spark):
    """Half of the rows have one id, a quarter none: no shard has most of the ids."""
    rows = [(7 if i % 2 else None if i % 4 else i, f"word {i} " * 20) for i in range(2000)]
    path = f"{shared_dir(spark)}/hot-{random.random()}"
    tokenfile.write(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), path)
    files = spark.read.parquet(path).selectExpr("shard", "aggregate(sizes, 0L, (s, x) -> s + x) AS n").groupBy("shard").sum("n").collect()
    each = [r[1] for r in files]
    assert len(each) < 2 or max(each) < 0.6 * sum(each)
    assert tokenfile.read(spark, path).selectExpr("sum(size(ids))").first()[0] == sum(each)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 4)
    monkeypatch.setattr(tokenfile, "LANES", 2)
    rows = [(2, "b " * 30, 1), (None, None, 1), (1, "", 1), (2, "b " * 30, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int").withColumn("ids", F.lit(1)).withColumn("at", F.lit(1))
    for i, d in enumerate((df, df.limit(0))):
        path = f"{shared_dir(spark)}/edge-{i}-{random.random()}"
        tokenfile.write(d, path)
        got = sorted((str(r["doc_id"]), r["start"], r["n_tokens"]) for r in tokenfile.digests(tokenfile.read(spark, path)).collect())
        assert got == ([] if i else [("1", 1, 1), ("2", 2, 31), ("2", 33, 31), ("None", 0, 1)])
