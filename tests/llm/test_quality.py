import math

from pyspark.sql import functions as F

from marrow.llm import quality


def binomial_cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_exact_binomial(spark):
    rows = [(k, n) for n in (1, 5, 50, 400) for k in (0, 1, 3, n // 2, n) if k <= n]
    df = spark.createDataFrame(rows, "k bigint, n bigint")
    for p in (0.004, 0.3):
        for r in df.withColumn("ln", quality.log_binomial_cdf(F.col("k"), F.col("n"), p)).collect():
            assert math.isclose(math.exp(r["ln"]), binomial_cdf(r["k"], r["n"], p), rel_tol=1e-9)
    assert math.isfinite(df.limit(1).select(quality.log_binomial_cdf(F.lit(100).cast("long"), F.lit(1_000_000).cast("long"), 0.01)).first()[0])


def naive(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 5))
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_features(spark):
    texts = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n \n \nx\r\nx\r", "é😀 #|<> \x0b\x0c y", "a b c d e f g a b c d e h a b c d e f", "\xa0nbsp   ls", "w " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("lang", F.lit(None).cast("string"))
    for r in quality.features(df).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == (naive(texts[r["id"]]) if r["id"] < 10 else (4000, 4000, 0, 0, 4000)), texts[r["id"]]


def test_cutoffs_are_certified_per_stratum(spark):
    clean = [(i, "en" if i % 2 else "de", f"word{i} " + " ".join(f"x{i}y{j}" for j in range(12))) for i in range(6000)]
    junk = [(10_000 + i, "en", " ".join(f"x{i}y{j}###" for j in range(12))) for i in range(50)]
    rare = [(20_000 + i, "fr", " ".join(f"x{i}y{j}###" for j in range(12))) for i in range(50)]
    df = spark.createDataFrame([*clean, *junk, *rare], "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([*((i, 1) for i, _, _ in clean), *((i, 0) for i, _, _ in junk), (None, 1), (1, None)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.judge(df, labels).collect()}
    assert all(got[i]["kept"] for i, _, _ in clean)
    assert all(got[i]["rejected_by"] == "symbols" for i, _, _ in junk)
    assert all(got[i]["kept"] for i, _, _ in rare)  # no labels, no certificate
    kept = quality.accept(df.withColumn("row", F.lit(1)).withColumn("kept", F.lit(2)), labels)
    assert kept.columns == ["doc_id", "lang", "text", "row", "kept"]
    assert kept.count() == len(clean) + len(rare)


def test_false_rejections_stay_limited(spark):
    """A feature that every good text may have is not cut where too many would go."""
    good = [(i, "en", " ".join([f"x{i}y{j}" for j in range(20)]) + (" ####" if i % 20 == 0 else "")) for i in range(3000)]
    df = spark.createDataFrame(good, "doc_id bigint, lang string, text string")
    labels = df.select("doc_id", F.lit(1).alias("quality"))
    assert quality.judge(df, labels).where("NOT kept").count() <= quality.RISK * 3000


def test_a_repeated_text_is_one_trial(spark):
    """Neither rows that repeat an id nor copies under other ids certify anything."""
    text = " ".join(f"x{j}" for j in range(20))
    for rows in ([(1, "en", text)] * 3000, [(i, "en", text) for i in range(3000)]):
        df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
        cut = quality.thresholds(quality.features(df), df.select("doc_id", F.lit(1).alias("quality")).distinct()).collect()
        assert [r["n"] for r in cut] == [1]
        assert all(cut[0][rule] is None for rule in quality.RULES)


def test_levels_are_dealt_by_labels_and_handed_on(spark):
    """How many clean texts a stratum needs: alone the whole delta is its own; beside one that gets through, that one's is handed on."""
    def rows(lang, n):  # and one bad text
        return [(lang, i, 20, 100, 90 if i == n else 0, 0, 0, 0) for i in range(n + 1)]

    def certified(*parts):
        data = [(100_000 * j + i, *r) for j, p in enumerate(parts) for i, r in enumerate(p)]
        feats = spark.createDataFrame(data, "id bigint, stratum string, hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_capitals bigint")
        cut = quality.thresholds(feats, feats.select(F.col("id").alias("doc_id"), (F.col("n_symbols") == 0).cast("int").alias("quality"))).collect()
        return {r["stratum"]: r["symbols"] for r in cut}

    least = math.ceil(math.log(quality.DELTA) / math.log1p(-quality.RISK))
    assert certified(rows("en", least)) == {"en": 0.3}
    assert certified(rows("en", least - 1)) == {"en": None}
    assert certified(rows("en", 3000), rows("de", least), rows("fr", 5)) == {"en": 0.3, "de": 0.3 if (1 - quality.RISK) ** least <= quality.DELTA * least / (least + 5) else None, "fr": None}
    assert certified(rows("en", 3000), rows("de", least)) == {"en": 0.3, "de": 0.3}


def test_the_loosest_cutoff_that_rejects_as_much(spark):
    """A rule goes as far as bad texts call for, and not at all where it meets none."""
    feats = [(i, "en", i, 20, 100, 0, 0, 0, 0) for i in range(3000)] + [(5000 + i, "en", 5000 + i, 20, 100, s, 0, 0, 0) for i, s in enumerate((40, 12, 11, 4))]
    df = spark.createDataFrame(feats, "id bigint, stratum string, hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_capitals bigint")
    cut = quality.thresholds(df, df.select(F.col("id").alias("doc_id"), (F.col("id") < 5000).cast("int").alias("quality"))).first()
    assert cut["symbols"] == 0.03
    assert [cut[rule] for rule in ("length", "capitals", "lines", "repeats")] == [None] * 4
    less = df.where("id < 5003")
    assert quality.thresholds(less, less.select(F.col("id").alias("doc_id"), (F.col("id") < 5000).cast("int").alias("quality"))).first()["symbols"] == 0.1


def test_cutoffs_bind_where_the_sql_checks_them(spark):
    from marrow.llm.queries import QUERIES

    got = QUERIES["op1_quality"](spark, "/root/testdata/sf0.01")
    assert got.where("NOT base_failed AND NOT kept").count() > 0
    bad = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 0")
    assert got.join(bad, "doc_id").where("kept").count() < got.join(bad, "doc_id").where("NOT base_failed").count()


def test_edges(spark, check_sql):
    check_sql(spark, "op1_quality")
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, quality int")
    assert quality.judge(none, none).count() == 0
    one = spark.createDataFrame([(None, None, None, 5), (1, "a", "x", 5), (1, "a", "x", 5)], "doc_id bigint, text string, lang string, id int")
    got = quality.judge(one, none).collect()
    assert len(got) == 3
    assert all(r["base_failed"] and not r["kept"] for r in got)


def test_no_python(spark, tables):
    from marrow.llm.queries import QUERIES

    plan = QUERIES["op1_quality"](spark, tables[0])._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
