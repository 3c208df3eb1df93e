"""The registered queries: each applies its operator to the whole of its tables and derives the columns asked for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.llm import bpe, decontaminate, hmm, htmltext, impact, jaccard, langid, quality, threshold, tokenfile, toxicity, urlfilter
from marrow.llm.common import fold, shared_dir, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op7_decontaminate"] = r"""
WITH folded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), patterns AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS p
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT n FROM patterns
), places AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, sizes WHERE len(w) >= n)
), hits AS (
    SELECT doc_id, n, i, item_id FROM places JOIN patterns USING (n, p)
), counted AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN counted USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 5) == 0)
    profiles = langid.learn(docs.where("NOT held_out"))
    return langid.predict(docs, profiles, keep=("held_out",))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _quality_sql() -> str:
    def broken(i: int) -> str:
        return " OR ".join(f"{quality.RULES[rule][0]} > {c}::DOUBLE" for rule, c in dict(quality.PATH[: i + 1]).items())

    steps = len(quality.PATH)
    tried = "\n    UNION ALL ".join(f"SELECT stratum, {i} AS step, count(*) AS n, count(*) FILTER (WHERE {broken(i)}) AS k FROM held GROUP BY stratum" for i in range(steps))
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.RISK!r}) + (n - i) * ln(1 - {quality.RISK!r}))"

    def cutoff(rule: str) -> str:
        at = [i for i, (r, _) in enumerate(quality.PATH) if r == rule]
        most = "greatest(0, " + ", ".join(f"CASE WHEN steps > {i} THEN b{i} ELSE 0 END" for i in at) + ")"
        return f"CASE WHEN {most} = 0 THEN NULL " + " ".join(f"WHEN steps > {i} AND b{i} = {most} THEN {quality.PATH[i][1]}::DOUBLE" for i in at) + " END"

    caught = ", ".join(f"count(*) FILTER (WHERE {quality.RULES[rule][0]} > {c}::DOUBLE) AS b{i}" for i, (rule, c) in enumerate(quality.PATH))
    rejects = " OR ".join(f"coalesce({feature} > {cutoff(rule)}, false)" for rule, (feature, *_) in quality.RULES.items())
    return rf"""
WITH split AS (
    SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)
), again AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeated AS (
    SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM again) GROUP BY doc_id
), features AS (
    SELECT doc_id, stratum, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
           len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals
    FROM split LEFT JOIN repeated USING (doc_id)
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM features
), rated AS (
    SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), all_held AS (
    SELECT DISTINCT stratum, text, good, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals FROM judged JOIN rated USING (doc_id) WHERE NOT base_failed
), held AS (
    FROM all_held WHERE good
), bad AS (
    SELECT stratum, {caught} FROM all_held WHERE NOT good GROUP BY stratum
), tried AS (
    {tried}
), sums AS (
    SELECT stratum, step, n, list_sum([{term} for i in range(0, k + 1)]) AS p FROM tried
), first_dealt AS (
    SELECT stratum, n, coalesce(min(step) FILTER (WHERE p > {quality.DELTA} * n / (SELECT sum(n) FROM sums WHERE step = 0)), {steps}) AS steps FROM sums GROUP BY stratum, n
), unfinished AS (
    SELECT stratum FROM first_dealt WHERE steps < {steps}
), dealt_again AS (
    SELECT stratum, coalesce(min(step) FILTER (WHERE p > {quality.DELTA} * n / (SELECT sum(n) FROM first_dealt WHERE steps < {steps})), {steps}) AS steps FROM sums WHERE stratum IN (FROM unfinished) GROUP BY stratum
), chosen AS (
    FROM dealt_again UNION ALL SELECT stratum, steps FROM first_dealt WHERE steps = {steps}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejects}) AS kept FROM judged LEFT JOIN chosen USING (stratum) LEFT JOIN bad USING (stratum)
"""


ORACLES["op1_quality"] = _quality_sql()


@query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def _urls_sql() -> str:
    fits = [(f"((host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}'))", d + p, what) for what, d, p in sorted(urlfilter.RULES, key=lambda r: -len(r[1]) - len(r[2]))]
    listed = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in urlfilter.LISTED_DOMAINS)
    return rf"""
WITH parts AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)} END AS rule,
       CASE {' '.join(f"WHEN {f} THEN '{w}'" for f, _, w in fits)} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM parts
"""


ORACLES["op10_urls"] = _urls_sql()


@query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


ORACLES["op2_jaccard"] = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)] END)) AS s FROM split
), classes AS (
    SELECT s, len(s) AS n, min(doc_id) AS class_id FROM sets WHERE len(s) > 0 GROUP BY s
), members AS (
    SELECT class_id, n, unnest(s) AS g FROM classes
), counts AS (
    SELECT g, count(*) AS df FROM members GROUP BY g
), foremost AS (
    SELECT class_id, n, g FROM members JOIN counts USING (g) QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY df, g) <= n - (85 * n + 99) // 100 + 1
), candidates AS (
    SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM foremost a JOIN foremost b USING (g) WHERE a.class_id < b.class_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), links AS (
    SELECT a, b FROM candidates c JOIN classes x ON x.class_id = a JOIN classes y ON y.class_id = b
    WHERE 100 * len(list_intersect(x.s, y.s)) >= 85 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT class_id AS a, class_id AS b FROM classes
    UNION
    SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), components AS (
    SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(class_id, doc_id) AS class_id, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN components USING (class_id)
"""


@query
def op2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_jaccard with the number of links of each document's class."""
    return jaccard.with_links(table(spark, sf_dir, "documents"))


ORACLES["op2_links"] = f"""
SELECT j.*, coalesce(n_links, 0) AS n_links
FROM ({ORACLES["op2_jaccard"]}) j
LEFT JOIN ({ORACLES["op2_jaccard"].rpartition("SELECT doc_id, len(sets.s)")[0]} SELECT a AS class_id, count(*) AS n_links FROM both_ways GROUP BY a) USING (class_id)
"""


@query
def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 7) == 2)
    return hmm.score(docs, keep=("held_out",))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = toxicity.rate(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return rated.withColumn("toxic", F.coalesce(F.col("grade") > 0, F.lit(False)))


@query
def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    tokenfile.write(table(spark, sf_dir, "documents"), path)
    return tokenfile.digests(tokenfile.read(spark, path))


@query
def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLES["op12_topk"] = """
WITH whole AS (
    SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id, v) AS copy FROM (SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings)
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asked AS (
    SELECT * FROM whole WHERE vec_id % 50 = 0 AND copy = 1
), scored AS (
    SELECT q.vec_id AS query_id, q.v, w.vec_id, list_sum(list_transform(list_zip(q.v, w.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM asked q JOIN whole w ON len(w.v) = len(q.v) AND (w.vec_id IS DISTINCT FROM q.vec_id OR w.v <> q.v OR w.copy > 1)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id NULLS LAST) <= 5
"""


@query
def op11_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.search(impact.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 50)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op11_impact"] = f"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents
), held AS (
    SELECT r, doc_id, t, len(t) AS n FROM split WHERE len(t) > 0
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM held
), lengths AS (
    SELECT r, doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM held, totals
), counts AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM held) GROUP BY r, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY term, docs
), asked AS (
    SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)
), scored AS (
    SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (r) GROUP BY item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) <= 50
"""
