"""The library's own queries by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions import text as X
from marrow.operators import blockmax, bm25, dense, embed, forward, fuse, learn, notes
from marrow.plans import index, search
from marrow.session import shared_dir
from marrow.sources import sinks, vault

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
QUESTION = "the and of retion"
REPEATED = "retion the retion retion"
TOP = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(text).alias("query"))


def plain_index(spark: SparkSession, sf_dir: str) -> bm25.Postings:
    return bm25.build(table(spark, sf_dir, "documents").select("doc_id", "text"), ("doc_id",), X.tokens(F.col("text")))


def text_search(spark: SparkSession, sf_dir: str, queries: DataFrame, limit: int) -> DataFrame:
    return blockmax.search_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ("doc_id",), F.col("text"), queries, limit, settled)


# --- Sparse leg

TOKENS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"
WORDS = f"words AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)"
COUNTS = f"""{WORDS}, lengths AS (SELECT doc_id, len(w) AS dl FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stats AS (SELECT count(*) AS doc_count, sum(dl) / count(*) AS avgdl FROM lengths)"""
IDF = "ln((doc_count - df + 0.5) / (df + 0.5) + 1)"


def bm25_sql(questions: str, limit: int) -> str:
    """questions: SQL for (query_id, query)."""
    return f"""{COUNTS}, questions AS ({questions}),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS term FROM questions) GROUP BY query_id, term),
scored AS (SELECT query_id, doc_id, round(sum(times * {IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
           FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), stats GROUP BY query_id, doc_id),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored WHERE score > 0
           QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {limit})"""


@query(f"WITH {WORDS} SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_terms FROM words")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_terms"))


@query(f"WITH {COUNTS} SELECT doc_id, dl, term, tf FROM tf JOIN lengths USING (doc_id)")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_index(spark, sf_dir).postings


@query(f"WITH {COUNTS} SELECT term, df FROM df")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_index(spark, sf_dir).terms


@query(f"WITH {COUNTS} SELECT doc_count, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_index(spark, sf_dir).stats.select("doc_count", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {COUNTS} SELECT term, round({IDF}, 6) AS idf FROM df, stats")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plain_index(spark, sf_dir)
    joined = found.terms.crossJoin(F.broadcast(found.stats))  # stats is one row
    return joined.select("term", F.round(bm25.idf(F.col("doc_count"), F.col("df")), 6).alias("idf"))


@query(f"WITH {bm25_sql(f'SELECT 0 AS query_id, $${QUESTION}$$ AS query', TOP)} SELECT query_id, doc_id, score, rank FROM sparse")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search(spark, sf_dir, one_query(spark, QUESTION), TOP)


@query(f"WITH {bm25_sql(f'SELECT 0 AS query_id, $${REPEATED}$$ AS query', TOP)} SELECT query_id, doc_id, score, rank FROM sparse")
def bm25_dup_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search(spark, sf_dir, one_query(spark, REPEATED), TOP)


@query(f"WITH {bm25_sql('SELECT item_id AS query_id, text AS query FROM benchmark', TOP)} SELECT query_id, doc_id, score, rank FROM sparse")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search(spark, sf_dir, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), TOP)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def document_blocks(spark: SparkSession, sf_dir: str) -> blockmax.Blocks:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return blockmax.opened(settled(blockmax.blocks(docs, ("doc_id",), X.tokens(F.col("text"))), "blocks"), ("doc_id",))


@query(ORACLES["bm25_batch"])
def bm25_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_batch over postings that are written in blocks with their bounds, and read only where a bound reaches the last place."""
    index = document_blocks(spark, sf_dir)
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return blockmax.search(index, questions, TOP, settled)


@query(
    f"""WITH {bm25_sql('SELECT item_id AS query_id, text AS query FROM benchmark', TOP)}
SELECT query_id, doc_id, any_value(score) AS score, count(*) AS n_terms, sum(tf)::BIGINT AS n_words FROM sparse JOIN asked USING (query_id) JOIN tf USING (doc_id, term) GROUP BY query_id, doc_id"""
)
def bm25_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of bm25_batch as pairs, scored anew from a forward index: the score, how many of the question's words are in the text, and how often."""
    docs, key = table(spark, sf_dir, "documents").select("doc_id", "text"), ("doc_id",)
    words = X.tokens(F.col("text"))
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    blocks = document_blocks(spark, sf_dir)
    pairs = settled(blockmax.search(blocks, questions, TOP, settled).select("query_id", *key), "pairs")
    index = settled(forward.build(docs, key, words), "forward")
    asked = settled(bm25.query_terms(questions).select("term").distinct(), "asked")
    terms = blocks.blocks.join(F.broadcast(asked) if asked.count() <= bm25.MAX_BROADCAST_TERMS else asked, "term").groupBy("term").agg(F.sum("df").alias("df"))
    found = forward.score(index, key, terms, blocks.stats, questions, pairs)
    tf = F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x["tf"])
    return found.select("query_id", "doc_id", "score", F.size("parts").cast("long").alias("n_terms"), tf.alias("n_words"))


FIELDED_SQL = f"""
WITH words AS (
    SELECT doc_id, unnest(list_concat({TOKENS.format('text')}, {TOKENS.format('source')}, {TOKENS.format('lang')}, {TOKENS.format('lang')}, {TOKENS.format('lang')})) AS term FROM documents
) SELECT doc_id, (sum(tf) OVER (PARTITION BY doc_id))::BIGINT AS dl, term, tf FROM (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term)
"""


@query(FIELDED_SQL)
def bm25_fielded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return bm25.term_counts(docs, ("doc_id",), X.repeated_tokens([(F.col("text"), 1), (F.col("source"), 1), (F.col("lang"), 3)]))


# --- Dense leg


def dense_sql(questions: str, limit: int) -> str:
    """questions: SQL for (query_id, q)."""
    return f"""asked AS ({questions}),
near AS (SELECT query_id, vec_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 5) AS score FROM embeddings, asked),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM near
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {limit})"""


FIRST = "SELECT 0 AS query_id, embedding AS q FROM embeddings WHERE vec_id = 0"


def first_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.lit(0).cast("long").alias("query_id"), "embedding")


@query(f"WITH {dense_sql(FIRST, 50)} SELECT query_id, vec_id, score, rank FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.topk(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 50, ("vec_id",))


@query(f"WITH {dense_sql('SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0', TOP)} SELECT query_id, vec_id, score, rank FROM dense")
def dense_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return dense.topk(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), TOP, ("vec_id",))


@query(ORACLES["dense_batch"])
def dense_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense_batch with both sides dealt to blocks, as for any number of queries."""
    vectors = table(spark, sf_dir, "embeddings")
    return dense.block_topk(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), TOP, ("vec_id",))


@query()
def static_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents by a static model that is learned from them; no SQL for that, tests compare the model with a dense factorisation."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    coded = settled(learn.token_ids(table(spark, sf_dir, "documents"), ("doc_id",), "text", tokenizer), "token-ids")
    return learn.learn(coded, tokenizer, settled).vectors(coded, ("doc_id",))


# --- Fusion and ranking: vectors stand for the documents of the same id, sources for notes

#: What each leg sends to the fusion, by the rule for a top k.
LIMIT = fuse.over_fetch(sys.maxsize, TOP)
LEGS = f"{bm25_sql(f'SELECT 0 AS query_id, $${QUESTION}$$ AS query', LIMIT)}, {dense_sql(FIRST, LIMIT).replace('asked AS', 'vectors AS').replace(', asked)', ', vectors)')}"
UNION = f"""{LEGS}, candidates AS (
    SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.vec_id, s.doc_id) AS doc_id, d.rank AS dense_rank, s.rank AS sparse_rank
    FROM dense d FULL OUTER JOIN sparse s ON d.query_id = s.query_id AND d.vec_id = s.doc_id
)"""
LEG = "coalesce(1::FLOAT / (60 + {})::FLOAT, 0::FLOAT)"
RRF = f"""{UNION}, fused AS (
    SELECT *, ({LEG.format('dense_rank')} + {LEG.format('sparse_rank')})::FLOAT AS score FROM candidates
)"""
#: The whole query against names: sources are names, langs tags.
BOOST = "(CASE WHEN '{q}' = source THEN 1.5 WHEN '{q}' = '#' || lang THEN 1.25 ELSE 1 END)::FLOAT"
SATURATED = """halved AS (
    SELECT *, (score * power(0.5, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) - 1)::FLOAT)::FLOAT AS adjusted FROM named
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, source, doc_id) AS place FROM halved
)"""


def legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    near = dense.topk(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), LIMIT, ("vec_id",)).withColumnRenamed("vec_id", "doc_id")
    return near, text_search(spark, sf_dir, one_query(spark, QUESTION), LIMIT)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.rrf(fuse.union(*legs(spark, sf_dir), ("doc_id",)))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    # at most LIMIT candidates a leg
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(F.broadcast(fused(spark, sf_dir)), "doc_id")


@query(f"WITH {LEGS} SELECT 'dense' AS leg, query_id, vec_id AS doc_id, score, rank FROM dense UNION ALL SELECT 'sparse', query_id, doc_id, score, rank FROM sparse")
def rank_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, sparse = legs(spark, sf_dir)
    return near.withColumn("leg", F.lit("dense")).unionByName(sparse.withColumn("leg", F.lit("sparse")))


@query(f"WITH {UNION} SELECT query_id, doc_id, coalesce(dense_rank, -1) AS dense_rank, coalesce(sparse_rank, -1) AS sparse_rank FROM candidates")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leg that does not have a document gives the rank -1."""
    return fuse.union(*legs(spark, sf_dir), ("doc_id",)).fillna(-1, ["dense_rank", "sparse_rank"])


@query(f"WITH {RRF} SELECT query_id, doc_id, coalesce(dense_rank, -1) AS dense_rank, coalesce(sparse_rank, -1) AS sparse_rank, round(score::DOUBLE, 9) AS score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).withColumn("score", F.round(F.col("score").cast("double"), 9)).fillna(-1, ["dense_rank", "sparse_rank"])


def boosts(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    factor = fuse.boost(F.lit(text), F.col("source"), nothing, nothing, F.array().cast("array<string>"), F.array("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", factor.cast("double").alias("boost"))


@query(f"SELECT doc_id, {BOOST.format(q='src3')}::DOUBLE AS boost FROM documents")
def boost_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosts(spark, sf_dir, "src3")


@query(f"SELECT doc_id, {BOOST.format(q='#fr')}::DOUBLE AS boost FROM documents")
def boost_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosts(spark, sf_dir, "#fr")


#: Questions put to every customer's note: in words that name it, or one of its tags, or nearly.
ASKED = {
    "name": ("c_custkey::VARCHAR", lambda c: c("name")),
    "title": ("c_name", lambda c: c("title")),
    "h1": ("'Customer'", lambda c: c("h1")),
    "alias": ("c_mktsegment", lambda c: c("aliases")[0]),
    "second alias": ("n_name || ', nation'", lambda c: c("aliases")[1]),
    "tag": ("'#' || n_name", lambda c: F.concat(F.lit("#"), c("tags")[0])),
    "tag within": ("'about (#' || n_name || '), please'", lambda c: F.concat(F.lit("about (#"), c("tags")[0], F.lit("), please"))),
    "longer tag": ("'#' || n_name || '-coast'", lambda c: F.concat(F.lit("#"), c("tags")[0], F.lit("-coast"))),
    "joined tag": ("'x#' || n_name", lambda c: F.concat(F.lit("x#"), c("tags")[0])),
    "joined at first": ("'x#' || n_name || ' #' || n_name", lambda c: F.concat(F.lit("x#"), c("tags")[0], F.lit(" #"), c("tags")[0])),
    "case": ("lower(c_name)", lambda c: F.lower(c("title"))),
    "blank": ("c_name || ' '", lambda c: F.concat(c("title"), F.lit(" "))),
}
NAMES, TAGS = ("name", "title", "h1", "alias", "second alias"), ("tag", "tag within")


@query(
    "WITH asked AS ("
    + " UNION ALL ".join(f"SELECT c_custkey, '{k}' AS how, {sql} AS question FROM customer JOIN nation ON c_nationkey = n_nationkey" for k, (sql, _) in ASKED.items())
    + f") SELECT 'customers/' || c_custkey || '.md' AS path, how, question, CASE WHEN how IN {NAMES} THEN 1.5 WHEN how IN {TAGS} THEN 1.25 ELSE 1 END::DOUBLE AS boost FROM asked"
)
def boost_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's note, read from its markdown, asked for by each of its names and tags, and by what is nearly one: what the score is multiplied by."""
    notes_of = notes.parse(customer_files(spark, sf_dir)).drop("chunks", "error")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("how"), f(F.col).alias("question")) for k, (_, f) in ASKED.items()]))
    rows = notes_of.select("*", asked.alias("q")).select("path", "name", "title", "h1", "aliases", "tags", "q.how", "q.question")
    factor = fuse.boost(*(F.col(c) for c in ("question", "name", "title", "h1", "aliases", "tags")))
    return rows.select("path", "how", "question", factor.cast("double").alias("boost"))


@query(f"WITH {RRF}, named AS (SELECT f.*, source FROM fused f JOIN documents USING (doc_id)), {SATURATED} SELECT doc_id, source, place, round(adjusted::DOUBLE, 9) AS score FROM placed WHERE place <= {TOP}")
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = fuse.saturate(named(spark, sf_dir), "source", ("doc_id",), TOP)
    return best.select("doc_id", "source", "place", F.round(F.col("score").cast("double"), 9).alias("score"))


@query(
    f"""WITH {RRF}, named AS (SELECT f.query_id, f.doc_id, source, (score * {BOOST.format(q=QUESTION)})::FLOAT AS score FROM fused f JOIN documents USING (doc_id)), {SATURATED}
SELECT doc_id, source, place, round(adjusted::DOUBLE, 9) AS score FROM placed WHERE place <= {TOP}"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs, fusion, boosts and saturation in one plan."""
    nothing = F.lit(None).cast("string")
    factor = fuse.boost(F.lit(QUESTION), F.col("source"), nothing, nothing, F.array().cast("array<string>"), F.array("lang"))
    rows = named(spark, sf_dir).withColumn("score", fuse.boosted(F.col("score"), factor))
    best = fuse.saturate(rows, "source", ("doc_id",), TOP)
    return best.select("doc_id", "source", "place", F.round(F.col("score").cast("double"), 9).alias("score"))


# --- Notes: markdown rendered from columns

def note_files(df: DataFrame, path: Column, text: Column) -> DataFrame:
    return df.select(path.alias("path"), F.encode(text, "UTF-8").alias("content"))


def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a note `# Conversation n`, `## role`, text. What is null counts as empty."""
    turns = table(spark, sf_dir, "conversations")
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("conv_id", "turn", "role", "text"))
    path = F.concat(F.lit("conv-"), conv, F.lit("-"), turn, F.lit(".md"))
    return note_files(turns, path, F.concat(F.lit("# Conversation "), conv, F.lit("\n## "), role, F.lit("\n"), F.btrim(text, F.lit(" \t\n\r")), F.lit("\n")))


@query(
    r"""
WITH turns AS (SELECT coalesce(conv_id::VARCHAR, '') AS conv, coalesce(turn::VARCHAR, '') AS turn, coalesce(role, '') AS role, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM conversations)
SELECT 'conv-' || conv || '-' || turn || '.md' AS path, CASE WHEN body = '' THEN [] ELSE ['Conversation ' || conv, role] END AS heading_trail, CASE WHEN body = '' THEN '' ELSE 'Conversation ' || conv || ' > ' || role END AS breadcrumb,
       CASE WHEN body = '' THEN 1 ELSE 3 END AS start_line, CASE WHEN body = '' THEN 1 ELSE 3 + len(body) - len(replace(body, chr(10), '')) END AS end_line, regexp_replace(body, '[ \t\r\n]', '', 'g') AS solid FROM turns
"""
)
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each turn's note the section that its chunks make up: trail, first and last line, and all that is not blank. A turn without text is a note of one chunk without a body."""
    parsed = notes.parse(turn_files(spark, sf_dir))
    trail = F.get("chunks", F.lit(0))["heading_trail"]
    lines = [F.array_min(F.transform("chunks", lambda c: c["start_line"])), F.array_max(F.transform("chunks", lambda c: c["end_line"]))]
    solid = F.regexp_replace(F.concat_ws("", F.transform("chunks", lambda c: c["body"])), r"[ \t\r\n]", "")
    return parsed.select("path", trail.alias("heading_trail"), X.breadcrumb(trail).alias("breadcrumb"), *[x.cast("long").alias(n) for x, n in zip(lines, ("start_line", "end_line"), strict=True)], solid.alias("solid"))


@query()
def turn_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns cut into chunks however long they are: SQL has no chunker."""
    rows = notes.chunk_rows(notes.parse(turn_files(spark, sf_dir)))
    return rows.select("path", F.col("chunk_seq").cast("long").alias("chunk_seq"), "heading_trail", X.breadcrumb(F.col("heading_trail")).alias("breadcrumb"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "body")


def _chunk_sql() -> str:
    """The chunks of every turn, on the hexadecimal digits of its text: the cuts one after another, then what a short piece is joined to."""
    target, hard, under = notes.TARGET, notes.HARD_MAX, notes.MERGE_UNDER
    nearest = lambda xs, less: f"list_min(list_transform({xs}, lambda x: abs(x - {less + target}) * 10000 + x)) % 10000"
    tail = "'((0A)|(0D))*$'"
    steps = f"""SELECT *, regexp_replace(substr(h, 2 * a + 1, 2 * size), {tail}, '') AS p FROM (
        SELECT *, CASE WHEN n - a <= {hard} THEN n - a WHEN len(good) > 0 THEN {nearest('good', 0)} WHEN len(fair) > 0 THEN {nearest('fair', 0)} WHEN len(late) > 0 THEN {nearest('late', 1)}
                       ELSE list_max(list_filter(range({hard - 3}, {hard + 1}), lambda x: NOT (w[2 * x + 1 : 2 * x + 2] BETWEEN '80' AND 'BF'))) END AS size
        FROM (SELECT *, list_filter(blank, lambda b: b BETWEEN {target // 2} AND {target + target // 2}) AS good, list_filter(blank, lambda b: b >= {target // 3}) AS fair, list_filter(ends, lambda i: i - 1 >= {target // 3}) AS late
        FROM (SELECT *, list_transform(list_filter(range(2, len(ends) + 1), lambda k: regexp_full_match(w[2 * ends[k - 1] + 1 : 2 * ends[k] - 2], '((20)|(09)|(0D))*')), lambda k: ends[k]) AS blank
        FROM (SELECT *, list_filter(range(1, {hard + 1}), lambda i: w[2 * i - 1 : 2 * i] = '0A') AS ends
        FROM (SELECT *, substr(h, 2 * a + 1, {2 * hard + 2}) AS w FROM {{}})))))"""
    cut = f"SELECT k, r, h, n, a, line, a + size AS e, line + len(list_filter(ends, lambda i: i <= size)) AS line_e, n - a <= {hard} AS final, p FROM ({steps})"
    return f"""
WITH RECURSIVE turns AS (
    SELECT row_number() OVER () AS r, coalesce(conv_id::VARCHAR, '') AS conv, 'conv-' || coalesce(conv_id::VARCHAR, '') || '-' || coalesce(turn::VARCHAR, '') || '.md' AS path, coalesce(role, '') AS role,
           hex(encode(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)))) AS h FROM conversations
), begun AS (
    SELECT 1::BIGINT AS k, r, h, len(h) // 2 AS n, 0::BIGINT AS a, 3::BIGINT AS line FROM turns WHERE h <> ''
), cuts AS (
    {cut.format('begun')}
    UNION ALL
    {cut.format('''(SELECT k + 1 AS k, r, h, n, e + len(s) // 2 AS a, line_e + (len(s) - len(replace(s, '0A', ''))) // 2 AS line FROM (SELECT *, regexp_extract(substr(h, 2 * e + 1), '^((0A)|(0D))*') AS s FROM cuts WHERE e < n))''')}
), pieces AS (
    SELECT r, k, line, CASE WHEN NOT final AND bare <> p AND (bare = '' OR right(bare, 2) IN ('0A', '0D')) THEN regexp_replace(bare, {tail}, '') WHEN final THEN substr(h, 2 * a + 1) ELSE p END AS piece
    FROM (SELECT *, regexp_replace(p, '((20)|(09))*$', '') AS bare FROM cuts)
), lined AS (
    SELECT r, k, line, piece, line + len(list_filter(range(1, len(piece) // 2 + 1), lambda i: piece[2 * i - 1 : 2 * i] = '0A')) AS last FROM pieces
), joined AS (
    SELECT r, k, 0::BIGINT AS seq, line, last, piece FROM lined WHERE k = 1
    UNION ALL
    SELECT r, k, CASE WHEN fits THEN seq ELSE seq + 1 END, CASE WHEN fits THEN line ELSE new_line END, new_last, CASE WHEN fits THEN piece || '0A' || new ELSE new END
    FROM (SELECT j.r, l.k, j.seq, j.line, j.piece, l.line AS new_line, l.last AS new_last, l.piece AS new, len(l.piece) < {2 * under} AND len(j.piece) + 2 + len(l.piece) <= {2 * hard} AS fits FROM joined j JOIN lined l ON l.r = j.r AND l.k = j.k + 1)
), chunks AS (
    SELECT r, seq, line, last, piece FROM joined QUALIFY row_number() OVER (PARTITION BY r, seq ORDER BY k DESC) = 1
)
SELECT path, coalesce(seq, 0) AS chunk_seq, CASE WHEN h = '' THEN [] ELSE ['Conversation ' || conv, role] END AS heading_trail, CASE WHEN h = '' THEN '' ELSE 'Conversation ' || conv || ' > ' || role END AS breadcrumb,
       coalesce(line, 1) AS start_line, coalesce(last, 1) AS end_line, coalesce(decode(unhex(piece)), '') AS body
FROM turns LEFT JOIN chunks USING (r)
"""


@query(_chunk_sql())
def turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turn_sections, which SQL can follow byte by byte."""
    return turn_sections(spark, sf_dir)


@query("SELECT 'doc-' || doc_id || '.md' AS path, [source, lang] AS tags, 'doc-' || doc_id AS name FROM documents")
def inline_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with one tag in the frontmatter, the same and another in the text, and one in a code span and a fence."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("---\ntags: ["), "source", F.lit("]\n---\n`#code` #"), "source", F.lit(" #"), "lang", F.lit("\n```\n#fenced\n```\n"))
    parsed = notes.parse(note_files(docs, F.concat(F.lit("doc-"), "doc_id", F.lit(".md")), text))
    return parsed.select("path", "tags", "name")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt to all cores: a table of few bytes is read by one task, however much is made of each row."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a note with a title, aliases and tags."""
    rows = spread(table(spark, sf_dir, "customer"), "c_custkey").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    text = F.concat(
        F.lit('---\ntitle: "'), "c_name", F.lit('"\naliases: ['), "c_mktsegment", F.lit(', "'), "n_name", F.lit(', nation"]\nbalance:\n  - '), F.col("c_acctbal").cast("string"), F.lit("\ntags:\n  - "), "n_name", F.lit("\n---\n# Customer\ntext\n")
    )
    return note_files(rows, F.concat(F.lit("customers/"), "c_custkey", F.lit(".md")), text)


@query(
    """
SELECT 'customers/' || c_custkey || '.md' AS path, c_custkey::VARCHAR AS name, 'customers' AS parent_folder, c_name AS title, [c_mktsegment, n_name || ', nation'] AS aliases, [n_name] AS tags, 'Customer' AS h1
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
)
def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.parse(customer_files(spark, sf_dir)).select("path", "name", "parent_folder", "title", "aliases", "tags", "h1")


def _customer_terms() -> str:
    name = lambda column, times: ", ".join([TOKENS.format(column)] * times)
    fields = (("'text'", 1), ("'customers'", 1), ("'Customer'", 2), ("c_custkey::VARCHAR", 3), ("c_name", 3), ("'Customer'", 3), ("c_mktsegment || ' ' || n_name || ', nation'", 3), ("n_name", 3))
    return f"""
WITH words AS (SELECT 'customers/' || c_custkey || '.md' AS path, list_concat({', '.join(name(c, n) for c, n in fields)}) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT path, 0::BIGINT AS chunk_seq, dl, term, count(*) AS tf FROM (SELECT path, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY path, dl, term
"""


@query(_customer_terms())
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same notes as an index in the shared folder, written, checked and read back: its postings."""
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.write(spark, customer_files(spark, sf_dir), folder, embed.HashEmbedder())
    return index.open_index(spark, folder).sparse.postings.select("path", F.col("chunk_seq").cast("long").alias("chunk_seq"), "dl", "term", "tf")



#: Frontmatter that cannot be read, or can: its lines, the line of the fault and what it is.
FAULTS = (
    ("title: x\n", None, "frontmatter that does not end"),
    ("title:\n---\n", 0, "a title without text"),
    ("\n\ntags: [a, [b]]\n---\n", 2, "a list within a list"),
    ('aliases: ["a\n---\n', 0, "a list without its closing bracket"),
    ("tags: [b, 'a]\n---\n", 0, "a quotation that does not end"),
    ("\r\nnothing here\r\n---\n", 1, "a line without a key"),
    ("- x\n---\n", 0, "a list item that belongs to no key"),
    ("tags:\n- a\n\n  - {b: c}\n---\n", 3, "a list item that is no plain text"),
    ("title: |\n---\n", 0, "a title that is no plain text"),
    ("aliases: {a}\n---\n", 0, "aliases or tags that are no plain list"),
    ("title: |-\ntags: a, b\nother:\n  - [x]\n----\n", 0, None),
)


@query(
    f"""SELECT path, CASE WHEN what IS NOT NULL THEN 'unsupported frontmatter in ' || path || ':' || line || ': ' || what END AS error
FROM (SELECT 'c/' || c_custkey || '-' || f.kind || '.md' AS path, CASE WHEN f.place IS NULL THEN 1 ELSE 2 + c_nationkey + f.place END AS line, f.what
      FROM customer, (VALUES {', '.join(f"({i}, {'NULL' if at is None else at}, {'NULL' if what is None else f'{what!r}'})" for i, (_, at, what) in enumerate(FAULTS))}) f(kind, place, what))"""
)
def note_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's note with every fault of FAULTS, after as many lines as the nation's number: what is said of it, with the line."""
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(text).alias("text")) for i, (text, *_) in enumerate(FAULTS)]))
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("c_custkey", "c_nationkey", kinds.alias("f"))
    text = F.concat(F.lit("---\n"), F.repeat(F.lit("k: v\n"), F.col("c_nationkey").cast("int")), "f.text", F.when(F.col("f.kind") > 0, "# Text\n").otherwise(""))
    return notes.parse(note_files(rows, F.concat(F.lit("c/"), "c_custkey", F.lit("-"), "f.kind", F.lit(".md")), text)).select("path", "error")


class NoVectors:
    """An embedder of zeros: every chunk is as near as any other, so that the dense leg is the first chunks by key. For searches that SQL can follow."""

    name = "zeros"

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.zeros((len(texts), embed.DIMENSIONS), np.float32)


def customer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask the customers' notes: every nation as a tag, every segment by its name, which is an alias, and both."""
    tags = table(spark, sf_dir, "nation").select(F.concat(F.lit("#"), "n_name").alias("query"))
    names = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    both = table(spark, sf_dir, "nation").select(F.concat(F.lit("customer 00001 of "), "n_name").alias("query"))
    return tags.union(names).union(both).select(F.col("query").alias("query_id"), "query")


@query(
    _customer_terms().strip().replace("SELECT path, 0::BIGINT", ", postings AS (SELECT path, 0::BIGINT")
    + f"""), lengths AS (SELECT DISTINCT path, dl FROM postings), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term), stats AS (SELECT count(*) AS doc_count, sum(dl) / count(*) AS avgdl FROM lengths),
questions AS (SELECT '#' || n_name AS query FROM nation UNION ALL SELECT DISTINCT c_mktsegment FROM customer UNION ALL SELECT 'customer 00001 of ' || n_name FROM nation),
asked AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest({TOKENS.format('query')}) AS term FROM questions) GROUP BY query, term),
scored AS (SELECT query, path, round(sum(times * {IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN df USING (term) JOIN postings USING (term), stats GROUP BY query, path),
sparse AS (SELECT query, path, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) - 1 AS sparse_rank FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, path) <= {LIMIT}),
dense AS (SELECT query, path, dense_rank FROM questions, (SELECT path, row_number() OVER (ORDER BY path) - 1 AS dense_rank FROM lengths) WHERE dense_rank < {LIMIT}),
fused AS (SELECT query, path, ({LEG.format('dense_rank')} + {LEG.format('sparse_rank')})::FLOAT AS score FROM dense FULL OUTER JOIN sparse USING (query, path)),
boosted AS (
    SELECT query, path, (score * (CASE WHEN query = c_name OR query = c_mktsegment THEN 1.5 WHEN query = '#' || n_name THEN 1.25 ELSE 1 END)::FLOAT)::FLOAT AS score
    FROM fused JOIN customer ON path = 'customers/' || c_custkey || '.md' JOIN nation ON c_nationkey = n_nationkey
)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, path)::INTEGER AS place, path, ['Customer'] AS heading_trail, 10::INTEGER AS start_line, 10::INTEGER AS end_line, round(score::DOUBLE, 9) AS score, 'text' AS body
FROM boosted QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, path) <= {TOP}"""
)
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product's own search, of many questions at once, over an index of the customers' notes that is written, checked and read back."""
    folder, zeros = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", NoVectors()
    index.write(spark, customer_files(spark, sf_dir), folder, zeros)
    found = search.search(index.open_index(spark, folder), customer_questions(spark, sf_dir), TOP, zeros, settled)
    return found.select(F.col("query_id").alias("query"), "place", "path", "heading_trail", "start_line", "end_line", F.round(F.col("score").cast("double"), 9).alias("score"), "body")


@query(
    r"""
SELECT doc_id, strlen(regexp_replace(coalesce(text, ''), '[ \t\r\n]', '', 'g')) AS solid_bytes, true AS all_fit, true AS ordered FROM documents
"""
)
def chunk_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks hold all that is not blank, none has over 1000 bytes, and their lines ascend."""
    docs = table(spark, sf_dir, "documents")
    parsed = notes.parse(note_files(docs, F.col("doc_id").cast("string"), F.concat(F.lit("# Text\n"), F.coalesce("text", F.lit("")))))
    solid = F.octet_length(F.regexp_replace(F.concat_ws("", F.transform("chunks", lambda c: c["body"])), r"[ \t\r\n]", ""))
    fit = F.forall("chunks", lambda c: F.octet_length(c["body"]) <= notes.HARD_MAX)
    lines = F.transform("chunks", lambda c: c["start_line"])
    return parsed.select(F.col("path").cast("long").alias("doc_id"), solid.cast("long").alias("solid_bytes"), fit.alias("all_fit"), (F.array_sort(lines) == lines).alias("ordered"))


@query(
    r"""
WITH bare AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS b FROM documents),
cuts AS (SELECT doc_id, b, list_max(list_filter(range(0, 201), lambda i: strlen(b[1:i]) <= 200)) AS n FROM bare)
SELECT doc_id, CASE WHEN strlen(b) <= 200 THEN b ELSE b[1:n] END AS snippet FROM cuts
"""
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), 200).alias("snippet"))


@query("SELECT doc_id, array_to_string(list_filter([source, lang, '', source, 'Top > ' || lang, text], lambda x: x IS NOT NULL AND x <> ''), ' ') AS dense_text FROM documents")
def dense_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    trail = F.array(F.lit("Top"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", X.dense_text(F.col("source"), F.col("lang"), F.array(F.lit(""), F.col("source")), F.lit(None).cast("string"), trail, F.col("text")).alias("dense_text"))


@query(
    """
WITH before AS (SELECT 'doc-' || doc_id AS path, n_chars AS size, 1 AS mtime FROM documents WHERE doc_id % 10 <> 3),
after AS (SELECT 'doc-' || doc_id AS path, n_chars + CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 0 END AS size, 1 AS mtime FROM documents WHERE doc_id % 10 <> 7)
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM before b FULL OUTER JOIN after a USING (path) WHERE b.path IS NULL OR a.path IS NULL OR b.size <> a.size OR b.mtime <> a.mtime
"""
)
def file_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings of files: some were added, some removed, some have another size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(1).cast("long").alias("mtime_ns"))
    after = docs.where("doc_id % 10 <> 7").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 10 == 5, 1).otherwise(0))
    return index.changes(docs.where("doc_id % 10 <> 3"), after)


#: Files of a folder that are no notes, or in folders that are skipped.
NO_NOTES = (".trash/old.md", ".git/x.md", "deep/node_modules/y.md", ".obsidian/z.md", "plain.txt", "md", "x.md.bak")


def note_folder(spark: SparkSession, sf_dir: str) -> str:
    """A new folder below the shared one with a note for every document, by its source, and what a vault may hold besides."""
    shared = shared_dir(spark).removeprefix("file://")
    if not shared.startswith("/"):
        raise ValueError("notes are files: the shared folder must be mounted where the executors are")
    root = f"{shared}/notes-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "wb") as f:  # again if the task is run again: the same
                    f.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("path")], names=["path"])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("none")).alias("source"))
    # names of every kind that are notes: hidden ones, in upper case, with blanks
    name = F.element_at(F.array(F.lit("doc-%d.md"), F.lit(".doc %d.md"), F.lit("_doc-%d.MD"), F.lit("d/e/\u00e9-%d.Md")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    files = note_files(docs, F.concat("source", F.lit("/"), F.replace(name, F.lit("%d"), F.col("doc_id").cast("string"))), F.col("text"))
    others = docs.select("source").distinct().select(F.explode(F.array(*[F.concat("source", F.lit(f"/{x}")) for x in NO_NOTES])).alias("path"))
    files.unionByName(note_files(others, F.col("path"), F.lit("no note"))).mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return root


@query(
    """
WITH docs AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(text, '') AS text FROM documents)
SELECT source || '/' || replace(['doc-%d.md', '.doc %d.md', '_doc-%d.MD', 'd/e/\u00e9-%d.Md'][doc_id % 4 + 1], '%d', doc_id::VARCHAR) AS path, strlen(text) AS size, sha256(text) AS sha256 FROM docs
""".replace("\\u00e9", "\u00e9")
)
def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file, found again by the vault source: paths, sizes and contents."""
    vault.register(spark)
    found = spark.read.format("vault").load(note_folder(spark, sf_dir))
    return found.select("path", "size", F.sha2("content", 256).alias("sha256"))


# --- Sinks


def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to all questions as results of a search, with names that are hard to write."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = text_search(spark, sf_dir, questions, TOP)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")).alias("b"))
    few = table(spark, sf_dir, "benchmark").count() * TOP <= 400_000
    rows = docs.join(F.broadcast(hits) if few else hits, "doc_id")
    trail = F.when(F.col("rank") == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit('a "'), F.coalesce("lang", F.lit("?")), F.lit('"\\\x01\x08\x0c\x1f/')), F.lit("é\t\r")))
    lines = (F.lit(1) + F.length("b") - F.length(F.replace("b", F.lit("\n"), F.lit("")))).cast("long")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return rows.select("query_id", (F.col("rank") + 1).alias("place"), path.alias("path"), trail.alias("heading_trail"), F.lit(1).cast("long").alias("start_line"), lines.alias("end_line"), "score", X.snippet(F.col("b"), sinks.JSON_SNIPPET).alias("snippet"))


ANSWERED = f"""WITH {bm25_sql('SELECT item_id AS query_id, text AS query FROM benchmark', TOP)},
found AS (SELECT query_id, rank, score, coalesce(source, 'none') || '/' || doc_id || '.md' AS path, coalesce(lang, '?') AS lang, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS b FROM sparse JOIN documents USING (doc_id)),
results AS (SELECT *, CASE WHEN rank = 0 THEN [] ELSE ['a "' || lang || '"' || chr(92) || chr(1) || chr(8) || chr(12) || chr(31) || '/', 'é' || chr(9) || chr(13)] END AS trail,
       1 + len(b) - len(replace(b, chr(10), '')) AS last,
       CASE WHEN strlen(b) <= 240 THEN b ELSE b[1 : list_max(list_filter(range(0, 241), lambda i: strlen(b[1:i]) <= 240))] END AS snippet FROM found)"""
#: A JSON string of a column, in SQL; the control characters are those that the answers have.
QUOTED = "'\"' || replace(replace(replace(replace(replace(replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't'), chr(1), chr(92) || 'u0001'), chr(8), chr(92) || 'u0008'), chr(12), chr(92) || 'u000c'), chr(31), chr(92) || 'u001f') || '\"'"


@query(
    f"""{ANSWERED}
SELECT '{{"results":[' || string_agg('{{"path":' || {QUOTED.format('path')} || ',"heading_trail":[' || array_to_string(list_transform(trail, lambda h: {QUOTED.format('h')}), ',') || '],"start_line":1,"end_line":' || last
    || ',"score":' || printf('%.6f', score) || ',"snippet":' || {QUOTED.format('snippet')} || '}}', ',' ORDER BY rank) || ']}}' AS line FROM results GROUP BY query_id"""
)
def answers_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to all questions written as JSON lines in the shared folder, and read back."""
    folder = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    sinks.write_json(answer_rows(spark, sf_dir), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query(
    f"""{ANSWERED}
SELECT query_id, string_agg(path || chr(10) || CASE WHEN len(trail) > 0 THEN '  ' || array_to_string(trail, ' > ') || chr(10) ELSE '' END || '  lines 1-' || last || chr(10) || '  ' || snippet || chr(10), chr(10) ORDER BY rank) AS block
FROM results GROUP BY query_id"""
)
def answers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.gathered(answer_rows(spark, sf_dir)).select("query_id", sinks.text_block(F.col("results")).alias("block"))
