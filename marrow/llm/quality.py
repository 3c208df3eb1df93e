"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text whose feature exceeds a cutoff. Labelled texts are the holdout: the rules'
cutoffs and the order in which they are tried (`PATH`) are fixed beforehand, so labels are used for
certification alone. A step of the path adds a rule or makes one tighter; after it, a text is rejected if any of the
rules so far rejects it. A step is certified if the exact binomial probability of seeing so few false
rejections among the stratum's good texts, were the true rate of all rules together `risk`, is at
most the stratum's level, and the first step that fails ends the stratum's sequence. The rate is that of the
rules together, so no share of it is set aside for rules that no text breaks; the steps are nested and
in fixed order, so they need no correction among themselves. Over strata `delta` is dealt in proportion to
their numbers of good texts, which say nothing of rejections; what strata that get through the whole
path had is dealt once more to the others (a step-down). With probability 1 - delta every stratum loses
at most `risk` of its good texts to the rules. A stratum with too few labels to certify anything rejects
nothing beyond the base rules.

Of a rule's certified cutoffs the loosest one is taken that rejects as many of the stratum's bad texts as the tightest does, and
none if that rejects no bad text: what is looser loses no more, so the bound holds, and good texts are not lost for nothing.

A trial is a distinct text of a stratum: rows that repeat an id, or copies under other ids, are one.

Texts are read once; features (a few numbers a row) are written to the shared folder, joined with the
labels by id, and judged by a table of one row a stratum. That table is broadcast while it has at
most `MAX_BROADCAST_STRATA` rows, else joined by shuffle. accept() writes the rows with their features instead.

Nulls: a null text has no words and fails the base rules; a null stratum is the stratum ''; labels
without id or quality are left out; of several labels of one id, or of one text, the best counts. A null id matches
no label. Repeated rows are judged alike. Ties: a feature equal to a cutoff passes, a probability equal to the level
certifies. Empty tables: no rows, and without labels no cutoffs. Texts of any length are taken whole. Further
columns may have any names: judge() reads three, accept() handles all by place.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.llm.common import settled

RISK, DELTA = 0.02, 0.05
MAX_BROADCAST_STRATA = 10_000
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rule: its feature, and its cutoffs: the first ones from the loosest on, then those that are tried last.
RULES = {
    "symbols": ("n_symbols / word_chars", (0.3, 0.2, 0.15, 0.1, 0.07, 0.05), (0.03,)),
    "length": ("word_chars / n_words", (20.0, 15.0, 12.0, 10.0), (9.0,)),
    "capitals": ("n_capitals / word_chars", (0.8, 0.6, 0.5, 0.4, 0.3), (0.25,)),
    "lines": ("n_dup_lines / n_words", (0.2, 0.15, 0.1, 0.07), (0.05,)),
    "repeats": ("n_repeat_words / n_words", (0.19, 0.17), (0.15, 0.12, 0.1)),
}
#: The steps in the order in which they are tried: (rule, cutoff).
PATH = tuple((rule, c) for part in (1, 2) for rule, spec in RULES.items() for c in spec[part])


def occurrences(text: Column, marks: str) -> Column:
    """How often the single-byte marks occur."""
    return reduce(lambda s, c: s + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))), marks, F.lit(0)).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", whole: bool = False) -> DataFrame:
    """id, stratum, a hash of the text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals of every row's whole text.

    whole: also `row`, a structure of all columns of docs by their place (k0, k1 and so on).
    """
    text = F.col("text")
    kept = ["row"] if whole else []
    row = [F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)]).alias("row")] if whole else []
    df = docs.select(*row, F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("bare", F.btrim(text, F.lit(BLANKS)))
    df = df.withColumn("w", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", r"[\x20\x09-\x0D]+")))
    df = df.withColumn("n_words", F.size("w").cast("long"))
    lines = F.when(F.instr(text, "\n") == 0, F.array().cast("array<string>")).otherwise(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("lines", lines)
    shape = df.select(
        *kept,
        "id",
        "stratum",
        F.xxhash64(text).alias("hash"),
        "n_words",
        (F.char_length(text) - occurrences(text, BLANKS)).cast("long").alias("word_chars"),
        occurrences(text, SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        # a number for each window of five words
        F.when(F.col("n_words") > 5, F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)]))).alias("windows"),
    )
    # Windows that recur, in the order of the text; most texts have none and skip the sort.
    shape = shape.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = lambda e, j: F.when(
        (F.get("sorted", j - 1)["h"] == e["h"]) | F.coalesce(F.get("sorted", j + 1)["h"] == e["h"], F.lit(False)), e["i"]
    )
    shape = shape.withColumn("starts", F.sort_array(F.array_compact(F.transform("sorted", again))))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("starts", none, lambda s, p: F.struct((p + 5).alias("end"), (s["n"] + F.least(F.lit(5), p + 5 - s["end"])).alias("n")), lambda s: s["n"])
    return shape.select(*kept, "id", "stratum", "hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_capitals")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Bin(n, p), summed term by term in logarithms: exact at any n."""
    start = n * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)

    def more(s: Column, i: Column) -> Column:
        term = s["term"] + F.ln((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (F.greatest(s["sum"], term) + F.log1p(F.exp(-F.abs(s["sum"] - term)))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(start.alias("term"), start.alias("sum")), more, lambda s: s["sum"])


def rejects(steps: int) -> Column:
    """Whether any rule of the first steps of the path rejects; each rule has its latest cutoff there."""
    cuts = dict(PATH[:steps])
    return reduce(lambda x, y: x | y, [F.expr(f"{RULES[rule][0]} > {c}D") for rule, c in cuts.items()])


def thresholds(feats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row a stratum: n (its good texts) and its certified cutoff for each rule, null where none is."""
    rated = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    held = feats.where(~base_failed()).join(rated, "id").select("stratum", "hash", (F.col("quality") == 1).alias("good"), *COUNTS).distinct()
    counts = [F.count_if(F.col("good") & rejects(i + 1)).alias(f"k{i}") for i in range(len(PATH))]
    caught = [F.count_if(~F.col("good") & F.expr(f"{RULES[rule][0]} > {c}D")).alias(f"b{i}") for i, (rule, c) in enumerate(PATH)]
    strata = settled(held.groupBy("stratum").agg(F.count_if("good").alias("n"), *counts, *caught), "quality-strata")  # a row a stratum

    def probability(i: int) -> Column:
        k = F.col(f"k{i}")
        # more than the expected number is never significant, and would only make the sum long
        return F.when(k > F.col("n") * risk, F.lit(0.0)).otherwise(log_binomial_cdf(k, F.col("n"), risk))

    bad = [f"b{i}" for i in range(len(PATH))]
    logs = settled(strata.select("stratum", "n", *bad, F.array(*map(probability, range(len(PATH)))).alias("p")), "quality-probabilities")

    def through(level: Column) -> Column:
        """How many steps from the first on are certified at the level."""
        return F.array_position(F.array_append(F.transform("p", lambda p: F.coalesce(p <= F.ln(level), F.lit(False))), F.lit(False)), F.lit(False)) - 1

    def dealt(whole: int) -> Column:
        return delta * F.col("n") / F.lit(float(max(1, whole)))

    whole = logs.agg(F.sum("n")).first()[0] or 0
    once = logs.withColumn("steps", through(dealt(whole)))
    rest = once.where(F.col("steps") < len(PATH)).agg(F.sum("n")).first()[0] or 0
    steps = once.withColumn("steps", F.when(F.col("steps") == len(PATH), F.col("steps")).otherwise(through(dealt(rest))))
    cuts = []
    for rule in RULES:
        at = [i for i, (r, _) in enumerate(PATH) if r == rule]  # from the loosest on
        most = F.greatest(F.lit(0), *[F.when(F.col("steps") > i, F.col(f"b{i}")).otherwise(0) for i in at])
        cut = F.when(most == 0, F.lit(None).cast("double"))
        for i in at:
            cut = cut.when((F.col("steps") > i) & (F.col(f"b{i}") == most), F.lit(PATH[i][1]))
        cuts.append(cut.alias(rule))
    return steps.select("stratum", "n", *cuts)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")


def verdicts(feats: DataFrame, cut: DataFrame) -> DataFrame:
    """feats with base_failed, the first rule that rejects (`rejected_by`) and kept."""
    cut = cut.drop("n")
    cut = F.broadcast(cut) if cut.count() <= MAX_BROADCAST_STRATA else cut
    fails = [F.when(F.expr(f"{feature} > `{rule}`"), rule) for rule, (feature, *_) in RULES.items()]
    judged = feats.join(cut, "stratum", "left").withColumn("base_failed", base_failed())
    # a feature is defined where there are words, which the base rules ask for
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(F.coalesce(*fails)))
    return judged.withColumn("kept", F.col("rejected_by").isNull())


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """id_col, the features, base_failed, the first rule that rejects (`rejected_by`) and kept, for every row."""
    feats = settled(features(docs, id_col, text_col, stratum_col), "quality-features")
    judged = verdicts(feats, settled(thresholds(feats, labels, risk, delta), "quality-thresholds"))
    return judged.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "rejected_by", "kept")


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept. They are written with their features once, so that neither is a text moved to a join nor a feature worked out twice."""
    rows = settled(features(docs, id_col, text_col, stratum_col, whole=True), "quality-rows")
    cut = settled(thresholds(rows.drop("row"), labels, risk, delta), "quality-thresholds")
    kept = verdicts(rows, cut).where("kept")
    return kept.select(*[F.col(f"row.k{i}").alias(c) for i, c in enumerate(docs.columns)])
