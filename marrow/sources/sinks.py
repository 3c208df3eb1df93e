"""Results as JSON or for people to read: of one query on the driver, or of a table of queries as columns that Spark writes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

JSON_SNIPPET, HUMAN_SNIPPET = 240, 200


def json_string(text: str) -> str:
    """A JSON string; control characters without a common short form as \\u00xx, anything beyond ASCII as it is."""
    short = {"\\b": "\\u0008", "\\f": "\\u000c"}
    return re.sub(r"\\(?:b|f|.)", lambda m: short.get(m[0], m[0]), json.dumps(text, ensure_ascii=False))


def result_json(rows: Iterable[Row]) -> str:
    """One line: {"results": [...]} with the keys in a fixed order and scores to six places."""
    out = []
    for r in rows:
        trail = ",".join(json_string(h) for h in r["heading_trail"])
        out.append(
            f'{{"path":{json_string(r["path"])},"heading_trail":[{trail}],"start_line":{r["start_line"]},"end_line":{r["end_line"]},"score":{r["score"]:.6f},"snippet":{json_string(r["snippet"])}}}'
        )
    return f'{{"results":[{",".join(out)}]}}\n'


def result_text(rows: Iterable[Row]) -> str:
    blocks = []
    for r in rows:
        trail = [f"  {' > '.join(r['heading_trail'])}"] if r["heading_trail"] else []
        blocks.append("\n".join([r["path"], *trail, f"  lines {r['start_line']}-{r['end_line']}", f"  {r['snippet']}"]) + "\n")
    return "\n".join(blocks) or "(no results)\n"


#: What a JSON string has for a character; the backslash comes first, as the others bring more of them.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"} | {chr(i): f"\\u{i:04x}" for i in range(32) if i not in (9, 10, 13)}


def json_text(text: Column) -> Column:
    """json_string() of a column."""
    out = text
    for char, short in list(ESCAPES.items())[:5]:
        out = F.replace(out, F.lit(char), F.lit(short))
    rare = out
    for char, short in list(ESCAPES.items())[5:]:
        rare = F.replace(rare, F.lit(char), F.lit(short))
    out = F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_line(results: Column) -> Column:
    """The line of result_json(), without its end, of results array<struct<path, heading_trail, start_line, end_line, score, snippet>>."""

    def one(r: Column) -> Column:
        trail = F.array_join(F.transform(r["heading_trail"], json_text), ",")
        score = F.format_string("%.6f", r["score"].cast("double"))
        lines = F.concat(F.lit(',"start_line":'), r["start_line"].cast("string"), F.lit(',"end_line":'), r["end_line"].cast("string"))
        return F.concat(F.lit('{"path":'), json_text(r["path"]), F.lit(',"heading_trail":['), trail, F.lit("]"), lines, F.lit(',"score":'), score, F.lit(',"snippet":'), json_text(r["snippet"]), F.lit("}"))

    return F.concat(F.lit('{"results":['), F.array_join(F.transform(results, one), ","), F.lit("]}"))


def text_block(results: Column) -> Column:
    """What result_text() gives of the same."""

    def one(r: Column) -> Column:
        trail = F.when(F.size(r["heading_trail"]) > 0, F.concat(F.lit("  "), F.array_join(r["heading_trail"], " > "), F.lit("\n"))).otherwise("")
        lines = F.concat(F.lit("  lines "), r["start_line"].cast("string"), F.lit("-"), r["end_line"].cast("string"))
        return F.concat(r["path"], F.lit("\n"), trail, lines, F.lit("\n  "), r["snippet"], F.lit("\n"))

    return F.when(F.size(results) > 0, F.array_join(F.transform(results, one), "\n")).otherwise("(no results)\n")


FIELDS = ("path", "heading_trail", "start_line", "end_line", "score", "snippet")


def gathered(results: DataFrame) -> DataFrame:
    """(query_id, results) in the order of place, from rows as a search gives them: at most top_k a query."""
    each = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", *FIELDS))).alias("x"))
    return each.select("query_id", F.transform("x", lambda r: F.struct(*[r[f].alias(f) for f in FIELDS])).alias("results"))


def write_json(results: DataFrame, folder: str) -> None:
    """A line for each query, as files of JSON lines that tasks write side by side."""
    gathered(results).select(json_line(F.col("results")).alias("value")).write.mode("overwrite").text(folder)
