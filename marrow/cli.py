"""python -m marrow.cli ask --vault PATH QUERY [--top-k N] [--json] [--model FOLDER]"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

USAGE = "marrow ask --vault PATH QUERY [--top-k N] [--json] [--model FOLDER]"


class Usage(Exception):
    pass


@dataclass
class Request:
    vault: str
    query: str
    top_k: int = 5
    as_json: bool = False
    model: str | None = None


def arguments(argv: list[str]) -> Request:
    """Words in any order; `ask` is always the command, and anything else that begins with a dash is an error."""
    words = iter(argv)
    asked, path, query, top_k, as_json, model = False, None, None, 5, False, None
    for word in words:
        if word == "ask":
            asked = True
        elif word == "--vault":
            path = next(words, None)
            if path is None:
                raise Usage(USAGE)
        elif word == "--top-k":
            value = next(words, None)
            if value is None:
                raise Usage("--top-k takes a number")
            if not re.fullmatch(r"[0-9]+", value):
                raise Usage(f"--top-k takes a number, not {value}")
            top_k = int(value)
            if not 1 <= top_k <= 50:
                raise Usage("--top-k takes 1 to 50")
        elif word == "--model":
            model = next(words, None)
            if model is None:
                raise Usage("--model takes a folder")
        elif word == "--json":
            as_json = True
        elif word.startswith("-"):
            raise Usage(f"no such option: {word}")
        elif query is not None:
            raise Usage(f"one query only, not {word} as well")
        else:
            query = word
    if not asked or path is None or not query:
        raise Usage(USAGE)
    return Request(path, query, top_k, as_json, model)


def main(argv: list[str] | None = None) -> int:
    """0: answered, also with no result; 1: an error while running; 2: wrong usage."""
    try:
        request = arguments(sys.argv[1:] if argv is None else argv)
    except Usage as e:
        print(e, file=sys.stderr)
        return 2
    try:
        from pyspark.sql import SparkSession

        from marrow.operators.embed import HashEmbedder, StaticEmbedder
        from marrow.plans.index import load_or_build
        from marrow.plans.search import search, with_snippets
        from marrow.session import ship
        from marrow.sources.sinks import HUMAN_SNIPPET, JSON_SNIPPET, result_json, result_text

        spark = SparkSession.builder.appName("marrow").getOrCreate()
        ship(spark)
        embedder = StaticEmbedder(request.model) if request.model else HashEmbedder()
        index, status = load_or_build(spark, request.vault, embedder)
        if status.kind == "rebuild":
            print(f"rebuilding index ({status.reason}) in {status.ms}ms", file=sys.stderr)
        queries = spark.createDataFrame([(0, request.query)], "query_id bigint, query string")
        rows = with_snippets(search(index, queries, request.top_k, embedder), JSON_SNIPPET if request.as_json else HUMAN_SNIPPET).collect()
        sys.stdout.write(result_json(rows) if request.as_json else result_text(rows))
        return 0
    except Exception as e:  # noqa: BLE001  the command's last resort
        print(f"error: {type(e).__name__}: {e}".splitlines()[0], file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
