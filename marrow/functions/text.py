"""Column functions on text: tokens, retrieval text, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII letters and digits and of anything beyond ASCII.
TOKEN = r"[a-z0-9\x{80}-\x{10FFFF}]+"


def tokens(text: Column) -> Column:
    """Tokens in order; only A-Z change case. A null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def breadcrumb(trail: Column) -> Column:
    return F.array_join(trail, " > ")


def joined(parts: Column) -> Column:
    """The parts that are neither null nor empty, joined by single spaces."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


def dense_text(name: Column, title: Column, aliases: Column, h1: Column, trail: Column, body: Column) -> Column:
    """What a chunk is embedded as: no tags, no folder."""
    head, rest = F.array(name, title), F.array(h1, breadcrumb(trail), body)
    return joined(F.concat(head, F.coalesce(aliases, F.array().cast("array<string>")), rest))


#: Field and how often its tokens count.
SPARSE_WEIGHTS = {"body": 1, "parent_folder": 1, "breadcrumb": 2, "name": 3, "title": 3, "h1": 3, "aliases": 3, "tags": 3}


def weighted_tokens(fields: list[tuple[Column, int]]) -> Column:
    """array<struct<term, weight>> of several texts; the same as the tokens of the texts repeated so many times."""

    def counted(text: Column, weight: int) -> Column:
        return F.transform(tokens(text), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    return F.flatten(F.array(*[counted(c, w) for c, w in fields]))


def repeated_tokens(fields: list[tuple[Column, int]]) -> Column:
    """array<string> of several texts, each one's tokens as often as it counts."""
    return F.flatten(F.concat(*[F.array_repeat(tokens(c), weight) for c, weight in fields]))


def sparse_fields() -> list[tuple[Column, int]]:
    """The weighted fields of a chunk joined with its note."""
    text = {"breadcrumb": breadcrumb(F.col("heading_trail")), "aliases": joined(F.col("aliases")), "tags": joined(F.col("tags"))}
    return [(text[name] if name in text else F.col(name), weight) for name, weight in SPARSE_WEIGHTS.items()]


def snippet(body: Column, most: int) -> Column:
    """body without blanks at its ends, cut to at most so many bytes of UTF-8 without cutting a character."""
    bare = F.btrim(F.coalesce(body, F.lit("")), F.lit(" \t\r\n"))
    # characters that fit: a character has one byte at least, so only the first `most` matter
    chars = F.split(F.substring(bare, 1, most), "")
    fits = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")),
        lambda s, c: F.when((s["bytes"] + F.octet_length(c) <= most) & (s["n"] >= 0), F.struct((s["bytes"] + F.octet_length(c)).alias("bytes"), (s["n"] + F.length(c)).alias("n"))).otherwise(
            F.struct(F.lit(most + 1).alias("bytes"), s["n"].alias("n"))
        ),
        lambda s: s["n"],
    )
    return F.when(F.octet_length(bare) <= most, bare).otherwise(F.substring(bare, F.lit(1), fits))


def explicit_tag(query: Column, tags: Column) -> Column:
    """Whether the query names a tag: equals `#tag`, or has it with free ends where it first occurs."""

    def named(tag: Column) -> Column:
        needle = F.concat(F.lit("#"), tag)
        at = F.instr(query, needle)
        before = F.substring(query, at - 1, F.lit(1))
        after = F.substring(query, at + F.length(needle), F.lit(1))
        free = ((at == 1) | ~before.rlike("^[A-Za-z0-9]$")) & ~after.rlike("^[A-Za-z0-9_/-]$")
        return (F.octet_length(tag) <= 255) & ((query == needle) | ((at > 0) & free))

    return F.coalesce(F.exists(tags, named), F.lit(False))
