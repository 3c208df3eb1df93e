"""Markdown notes: frontmatter, sections, inline tags and chunks, on the bytes of a file.

Everything sequential within one note is plain Python here; notes are independent, so a table of files
is parsed by an Arrow function in parallel, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.operators.batches import slices

# Sizes in bytes.
TARGET, HARD_MAX, MERGE_UNDER = 750, 1000, 250
SLICE_BYTES = 1_000_000
BLANKS = b" \t\r\n"
OPENING = re.compile(rb"---\r?\n")
CLOSING = re.compile(rb"^---\r?\n?", re.M)
HEADING = re.compile(rb"(#{1,6}) (.*)", re.S)
FENCE = re.compile(rb"[ \t]*(`{3,}|~{3,})")
#: Ends of blank lines; the look-ahead lets one newline end one blank line and begin the next.
BLANK_END = re.compile(rb"(?=\n[ \t\r]*(\n))")
NEWLINES = re.compile(rb"[\r\n]*")
FREE = re.compile(rb"[ \t]*")
CODE_OR_TAG = re.compile(rb"(`+)|(?<![A-Za-z0-9_-])#([A-Za-z0-9_/-]+)")


class VaultParseError(ValueError):
    """A note that cannot be read, with its path and line."""

    def __init__(self, path: str, line: int, message: str):
        super().__init__(f"unsupported frontmatter in {path}:{line}: {message}")
        self.path, self.line, self.message = path, line, message


class _Bad(Exception):
    def __init__(self, line: int, message: str):
        self.line, self.message = line, message


def unquote(s: bytes) -> bytes:
    return s[1:-1] if len(s) >= 2 and s[:1] == s[-1:] and s[:1] in (b'"', b"'") else s


def flow_list(value: bytes, line: int) -> list[bytes]:
    """`[a, "b, c"]` on one line; empty items are skipped."""
    if not value.endswith(b"]"):
        raise _Bad(line, "a list without its closing bracket")
    items, at, end = [], 1, len(value) - 1
    while at < end:
        at = FREE.match(value, at, end).end()
        if value[at : at + 1] in (b'"', b"'") and at < end:
            close = value.find(value[at : at + 1], at + 1, end)
            if close < 0:
                raise _Bad(line, "a quotation that does not end")
            item, at = value[at : close + 1], close + 1
        else:
            comma = value.find(b",", at, end)
            item, at = value[at : end if comma < 0 else comma], end if comma < 0 else comma
        item = item.strip(b" \t")
        if item[:1] in (b"[", b"{"):
            raise _Bad(line, "a list within a list")
        if item:
            items.append(unquote(item))
        at = FREE.match(value, at, end).end()
        at += value[at : at + 1] == b"," and at < end
    return items


def frontmatter(text: bytes) -> tuple[bytes | None, list[bytes], list[bytes]]:
    """Title, aliases and tags of the lines between the marks; the first of them is line 2 of the file."""
    title, lists = None, {b"aliases": [], b"tags": []}
    taking: list[bytes] | None = None  # the list that `- item` lines go to
    skipping = False  # whether such lines belong to a key of no interest
    for number, line in enumerate(text.split(b"\n"), 2):
        line = line.rstrip(b"\r").strip(b" \t")
        if not line:
            continue
        if line.startswith(b"- ") and (taking is not None or skipping):
            item = line[2:].strip(b" \t")
            if taking is not None:
                if not item or item[:1] in (b"[", b"{"):
                    raise _Bad(number, "a list item that is no plain text")
                taking.append(unquote(item))
            continue
        taking, skipping = None, False
        if line.startswith(b"- "):
            raise _Bad(number, "a list item that belongs to no key")
        key, colon, value = line.partition(b":")
        if not colon:
            raise _Bad(number, "a line without a key")
        key, value = key.strip(b" \t"), value.strip(b" \t")
        block = value[:1] == b"{" or value in (b"|", b">")
        if key == b"title":
            if not value:
                raise _Bad(number, "a title without text")
            if block or value[:1] == b"[":
                raise _Bad(number, "a title that is no plain text")
            title = unquote(value)
        elif key in lists:
            if not value:
                taking = lists[key]
            elif value[:1] == b"[":
                lists[key] += flow_list(value, number)
            elif block:
                raise _Bad(number, "aliases or tags that are no plain list")
            else:
                lists[key].append(unquote(value))
        else:
            skipping = not value
    return title, lists[b"aliases"], lists[b"tags"]


def fenced(body: bytes) -> Iterator[tuple[int, bytes, bool, bool]]:
    """(offset, line, whether it begins inside a fence, whether it ends inside one) of each line."""
    at, mark = 0, b""
    for line in re.findall(rb"[^\n]*\n|[^\n]+", body):
        before, bare = bool(mark), line.rstrip(b"\n").rstrip(b"\r")
        found = FENCE.match(bare)
        if not mark and found:
            mark = found[1]
        elif mark:
            run = re.match(rb"[ \t]*(" + re.escape(mark[:1]) + rb"+)", bare)
            if run and len(run[1]) >= len(mark):
                mark = b""
        yield at, bare, before, bool(mark)
        at += len(line)


def heading(line: bytes) -> tuple[int, bytes] | None:
    m = HEADING.fullmatch(line)
    return (len(m[1]), m[2].strip(b" \t").rstrip(b"#").rstrip(b" \t")) if m else None


def sections(body: bytes, first_line: int) -> list[tuple[int, bytes, list[bytes], bytes, int]]:
    """(level, heading, trail, text, first line) of the stretches between headings that are not blank."""
    found: list[tuple[int, bytes, list[bytes], int, int]] = [(0, b"", [], 0, first_line)]
    ends, trail = [], []
    for number, (at, line, inside, _) in enumerate(fenced(body), first_line):
        if not inside and (h := heading(line)):
            trail = trail[: h[0] - 1]
            trail = [*trail, *[b""] * (h[0] - 1 - len(trail)), h[1]]
            ends.append(at)
            newline = body.find(b"\n", at)
            found.append((*h, trail, len(body) if newline < 0 else newline + 1, number + 1))
    ends.append(len(body))
    kept = [(level, name, way, body[a:b], line) for (level, name, way, a, line), b in zip(found, ends, strict=True) if body[a:b].strip(BLANKS)]
    return kept or [(0, b"", [], b"", first_line)]


def inline_tags(body: bytes) -> list[bytes]:
    """`#tag`s outside fences and code spans; a code span that does not close swallows its line."""
    tags = []
    for _, line, before, after in fenced(body):
        if before or after:
            continue
        at = 0
        while m := CODE_OR_TAG.search(line, at):
            at = m.end()
            if m[2]:
                tags.append(m[2])
            else:
                close = re.compile(rb"(?<!`)" + m[1] + rb"(?!`)").search(line, at)
                at = close.end() if close else len(line)
    return tags


def cut(text: bytes) -> int:
    """Where the next chunk ends of a text of which more than HARD_MAX bytes are given: a blank line, a line, or a character near TARGET."""
    window = text[:HARD_MAX]
    near = lambda at: abs(at - TARGET)
    blank = [m.end(1) for m in BLANK_END.finditer(window)]
    for fit in ([a for a in blank if TARGET // 2 <= a <= TARGET + TARGET // 2], [a for a in blank if a >= TARGET // 3]):
        if fit:
            return min(fit, key=near)
    if lines := [m.start() for m in re.finditer(rb"\n", window) if m.start() >= TARGET // 3]:
        return min(lines, key=near) + 1
    end = HARD_MAX
    while end and text[end] & 0xC0 == 0x80:  # never inside a character
        end -= 1
    return end or HARD_MAX


def trim_end(piece: bytes) -> bytes:
    piece = piece.rstrip(b"\r\n")
    bare = piece.rstrip(b" \t")
    return bare.rstrip(b"\r\n") if bare != piece and (not bare or bare[-1:] in b"\r\n") else piece


def chunks(body: bytes, first_line: int) -> list[tuple[list[bytes], bytes, int, int]]:
    """(trail, text, first line, last line), lines counted from 1."""
    out: list[tuple[list[bytes], bytes, int, int]] = []
    for _, _, trail, text, line in sections(body, first_line):
        bare = text.strip(BLANKS)
        line += text[: len(text) - len(text.lstrip(BLANKS))].count(b"\n")
        last = line + bare.count(b"\n")
        at = 0  # an offset, so that a long text is not copied for every chunk
        while at < len(bare):
            if len(bare) - at <= HARD_MAX:
                out.append((trail, bare[at:], line, last))
                break
            end = at + cut(bare[at : at + HARD_MAX + 1])
            piece = trim_end(bare[at:end])
            out.append((trail, piece, line, line + piece.count(b"\n")))
            rest = NEWLINES.match(bare, end).end()
            line += bare.count(b"\n", at, rest)
            at = rest
    merged = out[:1]
    for trail, text, start, end in out[1:]:
        before = merged[-1]
        if before[0] == trail and len(text) < MERGE_UNDER and len(before[1]) + 1 + len(text) <= HARD_MAX:
            merged[-1] = (trail, before[1] + b"\n" + text, before[2], end)
        else:
            merged.append((trail, text, start, end))
    return merged or [([], b"", first_line, first_line)]


def name_of(path: str) -> str:
    base = path.rsplit("/", 1)[-1]
    return base[:-3] if base.lower().endswith(".md") else base


def parse_note(path: str, raw: bytes) -> dict:
    """A note with its chunks; raises VaultParseError."""
    title, aliases, tags, start = None, [], [], 0
    try:
        if opening := OPENING.match(raw):
            closing = CLOSING.search(raw, opening.end())
            if not closing:
                raise _Bad(1, "frontmatter that does not end")
            title, aliases, tags = frontmatter(raw[opening.end() : closing.start()])
            start = closing.end()
    except _Bad as e:
        raise VaultParseError(path, e.line, e.message) from None
    body, first = raw[start:], raw[:start].count(b"\n") + 1
    known = set(tags)
    found = [t for t in dict.fromkeys(inline_tags(body)) if t not in known]
    text = lambda b: b.decode("utf-8", "replace")
    return {
        "path": path,
        "name": name_of(path),
        "parent_folder": path.rpartition("/")[0],
        "title": None if title is None else text(title),
        "aliases": [text(a) for a in aliases],
        "tags": [text(t) for t in [*tags, *found]],
        "h1": next((text(name) for level, name, *_ in sections(body, first) if level == 1), None),
        "chunks": [
            {"chunk_seq": i, "heading_trail": [text(h) for h in trail], "body": text(b), "start_line": a, "end_line": z} for i, (trail, b, a, z) in enumerate(chunks(body, first))
        ],
    }


CHUNK = T.StructType([T.StructField("chunk_seq", T.IntegerType()), T.StructField("heading_trail", T.ArrayType(T.StringType())), T.StructField("body", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])
STRINGS = T.ArrayType(T.StringType())
NOTE = T.StructType([T.StructField(c, k) for c, k in (("path", T.StringType()), ("name", T.StringType()), ("parent_folder", T.StringType()), ("title", T.StringType()), ("aliases", STRINGS), ("tags", STRINGS), ("h1", T.StringType()), ("chunks", T.ArrayType(CHUNK)), ("error", T.StringType()))])


def parse(files: DataFrame) -> DataFrame:
    """Notes with an array of chunks from files (path, content); `error` says why a note could not be read, and is else null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(NOTE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content", SLICE_BYTES):
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows.append({**parse_note(path, raw or b""), "error": None})
                except VaultParseError as e:
                    rows.append({"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, NOTE)


def first_error(parsed: DataFrame) -> str | None:
    """The error of the first bad note in path order."""
    row = parsed.where("error IS NOT NULL").agg(F.min(F.struct("path", "error")).alias("e")).first()
    return row["e"]["error"] if row["e"] else None


def chunk_rows(parsed: DataFrame) -> DataFrame:
    """(path, chunk_seq, heading_trail, body, start_line, end_line)."""
    return parsed.select("path", F.explode("chunks").alias("c")).select("path", "c.*")
