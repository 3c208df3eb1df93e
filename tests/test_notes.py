import random

import pyarrow as pa
import pytest

from marrow.operators.notes import HARD_MAX, VaultParseError, chunk_rows, cut, first_error, frontmatter, heading, parse, parse_note


def note(text, path="n.md"):
    return parse_note(path, text.encode())


def trails(n):
    return [c["heading_trail"] for c in n["chunks"]]


def lines(n):
    return [(c["start_line"], c["end_line"]) for c in n["chunks"]]


def test_frontmatter_and_inline_tags():
    n = note("---\ntitle: Hello\naliases:\n  - Hi\n  - Hey\ntags: [a, b]\n---\nbody #c\n")
    assert (n["title"], n["aliases"], n["tags"]) == ("Hello", ["Hi", "Hey"], ["a", "b", "c"])


@pytest.mark.parametrize(
    ("text", "line"),
    [
        ("---\ntitle:\n  - nope\n---\n", 2),
        ("---\ntitle: x\n", 1),
        ("---\n# comment\n---\n", 2),
        ("---\n- x\n---\n", 2),
        ("---\na: 1\ntags: [a, [b]]\n---\n", 3),
        ("---\ntags: [a\n---\n", 2),
        ('---\ntags: ["a]\n---\n', 2),
        ("---\ntitle: |\n---\n", 2),
        ("---\ntags:\n- [x]\n---\n", 3),
        ("---\ntags: {a: 1}\n---\n", 2),
    ],
)
def test_what_frontmatter_does_not_take(text, line):
    with pytest.raises(VaultParseError) as e:
        note(text, "d/x.md")
    assert (e.value.path, e.value.line) == ("d/x.md", line)
    assert str(e.value).startswith(f"unsupported frontmatter in d/x.md:{line}: ")


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (b"meta:\n  title: X", (b"X", [], [])),
        (b"title: a\ntitle: 'b'", (b"b", [], [])),
        (b"title: |-", (b"|-", [], [])),
        (b"tags: a, b", (None, [], [b"a, b"])),
        (b"aliases: [\"A, B\", 'C, D']\ntags: [one, \"two, three\"]", (None, [b"A, B", b"C, D"], [b"one", b"two, three"])),
        (b"tags: [, a,, b ,]\ntags: c", (None, [], [b"a", b"b", b"c"])),
        (b"x:\n- [skipped]\n\n- {too}\ntags:\n\n- a\n\n-  b\r\n", (None, [], [b"a", b"b"])),
        (b"tags: []", (None, [], [])),
    ],
)
def test_frontmatter_forms(text, found):
    assert frontmatter(text) == found


def test_a_longer_mark_closes_and_its_rest_is_body():
    n = note("---\ntitle: T\n----\nx\n")
    assert n["title"] == "T"
    assert n["chunks"][0]["body"] == "-\nx"


@pytest.mark.parametrize(("line", "found"), [(b"# C#", (1, b"C")), (b"#x", None), (b"####### a", None), (b"#", None), (b"#\tx", None), (b"## a ##  ", (2, b"a")), (b"# ", (1, b"")), (b" # a", None)])
def test_headings(line, found):
    assert heading(line) == found


def test_sections_and_trails():
    assert trails(note("### Deep\n\nx\n")) == [["", "", "Deep"]]
    n = note("# T\n## S\ntext\n")
    assert (n["h1"], trails(n), lines(n)) == (None, [["T", "S"]], [(3, 3)])
    n = note("# One\na\n# Two\nb\n")
    assert len(n["chunks"]) == 2
    assert all("# Two" not in c["body"] for c in n["chunks"])
    n = note("# A\n\nfoo\n\n# A\n\nbar\n")
    assert ([c["body"] for c in n["chunks"]], lines(n)) == (["foo\nbar"], [(3, 7)])
    n = note("")
    assert ([c["body"] for c in n["chunks"]], lines(n), trails(n)) == ([""], [(1, 1)], [[]])


def test_fences_hide_headings_and_tags():
    n = note("# Real\n```\n# Fake Heading\n#faketag\n```\n#keep\n")
    assert n["tags"] == ["keep"]
    assert trails(n) == [["Real"]]
    assert "# Fake Heading" in n["chunks"][0]["body"]
    assert note("~~~~\n```\n~~~\n#a\n~~~~~ rest\n#b\n")["tags"] == ["b"]
    assert note("x\n```\n#never\n")["tags"] == []


@pytest.mark.parametrize(
    ("line", "tags"),
    [("`#nope` ``#nope3`` #real", ["real"]), ("`open #x", []), ("##x", ["x"]), ("a#b -#c _#d /#e", ["e"]), ("#123 #a/b-c_d.", ["123", "a/b-c_d"]), ("#Title", ["Title"]), ("``a`#b`` #c", ["c"]), ("# #", [])],
)
def test_inline_tags(line, tags):
    assert note(line)["tags"] == tags


def test_frontmatter_tags_keep_repeats_and_inline_ones_are_added_once():
    assert note("---\ntags: [a, a]\n---\n#a #b #b\n")["tags"] == ["a", "a", "b"]


def test_a_split_at_a_blank_line_keeps_line_numbers():
    text = "# Big\n" + "alpha " * 120 + "\n   \n" + "bravo " * 120 + "\n"
    n = note(text)
    second = next(c for c in n["chunks"] if c["body"].startswith("bravo"))
    assert text.split("\n")[second["start_line"] - 1].startswith("bravo")


def test_hard_cuts():
    n = note("# Big\n" + "word " * 2500)
    assert len(n["chunks"]) > 1
    assert all(len(c["body"].encode()) <= HARD_MAX for c in n["chunks"])
    n = note("a" + "é" * 1200)
    assert "".join(c["body"] for c in n["chunks"]) == "a" + "é" * 1200  # no character is cut


def test_nearest_cut_first_wins():
    assert cut(b"x" * 700 + b"\n\n" + b"y" * 94 + b"\n\n" + b"z" * 400) == 702
    assert cut(b"x" * 740 + b"\n" + b"y" * 19 + b"\n" + b"z" * 400) == 741
    assert cut(b"x" * 2000) == 1000


def test_random_notes_lose_nothing():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "é😀", "\n", "\n\n", "# H\n", "x" * 90, " \t", "\r\n"]) for _ in range(rng.randint(0, 250)))
        n = note(text)
        assert all(len(c["body"].encode()) <= HARD_MAX for c in n["chunks"])
        assert all(a <= b for a, b in lines(n))
        source = text.split("\n")
        for c in n["chunks"]:
            first = c["body"].split("\n")[0].strip()
            assert first in source[c["start_line"] - 1] or not first


def test_tables_of_notes(spark):
    files = spark.createDataFrame([("b.md", b"---\nx\n---\n"), ("a.md", b"---\n- y\n---\n"), ("c.md", b"# T\ntext"), ("d.md", None)], "path string, content binary")
    parsed = parse(files)
    assert first_error(parsed) == "unsupported frontmatter in a.md:2: a list item that belongs to no key"
    rows = {(r["path"], r["body"]) for r in chunk_rows(parsed.where("error IS NULL")).collect()}
    assert rows == {("c.md", "text"), ("d.md", "")}


@pytest.mark.parametrize("raw", [b"---\ntags: [" + b",".join(b"t%d" % i for i in range(100_000)) + b"]\n---\n" + b" ".join(b"#u%d" % i for i in range(100_000)), b"x" * 8_000_000, b"`a` " * 500_000, b"paragraph\n\n" * 100_000])
def test_time_goes_with_the_length(raw):
    import time

    began = time.process_time()
    note = parse_note("x.md", raw)
    assert time.process_time() - began < 15  # seconds; in the square of the length it would be many minutes
    assert all(len(c["body"].encode()) <= HARD_MAX for c in note["chunks"])


def test_a_batch_is_parsed_in_small_slices(spark):
    """Whatever Spark hands over at once, about a megabyte of notes is held as Python objects."""

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    rows = [(f"n{i}", b"# A\n" + b"word " * 20_000) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["path", "content"])
    got = list(parse(Files())(iter([batch])))
    assert [p for b in got for p in b.column("path").to_pylist()] == [r[0] for r in rows]
    assert max(b.nbytes for b in got) < 1_500_000
