import json
import os

import numpy as np
import pytest
from pyspark.sql import Row

from marrow import cli
from marrow.operators.embed import HashEmbedder, StaticEmbedder
from marrow.plans.index import VaultError, cache_key, load_or_build, open_index, read_manifest
from marrow.plans.search import search, with_snippets
from marrow.sources import vault
from marrow.sources.sinks import json_string, result_json, result_text

GARDEN = "---\ntitle: Community Garden\naliases: [Garden Plot]\ntags:\n  - gardening\n---\n\n# Community Garden\n\nTomatoes and herbs grow here every summer.\n\n## Soil prep\n\nTurn the soil in spring for #gardening beds.\n"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "vault"
    for name, text in {"Projects/Garden.md": GARDEN, "_x.md": "# Under\nscore tomatoes", ".x.md": "dotted", "A.MD": "upper case", ".obsidian/y.md": "hidden", "n.txt": "no note", "sub/.git/z.md": "hidden"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    os.symlink(root / "A.MD", root / "link.md")
    return root


def test_source_lists_notes(spark, folder):
    vault.register(spark)
    rows = spark.read.format("vault").load(str(folder)).collect()
    assert sorted(r["path"] for r in rows) == [".x.md", "A.MD", "Projects/Garden.md", "_x.md"]
    assert {r["path"]: r["size"] for r in rows}["A.MD"] == 10
    assert [f[0] for f in vault.snapshot(str(folder))] == [".x.md", "A.MD", "Projects/Garden.md", "_x.md"]


def test_source_refuses_what_is_not_utf8(spark, folder):
    (folder / "bad.md").write_bytes(b"\xff\xfe")
    vault.register(spark)
    with pytest.raises(Exception, match="not UTF-8"):
        spark.read.format("vault").load(str(folder)).collect()


def test_index_lifecycle_and_search(spark, folder, tmp_path):
    e, base = HashEmbedder(), str(tmp_path / "cache")
    index, status = load_or_build(spark, str(folder), e, base)
    assert (status.kind, status.reason) == ("rebuild", "missing manifest")
    assert load_or_build(spark, str(folder), e, base)[1].kind == "hit"
    queries = spark.createDataFrame([(0, "soil #gardening"), (1, "Garden Plot"), (2, ""), (3, None)], "query_id bigint, query string")
    rows = with_snippets(search(index, queries, 3, e), 200).collect()
    assert {r["query_id"] for r in rows} == {0, 1}
    first = rows[0]
    assert (first["path"], first["start_line"], first["heading_trail"]) == ("Projects/Garden.md", 14, ["Community Garden", "Soil prep"])
    assert GARDEN.split("\n")[first["start_line"] - 1] == first["snippet"].split("\n")[0]
    (folder / "A.MD").write_text("changed now", encoding="utf-8")
    assert load_or_build(spark, str(folder), e, base)[1].reason == "stale or incompatible cache"
    # damage of any kind is a rebuild
    cache = os.path.join(base, "marrow", cache_key(os.path.realpath(folder)))
    manifest = read_manifest(f"{cache}/manifest.json")
    for damage in ('{"schema":"nope"}', "{", json.dumps({**manifest, "files": [{**manifest["files"][0], "size": "x"}]})):
        with open(f"{cache}/manifest.json", "w") as f:
            f.write(damage)
        assert load_or_build(spark, str(folder), e, base)[1].kind == "rebuild"
    version = read_manifest(f"{cache}/manifest.json")["version"]
    for name in os.listdir(f"{cache}/{version}/terms"):
        if name.endswith(".parquet"):
            with open(f"{cache}/{version}/terms/{name}", "wb") as f:
                f.write(b"NOT PARQUET")
    assert load_or_build(spark, str(folder), e, base)[1].kind == "rebuild"
    assert load_or_build(spark, str(folder), e, base)[1].kind == "hit"
    # a bad note fails the build and leaves the cache as it was
    (folder / "a bad.md").write_text("---\nx\n---\n", encoding="utf-8")
    with pytest.raises(VaultError, match="a bad.md:2"):
        load_or_build(spark, str(folder), e, base)
    (folder / "a bad.md").unlink()
    assert load_or_build(spark, str(folder), e, base)[1].kind == "hit"


def test_tables_that_disagree_are_damage(spark, folder, tmp_path):
    """Each table in turn loses its rows, or has one of them twice."""
    e, base = HashEmbedder(), str(tmp_path / "cache")
    load_or_build(spark, str(folder), e, base)
    cache = os.path.join(base, "marrow", cache_key(os.path.realpath(folder)))
    for name in ("notes", "chunks", "vectors", "postings", "doc_len", "terms", "stats"):
        for change in (lambda df: df.limit(0), lambda df: df.limit(1).union(df)):
            path = f"file://{cache}/{read_manifest(f'{cache}/manifest.json')['version']}"
            if name in ("notes", "stats") and change(spark.range(1)).count() == 2:
                continue  # a note twice has no effect on counts of chunks, nor has a second row of stats
            spark.createDataFrame(change(spark.read.parquet(f"{path}/{name}")).collect(), spark.read.parquet(f"{path}/{name}").schema).write.mode("overwrite").parquet(f"{path}/{name}")
            with pytest.raises(ValueError, match="damaged"):
                open_index(spark, path)
            assert load_or_build(spark, str(folder), e, base)[1].kind == "rebuild"


def test_a_model_folder_gives_its_vectors(spark, folder, tmp_path, capsys):
    """A small matrix and tokenizer as such models have them: the mean of the tokens' rows, each times its scale, of length one."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = tmp_path / "model"
    model.mkdir()
    words = ["[UNK]", "soil", "tomatoes", "herbs"]
    t = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(model / "tokenizer.json"))
    matrix, scale = np.array([[0, 0, 1], [2, 0, 0], [0, 4, 0], [0, 4, 1]], np.int8), np.array([1, 0.5, 0.25, 1], np.float32)
    head = json.dumps({"embeddings": {"dtype": "I8", "shape": [4, 3], "data_offsets": [0, 12]}, "scales": {"dtype": "F32", "shape": [4], "data_offsets": [12, 28]}}).encode()
    (model / "model.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + matrix.tobytes() + scale.tobytes())
    e = StaticEmbedder(str(model))
    got = e.embed(["soil tomatoes", "", "herbs"])
    assert np.allclose(got, [[2**-0.5, 2**-0.5, 0], [0, 0, 0], [0, 4 / 17**0.5, 1 / 17**0.5]], atol=1e-6)
    index, _ = load_or_build(spark, str(folder), e, str(tmp_path / "cache"))
    assert index.vectors.selectExpr("max(size(embedding))").first()[0] == 3
    assert load_or_build(spark, str(folder), HashEmbedder(), str(tmp_path / "cache"))[1].kind == "rebuild"
    os.environ["XDG_CACHE_HOME"] = str(tmp_path / "home")
    try:
        assert cli.main(["ask", "--vault", str(folder), "tomatoes", "--model", str(model), "--json"]) == 0
    finally:
        del os.environ["XDG_CACHE_HOME"]
    assert json.loads(capsys.readouterr().out)["results"][0]["path"] in ("Projects/Garden.md", "_x.md")


def test_every_chunk_of_the_garden(spark, folder, tmp_path):
    index, _ = load_or_build(spark, str(folder), HashEmbedder(), str(tmp_path / "cache"))
    got = [(r["chunk_seq"], r["heading_trail"], r["start_line"], r["end_line"], r["body"]) for r in index.chunks.where("path = 'Projects/Garden.md'").orderBy("chunk_seq").collect()]
    assert got == [
        (0, ["Community Garden"], 10, 10, "Tomatoes and herbs grow here every summer."),
        (1, ["Community Garden", "Soil prep"], 14, 14, "Turn the soil in spring for #gardening beds."),
    ]


def test_cache_keys_differ():
    assert cache_key("/a") == cache_key("/a") != cache_key("/b")
    assert len(cache_key("/a")) == 64


def test_sinks():
    row = Row(path='a"b.md', heading_trail=["Community Garden", "Soil prep"], start_line=1, end_line=2, score=0.5, snippet="x\n\x01\x08é")
    assert result_json([row]) == '{"results":[{"path":"a\\"b.md","heading_trail":["Community Garden","Soil prep"],"start_line":1,"end_line":2,"score":0.500000,"snippet":"x\\n\\u0001\\u0008é"}]}\n'
    assert json.loads(result_json([row]))["results"][0]["snippet"] == "x\n\x01\x08é"
    assert json.loads(json_string("\\b \\ \b")) == "\\b \\ \b"
    assert result_json([]) == '{"results":[]}\n'
    assert result_text([]) == "(no results)\n"
    assert result_text([row, row]).startswith('a"b.md\n  Community Garden > Soil prep\n  lines 1-2\n  x')


@pytest.mark.parametrize("argv", [[], ["ask"], ["ask", "--vault", "v"], ["ask", "--vault", "v", ""], ["--help"], ["ask", "--vault"], ["ask", "--vault", "v", "q", "r"], ["ask", "--vault", "v", "q", "--top-k", "0"], ["ask", "--vault", "v", "q", "--top-k", "51"], ["ask", "--vault", "v", "q", "--top-k", "+5"], ["--vault", "v", "q"], ["ask", "--vault", "v", "-q"]])
def test_usage_errors(argv, capsys):
    assert cli.main(argv) == 2
    assert capsys.readouterr().err


def test_arguments_in_any_order():
    assert cli.arguments(["--json", "q w", "--top-k", "7", "--vault", "v", "ask"]) == cli.Request("v", "q w", 7, True)
    assert cli.arguments(["ask", "--vault", "v", " "]).query == " "


def test_the_cache_folder_of_each_system(monkeypatch):
    from marrow.plans import index

    monkeypatch.setenv("HOME", "/home/x")
    monkeypatch.delenv("XDG_CACHE_HOME", raising=False)
    assert index.cache_base() == "/home/x/.cache"
    monkeypatch.setenv("XDG_CACHE_HOME", "/cache")
    assert index.cache_base() == "/cache"
    monkeypatch.setattr(index.sys, "platform", "darwin")
    assert index.cache_base() == "/home/x/Library/Caches"


def test_why_a_cache_is_not_used(tmp_path):
    from marrow.plans import index

    assert index.why(str(tmp_path), None) == "missing manifest"
    (tmp_path / "manifest.json").write_text("{}")
    assert index.why(str(tmp_path), None) == "stale or incompatible cache"
    assert index.why(str(tmp_path), {"version": "v-1"}) == "missing index.bin"
    (tmp_path / "v-1").mkdir()
    assert index.why(str(tmp_path), {"version": "v-1"}) == "stale or incompatible cache"
