import random
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from marrow.llm import decontaminate


def test_query(spark, check_sql):
    got = check_sql(spark, "op7_decontaminate")
    assert got.where("contaminated").count() > 3


def test_spans_point_into_the_original(spark):
    item = "Ärger mit der Öl-Pumpe: was ist los, Herr Ober, heute abend?"
    text = f"«Vor» dem 😀 {item.upper().replace('Ä', 'ä')} — ÄRGER"
    docs = spark.createDataFrame([(1, f"x {item} y {item.replace(',', ';;')}"), (2, text), (3, "mit der öl"), (4, None)], "doc_id int, text string")
    items = spark.createDataFrame([(10, item), (11, "der Ölpumpe"), (None, "x"), (12, None), (13, " . ")], "item_id int, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan(docs, items).collect()}
    assert got[1]["items"] == ["10"]
    first = docs.where("doc_id = 1").first()["text"]
    assert [first[s["start"] : s["end"]] for s in got[1]["spans"]] == [f"x {item[:-1]}", item.replace(",", ";;")[:-1]]
    assert got[2]["items"] == ["10"]
    assert [text[s["start"] : s["end"]] for s in got[2]["spans"]] == ["MIT DER ÖL-PUMPE: WAS IST LOS, HERR OBER, HEUTE ABEND"]  # ä is not Ä
    assert (got[4]["n_words"], got[4]["spans"]) == (0, [])


def test_several_automata_give_the_same(spark, tables):
    path, _ = tables
    docs, items = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontaminate.scan(docs, items, keep=("lang", "text")).collect()
    parts = decontaminate.scan(docs, items, keep=("lang", "text"), max_nodes=300).collect()
    assert sorted(whole, key=str) == sorted(parts, key=str)


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    item = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, "x " + " ".join(item.split()[i : i + 10]) + " y") for i in range(51)] + [(99, " ".join(item.split()[:9]))], "doc_id int, text string")
    items = spark.createDataFrame([(1, item), (2, item)], "item_id int, text string")
    for nodes in (10**9, 100):
        got = decontaminate.scan(docs, items, max_nodes=nodes).collect()
        assert {(r["doc_id"], r["n_hit"], tuple(r["items"])) for r in got} == {(i, 10, ("1", "2")) for i in range(51)} | {(99, 0, ())}


def test_memory_of_a_large_benchmark():
    """4 MB of benchmark text in shards: one machine at a time stays within its bound, resident."""
    code = """
import random, resource, sys
sys.path.insert(0, "/root/repo" if len(sys.argv) < 2 else sys.argv[1])
from marrow.llm import decontaminate as d
rng = random.Random(2)
names = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(20000)]
items = [(str(i), " ".join(rng.choices(names, k=200))) for i in range(3400)]
assert sum(len(t) for _, t in items) > 4_000_000
words = d.MAX_NODES // d.WINDOW
shard = items[: words // 200]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
m = d.Machine(shard, d.WINDOW)
assert m.found.get_stats()["nodes_count"] <= d.MAX_NODES + 1
assert m.find([w.encode() for w in ("x " + shard[5][1]).split()])[1] == {"5"}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    root = str(Path(decontaminate.__file__).resolve().parents[2])
    used = int(subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, check=True).stdout)
    assert used < 400_000  # KB


def test_windows_of_every_length_are_found():
    """Against trying every place, with items of one to twelve words."""
    rng = random.Random(6)
    names = [f"w{i}" for i in range(12)]
    for _ in range(200):
        items = [(str(i), " ".join(rng.choices(names, k=rng.randint(1, 12)))) for i in range(rng.randint(1, 4))]
        words = [w.encode() for w in rng.choices([*names, "x", "y"], k=rng.randint(0, 60))]
        runs, ids = [], set()
        for item, text in items:
            w = text.encode().split()
            for j in range(max(1, len(w) - 4)):
                window = w[j : j + 5]
                for k in range(len(words) - len(window) + 1):
                    if words[k : k + len(window)] == window:
                        runs.append((k, k + len(window) - 1))
                        ids.add(item)
        assert decontaminate.Machine(items, 5).find(words) == (decontaminate.merged(runs), ids)


def test_a_worker_builds_a_machine_once():
    one = decontaminate.machine("k", [("1", "a b")], 10)
    assert decontaminate.machine("k", [("1", "a b")], 10) is one
    assert decontaminate.machine("l", [("1", "a b")], 10) is not one


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b", "h")], "doc_id int, text string, hits string").withColumn("items", F.lit(1)).withColumn("id", F.lit(1))
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.scan(docs, none).first()["n_hit"] == 0
    assert decontaminate.scan(docs.limit(0), none).count() == 0
