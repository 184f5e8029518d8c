"""The engine object and the command line over a small source tree under version control."""

import json
import subprocess

import pytest

from lodegraph import cli
from lodegraph.engine import Engine


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    (root / "a.ts").write_text("import { help } from './b';\nexport function start() { return help(); }\n")
    (root / "b.ts").write_text("export function help() { return 1; }\n")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    (root / "b.ts").write_text("export function help() { return 2; } // token\n")
    git("commit", "-qam", "two")
    e = Engine(spark, str(root / ".store"), str(root))
    assert e.build()["parsed"] == 2
    return e, root


def test_questions(tree):
    e, root = tree
    assert {r.id for r in e.impact("b.ts").collect()} == {f"file:{root}/a.ts"}
    assert e.stats()["files"] == 2 and e.deps("a.ts")["direct"].count() == 1
    assert "## Source" in e.bundle("a.ts")
    assert e.embed_nodes() == 4 and e.embed_nodes() == 0
    assert e.hybrid_search("help").first().name == "help"
    assert "b.ts" in e.review_context() and e.analyze_changes().first().lines == 2


def test_rename(tree):
    e, root = tree
    key = e.rename_preview(f"function:{root}/b.ts#help", "assist", now=0.5)["id"]
    assert e.apply_rename("zzzzzzzz")["status"] == "unknown"
    assert e.apply_rename(key, now=10_000)["status"] == "expired"
    key = e.rename_preview(f"function:{root}/b.ts#help", "assist")["id"]
    assert e.apply_rename(key)["replaced"] == 1 and "function assist()" in (root / "b.ts").read_text()


def test_command_line(tree, spark):
    e, root = tree
    run = lambda *a: cli.main(["--root", str(root), "--store", e.store.path, "--registry", str(root / "r.json"), *a], spark)
    assert len(json.loads(run("search", "help"))) >= 1
    assert json.loads(run("impact", "b.ts"))[0]["depth"] == 1
    run("registry-register", str(root), e.store.path)
    assert json.loads(run("registry-search", "help"))[0]["repo"] == root.name


def test_lookups_index_and_sections(tree, spark):
    e, root = tree
    assert e.file("a.ts").first().language == "typescript" and e.file("zz.ts").count() == 0
    e.embed_nodes()
    n = e.embedding_count().first().n
    assert e.embedding("a.ts").count() == 1
    e.delete_embedding("a.ts")
    assert e.embedding("a.ts").count() == 0 and e.embedding_count().first().n == n - 1
    assert e.tfidf_search("start").count() >= 1
    stamp = e.store.load("index_of").inputFiles()
    assert e.find_similar("a.ts").count() >= 0 and e.store.load("index_of").inputFiles() == stamp
    e.persist_communities()
    first = e.stored_communities().first()
    assert e.stored_communities(0).count() >= 1 and e.stored_communities(7).count() == 0 and e.community_members(first.id).count() == first["size"]
    assert e.wiki_section("zzz").startswith("No section zzz. Sections: ") and "## Files" in e.wiki_section(first.name)
    page = root / "g.html"
    drawn = e.drawing(str(page))
    assert drawn["nodes"] == e.graph.nodes.where("not is_external").count() and drawn["links"] > 0 and page.read_text().count('"source"') == drawn["links"]


def test_watching_a_tree(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for n in "abc":
        (src / f"{n}.py").write_text(f"def {n}1(): pass\n")
    e = Engine(spark, str(tmp_path / "store"), str(src))
    assert e.watch(rounds=1) == 1 and e.store.load("files").count() == 3
    assert e.watch(rounds=1) == 0
    e.embed_nodes()
    (src / "a.py").unlink()
    (src / "b.py").unlink()
    (src / "c.py").write_text("def c2(): pass\n")
    assert e.watch(rounds=1) == 1
    left = {r.id for r in e.graph.nodes.collect()}
    assert any(x.endswith("#c2") for x in left) and not any("/a.py" in x or "/b.py" in x for x in left)
    assert not any("/a.py" in r.node_id for r in e.store.load("embeddings").collect())


def test_evaluation(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("import b\ndef start():\n    return b.help()\n")
    (src / "b.py").write_text("def help():\n    return 1\n")
    spec = tmp_path / "repos.json"
    spec.write_text(json.dumps([{"name": "two", "root": str(src), "store": str(tmp_path / "store"), "searches": {"help": "b.py"}, "entries": [], "bundle_file": "a.py"}]))
    e = Engine(spark, str(tmp_path / "none"), str(src))
    text = e.evaluate(str(spec), str(tmp_path / "out.csv"))
    assert text.count("|") > 20 and "search_quality | 1 | 1 | 1.000" in text
    lines = (tmp_path / "out.csv").read_text().splitlines()
    assert lines[0] == "repo,benchmark,score,passed,seconds" and len(lines) == 6
    assert e.eval_repos(str(spec)) == [{"name": "two", "root": str(src)}]


def test_more_than_ten_thousand_files(spark, tmp_path):
    from pyspark.sql import functions as F

    n = 10_050
    e = Engine(spark, str(tmp_path / "store"), str(tmp_path))
    path = F.concat(F.lit(f"{tmp_path}/f"), "id", F.lit(".ts"))
    row = lambda i, p: [i.alias("id"), F.lit("function").alias("kind"), F.lit("old").alias("name"), p.alias("file_path")]
    nodes = spark.range(n).select(*row(F.concat(F.lit("function:"), path), path)).union(spark.range(1).select(*row(F.lit("function:x"), F.lit(f"{tmp_path}/x.ts"))))
    e.store.save("nodes", nodes)
    e.store.save("edges", nodes.where("id != 'function:x'").select(F.concat("id", F.lit("|x")).alias("id"), F.col("id").alias("from_id"), F.lit("function:x").alias("to_id"), F.lit("calls").alias("kind")))
    for i in range(n):
        (tmp_path / f"f{i}.ts").write_text("old()\n")
    read = e._contents(spark.range(n).select(path.alias("file_path"), F.lit("modified").alias("status")))
    assert read.where("content = 'old()\n'").select("file_path").distinct().count() == n
    got = e.rename_preview("function:x", "new")
    assert got["n_edits"] == n + 1
    done = e.apply_rename(got["id"])
    assert (done["files"], done["replaced"], done["skipped"]) == (n, n, [f"{tmp_path}/x.ts"])
    assert all((tmp_path / f"f{i}.ts").read_text() == "new()\n" for i in range(n))
