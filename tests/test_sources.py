"""Parsers, builds, watching, reports."""

from lodegraph import schema
from lodegraph.operators.store import Store
from lodegraph.plans import reports
from lodegraph.sources import files, parsers
from lodegraph.streaming import watch

SOURCES = {
    "python": ("import os, json as j\nfrom a.b import c\nclass A(Base, object):\n    def m(self):\n        pass\n# class No\ns = '''class No2: '''\nasync def f(): pass\n", {"class:p#A", "function:p#m", "function:p#f", "external_dep:os", "external_dep:json", "external_dep:a"}, {"class:p#A|inherits|class:p#Base"}),
    "csharp": ("using System.Text;\nnamespace N.M {\n public class A : B, IC {\n  public int Go(int x) { return 1; }\n }\n interface IC : ID { }\n}", {"external_dep:System", "module:p#N.M", "class:p#A", "interface:p#IC", "method:p#Go"}, {"class:p#A|inherits|class:p#B", "class:p#A|inherits|class:p#IC", "interface:p#IC|inherits|class:p#ID"}),
    "go": ('package p\nimport (\n\t"fmt"\n\tx "a/b"\n)\ntype T struct { }\ntype I interface { }\nfunc F(a int) int { return 1 }\nfunc (t *T) M() {}\n', {"external_dep:fmt", "external_dep:a/b", "class:p#T", "interface:p#I", "function:p#F", "method:p#M"}, set()),
    "java": ("import java.util.List;\nimport static org.x.Y.z;\npublic class A<T> extends B implements C, D<E> {\n  public A() { }\n  private static int go(int x) { return 1; }\n}\ninterface I extends J {}\nenum K { X }", {"external_dep:java", "external_dep:org", "class:p#A", "class:p#K", "interface:p#I", "method:p#A", "method:p#go"}, {"class:p#A|inherits|class:p#B", "class:p#A|implements|interface:p#C", "class:p#A|implements|interface:p#D"}),
    "rust": ("use std::io;\nstruct S { }\nenum E { A }\ntrait T { }\nfn f() { }\nimpl S {\n  fn m(&self) { }\n}\n", {"external_dep:std", "class:p#S", "class:p#E", "interface:p#T", "function:p#f", "method:p#m"}, set()),
    "ruby": ("require 'json'\nrequire_relative 'x/y'\nmodule M\n  class A < B\n    def go?\n    end\n  end\nend\ndef top\nend\n", {"external_dep:json", "external_dep:x/y", "module:p#M", "class:p#A", "method:p#go?", "function:p#top"}, set()),
    "php": ("<?php\nuse App\\Models\\User;\nclass A extends B implements C {\n  public function m() {}\n}\ninterface I {}\ntrait T {}\nfunction f() {}\n", {"external_dep:App", "class:p#A", "class:p#T", "interface:p#I", "method:p#m", "function:p#f"}, set()),
    "c": ('#include <stdio.h>\n#include "x/y.h"\nstruct S { int a; };\nenum E { A };\nint main(int argc, char **argv) {\n  if (x) { }\n  return 0;\n}\n', {"external_dep:stdio.h", "external_dep:x/y.h", "class:p#S", "class:p#E", "function:p#main"}, set()),
    "cpp": ("class A : public B { };\nvoid A::go(int x) const {\n}\n", {"class:p#A", "function:p#go"}, set()),
    "kotlin": ("import a.b.C\nclass A(val x: Int) : B(), I\nobject O\ninterface I\nfun f(x: Int) = 1\n", {"external_dep:a", "class:p#A", "class:p#O", "interface:p#I", "function:p#f"}, set()),
    "typescript": ("import x from './lib/b.js';\nimport { y } from '@org/pkg/sub';\nconst z = require('lodash/fp');\nexport class A extends B implements C {\n  private go(a: number): void {\n  }\n}\ninterface I { }\nfunction f() { }\nconst g = async (q) => q;\n", {"external_dep:@org/pkg", "external_dep:lodash", "class:p#A", "interface:p#I", "function:p#f", "function:p#g", "method:p#go"}, {"class:p#A|inherits|class:p#B", "class:p#A|implements|interface:p#C", "file:p|imports|file:lib/b"}),
}


def test_languages():
    for lang, (text, want, links) in SOURCES.items():
        nodes, edges = parsers.parse("p", lang, text)
        assert {n["id"] for n in nodes} == want | {"file:p"}, lang
        assert {e["id"] for e in edges if e["kind"] in ("inherits", "implements") or e["to_id"].startswith("file:")} == links, lang
        assert {e["to_id"] for e in edges if e["kind"] == "exports"} == {i for i in want if not i.startswith("external")}, lang


def test_build_is_incremental(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "store")
    (src / "node_modules").mkdir(parents=True)
    (src / "lib").mkdir()
    (src / "a.ts").write_text("import { b } from './lib/b';\nimport c from './c';\nexport function f() { }\n")
    (src / "lib/b.ts").write_text("export class K { }\n")
    (src / "node_modules/x.ts").write_text("class Z { }\n")
    (src / "note.txt").write_text("class Z { }\n")
    got = files.build(spark, str(src), out, 1)
    assert (got["parsed"], got["skipped"], got["errors"].count()) == (2, 0, 0)
    g = Store(spark, out).graph()
    a = f"file:{src}/a.ts"
    assert {r.to_id for r in g.edges.where("kind = 'imports'").collect()} == {f"file:{src}/lib/b.ts", f"file:{src}/c"}
    assert g.nodes.where(f"id = '{a}'").count() == 1 and g.nodes.where("name = 'Z'").count() == 0
    assert files.build(spark, str(src), out, 2)["skipped"] == 2
    (src / "a.ts").write_text("export function h() { }\n")
    (src / "lib/b.ts").unlink()
    assert files.build(spark, str(src), out, 3)["parsed"] == 1
    s = Store(spark, out)
    assert {r.name for r in s.graph().nodes.collect()} == {"a.ts", "h"}
    assert s.load("files", schema.FILES).count() == 1


def test_watch(spark, tmp_path):
    feed, out = tmp_path / "feed", str(tmp_path / "store")
    feed.mkdir()
    row = '{{"ts": "2024-01-01T00:00:0{}Z", "file_path": "/w/{}.py", "event": "{}", "content": "{}"}}\n'
    (feed / "1.json").write_text(row.format(1, "a", "add", "def f(): pass") + row.format(2, "a", "change", "def g(): pass") + row.format(1, "b", "add", "def h(): pass"))
    seen = []
    q = watch.watch(spark, watch.file_stream(spark, str(feed)), out, seen.append, {"availableNow": True}, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None and seen[0]["parsed"] == 2
    names = lambda: {r.name for r in Store(spark, out).graph().nodes.collect()}
    assert names() == {"a.py", "b.py", "g", "h"}
    watch.apply_batch(spark, out, spark.createDataFrame([("2024-01-02", "/w/b.py", "unlink", None)], "ts string, file_path string, event string, content string"), 2)
    assert names() == {"a.py", "g"}


def test_reports(spark, tmp_path):
    nodes, edges = parsers.parse("/r/a.ts", "typescript", SOURCES["typescript"][0])
    from lodegraph.schema import Graph

    g = Graph(spark.createDataFrame([{**n, "language": n["language"] or ""} for n in nodes]), spark.createDataFrame(edges))
    lines = reports.bundle_lines(g, "/r/a.ts", source="code")
    text = reports.render_bundle(lines, "/r/a.ts")
    assert "## Symbols" in text and "- class `A`" in text and "extends `class:/r/a.ts#B`" in text and "```\ncode" in text
    members = g.nodes.where("not is_external").selectExpr("id", "'all' as community")
    written = reports.write_wiki(reports.wiki_pages(g, members), str(tmp_path / "wiki"))
    assert len(written) == 2 and "Exported" in (tmp_path / "wiki" / written[1]).read_text()
    page = tmp_path / "g.html"
    n, links = reports.write_drawing(g, str(page), "</script>")
    text = page.read_text()
    assert n == g.nodes.where("not is_external").count() and text.count('"bucket"') == n and text.count('"source"') == links and text.count("<script>") == 1
    rows = reports.run_eval(lambda: g, {"go": "go"}, {}, ["f"], 10_000, "/r/a.ts")
    assert [r["benchmark"] for r in rows] == list(reports.THRESHOLDS) and rows[1]["passed"] and rows[2]["score"] == 1
    assert "| search_quality | 1 | 1 | 1.000 |" in reports.eval_markdown(reports.eval_summary(spark.createDataFrame(rows)))
