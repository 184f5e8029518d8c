"""Composite outputs: context bundles, wiki pages, drawings, evaluation. Only ordered, bounded lists reach the driver."""

from __future__ import annotations

import csv
import html
import io
import json
import os
import re
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions.text import search_like, token_estimate
from lodegraph.operators import community as com
from lodegraph.operators import graph as ops
from lodegraph.operators import store
from lodegraph.operators.traverse import traverse
from lodegraph.schema import Graph
from lodegraph.storage import materialise


def _section(no: int, title: str, rows: DataFrame, line: Column, order: list, most: int | None = None) -> DataFrame:
    """section_no, title, pos, line in a fixed order; at most ``most`` lines, or all, which then are those of one file."""
    rows = rows if most is None else rows.orderBy(*order).limit(most)
    numbered = rows.withColumn("pos", F.row_number().over(W.orderBy(*order)))
    return numbered.select(F.lit(no).alias("section_no"), F.lit(title).alias("title"), "pos", line.alias("line"))


def bundle_lines(graph: Graph, file_path: str, depth: int = 2, source: str | None = None) -> DataFrame:
    """The lines of a bundle about one file, in seven sections; sections without lines are not there."""
    file_id = F.concat(F.lit("file:"), F.lit(file_path))
    n, e = graph.nodes, graph.edges
    code = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    own = n.where(F.col("file_path") == file_path)
    start = own.where("kind = 'file'").select("id").union(n.where(F.col("id") == file_id).select("id")).distinct()
    direct = e.where("kind = 'imports'").join(start.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).join(n, "id")
    parts = [
        _section(1, "File", n.sparkSession.range(1), F.concat(F.lit("Bundle for `"), F.lit(file_path), F.lit("`")), ["id"], 1),
        _section(2, "Layers", ops.layers(graph).limit(12), F.concat(F.lit("- "), "layer", F.lit(": "), F.col("n_files").cast("string"), F.lit(" files")), [F.desc("n_files"), "layer"], 12),
        _section(3, "Symbols", own.where("kind != 'file'"), F.concat(F.lit("- "), "kind", F.lit(" "), code("name")), ["kind", "name", "id"]),
        _section(4, "Imports", direct, F.concat(F.lit("- "), code("name"), F.when(F.col("is_external"), " (external)").otherwise("")), ["name", "id"]),
    ]
    if depth > 1:
        far = traverse(graph, start, ["imports"], "out", depth).where("depth > 1").select("id").distinct().join(n.where("not is_external"), "id")
        parts.append(_section(5, "Transitive imports", far, F.concat(F.lit("- "), code("name")), ["name", "id"], 10))
    importers = e.where("kind = 'imports'").join(start.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id"), "reason").join(n, "id")
    parts.append(_section(6, "Imported by", importers, F.concat(F.lit("- "), code("name"), F.lit(" - "), "reason"), ["name", "id"], 20))
    classes = own.where("kind in ('class', 'interface')").select("id", "name")
    kin = e.where("kind in ('inherits', 'implements')")
    up = kin.join(classes.select(F.col("id").alias("from_id"), "name"), "from_id").join(n.select(F.col("id").alias("to_id"), F.col("name").alias("other")), "to_id", "left").select("name", F.when(F.col("kind") == "inherits", "extends").otherwise("implements").alias("how"), F.coalesce("other", "to_id").alias("other"))
    down = kin.join(classes.select(F.col("id").alias("to_id"), "name"), "to_id").join(n.select(F.col("id").alias("from_id"), F.col("name").alias("other")), "from_id", "left").select("name", F.lit("extended by").alias("how"), F.coalesce("other", "from_id").alias("other"))
    parts.append(_section(7, "Hierarchy", up.unionByName(down), F.concat_ws(" ", F.lit("-"), code("name"), "how", code("other")), ["name", "how", "other"]))
    if source is not None:
        parts.append(_section(8, "Source", n.sparkSession.range(1), F.lit(f"```\n{source}\n```"), ["id"], 1))
    return reduce(DataFrame.unionByName, parts)


def bundle_sections(lines: DataFrame) -> DataFrame:
    """section_no, title, n_lines, tokens of each section."""
    return lines.groupBy("section_no", "title").agg(F.count("*").alias("n_lines"), token_estimate(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")).alias("tokens"))


def render_bundle(lines: DataFrame, file_path: str, stamp: str = "") -> str:
    rows = lines.orderBy("section_no", "pos", "line").collect()
    body: list[str] = []
    last = None
    for r in rows:
        if r.section_no != last:
            body += ["", f"## {r.title}", ""]
            last = r.section_no
        body.append(r.line)
    text = "\n".join(body)
    return f"<!-- bundle of {file_path} {stamp} about {-(-len(text) // 4)} tokens -->\n{text}\n"


def slug(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(label, r"[^a-zA-Z0-9_-]", "-"), "-+", "-"))


def wiki_pages(graph: Graph, members: DataFrame, most_files: int = 40, most_exports: int = 20) -> DataFrame:
    """community, label, slug, role, n_nodes, n_files, files, hubs, exported: one row per community of two and more.

    Lists are cut by window ranks before they are collected, so no row grows with its community.
    """
    n = graph.nodes.join(members, "id")
    size = n.groupBy("community").agg(F.count("*").alias("n_nodes"), F.countDistinct("file_path").alias("n_files")).where("n_nodes >= 2")

    def first(rows: DataFrame, order: list, most: int, line: Column, name: str) -> DataFrame:
        r = rows.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(*order))).where(F.col("r") <= most)
        return r.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda s: s["line"]), "\n").alias(name))

    files = first(n.select("community", "file_path").distinct(), ["file_path"], most_files, F.concat(F.lit("- `"), "file_path", F.lit("`")), "files")
    hubs = first(com.hubs(graph, members), [F.desc("fan_in"), "id"], 5, F.concat(F.lit("| "), "name", F.lit(" | "), F.col("fan_in").cast("string"), F.lit(" |")), "hubs")
    shown = graph.edges.where("kind = 'exports'").select(F.col("to_id").alias("id")).distinct().join(n, "id")
    exported = first(shown, ["name", "id"], most_exports, F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit(")")), "exported")
    out = size.join(com.names(graph, members), "community").join(com.roles(graph, members), "community").join(files, "community", "left").join(hubs, "community", "left").join(exported, "community", "left")
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("community", "label", slug(F.col("label")).alias("slug"), "role", "n_nodes", "n_files", none("files"), none("hubs"), none("exported"))


def page_text(r) -> str:
    return f"# {r.label}\n\nRole: {r.role}, {r.n_nodes} nodes in {r.n_files} files\n\n## Files\n\n{r.files}\n\n## Hubs\n\n| Name | Used by |\n|---|---|\n{r.hubs}\n\n## Exported\n\n{r.exported}\n"


def write_wiki(pages: DataFrame, folder: str) -> list[str]:
    """README.md and one page per community; rows come one at a time."""
    os.makedirs(folder, exist_ok=True)
    index, written = ["# Architecture", "", "| Community | Role | Nodes | Files |", "|---|---|---|---|"], []
    for r in pages.orderBy(F.desc("n_nodes"), "community").toLocalIterator():
        name = f"{r.slug}.md" if f"{r.slug}.md" not in written else f"{r.slug}-{len(written)}.md"
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(page_text(r))
        index.append(f"| [{r.label}]({name}) | {r.role} | {r.n_nodes} | {r.n_files} |")
        written.append(name)
    with open(f"{folder}/README.md", "w", encoding="utf-8") as f:
        f.write("\n".join(index) + "\n")
    return ["README.md", *written]


def wiki_section(pages: DataFrame, label: str) -> str:
    """One community's page by its label or slug, in any case; what there is, if none has it."""
    rows = pages.where((F.lower("label") == label.lower()) | (F.col("slug") == label.lower())).orderBy(F.desc("n_nodes"), "community").limit(1).collect()
    if not rows:
        return f"No section {label}. Sections: " + ", ".join(r.label for r in pages.select("label").distinct().orderBy("label").toLocalIterator())
    return page_text(rows[0])


_DRAW = """const v=document.getElementById("v"),g=v.getContext("2d"),q=document.getElementById("q"),k=document.getElementById("k");
const at=new Map(d.nodes.map((n,i)=>[n.id,i])),N=d.nodes.length,L=d.links.map(l=>[at.get(l.source),at.get(l.target)]).filter(l=>l[0]!==undefined&&l[1]!==undefined);
for(const x of [...new Set(d.nodes.map(n=>n.kind))].sort()){const o=document.createElement("option");o.textContent=x;k.append(o)}
const R=30*Math.sqrt(N+1);d.nodes.forEach((n,i)=>{const a=i*2.399963;n.x=R*Math.sqrt((i+.5)/N)*Math.cos(a);n.y=R*Math.sqrt((i+.5)/N)*Math.sin(a)});
let heat=N<20000?60:0,s=1,ox=0,oy=0;const step=()=>{for(const [a,b] of L){const p=d.nodes[a],r=d.nodes[b],dx=r.x-p.x,dy=r.y-p.y,z=Math.hypot(dx,dy)||1,f=(z-40)/z*.05;p.x+=dx*f;p.y+=dy*f;r.x-=dx*f;r.y-=dy*f}
const cells=new Map();for(const n of d.nodes){const c=Math.floor(n.x/40)+","+Math.floor(n.y/40),m=cells.get(c);if(m){const dx=n.x-m.x||Math.random()-.5,dy=n.y-m.y||Math.random()-.5,z=Math.hypot(dx,dy);n.x+=dx/z*4;n.y+=dy/z*4}else cells.set(c,n)}};
const draw=()=>{v.width=innerWidth;v.height=innerHeight-60;g.translate(v.width/2+ox,v.height/2+oy);const z=s*Math.min(v.width,v.height)/(2*R+80);g.scale(z,z);const t=q.value.toLowerCase(),on=n=>(!k.value||n.kind===k.value)&&n.label.toLowerCase().includes(t);
g.strokeStyle="#8886";g.beginPath();for(const [a,b] of L){const p=d.nodes[a],r=d.nodes[b];if(on(p)&&on(r)){g.moveTo(p.x,p.y);g.lineTo(r.x,r.y)}}g.stroke();
for(const n of d.nodes)if(on(n)){g.fillStyle=`hsl(${n.bucket*40} 60% 50%)`;g.beginPath();g.arc(n.x,n.y,5,0,7);g.fill();if(N<300||t){g.fillStyle="#333";g.fillText(n.label,n.x+7,n.y+3)}}};
const run=()=>{if(heat-->0){step();requestAnimationFrame(run)}draw()};q.oninput=k.onchange=draw;v.onwheel=e=>{s*=e.deltaY<0?1.1:.9;draw();e.preventDefault()};v.onpointermove=e=>{if(e.buttons){ox+=e.movementX;oy+=e.movementY;draw()}};run()"""


def write_drawing(graph: Graph, file: str, title: str = "graph") -> tuple[int, int]:
    """A page that draws the whole graph, external nodes left out, with filters by kind and name; it loads nothing from elsewhere.

    Rows go into the file a partition at a time. Returns the numbers of nodes and links.
    """
    own = Graph(graph.nodes.where("not is_external"), graph.edges)
    nodes = store.view_nodes(own).select("id", "label", "kind", "bucket").orderBy("id")
    links = store.view_edges(own).select(F.col("from_id").alias("source"), F.col("to_id").alias("target"), "kind").orderBy("source", "target", "kind")
    count = []
    with open(file, "w", encoding="utf-8") as f:
        f.write(f"""<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1 style="font-size:1em">{html.escape(title)}</h1><input id="q" placeholder="name"><select id="k"><option></option></select><canvas id="v"></canvas>\n<script>const d={{""")
        for name, rows in (("nodes", nodes), ("links", links)):
            f.write(f'"{name}":[')
            n = 0
            for r in rows.toLocalIterator():
                f.write(",\n" * bool(n) + json.dumps(r.asDict()).replace("</", "<\\/"))
                n += 1
            f.write("],")
            count.append(n)
        f.write(f"}};\n{_DRAW}</script>\n")
    return count[0], count[1]


# --- evaluation
THRESHOLDS = {"build_performance": 1.0, "search_quality": 0.5, "impact_accuracy": 0.6, "flow_completeness": 0.5, "token_efficiency": 0.2}


def hit_rate(ranked: DataFrame, golden: DataFrame, top: int = 10) -> DataFrame:
    """query, hit: whether an expected id (golden: query, id) is among the first ``top`` (ranked: query, id, rank from one)."""
    got = golden.join(ranked.where(F.col("rank") <= top).select("query", "id").withColumn("__hit", F.lit(True)).distinct(), ["query", "id"], "left")
    return got.groupBy("query").agg(F.bool_or(F.coalesce("__hit", F.lit(False))).alias("hit"))


def recall(found: DataFrame, known: DataFrame) -> DataFrame:
    """key, recall of known ids (key, id) among the found ones; 1 where nothing is known is left to the caller."""
    j = known.distinct().join(found.select("key", "id").distinct().withColumn("__f", F.lit(1)), ["key", "id"], "left")
    return j.groupBy("key").agg(F.avg(F.coalesce("__f", F.lit(0))).alias("recall"))


def eval_summary(results: DataFrame) -> DataFrame:
    """benchmark, runs, passed, avg_score for all five benchmarks, 0 for those that did not run."""
    kinds = results.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("benchmark"))
    agg = results.groupBy("benchmark").agg(F.count("*").alias("runs"), F.count_if("passed").alias("passed"), F.avg("score").alias("avg_score"))
    return kinds.join(agg, "benchmark", "left").select("benchmark", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "passed")], F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"))


def run_eval(graph_of: Callable[[], Graph], searches: dict[str, str], impacts: dict[str, list[str]], entries: list[str], source_tokens: int, bundle_file: str) -> list[dict]:
    """The five benchmarks over one graph: rows of benchmark, score, passed, seconds."""
    out = []

    def timed(name: str, fn: Callable[[], float]) -> None:
        t = time.time()
        score = fn()
        out.append({"benchmark": name, "score": float(score), "passed": bool(score >= THRESHOLDS[name]), "seconds": time.time() - t})

    t = time.time()
    graph = graph_of()
    graph.nodes.count()
    spent = time.time() - t
    out.append({"benchmark": "build_performance", "score": float(spent < 120), "passed": spent < 120, "seconds": spent})
    timed("search_quality", lambda: sum(any(want in (r.name or "") or want in (r.file_path or "") for r in search_like(graph.nodes, q, 10).collect()) for q, want in searches.items()) / len(searches) if searches else 1)

    def impact_score() -> float:
        if not impacts:
            return 1.0
        seeds = graph.nodes.where(F.col("id").isin(list(impacts))).select("id")
        reached = ops.impact(graph, seeds).select(F.col("seed").alias("key"), "id")
        known = graph.nodes.sparkSession.createDataFrame([(k, v) for k, vs in impacts.items() for v in vs], "key string, id string")
        return recall(reached, known).agg(F.avg("recall")).first()[0]

    timed("impact_accuracy", impact_score)
    timed("flow_completeness", lambda: len({r.name for r in ops.entry_points(graph, 30).collect()} & set(entries)) / len(entries) if entries else 1)
    timed("token_efficiency", lambda: max(0.0, 1 - bundle_sections(bundle_lines(graph, bundle_file)).agg(F.sum("tokens")).first()[0] / max(1, source_tokens)))
    return out


def eval_markdown(summary: DataFrame) -> str:
    rows = summary.orderBy("benchmark").collect()
    return "\n".join(["| Benchmark | Runs | Passed | Score |", "|---|---|---|---|", *[f"| {r.benchmark} | {r.runs} | {r.passed} | {r.avg_score:.3f} |" for r in rows]]) + "\n"


def eval_csv(results: list[dict]) -> str:
    """One line for each repository and benchmark."""
    out = io.StringIO()
    w = csv.DictWriter(out, ["repo", "benchmark", "score", "passed", "seconds"], lineterminator="\n")
    w.writeheader()
    w.writerows({k: f"{v:.3f}" if isinstance(v, float) else v for k, v in r.items()} for r in results)
    return out.getvalue()


def html_links(pages: DataFrame) -> DataFrame:
    """page_id, target: every href of a page, in order of appearance, repeats kept."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


def file_name(label: str) -> str:
    return re.sub(r"-+", "-", re.sub(r"[^a-zA-Z0-9_-]", "-", label)).lower()
