"""Graph questions: dependencies, impact, paths, cycles, orphans, layers, degrees and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.traverse import traverse
from lodegraph.schema import Graph
from lodegraph.storage import materialise

_SYMBOLS = ["function", "method", "class", "interface"]


def _one(graph: Graph, node_id: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == node_id).select("id")


def _ends(graph: Graph, node_id: str, kinds: list[str], of: str) -> DataFrame:
    """The existing nodes at the other end of a node's edges, with the edge's reason."""
    near, far = ("from_id", "to_id") if of == "out" else ("to_id", "from_id")
    e = graph.edges.where((F.col(near) == node_id) & F.col("kind").isin(kinds)).select(F.col(far).alias("id"), "reason")
    return e.join(graph.nodes, "id").select("id", "name", "kind", "file_path", "reason")


def callers(graph: Graph, node_id: str) -> DataFrame:
    return _ends(graph, node_id, ["calls"], "in")


def callees(graph: Graph, node_id: str) -> DataFrame:
    return _ends(graph, node_id, ["calls"], "out")


def deps_direct(graph: Graph, node_id: str) -> DataFrame:
    return _ends(graph, node_id, ["imports"], "out")


def deps_transitive(graph: Graph, node_id: str, depth: int = 3) -> DataFrame:
    """id, depth of all that is imported within ``depth`` steps, direct ones included; none for depth 1 or less."""
    got = traverse(graph, _one(graph, node_id), ["imports"], "out", depth)
    return got.where((F.col("depth") > 0) & F.lit(depth > 1)).select("id", "depth")


def impact(graph: Graph, seeds: DataFrame, max_depth: int = 10, with_path: bool = False) -> DataFrame:
    """seed, id, depth of all that imports or is reached by exports backwards, per seed; the seed itself is left out."""
    return traverse(graph, seeds.join(graph.nodes.select("id"), "id", "left_semi"), ["imports", "exports"], "in", max_depth, with_path).where("depth > 0 and id != seed")


def shortest_path(graph: Graph, source: str, target: str) -> DataFrame:
    """depth, path, edge_ids of a shortest directed path over all kinds: one row, or none."""
    got = traverse(graph, _one(graph, source), None, "out", None, True, stop=target)
    return got.where(F.col("id") == target).select("depth", "path", "edge_ids")


def call_chain(graph: Graph, node_id: str, max_depth: int = 5) -> DataFrame:
    """id, depth over calls; the bound is inclusive: depths 0 to max_depth."""
    return traverse(graph, _one(graph, node_id), ["calls"], "out", max_depth).select("id", "depth")


def cycle_members(graph: Graph, kinds=("imports",)) -> DataFrame:
    """id, cycle: nodes on a cycle, with the smallest id of their strongly connected component.

    Nodes without edges in or out are trimmed away until none is left to trim. What
    remains is coloured by the largest id that reaches it; within a colour, what
    reaches the colour's own node backwards is its component.
    """
    edges = materialise(graph.edges.where(F.col("kind").isin(list(kinds))).select(F.col("from_id").alias("u"), F.col("to_id").alias("v")).distinct(), "scc")
    found = None
    while True:
        while True:  # trim
            kept = materialise(edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"), "scc")
            same = kept.count() == edges.count()
            edges = kept
            if same:
                break
        if edges.isEmpty():
            break
        colour = materialise(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("c")), "scc")
        while True:  # the largest id spreads along the edges
            push = edges.join(colour.withColumnRenamed("id", "u"), "u").select(F.col("v").alias("id"), "c")
            nxt = materialise(colour.union(push).groupBy("id").agg(F.max("c").alias("c")), "scc")
            moved = not nxt.join(colour, ["id", "c"], "left_anti").isEmpty()
            colour = nxt
            if not moved:
                break
        inside = edges.join(colour.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").select("u", "v", F.col("cu").alias("c"))
        inside = materialise(inside, "scc")
        part = materialise(colour.where("id = c"), "scc")
        while True:  # backwards from each colour's own node
            more = materialise(inside.join(part.withColumnRenamed("id", "v"), ["v", "c"]).select(F.col("u").alias("id"), "c").union(part).distinct(), "scc")
            grown = more.count() > part.count()
            part = more
            if not grown:
                break
        loops = edges.where("u = v").select(F.col("u").alias("id"))
        sized = part.join(part.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("cycle")), "c")
        on = sized.where("n > 1").select("id", "cycle").union(sized.where("n = 1").join(loops, "id", "left_semi").select("id", "cycle"))
        found = materialise(on if found is None else found.union(on), "scc")
        done = part.select("id")
        edges = materialise(edges.join(done.withColumnRenamed("id", "u"), "u", "left_anti").join(done.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v"), "scc")
        if edges.isEmpty():
            break
    return found if found is not None else edges.select(F.col("u").alias("id"), F.col("v").alias("cycle"))


def cycle_paths(graph: Graph, kinds=("imports",), most_edges: int = 200_000) -> list[list[str]]:
    """Closed id lists, one per back edge of a depth-first search in order of name and id, on the cyclic part only.

    That part must fit the driver: it is refused beyond ``most_edges``; cycle_members() has no such bound.
    """
    members = cycle_members(graph, kinds).select("id")
    e = graph.edges.where(F.col("kind").isin(list(kinds))).select(F.col("from_id").alias("u"), F.col("to_id").alias("v")).distinct()
    e = e.join(members.withColumnRenamed("id", "u"), "u", "left_semi").join(members.withColumnRenamed("id", "v"), "v", "left_semi")
    rows = e.limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise ValueError("too many edges on cycles to list paths")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.u, r.v)):
        out.setdefault(r.u, []).append(r.v)
    found: list[list[str]] = []
    done: set[str] = set()
    for root in sorted(out):
        if root in done:
            continue
        trail, on, todo = [root], {root}, [iter(out.get(root, ()))]
        while todo:
            nxt = next(todo[-1], None)
            if nxt is None:
                todo.pop()
                gone = trail.pop()
                on.discard(gone)
                done.add(gone)
            elif nxt in on:
                found.append([*trail[trail.index(nxt) :], nxt])
            elif nxt not in done:
                trail.append(nxt)
                on.add(nxt)
                todo.append(iter(out.get(nxt, ())))
    return found


def orphans(graph: Graph) -> DataFrame:
    ends = graph.edges.select(F.col("from_id").alias("id")).union(graph.edges.select(F.col("to_id").alias("id")))
    return graph.nodes.where("not is_external").join(ends, "id", "left_anti")


def layer_of(path):
    """The directory after the first ``src``, else the directory that holds the file, else ``root``."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    at = F.array_position(parts, "src")
    after = F.when((at > 0) & (F.size(parts) > at), F.element_at(parts, (at + 1).cast("int")))
    parent = F.when(F.size(parts) > 1, F.nullif(F.element_at(parts, -2), F.lit("")))
    return F.coalesce(after, parent, F.lit("root"))


def layer_kinds(graph: Graph) -> DataFrame:
    """layer, kind, n: all nodes in the files of each layer."""
    files = graph.nodes.where("kind = 'file' and not is_external").select("file_path", layer_of(F.col("file_path")).alias("layer")).distinct()
    return graph.nodes.select("file_path", "kind").join(files, "file_path").groupBy("layer", "kind").agg(F.count("*").alias("n"))


def layers(graph: Graph) -> DataFrame:
    """layer, n_files, kinds (map), most files first."""
    files = graph.nodes.where("kind = 'file' and not is_external").groupBy(layer_of(F.col("file_path")).alias("layer")).agg(F.count("*").alias("n_files"))
    kinds = layer_kinds(graph).groupBy("layer").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    return files.join(kinds, "layer").orderBy(F.desc("n_files"), "layer")


def degrees(graph: Graph, kinds=None) -> DataFrame:
    """id, fan_in, fan_out, by one aggregation over the ends of the edges."""
    e = graph.edges if kinds is None else graph.edges.where(F.col("kind").isin(list(kinds)))
    ends = e.select(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("from_id", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def with_degrees(nodes: DataFrame, graph: Graph, kinds=None) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return nodes.join(degrees(graph, kinds), "id", "left").select(*nodes.columns, zero("fan_in"), zero("fan_out"))


def entry_points(graph: Graph, limit: int | None = 30) -> DataFrame:
    """Functions, methods and files that nothing calls, most callees first."""
    n = graph.nodes.where(F.col("kind").isin("function", "method", "file") & ~F.col("is_external")).select("id", "name", "kind", "file_path")
    out = with_degrees(n, graph, ["calls"]).where("fan_in = 0").select("id", "name", "kind", "file_path", "fan_out").orderBy(F.desc("fan_out"), "id")
    return out if limit is None else out.limit(limit)


def criticality(graph: Graph, limit: int | None = 20) -> DataFrame:
    """id, fan_in, fan_out, score = 3 in + out over calls and imports, label; highest first."""
    n = graph.nodes.where(F.col("kind").isin(_SYMBOLS) & ~F.col("is_external")).select("id", "name", "kind", "file_path")
    d = with_degrees(n, graph, ["calls", "imports"]).withColumn("score", F.col("fan_in") * 3 + F.col("fan_out"))
    label = F.when(F.col("score") >= 30, "critical").when(F.col("score") >= 15, "high").when(F.col("score") >= 5, "medium").otherwise("low")
    out = d.withColumn("label", label).orderBy(F.desc("score"), "id")
    return out if limit is None else out.limit(limit)


def large_functions(graph: Graph, limit: int | None = 20) -> DataFrame:
    """Functions and methods by complexity = in + 2 out over calls."""
    n = graph.nodes.where(F.col("kind").isin("function", "method")).select("id", "name", "kind", "file_path")
    out = with_degrees(n, graph, ["calls"]).withColumn("complexity", F.col("fan_in") + F.col("fan_out") * 2).orderBy(F.desc("complexity"), "id")
    return out if limit is None else out.limit(limit)


def suggestions(graph: Graph, limit: int | None = 10) -> DataFrame:
    """``extract`` where much goes out of a symbol, ``split`` where much comes into a file."""
    n = graph.nodes.where("not is_external and kind in ('function', 'method', 'class', 'file')").select("id", "name", "kind", "file_path")
    much = degrees(graph).where("fan_in >= 15 or fan_out >= 10")  # before any node is joined
    d = n.join(much, "id").withColumn("suggestion", F.when((F.col("kind") == "file") & (F.col("fan_in") >= 15), "split").when((F.col("kind") != "file") & (F.col("fan_out") >= 10), "extract"))
    out = d.where("suggestion is not null").orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id")
    return out if limit is None else out.limit(limit)


def is_test_path(path):
    """Whether a path lies in a test directory or has a test suffix."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    inside = [f"/{d}/" for d in ("test", "tests", "__tests__", "spec")]
    ends = [f".{a}.{b}" for a in ("test", "spec") for b in ("ts", "js")] + ["_test.go", "_test.py", "test.cs"]
    hit = F.lit(False)
    for d in inside:
        hit = hit | F.contains(p, F.lit(d))
    for s in ends:
        hit = hit | F.endswith(p, F.lit(s))
    return F.coalesce(hit, F.lit(False))


def dead_code(graph: Graph, limit: int | None = 30, ignore_kinds: tuple = ()) -> DataFrame:
    """Symbols without inbound edges (of kinds not ignored), outside test paths, by name."""
    used = graph.edges.where(~F.col("kind").isin(list(ignore_kinds))) if ignore_kinds else graph.edges
    n = graph.nodes.where(F.col("kind").isin([*_SYMBOLS, "type"]) & ~F.col("is_external"))
    n = n.where(~F.col("file_path").rlike(r"(?i)\.(test|spec)\.|/(test|__tests?__|spec)/"))
    # an id once, however many edges come into it
    out = n.join(used.select(F.col("to_id").alias("id")).distinct(), "id", "left_anti").select("id", "name", "kind", "file_path").orderBy("name", "id")
    return out if limit is None else out.limit(limit)


def rename_preview(graph: Graph, node_id: str) -> DataFrame:
    """edge_id, direction, kind, other_id, other_name: every edge of a node; a self-loop twice; names fall back to ids."""
    e = graph.edges
    both = e.where(F.col("from_id") == node_id).select(F.col("id").alias("edge_id"), F.lit("out").alias("direction"), "kind", F.col("to_id").alias("other_id")).unionAll(
        e.where(F.col("to_id") == node_id).select("id", F.lit("in"), "kind", F.col("from_id"))
    )
    named = graph.nodes.select(F.col("id").alias("other_id"), "name", "file_path")
    return both.join(named, "other_id", "left").select("edge_id", "direction", "kind", "other_id", F.coalesce("name", "other_id").alias("other_name"), "file_path")


def rename_edits(graph: Graph, node_id: str, new_name: str) -> DataFrame:
    """One edit for each file touched: where the node is defined with confidence 0.95, elsewhere 0.8."""
    own = graph.nodes.where(F.col("id") == node_id)
    line = F.coalesce(F.get_json_object("meta", "$.line"), F.get_json_object("meta", "$.line_start")).cast("int") if "meta" in graph.nodes.columns else F.lit(None).cast("int")
    home = own.select("file_path", F.col("name").alias("old_name"), F.lit(new_name).alias("new_name"), F.lit(0.95).alias("confidence"), line.alias("line"))
    others = rename_preview(graph, node_id).where("file_path is not null").select("file_path").distinct().join(own.select(F.col("file_path").alias("fp"), F.col("name").alias("old_name")), F.col("file_path") != F.col("fp"))
    return home.unionByName(others.select("file_path", "old_name", F.lit(new_name).alias("new_name"), F.lit(0.8).alias("confidence"), F.lit(None).cast("int").alias("line")))


def apply_rename(texts: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """``texts`` with whole-word occurrences of ``old`` replaced, and how many there were."""
    import re

    pattern = r"(?<![\w$])" + re.escape(old) + r"(?![\w$])"
    return texts.withColumn("n_replaced", F.regexp_count(column, F.lit(pattern))).withColumn("new_text", F.regexp_replace(column, pattern, new.replace("\\", "\\\\").replace("$", "\\$")))


def stats(graph: Graph, files: DataFrame | None = None) -> DataFrame:
    f = (graph.nodes.where("kind = 'file'") if files is None else files).agg(F.count("*").alias("files"))
    return graph.nodes.agg(F.count("*").alias("nodes")).join(graph.edges.agg(F.count("*").alias("edges")), F.lit(True)).join(f, F.lit(True))
