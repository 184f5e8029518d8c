"""Graph operators on small hand-made graphs and on random ones against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import components, graph as ops, store
from lodegraph.operators.traverse import traverse
from lodegraph.schema import Graph

N = "id string, kind string, name string, file_path string, description string, is_external boolean, language string, meta string"
E = "id string, from_id string, to_id string, kind string, reason string"


def make(spark, nodes, edges):
    rows = [(i, i.split(":")[0], i.split("/")[-1].split("#")[-1], i.split(":", 1)[1].split("#")[0], "", i.startswith("external_dep"), "typescript", '{"line": 3}') for i in nodes]
    return Graph(spark.createDataFrame(rows, N), spark.createDataFrame([(f"{a}|{k}|{b}", a, b, k, f"{k} it") for a, k, b in edges], E))


NODES = ["file:/root/a.ts", "file:/root/b.ts", "file:/root/c.ts", "file:/root/d.ts", "external_dep:lodash", "class:/root/a.ts#X", "class:/root/b.ts#Y"]
A, B, C, D, LODASH, X, Y = NODES
EDGES = [(A, "imports", B), (A, "imports", C), (B, "imports", C), (C, "imports", LODASH), (A, "exports", X), (X, "inherits", Y)]


@pytest.fixture(scope="module")
def g(spark):
    return make(spark, NODES, EDGES)


def ids(df, c="id"):
    return {r[c] for r in df.collect()}


def test_deps(g):
    assert ids(ops.deps_direct(g, A)) == {B, C}
    assert ids(ops.deps_transitive(g, A, 1)) == set()
    assert ids(ops.deps_transitive(g, A, 2)) == {B, C, LODASH}
    assert ids(ops.deps_transitive(g, "file:/none", 2)) == set()


def test_impact_and_paths(g, spark):
    of = lambda i: {(r.id, r.depth) for r in ops.impact(g, spark.createDataFrame([(i,)], "id string")).collect()}
    assert of(C) == {(A, 1), (B, 1)}
    assert of(B) == {(A, 1)}
    assert of(A) == set() and of("file:/none") == set()
    assert ops.shortest_path(g, A, C).first().path == [A, C]
    assert ops.shortest_path(g, A, A).first().depth == 0
    assert ops.shortest_path(g, D, A).count() == 0
    got = ops.shortest_path(g, A, Y).first()
    assert got.path == [A, X, Y] and got.edge_ids == [f"{A}|exports|{X}", f"{X}|inherits|{Y}"]


def test_cycles(g, spark):
    assert ops.cycle_members(g).count() == 0 and ops.cycle_paths(g) == []
    more = make(spark, NODES, [*EDGES, (C, "imports", A), (D, "imports", D)])
    assert {(r.id, r.cycle) for r in ops.cycle_members(more).collect()} == {(A, A), (B, A), (C, A), (D, D)}
    assert [A, B, C, A] in ops.cycle_paths(more) and [D, D] in ops.cycle_paths(more)


def test_orphans_layers_files(g):
    assert ids(ops.orphans(g)) == {D}
    assert ids(store.nodes_by_file(g, "/root/a.ts")) == {A, X}
    assert [(r.layer, r.n_files, r.kinds) for r in ops.layers(g).collect()] == [("root", 4, {"class": 2, "file": 4})]


def test_degrees(spark):
    f, h, t = "function:/p/a.py#f", "function:/p/a.py#h", "method:/p/test/b.py#t"
    g = make(spark, [f, h, t], [(f, "calls", h), (f, "calls", t), (h, "calls", t), (h, "calls", h)])
    assert [(r.id, r.fan_out) for r in ops.entry_points(g).collect()] == [(f, 2)]
    assert {(r.id, r.score, r.label) for r in ops.criticality(g).collect()} == {(f, 2, "low"), (h, 8, "medium"), (t, 6, "medium")}
    assert {r.id: r.complexity for r in ops.large_functions(g).collect()} == {f: 4, h: 6, t: 2}
    assert ids(ops.dead_code(g)) == {f}
    assert {(r.id, r.depth) for r in ops.call_chain(g, f).collect()} == {(f, 0), (h, 1), (t, 1)}
    assert ops.rename_preview(g, h).count() == 4  # the self-loop counts both ways
    edits = {(r.file_path, r.confidence, r.line) for r in ops.rename_edits(g, f, "new").collect()}
    assert edits == {("/p/a.py", 0.95, 3), ("/p/test/b.py", 0.8, None)}


def test_apply_rename_and_test_paths(spark):
    t = spark.createDataFrame([("foo foo1 $foo foo.bar",)], "text string")
    assert ops.apply_rename(t, "text", "foo", "$x").first().new_text == "$x foo1 $foo $x.bar"
    p = spark.createDataFrame([("/a/__tests__/x.ts",), ("C:\\a\\TEST\\x.ts",), ("/a/x.spec.js",), ("/a/x_test.go",), ("/attest/x.ts",)], "p string")
    assert [r.t for r in p.select(ops.is_test_path(F.col("p")).alias("t")).collect()] == [True, True, True, True, False]


def test_store(spark, tmp_path):
    from lodegraph import schema

    s = store.Store(spark, str(tmp_path))
    assert s.load("nodes", schema.NODES).count() == 0
    rows = spark.createDataFrame([("a", "imports", 1), ("b", "exports", 1)], "id string, reason string, updated_at long")
    s.save("edges", rows)
    more = spark.createDataFrame([("a", "new", 2), ("c", "x", 2), ("c", "y", 3)], rows.schema)
    s.save("edges", store.upsert_edges(s.load("edges"), more, ["updated_at"]))
    assert {tuple(r) for r in s.load("edges").collect()} == {("a", "new", 2), ("b", "exports", 1), ("c", "y", 3)}


def test_delete_file(g, spark):
    got, _ = store.delete_files(g, spark.createDataFrame([("/root/a.ts",)], "file_path string"))
    assert ids(got.nodes) == {B, C, D, LODASH, Y}
    assert ids(got.edges) == {f"{B}|imports|{C}", f"{C}|imports|{LODASH}"}  # incoming edges would stay


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = [f"file:/n{i}" for i in range(25)]
    edges = sorted({(rng.choice(nodes), "imports", rng.choice([*nodes, "file:/gone"])) for _ in range(45)})
    g = make(spark, nodes, edges)
    out = {}
    for a, _, b in edges:
        out.setdefault(a, set()).add(b)
    want = {}
    for s in nodes[:5]:
        seen, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v in out.get(u, ()):
                if v not in seen and v in nodes:
                    seen[v] = seen[u] + 1
                    todo.append(v)
        want |= {(s, v): d for v, d in seen.items()}
    got = traverse(g, spark.createDataFrame([(s,) for s in nodes[:5]], "id string"), ["imports"])
    assert {(r.seed, r.id): r.depth for r in got.collect()} == want
    reach = {u: {u} for u in [*nodes, "file:/gone"]}
    for _ in range(30):
        for a, _, b in edges:
            reach[a] |= reach[b]
    on = {u for a, _, b in edges for u in [a] if a in reach[b]}
    assert ids(ops.cycle_members(g)) == on
    parent = {u: u for u in reach}

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for a, _, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    touched = {u for a, _, b in edges for u in (a, b)}
    got = components.connected_components(g.edges, "from_id", "to_id")
    assert {r.id: r.component for r in got.collect()} == {u: find(u) for u in touched}


def test_levels_are_measured(spark):
    """A level goes to the edges by its bytes, not by its compressed file."""
    from lodegraph.storage import materialise, measured

    t = materialise(spark.range(3000).selectExpr("repeat('a', 100) || id as seed", "repeat('b', 100) as id"))
    hinted = lambda limit: "broadcast" in measured(t, limit)[0]._jdf.queryExecution().logical().toString().lower()
    assert measured(t)[1] == 3000 and hinted(1 << 20) and not hinted(500_000)


def test_ids_are_collapsed_before_joins(spark, g):
    """dead_code joins an id once, however many edges come into it; suggestions joins no node that has few edges."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan(ops.dead_code(g))
    assert "LeftOuter" not in plan(ops.suggestions(g))
    hub = make(spark, [A, X, Y, *[f"file:/f{i}" for i in range(16)]], [*[(f"file:/f{i}", "imports", A) for i in range(15)], *[(X, "calls", f"file:/f{i}") for i in range(10)], *[(Y, "calls", f"file:/f{i}") for i in range(9)]])
    assert {(r.id, r.suggestion, r.fan_in, r.fan_out) for r in ops.suggestions(hub).collect()} == {(A, "split", 15, 0), (X, "extract", 0, 10)}
    assert ids(ops.dead_code(hub)) == {X, Y}


def test_components_end_when_all_are_stars(spark, monkeypatch):
    """No round is spent on seeing that nothing moves; chains, rings and stars that share leaves come out right."""
    rounds = []
    star = components._star
    monkeypatch.setattr(components, "_star", lambda e, large: (rounds.append(large), star(e, large))[1])
    of = lambda rows: {r.id: r.component for r in components.connected_components(spark.createDataFrame(rows, "src int, dst int")).collect()}
    assert of([(1, i) for i in range(2, 9)]) == dict.fromkeys(range(1, 9), 1) and rounds == [True, False]
    assert of([(1, 10), (2, 10), (2, 11), (3, 11)]) == dict.fromkeys((1, 2, 3, 10, 11), 1)
    assert of([*[(i, i + 1) for i in range(40)], (50, 51), (51, 52), (52, 50), (60, 60)]) == {**dict.fromkeys(range(41), 0), **dict.fromkeys((50, 51, 52), 50), 60: 60}
