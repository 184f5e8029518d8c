"""Retrieval, risk, communities, version-control text."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import text, vectors
from lodegraph.operators import community as com
from lodegraph.operators import risk
from lodegraph.schema import Graph
from lodegraph.sources import gitdiff
from lodegraph.sources.registry import Registry

N = "id string, kind string, name string, file_path string, description string, is_external boolean, language string"


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(
        [
            ("1", "class", "TokenParser", "/a/token_parser.ts", "parses files", False, "typescript"), ("2", "function", "parse_files", "/a/run.py", "", False, "python"),
            ("3", "file", "b.py", "/b.py", "files to parse", False, None), ("4", "external_dep", "parse", "parse", "", True, None),
        ], N,
    )


def test_like(nodes):
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(text.search_like(nodes, "PARSE")) == ["1", "2", "3", "4"]
    assert ids(text.search_like(nodes, "n_p")) == ["1", "2"]  # token_parser and run.py
    assert ids(text.search_like(nodes, "e_f")) == ["2"] and ids(text.search_like(nodes, "s_f")) == ["1"]
    assert ids(text.search_like(nodes, "s_f", literal=True)) == []


def test_full_text(nodes):
    assert {r.id for r in text.fts_prefix(nodes, "files par").collect()} == {"1", "2", "3"}
    assert text.fts_prefix(nodes, "b.py").count() == 0 and text.bm25(nodes, "a-b").count() == 0
    got = {r.id: r.score for r in text.bm25(nodes, "files").collect()}
    docs = {"1": "tokenparser parses files a token parser ts", "2": "parse files a run py", "3": "b py files to parse b py", "4": "parse parse"}
    lens = {k: len(v.split()) for k, v in docs.items()}
    avg, n = sum(lens.values()) / 4, 3
    idf = math.log((4 - n + 0.5) / (n + 0.5))
    idf = idf if idf > 0 else 1e-6
    assert got == pytest.approx({k: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lens[k] / avg)) for k in "123"})


def test_tfidf_and_hybrid(nodes, spark):
    index = text.tfidf_index(nodes)
    assert {r.id for r in text.tfidf_search(nodes, "parse", index=index).collect()} == {"2", "3"}
    assert text.tfidf_search(nodes, "zzz", index=index).count() == 0
    assert [r.id for r in text.tfidf_similar(nodes, "2", index=index).collect()][0] == "3"
    assert text.tfidf_similar(nodes, "4", index=index).count() == 0
    v = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0]), ("3", [1.0, 1.0])], "node_id string, vector array<float>")
    got = text.hybrid_search(nodes, "parse", v, index=index).collect()
    assert {r.id for r in got} == {"1", "2", "3", "4"}
    boosted = text.hybrid_search(nodes, "parse", None, context_files=["/b.py"], index=index).collect()
    assert boosted[0].id == "3"


def test_vectors(nodes, spark):
    v = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", [4.0, 3.0, 9.0])], "node_id string, vector array<float>")
    assert {r.node_id: round(r.score, 6) for r in vectors.cosine_top(v, [3.0, 4.0]).collect()} == {"a": 1.0, "c": 0.96}
    first = vectors.embed(nodes, spark.createDataFrame([], "node_id string, vector array<float>, text_hash string, provider string"))
    assert first.count() == 3 and vectors.embed(nodes, first).count() == 0
    assert vectors.embed(nodes, first.withColumn("provider", F.lit("other"))).count() == 3


CHANGES = "file_path string, status string, old_path string, lines_added int, lines_removed int"


def test_changes(spark):
    paths = ["src/auth.ts", "src/crypto.ts", "src/utils.ts", "src/config.ts", "src/unused.ts", "test/auth.test.ts"]
    nodes = spark.createDataFrame([(f"file:/proj/{p}", "file", p, f"/proj/{p}", "", False, "typescript") for p in paths], N)
    e = [("src/auth.ts", "src/crypto.ts"), ("src/crypto.ts", "src/utils.ts"), ("test/auth.test.ts", "src/auth.ts")]
    g = Graph(nodes, spark.createDataFrame([(f"{a}{b}", f"file:/proj/{a}", f"file:/proj/{b}", "imports", "") for a, b in e], "id string, from_id string, to_id string, kind string, reason string"))
    ch = spark.createDataFrame([("/proj/src/auth.ts", "modified", None, 10, 2), ("/proj/src/crypto.ts", "added", None, 30, 0), ("/proj/src/unused.ts", "deleted", None, 0, 5)], CHANGES)
    c = risk.review_context(g, ch)
    got = [(r.file_path[10:], r.blast, r.blast_score, r.keyword_score, r.type_score, r.size_score, r.test_score, r.score) for r in c["details"].collect()]
    assert got == [("crypto.ts", 2, 1, 5, 5, 1, 15, 27), ("unused.ts", 0, 0, 0, 5, 0, 15, 20), ("auth.ts", 1, 1, 5, 12, 0, 0, 18)]
    assert tuple(c["summary"].first()) == (1, 1, 1, 0, 47) and c["overall"].first()[0] == "medium"
    assert [r[0] for r in c["affected"].collect()] == [r[0] for r in c["tests"].collect()] == ["/proj/test/auth.test.ts"]
    assert [r.file_path for r in c["focus"].collect()] == ["/proj/src/crypto.ts"]
    assert "Overall risk: **medium**" in risk.format_review(c)
    none = risk.review_context(g, ch.where("false"))
    assert none["details"].count() == 0 and none["overall"].first()[0] == "low" and tuple(none["summary"].first()) == (0,) * 5


def test_risk_parts(spark):
    p = spark.createDataFrame([("/a/.env",), ("/a/x.env",), ("/a/My.TOKEN.PEM",), ("/a/b",)], "p string")
    assert [r.e for r in p.select(risk.extension(F.col("p")).alias("e")).collect()] == ["", ".env", ".pem", ""]
    f = spark.createDataFrame([("/a/x.md", 50, 250, True, "secret")], "file_path string, blast int, lines int, has_tests boolean, content string")
    r = risk.score_files(f).first()
    assert (r.blast_score, r.keyword_score, r.type_score, r.size_score, r.test_score) == (30, 10, 2, 8, 0)


def test_git(spark):
    lines = spark.createDataFrame([("R090\ta.ts\tb.ts",), ("bad",)], "line string")
    assert [tuple(r) for r in gitdiff.parse_name_status(lines).collect()] == [("b.ts", "renamed", "a.ts")]


def test_communities(spark):
    ids = [f"function:/x/{c}.py#{c}{i}" for c in "ab" for i in range(4)]
    nodes = spark.createDataFrame([(i, "function", i[-2:], i.split(":")[1].split("#")[0], "", False, "python") for i in ids], N)
    e = [(u, v) for c in (ids[:4], ids[4:]) for u in c for v in c if u < v] + [(ids[0], ids[4])]
    g = Graph(nodes, spark.createDataFrame([(u + v, u, v, "calls", "") for u, v in e], "id string, from_id string, to_id string, kind string, reason string"))
    m = com.detect(g)
    groups = {}
    for r in m.collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [ids[:4], ids[4:]]
    assert {(r.internal, r.external) for r in com.cohesion(g, m).collect()} == {(6, 1)}
    assert com.coupling(g, m).first().edges == 1
    table, placed = com.persist(g, m)
    assert table.count() == 2 and placed.where("community_id is null").count() == 0
    assert com.health(7, 0, 0, 1, 10) == (50, ["5 circular dependencies"])
    assert {r.label for r in com.file_labels(spark.createDataFrame([("1", "/a/b/c.ts"), ("2", "/a/b/c.ts"), ("2", "/a/b/d.ts"), ("3", "x/a"), ("3", "y/a")], "component string, file_path string")).collect()} == {"c.ts", "b", "cluster-2-files"}


def test_moves_settle(spark):
    """No node of any parent gains by a move, against plain sums; too few rounds are an error."""
    rng = random.Random(1)
    pairs = sorted({(q, *sorted((f"{q}{a:03}", f"{q}{b:03}"))) for q in "pq" for a, b in (rng.sample(range(90), 2) for _ in range(200))})
    df = spark.createDataFrame([(q, u, v, 1.0) for q, u, v in pairs], "parent string, u string, v string, w double")
    label = {r.id: r.community for r in com.local_moves(df, settle=True).collect()}
    near, total, s = {}, {"p": 0, "q": 0}, {}
    for q, u, v in pairs:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
        total[q] += 2
    for u, n in near.items():
        s[label[u]] = s.get(label[u], 0) + len(n)
    assert set(label) == set(near) and all(c[0] == u[0] for u, c in label.items())
    for u, n in near.items():
        gain = lambda c, u=u, n=n: sum(label[v] == c for v in n) - len(n) * (s[c] - len(n) * (c == label[u])) / total[u[0]]
        assert all(gain(label[v]) <= gain(label[u]) + 1e-6 for v in n)
    with pytest.raises(RuntimeError):
        com.local_moves(df, 2, settle=True)


def test_registry(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "r.json"))
    r.register("/repo/a", str(tmp_path / "a"))
    r.register("/repo/a", str(tmp_path / "a"), "again")
    r.register("/repo/b", str(tmp_path / "missing"))
    spark.createDataFrame([(str(i), "file", "bolt", "/b", "", False, None) for i in range(5)], N).write.parquet(str(tmp_path / "a/nodes"))
    assert {x.name for x in r.list().collect()} == {"again", "b"}
    assert r.search("bolt", 3).count() == 3
    assert r.unregister("again") and not r.unregister("again")


def test_cohesion_of_ends_that_are_no_members(spark):
    """Null communities, ends without one, self-loops and parallel edges, against plain Python."""
    of = {"a": "x", "b": "x", "c": "y", "d": None}
    edges = [("a", "b"), ("a", "b"), ("a", "c"), ("a", "a"), ("b", "gone"), ("gone", "c"), ("d", "d"), ("d", "a"), ("gone", "gone")]
    e = spark.createDataFrame([(str(i), *x, "calls", "") for i, x in enumerate(edges)], "id string, from_id string, to_id string, kind string, reason string")
    members = spark.createDataFrame(list(of.items()), "id string, community string")
    want = {}
    for a, b in [*edges, *[(b, a) for a, b in edges]]:
        if a in of:
            same = of[a] is not None and of[a] == of.get(b)
            want.setdefault(of[a], [0, 0])[not same] += 1
    got = {r.community: (r.internal, r.external) for r in com.cohesion(Graph(members, e), members).collect()}
    assert got == {k: (i // 2, x) if k else (0, 0) for k, (i, x) in want.items()}
    assert [(r.a, r.b, r.edges) for r in com.coupling(Graph(members, e), members).collect()] == [("x", "y", 1)]


def test_moves_end_only_when_no_node_gains(spark):
    """Without being asked to settle; a hub that many want to join at once does not end the moves either."""
    rng = random.Random(3)
    pairs = sorted({tuple(sorted((f"{a:03}", f"{b:03}"))) for a, b in (rng.sample(range(120), 2) for _ in range(260))} | {(f"{i:03}", "hub") for i in range(0, 120, 2)})
    label = {r.id: r.community for r in com.local_moves(spark.createDataFrame([(u, v, 1.0) for u, v in pairs], "u string, v string, w double")).collect()}
    near, s = {}, {}
    for u, v in pairs:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    for u, n in near.items():
        s[label[u]] = s.get(label[u], 0) + len(n)
    for u, n in near.items():
        gain = lambda c, u=u, n=n: sum(label[v] == c for v in n) - len(n) * (s[c] - len(n) * (c == label[u])) / (2 * len(pairs))
        assert all(gain(label[v]) <= gain(label[u]) + 1e-6 for v in n)
