"""Risk of changes: factors of a file's score, multi-source impact of all changes at once, review context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import token_estimate
from lodegraph.operators.graph import is_test_path
from lodegraph.operators.traverse import traverse
from lodegraph.schema import Graph

#: Substrings that make a text security relevant; the one that counts twice does so in the scores to match.
KEYWORDS = sorted(
    """abac acl admin aes apikey api_key argon auth authenticate authorization bcrypt capabilities certificate command config cookie cors credentials crypto csrf
    decrypt encrypt env .env eval exec execute hash header hmac inject injection input jwt login logout md5 oauth passwd password pbkdf permission permissions policy
    popen private_key privilege public_key query rbac redirect referer request response role root rsa saml sanitize secret session settings sha shell sign signature spawn
    sql subprocess superuser token validate xss""".split()
)
WEIGHTS = {"secret": 2}
EXTENSIONS = {15: "env pem key pfx p12", 10: "yml yaml", 8: "json toml ini cfg conf", 5: "ts js py cs java go"}
NAMES = "auth|login|password|credential|token|secret|config|settings|env|security|permission|middleware"


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def keyword_hits(text: Column) -> Column:
    """Keywords that a lower-cased text contains, by weight; one pass of literal searches, no join."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(k)), WEIGHTS.get(k, 1)).otherwise(0) for k in KEYWORDS])


def band(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low")


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def extension(path: Column) -> Column:
    """The last suffix of the base name with its dot; a leading dot alone makes none."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def score_columns(path: Column, blast: Column, lines: Column, has_tests: Column, content: Column) -> dict[str, Column]:
    base, ext = basename(path), extension(path)
    risky = base.rlike(NAMES)
    kind = F.lit(2)
    for points, names in EXTENSIONS.items():
        kind = F.when(ext.isin(["." + n for n in names.split()]), points).otherwise(kind)
    out = {
        "blast_score": F.least(F.lit(30), _half_up(blast / 50 * 30)),
        "keyword_score": F.least(F.lit(25), keyword_hits(F.lower(F.concat_ws(" ", F.coalesce(content, F.lit("")), path))) * 5),
        "type_score": F.when(risky, F.least(F.lit(15), kind + 7)).otherwise(kind),
        "size_score": F.least(F.lit(15), _half_up(lines / 500 * 15)),
        "test_score": F.when(has_tests, 0).otherwise(15),
    }
    out["score"] = F.least(F.lit(100), reduce(lambda a, b: a + b, out.values()))
    out["security_relevant"] = (out["keyword_score"] >= 10) | risky
    return out


def score_files(files: DataFrame) -> DataFrame:
    """file_path, blast, lines, has_tests, content -> the five factors, score, band, security_relevant."""
    s = score_columns(*[F.col(c) for c in ("file_path", "blast", "lines", "has_tests", "content")])
    return files.select("file_path", *[c.alias(k) for k, c in s.items()]).withColumn("band", band(F.col("score")))


def tested_files(graph: Graph, paths: DataFrame) -> DataFrame:
    """file_path, test_path: test files with an edge of any kind into a node of each file."""
    inside = graph.nodes.select(F.col("id").alias("to_id"), "file_path").join(paths.select("file_path").distinct(), "file_path", "left_semi")
    tests = graph.nodes.where(is_test_path(F.col("file_path"))).select(F.col("id").alias("from_id"), F.col("file_path").alias("test_path"))
    return graph.edges.select("from_id", "to_id").join(inside, "to_id").join(tests, "from_id").select("file_path", "test_path").distinct()


def analyze_changes(graph: Graph, changes: DataFrame, contents: DataFrame | None = None, max_depth: int = 10) -> DataFrame:
    """One row per change: nodes, blast, factors, score; one traversal serves all changed files together.

    ``contents``: file_path, content of files as they are now; deleted files are scored by path alone.
    """
    paths = changes.select("file_path").distinct()
    inside = graph.nodes.select("id", "file_path").join(paths, "file_path", "left_semi")
    reached = traverse(graph, inside.select("id"), ["imports", "exports"], "in", max_depth).where("depth > 0 and id != seed")
    home = inside.select(F.col("id").alias("seed"), F.col("file_path").alias("changed"))
    far = reached.join(home, "seed").join(graph.nodes.select("id", F.col("file_path").alias("hit")), "id").where("hit != changed")
    blast = far.groupBy(F.col("changed").alias("file_path")).agg(F.countDistinct("hit").alias("blast"))
    nodes = inside.groupBy("file_path").agg(F.count("*").alias("nodes_affected"))
    tests = tested_files(graph, paths).select("file_path").distinct().withColumn("has_tests", F.lit(True))
    rows = changes.join(blast, "file_path", "left").join(nodes, "file_path", "left").join(tests, "file_path", "left")
    if contents is None:
        rows = rows.withColumn("content", F.lit(None).cast("string"))
    else:
        rows = rows.join(contents.select("file_path", "content"), "file_path", "left").withColumn("content", F.when(F.col("status") != "deleted", F.col("content")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    rows = rows.withColumns({"blast": zero("blast"), "nodes_affected": zero("nodes_affected"), "has_tests": F.coalesce("has_tests", F.lit(False)), "lines": (F.col("lines_added") + F.col("lines_removed")).cast("bigint")})
    s = score_columns(*[F.col(c) for c in ("file_path", "blast", "lines", "has_tests", "content")])
    return rows.select("file_path", "status", "lines", "nodes_affected", "blast", "has_tests", *[c.alias(k) for k, c in s.items()]).withColumn("band", band(F.col("score"))).orderBy(F.desc("score"), "file_path")


def summary(changes: DataFrame) -> DataFrame:
    """added, modified, deleted, renamed, total_lines: one row."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return changes.agg(*map(n, ("added", "modified", "deleted", "renamed")), F.coalesce(F.sum(F.col("lines_added") + F.col("lines_removed")), F.lit(0)).cast("bigint").alias("total_lines"))


def overall(details: DataFrame) -> DataFrame:
    """The band of the highest score; low for no changes."""
    return details.agg(F.coalesce(band(F.max("score")), F.lit("low")).alias("overall"))


def blast_files(graph: Graph, changes: DataFrame) -> DataFrame:
    """file_path of files one edge of any kind into a changed file, changed ones left out."""
    paths = changes.select("file_path").distinct()
    inside = graph.nodes.join(paths, "file_path", "left_semi").select(F.col("id").alias("to_id"))
    near = graph.edges.join(inside, "to_id", "left_semi").select(F.col("from_id").alias("id"))
    return graph.nodes.join(near, "id", "left_semi").select("file_path").distinct().join(paths, "file_path", "left_anti").orderBy("file_path")


def review_tests(graph: Graph, changes: DataFrame) -> DataFrame:
    paths = changes.select("file_path").distinct()
    return tested_files(graph, paths).select(F.col("test_path").alias("file_path")).distinct().join(paths, "file_path", "left_anti").orderBy("file_path")


def focus_areas(details: DataFrame, limit: int = 5) -> DataFrame:
    return details.where("score >= 25").orderBy(F.desc("score"), "file_path").limit(limit).select("file_path", "score")


def review_context(graph: Graph, changes: DataFrame, contents: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of a review: details, summary, overall, affected, tests, focus, tokens."""
    details = analyze_changes(graph, changes, contents)
    affected, tests = blast_files(graph, changes), review_tests(graph, changes)
    every = changes.select("file_path").unionAll(affected).unionAll(tests)
    tokens = every.agg(F.coalesce(F.sum(F.length("file_path") + 1) - 1, F.lit(0)).alias("n")).select(F.ceil(F.col("n") / 4).cast("bigint").alias("tokens"))
    return {"details": details, "summary": summary(changes), "overall": overall(details), "affected": affected, "tests": tests, "focus": focus_areas(details), "tokens": tokens}


def format_review(context: dict[str, DataFrame], base: str = "HEAD~1", most: int = 50) -> str:
    """The review as Markdown; lists longer than ``most`` say how many more there are."""
    s, o = context["summary"].first(), context["overall"].first()
    out = [f"# Review of {base}..HEAD", "", f"Overall risk: **{o.overall}**. {s.added} added, {s.modified} modified, {s.deleted} deleted, {s.renamed} renamed; {s.total_lines} lines.", ""]
    for title, key in (("Focus", "focus"), ("Changed files", "details"), ("Affected files", "affected"), ("Relevant tests", "tests")):
        rows = context[key].limit(most + 1).collect()
        out += [f"## {title}", ""]
        for r in rows[:most]:
            d = r.asDict()
            note = f" - score {d['score']} ({d['band']}), {d['blast']} files reached" if "blast" in d else f" - score {d['score']}" if "score" in d else ""
            out.append(f"- `{d['file_path']}`{note}")
        out += ["- and more" if len(rows) > most else "", ""] if rows else ["none", ""]
    return "\n".join([*out, f"About {context['tokens'].first().tokens} tokens."])
