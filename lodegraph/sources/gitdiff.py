"""Changes out of version control: two text outputs parsed and joined."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.schema import CHANGES


def _run(root: str, *args: str) -> str:
    got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
    return got.stdout if got.returncode == 0 else ""


def is_repo(root: str) -> bool:
    return _run(root, "rev-parse", "--is-inside-work-tree").strip() == "true"


def repo_root(root: str) -> str:
    return _run(root, "rev-parse", "--show-toplevel").strip()


def default_branch(root: str) -> str:
    head = _run(root, "symbolic-ref", "--short", "refs/remotes/origin/HEAD").strip()
    return head.rsplit("/", 1)[-1] if head else "main"


def new_name(path):
    """a/{x => y}.ts and x => y both name what the file is called now."""
    braces = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(braces, r"^.* => ", ""), "/{2,}", "/")


def parse_numstat(lines: DataFrame) -> DataFrame:
    """file_path, lines_added, lines_removed from a column ``line``; binary files count no lines."""
    p = F.split("line", "\t")
    n = lambda i: F.coalesce(F.expr(f"try_cast(split(line, '\\t')[{i}] as int)"), F.lit(0))
    return lines.where(F.size(p) >= 3).select(new_name(F.element_at(p, 3)).alias("file_path"), n(0).alias("lines_added"), n(1).alias("lines_removed"))


def parse_name_status(lines: DataFrame) -> DataFrame:
    """file_path, status, old_path from a column ``line``."""
    p = F.split("line", "\t")
    code = F.substring(p[0], 1, 1)
    status = F.when(code == "A", "added").when(code == "D", "deleted").when(code == "R", "renamed").otherwise("modified")
    moved = (code == "R") & (F.size(p) >= 3)
    return lines.where(F.size(p) >= 2).select(F.when(moved, F.get(p, 2)).otherwise(p[1]).alias("file_path"), status.alias("status"), F.when(moved, p[1]).alias("old_path"))


def changes(name_status: DataFrame, numstat: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """Changes with their lines (0 where none are given); staged ones only where the path is not there yet."""
    lines = numstat.groupBy("file_path").agg(F.max("lines_added").alias("lines_added"), F.max("lines_removed").alias("lines_removed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    out = name_status.join(lines, "file_path", "left").select("file_path", "status", "old_path", zero("lines_added"), zero("lines_removed"))
    if staged is not None:
        out = out.unionByName(staged.select(*out.columns).join(out.select("file_path"), "file_path", "left_anti").select(*out.columns))
    return out


def read_changes(spark: SparkSession, root: str, base: str = "HEAD~1") -> DataFrame:
    """The changes of a working copy against ``base``, staged ones included for HEAD and HEAD~1."""
    lines = lambda text: spark.createDataFrame([(x,) for x in text.splitlines() if x], "line string")

    def pair(*args: str) -> DataFrame:
        return changes(parse_name_status(lines(_run(root, "diff", "--name-status", *args))), parse_numstat(lines(_run(root, "diff", "--numstat", *args))))

    staged = pair("--cached") if base in ("HEAD", "HEAD~1") else None
    first = pair(base, "HEAD")
    if staged is not None:
        first = first.unionByName(staged.join(first.select("file_path"), "file_path", "left_anti").select(*first.columns))
    at = F.lit(root.rstrip("/") + "/")
    return spark.createDataFrame(first.withColumn("file_path", F.concat(at, "file_path")).collect(), CHANGES) if first.isEmpty() else first.withColumn("file_path", F.concat(at, "file_path"))
