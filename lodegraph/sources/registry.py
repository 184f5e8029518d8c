"""A registry of repositories: a JSON array on disk, and search across their tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions.text import search_like

SCHEMA = "name string, path string, store string, registered_at string"


class Registry:
    """Entries by path; registering a path again replaces its entry."""

    def __init__(self, spark: SparkSession, file: str):
        self.spark, self.file = spark, file

    def _rows(self) -> list[dict]:
        if not os.path.exists(self.file):
            return []
        with open(self.file, encoding="utf-8") as f:
            return json.load(f)

    def _save(self, rows: list[dict]) -> None:
        with open(f"{self.file}.new", "w", encoding="utf-8") as f:
            json.dump(rows, f, indent=2)
        os.replace(f"{self.file}.new", self.file)

    def register(self, path: str, store: str, name: str | None = None, at: str = "") -> dict:
        row = {"name": name or os.path.basename(path.rstrip("/")), "path": path, "store": store, "registered_at": at}
        self._save([r for r in self._rows() if r["path"] != path] + [row])
        return row

    def unregister(self, name_or_path: str) -> bool:
        rows = self._rows()
        kept = [r for r in rows if name_or_path not in (r["name"], r["path"])]
        self._save(kept)
        return len(kept) < len(rows)

    def list(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(self.file, multiLine=True) if os.path.exists(self.file) else self.spark.createDataFrame([], SCHEMA)

    def search(self, query: str, per_repo: int = 10) -> DataFrame:
        """Hits in all repositories whose store can be read."""
        found = None
        for r in self._rows():
            if os.path.isdir(f"{r['store']}/nodes"):
                n = self.spark.read.parquet(f"{r['store']}/nodes").withColumn("repo", F.lit(r["name"]))
                found = n if found is None else found.unionByName(n, allowMissingColumns=True)
        return self.spark.createDataFrame([], "repo string, id string") if found is None else search_repos(found, query, per_repo)


def search_repos(nodes: DataFrame, query: str, per_repo: int = 10) -> DataFrame:
    """The first hits of each repository (column repo), by id."""
    hits = search_like(nodes, query, None)
    return hits.withColumn("__r", F.row_number().over(W.partitionBy("repo").orderBy("id"))).where(F.col("__r") <= per_repo).drop("__r")
