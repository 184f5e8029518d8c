"""One object per stored graph: every question under one name, for programs and for the command line."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.functions import text, vectors
from lodegraph.operators import community, graph as ops, risk, store as st
from lodegraph.plans import reports
from lodegraph.sources import files, gitdiff
from lodegraph.streaming import watch
from lodegraph.storage import materialise, own_session

PREVIEW_SECONDS = 600
PATHS_AT_ONCE = 10_000


class Engine:
    """Questions to the store at ``path`` about the source tree at ``root``."""

    def __init__(self, spark: SparkSession, path: str, root: str | None = None):
        self.spark = own_session(spark)
        self.store, self.root = st.Store(self.spark, path), root

    @property
    def graph(self) -> schema.Graph:
        return self.store.graph()

    def node_id(self, target: str) -> str:
        """A node id as it is; anything else is a path below the root."""
        if ":" in target.split("/", 1)[0]:
            return target
        return "file:" + os.path.abspath(os.path.join(self.root or ".", target))

    def _ids(self, target: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(self.node_id(target)).alias("id"))

    # --- building ---
    def build(self, force: bool = False, calls: bool = False) -> dict:
        return files.build(self.spark, self.root, self.store.path, int(time.time() * 1000), force, calls)

    def remove_file(self, file_path: str) -> None:
        files.remove_file(self.spark, self.store.path, file_path)

    def watch(self, every: float = 2.0, rounds: int | None = None) -> int:
        """Keep the store up to date with the tree; see streaming.watch for change files as a stream."""
        return watch.watch_tree(self.spark, self.root, self.store.path, None, every, rounds)

    # --- lookups ---
    def file(self, target: str) -> DataFrame:
        return st.file(self.store.load("files", schema.FILES), self.node_id(target).split(":", 1)[1])

    def embedding(self, target: str, provider: str | None = None) -> DataFrame:
        return st.embedding(self.store.load("embeddings", schema.EMBEDDINGS), self.node_id(target), provider)

    def embedding_count(self) -> DataFrame:
        return st.embedding_count(self.store.load("embeddings", schema.EMBEDDINGS))

    def delete_embedding(self, target: str) -> None:
        left = materialise(st.delete_embeddings(self.store.load("embeddings", schema.EMBEDDINGS), self._ids(target)), "embeddings")
        self.store.save("embeddings", left)

    def stored_communities(self, level: int | None = None) -> DataFrame:
        return st.communities(self.store.load("communities", schema.COMMUNITIES), level)

    def community_members(self, community_id: int) -> DataFrame:
        return st.community_members(self.graph, community_id)

    # --- graph ---
    def stats(self) -> dict:
        g = self.graph
        row = ops.stats(g, self.store.load("files", schema.FILES)).first().asDict()
        return row | {"by_kind": {r.kind: r["count"] for r in g.nodes.groupBy("kind").count().collect()}, "cycles": ops.cycle_members(g).select("cycle").distinct().count(), "orphans": ops.orphans(g).count()}

    def deps(self, target: str, depth: int = 3) -> dict[str, DataFrame]:
        i = self.node_id(target)
        return {"direct": ops.deps_direct(self.graph, i), "transitive": ops.deps_transitive(self.graph, i, depth)}

    def callers(self, target: str) -> DataFrame:
        return ops.callers(self.graph, self.node_id(target))

    def callees(self, target: str) -> DataFrame:
        return ops.callees(self.graph, self.node_id(target))

    def impact(self, target: str, max_depth: int = 10) -> DataFrame:
        g = self.graph
        return ops.impact(g, self._ids(target), max_depth, True).select("id", "depth", "path").join(g.nodes.select("id", "name", "kind", "file_path"), "id").orderBy("depth", "id")

    def shortest_path(self, source: str, target: str) -> DataFrame:
        return ops.shortest_path(self.graph, self.node_id(source), self.node_id(target))

    def call_chain(self, target: str, max_depth: int = 5) -> DataFrame:
        return ops.call_chain(self.graph, self.node_id(target), max_depth)

    def cycles(self) -> list[list[str]]:
        return ops.cycle_paths(self.graph)

    def orphans(self) -> DataFrame:
        return ops.orphans(self.graph).orderBy("name", "id")

    def layers(self) -> DataFrame:
        return ops.layers(self.graph)

    def entry_points(self, limit: int = 30) -> DataFrame:
        return ops.entry_points(self.graph, limit)

    def criticality(self, limit: int = 20) -> DataFrame:
        return ops.criticality(self.graph, limit)

    critical_nodes = criticality

    def large_functions(self, limit: int = 20) -> DataFrame:
        return ops.large_functions(self.graph, limit)

    # --- refactoring ---
    def dead_code(self, limit: int = 30, ignore_kinds: tuple = ()) -> DataFrame:
        return ops.dead_code(self.graph, limit, ignore_kinds)

    def suggestions(self, limit: int = 10) -> DataFrame:
        return ops.suggestions(self.graph, limit)

    def rename_preview(self, target: str, new_name: str | None = None, now: float | None = None) -> dict:
        """The edges a rename touches; with a new name also its edits, kept for ten minutes under an eight-character id."""
        i = self.node_id(target)
        out = {"edges": ops.rename_preview(self.graph, i)}
        if new_name:
            key = uuid.uuid4().hex[:8]
            folder = f"{self.store.path}/previews"
            os.makedirs(folder, exist_ok=True)
            ops.rename_edits(self.graph, i, new_name).write.parquet(f"{folder}/{key}.edits")
            edits = self.spark.read.parquet(f"{folder}/{key}.edits")
            with open(f"{folder}/{key}.json", "w", encoding="utf-8") as f:
                json.dump({"expires": (now or time.time()) + PREVIEW_SECONDS}, f)
            out |= {"id": key, "n_edits": edits.count(), "edits": edits}
        return out

    def apply_rename(self, key: str, root: str | None = None, now: float | None = None) -> dict:
        """Carry out a preview: whole words on the named line, or in the whole file; only below the root."""
        file = f"{self.store.path}/previews/{key}.json"
        if not re.fullmatch(r"[0-9a-f]{8}", key) or not os.path.exists(file):
            return {"status": "unknown", "files": 0, "replaced": 0}
        with open(file, encoding="utf-8") as f:
            preview = json.load(f)
        os.remove(file)
        table = f"{self.store.path}/previews/{key}.edits"
        if (now or time.time()) > preview["expires"]:
            shutil.rmtree(table)
            return {"status": "expired", "files": 0, "replaced": 0}
        base = os.path.realpath(root or self.root) + os.sep
        changed = replaced = 0
        skipped = []
        # one partition at a time, so that any number of edits is carried out
        for e in self.spark.read.parquet(table).toLocalIterator():
            real = os.path.realpath(e["file_path"])
            if not real.startswith(base) or not os.path.isfile(real):
                skipped.append(e["file_path"])
                continue
            word = re.compile(r"(?<![\w$])" + re.escape(e["old_name"]) + r"(?![\w$])")
            with open(real, encoding="utf-8") as f:
                lines = f.read().split("\n")
            at = (e["line"] or 0) - 1
            spots = [at] if 0 <= at < len(lines) and word.search(lines[at]) else range(len(lines))
            n = 0
            for k in spots:
                lines[k], c = word.subn(lambda _, new=e["new_name"]: new, lines[k])
                n += c
            if n:
                with open(real, "w", encoding="utf-8") as f:
                    f.write("\n".join(lines))
                changed, replaced = changed + 1, replaced + n
        shutil.rmtree(table)
        return {"status": "applied", "files": changed, "replaced": replaced, "skipped": skipped}

    # --- retrieval ---
    def search_like(self, query: str, limit: int = 100) -> DataFrame:
        return text.search_like(self.graph.nodes, query, limit)

    def embed_nodes(self, provider=vectors.hashing_provider, name: str = "hashing-64") -> int:
        old = self.store.load("embeddings", schema.EMBEDDINGS)
        new = materialise(vectors.embed(self.graph.nodes, old, provider, name), "embeddings")
        self.store.save("embeddings", materialise(st.upsert(old, new, ["node_id", "provider"]), "embeddings"))
        return new.count()

    def hybrid_search(self, query: str, context_files: list[str] = (), limit: int = 20, provider=vectors.hashing_provider, name: str = "hashing-64") -> DataFrame:
        v = self.store.load("embeddings", schema.EMBEDDINGS).where(F.col("provider") == name)
        return text.hybrid_search(self.graph.nodes, query, v, provider([query])[0], list(context_files), True, limit)

    def build_index(self) -> None:
        """Store the search index of the nodes as they are."""
        docs, idf = text.tfidf_index(self.graph.nodes)
        self.store.save_all({"index_docs": docs, "index_idf": idf, "index_of": self.spark.createDataFrame([(self._version(),)], "version string")})

    def _version(self) -> str:
        row = self.graph.nodes.agg(F.count("*").alias("n"), F.max("updated_at").alias("at"), F.sum(F.xxhash64("id", "name", "description").cast("decimal(38,0)")).alias("h")).first()
        return f"{row.n} {row.at} {row.h}"

    def index(self) -> text.Index:
        """The stored search index, built anew if the nodes have changed since."""
        if not self.store.exists("index_of") or self.store.load("index_of").first().version != self._version():
            self.build_index()
        return text.Index(self.store.load("index_docs"), self.store.load("index_idf"))

    def tfidf_search(self, query: str, limit: int = 20) -> DataFrame:
        return text.tfidf_search(self.graph.nodes, query, limit, self.index())

    def find_similar(self, target: str, limit: int = 10) -> DataFrame:
        return text.tfidf_similar(self.graph.nodes, self.node_id(target), limit, self.index())

    # --- architecture ---
    def communities(self) -> DataFrame:
        return community.detect(self.graph)

    def persist_communities(self) -> DataFrame:
        table, nodes = community.persist(self.graph, self.communities(), int(time.time() * 1000))
        table, nodes = materialise(table, "communities"), materialise(nodes, "nodes")
        self.store.save("nodes", nodes.select(*schema.NODES.names))
        return self.store.save("communities", table)

    def overview(self) -> dict:
        return community.overview(self.graph, materialise(self.communities(), "members"))

    def bundle(self, file_path: str, depth: int = 2, include_source: bool = True) -> str:
        path = self.node_id(file_path).split(":", 1)[1].split("#")[0]
        source = None
        if include_source and os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                source = f.read()
        return reports.render_bundle(reports.bundle_lines(self.graph, path, depth, source), path)

    def wiki(self, folder: str | None = None):
        pages = reports.wiki_pages(self.graph, materialise(self.communities(), "members"))
        return pages if folder is None else reports.write_wiki(pages, folder)

    def wiki_section(self, label: str) -> str:
        return reports.wiki_section(reports.wiki_pages(self.graph, materialise(self.communities(), "members")), label)

    def drawing(self, file: str) -> dict:
        return dict(zip(("nodes", "links"), reports.write_drawing(self.graph, file)))

    # --- evaluation
    def evaluate(self, spec: str, csv: str | None = None) -> str:
        """The five benchmarks over every repository of a JSON list, as Markdown, and as CSV into a file.

        An entry has name, root, store, and as far as they are known searches (query: expected), impacts (id: ids), entries, bundle_file.
        """
        results = []
        with open(spec, encoding="utf-8") as f:
            repos = json.load(f)
        for r in repos:
            one = Engine(self.spark, r["store"], r["root"])
            built = lambda one=one: (one.build(force=True), one.graph)[1]
            bundle_file = one.node_id(r["bundle_file"]).split(":", 1)[1] if "bundle_file" in r else ""
            size = -(-os.path.getsize(bundle_file) // 4) if os.path.isfile(bundle_file) else 0
            results += [{"repo": r["name"], **x} for x in reports.run_eval(built, r.get("searches", {}), r.get("impacts", {}), r.get("entries", []), size, bundle_file)]
        if csv:
            with open(csv, "w", encoding="utf-8") as f:
                f.write(reports.eval_csv(results))
        return reports.eval_markdown(reports.eval_summary(self.spark.createDataFrame(results, "repo string, benchmark string, score double, passed boolean, seconds double")))

    def eval_repos(self, spec: str) -> list[dict]:
        """Name and root of the repositories of an evaluation."""
        with open(spec, encoding="utf-8") as f:
            return [{k: r[k] for k in ("name", "root")} for r in json.load(f)]

    # --- changes ---
    def _contents(self, changes: DataFrame) -> DataFrame:
        """The contents of all changed files, read where they lie, in batches of paths."""
        changed = changes.where("status != 'deleted'").select("file_path").distinct()
        paths = [r.file_path for r in changed.toLocalIterator() if os.path.isfile(r.file_path)]
        out = self.spark.createDataFrame([], "file_path string, content string")
        for i in range(0, len(paths), PATHS_AT_ONCE):
            raw = self.spark.read.format("binaryFile").load(paths[i : i + PATHS_AT_ONCE])
            out = out.unionByName(raw.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), F.decode("content", "utf-8").alias("content")))
        return out

    def analyze_changes(self, base: str = "HEAD~1") -> DataFrame:
        ch = gitdiff.read_changes(self.spark, self.root, base)
        return risk.analyze_changes(self.graph, ch, self._contents(ch))

    def review_context(self, base: str = "HEAD~1") -> str:
        ch = gitdiff.read_changes(self.spark, self.root, base)
        return risk.format_review(risk.review_context(self.graph, ch, self._contents(ch)), base)
