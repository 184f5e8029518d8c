"""Command line: python -m lodegraph.cli --root SRC --store DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from lodegraph.engine import Engine
from lodegraph.sources.registry import Registry
from lodegraph.storage import ship

#: command -> (engine method, arguments with their types)
COMMANDS = {
    "init": ("build", [("--force", bool), ("--calls", bool)]), "stats": ("stats", []), "deps": ("deps", [("target", str), ("--depth", int)]), "callers": ("callers", [("target", str)]),
    "callees": ("callees", [("target", str)]), "impact": ("impact", [("target", str), ("--max-depth", int)]), "search": ("search_like", [("query", str), ("--limit", int)]),
    "path": ("shortest_path", [("source", str), ("target", str)]), "call-chain": ("call_chain", [("target", str), ("--max-depth", int)]), "cycles": ("cycles", []), "orphans": ("orphans", []),
    "layers": ("layers", []), "entry-points": ("entry_points", [("--limit", int)]), "criticality": ("criticality", [("--limit", int)]), "large-functions": ("large_functions", [("--limit", int)]),
    "dead-code": ("dead_code", [("--limit", int)]), "suggest": ("suggestions", [("--limit", int)]), "rename-preview": ("rename_preview", [("target", str), ("--new-name", str)]),
    "apply-rename": ("apply_rename", [("key", str)]), "embed": ("embed_nodes", []), "hybrid-search": ("hybrid_search", [("query", str), ("--limit", int)]), "similar": ("find_similar", [("target", str), ("--limit", int)]),
    "communities": ("persist_communities", []), "architecture": ("overview", []), "bundle": ("bundle", [("file_path", str), ("--depth", int)]), "wiki": ("wiki", [("folder", str)]),
    "visualize": ("drawing", [("file", str)]), "wiki-section": ("wiki_section", [("label", str)]), "watch": ("watch", [("--every", float), ("--rounds", int)]),
    "eval": ("evaluate", [("spec", str), ("--csv", str)]), "eval-list": ("eval_repos", [("spec", str)]), "file": ("file", [("target", str)]), "embedding-count": ("embedding_count", []),
    "community-list": ("stored_communities", [("--level", int)]), "community-members": ("community_members", [("community_id", int)]), "tfidf-search": ("tfidf_search", [("query", str), ("--limit", int)]), "detect-changes": ("analyze_changes", [("--base", str)]), "review-context": ("review_context", [("--base", str)]),
}


def shown(value):
    """Results as plain data; tables come a partition at a time, with all their rows."""
    if isinstance(value, DataFrame):
        return [r.asDict(True) for r in value.toLocalIterator()]
    if isinstance(value, dict):
        return {k: shown(v) for k, v in value.items()}
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodegraph")
    p.add_argument("--root", default=".")
    p.add_argument("--store", default=".lodegraph")
    p.add_argument("--registry", default="registry.json")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, args) in COMMANDS.items():
        s = sub.add_parser(name)
        for a, kind in args:
            s.add_argument(a, **({"action": "store_true", "default": None} if kind is bool else {"type": kind}))
    for name, args in {"register": ["path", "store_path"], "unregister": ["name"], "list": [], "search": ["query"]}.items():
        s = sub.add_parser(f"registry-{name}")
        for a in args:
            s.add_argument(a)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = vars(parser().parse_args(argv))
    command, root, store, registry = (a.pop(k) for k in ("command", "root", "store", "registry"))
    spark = spark or SparkSession.builder.appName("lodegraph").getOrCreate()
    ship(spark)
    if command.startswith("registry-"):
        r = Registry(spark, registry)
        out = {"register": lambda: r.register(a["path"], a["store_path"]), "unregister": lambda: r.unregister(a["name"]), "list": r.list, "search": lambda: r.search(a["query"])}[command[9:]]()
    else:
        out = getattr(Engine(spark, store, root), COMMANDS[command][0])(**{k: v for k, v in a.items() if v is not None})
    return out if isinstance(out, str) else json.dumps(shown(out), indent=2, default=str)


if __name__ == "__main__":
    print(main())
