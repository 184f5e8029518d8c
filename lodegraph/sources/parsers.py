"""Source texts into nodes and edges: one table function over (path, language, content) rows.

Every language has a table of patterns; comments and string bodies are blanked
before symbols are looked for. Emitted are a file node, one external_dep and
imports edge per imported package, and a node with an exports edge per symbol.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.schema import Graph
from lodegraph.storage import materialise

EXTENSIONS = {
    "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "csharp": "cs", "python": "py", "go": "go", "java": "java", "rust": "rs", "ruby": "rb",
    "php": "php", "c": "c h", "cpp": "cpp cc cxx hpp hh", "kotlin": "kt kts",
}
_BY_EXTENSION = {f".{e}": lang for lang, es in EXTENSIONS.items() for e in es.split()}


def language(path: Column) -> Column:
    """The language of a path's extension, in any case; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in _BY_EXTENSION.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)))


def node_id(kind: str, path: str, symbol: str | None = None) -> str:
    return f"{kind}:{path}" + (f"#{symbol}" if symbol else "")


def snippet(text: str, most: int = 120) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


@dataclass
class Rules:
    """imports: (pattern, how the package is cut from the name); symbols: (kind, pattern with group name, maybe group bases)."""

    imports: list[tuple[str, str]]
    symbols: list[tuple[str, str]]
    line_comment: str = "//"
    block: bool = True
    inside: str | None = None  # a block head that makes functions in it methods
    words: set[str] = field(default_factory=lambda: {"if", "for", "while", "switch", "catch", "return", "else", "do", "new", "sizeof", "function", "super", "using", "lock"})


_ID = r"[A-Za-z_$][\w$]*"
_C_CALL = r"^[ \t]*(?:[A-Za-z_][\w:<>,*&\[\]~ \t]*?[ \t*&]+)(?:[A-Za-z_]\w*::)*(?P<name>~?[A-Za-z_]\w*)[ \t]*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)[^;{}=]*\{"
_JAVA_METHOD = r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|synchronized|native|default|extern|partial)[ \t]+)+(?:<[^>]+>[ \t]*)?(?:[\w<>\[\],.? \t]+?[ \t]+)?(?P<name>[A-Za-z_]\w*)[ \t]*\("
RULES = {
    "typescript": Rules(
        [(r"""(?:import|export)\s[^;'"]*?from\s*['"]([^'"]+)['"]|import\s*['"]([^'"]+)['"]|(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)""", "node")],
        [
            ("class", rf"\bclass\s+(?P<name>{_ID})(?:<[^>{{]*>)?(?P<heads>[^{{]*)\{{"), ("interface", rf"\binterface\s+(?P<name>{_ID})(?:<[^>{{]*>)?(?P<heads>[^{{]*)\{{"),
            ("function", rf"\bfunction\s*\*?\s*(?P<name>{_ID})\s*[(<]"), ("function", rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_ID})\s*(?::[^=\n]+)?=>"),
            ("method", rf"^[ \t]+(?:(?:public|private|protected|static|readonly|async|override|abstract|get|set)[ \t]+)*\*?(?P<name>{_ID})[ \t]*(?:<[^>(]*>)?\([^(){{}}]*(?:\([^()]*\)[^(){{}}]*)*\)[ \t]*(?::[^{{;=\n]+)?\{{"),
        ],
    ),
    "python": Rules(
        [(r"^[ \t]*import[ \t]+([^\n#]+)", "list"), (r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b", "dot")],
        [("class", r"^[ \t]*class[ \t]+(?P<name>\w+)[ \t]*(?:\((?P<bases>[^)]*)\))?[ \t]*:"), ("function", r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*\(")], "#", False,
    ),
    "csharp": Rules(
        [(r"^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?([\w.]+)[ \t]*;", "dot")],
        [("module", r"\bnamespace\s+(?P<name>[\w.]+)"), ("class", r"\b(?:class|record|struct)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\([^)]*\))?\s*(?::(?P<bases>[^{;]*))?[{;]"), ("interface", r"\binterface\s+(?P<name>\w+)(?:<[^>{]*>)?\s*(?::(?P<bases>[^{]*))?\{"), ("method", _JAVA_METHOD)],
    ),
    "go": Rules(
        [(r"""^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?"([^"]+)\"""", "whole"), (r"""^[ \t]+(?:[\w.]+[ \t]+)?"([^"\s]+)"[ \t]*$""", "whole")],
        [("interface", r"^type[ \t]+(?P<name>\w+)(?:\[[^\]]*\])?[ \t]+interface\b"), ("class", r"^type[ \t]+(?P<name>\w+)(?:\[[^\]]*\])?[ \t]+(?!interface\b)[\w\[\]*(.]"), ("method", r"^func[ \t]*\([^)]*\)[ \t]*(?P<name>\w+)[ \t]*[(\[]"), ("function", r"^func[ \t]+(?P<name>\w+)[ \t]*[(\[]")],
    ),
    "java": Rules(
        [(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)(?:\.\*)?[ \t]*;", "dot")],
        [("class", r"\b(?:class|enum|record)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\([^)]*\))?(?P<heads>[^{]*)\{"), ("interface", r"\binterface\s+(?P<name>\w+)(?:<[^>{]*>)?(?P<heads>[^{]*)\{"), ("method", _JAVA_METHOD)],
    ),
    "rust": Rules(
        [(r"^[ \t]*(?:pub[ \t]+)?use[ \t]+(?:::)?(\w+)", "whole")],
        [("class", r"\b(?:struct|enum)\s+(?P<name>\w+)"), ("interface", r"\btrait\s+(?P<name>\w+)"), ("function", r"\bfn\s+(?P<name>\w+)")], inside=r"\bimpl\b[^{;]*\{",
    ),
    "ruby": Rules(
        [(r"""^[ \t]*require(?:_relative)?[ \t(]*['"]([^'"]+)['"]""", "whole")],
        [("class", r"^[ \t]*class[ \t]+(?P<name>[A-Z][\w:]*)(?:[ \t]*<[ \t]*(?P<bases>[A-Z][\w:]*))?"), ("module", r"^[ \t]*module[ \t]+(?P<name>[A-Z][\w:]*)"), ("function", r"^(?P<indent>[ \t]*)def[ \t]+(?:self\.)?(?P<name>\w+[?!=]?)")], "#", False,
    ),
    "php": Rules(
        [(r"^[ \t]*use[ \t]+(?:function[ \t]+|const[ \t]+)?\\?([\w\\]+)", "back")],
        [("class", r"\b(?:class|trait)\s+(?P<name>\w+)(?P<heads>[^{;]*)\{"), ("interface", r"\binterface\s+(?P<name>\w+)(?P<heads>[^{;]*)\{"), ("method", r"\b(?:public|private|protected|static|abstract|final)\s+(?:(?:static|public|private|protected|final)\s+)*function\s+&?(?P<name>\w+)\s*\("), ("function", r"^(?:[ \t]*)function\s+&?(?P<name>\w+)\s*\(")],
    ),
    "c": Rules([(r"""^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]""", "whole")], [("class", r"\b(?:struct|union|enum|class)\s+(?:class\s+)?(?P<name>\w+)(?:\s*final)?\s*(?::(?P<bases>[^{;:()]*))?\{"), ("function", _C_CALL)]),
    "kotlin": Rules(
        [(r"^[ \t]*import[ \t]+([\w.]+)", "dot")],
        [("interface", r"\binterface\s+(?P<name>\w+)"), ("class", r"\b(?:class|object)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\([^)]*\))?\s*(?::(?P<bases>[^{\n]*))?"), ("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\(")],
    ),
}
RULES["javascript"], RULES["cpp"] = RULES["typescript"], RULES["c"]
_COMPILED = {k: ([(re.compile(p, re.M), how) for p, how in r.imports], [(kind, re.compile(p, re.M)) for kind, p in r.symbols]) for k, r in RULES.items()}
_HEADS = re.compile(r"\b(extends|implements)\s+([^{]*?)(?=\bextends\b|\bimplements\b|$)", re.S)


def _blank(text: str, rules: Rules, strings: bool) -> str:
    """Comments (and the insides of strings) become spaces, places and line breaks stay."""
    parts = [re.escape(rules.line_comment) + r"[^\n]*"]
    if rules.block:
        parts.insert(0, r"/\*.*?\*/")
    quoted = r'"(?:\\.|[^"\\\n])*"' + r"|'(?:\\.|[^'\\\n])*'" + (r"|`(?:\\.|[^`\\])*`" if rules is RULES["typescript"] else "")
    if not rules.block:
        quoted = r'""".*?"""|' + r"'''.*?'''|" + quoted

    def put(m: re.Match) -> str:
        s = m.group()
        is_comment = s.startswith(rules.line_comment) or s.startswith("/*")
        return re.sub(r"[^\n]", " ", s) if is_comment or strings else s

    return re.sub("|".join([*parts, quoted]), put, text, flags=re.S)


def _package(name: str, how: str) -> list[str]:
    if how == "list":
        return [p.strip().split()[0].split(".")[0] for p in name.split(",") if p.strip()]
    if how == "dot":
        return [name.lstrip(".").split(".")[0]] if name.strip(".") else []
    if how == "back":
        return [name.split("\\")[0]]
    if how == "node":
        return ["/".join(name.split("/")[: 2 if name.startswith("@") else 1])]
    return [name]


def _relative(path: str, spec: str) -> str:
    """The path that a relative import names, without the suffix of a script."""
    parts = path.split("/")[:-1]
    for p in spec.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in (".", ""):
            parts.append(p)
    return re.sub(r"\.(?:[cm]?jsx?|tsx?)$", "", "/".join(parts))


def parse(path: str, lang: str, text: str, calls: bool = False) -> tuple[list[dict], list[dict]]:
    """(nodes, edges) of one file. ``calls`` adds contains and same-file calls edges, and parents in all languages."""
    rules, (imports, symbols) = RULES[lang], _COMPILED[lang]
    file_id = node_id("file", path)
    base = path.rsplit("/", 1)[-1]
    nodes = {file_id: {"id": file_id, "kind": "file", "name": base, "file_path": path, "description": f"Source file {base}", "is_external": False, "language": lang, "meta": "{}"}}
    edges: dict[str, dict] = {}

    def edge(a: str, kind: str, b: str, reason: str) -> None:
        edges.setdefault(f"{a}|{kind}|{b}", {"id": f"{a}|{kind}|{b}", "from_id": a, "to_id": b, "kind": kind, "reason": reason})

    code = _blank(text, rules, False)
    for pattern, how in imports:
        for m in pattern.finditer(code):
            spec = next(g for g in m.groups() if g)
            if how == "node" and spec.startswith("."):
                edge(file_id, "imports", "file:" + _relative(path, spec), f"imports {spec}")
                continue
            for name in _package(spec, how):
                dep = node_id("external_dep", name)
                nodes.setdefault(dep, {"id": dep, "kind": "external_dep", "name": name, "file_path": name, "description": f"External package {name}", "is_external": True, "language": None, "meta": "{}"})
                edge(file_id, "imports", dep, f"imports {spec.strip()}")
    bare = _blank(text, rules, True)
    spans = [(m.start(), _close(bare, m.end() - 1)) for m in re.finditer(rules.inside, bare)] if rules.inside else []
    found: list[tuple[str, str, int, int]] = []
    for kind, pattern in symbols:
        for m in pattern.finditer(bare):
            name = m["name"]
            if name in rules.words:
                continue
            groups = m.groupdict()
            k = kind
            if k == "function" and (any(a < m.start() < b for a, b in spans) or (lang == "ruby" and groups.get("indent"))):
                k = "method"
            own = node_id(k, path, name)
            if own in nodes or (k in ("method", "function") and any(node_id(o, path, name) in nodes for o in ("method", "function"))):
                continue
            line = bare.count("\n", 0, m.start("name")) + 1
            nodes[own] = {"id": own, "kind": k, "name": name, "file_path": path, "description": snippet(text[m.start() : m.end()].strip()) if k == "class" else f"{k} {name}", "is_external": False, "language": lang, "meta": json.dumps({"line": line})}
            edge(file_id, "exports", own, f"exports {k} {name}")
            found.append((own, name, m.start(), m.end()))
            parents: list[tuple[str, str, str]] = []
            if groups.get("bases"):
                parents = [("inherits", "class", b) for b in _names(groups["bases"]) if not (lang == "python" and b == "object")]
            for word, listed in _HEADS.findall(groups.get("heads") or ""):
                parents += [("inherits" if word == "extends" else "implements", "interface" if word == "implements" or k == "interface" else "class", b) for b in _names(listed)]
            # parents of other languages' symbols, and of interfaces but for one language, only come with the extensions
            plain = lang in ("typescript", "javascript", "python", "csharp", "java") and (k != "interface" or lang == "csharp")
            for how, what, b in parents if plain or calls else ():
                edge(own, how, node_id(what, path, b), f"{name} {how} {b}")
    if calls:
        by_name = {name: own for own, name, _, _ in found}
        ordered = sorted((s, own) for own, _, s, _ in found if own.split(":", 1)[0] in ("function", "method"))
        for own, *_ in found:
            edge(file_id, "contains", own, "defined in file")
        for i, (s, own) in enumerate(ordered):
            body = bare[s : ordered[i + 1][0] if i + 1 < len(ordered) else len(bare)]
            for n in re.findall(r"([A-Za-z_]\w*)\s*\(", body):
                if n in by_name and by_name[n] != own:
                    edge(own, "calls", by_name[n], f"calls {n}")
    return list(nodes.values()), list(edges.values())


def _names(listed: str) -> list[str]:
    flat = re.sub(r"<[^<>]*>|\([^()]*\)", "", re.sub(r"<[^<>]*>", "", listed))
    return [n for n in (re.sub(r"^(?:public|private|protected|virtual)\s+", "", p.strip()).split("=")[0].strip() for p in flat.split(",")) if re.fullmatch(r"[A-Za-z_$][\w$.:\\]*", n)]


def _close(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i
    return len(text)


_ROWS = "record string, id string, kind string, name string, file_path string, description string, is_external boolean, language string, meta string, from_id string, to_id string, reason string, error string"
_COLUMNS = [c.split()[0] for c in _ROWS.split(", ")]


def parse_table(files: DataFrame, calls: bool = False) -> DataFrame:
    """Node, edge and error rows of files (file_path, language, content); a file that fails gives one error row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[dict] = []
            for path, lang, text in zip(f.file_path, f.language, f.content):
                try:
                    nodes, edges = parse(path, lang, text or "", calls)
                    rows += [{"record": "node", **n} for n in nodes] + [{"record": "edge", "file_path": path, **e} for e in edges]
                except Exception as e:  # one bad file must not end the job; it is reported as a row
                    rows.append({"record": "error", "file_path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=_COLUMNS).astype(object).where(lambda d: d.notna(), None)

    known = files.where(F.col("language").isin(list(RULES)))
    return known.select("file_path", "language", F.col("content").cast("string").alias("content")).mapInPandas(run, _ROWS)


def resolve_imports(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges whose ``file:`` end lacks a suffix, pointed at the first candidate among existing files; unresolved ones stay."""
    suffixes = [f".{e}" for e in "ts tsx js jsx mjs cjs".split()] + [f"/index.{e}" for e in "ts tsx js jsx".split()]
    open_ = edges.where("kind = 'imports' and to_id like 'file:%'")
    bases = open_.select(F.expr("substring(to_id, 6)").alias("base")).distinct()
    tried = bases.select("base", F.posexplode(F.array(*[F.concat("base", F.lit(s)) for s in suffixes])).alias("rank", "file_path"))
    hit = tried.join(paths.select("file_path").distinct(), "file_path").groupBy("base").agg(F.min_by("file_path", "rank").alias("found"))
    j = edges.withColumn("base", F.when((F.col("kind") == "imports") & F.col("to_id").startswith("file:"), F.expr("substring(to_id, 6)"))).join(hit, "base", "left")
    to = F.when(F.col("found").isNotNull(), F.concat(F.lit("file:"), "found")).otherwise(F.col("to_id"))
    return j.withColumn("to_id", to).withColumn("id", F.concat_ws("|", "from_id", "kind", "to_id")).select(*edges.columns).dropDuplicates(["id"])


def parse_graph(files: DataFrame, calls: bool = False) -> tuple[Graph, DataFrame]:
    """(graph, errors) of files."""
    rows = materialise(parse_table(files, calls), "parsed")
    nodes = rows.where("record = 'node'").select("id", "kind", "name", "file_path", "description", "is_external", "language", "meta").dropDuplicates(["id"])
    edges = rows.where("record = 'edge'").select("id", "from_id", "to_id", "kind", "reason")
    return Graph(nodes, resolve_imports(edges, files)), rows.where("record = 'error'").select("file_path", "error")
