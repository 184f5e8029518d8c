"""Operator 6, license scans: Aho-Corasick over the words of a text, and licence expressions by shunting-yard.

One automaton finds notice phrases (as runs of whole words) and identifier
tags. What follows a tag is read as a licence expression of identifiers joined
by and / or / with and brackets, put into postfix order by the shunting-yard
algorithm and evaluated.

Defined cases: a null text counts as empty: no words, places, labels, score 0;
overlapping places all count; repeated rows give repeated results; a tag whose
expression cannot be read adds the label ``unreadable``.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm.batches import map_rows

#: A-Z become a-z, all other ASCII that is not a digit or a-z becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "mozilla public license": ("mpl", 0.9), "eclipse public license": ("epl", 0.9), "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9), "creative commons attribution": ("cc-by", 0.8), "cc by": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.9), "cc by nc": ("cc-by-nc", 0.9), "cc by nd": ("cc-by-nd", 0.9), "cc0 1 0": ("cc0", 0.9), "bsd license": ("bsd", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8), "isc license": ("isc", 0.9), "permission is hereby granted free of charge": ("mit", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.6), "boost software license": ("bsl", 0.9), "unlicense org": ("unlicense", 0.9),
}
TAG = "spdx license identifier"

#: Identifier prefix (lower case) -> label and whether reuse without sharing alike is allowed.
IDENTIFIERS = (
    ("apache-", "apache", True), ("mit", "mit", True), ("bsd-", "bsd", True), ("isc", "isc", True), ("0bsd", "bsd", True), ("bsl-", "bsl", True), ("zlib", "zlib", True),
    ("unlicense", "unlicense", True), ("cc0-", "cc0", True), ("cc-by-nc", "cc-by-nc", False), ("cc-by-sa", "cc-by-sa", False), ("cc-by-nd", "cc-by-nd", False), ("cc-by-", "cc-by", True),
    ("agpl-", "agpl", False), ("lgpl-", "lgpl", False), ("gpl-", "gpl", False), ("mpl-", "mpl", False), ("epl-", "epl", False), ("python-", "python", True),
)

_TAG_TEXT = re.compile(r"(?i)spdx[^A-Za-z0-9\x80-\U0010ffff]+license[^A-Za-z0-9\x80-\U0010ffff]+identifier[ \t]*:?[ \t]*([^\n]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard; reads as far as the text is an expression, None if no operand stands at the start or brackets stay open."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for m in _TOKEN.finditer(expression):
        t = m.group().lower()
        if operand:
            if t == "(":
                stack.append(t)
            elif t in _RANK or t == ")":
                return None
            else:
                out.append(t)
                operand = False
        elif t in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            break  # prose after the expression
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """(labels, permissive): an 'or' is permissive if one side is, an 'and' if both are, a 'with' as its licence is."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[set[str], bool]] = []
    for t in order:
        if t in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append((a[0] | b[0], a[1] or b[1]) if t == "or" else (a[0] | b[0], a[1] and b[1]) if t == "and" else a)
        else:
            stack.append(next((({label}, free) for prefix, label, free in IDENTIFIERS if t.startswith(prefix)), ({t}, False)))
    return stack[0]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: None}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


_built: list = []


def scan(text: str | None) -> dict:
    """All places and labels of one whole text."""
    if not _built:
        _built.append(_automaton())
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split(b" ")
    words = [w for w in words if w] if b"" in words else words
    joined = " " + b" ".join(words).decode("utf-8") + " "
    starts: list[int] = []
    base: set[str] = set()
    added: set[str] = set()
    score, done, at = 0.0, 0, 0
    tagged = False
    for end, phrase in _built[0].iter(joined):
        first = end - len(phrase) - 1
        if phrase in BASE:
            at += joined.count(" ", done, first) if first >= done else -joined.count(" ", first, done)
            done = first
            starts.append(at)
            base.add(BASE[phrase])
            score = max(score, 0.9)
        elif phrase == TAG:
            tagged = True
        else:
            label, weight = NOTICES[phrase]
            added.add(label)
            score = max(score, weight)
    expressions: list[str] = []
    permissive = None
    if tagged:
        for m in _TAG_TEXT.finditer(text):
            expressions.append(m.group(1).strip())
            got = evaluate(m.group(1))
            if got is None:
                added.add("unreadable")
                score = max(score, 0.5)
            else:
                added |= got[0]
                permissive = got[1] if permissive is None else permissive and got[1]
                score = 1.0
    labels = base | added
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "expressions": expressions, "permissive": permissive,
    }


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions array<string>, permissive boolean"


def scan_documents(documents: DataFrame) -> DataFrame:
    """One row per input row: places of the base phrases, labels, tag expressions and whether they allow free reuse."""

    def run(ids, texts):
        found = [scan(t) for t in texts]
        return {"doc_id": ids, **{k: [f[k] for f in found] for k in found[0]}}

    return map_rows(documents.select("doc_id", "text"), SCHEMA, run)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("expressions")
