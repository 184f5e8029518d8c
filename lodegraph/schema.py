"""Schemas of the stored tables, and the graph they form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


NODES = _struct(id=_S, kind=_S, name=_S, file_path=_S, description=_S, is_external=_B, language=_S, meta=_S, updated_at=_L, community_id=_L)
EDGES = _struct(id=_S, from_id=_S, to_id=_S, kind=_S, reason=_S, updated_at=_L)
FILES = _struct(file_path=_S, language=_S, content_hash=_S, mtime=_D, node_count=_I, edge_count=_I, parsed_at=_L)
EMBEDDINGS = _struct(node_id=_S, vector=T.ArrayType(T.FloatType()), text_hash=_S, provider=_S)
COMMUNITIES = _struct(id=_L, name=_S, level=_I, parent_id=_L, cohesion=_D, size=_I, dominant_language=_S, description=_S, created_at=_L)
CHANGES = _struct(file_path=_S, status=_S, old_path=_S, lines_added=_I, lines_removed=_I)

NODE_KINDS = ("file", "class", "function", "method", "interface", "module", "external_dep", "type", "test")
EDGE_KINDS = ("imports", "exports", "calls", "inherits", "implements", "contains", "tested_by", "depends_on")


@dataclass(frozen=True)
class Graph:
    """A typed property graph: nodes by id, and edges whose ends need not exist."""

    nodes: DataFrame
    edges: DataFrame
