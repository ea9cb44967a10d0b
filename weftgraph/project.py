"""A project: nodes, edges and boundary points as DataFrames.

Whatever the rows come from - versioned tables, a store, extracted files - an operator sees the same
columns:

  nodes       id, kind, path, line, identity (JSON text), properties (JSON text)
  edges       edge_id, type, source_id, target_id, origin, resolved, confidence, ev_file, ev_line, properties
  boundaries  boundary_id, direction, type, node_id, match_key, ev_file, ev_line, meta
  diagnostics source, file, line, msg
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.keys import canonical_key
from weftgraph.operators.current import current_rows
from weftgraph.session import table

NODE_COLUMNS = ["id", "kind", "path", "line", "identity", "properties"]
EDGE_COLUMNS = ["edge_id", "type", "source_id", "target_id", "origin", "resolved", "confidence", "ev_file", "ev_line", "properties"]
BOUNDARY_COLUMNS = ["boundary_id", "direction", "type", "node_id", "match_key", "ev_file", "ev_line", "meta"]

NODE_SCHEMA = "id string, kind string, path string, line int, identity string, properties string"
EDGE_SCHEMA = "edge_id long, type string, source_id string, target_id string, origin string, resolved boolean, confidence double, ev_file string, ev_line int, properties string"
BOUNDARY_SCHEMA = "boundary_id long, direction string, type string, node_id string, match_key string, ev_file string, ev_line int, meta string"
DIAGNOSTIC_SCHEMA = "source string, file string, line int, msg string"


@dataclass(frozen=True)
class Project:
    nodes: DataFrame
    edges: DataFrame
    boundaries: DataFrame
    diagnostics: DataFrame | None = None
    meta: DataFrame | None = None

    def unresolved(self) -> DataFrame:
        """The edges that are not resolved: a view, never stored.  A null flag counts as unresolved."""
        return self.edges.where(~F.coalesce("resolved", F.lit(False)))

    def then(self, step: Callable[[Project], Project]) -> Project:
        return step(self)


def current_project(spark: SparkSession, d: str) -> Project:
    """The current state of versioned tables: the latest row of each id, removed records left out, keys canonical.

    Everything is lazy: an operator that needs two columns reads and shuffles two.
    """
    nodes = table(spark, d, "nodes").select(*NODE_COLUMNS, "removed_at", "loaded_at")
    shared = table(spark, d, "shared_nodes").select(*NODE_COLUMNS, "removed_at", "loaded_at")
    both = nodes.unionByName(shared).where("id is not null")
    edges = table(spark, d, "edges").select(*EDGE_COLUMNS, "loaded_at").withColumns({c: canonical_key(c) for c in ("source_id", "target_id")})
    points = table(spark, d, "boundaries").select(*BOUNDARY_COLUMNS, "loaded_at").withColumns({c: canonical_key(c) for c in ("node_id", "match_key")})
    return Project(
        current_rows(both, ["id"]).where("removed_at is null").select(*NODE_COLUMNS),
        current_rows(edges, ["edge_id"]).select(*EDGE_COLUMNS),
        current_rows(points, ["boundary_id"]).select(*BOUNDARY_COLUMNS),
    )
