"""Queries of the general data problems (p1-p4) over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators import fan, hotkeys, orphans, snapshot_diff
from weftgraph.operators.node_parents import node_hierarchy
from weftgraph.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """node_id, cycle_id of nodes whose chain of parents never ends."""
    return node_hierarchy(table(spark, d, "nodes"), table(spark, d, "shared_nodes")).in_cycles()


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """node_id, path, depth, root_id, n_descendants, cycle_id of every node."""
    return node_hierarchy(table(spark, d, "nodes"), table(spark, d, "shared_nodes"), with_paths=True).nodes()


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """ancestor_id, node_id, distance: all descendants of every node, as rows."""
    return node_hierarchy(table(spark, d, "nodes"), table(spark, d, "shared_nodes")).descendants()


def _referring(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("nodes", "shared_nodes", "edges", "boundaries")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """src_table, row_id of the references to records that do not exist."""
    return orphans.orphan_state(*_referring(spark, d)).orphans()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """src_table, month, n_references, n_orphans after everything was loaded."""
    return orphans.orphan_state(*_referring(spark, d)).snapshot()


def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The report after each month of loading: src_table, month, n_references, n_orphans, batch_no."""
    return orphans.orphan_history(*_referring(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """endpoint, key_id of the keys with at least 2 % of the edges at that endpoint."""
    return hotkeys.heavy_endpoints(hotkeys.endpoint_states(table(spark, d, "edges")))


def p3_keys(spark: SparkSession, d: str) -> DataFrame:
    """endpoint, key_id, type, origin, n_edges, first_observed_at, last_observed_at of every key."""
    return hotkeys.endpoint_states(table(spark, d, "edges"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """entity, snapshot_no, node_id, edge_type, source_id, target_id, change."""
    return snapshot_diff.graph_changes(table(spark, d, "node_snapshots"), table(spark, d, "edge_snapshots"))


def op1_links(spark: SparkSession, d: str) -> DataFrame:
    """source_id, target_id of every link of the graph."""
    return fan.links(fan.vertices(table(spark, d, "nodes"), table(spark, d, "shared_nodes")), table(spark, d, "edges"))


def op5_fan(spark: SparkSession, d: str) -> DataFrame:
    """node_id, fan_in, fan_out of every node of the graph."""
    ids = fan.vertices(table(spark, d, "nodes"), table(spark, d, "shared_nodes"))
    return fan.fan(ids, fan.links(ids, table(spark, d, "edges")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p2_found, p2_report, p2_snapshots, p3_found, p3_keys, p4_found, op1_links, op5_fan)}
