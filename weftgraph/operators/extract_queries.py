"""Queries that read source files: scans (S), extraction (X) and the rules that need what they yield.

A path counts once, in its latest revision; every extraction parses the whole of every such file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import canonical_key
from weftgraph.operators import extract, integrity, stats
from weftgraph.plans.materialize import cut
from weftgraph.project import NODE_COLUMNS, Project, current_project
from weftgraph.session import table
from weftgraph.sources import discovery

#: Ignore globs of the query; a setting.
IGNORED = ["npc", "*.import", "*/ui/*", "[bad"]


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """path, content, binary of the latest revision of every path (equal times: the greatest file_id)."""
    w = Window.partitionBy("path").orderBy(F.desc_nulls_last("committed_at"), F.desc("file_id"))
    rows = table(spark, d, "source_files").where("path is not null").select(canonical_key("path").alias("path"), "content", "committed_at", "file_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("path", "content", F.lit(False).alias("binary"))


def _project(spark: SparkSession, d: str) -> Project:
    concepts = current_project(spark, d).nodes.where("kind in ('autoload', 'action', 'group', 'layer')").select(*NODE_COLUMNS)
    return extract.extracted(source_files(spark, d), concepts)


def s6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """path, kind of every source file (S-3, S-6)."""
    return source_files(spark, d).select("path", discovery.kind_of("path").alias("kind"))


def s4_ignored(spark: SparkSession, d: str) -> DataFrame:
    """path, ignored under the query's globs (S-4)."""
    return source_files(spark, d).select("path", discovery.is_ignored(F.regexp_replace("path", "^res://", ""), IGNORED).alias("ignored"))


def s8_header_uids(spark: SparkSession, d: str) -> DataFrame:
    """path, uid of scenes and resources (S-8)."""
    return discovery.header_uids(source_files(spark, d))


def s9_import_uids(spark: SparkSession, d: str) -> DataFrame:
    """path, uid, source_file of import sidecars (S-9)."""
    return discovery.import_uids(source_files(spark, d))


def s_uid_map(spark: SparkSession, d: str) -> DataFrame:
    """uid, path."""
    return discovery.uid_map(source_files(spark, d))


def x_facts(spark: SparkSession, d: str) -> DataFrame:
    """file, fact, n: how many facts of each sort a file holds (S-10, S-11, S-13)."""
    return extract.facts_of(source_files(spark, d)).groupBy("file", "fact").agg(F.count(F.lit(1)).alias("n"))


def x_nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, path, line, identity, properties (X-3, X-7 to X-14)."""
    return _project(spark, d).nodes


def x_edges(spark: SparkSession, d: str) -> DataFrame:
    """type, source_id, target_id, origin, resolved, confidence, ev_file, ev_line, properties (X-2 to X-27)."""
    return _project(spark, d).edges.drop("edge_id")


def x_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """direction, type, node_id, match_key, ev_file, ev_line, meta (X-5, X-12, X-19 to X-27)."""
    return _project(spark, d).boundaries.drop("boundary_id")


def x_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """source, file, line, msg."""
    return _project(spark, d).diagnostics


def x_totals(spark: SparkSession, d: str) -> DataFrame:
    """nodes, edges, boundaries, unresolved of the extracted project."""
    return stats.totals(_project(spark, d))


def x11_signals(spark: SparkSession, d: str) -> DataFrame:
    """file, name of declared signals."""
    return extract.facts_of(source_files(spark, d)).where("fact = 'signal'").select("file", F.col("a").alias("name")).distinct()


def x12_functions(spark: SparkSession, d: str) -> DataFrame:
    """file, name of declared functions."""
    return extract.facts_of(source_files(spark, d)).where("fact = 'func'").select("file", F.col("a").alias("name")).distinct()


def x10_bases(spark: SparkSession, d: str) -> DataFrame:
    """file, base of scripts."""
    return extract.facts_of(source_files(spark, d)).where("fact = 'extends'").select("file", F.col("b").alias("base")).distinct()


def x3_scene_nodes(spark: SparkSession, d: str) -> DataFrame:
    """file, node_path, node_type of scene nodes."""
    return extract.facts_of(source_files(spark, d)).where("fact = 'node' and file like '%.tscn'").select("file", F.col("d").alias("node_path"), F.col("b").alias("node_type")).distinct()


def j1_resources(spark: SparkSession, d: str) -> DataFrame:
    """file, rid, rtype, target: external resources by id, dereferenced by path or uid (J-1)."""
    files = cut(source_files(spark, d), "files")
    own = extract.facts_of(files).where("fact in ('ext', 'node', 'ref', 'script', 'sub_script')")
    return extract.dereferenced(cut(own, "own"), discovery.uid_map(files)).select("file", "rid", "rtype", "target").distinct()


def x_rules(spark: SparkSession, d: str) -> DataFrame:
    """severity, rule, n of the rules that need exported and assigned variables."""
    return integrity.severity_counts(integrity.findings(_project(spark, d), only=("dead_export", "export_type_mismatch", "unresolved_load", "dangling_connection")))


def i_dead_export(spark: SparkSession, d: str) -> DataFrame:
    """Findings of dead_export over the extracted project (J-15)."""
    return integrity.findings(_project(spark, d), only=("dead_export",)).drop("edge_id")


def i_export_type_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Findings of export_type_mismatch over the extracted project."""
    return integrity.findings(_project(spark, d), only=("export_type_mismatch",)).drop("edge_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (s6_kinds, s4_ignored, s8_header_uids, s9_import_uids, s_uid_map, x_facts, x_nodes, x_edges, x_boundaries, x_diagnostics, x_totals, x11_signals, x12_functions, x10_bases, x3_scene_nodes, j1_resources, x_rules, i_dead_export, i_export_type_mismatch)
    return {f.__name__: f for f in named}
