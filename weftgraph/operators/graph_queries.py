"""Queries of the graph, its counts and its integrity over whole tables; names begin with the survey's id."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import keys
from weftgraph.operators import graph, integrity, resolve, stats
from weftgraph.plans.materialize import cut
from weftgraph.project import Project, current_project
from weftgraph.session import table

#: Globs of the declared projection; a setting.
DOMAINS = {"shared/**": "shared", "*/ui/**": "interface", "*/levels/**": "world", "*/world/**": "world", "*/actors/**": "actors", "*/npc/**": "actors", "*/systems/**": "systems"}
WALK_HOPS = 3


def _graph(spark: SparkSession, d: str) -> tuple[Project, DataFrame, DataFrame]:
    p = current_project(spark, d)
    ids, links = stats.graph_of(p)
    return p, ids, cut(links, "links")


def _hub(p: Project, ids: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """root: the id with the greatest degree, ties to the smallest id."""
    from weftgraph.operators.fan import fan

    return fan(ids, links).orderBy(F.desc(by), "node_id").limit(1).select(F.col("node_id").alias("root"))


def _directories(ids: DataFrame) -> DataFrame:
    return ids.select("id", graph.directory("id").alias("group"))


def _repositories(ids: DataFrame) -> DataFrame:
    return ids.select("id", keys.repository("id").alias("group"))


# ---- counts ------------------------------------------------------------------------------------


def g1_nodes_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """kind, n."""
    return stats.count_by(current_project(spark, d).nodes, "kind")


def g2_edges_by_type(spark: SparkSession, d: str) -> DataFrame:
    """type, n."""
    return stats.count_by(current_project(spark, d).edges, "type")


def g3_boundaries_by_direction(spark: SparkSession, d: str) -> DataFrame:
    """ingress, egress."""
    return stats.directions(current_project(spark, d))


def g4_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """section, key, n."""
    return stats.breakdown(current_project(spark, d))


def g5_totals(spark: SparkSession, d: str) -> DataFrame:
    """nodes, edges, boundaries, unresolved."""
    return stats.totals(current_project(spark, d))


def g8_order(spark: SparkSession, d: str) -> DataFrame:
    """n: the number of vertices."""
    return current_project(spark, d).nodes.agg(F.count(F.lit(1)).alias("n"))


def g10_autoload_access(spark: SparkSession, d: str) -> DataFrame:
    """owner_id, autoload_id, first_line, n_accesses."""
    return stats.first_access(current_project(spark, d))


def g11_stub_enrich(spark: SparkSession, d: str) -> DataFrame:
    """class_id, script, n_mentions."""
    return stats.enriched_classes(current_project(spark, d))


def g12_signal_lists(spark: SparkSession, d: str) -> DataFrame:
    """script, signals."""
    return stats.signal_lists(current_project(spark, d))


def g13_coupling(spark: SparkSession, d: str) -> DataFrame:
    """unit, ca, ce, instability of every folder."""
    _, ids, links = _graph(spark, d)
    return stats.coupling(_directories(ids), links)


def g14_autoload_fan_in(spark: SparkSession, d: str) -> DataFrame:
    """id, n_edges, n_peers: autoloads by the sources that use them."""
    return stats.degree_ranking(current_project(spark, d), "accesses_autoload", "target_id", "autoload:")


def g14_instance_fan_in(spark: SparkSession, d: str) -> DataFrame:
    """id, n_edges, n_peers: scenes by the sources that instance them."""
    return stats.degree_ranking(current_project(spark, d), "instances", "target_id")


def g14_signal_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """id, n_edges, n_peers: emitters by what is connected to them."""
    return stats.degree_ranking(current_project(spark, d), "connects_signal", "source_id")


def g15_fragile_reach(spark: SparkSession, d: str) -> DataFrame:
    """unit, n, avg_distance, max_distance of node paths by folder."""
    return stats.fragile_reach(current_project(spark, d), graph.directory)


def g16_flow_patterns(spark: SparkSession, d: str) -> DataFrame:
    """signature, n_walks: walks by what they begin with, how far they go and what they end in."""
    p = current_project(spark, d)
    w = _walks(p)
    kinds = {}
    for way, test in (("ingress", F.col("direction") == "ingress"), ("egress", ~F.col("direction").eqNullSafe("ingress"))):
        one = p.boundaries.where(test & (F.col("node_id") != "")).select("node_id", "type").distinct()
        # the types are a fixed list: a set per node is bounded
        kinds[way] = one.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("type")), "+").alias(way))
    a = w.join(kinds["ingress"].withColumnRenamed("node_id", "start_id"), "start_id").join(kinds["egress"].withColumnRenamed("node_id", "end_id"), "end_id")
    return a.groupBy(F.concat_ws(" > ", "ingress", F.col("hops").cast("string"), "egress").alias("signature")).agg(F.count(F.lit(1)).alias("n_walks"))


def g17_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    """severity, rule, n over all rules."""
    return integrity.severity_counts(_findings(spark, d))


def g18_dependency_matrix(spark: SparkSession, d: str) -> DataFrame:
    """source_unit, target_unit, n_links between and within repositories."""
    _, ids, links = _graph(spark, d)
    return graph.crossings(_repositories(ids), links)


def g18_domain_summary(spark: SparkSession, d: str) -> DataFrame:
    """n_units, cross_links, avg_instability over repositories."""
    _, ids, links = _graph(spark, d)
    groups = _repositories(ids)
    cross = graph.crossings(groups, links).where("source_unit <> target_unit").agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("cross_links"))
    units = stats.coupling(groups, links).agg(F.count(F.lit(1)).alias("n_units"), F.round(F.avg(F.col("ce") / F.nullif(F.col("ca") + F.col("ce"), F.lit(0))), 4).alias("avg_instability"))
    both = cross.unionByName(units, allowMissingColumns=True)
    return both.agg(F.max("n_units").alias("n_units"), F.max("cross_links").alias("cross_links"), F.max("avg_instability").alias("avg_instability"))


def g19_impact_rings(spark: SparkSession, d: str) -> DataFrame:
    """depth, n, share: nodes by their distance to the node with the greatest fan-in, against the links."""
    p, ids, links = _graph(spark, d)
    met = graph.reach(links, _hub(p, ids, links, "fan_in"), reverse=True)
    return met.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / ids.select(F.count(F.lit(1))).scalar(), 6))


def g19_impact_domains(spark: SparkSession, d: str) -> DataFrame:
    """unit, n, share: what depends on the node with the greatest fan-in, by repository (null: shared concepts)."""
    p, ids, links = _graph(spark, d)
    met = graph.reach(links, _hub(p, ids, links, "fan_in"), reverse=True)
    return met.groupBy(keys.repository("id").alias("unit")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / ids.select(F.count(F.lit(1))).scalar(), 6))


def g20_overview(spark: SparkSession, d: str) -> DataFrame:
    """editor_edges, unresolved, findings."""
    p = integrity.materialised(current_project(spark, d))
    counts = p.edges.agg(F.count_if(F.col("origin") == "editor").alias("editor_edges"), F.count_if(~F.coalesce("resolved", F.lit(False))).alias("unresolved"))
    return counts.withColumn("findings", integrity.findings(p).select(F.count(F.lit(1))).scalar())


def r8_scopes(spark: SparkSession, d: str) -> DataFrame:
    """scope, source_id, target_id: the links of each scoped view."""
    p = current_project(spark, d)
    p = Project(p.nodes.select("id"), cut(p.edges.select("type", "source_id", "target_id"), "edges"), p.boundaries)
    out = [stats.graph_of(graph.scoped(p, name))[1].select(F.lit(name).alias("scope"), "source_id", "target_id") for name in graph.SCOPES]
    return reduce(DataFrame.unionByName, out)


def t1_top_fan_in(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, fan_in of the ten nodes with most."""
    return stats.ranking(current_project(spark, d), "fan_in", 10)


def t1_top_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, fan_out of the ten nodes with most."""
    return stats.ranking(current_project(spark, d), "fan_out", 10)


def t1_all_fan_in(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, fan_in of every node that has any."""
    return stats.ranking(current_project(spark, d), "fan_in", 0)


# ---- graph -------------------------------------------------------------------------------------


def r2_forward_reach(spark: SparkSession, d: str) -> DataFrame:
    """root, id, depth: all that the node with the greatest fan-out reaches."""
    p, ids, links = _graph(spark, d)
    return graph.reach(links, _hub(p, ids, links, "fan_out"))


def r2_forward_depth2(spark: SparkSession, d: str) -> DataFrame:
    """root, id, depth: what every scene reaches in two links."""
    p, _, links = _graph(spark, d)
    return graph.reach(links, p.nodes.where("kind = 'scene'").select(F.col("id").alias("root")), 2)


def r3_reverse_reach(spark: SparkSession, d: str) -> DataFrame:
    """root, id, depth: all that reaches the node with the greatest fan-in."""
    p, ids, links = _graph(spark, d)
    return graph.reach(links, _hub(p, ids, links, "fan_in"), reverse=True)


def r4_components(spark: SparkSession, d: str) -> DataFrame:
    """id, component_id, size of every node."""
    _, ids, links = _graph(spark, d)
    return graph.components(ids, links)


def r6_directories(spark: SparkSession, d: str) -> DataFrame:
    """source_id, target_id: links between folders."""
    _, ids, links = _graph(spark, d)
    return graph.project(_directories(ids), links)[1]


def r6_directory_vertices(spark: SparkSession, d: str) -> DataFrame:
    """id of every folder, those without links included."""
    _, ids, links = _graph(spark, d)
    return graph.project(_directories(ids), links)[0]


def r7_node_view(spark: SparkSession, d: str) -> DataFrame:
    """id, direction, type, peer, origin, resolved of all edges at the shared autoloads."""
    ids = table(spark, d, "shared_nodes").where("kind = 'autoload'").select("id")
    return graph.neighbours(current_project(spark, d).edges, ids).orderBy("id", "direction", "type", "peer")


def r8_focus(spark: SparkSession, d: str) -> DataFrame:
    """root, id, hops within two hops of the node with the greatest fan-out, over editor edges only."""
    p = current_project(spark, d)
    ids = p.nodes.select("id")
    from weftgraph.operators.fan import valid_links

    links = cut(valid_links(ids, p.edges.where("origin = 'editor'")), "links")
    return graph.focus(links, _hub(p, ids, links, "fan_out"), 2)


def _scene_flow(p: Project) -> tuple[DataFrame, DataFrame]:
    """(main scenes, links between scenes): a scene leads where the scripts in it change the scene to."""
    file = F.substring_index("source_id", "::", 1)
    target = F.regexp_replace(F.substring_index("target_id", "::", 1), "^res:(?=res://)", "")
    attached = p.edges.where("type = 'attaches_script'").select(file.alias("scene"), target.alias("script"))
    changes = p.edges.where("type = 'changes_scene_to'").select(file.alias("script"), target.alias("to"))
    scenes = p.nodes.where("kind = 'scene'")
    direct = changes.select(F.col("script").alias("source_id"), F.col("to").alias("target_id"))
    led = attached.distinct().join(changes.distinct(), "script").select(F.col("scene").alias("source_id"), F.col("to").alias("target_id"))
    from weftgraph.operators.fan import valid_links

    main = scenes.where(F.coalesce(F.get_json_object("identity", "$.main_scene"), F.get_json_object("identity", "$.mainScene")) == "true").select(F.col("id").alias("root"))
    return main, valid_links(scenes.select("id"), direct.unionByName(led))


def r9_scene_flow(spark: SparkSession, d: str) -> DataFrame:
    """root, id, depth: the scenes that each main scene leads to."""
    main, links = _scene_flow(current_project(spark, d))
    return graph.reach(links, main)


def _walks(p: Project) -> DataFrame:
    calls = p.edges.where("type = 'calls' and source_id <> target_id").select("source_id", "target_id")
    steps = cut(calls.distinct(), "calls")
    points = p.boundaries.where("node_id <> ''")
    return graph.walks(steps, points.where("direction = 'ingress'").select(F.col("node_id").alias("id")), points.where("not (direction <=> 'ingress')").select(F.col("node_id").alias("id")), WALK_HOPS)


def r10_walks(spark: SparkSession, d: str) -> DataFrame:
    """start_id, end_id, path, hops: ways of at most three calls from an ingress to an egress."""
    return _walks(current_project(spark, d))


def r11_communities(spark: SparkSession, d: str) -> DataFrame:
    """id, community_id: inferred domains, begun with the folders."""
    _, ids, links = _graph(spark, d)
    return graph.communities(ids, links, _directories(ids))


def r12_declared(spark: SparkSession, d: str) -> DataFrame:
    """source_id, target_id: links between declared domains."""
    _, ids, links = _graph(spark, d)
    return graph.project(graph.by_rules(ids, DOMAINS), links)[1]


def r13_unit_cycles(spark: SparkSession, d: str) -> DataFrame:
    """component_id, id, size of the folders on cycles."""
    _, ids, links = _graph(spark, d)
    return graph.cycles(*graph.project(_directories(ids), links))


def r14_sprawl(spark: SparkSession, d: str) -> DataFrame:
    """group, n, n_parts, purity, entropy: how folders spread over inferred domains."""
    _, ids, links = _graph(spark, d)
    found = graph.communities(ids, links, _directories(ids))
    return stats.sprawl(_directories(ids), found.select("id", F.col("community_id").alias("group")))


def r14_declared_sprawl(spark: SparkSession, d: str) -> DataFrame:
    """group, n, n_parts, purity, entropy: how declared domains spread over repositories."""
    ids = current_project(spark, d).nodes.select("id")
    return stats.sprawl(graph.by_rules(ids, DOMAINS), _repositories(ids))


def r15_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    """kind, n, on_cycle: what depends on the node with the greatest fan-in, by kind; whether that node lies on a cycle."""
    p, ids, links = _graph(spark, d)
    root = cut(_hub(p, ids, links, "fan_in"), "root")
    met = graph.reach(links, root, reverse=True)
    # the root lies on a cycle when it reaches one of its direct dependants' sources: itself again
    back = graph.reach(links, root).select("id").join(met.select("id"), "id", "left_semi").select(F.count(F.lit(1))).scalar()
    return met.join(p.nodes.select("id", "kind"), "id").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("on_cycle", back > 0)


# ---- joins ---------------------------------------------------------------------------------------


def j2_connections(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, emitter_id, signal, emitter_type, handler_script, method of editor connections (J-2, J-3)."""
    return resolve.connections(current_project(spark, d)).select("edge_id", "emitter_id", "signal", "emitter_type", "handler_script", "method")


def j5_resource_exists(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, type, target_id, exists."""
    return resolve.resource_targets(current_project(spark, d))


def j6_extends_path(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, source_id, target_id, exists."""
    return resolve.extends_targets(current_project(spark, d))


def j7_autoloads(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, source_id, target_id of accesses to registered autoloads."""
    return resolve.known_autoloads(current_project(spark, d))


def j8_local_calls(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, source_id, target_id of calls within a file."""
    return resolve.local_calls(current_project(spark, d))


def j13_match_keys(spark: SparkSession, d: str) -> DataFrame:
    """boundary_id, match_key, strategy, n_partners, partner_id, confidence."""
    return resolve.stitched(current_project(spark, d))


def j14_node_paths(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, source_id, path, n_owners, n_found, target_id, reason."""
    return resolve.node_paths(current_project(spark, d))


# ---- keys ---------------------------------------------------------------------------------------


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, path: normalised paths of the targets as they are written (P-1)."""
    return table(spark, d, "edges").select("edge_id", "loaded_at", keys.normalize_path("target_id").alias("path")).distinct()


def k_match_keys(spark: SparkSession, d: str) -> DataFrame:
    """id, signal_key, rpc_key, resource_key, action_key, group_key, autoload_key, nodepath_key made of node names (P-2 to P-6)."""
    n = F.get_json_object("identity", "$.name")
    owner = F.get_json_object("identity", "$.node_type")
    rows = current_project(spark, d).nodes
    return rows.select(
        "id", keys.signal_key(owner, n).alias("signal_key"), keys.rpc_key(owner, n).alias("rpc_key"), keys.resource_key("path").alias("resource_key"),
        keys.prefixed("action", n).alias("action_key"), keys.prefixed("group", n).alias("group_key"), keys.prefixed("autoload", n).alias("autoload_key"), keys.prefixed("nodepath", n).alias("nodepath_key"),
    )


def k_ids(spark: SparkSession, d: str) -> DataFrame:
    """id, file, symbol, signal, scene_node, class, ext, doc: ids built from the parts of a node (P-7)."""
    n, path = F.get_json_object("identity", "$.name"), F.col("path")
    return current_project(spark, d).nodes.select(
        "id", keys.file_id(path).alias("file"), keys.symbol_id(path, n).alias("symbol"), keys.signal_id(path, n).alias("signal"), keys.scene_node_id(path, n).alias("scene_node"),
        keys.concept_id("class", n).alias("class"), keys.extension_id(path).alias("ext"), keys.doc_id(path).alias("doc"),
    )


def k_parsed_ids(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, file, name: which form an id has, and its parts (P-8)."""
    s, g, n = keys.parse_symbol_id("id"), keys.parse_signal_id("id"), keys.parse_scene_node_id("id")
    form = F.when(g.isNotNull(), "signal").when(n.isNotNull(), "scene_node").when(s.isNotNull(), "symbol")
    x = F.coalesce(g, n, s)
    return current_project(spark, d).nodes.select("id", form.alias("form"), x["file"].alias("file"), x["name"].alias("name"))


def k_scene_paths(spark: SparkSession, d: str) -> DataFrame:
    """id, node_path: paths of scene nodes from parent and name (P-9)."""
    rows = current_project(spark, d).nodes.where("kind = 'scene_node'")
    return rows.select("id", keys.scene_path(F.get_json_object("identity", "$.parent"), F.get_json_object("identity", "$.name")).alias("node_path"))


def k_asset_types(spark: SparkSession, d: str) -> DataFrame:
    """resource_type, edge_type of the resource types in use (P-10)."""
    rows = current_project(spark, d).nodes.where("kind = 'resource'").select(F.get_json_object("identity", "$.resource_type").alias("resource_type")).where("resource_type is not null").distinct()
    return rows.select("resource_type", keys.asset_edge_type("resource_type").alias("edge_type"))


def k5_json(spark: SparkSession, d: str) -> DataFrame:
    """id, canonical: identity as JSON with sorted keys, null for null and empty (K-5)."""
    from weftgraph.operators.snapshot_diff import canonical_json

    return current_project(spark, d).nodes.select("id", F.when(F.trim("identity") != "", canonical_json("identity")).alias("canonical"))


def p19_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, tag: unresolved edges with how they are shown (P-19, P-20)."""
    return current_project(spark, d).unresolved().select("edge_id", F.lit(", unresolved").alias("tag"))


# ---- rules ---------------------------------------------------------------------------------------


def _findings(spark: SparkSession, d: str, *only: str) -> DataFrame:
    p = current_project(spark, d)
    return integrity.findings(p if only else integrity.materialised(p), only=only)


def one_rule(name: str, spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d, name)


def i_findings(spark: SparkSession, d: str) -> DataFrame:
    """All findings, in their order (T-7)."""
    return integrity.ordered(_findings(spark, d))


def i_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """node_id, edge_id, want, suggestion, distance."""
    p = current_project(spark, d)
    return integrity.suggestions(p, integrity.findings(p, only=("dangling_connection", "connection_to_missing_signal")))


def i_configured(spark: SparkSession, d: str) -> DataFrame:
    """severity, rule, n with one rule switched off, one made graver and one node suppressed."""
    s = integrity.Settings(disabled=frozenset(["orphan_asset"]), severity={"unused_group": "warning"}, suppress=(("unused_action", "action:jump"),))
    p = current_project(spark, d)
    return integrity.severity_counts(integrity.findings(p, s, ("orphan_asset", "unused_group", "unused_action", "undefined_action")))


#: Rules whose facts the tables hold; the others need edges that only extraction gives.
TABLE_RULES = (
    "dangling_connection", "connection_to_missing_signal", "undefined_action", "unused_action", "empty_group_call", "unused_group", "unresolved_load", "missing_resource", "unused_signal", "unhandled_signal",
    "fragile_nodepath", "nodepath_unresolved", "orphan_script", "orphan_scene", "orphan_asset", "orphan_layer", "per_frame_cost", "large_scene", "doc_uncovered_entity",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        g1_nodes_by_kind, g2_edges_by_type, g3_boundaries_by_direction, g4_breakdown, g5_totals, g8_order, g10_autoload_access, g11_stub_enrich, g12_signal_lists, g13_coupling, g14_autoload_fan_in, g14_instance_fan_in,
        g14_signal_fan_out, g15_fragile_reach, g16_flow_patterns, g17_severity_counts, g18_dependency_matrix, g18_domain_summary, g19_impact_rings, g19_impact_domains, g20_overview, t1_top_fan_in, t1_top_fan_out, t1_all_fan_in,
        r2_forward_reach, r2_forward_depth2, r3_reverse_reach, r4_components, r6_directories, r6_directory_vertices, r7_node_view, r8_focus, r8_scopes, r9_scene_flow, r10_walks, r11_communities, r12_declared, r13_unit_cycles, r14_sprawl,
        r14_declared_sprawl, r15_blast_radius, j2_connections, j5_resource_exists, j6_extends_path, j7_autoloads, j8_local_calls, j13_match_keys, j14_node_paths,
        k_match_keys, k_ids, k_parsed_ids, k_scene_paths, k_asset_types, k5_json, i_findings, i_suggestions, i_configured,
    ]
    out = {f.__name__: f for f in named}
    # p1_ and p19_ would read as problems 1 and 19
    out |= {"k_normalized_paths": p1_paths, "k_unresolved": p19_unresolved}
    return out | {f"i_{name}": partial(one_rule, name) for name in TABLE_RULES}
