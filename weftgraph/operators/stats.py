"""Counts and rankings of a project.

All of them are algebraic aggregates with map-side combining: what is shuffled is one row per group and
task.  Null kinds, types and directions are groups of their own; an empty project gives totals of zero
and no groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.fan import fan, valid_links
from weftgraph.plans.skew import left_join
from weftgraph.project import Project

def count_by(df: DataFrame, column: str) -> DataFrame:
    """``column``, n."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def directions(p: Project) -> DataFrame:
    """ingress, egress: one row; what is not ingress counts as egress."""
    into = F.coalesce(F.col("direction") == "ingress", F.lit(False))
    return p.boundaries.agg(F.count_if(into).alias("ingress"), F.count_if(~into).alias("egress"))


def totals(p: Project) -> DataFrame:
    """nodes, edges, boundaries, unresolved: one row, from one pass over each table."""
    n = F.count(F.lit(1))
    unresolved = F.count_if(~F.coalesce("resolved", F.lit(False))).alias("unresolved")
    a = p.nodes.agg(n.alias("nodes"))
    b = p.edges.agg(n.alias("edges"), unresolved)
    c = p.boundaries.agg(n.alias("boundaries"))
    rows = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return rows.agg(*[F.max(x).alias(x) for x in ("nodes", "edges", "boundaries", "unresolved")])


def breakdown(p: Project) -> DataFrame:
    """section, key, n: nodes by kind, edges by type, boundaries by direction; nothing that is zero."""
    into = F.when(F.col("direction") == "ingress", "ingress").otherwise("egress")
    parts = [("boundaries", p.boundaries.select(into.alias("key"))), ("edges", p.edges.select(F.col("type").alias("key"))), ("nodes", p.nodes.select(F.col("kind").alias("key")))]
    rows = None
    for section, df in parts:
        one = count_by(df, "key").select(F.lit(section).alias("section"), "key", "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.orderBy("section", "key")


def graph_of(p: Project) -> tuple[DataFrame, DataFrame]:
    """(vertices, links): all nodes; distinct pairs of different nodes joined by an edge, whatever ``resolved`` says."""
    ids = p.nodes.select("id")
    return ids, valid_links(ids, p.edges)


def ranking(p: Project, by: str = "fan_in", top: int = 10) -> DataFrame:
    """id, kind, fan_in (or fan_out): nodes with at least one, the greatest first, ties by id.

    ``top`` of 0 or less gives all.
    """
    ids, links = graph_of(p)
    degrees = fan(ids, links).withColumnRenamed("node_id", "id").where(F.col(by) > 0)
    ranked = degrees.select("id", F.col(by).alias(by)).join(p.nodes.select("id", "kind"), "id").select("id", "kind", by).orderBy(F.desc(by), "id")
    return ranked.limit(top) if top > 0 else ranked


def degree_ranking(p: Project, edge_type: str, end: str, target_prefix: str = "") -> DataFrame:
    """id, n_edges, n_peers by one edge type, at one end, the most peers first.

    Leaderboards: autoloads by who reads them, scenes by who instances them, signals by who listens.
    """
    other = "source_id" if end == "target_id" else "target_id"
    kept = p.edges.where((F.col("type") == edge_type) & F.col(end).startswith(target_prefix))
    # two steps, so that the peers of a hub are counted from distinct pairs and not in one task's set
    pairs = kept.groupBy(F.col(end).alias("id"), F.col(other).alias("peer")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("id").agg(F.sum("n").alias("n_edges"), F.count("peer").alias("n_peers")).orderBy(F.desc("n_peers"), "id")


def first_access(p: Project) -> DataFrame:
    """owner_id, autoload_id, first_line, n_accesses: accesses of an autoload, once per owner."""
    kept = p.edges.where("type = 'accesses_autoload'")
    return kept.groupBy(F.col("source_id").alias("owner_id"), F.col("target_id").alias("autoload_id")).agg(F.min("ev_line").alias("first_line"), F.count(F.lit(1)).alias("n_accesses"))


def enriched_classes(p: Project) -> DataFrame:
    """class_id, script, n_mentions: a class is known from its first mention; its declaration adds the script.

    Mentions are targets of ``extends`` edges, declarations are class nodes; either may come first or alone.
    """
    mentions = p.edges.where(F.col("type") == "extends").where(F.col("target_id").startswith("class:")).select(F.col("target_id").alias("class_id"), F.lit(None).cast("string").alias("script"), F.lit(1).alias("mention"))
    declared = p.nodes.where("kind = 'class'").select(F.col("id").alias("class_id"), F.get_json_object("identity", "$.script").alias("script"), F.lit(0).alias("mention"))
    return mentions.unionByName(declared).groupBy("class_id").agg(F.max("script").alias("script"), F.sum("mention").cast("long").alias("n_mentions"))


def signal_lists(p: Project) -> DataFrame:
    """script, signals: the names that a script declares, in the order of their lines (then by name), joined by ','.

    A list is as long as a file has declarations.
    """
    rows = p.nodes.where("kind = 'signal'").select(F.get_json_object("identity", "$.script").alias("script"), F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.get_json_object("identity", "$.name").alias("name")).alias("x"))
    return rows.where("script is not null").groupBy("script").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]), ",").alias("signals"))


def layers(p: Project) -> DataFrame:
    """index, names: every layer with the names of its categories, from layer nodes."""
    rows = p.nodes.where("kind = 'layer'")
    return rows.select(F.substring_index("id", ":", -1).alias("index"), F.coalesce(F.get_json_object("identity", "$.names"), F.get_json_object("identity", "$.name")).alias("names"))


# ---- units -----------------------------------------------------------------------------------


def coupling(groups: DataFrame, links: DataFrame) -> DataFrame:
    """unit, ca, ce, instability: nodes outside that depend on the unit, nodes outside it depends on, ce / (ca + ce).

    A unit without either has no instability (null).
    """
    of = groups.where("group is not null")
    a = of.select(F.col("id").alias("source_id"), F.col("group").alias("a"))
    b = of.select(F.col("id").alias("target_id"), F.col("group").alias("b"))
    x = left_join(links, a, "source_id", "target_id").where("a is not null")
    x = left_join(x, b, "target_id", "source_id").where("b is not null and a <> b")
    # distinct outer nodes, by explicit pairs: a sum of ones shuffles partial counts only
    into = x.select(F.col("b").alias("unit"), F.lit("ca").alias("side"), F.col("source_id").alias("n"))
    out = x.select(F.col("a").alias("unit"), F.lit("ce").alias("side"), F.col("target_id").alias("n"))
    pairs = into.unionByName(out).distinct()
    every = of.select(F.col("group").alias("unit")).distinct().select("unit", F.lit(None).cast("string").alias("side"))
    c = pairs.select("unit", "side").unionByName(every).groupBy("unit").agg(F.count_if(F.col("side") == "ca").alias("ca"), F.count_if(F.col("side") == "ce").alias("ce"))
    return c.withColumn("instability", F.round(F.col("ce") / F.nullif(F.col("ca") + F.col("ce"), F.lit(0)), 4))


def fragile_reach(p: Project, unit) -> DataFrame:
    """unit, n, avg_distance, max_distance of node paths, by the unit of their source; distance counts the steps up."""
    from weftgraph.functions.keys import path_distance

    kept = p.edges.where("type = 'references_node' and target_id like 'nodepath:%'").select(unit("source_id").alias("unit"), path_distance(F.substring("target_id", 10, 1 << 30)).cast("long").alias("d"))
    return kept.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 4).alias("avg_distance"), F.max("d").alias("max_distance"))


def sprawl(first: DataFrame, second: DataFrame) -> DataFrame:
    """group, n, n_parts, purity, entropy: how the members of each ``first`` group spread over ``second`` groups.

    Purity is the share of the greatest part; entropy is in bits.  Both sides: id, group.
    """
    both = first.where("group is not null").join(second.select("id", F.col("group").alias("part")), "id")
    parts = both.groupBy("group", "part").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("group")
    share = parts.withColumn("p", F.col("k") / F.sum("k").over(w))
    return share.groupBy("group").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_parts"), F.round(F.max("p"), 4).alias("purity"), F.round(-F.sum(F.col("p") * F.log2("p")) + 0.0, 4).alias("entropy"))
