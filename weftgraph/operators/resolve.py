"""Stitching: from match keys to the nodes that they mean.

Equal keys link; a ``*`` for the owner of a signal or a remote call matches any owner.  Links between boundary
points are many-to-many, so results are one row per point with the number of its partners and the
smallest one, never the pairs.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.globs import glob_regex
from weftgraph.plans.skew import left_join
from weftgraph.project import Project


def _parts(key: str) -> tuple[Column, Column, Column]:
    """(scheme, owner, name) of a ``signal:`` or ``rpc:`` key."""
    c = F.col(key)
    scheme = F.substring_index(c, ":", 1)
    rest = F.substring(c, F.length(scheme) + 2, F.lit(1 << 30))
    owner = F.substring_index(rest, ":", 1)
    return scheme, owner, F.substring(rest, F.length(owner) + 2, F.lit(1 << 30))


def stitched(p: Project) -> DataFrame:
    """boundary_id, match_key, strategy, n_partners, partner_id, confidence of every egress point with a key.

    Partners are ingress points: of the same key (exact, 1.0), else of the same name where either owner is
    ``*`` (variant, 0.7); none gives strategy ``none`` and confidence 0.  ``partner_id`` is the smallest
    node id among them.
    """
    rows = p.boundaries.where("match_key is not null and match_key <> ''").select("boundary_id", "direction", "node_id", "match_key")
    inner = rows.where("direction = 'ingress'")
    scheme, owner, name = _parts("match_key")
    open_ = (F.col("match_key").startswith("signal:") | F.col("match_key").startswith("rpc:")) & (F.size(F.split("match_key", ":")) >= 3)
    node = F.nullif("node_id", F.lit(""))
    exact = inner.groupBy("match_key").agg(F.count(F.lit(1)).alias("n_exact"), F.min(node).alias("exact_id"))
    named = inner.where(open_).select(scheme.alias("scheme"), name.alias("name"), (owner == "*").alias("wild"), node.alias("node"))
    by_name = named.groupBy("scheme", "name").agg(F.count(F.lit(1)).alias("n_all"), F.min("node").alias("all_id"), F.count_if("wild").alias("n_wild"), F.min(F.when(F.col("wild"), F.col("node"))).alias("wild_id"))
    out = rows.where("not (direction <=> 'ingress')").withColumn("scheme", F.when(open_, scheme)).withColumn("name", F.when(open_, name)).withColumn("star", F.when(open_, owner == "*"))
    x = left_join(out, exact, "match_key", "boundary_id")
    x = x.withColumn("sn", F.concat_ws(":", "scheme", "name"))
    key = by_name.select(F.concat_ws(":", "scheme", "name").alias("sn"), "n_all", "all_id", "n_wild", "wild_id")
    x = left_join(x.where("scheme is not null"), key, "sn", "boundary_id").unionByName(x.where("scheme is null"), allowMissingColumns=True)
    # a point with a star means any owner, one with an owner also the starred ones
    n_variant = F.coalesce(F.when(F.col("star"), F.col("n_all")).otherwise(F.col("n_wild")), F.lit(0))
    variant_id = F.when(F.col("star"), F.col("all_id")).otherwise(F.col("wild_id"))
    strategy = F.when(F.col("n_exact") > 0, "exact").when(n_variant > 0, "variant").otherwise("none")
    return x.select("boundary_id", "match_key", strategy.alias("strategy"), F.when(F.col("n_exact") > 0, F.col("n_exact")).otherwise(n_variant).alias("n_partners"), F.when(F.col("n_exact") > 0, F.col("exact_id")).when(n_variant > 0, variant_id).alias("partner_id")).withColumn(
        "confidence", F.when(F.col("strategy") == "exact", 1.0).when(F.col("strategy") == "variant", 0.7).otherwise(0.0)
    )


def _climbed(base: Column, path: Column) -> Column:
    """A node path from ``base`` (a path in the scene, ``.`` for its root), null when it climbs over the root."""
    start = F.when(base == ".", F.array().cast("array<string>")).otherwise(F.split(base, "/"))
    steps = F.split(path, "/")
    walked = F.aggregate(
        steps,
        start,
        lambda acc, x: F.when(acc.isNull() | (x == "") | (x == "."), acc)
        .when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(F.size(walked) == 0, F.lit(".")).otherwise(F.array_join(walked, "/"))


def node_paths(p: Project) -> DataFrame:
    """edge_id, source_id, path, n_owners, n_found, target_id, reason of every reference by node path.

    A path starts at the scene node that makes the reference or, from a script, at every scene node that
    the script is attached to; ``%Name`` finds the nodes of that name in the scene; a path that begins with ``/`` is
    outside of any scene.  ``reason``: null when some owner finds its node, else ``no_owner``, ``absolute`` or
    ``nodepath_unresolved``.  ``target_id`` is the smallest node found.
    """
    refs = p.edges.where("type = 'references_node' and target_id like 'nodepath:%'").select("edge_id", "source_id", F.substring("target_id", 10, 1 << 30).alias("path"))
    nodes = p.nodes.where("kind = 'scene_node'").select("id")
    attached = p.edges.where("type = 'attaches_script' and source_id like '%::%'").select(F.substring_index("target_id", "::", 1).alias("script"), F.col("source_id").alias("owner"))
    by_script = attached.join(nodes.withColumnRenamed("id", "owner"), "owner", "left_semi").distinct()
    file = F.substring_index("source_id", "::", 1)
    scene = file.endswith(".tscn") | file.endswith(".scn")
    own = refs.where(scene).withColumn("owner", F.when(F.instr("source_id", "::") > 0, F.col("source_id")).otherwise(F.concat("source_id", F.lit("::."))))
    code = refs.where(~scene).withColumn("script", file)
    code = left_join(code, by_script, "script", "edge_id").drop("script")
    starts = own.unionByName(code)
    head = F.substring_index("owner", "::", 1)
    base = F.substring(F.col("owner"), F.length(head) + 3, F.lit(1 << 30))
    plain = ~F.col("path").startswith("%") & ~F.col("path").startswith("/")
    wanted = F.when(plain, F.concat(head, F.lit("::"), _climbed(base, F.col("path"))))
    unique = F.when(F.col("path").startswith("%"), F.concat(head, F.lit("::%"), F.regexp_extract("path", r"^%([^/]+)", 1)))
    asked = starts.withColumn("want", F.coalesce(wanted, unique))
    name = F.substring_index(F.substring_index("id", "::", -1), "/", -1)
    known = nodes.select(F.col("id").alias("want"), F.col("id").alias("hit")).unionByName(nodes.select(F.concat(F.substring_index("id", "::", 1), F.lit("::%"), name).alias("want"), F.col("id").alias("hit")).groupBy("want").agg(F.min("hit").alias("hit")))
    met = left_join(asked, known, "want", "edge_id")
    got = met.groupBy("edge_id", "source_id", "path").agg(F.count_distinct("owner").alias("n_owners"), F.count("hit").alias("n_found"), F.min("hit").alias("target_id"))
    reason = F.when(F.col("n_found") > 0, None).when(F.col("path").startswith("/"), "absolute").when(F.col("n_owners") == 0, "no_owner").otherwise("nodepath_unresolved")
    return got.withColumn("reason", reason)


def resource_targets(p: Project) -> DataFrame:
    """edge_id, type, target_id, exists of loads and scene changes: whether the path names a node.

    An edge whose target is null or empty is dynamic; it exists nowhere.
    """
    rows = p.edges.where("type in ('loads_resource', 'changes_scene_to')").select("edge_id", "type", F.col("target_id"))
    known = p.nodes.select(F.col("id").alias("target_id"), F.lit(True).alias("found"))
    return left_join(rows, known, "target_id", "edge_id").select("edge_id", "type", "target_id", F.coalesce("found", F.lit(False)).alias("exists"))


def extends_targets(p: Project) -> DataFrame:
    """edge_id, source_id, target_id, exists of every base that is named by path."""
    rows = p.edges.where("type = 'extends' and target_id like 'res://%'").select("edge_id", "source_id", "target_id")
    known = p.nodes.select(F.col("id").alias("target_id"), F.lit(True).alias("found"))
    return left_join(rows, known, "target_id", "edge_id").select("edge_id", "source_id", "target_id", F.coalesce("found", F.lit(False)).alias("exists"))


def local_calls(p: Project) -> DataFrame:
    """edge_id, source_id, target_id of calls whose target is a method of the same file."""
    rows = p.edges.where("type = 'calls'").where(F.substring_index("source_id", "::", 1) == F.substring_index("target_id", "::", 1)).select("edge_id", "source_id", "target_id")
    methods = p.nodes.where("kind = 'method'").select(F.col("id").alias("target_id"), F.lit(True).alias("found"))
    return left_join(rows, methods, "target_id", "edge_id").where("found").drop("found")


def known_autoloads(p: Project) -> DataFrame:
    """edge_id, source_id, target_id of accesses whose autoload is registered."""
    rows = p.edges.where("type = 'accesses_autoload'").select("edge_id", "source_id", "target_id")
    names = p.nodes.where("kind = 'autoload'").select(F.col("id").alias("target_id"), F.lit(True).alias("found"))
    return left_join(rows, names, "target_id", "edge_id").where("found").drop("found")


def connections(p: Project) -> DataFrame:
    """edge_id, emitter_id, signal, emitter_type, handler_script, method of every editor connection.

    The emitter's type comes from its scene node (``*`` if unknown), the handler's script from the target.
    """
    rows = p.edges.where("type = 'connects_signal' and origin = 'editor'")
    kept = rows.select("edge_id", F.col("source_id").alias("emitter_id"), F.get_json_object("properties", "$.signal").alias("signal"), F.get_json_object("properties", "$.method").alias("method"), F.substring_index("target_id", "::", 1).alias("handler_script"))
    types = p.nodes.where("kind = 'scene_node'").select(F.col("id").alias("emitter_id"), F.get_json_object("identity", "$.node_type").alias("t"))
    return left_join(kept, types, "emitter_id", "edge_id").withColumn("emitter_type", F.coalesce(F.nullif("t", F.lit("")), F.lit("*"))).drop("t")




def hinted(p: Project, hints: dict[str, str]) -> Project:
    """The project with edges for dynamic loads that a hint explains.

    A hint says which files (a glob over ids) an expression that contains a text may mean; it is a setting, so
    there are few.  The dynamic edge stays; each file that a hint allows gets an edge of the same type with
    confidence 0.7.  An expression is compared with each hint, never with each file.
    """
    usable = [(text, regex) for text, glob in hints.items() if (regex := glob_regex(glob))]
    if not usable:
        return p
    expr = F.get_json_object("properties", "$.expr")
    asked = p.edges.where(F.col("type").isin("loads_resource", "changes_scene_to")).where(F.get_json_object("properties", "$.dynamic") == "true").withColumn("expr", expr)
    asked = asked.withColumn("hint", F.explode(F.filter(F.array(*[F.lit(t) for t, _ in usable]), lambda t: F.col("expr").contains(t))))
    files = p.nodes.select(F.col("id").alias("file"), F.explode(F.filter(F.array(*[F.struct(F.lit(t).alias("hint"), F.col("id").rlike(r).alias("ok")) for t, r in usable]), lambda x: x["ok"])).alias("x")).select("file", "x.hint")
    met = asked.join(files, "hint")
    more = met.select(
        F.xxhash64("edge_id", "file").alias("edge_id"), "type", "source_id", F.concat(F.lit("res:"), "file").alias("target_id"), "origin", F.lit(True).alias("resolved"), F.lit(0.7).alias("confidence"), "ev_file", "ev_line",
        F.to_json(F.struct(F.lit("hint").alias("via"), "hint")).alias("properties"),
    )
    return replace(p, edges=p.edges.unionByName(more))
