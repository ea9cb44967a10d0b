"""Parents of scene nodes and scripts, as the hierarchy operator wants them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import RES, canonical_key, clean_node_path, trim_ws
from weftgraph.operators.current import current_rows
from weftgraph.operators.hierarchy import Hierarchy, peel
from weftgraph.plans.materialize import cut

_IDENTITY = "scene string, parent string, extends string, script string, name string"


def node_links(nodes: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, parent_id, block, part, label) and the class index (name, node_id).

    A scene node names its parent within its scene, a script or a script-less class its base by path
    or class name; a class with a script stands for that script and is no link itself.  Identity that
    is null or not a JSON object gives no parent.  Columns other than those read are ignored.
    """
    cols = ["id", "kind", "identity", "removed_at", "loaded_at"]
    both = nodes.select(*cols).unionByName(shared.select(*cols)).withColumn("i", F.from_json("identity", _IDENTITY))
    base = F.col("i.extends")
    key = canonical_key(base)
    by_path = F.when(base.contains(RES), F.when(key.startswith(RES), key))
    ancestor = F.coalesce(by_path, F.concat(F.lit("class:"), trim_ws(base)))
    inside = F.concat(F.col("i.scene"), F.lit("::"), clean_node_path(F.col("i.parent")))
    script = canonical_key(F.col("i.script"))
    is_alias = (F.col("kind") == "class") & F.col("i.script").isNotNull()
    parent = F.when(F.col("kind") == "scene_node", inside).when((F.col("kind") == "script") | ((F.col("kind") == "class") & F.col("i.script").isNull()), ancestor)
    # nodes of one repository, and all that has none, probably belong together
    block = F.coalesce(F.regexp_extract("id", r"^res://([^/]*)/", 1), F.lit(""))
    label = F.coalesce(F.col("i.name"), F.substring_index(F.substring_index(F.col("id"), "::", -1), "/", -1))
    slim = both.select(F.col("id").alias("node_id"), parent.alias("parent_id"), F.when(is_alias, script).alias("stands_for"), block.alias("block"), F.substring_index("id", "::", 1).alias("part"), label.alias("label"), F.col("removed_at").isNotNull().alias("gone"), "loaded_at")
    live = current_rows(slim, ["node_id"]).where("not gone").drop("gone", "loaded_at")
    live = cut(live, "live")
    index = live.where("stands_for is not null").select(F.col("node_id").alias("name"), F.col("stands_for").alias("node_id"))
    return live.drop("stands_for"), index


def node_hierarchy(nodes: DataFrame, shared: DataFrame, with_paths: bool = False) -> Hierarchy:
    links, index = node_links(nodes, shared)
    return peel(links, index, with_paths)
