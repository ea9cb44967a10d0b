"""The graph of the records and the degrees of its nodes (R-1 and R-5 of SURVEY section 2.9).

Vertices are the ids whose current row is not removed.  A link is an ordered pair of different vertices
that some current edge joins, by canonical keys, whatever ``resolved`` says; parallel edges are one
link and self-loops none.  Keys with a large share of the links are dealt over salted buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import canonical_key
from weftgraph.operators.current import current_rows
from weftgraph.plans.materialize import cut
from weftgraph.plans.skew import SMALL, left_join


def vertices(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """id of every record that is there now."""
    rows = nodes.select("id", "removed_at", "loaded_at").unionByName(shared.select("id", "removed_at", "loaded_at")).where("id is not null")
    return current_rows(rows, ["id"]).where("removed_at is null").select("id")


def links(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, target_id of every link, from versioned edges."""
    now = current_rows(edges.select("edge_id", "source_id", "target_id", "loaded_at"), ["edge_id"])
    return valid_links(ids, now.select(canonical_key("source_id").alias("source_id"), canonical_key("target_id").alias("target_id")))


def valid_links(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct pairs of different ids in ``edges`` (source_id, target_id) that are both vertices."""
    pairs = cut(edges.select("source_id", "target_id").where("source_id <> target_id").distinct(), "pairs")
    ends = (("source_id", "target_id"), ("target_id", "source_id"))
    if pairs.count() <= SMALL:
        for end, _ in ends:
            pairs = pairs.join(ids.select(F.col("id").alias(end)), end, "left_semi").select("source_id", "target_id")
        return pairs
    for end, other in ends:
        there = ids.select(F.col("id").alias(end), F.lit(True).alias("there"))
        pairs = left_join(pairs, there, end, other).where("there").select("source_id", "target_id")
    return pairs


def fan(ids: DataFrame, found: DataFrame) -> DataFrame:
    """node_id, fan_in, fan_out of every vertex, those without links included."""
    ends = found.select(F.explode(F.array(F.struct(F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    every = ends.select("e.*").unionByName(ids.select(F.col("id").alias("node_id"), F.lit(0).alias("i"), F.lit(0).alias("o")))
    return every.groupBy("node_id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
