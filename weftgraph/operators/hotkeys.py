"""Per-key results when a few keys hold most rows: map-side combining.

Each task folds its rows into a hash table of (endpoint, key, type, origin) states - count, first
and last time - which spills when it outgrows its memory; only those partial states are shuffled by
key.  So a key with a third of all rows reaches the reducer as a handful of rows per map task, and no
task gets its records.  Spark's two-phase aggregate of algebraic functions is exactly that operator.
The edges themselves cross one exchange before, by their own ids, which finds their current versions.

Defined results: keys are canonical; null keys are kept as a group of their own (they count into the
totals); copies and superseded versions of an edge count once; null type and origin are groups of
their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import canonical_key
from weftgraph.operators.current import current_rows


def endpoint_states(edges: DataFrame) -> DataFrame:
    """endpoint, key_id, type, origin, n_edges, first_observed_at, last_observed_at."""
    slim = edges.select("edge_id", "type", "origin", "observed_at", "loaded_at", canonical_key("source_id").alias("source"), canonical_key("target_id").alias("target"))
    ends = current_rows(slim, ["edge_id"]).select(
        "type", "origin", "observed_at", F.explode(F.array(F.struct(F.lit("source").alias("endpoint"), F.col("source").alias("key_id")), F.struct(F.lit("target").alias("endpoint"), F.col("target").alias("key_id")))).alias("e")
    )
    return (
        ends.groupBy("e.endpoint", "e.key_id", "type", "origin")
        .agg(F.count(F.lit(1)).alias("n_edges"), F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"))
        .select("endpoint", "key_id", "type", "origin", "n_edges", "first_observed_at", "last_observed_at")
    )


def key_totals(states: DataFrame) -> DataFrame:
    """endpoint, key_id, n_edges, first_observed_at, last_observed_at: the states merged once more."""
    return states.groupBy("endpoint", "key_id").agg(F.sum("n_edges").alias("n_edges"), F.min("first_observed_at").alias("first_observed_at"), F.max("last_observed_at").alias("last_observed_at"))


def heavy_endpoints(states: DataFrame, share: float = 0.02) -> DataFrame:
    """endpoint, key_id of the non-null keys with at least ``share`` of all edges at that endpoint.

    Each edge counts once at either endpoint, null keys included, so the number of edges is half the
    sum of all totals: the same exchange serves the total and the keys, and the edges are read once.
    """
    totals = states.groupBy("endpoint", "key_id").agg(F.sum("n_edges").alias("n_edges"))
    ends = totals.select(F.sum("n_edges")).scalar()
    # one predicate on the sum, as a filter on the key would move below the exchange of one side only
    named = F.when(F.col("key_id").isNotNull(), F.col("n_edges"))
    return totals.where(named * 2 >= ends * F.lit(share)).select("endpoint", "key_id")
