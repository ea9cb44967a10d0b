"""What changed between full snapshots: a full outer join on the primary key.

Each record becomes (key, snapshot, 128-bit hash of its canonical content, confidence), once, in a
written table.  A snapshot as the older side and the next one as the newer meet in one full outer
join on (key, pair) for all pairs at once: a missing side is an addition or a removal, unequal hashes
are a change.  The next snapshot is the next number that was delivered, so a gap in the numbers is no
empty snapshot.  The older side is keyed by the number that follows its own before anything is
shuffled, so the exchange that finds the latest delivery also serves the join: two exchanges in all.

Defined results: within a snapshot the row delivered last counts (equal times: the one with the
greater hash, then the greater confidence); null equals '', 0 and, for identity, ``{}``; a null
confidence equals 1.0, and confidences nearer than 1e-6 are equal; identity is compared as a JSON value
(key order and white space do not matter, 1 equals 1.0, but a number with an exponent is its own
value; text that is no JSON, duplicate keys included, is compared as it is).  Rows with a null
key or snapshot number are ignored; an empty table gives no rows; so does a single snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import canonical_key
from weftgraph.plans.materialize import cut

EPSILON = 1e-6


def canonical_json(value: str) -> Column:
    """JSON text in one form: sorted keys, no blanks, ``{}`` for null; other text stays as it is."""
    c = F.col(value)
    return F.coalesce(F.to_json(F.try_parse_json(c)), F.nullif(F.trim(c), F.lit("")), F.lit("{}"))


def _content_hash(*parts: Column) -> Column:
    # a separator that no part contains would not be certain: lengths go in, too
    framed = [p for x in parts for p in (F.length(x).cast("string"), F.lit(":"), x)]
    return F.unhex(F.md5(F.concat(*framed)))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("0"))


def node_states(df: DataFrame) -> DataFrame:
    content = _content_hash(_text("kind"), _text("path"), _number("line"), canonical_json("identity"))
    return df.select("snapshot_no", "delivered_at", canonical_key("id").alias("node_id"), content.alias("content"))


def edge_states(df: DataFrame) -> DataFrame:
    flag = F.coalesce(F.col("resolved"), F.lit(False)).cast("string")
    content = _content_hash(_text("origin"), flag, _text("ev_file"), _number("ev_line"))
    keys = [F.coalesce(x, F.lit("")).alias(n) for x, n in ((F.col("type"), "edge_type"), (canonical_key("source_id"), "source_id"), (canonical_key("target_id"), "target_id"))]
    return df.select("snapshot_no", "delivered_at", *keys, content.alias("content"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def snapshot_changes(states: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, snapshot_no (the later one) and change, for each snapshot and the next."""
    extra = [c for c in ("content", "confidence") if c in states.columns]
    ok = states.where(F.col("snapshot_no").isNotNull() & F.col(keys[0]).isNotNull()).withColumn("kh", F.xxhash64(*keys))
    ok = cut(ok, "states")
    numbers = [r[0] for r in ok.select("snapshot_no").distinct().orderBy("snapshot_no").collect()]  # one number per delivery
    following = F.lit(None).cast("int")
    for older, newer in zip(numbers, numbers[1:]):
        following = F.when(F.col("snapshot_no") == older, newer).otherwise(following)

    def side(pair: Column, tag: str) -> DataFrame:
        rows = ok.select("kh", *keys, pair.alias("pair"), "delivered_at", *extra).where(F.col("pair").isNotNull())
        w = Window.partitionBy("kh", *keys, "pair").orderBy(F.col("delivered_at").desc_nulls_last(), *[F.desc(c) for c in extra])
        kept = rows.withColumn("_before", F.lag(F.lit(1)).over(w)).where("_before is null")
        return kept.select("kh", *keys, "pair", *[F.col(c).alias(f"{tag}_{c}") for c in extra])

    newer = F.when(F.col("snapshot_no") > (numbers[0] if numbers else 0), F.col("snapshot_no"))
    both = side(following, "old").join(side(newer, "new"), ["kh", *keys, "pair"], "full_outer")
    differs = F.col("old_content") != F.col("new_content")
    if "confidence" in extra:
        differs = differs | (F.abs(F.col("old_confidence") - F.col("new_confidence")) >= EPSILON)
    change = F.when(F.col("old_content").isNull(), "added").when(F.col("new_content").isNull(), "removed").when(differs, "changed")
    return both.select(*keys, F.col("pair").cast("int").alias("snapshot_no"), change.alias("change")).where("change is not null")


def graph_changes(node_snapshots: DataFrame, edge_snapshots: DataFrame) -> DataFrame:
    """entity, snapshot_no, node_id, edge_type, source_id, target_id, change."""
    none = F.lit("")
    out = []
    for entity, states, keys in (("node", node_states(node_snapshots), ["node_id"]), ("edge", edge_states(edge_snapshots), ["edge_type", "source_id", "target_id"])):
        rows = snapshot_changes(states, keys)
        cols = [(F.col(c) if c in keys else none).alias(c) for c in ("node_id", "edge_type", "source_id", "target_id")]
        out.append(rows.select(F.lit(entity).alias("entity"), "snapshot_no", *cols, "change"))
    return out[0].unionByName(out[1])
