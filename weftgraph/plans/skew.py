"""Joins that stay even when a few keys hold a large share of the rows.

``heavy_keys`` finds the keys above a share of the rows with a map-side combined count; by
definition there are at most ``1 / share`` of them, which bounds what is broadcast.
``spread_left_join`` deals the rows of those keys over ``salts`` buckets and repeats only their
partners, so no task gets a whole hot group and nothing is dropped or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.materialize import cut

SHARE = 0.01
SALTS = 16
#: Rows that any task can hold and sort: no key of so few is too hot.
SMALL = 200_000


def heavy_keys(df: DataFrame, key: str, share: float = SHARE) -> list:
    """Values of ``key`` with at least ``share`` of the non-null rows (at most ``1/share`` values)."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.orderBy(F.desc("n")).limit(int(1 / share)).collect()
    if len(rows) < int(1 / share):
        total = sum(r["n"] for r in rows)  # these are all keys
    else:
        total = df.where(F.col(key).isNotNull()).count()
    return [r[0] for r in rows if r["n"] >= share * total]


def spread_left_join(left: DataFrame, right: DataFrame, key: str, spread: str, heavy: list, salts: int = SALTS) -> DataFrame:
    """``left`` left-joined with ``right`` on ``key``; rows of heavy keys are dealt by ``spread``.

    ``right`` may have several rows of a key; rows of ``left`` with a null key are kept.
    """
    if not heavy:
        return left.join(right, key, "left")
    hot = F.col(key).isin(heavy)
    salted = left.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn("_salt", F.explode(copies))
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")


def left_join(left: DataFrame, right: DataFrame, key: str, spread: str, small: int = SMALL) -> DataFrame:
    """``spread_left_join`` whose heavy keys are those of ``left``, which is written once for both uses.

    A ``left`` of at most ``small`` rows is one task's work whatever its keys, so nothing is dealt; the
    rows are the same.
    """
    kept = left if hasattr(left, "_weft_path") else cut(left, "left")
    if kept.count() <= small:  # from the footers of the written files
        return kept.join(right, key, "left")
    return spread_left_join(kept, right, key, spread, heavy_keys(kept, key))
