"""Orphan references of growing tables.

References and records arrive as one stream of tagged rows; each micro-batch is one batch of the pending-orphan
state, whose folder is all that has to survive.  A micro-batch that is delivered again after a failure
finds its number already there and is skipped, so every row counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.orphans import OrphanState

_REF = ("src_table", "row_id", "kh", "observed_at", "loaded_at")
_PARENT = ("kh", "added_at", "removed_at", "loaded_at")


def tagged(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """One stream of both: the columns of references and of parents, and which of them a row is."""
    return refs.select(F.lit("ref").alias("what"), *_REF).unionByName(parents.select(F.lit("parent").alias("what"), *_PARENT), allowMissingColumns=True)


def follow(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the state in ``folder`` up to date with ``stream`` (see ``tagged``); ``trigger`` as of ``DataStreamWriter.trigger``."""

    def step(rows: DataFrame, number: int) -> None:
        state = OrphanState(rows.sparkSession, folder)
        if number < state.batch:
            return
        kept = rows.persist()
        try:
            state.apply(kept.where("what = 'ref'").select(*_REF), kept.where("what = 'parent'").select(*_PARENT))
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
