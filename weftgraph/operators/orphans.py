"""References to records that do not exist: keyed pending-orphan state, kept incrementally.

The state is a folder.  Each batch adds to it and rewrites only what is small:

* *index*: the versions of parent keys (added, removed, loaded), by bucket of the key;
* *verdicts*: the versions of references with whether they are orphans, by bucket of the key; a verdict
  that changes is a further row, the last one counts;
* *pending*: the references that are orphans now, waiting for their key; rewritten every batch;
* *BATCH*: the number of the last batch that is complete, replaced in one step.  A batch that dies is
  repeated from the one before it; a folder can be opened again later.

``OrphanState.apply`` takes what arrived since the last call.  New references probe the index, in the
buckets of their keys.  A parent that is new can only resolve, so it meets the pending orphans alone; one
that changed meets those and the verdicts in the buckets of such keys, where a deletion reopens what it
leaves behind.  Nothing else is read: the cost of a batch follows its own size and that of the pending
orphans, not that of all references.  ``snapshot`` counts the last verdict of the latest version of
every reference.  ``history`` gives the counts after every month of loading.

Keys travel as 16-byte digests, so the state stays small.  Rows of hot keys are dealt over salted
buckets (``plans.skew``).  Defined results: references whose key is null, empty or symbolic are no
references (they can still supersede an older version); a reference observed at the very time its
parent was added finds it, at the very time of removal it does not; copies count once; a null
``observed_at`` finds any parent that was not removed.  Empty tables give an empty state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import canonical_key, is_reference
from weftgraph.operators.current import current_rows
from weftgraph.plans.materialize import cut, drop, read_text, replace_text, shared_folder
from weftgraph.plans.skew import heavy_keys, left_join, spread_left_join


def digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def references(df: DataFrame, source: str, row_id: str, key: str) -> DataFrame:
    """Rows of a referring table as (src_table, row_id, kh, observed_at, loaded_at)."""
    c = canonical_key(key)
    return df.select(F.lit(source).alias("src_table"), F.col(row_id).alias("row_id"), F.when(is_reference(c), digest(c)).alias("kh"), F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"))


def parents(df: DataFrame) -> DataFrame:
    """Rows of a table of records as (kh, added_at, removed_at, loaded_at)."""
    return df.where("id is not null").select(digest(F.col("id")).alias("kh"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("added_at", "removed_at", "loaded_at")])


def _missing(observed: str = "observed_at") -> Column:
    """Whether the joined parent row (null: none) leaves the reference an orphan."""
    late = F.coalesce(F.col("added_at") > F.col(observed), F.lit(False))
    gone = F.coalesce(F.col("removed_at") <= F.col(observed), F.col("removed_at").isNotNull() & F.col(observed).isNull())
    return F.col("found").isNull() | late | gone


BUCKETS = 32
_REFS = "src_table string, row_id long, kh binary, observed_at timestamp_ntz, loaded_at timestamp_ntz, orphan boolean"
_PARENTS = "kh binary, added_at timestamp_ntz, removed_at timestamp_ntz, loaded_at timestamp_ntz"
_VERSION = ["src_table", "row_id", "kh", "observed_at", "loaded_at"]


def _bucket(key: str = "kh") -> Column:
    """The bucket of a key; references without one have a bucket of their own."""
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"), F.lit(-1))


class OrphanState:
    """The state in ``folder`` (any file system that all executors share; none: a folder for this session)."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or shared_folder(spark, "orphans")
        self.batch = int(read_text(spark, f"{self.folder}/BATCH") or 0)

    def _read(self, table: str, schema: str) -> DataFrame:
        """A table of the state as of the last complete batch, with batch and kb."""
        if not self.batch:
            return self.spark.createDataFrame([], f"{schema}, batch int, kb int")
        return self.spark.read.schema(f"{schema}, batch int, kb int").parquet(f"{self.folder}/{table}").where(F.col("batch") <= self.batch)

    def _pending(self) -> DataFrame:
        if not self.batch:
            return self.spark.createDataFrame([], _REFS)
        return self.spark.read.schema(_REFS).parquet(f"{self.folder}/pending/{self.batch}")

    def _touched(self, df: DataFrame, table: str, schema: str) -> DataFrame:
        """The rows of a table in the buckets of ``df``'s keys; the list of buckets has at most BUCKETS numbers."""
        found = [r[0] for r in df.select(_bucket().alias("kb")).distinct().collect()]
        return self._read(table, schema).where(F.col("kb").isin(found) if found else F.lit(False))

    def _append(self, df: DataFrame, table: str, spread: str) -> DataFrame:
        """Write rows as the next batch's part of a table, a bucket of a hot key in several files."""
        path = f"{self.folder}/{table}/batch={self.batch + 1}"
        dealt = df.withColumn("kb", _bucket()).repartition("kb", F.pmod(F.xxhash64(spread), F.lit(8)))
        dealt.write.mode("overwrite").partitionBy("kb").parquet(path)
        return self.spark.read.schema(dealt.schema).parquet(path)

    def apply(self, new_refs: DataFrame, new_parents: DataFrame) -> None:
        """One batch: references (src_table, row_id, kh, observed_at, loaded_at) and parents (kh, added_at, removed_at, loaded_at)."""
        # parents that are newer than what the index knows
        arrived = cut(current_rows(new_parents, ["kh"]), "arrived")
        before = self._touched(arrived, "index", _PARENTS).groupBy("kh").agg(F.max("loaded_at").alias("was_loaded"), F.lit(True).alias("known"))
        met = arrived.join(before, "kh", "left").where("known is null or was_loaded is null or loaded_at > was_loaded")
        changed = cut(met.select("kh", "added_at", "removed_at", "loaded_at", F.coalesce("known", F.lit(False)).alias("known")), "changed")
        drop(arrived)
        self._append(changed.drop("known"), "index", "kh")
        fresh_parents = changed.select("kh", "added_at", "removed_at", F.lit(True).alias("found"))

        # new references against the index, this batch's parents included
        fresh = cut(current_rows(new_refs.select(*_VERSION), ["src_table", "row_id"]), "fresh")
        asking = fresh.where("kh is not null")
        older = self._touched(asking, "index", _PARENTS).select("kh", "added_at", "removed_at", "loaded_at")
        wanted = asking.select("kh").distinct()
        known = older.unionByName(changed.drop("known")).join(wanted, "kh", "left_semi")
        known = known.groupBy("kh").agg(F.max_by(F.struct("added_at", "removed_at"), F.struct(F.col("loaded_at").isNotNull(), "loaded_at")).alias("x")).select("kh", "x.*", F.lit(True).alias("found"))
        heavy = heavy_keys(fresh, "kh")
        judged = spread_left_join(asking, known, "kh", "row_id", heavy).withColumn("orphan", _missing()).select(*_VERSION, "orphan")

        # what waited for keys that arrived or changed, and what had found those that changed
        pending = self._pending()
        waited = spread_left_join(pending, fresh_parents, "kh", "row_id", heavy_keys(pending, "kh")) if self.batch else pending.join(fresh_parents, "kh", "left")
        waited = cut(waited.select(*_VERSION, F.when(F.col("found").isNull(), F.lit(True)).otherwise(_missing()).alias("orphan")), "waited")
        updated = changed.where("known").select("kh", "added_at", "removed_at", F.lit(True).alias("found"))
        reopened = []
        if not updated.isEmpty():
            held = self._touched(updated, "verdicts", _REFS).join(updated.select("kh"), "kh", "left_semi")
            last = held.groupBy(*_VERSION).agg(F.max(F.struct("batch", "orphan"))["orphan"].alias("orphan")).where("not orphan").drop("orphan")
            reopened.append(left_join(last, updated, "kh", "row_id").withColumn("orphan", _missing()).where("orphan").select(*_VERSION, "orphan"))

        events = judged.unionByName(fresh.where("kh is null").withColumn("orphan", F.lit(False))).unionByName(waited.where("not orphan"))
        for more in reopened:
            events = events.unionByName(more)
        added = self._append(events, "verdicts", "row_id")
        still = waited.where("orphan").unionByName(added.where("orphan").select(*_VERSION, "orphan"))
        still.write.mode("overwrite").parquet(f"{self.folder}/pending/{self.batch + 1}")
        replace_text(self.spark, f"{self.folder}/BATCH", str(self.batch + 1))
        self.batch += 1
        for done in (changed, fresh, waited):
            drop(done)

    def ledger(self) -> DataFrame:
        """The latest version of every reference with its last verdict."""
        w = Window.partitionBy("src_table", "row_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.desc("batch"))
        rows = self._read("verdicts", _REFS).withColumn("_before", F.lag(F.lit(1)).over(w))
        return rows.where("_before is null").select(*_VERSION, "orphan")

    def orphans(self) -> DataFrame:
        """src_table, row_id of the references that are orphans now."""
        return self.ledger().where("orphan").select("src_table", "row_id")

    def snapshot(self) -> DataFrame:
        """src_table, month (of observed_at), n_references, n_orphans as of the last batch."""
        month = F.date_format("observed_at", "yyyy-MM").alias("month")
        return self.ledger().where("kh is not null").groupBy("src_table", month).agg(F.count(F.lit(1)).alias("n_references"), F.count_if("orphan").alias("n_orphans"))


def replay(refs: DataFrame, records: DataFrame, batches: int = 3) -> OrphanState:
    """The state after whole tables were fed in the order in which they were loaded, in ``batches`` equal spans of time.

    Both tables are read once: their rows are written by batch, and each batch reads its own part.
    """
    spark = refs.sparkSession
    span = refs.select("loaded_at").unionByName(records.select("loaded_at")).agg(F.min(F.unix_micros(F.col("loaded_at").cast("timestamp"))).alias("lo"), F.max(F.unix_micros(F.col("loaded_at").cast("timestamp"))).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    width = (hi - lo) // batches + 1
    at = F.coalesce(((F.unix_micros(F.col("loaded_at").cast("timestamp")) - lo) / width).cast("int"), F.lit(0))
    parts = []
    for name, df in (("refs", refs), ("records", records)):
        path = shared_folder(spark, name)
        df.withColumn("part", at).write.partitionBy("part").parquet(path)
        parts.append(spark.read.schema(df.withColumn("part", at).schema).parquet(path))
    state = OrphanState(spark)
    for k in range(batches):
        state.apply(*[p.where(F.col("part") == k).drop("part") for p in parts])
    return state


def _reigns(df: DataFrame, by: list[str], batch: Column) -> DataFrame:
    """Each version with the batches ``since`` .. ``until`` - 1 after which it is the current row (``until`` null: to the end)."""
    w = Window.partitionBy(*by).orderBy(F.col("loaded_at").asc_nulls_first())
    return df.withColumn("since", batch).withColumn("until", F.lead("since").over(w)).where("until is null or until > since").drop("loaded_at")


def history(refs: DataFrame, records: DataFrame) -> DataFrame:
    """The snapshot after each month of ``loaded_at``: src_table, month, n_references, n_orphans, batch_no.

    A batch is what was loaded in one calendar month; batch 1 is the first month of the span, and there
    are as many batches as months in the span (months without loads repeat the counts).  Rows without
    ``loaded_at`` are in batch 1.  Rather than replaying the batches, every version of a reference and of
    a record gets the batches in which it is current; what a reference finds begins and ends with
    their overlaps.  The beginnings and ends are counted per batch and summed up over the batches, so the
    cost does not grow with their number.
    """
    no = F.year("loaded_at") * 12 + F.month("loaded_at")
    span = refs.select("loaded_at").unionByName(records.select("loaded_at")).agg(F.min(no).alias("lo"), F.max(no).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    batch = F.coalesce(no - lo + 1, F.lit(1))
    month = F.date_format("observed_at", "yyyy-MM").alias("month")
    end = F.lit(hi - lo + 2)

    versions = cut(_reigns(refs, ["src_table", "row_id"], batch).where("kh is not null"), "versions")
    known = _reigns(records, ["kh"], batch).withColumnsRenamed({"since": "psince", "until": "puntil"}).withColumn("found", F.lit(True))
    met = spread_left_join(versions, known, "kh", "row_id", heavy_keys(versions, "kh")).where(~_missing())
    begun, over = F.greatest("since", "psince"), F.least(F.coalesce("until", end), F.coalesce("puntil", end))
    met = met.select("src_table", month, begun.alias("since"), over.alias("until")).where("until > since")

    def steps(df: DataFrame, refs_by: int, found_by: int) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("sign")), F.struct(F.coalesce("until", end).alias("at"), F.lit(-1).alias("sign")))).alias("e")
        return df.select("src_table", "month", ends).select("src_table", "month", "e.at", (F.col("e.sign") * refs_by).alias("r"), (F.col("e.sign") * found_by).alias("f"))

    changes = steps(versions.select("src_table", month, "since", "until"), 1, 0).unionByName(steps(met, 0, 1))
    changes = changes.where(F.col("at") < end).groupBy("src_table", "month", "at").agg(F.sum("r").alias("r"), F.sum("f").alias("f"))
    # a row for each month of observation and batch: small
    counts = changes.select("src_table", "month", "r", "f", F.explode(F.sequence("at", end - 1)).alias("batch_no")).groupBy("src_table", "month", "batch_no").agg(F.sum("r").alias("n_references"), F.sum("f").alias("n_found"))
    return counts.where("n_references > 0").select("src_table", "month", "n_references", (F.col("n_references") - F.col("n_found")).alias("n_orphans"), "batch_no")


def _tables(nodes: DataFrame, shared: DataFrame, edges: DataFrame, boundaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    refs = references(edges, "edges", "edge_id", "target_id").unionByName(references(boundaries, "boundaries", "boundary_id", "match_key"))
    return refs, parents(nodes).unionByName(parents(shared))


def orphan_state(nodes: DataFrame, shared: DataFrame, edges: DataFrame, boundaries: DataFrame, batches: int = 3) -> OrphanState:
    return replay(*_tables(nodes, shared, edges, boundaries), batches)


def orphan_history(nodes: DataFrame, shared: DataFrame, edges: DataFrame, boundaries: DataFrame) -> DataFrame:
    return history(*_tables(nodes, shared, edges, boundaries))
