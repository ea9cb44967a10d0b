"""Parent links to full hierarchies by blocked bottom-up leaf peeling.

Input: one row per node with a unique ``node_id``, the ``parent_id`` it names (null: none), a
``block`` column that says which nodes probably belong together, and optionally ``label`` for paths.

1. Nodes get a 64-bit number in a written table; one join turns parent names into numbers and ends
   chains whose parent does not exist.  From here on only numbers move.
2. *Peeling.*  Nodes are dealt to partitions by block.  A round peels each partition until no leaf
   is left in it - all levels at once, vectorized - adding subtree sizes to the parents.  What a
   peeled node owes to a parent of another partition leaves as a message (children done, subtree
   size), summed map-side, and takes part in the next round.  So the number of Spark rounds is the
   number of partition crossings along a chain, not its length.  Once the rest fits one block (a
   bounded number of rows) one more round ends it.  If it does not, and a round peels less than half
   of what is left, the rest is a skeleton of long chains across partitions: it is *climbed* by
   pointer doubling (``climb``), in rounds that grow with the logarithm of the depth.
3. What cannot be peeled lies on a cycle: a node has one parent, so a chain that leads into a cycle
   is itself peeled.  Each cycle gets its smallest id (byte order).
4. *Reverse peel order* hands depth, root, cycle and, if asked for, the path from parents to children,
   again one pass per round.

A block larger than a task is dealt by ``part`` (the file of a node), as links rarely leave a file;
only a part that is itself larger is dealt by node number.  Nothing is collected to the driver but
two counts a round and the names of oversized blocks (at most rows / ``block_rows``).

Defined results: a node without parent, or whose parent does not exist, is a root of depth 0.  Nodes
on or below a cycle get ``cycle_id``; the members of the cycle have depth 0 and are their own entry
points; a node below has the depth from the member that its chain enters and that member as root.
The descendants of a ring member are the nodes of the trees that hang on that member alone, and
``n_descendants`` counts these: the other members of the ring, and what hangs on them, are no
descendants of it, and no node is its own.  With A<->B and C below B, B has one descendant, A none.

Descendants are not sent up as lists while peeling: a list at a parent would grow with its subtree, a
root with a third of all nodes would get a third of the table in one row.  ``descendants`` sends them up
as rows, to the parent, then all rows so far to the ancestor 2, 4, 8 .. links above, so every pair is
made once, in rounds that grow with the logarithm of the depth, and no task holds a list.
Rows with a null ``node_id`` are ignored; repeated ``node_id`` must be resolved by the caller
(``current_rows``).  An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.plans.materialize import cut, drop
from weftgraph.plans.skew import heavy_keys, left_join, spread_left_join

#: Rows that one task may hold: a node takes about 60 bytes here.
BLOCK_ROWS = 500_000

_STATE = T.StructType(
    [
        T.StructField("nid", T.LongType()),
        T.StructField("pid", T.LongType()),
        T.StructField("bk", T.LongType()),
        T.StructField("rem", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("ext", T.BooleanType()),
        T.StructField("above", T.BooleanType()),
        T.StructField("cyc", T.LongType()),
    ]
)


def _lookup(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` in ``ids`` (unique), -1 where absent."""
    if not len(ids):
        return np.full(len(wanted), -1, dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], wanted)
    at[at == len(ids)] = 0
    found = order[at]
    return np.where(ids[found] == wanted, found, -1)


def _peel_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peel one partition.

    ``level`` is null for what stays; ``ext`` marks parents in other partitions, ``above`` parents
    that are not peeled in this pass, wherever they are.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    nid, bk, rem, size = (t[c].to_numpy().copy() for c in ("nid", "bk", "rem", "size"))
    pid = t["pid"].fill_null(-1).to_numpy().copy()
    n = len(nid)
    parent = _lookup(nid, pid)
    parent[pid < 0] = -1
    level = np.full(n, -1, dtype=np.int32)
    ready, step = np.flatnonzero(rem == 0), 0
    while len(ready):
        level[ready] = step
        up = parent[ready]
        inside = up >= 0
        up, grown = up[inside], size[ready][inside]
        np.add.at(size, up, grown)
        np.subtract.at(rem, up, 1)
        touched = np.unique(up)
        ready = touched[(rem[touched] == 0) & (level[touched] < 0)]
        step += 1
    # cycles that lie wholly in this partition: follow the parents of what is left
    cyc = np.full(n, -1, dtype=np.int64)
    left = np.flatnonzero(level < 0)
    if len(left):
        seen = np.zeros(n, dtype=np.int8)
        for start in left:
            trail, x = [], start
            while x >= 0 and level[x] < 0 and not seen[x]:
                seen[x] = 1
                trail.append(x)
                x = parent[x]
            if x >= 0 and seen[x] == 1:  # closed on the trail of this very walk
                ring = trail[trail.index(x) :]
                cyc[ring] = nid[ring].min()
            seen[trail] = 2
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(nid),
            pa.array(pid, mask=pid < 0),
            pa.array(bk),
            pa.array(rem),
            pa.array(size),
            pa.array(level, mask=level < 0),
            pa.array((parent < 0) & (pid >= 0)),
            pa.array((pid >= 0) & ((parent < 0) | (level[parent] < 0))),
            pa.array(cyc, mask=cyc < 0),
        ],
        names=_STATE.names,
    )


def _deal(df: DataFrame, parts: int) -> DataFrame:
    return df.coalesce(1) if parts == 1 else df.repartition(parts, "bk")


def _assign_partition(with_paths: bool):
    """Top-down pass over the nodes of one round; parents elsewhere arrive in ``p*`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        nid, level, size = (t[c].to_numpy() for c in ("nid", "level", "size"))
        pid = t["pid"].fill_null(-1).to_numpy()
        parent = _lookup(nid, pid)
        parent[pid < 0] = -1
        depth = t["pdepth"].fill_null(-1).to_numpy() + 1
        root = np.where(t["proot"].is_valid().to_numpy(), t["proot"].fill_null(-1).to_numpy(), nid)
        cyc = t["pcyc"].fill_null(-1).to_numpy().copy()
        paths = None
        if with_paths:
            own, up = t["label"].to_pylist(), t["ppath"].to_pylist()
            paths = [a if p is None else f"{p}/{a}" for p, a in zip(up, own)]
        order = np.argsort(-level, kind="stable")
        ends = np.flatnonzero(np.diff(level[order])) + 1
        for at in np.split(order, ends):
            inside = at[parent[at] >= 0]
            over = parent[inside]
            depth[inside], root[inside], cyc[inside] = depth[over] + 1, root[over], cyc[over]
            if with_paths:
                for i, p in zip(inside, over):
                    paths[i] = f"{paths[p]}/{own[i]}"
        out = [pa.array(nid), pa.array(depth), pa.array(root), pa.array(size), pa.array(cyc, mask=cyc < 0)]
        if with_paths:
            out.append(pa.array(paths, pa.string()))
        yield pa.RecordBatch.from_arrays(out, names=_placed(with_paths).names)

    return run


def _placed(with_paths: bool) -> T.StructType:
    fields = [T.StructField(c, T.LongType()) for c in ("nid", "depth", "root", "size", "cyc")]
    if with_paths:
        fields.append(T.StructField("path", T.StringType()))
    return T.StructType(fields)


def _rings(rest: DataFrame) -> DataFrame:
    """nid, cyc of the nodes on cycles: pointers are doubled until only those that never end are left.

    The number of pointers that have not ended falls every round until only cycles, and what leads into
    them, are left; after as many steps as these are nodes, every pointer is on its cycle.
    """
    state = cut(rest.where("pid is not null").select("nid", F.col("pid").alias("ptr"), F.col("nid").alias("low")), "pointers")
    n, steps, settled = state.count(), 1, False
    while n and not (settled and steps >= n):
        other = state.select(F.col("nid").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        moved = cut(left_join(state, other, "ptr", "nid").where("ptr2 is not null").select("nid", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low")), "pointers")
        drop(state)
        m = moved.count()
        state, settled, n, steps = moved, settled or m == n, m, steps * 2
    on = state.select(F.col("ptr").alias("nid")).distinct()
    return cut(state.join(on, "nid", "left_semi").select("nid", F.col("low").alias("cyc")), "rings")


def climb(rest: DataFrame, with_paths: bool = False) -> tuple[DataFrame, DataFrame]:
    """(placed, rings) of nodes (nid, pid, size[, label]) that hold all their ancestors, by pointer doubling.

    After round k a node knows its ancestor 2**k links above and the sizes of what hangs on it nearer than
    that; both double by asking that ancestor, and by the sums that come from below.  Members of rings are
    roots, so sizes count the trees on each of them.
    """
    rings = _rings(rest)
    open_ = rest.join(rings.withColumnRenamed("cyc", "ring"), "nid", "left").withColumn("ptr", F.when(F.col("ring").isNull(), F.col("pid")))
    path = [F.col("label").alias("path")] if with_paths else []
    state = cut(open_.select("nid", "ptr", F.coalesce("ptr", "nid").alias("top"), F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("dist"), "size", *path), "climbers")
    while not state.where("ptr is not null").isEmpty():
        sums = state.where("ptr is not null").groupBy(F.col("ptr").alias("nid")).agg(F.sum("size").alias("more"))
        other = state.select(F.col("nid").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("top").alias("top2"), F.col("dist").alias("dist2"), *[F.col("path").alias("path2") for _ in path])
        far = left_join(state, other, "ptr", "nid").join(sums, "nid", "left")
        grown = [F.concat_ws("/", "path2", "path").alias("path") for _ in path]
        moved = far.select("nid", F.col("ptr2").alias("ptr"), F.coalesce("top2", "top").alias("top"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), *grown)
        moved = cut(moved, "climbers")
        drop(state)
        state = moved
    ends = rings.select(F.col("nid").alias("top"), "cyc")
    placed = left_join(state, ends, "top", "nid").select("nid", F.col("dist").alias("depth"), F.col("top").alias("root"), "size", "cyc", *[F.col("path") for _ in path])
    return cut(placed, "placed"), rings


class Hierarchy:
    """``placed``: (nid, depth, root, size, cyc[, path]); ``names``: (nid, node_id); ``links``: (nid, pid); ``rings``: (nid, cyc)."""

    def __init__(self, placed: DataFrame, names: DataFrame, links: DataFrame, rings: DataFrame):
        self.placed, self.names, self.links, self.rings = placed, names, links, rings
        self.cycles = rings.join(names, "nid").groupBy("cyc").agg(F.min("node_id").alias("cycle_id"))

    def nodes(self) -> DataFrame:
        """node_id, depth, root_id, n_descendants, cycle_id (and path if it was asked for).

        ``n_descendants`` of a ring member counts the trees that hang on that member, not the ring.
        """
        roots = self.names.select(F.col("nid").alias("root"), F.col("node_id").alias("root_id"))
        out = left_join(self.placed.join(self.names, "nid"), roots, "root", "nid").join(self.cycles, "cyc", "left")
        extra = ["path"] if "path" in self.placed.columns else []
        return out.select("node_id", *extra, F.col("depth").cast("int").alias("depth"), "root_id", (F.col("size") - 1).alias("n_descendants"), "cycle_id")

    def in_cycles(self) -> DataFrame:
        """node_id, cycle_id of the nodes whose chain never ends."""
        return self.placed.where("cyc is not null").join(self.names, "nid").join(self.cycles, "cyc").select("node_id", "cycle_id")

    def descendants(self) -> DataFrame:
        """ancestor_id, node_id, distance: the descendant lists as rows.

        Nodes below a cycle have the ancestors up to the member that they enter; ring members have no
        ancestors and are nobody's descendants.
        """
        first = self.links.join(self.rings.select("nid"), "nid", "left_anti").select(F.col("pid").alias("up"), "nid", F.lit(1).alias("distance"))
        found, far = [cut(first, "pairs")], 1
        while True:
            every = reduce(DataFrame.unionByName, found)
            # the ancestor ``far`` links above the ancestors found so far
            above = found[-1].where(F.col("distance") == far).select(F.col("nid").alias("up"), F.col("up").alias("top"))
            met = spread_left_join(every, above, "up", "nid", heavy_keys(every, "up")).where("top is not null")
            more = cut(met.select(F.col("top").alias("up"), "nid", (F.col("distance") + far).alias("distance")), "pairs")
            if more.isEmpty():
                drop(more)
                break
            found.append(more)
            far *= 2
        above = self.names.select(F.col("nid").alias("up"), F.col("node_id").alias("ancestor_id"))
        return left_join(every, above, "up", "nid").join(self.names, "nid").select("ancestor_id", "node_id", F.col("distance").cast("int").alias("distance"))


def peel(nodes: DataFrame, index: DataFrame | None = None, with_paths: bool = False, block_rows: int = BLOCK_ROWS) -> Hierarchy:
    """Peel ``nodes`` (node_id, parent_id, block[, part][, label]).

    ``index`` maps further names to nodes: (name, node_id) rows by which a ``parent_id`` may also be
    found; a null node_id ends the chain.  Names of ``index`` hide equal node ids.
    """
    cols = ["node_id", "parent_id", "block", *[c for c in ("part",) if c in nodes.columns], *(["label"] if with_paths else [])]
    named = cut(nodes.where("node_id is not null").select(*cols).withColumn("nid", F.monotonically_increasing_id()), "names")
    names = named.select("nid", "node_id")

    by_name = names.select(F.col("node_id").alias("name"), F.col("nid").alias("pid"))
    if index is not None:
        alias = index.join(names, "node_id", "left").select("name", F.col("nid").alias("pid"))
        by_name = by_name.join(index.select("name"), "name", "left_anti").unionByName(alias)
    has = named.where("parent_id is not null")
    linked = has.join(by_name.withColumnRenamed("name", "parent_id"), "parent_id", "left").select("nid", "pid")
    links = cut(linked.where("pid is not null"), "links")

    # a block larger than one task is dealt by its parts, a part larger than that by node number
    total = named.count()
    whole, base = F.xxhash64("block"), named
    bk = whole
    if total > block_rows:
        by = ["block", *[c for c in ("part",) if c in named.columns]]
        parts_of = cut(named.groupBy(*by).agg(F.count(F.lit(1)).alias("m")), "sizes")
        sizes = parts_of.groupBy("block").agg(F.sum("m").alias("n"))
        base = named.join(F.broadcast(sizes.where(F.col("n") > block_rows).select("block", F.lit(True).alias("wide"))), "block", "left")  # at most total / block_rows rows
        bk = F.when(F.col("wide"), F.xxhash64(*by)).otherwise(whole)
        if len(by) > 1:
            giant = parts_of.where(F.col("m") > block_rows).select(*by, F.ceil(F.col("m") / block_rows).alias("cuts"))
            base = base.join(F.broadcast(giant), by, "left")  # at most total / block_rows rows
            bk = F.when(F.col("cuts").isNotNull(), F.xxhash64(*by, F.pmod(F.xxhash64("nid"), "cuts"))).otherwise(bk)
        else:
            cuts = F.broadcast(sizes.where(F.col("n") > block_rows).select("block", F.ceil(F.col("n") / block_rows).alias("cuts")))
            base = base.join(cuts, "block", "left")
            bk = F.when(F.col("wide"), F.xxhash64("block", F.pmod(F.xxhash64("nid"), "cuts"))).otherwise(bk)
    children = links.groupBy(F.col("pid").alias("nid")).agg(F.count(F.lit(1)).alias("rem"))
    state = (
        base.select("nid", bk.alias("bk"))
        .join(links, "nid", "left")
        .join(children, "nid", "left")
        .select("nid", "pid", "bk", F.coalesce("rem", F.lit(0)).cast("long").alias("rem"), F.lit(1).cast("long").alias("size"))
    )

    # blocks are hashed to tasks: twice as many tasks as needed keep what meets in one small
    slots = nodes.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-2 * total // block_rows) if total > block_rows else 1, min(slots, total // 20_000))
    rounds: list[tuple[DataFrame, int]] = []
    labels = named.select("nid", "label") if with_paths else None
    left = total
    while True:
        done = cut(_deal(state, parts).mapInArrow(_peel_partition, _STATE), "round")
        rounds.append((done, parts))
        alive = done.where("level is null").drop("level", "ext", "above", "cyc")
        owed = done.where("level is not null and ext").groupBy(F.col("pid").alias("nid")).agg(F.count(F.lit(1)).alias("did"), F.sum("size").alias("more"))
        counts = done.agg(F.count_if(F.col("level").isNull()).alias("alive"), F.count_if(F.col("level").isNotNull() & F.col("ext")).alias("owed")).first()
        if not counts["alive"] or (not counts["owed"] and parts == 1):
            placed, rings = None, done.where("level is null").select("nid", "cyc")
            break
        state = alive.join(owed, "nid", "left").select("nid", "pid", "bk", (F.col("rem") - F.coalesce("did", F.lit(0))).alias("rem"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        if counts["alive"] > block_rows and (counts["alive"] * 2 > left or not counts["owed"]):
            rest = state.select("nid", "pid", "size")
            placed, rings = climb(cut(rest.join(labels, "nid") if with_paths else rest, "rest"), with_paths)
            break
        left = counts["alive"]
        parts = max(1, -(-2 * left // block_rows)) if left > block_rows else 1

    shape = _placed(with_paths)
    rings = cut(rings, "rings")
    if placed is None:
        last = rounds[-1][0].where("level is null")
        placed = last.select("nid", F.lit(0).cast("long").alias("depth"), F.col("nid").alias("root"), "size", "cyc")
        if with_paths:
            placed = placed.join(labels, "nid").select("nid", "depth", "root", "size", "cyc", F.col("label").alias("path"))
        placed = cut(placed, "placed")
    for done, parts in reversed(rounds):
        ripe = done.where("level is not null").select("nid", "pid", "bk", "size", "level", "above")
        above = placed.select(F.col("nid").alias("pid"), F.col("depth").alias("pdepth"), F.col("root").alias("proot"), F.col("cyc").alias("pcyc"), *([F.col("path").alias("ppath")] if with_paths else []))
        # only nodes whose parent was peeled later look it up
        found = left_join(ripe.where("above"), above, "pid", "nid")
        own = ripe.where("not above")
        whole = found.unionByName(own, allowMissingColumns=True)
        if with_paths:
            whole = whole.join(labels, "nid")
        now = cut(_deal(whole.drop("above"), parts).mapInArrow(_assign_partition(with_paths), shape), "placed")
        placed = placed.unionByName(now)
    for done, _ in rounds:
        drop(done)
    return Hierarchy(placed, names, links, rings)
