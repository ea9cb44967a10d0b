"""Questions to the graph: reach, strongly connected components, projections, neighbours, walks.

A graph is two DataFrames: vertices (id) and links (source_id, target_id), distinct pairs of different
vertices (``fan.links``).  Every operator that yields a graph yields the same two, so they compose.

Loops keep their state in written tables (``plans.materialize.cut``), so lineage stays short and a lost
executor costs a task, not a round.  A frontier that is small is broadcast by the planner, which knows
the size of the written table; links of a vertex with a large share of them are dealt over salted
buckets.  Empty graphs give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.materialize import cut, drop
from weftgraph.plans.skew import heavy_keys, left_join, spread_left_join
from weftgraph.project import Project

#: Edge types of the scoped views.
SCOPES = {
    "composition": ("instances", "attaches_script"),
    "signals": ("declares_signal", "emits_signal", "connects_signal"),
    "autoloads": ("accesses_autoload",),
    "scene_flow": ("changes_scene_to",),
}

#: Links that one task finishes by itself: 16 bytes each, and about ten times that while it works.
BLOCK_LINKS = 2_000_000


def reach(links: DataFrame, roots: DataFrame, max_depth: int = 0, reverse: bool = False) -> DataFrame:
    """root, id, depth: what each root reaches along the links (against them if ``reverse``), by hops.

    ``max_depth`` of 0 or less sets no bound.  A root is never in its own result, not even on a cycle;
    null and unknown roots reach nothing; repeated roots count once.  A round is a hop of all roots.
    """
    here, there = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    hops = cut(links.select(F.col(here).alias("id"), F.col(there).alias("next")), "hops")
    heavy = heavy_keys(hops, "id")
    first = roots.where("root is not null").select("root").distinct()
    layers = [cut(first.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")), "frontier")]
    while max_depth <= 0 or len(layers) <= max_depth:
        met = spread_left_join(hops, layers[-1].select("root", "id"), "id", "next", heavy).where("root is not null")
        seen = reduce(DataFrame.unionByName, layers).select("root", "id")
        fresh = met.select("root", F.col("next").alias("id")).distinct().join(seen, ["root", "id"], "left_anti")
        layer = cut(fresh.withColumn("depth", F.lit(len(layers))), "frontier")
        if layer.isEmpty():
            drop(layer)
            break
        layers.append(layer)
    drop(hops)
    return reduce(DataFrame.unionByName, layers).where("depth > 0").select("root", "id", "depth")


def focus(links: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """root, id, hops: the neighbourhood of each root within ``hops`` links, along or against them."""
    both = reach(links, roots, hops).unionByName(reach(links, roots, hops, reverse=True))
    return both.groupBy("root", "id").agg(F.min("depth").alias("hops"))


def scoped(p: Project, scope: str) -> Project:
    """The project with the edges of one scoped view only."""
    return replace(p, edges=p.edges.where(F.col("type").isin(*SCOPES[scope])))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, direction, type, peer, origin, resolved of every edge at the given ids (column ``id``).

    All edges count, resolved or not; a self-loop shows in both directions.
    """
    kept = ["type", "origin", "resolved"]
    out = edges.select(F.col("source_id").alias("id"), F.lit("outbound").alias("direction"), F.col("target_id").alias("peer"), *kept)
    into = edges.select(F.col("target_id").alias("id"), F.lit("inbound").alias("direction"), F.col("source_id").alias("peer"), *kept)
    wanted = ids.select("id").distinct()
    return out.unionByName(into).join(wanted, "id", "left_semi").select("id", "direction", "type", "peer", "origin", "resolved")


def project(groups: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, links) of the quotient graph.  ``groups``: id, group; a null group drops the node.

    Links within a group vanish, one link per ordered pair of groups stays, groups without links stay.
    """
    kept = groups.where("group is not null").select("id", "group")
    a = kept.select(F.col("id").alias("source_id"), F.col("group").alias("a"))
    b = kept.select(F.col("id").alias("target_id"), F.col("group").alias("b"))
    pairs = left_join(links, a, "source_id", "target_id").where("a is not null")
    pairs = left_join(pairs, b, "target_id", "source_id").where("b is not null")
    found = pairs.where("a <> b").select(F.col("a").alias("source_id"), F.col("b").alias("target_id")).distinct()
    return kept.select(F.col("group").alias("id")).distinct(), found


def crossings(groups: DataFrame, links: DataFrame) -> DataFrame:
    """source_unit, target_unit, n_links: links between and within groups, for structure matrices."""
    a = groups.where("group is not null").select(F.col("id").alias("source_id"), F.col("group").alias("source_unit"))
    b = groups.where("group is not null").select(F.col("id").alias("target_id"), F.col("group").alias("target_unit"))
    pairs = left_join(links, a, "source_id", "target_id")
    pairs = left_join(pairs, b, "target_id", "source_id")
    return pairs.where("source_unit is not null and target_unit is not null").groupBy("source_unit", "target_unit").agg(F.count(F.lit(1)).alias("n_links"))


def directory(path: str | Column) -> Column:
    """The folder of a ``res://`` id or path, with its closing slash; null for others."""
    c = F.col(path) if isinstance(path, str) else path
    file = F.substring_index(c, "::", 1)
    return F.nullif(F.regexp_extract(file, r"^(res://(?:[^/]+/)*)", 1), F.lit(""))


def by_rules(vertices: DataFrame, rules: dict[str, str]) -> DataFrame:
    """id, group by the first glob of ``rules`` (pattern -> group) that the file of an id matches.

    ``*`` and ``?`` stop at ``/``, ``**`` does not.  The rules are a setting, not data.
    """
    from weftgraph.functions.globs import glob_regex

    body = F.regexp_replace(F.substring_index("id", "::", 1), "^res://", "")
    group = F.lit(None).cast("string")
    for pattern, name in reversed(list(rules.items())):
        group = F.when(body.rlike(glob_regex(pattern, deep=True)), F.lit(name)).otherwise(group)
    return vertices.select("id", group.alias("group"))


# ---- strongly connected components -------------------------------------------------------------


def _tarjan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, comp) of the vertices on cycles of one task's links, by an iterative depth-first search."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    ids, flat = np.unique(np.concatenate([t["src"].to_numpy(), t["dst"].to_numpy()]), return_inverse=True)
    n = len(ids)
    src, dst = flat[: t.num_rows], flat[t.num_rows :]
    order = np.argsort(src, kind="stable")
    heads = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    ends = dst[order].tolist()
    index, low, comp = [-1] * n, [0] * n, [-1] * n
    at = heads[:-1].copy()
    stack: list[int] = []
    clock = 0
    for begin in range(n):
        if index[begin] >= 0:
            continue
        path = [begin]
        index[begin] = low[begin] = clock
        clock += 1
        stack.append(begin)
        while path:
            v = path[-1]
            if at[v] < heads[v + 1]:
                w = ends[at[v]]
                at[v] += 1
                if index[w] < 0:
                    index[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    path.append(w)
                elif comp[w] < 0:
                    low[v] = min(low[v], index[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == index[v]:
                while True:
                    w = stack.pop()
                    comp[w] = v
                    if w == v:
                        break
    comps = np.array(comp)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[comps])], names=["nid", "comp"])


def _trimmed(live: DataFrame) -> DataFrame:
    """Links whose source has a link into it and whose target one out of it: others lie on no cycle."""
    into = live.select(F.col("dst").alias("src")).distinct()
    out = live.select(F.col("src").alias("dst")).distinct()
    return cut(live.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"), "live")


def _coloured(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components found, links still open) by one pass of colouring.

    The colour of a vertex is the smallest number that reaches it.  Links between colours lie on no
    cycle; within a colour, what reaches its first vertex backwards is that vertex's component.
    """
    ends = live.select(F.col("src").alias("nid")).unionByName(live.select(F.col("dst").alias("nid"))).distinct()
    colour = cut(ends.select("nid", F.col("nid").alias("c")), "colour")
    while True:
        came = live.join(colour.withColumnsRenamed({"nid": "src", "c": "m"}), "src").groupBy(F.col("dst").alias("nid")).agg(F.min("m").alias("m"))
        moved = cut(colour.join(came, "nid", "left").select("nid", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("less")), "colour")
        drop(colour)
        colour = moved.select("nid", "c")
        if moved.where("less").isEmpty():
            break
    a, b = colour.withColumnsRenamed({"nid": "src", "c": "ca"}), colour.withColumnsRenamed({"nid": "dst", "c": "cb"})
    same = cut(live.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("c")), "same")
    found = [cut(colour.where("nid = c"), "members")]
    while True:
        step = same.join(found[-1].select(F.col("nid").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("nid"), "c").distinct()
        fresh = cut(step.join(reduce(DataFrame.unionByName, found), ["nid", "c"], "left_anti"), "members")
        if fresh.isEmpty():
            break
        found.append(fresh)
    members = reduce(DataFrame.unionByName, found)
    rest = same.join(members.select(F.col("nid").alias("src")), "src", "left_anti").join(members.select(F.col("nid").alias("dst")), "dst", "left_anti")
    rest = cut(rest.select("src", "dst"), "live")
    drop(same)
    drop(moved)
    return members.select("nid", F.col("c").alias("comp")), rest


def components(vertices: DataFrame, links: DataFrame, block_links: int = BLOCK_LINKS) -> DataFrame:
    """id, component_id, size of every vertex: its strongly connected component.

    ``component_id`` is the smallest id (byte order) of the component; a vertex on no cycle is a component
    of its own.  Links that can lie on no cycle are trimmed in rounds while that removes a tenth of them
    or more; what is left is coloured until it fits one task, which finishes it.  The result does
    not depend on ``block_links``.
    """
    names = cut(vertices.where("id is not null").distinct().withColumn("nid", F.monotonically_increasing_id()), "names")
    numbered = left_join(links, names.select(F.col("id").alias("source_id"), F.col("nid").alias("src")), "source_id", "target_id").where("src is not null").select("src", "target_id")
    live = left_join(numbered, names.select(F.col("id").alias("target_id"), F.col("nid").alias("dst")), "target_id", "src").where("dst is not null")
    live = cut(live.select("src", "dst"), "live")
    count, done = live.count(), []
    while count > 0:
        slim = _trimmed(live)
        drop(live)
        live, before, count = slim, count, slim.count()
        if count * 10 <= before * 9 and count > block_links:
            continue
        if count <= block_links:
            done.append(cut(live.coalesce(1).mapInArrow(_tarjan, "nid long, comp long"), "components"))
            break
        found, live_ = _coloured(live)
        drop(live)
        live, count = live_, live_.count()
        done.append(found)
    if not done:
        return names.select("id", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("size"))
    known = names.join(reduce(DataFrame.unionByName, done), "nid", "left").select("id", F.coalesce("comp", "nid").alias("comp"))
    heads = known.groupBy("comp").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    return known.join(heads, "comp").select("id", "component_id", "size")


def cycles(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """component_id, id, size of the vertices that lie on a cycle of two or more."""
    return components(vertices, links).where("size > 1").select("component_id", "id", "size")


# ---- walks -----------------------------------------------------------------------------------


def walks(steps: DataFrame, starts: DataFrame, ends: DataFrame, max_hops: int) -> DataFrame:
    """start_id, end_id, path, hops: ways of at most ``max_hops`` links from a start to an end.

    ``steps``: source_id, target_id.  A walk never visits a vertex twice (cycles are cut off); every way
    that stands at an end is given, ways that go on are given again.  A start that is an end has the walk
    of no hops.  The number of walks grows with the branching to the power of ``max_hops``: that bound is
    the parameter.
    """
    ways = cut(starts.select("id").distinct().select(F.col("id").alias("start_id"), F.col("id").alias("at"), F.array("id").alias("path")), "ways")
    rounds = [ways]
    heavy = heavy_keys(steps, "source_id")
    hops = steps.select(F.col("source_id").alias("at"), F.col("target_id").alias("next")).distinct()
    for _ in range(max_hops):
        met = spread_left_join(hops, rounds[-1], "at", "next", heavy).where("start_id is not null")
        grown = met.where(~F.array_contains("path", F.col("next"))).select("start_id", F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"))
        rounds.append(cut(grown, "ways"))
        if rounds[-1].isEmpty():
            break
    every = reduce(DataFrame.unionByName, rounds)
    stop = ends.select(F.col("id").alias("at")).distinct()
    return every.join(stop, "at", "left_semi").select("start_id", F.col("at").alias("end_id"), F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("hops"))


# ---- communities -----------------------------------------------------------------------------


def communities(vertices: DataFrame, links: DataFrame, seed: DataFrame, passes: int = 6, levels: int = 3) -> DataFrame:
    """id, community_id: groups with many links inside, by local moves and aggregation (Louvain).

    Links count in both directions.  ``seed`` (id, group) gives the groups to begin with (null: the vertex
    alone).  In a pass every vertex may move to the neighbouring group with the greatest gain of modularity, ties
    to the smallest group id; only half of the vertices (by a hash) move in a pass, so that two do not
    swap for ever.  After the passes of a level groups become vertices.  The result is deterministic.
    ``community_id`` is the smallest id of the group.
    """
    ids = vertices.select("id").distinct()
    back = links.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    weights = cut(links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(back).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")), "weights")
    total = weights.agg(F.sum("w").alias("m")).first()["m"] or 0  # twice the number of links
    start = seed.where("group is not null").select("id", "group")
    heads = start.groupBy("group").agg(F.min("id").alias("head"))
    member = ids.join(start.join(heads, "group").select("id", "head"), "id", "left").select("id", F.coalesce("head", "id").alias("c"))
    member = cut(member, "member")
    if not total:
        return member.select("id", F.col("c").alias("community_id"))
    # vertices of a level: v, its group c, and which ids it stands for
    stands = member.select("id", F.col("id").alias("v"))
    state = member.select(F.col("id").alias("v"), "c")
    for level in range(levels):
        degree = cut(weights.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k")), "degree")
        changed = False
        for step in range(passes):
            groups = state.join(degree, "v").groupBy("c").agg(F.sum("k").alias("tot"))
            near = weights.where("a <> b").join(state.withColumnsRenamed({"v": "b"}), "b").groupBy(F.col("a").alias("v"), "c").agg(F.sum("w").alias("inside"))
            own = state.withColumnRenamed("c", "mine")
            # staying is a choice, too: the own group is among the candidates even without links to it
            stay = own.join(degree, "v").select("v", F.col("mine").alias("c"), F.lit(0).cast("long").alias("inside"))
            offers = near.unionByName(stay).groupBy("v", "c").agg(F.sum("inside").alias("inside"))
            rated = offers.join(degree, "v").join(groups, "c").join(own, "v")
            others = F.col("tot") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0)
            gain = F.col("inside") * F.lit(total) - F.col("k") * others  # whole numbers: no rounding
            best = rated.select("v", "mine", F.struct(gain.alias("g"), (F.col("c") == F.col("mine")).cast("int").alias("stays"), "c").alias("o"))
            w = Window.partitionBy("v").orderBy(F.desc("o.g"), F.desc("o.stays"), "o.c")
            won = best.withColumn("n", F.row_number().over(w)).where("n = 1").select("v", F.col("o.c").alias("to"))
            turn = F.pmod(F.xxhash64("v"), F.lit(2)) == step % 2
            moved = cut(state.join(won, "v", "left").select("v", F.when(turn, F.coalesce("to", "c")).otherwise(F.col("c")).alias("c"), F.col("c").alias("was")), "state")
            n = moved.where("c <> was").count()
            state = moved.select("v", "c")
            changed = changed or n > 0
            if not n and step:
                break
        stands = cut(stands.join(state, "v").select("id", F.col("c").alias("v")), "stands")
        if not changed:
            break
        a, b = state.withColumnsRenamed({"v": "a", "c": "ca"}), state.withColumnsRenamed({"v": "b", "c": "cb"})
        weights = cut(weights.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "weights")
        state = cut(state.select(F.col("c").alias("v"), F.col("c")).distinct(), "state")
    first = stands.groupBy("v").agg(F.min("id").alias("community_id"))
    return stands.join(first, "v").select("id", "community_id")


def modularity(links: DataFrame, groups: DataFrame) -> float:
    """Newman's modularity of a grouping (id, group), links taken as undirected."""
    back = links.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    both = links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(back)
    ga, gb = groups.select(F.col("id").alias("a"), F.col("group").alias("ca")), groups.select(F.col("id").alias("b"), F.col("group").alias("cb"))
    per = both.join(ga, "a").join(gb, "b").groupBy("ca").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    r = per.agg(F.sum("inside").alias("i"), F.sum("k").alias("m"), F.sum(F.col("k").cast("double") * F.col("k")).alias("k2")).first()
    return r["i"] / r["m"] - r["k2"] / float(r["m"]) ** 2 if r["m"] else 0.0
