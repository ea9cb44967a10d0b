import random
import time

from weftgraph.operators import hierarchy

SCHEMA = "node_id string, parent_id string, block string, part string, label string"


def test_descendants_of_ring_members_are_their_own_trees(spark):
    rows = [("A", "B", "x", "A"), ("B", "A", "x", "B"), ("C", "B", "x", "C"), ("D", "C", "x", "D"), ("R", None, "x", "R"), ("S", "R", "x", "S"), ("T", "S", "x", "T"), ("L", "L", "x", "L")]
    h = hierarchy.peel(spark.createDataFrame(rows, "node_id string, parent_id string, block string, label string"), with_paths=True)
    nodes = {r["node_id"]: (r["depth"], r["root_id"], r["n_descendants"], r["cycle_id"]) for r in h.nodes().collect()}
    assert nodes == {
        "A": (0, "A", 0, "A"), "B": (0, "B", 2, "A"), "C": (1, "B", 1, "A"), "D": (2, "B", 0, "A"),
        "R": (0, "R", 2, None), "S": (1, "R", 1, None), "T": (2, "R", 0, None), "L": (0, "L", 0, "L"),
    }
    assert {tuple(r) for r in h.descendants().collect()} == {("B", "C", 1), ("B", "D", 2), ("C", "D", 1), ("R", "S", 1), ("R", "T", 2), ("S", "T", 1)}


def expected(rows):
    """node -> (depth, root, size - 1, cycle, path), by walking."""
    parent = {n: p if p in {r[0] for r in rows} else None for n, p, *_ in rows}
    label = {r[0]: r[4] for r in rows}
    ring = {}
    for n in parent:
        trail, x = [], n
        while x is not None and x not in trail:
            trail.append(x)
            x = parent[x]
        if x is not None:
            members = trail[trail.index(x) :]
            ring |= dict.fromkeys(members, min(members))
    out, below = {}, dict.fromkeys(parent, 0)
    for n in parent:
        chain = [n]
        while parent[chain[-1]] is not None and chain[-1] not in ring:
            chain.append(parent[chain[-1]])
        for up in chain[1:]:
            below[up] += 1
        out[n] = (len(chain) - 1, chain[-1], ring.get(chain[-1]), "/".join(label[x] for x in reversed(chain)))
    return {n: (d, r, below[n], c, p) for n, (d, r, c, p) in out.items()}


def forest(seed):
    """Deep chains across parts, a bushy tree, rings with tails, orphans and a node that is its own parent."""
    rng = random.Random(seed)
    rows = []
    for c in range(4):
        rows += [(f"c{c}_{i:03d}", f"c{c}_{i - 1:03d}" if i else None, "big", f"p{rng.randrange(6)}", f"c{i}") for i in range(60)]
    for k in range(3):
        rows += [(f"r{k}_{i:02d}", f"r{k}_{(i + 1) % 17:02d}", "big", f"p{rng.randrange(6)}", f"r{i}") for i in range(17)]
        rows += [(f"t{k}_{i:02d}", f"t{k}_{i - 1:02d}" if i else f"r{k}_03", "big", f"p{rng.randrange(6)}", f"t{i}") for i in range(25)]
    rows += [(f"b{i:03d}", f"b{rng.randrange(i):03d}" if i else "missing", "small", "q", f"b{i}") for i in range(80)]
    rows += [("self", "self", "small", "q", "self"), ("lone", None, "", "q", "lone")]
    rng.shuffle(rows)
    return rows


def test_split_blocks_and_doubling_agree_with_walking(spark):
    rows = forest(7)
    want = expected(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for block_rows in (20, 150, 100_000):
        h = hierarchy.peel(df, with_paths=True, block_rows=block_rows)
        got = {r["node_id"]: (r["depth"], r["root_id"], r["n_descendants"], r["cycle_id"], r["path"]) for r in h.nodes().collect()}
        assert got == want, block_rows
        assert {r["node_id"] for r in h.in_cycles().collect()} == {n for n, x in want.items() if x[3]}
        assert h.descendants().groupBy("ancestor_id").count().count() == sum(x[2] > 0 for x in want.values())


def test_rounds_grow_with_the_logarithm_of_the_depth(spark):
    """A chain of 4 000 over 200 parts needs a dozen doublings, not thousands of rounds."""
    rows = [(f"n{i:05d}", f"n{i - 1:05d}" if i else None, "one", f"p{i % 200}", "x") for i in range(4000)]
    begun = time.time()
    h = hierarchy.peel(spark.createDataFrame(rows, SCHEMA), block_rows=400)
    got = h.nodes().selectExpr("max(depth) as d", "max(n_descendants) as n", "count(*) as k").first()
    assert (got["d"], got["n"], got["k"]) == (3999, 3999, 4000)
    assert time.time() - begun < 120


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    h = hierarchy.peel(empty, with_paths=True)
    assert h.nodes().count() == h.descendants().count() == h.in_cycles().count() == 0
    h = hierarchy.peel(spark.createDataFrame([(None, "a", None, None, None), ("a", None, None, None, None)], SCHEMA), with_paths=True)
    assert [r["node_id"] for r in h.nodes().collect()] == ["a"]
