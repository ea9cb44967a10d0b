import random

from weftgraph.operators import fan, graph, stats

IDS = "ABCDE"
LINKS = ["AB", "BC", "CA", "CD", "DE"]


def toy(spark):
    ids = spark.createDataFrame([(x,) for x in IDS], "id string")
    return ids, spark.createDataFrame([(a, b) for a, b in LINKS], "source_id string, target_id string")


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def found(df):
    return {(r["root"], r["id"], r["depth"]) for r in df.collect()}


def test_reach(spark):
    _, links = toy(spark)
    assert found(graph.reach(links, roots(spark, "A"))) == {("A", "B", 1), ("A", "C", 2), ("A", "D", 3), ("A", "E", 4)}
    assert found(graph.reach(links, roots(spark, "A"), 2)) == {("A", "B", 1), ("A", "C", 2)}
    assert found(graph.reach(links, roots(spark, "E"), reverse=True)) == {("E", "D", 1), ("E", "C", 2), ("E", "B", 3), ("E", "A", 4)}
    assert found(graph.reach(links, roots(spark, "nobody", None))) == set()
    both = graph.reach(links, roots(spark, "A", "D", "D"))
    assert {r for r in found(both) if r[0] == "D"} == {("D", "E", 1)}


def test_forward_and_reverse_reach_are_each_other_turned(spark):
    rng = random.Random(3)
    rows = sorted({(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(60)})
    links = spark.createDataFrame([r for r in rows if r[0] != r[1]], "source_id string, target_id string")
    every = roots(spark, *[f"n{i:02d}" for i in range(30)])
    forth = {(a, b, d) for a, b, d in found(graph.reach(links, every))}
    back = {(b, a, d) for a, b, d in found(graph.reach(links, every, reverse=True))}
    assert forth == back


def test_components(spark):
    ids, links = toy(spark)
    for block in (0, 2, 1000):
        got = {r["id"]: (r["component_id"], r["size"]) for r in graph.components(ids, links, block).collect()}
        assert got == {"A": ("A", 3), "B": ("A", 3), "C": ("A", 3), "D": ("D", 1), "E": ("E", 1)}
    assert {r["id"] for r in graph.cycles(ids, links).collect()} == {"A", "B", "C"}


def test_components_distributed_and_in_one_task_agree(spark):
    rng = random.Random(11)
    rows = sorted({(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(80)})
    links = spark.createDataFrame([r for r in rows if r[0] != r[1]], "source_id string, target_id string").repartition(3)
    ids = spark.createDataFrame([(f"n{i:02d}",) for i in range(60)], "id string")
    one = {tuple(r) for r in graph.components(ids, links).collect()}
    assert {tuple(r) for r in graph.components(ids, links, 0).collect()} == one
    # by walking: two nodes share a component when each reaches the other
    out = {}
    for a, b in rows:
        if a != b:
            out.setdefault(a, set()).add(b)

    def far(x):
        seen, todo = set(), [x]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    reach = {f"n{i:02d}": far(f"n{i:02d}") for i in range(60)}
    for name, component, size in one:
        mates = {m for m in reach if m == name or (m in reach[name] and name in reach[m])}
        assert (component, size) == (min(mates), len(mates))


def test_degrees(spark):
    ids, links = toy(spark)
    got = {r["node_id"]: (r["fan_in"], r["fan_out"]) for r in fan.fan(ids, links).collect()}
    assert got["A"] == (1, 1) and got["C"] == (1, 2) and got["E"] == (1, 0)
    assert sum(x for x, _ in got.values()) == sum(y for _, y in got.values()) == links.count()


def test_projection(spark):
    ids, links = toy(spark)
    groups = spark.createDataFrame([("A", "core"), ("B", "core"), ("C", "core"), ("D", "leaf"), ("E", "leaf"), ("F", "alone"), ("G", None)], "id string, group string")
    vertices, found_links = graph.project(groups, links)
    assert {r[0] for r in vertices.collect()} == {"core", "leaf", "alone"}
    assert [tuple(r) for r in found_links.collect()] == [("core", "leaf")]
    c = {r["unit"]: (r["ca"], r["ce"], r["instability"]) for r in stats.coupling(groups, links).collect()}
    assert c == {"core": (0, 1, 1.0), "leaf": (1, 0, 0.0), "alone": (0, 0, None)}


def test_neighbours_show_a_self_loop_twice(spark):
    edges = spark.createDataFrame([("calls", "A", "B", "code", True), ("calls", "A", "A", "code", False)], "type string, source_id string, target_id string, origin string, resolved boolean")
    rows = graph.neighbours(edges, spark.createDataFrame([("A",)], "id string")).collect()
    assert sorted((r["direction"], r["peer"]) for r in rows) == [("inbound", "A"), ("outbound", "A"), ("outbound", "B")]


def test_focus_and_walks(spark):
    ids, links = toy(spark)
    near = {(r["id"], r["hops"]) for r in graph.focus(links, roots(spark, "C"), 1).collect()}
    assert near == {("B", 1), ("A", 1), ("D", 1)}
    one = lambda *x: spark.createDataFrame([(y,) for y in x], "id string")
    got = {(r["path"], r["hops"]) for r in graph.walks(links, one("A"), one("E", "A", "D"), 4).collect()}
    assert got == {("A", 0), ("A > B > C > D", 3), ("A > B > C > D > E", 4)}


def test_communities_find_two_cliques(spark):
    rows = [(f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(6) for j in range(6) if i != j] + [("x0", "y0")]
    links = spark.createDataFrame(rows, "source_id string, target_id string")
    ids = spark.createDataFrame([(f"{g}{i}",) for g in "xy" for i in range(6)] + [("z",)], "id string")
    none = spark.createDataFrame([], "id string, group string")
    got = {r["id"]: r["community_id"] for r in graph.communities(ids, links, none).collect()}
    assert {got[f"x{i}"] for i in range(6)} == {"x0"} and {got[f"y{i}"] for i in range(6)} == {"y0"} and got["z"] == "z"
    groups = spark.createDataFrame(list(got.items()), "id string, group string")
    alone = spark.createDataFrame([(k, k) for k in got], "id string, group string")
    assert graph.modularity(links, groups) > 0.4 > graph.modularity(links, alone)
    seeded = {r["id"]: r["community_id"] for r in graph.communities(ids, links, groups).collect()}
    assert seeded == got


def test_sprawl(spark):
    first = spark.createDataFrame([(f"n{i}", "dir") for i in range(4)], "id string, group string")
    second = spark.createDataFrame([(f"n{i}", "a" if i else "b") for i in range(4)], "id string, group string")
    r = stats.sprawl(first, second).first()
    assert (r["n"], r["n_parts"], r["purity"]) == (4, 2, 0.75) and abs(r["entropy"] - 0.8113) < 1e-4


def test_empty_graph(spark):
    ids = spark.createDataFrame([], "id string")
    links = spark.createDataFrame([], "source_id string, target_id string")
    assert graph.components(ids, links).count() == graph.reach(links, roots(spark, "A")).count() == fan.fan(ids, links).count() == 0


def test_declared_domains_and_directories(spark):
    ids = spark.createDataFrame([("res://r/ui/menu/a.gd::f",), ("res://shared/x.gd",), ("class:Node",), ("res://b.gd",)], "id string")
    got = {r["id"]: r["group"] for r in graph.by_rules(ids, {"shared/**": "shared", "*/ui/**": "ui"}).collect()}
    assert got == {"res://r/ui/menu/a.gd::f": "ui", "res://shared/x.gd": "shared", "class:Node": None, "res://b.gd": None}
    folder = {r["id"]: r["d"] for r in ids.select("id", graph.directory("id").alias("d")).collect()}
    assert folder == {"res://r/ui/menu/a.gd::f": "res://r/ui/menu/", "res://shared/x.gd": "res://shared/", "class:Node": None, "res://b.gd": "res://"}
