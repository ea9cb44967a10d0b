from datetime import datetime

import __spark_entry__


def test_toy_graph(spark, tmp_path):
    t = [datetime(2023, 1, k) for k in range(1, 10)]
    nodes = [(f"res://r/{x}", None, t[0]) for x in "ABCDE"] + [("res://r/F", None, t[0]), ("res://r/F", t[1], t[1])]
    kind = "id string, removed_at timestamp_ntz, loaded_at timestamp_ntz"
    spark.createDataFrame(nodes, kind).write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([("class:Node", None, t[0])], kind).write.parquet(f"{tmp_path}/shared_nodes.parquet")
    pairs = ["AB", "BC", "CA", "CD", "DE", "AB", "DD", "AF", "AX"]
    edges = [(i, f"res://r/{a}", f" res://r/./{b}", False, t[1]) for i, (a, b) in enumerate(pairs)]
    edges += [(50, "res://r/E", "res://r/A", True, t[1]), (50, "res://r/E", "class:Node", False, t[2]), (51, "res://r/E", None, True, t[1])]
    spark.createDataFrame(edges, "edge_id long, source_id string, target_id string, resolved boolean, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/edges.parquet")
    q = __spark_entry__.queries()
    want = {("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("D", "E"), ("E", "class:Node")}
    got = [tuple(x.removeprefix("res://r/") for x in r) for r in q["op1_links"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
    fan = {r["node_id"].removeprefix("res://r/"): (r["fan_in"], r["fan_out"]) for r in q["op5_fan"](spark, str(tmp_path)).collect()}
    assert fan == {"A": (1, 1), "B": (1, 1), "C": (1, 2), "D": (1, 1), "E": (1, 1), "class:Node": (1, 0)}
