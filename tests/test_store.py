import pytest

from weftgraph import store
from weftgraph.project import BOUNDARY_SCHEMA, DIAGNOSTIC_SCHEMA, EDGE_SCHEMA, NODE_SCHEMA, Project


def project(spark, n=3):
    nodes = [(f"res://n{i}.gd", "script", f"res://n{i}.gd", i, None if i % 2 else '{"arity": 2}', None) for i in range(n)]
    edges = [(i, "calls", f"res://n{i}.gd", f"res://n{(i + k) % n}.gd", "code", bool(i % 2), 0.5, "f", i, None) for i in range(n) for k in (1, 2)]
    points = [(i, "egress", "file_io", f"res://n{i}.gd", None, "f", i, '{"p": 1}') for i in range(n)]
    meta = spark.createDataFrame([("version", "4.3")], "key string, value string")
    return Project(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA), spark.createDataFrame(points, BOUNDARY_SCHEMA), spark.createDataFrame([("gd", "f", 1, "m")], DIAGNOSTIC_SCHEMA), meta)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_what_is_saved_is_loaded_and_replaced_as_a_whole(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    with pytest.raises(store.StoreError):
        s.load()
    p = project(spark)
    s.save(p)
    q = store.Store(spark, str(tmp_path / "db")).load()
    for a in ("nodes", "edges", "boundaries", "diagnostics"):
        assert rows(getattr(p, a)) == rows(getattr(q, a))
    assert q.unresolved().count() == p.unresolved().count()
    assert s.meta("version") == "4.3" and s.meta("analyzed_at").endswith("Z") and s.meta("nothing") is None
    for n in (5, 2, 1):
        s.save(project(spark, n))
    assert s.load().nodes.count() == 1
    assert len(list((tmp_path / "db" / "snapshots").iterdir())) == store.KEPT
    assert s.findings().count() == 0


def test_older_layouts_are_brought_up_to_date(spark):
    old = spark.createDataFrame([(1, "calls", "a", "b", None)], "edge_id int, type string, source_id string, target_id string, confidence double")
    new = store.migrate({"edges": old}, 1)["edges"]
    assert new.schema.simpleString() == spark.createDataFrame([], EDGE_SCHEMA).schema.simpleString()
    assert new.first()["confidence"] == 1.0 and new.first()["ev_file"] is None
    bare = store.migrate({"edges": old.drop("confidence")}, 1)["edges"]
    assert bare.first()["confidence"] == 1.0
    with pytest.raises(store.StoreError):
        store.migrate({"edges": old}, store.SCHEMA_VERSION + 1)
