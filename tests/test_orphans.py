from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__
from weftgraph.operators import orphans

T = datetime


def tables(spark, d):
    node = "id string, kind string, added_at timestamp_ntz, removed_at timestamp_ntz, loaded_at timestamp_ntz"
    nodes = [
        ("res://r/a", "x", T(2022, 1, 1), None, T(2023, 2, 1)),  # resolves edge 1 in the second month
        ("res://r/b", "x", T(2022, 1, 1), None, T(2023, 1, 1)),
        ("res://r/b", "x", T(2022, 1, 1), T(2022, 6, 1), T(2023, 4, 9)),  # reopens edge 2 in the fourth
        ("res://r/b", "x", T(2022, 1, 1), T(2022, 6, 1), T(2023, 4, 9)),
        ("res://r/c", "x", T(2025, 1, 1), None, None),
    ]
    spark.createDataFrame(nodes, node).write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([("class:Node", "class", None, None, T(2022, 12, 5))], node).write.parquet(f"{d}/shared_nodes.parquet")
    edges = [
        (1, "res://r/./a", T(2022, 7, 1), T(2023, 1, 3)),
        (2, " res://r/b", T(2022, 7, 1), T(2023, 1, 3)),
        (3, "res://r/gone", T(2022, 7, 1), T(2023, 1, 4)),
        (3, "signal:x:y", T(2022, 7, 1), T(2023, 3, 4)),  # ceases to be a reference in the third month
        (4, "res://r/c", T(2022, 8, 1), T(2023, 1, 4)),
        (4, "class:Node", T(2022, 8, 1), T(2023, 1, 5)),
        (5, "res://r/none", None, T(2024, 1, 1)),
        (6, None, T(2022, 8, 1), None),
    ]
    spark.createDataFrame(edges, "edge_id long, target_id string, observed_at timestamp_ntz, loaded_at timestamp_ntz").write.parquet(f"{d}/edges.parquet")
    spark.createDataFrame([(1, "res://r/c", T(2026, 1, 1), T(2023, 3, 1))], "boundary_id long, match_key string, observed_at timestamp_ntz, loaded_at timestamp_ntz").write.parquet(f"{d}/boundaries.parquet")
    return [spark.read.parquet(f"{d}/{t}.parquet") for t in ("nodes", "shared_nodes", "edges", "boundaries")]


def test_orphans_that_are_resolved_within_a_year_are_counted(spark, tmp_path):
    tables(spark, tmp_path)
    got = __spark_entry__.queries()["p2_snapshots"](spark, str(tmp_path)).where("src_table = 'edges' and month = '2022-07'").collect()
    # December 2022 is batch 1, January 2024 batch 14
    assert {r["batch_no"]: (r["n_references"], r["n_orphans"]) for r in got} == {2: (3, 2), 3: (3, 1), 4: (2, 0), **{k: (2, 1) for k in range(5, 15)}}


def test_history_equals_the_state_fed_month_by_month(spark, tmp_path):
    refs, records = orphans._tables(*tables(spark, tmp_path))
    no = F.coalesce(F.year("loaded_at") * 12 + F.month("loaded_at") - (2022 * 12 + 12) + 1, F.lit(1))
    state, want = orphans.OrphanState(spark), set()
    for k in range(1, 6):
        state.apply(refs.where(no == k), records.where(no == k))
        want |= {(*r, k) for r in state.snapshot().collect()}
    assert {tuple(r) for r in orphans.history(refs, records).where("batch_no < 6").collect()} == want


def rows_of(spark, n_refs, n_parents, late=()):
    refs = [("edges", i, f"res://p{i % n_parents}", T(2024, 1, 1), T(2024, 1, 2)) for i in range(n_refs)]
    parents = [(f"res://p{i}", T(2023, 1, 1), None, T(2024, 1, 1)) for i in range(n_parents) if i not in late]
    return keyed(spark, refs), recorded(spark, parents)


def keyed(spark, rows):
    df = spark.createDataFrame(rows, "src_table string, row_id long, key string, observed_at timestamp_ntz, loaded_at timestamp_ntz")
    return df.select("src_table", "row_id", orphans.digest(F.col("key")).alias("kh"), "observed_at", "loaded_at")


def recorded(spark, rows):
    df = spark.createDataFrame(rows, "id string, added_at timestamp_ntz, removed_at timestamp_ntz, loaded_at timestamp_ntz")
    return orphans.parents(df)


def test_a_small_batch_reads_little_and_the_state_can_be_opened_again(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    state = orphans.OrphanState(spark, folder)
    refs, parents = rows_of(spark, 20_000, 400, late={1, 2})
    state.apply(refs, parents)
    assert state.orphans().count() == 100
    again = orphans.OrphanState(spark, folder)
    assert again.batch == 1
    # what a batch reads of the verdicts: only buckets of keys that changed
    read = []
    touched = again._touched
    again._touched = lambda df, table, schema: read.append((table, touched(df, table, schema))) or read[-1][1]
    new = keyed(spark, [("edges", 50_000 + i, f"res://p{i % 400}", T(2024, 1, 5), T(2024, 1, 6)) for i in range(200)])
    change = recorded(spark, [("res://p1", T(2023, 1, 1), None, T(2024, 1, 5)), ("res://p7", T(2023, 1, 1), T(2023, 12, 1), T(2024, 1, 5))])
    again.apply(new, change)
    seen = sum(df.count() for table, df in read if table == "verdicts")
    assert 0 < seen <= 0.1 * 20_000
    # p1 arrived, p2 is still missing, p7 was removed
    want = {i for i in range(20_000) if i % 400 in (2, 7)} | {50_000 + i for i in range(200) if i % 400 in (2, 7)}
    assert {r["row_id"] for r in orphans.OrphanState(spark, folder).orphans().collect()} == want


def test_a_batch_that_died_is_repeated(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    state = orphans.OrphanState(spark, folder)
    refs, parents = rows_of(spark, 100, 10, late={3})
    state.apply(refs, parents)
    # a second batch that wrote its tables but not the pointer
    state.apply(keyed(spark, [("edges", 500, "res://none", T(2024, 2, 1), T(2024, 2, 1))]), recorded(spark, []))
    from weftgraph.plans.materialize import replace_text

    replace_text(spark, f"{folder}/BATCH", "1")
    state = orphans.OrphanState(spark, folder)
    assert state.orphans().count() == 10
    state.apply(keyed(spark, []), recorded(spark, [("res://p3", None, None, T(2024, 2, 1))]))
    assert state.orphans().count() == 0 and state.batch == 2


def test_a_hot_key_and_superseded_versions(spark):
    rows = [("edges", i, "res://hot" if i < 900 else f"res://x{i}", T(2024, 1, 1), T(2024, 1, 2)) for i in range(1000)]
    rows += [("edges", 5, "res://cold", T(2024, 1, 1), T(2024, 1, 3)), ("edges", 6, None, T(2024, 1, 1), T(2024, 1, 3)), ("edges", 7, "res://cold", T(2024, 1, 1), None)]
    state = orphans.OrphanState(spark)
    state.apply(keyed(spark, rows), recorded(spark, [("res://hot", None, None, T(2024, 1, 1))]))
    assert {r["row_id"] for r in state.orphans().collect()} == {5, *range(900, 1000)}
    counts = state.snapshot().first()
    assert (counts["n_references"], counts["n_orphans"]) == (999, 101)


def test_empty_tables_give_an_empty_state(spark):
    state = orphans.OrphanState(spark)
    state.apply(keyed(spark, []), recorded(spark, []))
    assert state.orphans().count() == state.snapshot().count() == 0
    assert orphans.replay(keyed(spark, []), recorded(spark, [])).orphans().count() == 0
