from datetime import datetime

from pyspark.sql import functions as F

from weftgraph.operators import orphans
from weftgraph.streaming.orphans import follow, tagged

T = datetime
REF = "src_table string, row_id long, key string, observed_at timestamp_ntz, loaded_at timestamp_ntz"
PARENT = "id string, added_at timestamp_ntz, removed_at timestamp_ntz, loaded_at timestamp_ntz"


def test_arrivals_resolve_and_a_restart_repeats_nothing(spark, tmp_path):
    def write(n, refs, parents):
        spark.createDataFrame(refs, REF).coalesce(1).write.mode("append").parquet(f"{tmp_path}/refs")
        spark.createDataFrame(parents, PARENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/parents")

    def run():
        read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        refs = read("refs", REF).select("src_table", "row_id", orphans.digest(F.col("key")).alias("kh"), "observed_at", "loaded_at")
        follow(tagged(refs, orphans.parents(read("parents", PARENT))), f"file://{tmp_path}/state", f"{tmp_path}/checkpoint").awaitTermination(120)
        return {r["row_id"] for r in orphans.OrphanState(spark, f"file://{tmp_path}/state").orphans().collect()}

    at = T(2024, 1, 1)
    write(0, [("edges", 1, "res://a", at, at), ("edges", 2, "res://b", at, at)], [("res://b", None, None, at)])
    assert run() == {1}
    write(1, [("edges", 3, "res://c", at, at)], [("res://a", None, None, at)])
    assert run() == {3}
    assert run() == {3}
