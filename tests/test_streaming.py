from factloom.operators.orphans import OrphanTracker
from factloom.operators.search import scan
from factloom.sources.store import GraphStore
from factloom.streaming.ingest import event_counts, ingest_entities, track_orphans


def test_entities_arrive_in_batches(spark, tmp_path):
    schema = "input_id long, name string, entity_type string, properties string, confidence double"
    src = str(tmp_path / "in")
    store = GraphStore(spark, f"file://{tmp_path}/store")
    for rows in ([(1, "Ann", "Person", '{"aa": "1"}', None), (2, "", "Person", None, None)], [(3, " Ann ", "Person", '{"bb": "2"}', 0.5), (4, "Acme", "Company", None, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest_entities(spark.readStream.schema(schema).parquet(src), store, ["Person", "Company"], f"{tmp_path}/cp").awaitTermination()
    got = {r["name"]: r for r in scan(store.graph().vertices).collect()}
    assert set(got) == {"Ann", "Acme"}, got
    assert got["Ann"]["properties"] == {"aa": "1", "bb": "2"}, got
    assert got["Ann"]["properties"] == {"aa": "1", "bb": "2"} and got["Ann"]["confidence"] == 0.5
    assert store.version == 2


def test_orphans_in_a_stream(spark, tmp_path):
    schema = "kind string, id string, from_id string, to_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"
    src, tracker = str(tmp_path / "in"), OrphanTracker(spark)
    from datetime import datetime as T

    for rows in ([("parent", "a", None, None, T(2025, 1, 1), None), ("reference", "r1", "a", "b", T(2025, 1, 2), None)], [("parent", "b", None, None, T(2025, 2, 1), None), ("reference", "r2", "b", None, T(2025, 2, 2), None), ("parent", "a", None, None, T(2025, 2, 3), T(2025, 1, 1, 12))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        track_orphans(spark.readStream.schema(schema).parquet(src), tracker, f"{tmp_path}/cp").awaitTermination()
    assert {tuple(r) for r in tracker.found().collect()} == {("relationships", "r1", "to_id"), ("relationships", "r1", "from_id")}
    assert [tuple(r) for r in tracker.monthly().orderBy("month").collect()] == [("relationships", "2025-01", 2, 2), ("relationships", "2025-02", 0, 1)]


def test_windows(spark, tmp_path):
    from datetime import datetime as T

    schema = "ts timestamp_ntz, event_type string, value double"
    spark.createDataFrame([(T(2025, 1, 1, 0, 5), "x", 1.0), (T(2025, 1, 1, 0, 50), "x", 2.0), (T(2025, 1, 1, 1, 5), "y", 4.0)], schema).write.parquet(str(tmp_path / "e"))
    q = event_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.table("windows").collect()) == [("x", 2, 3.0), ("y", 1, 4.0)]
