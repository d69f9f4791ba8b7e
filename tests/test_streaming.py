from datetime import datetime

from merganser.streaming.ingest import parsed_stream, participation_stream


def run(spark, frame, name, mode):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_counts_and_names(spark, tmp_path):
    rows = [(1, 7, datetime(2024, 1, 1)), (1, 7, datetime(2024, 1, 1)), (2, 7, datetime(2024, 1, 1)), (2, 8, datetime(2024, 1, 1))]
    schema = "event_id long, entity_id long, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/p")
    got = run(spark, participation_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/p")), "counts", "complete")
    assert {r.entity_id: r.events for r in got} == {7: 2, 8: 1}
    spark.createDataFrame([(1, "Smith, John")], "entity_id long, title string").write.parquet(f"{tmp_path}/e")
    got = run(spark, parsed_stream(spark.readStream.schema("entity_id long, title string").parquet(f"{tmp_path}/e")), "names", "append")
    assert [(r.first, r.last) for r in got] == [("john", "smith")]
