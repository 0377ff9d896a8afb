import datetime as dt

from tallyfold.streaming import ingest

T0 = dt.datetime(2025, 3, 3)


def test_a_late_delivery_is_left_out_of_a_closed_window(spark, tmp_path):
    schema = "document_type string, ingested_at timestamp"

    def deliver(name, *days):
        spark.createDataFrame([("invoice", T0 + dt.timedelta(days=d)) for d in days], schema).coalesce(1).write.parquet(str(tmp_path / name))

    def run():
        stream = ingest.read_stream(spark, str(tmp_path / "in*"), spark.createDataFrame([], schema).schema, files_per_batch=1)
        q = ingest.arrivals(stream, window="1 day", lateness="5 days").writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(((r["window_start"] - T0).days, r["documents"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    deliver("in1", 0, 0, 1)
    run()
    deliver("in2", 20)
    assert run() == [(0, 2), (1, 1)]
    deliver("in3", 0, 1, 30)  # the first two are later than the watermark allows
    got = run()
    assert got == [(0, 2), (1, 1), (20, 1)]
