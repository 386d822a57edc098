from glintspan.streaming import sessions


def test_stream_gives_what_the_batch_gives(spark):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src).selectExpr("user_id", "CAST(ts AS timestamp) AS ts", "event_type")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001").selectExpr("user_id", "CAST(ts AS timestamp) AS ts", "event_type")
    q = sessions.label_counts(stream, "ts", "event_type", "1 day", late="60 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, sessions.label_counts(batch, "ts", "event_type", "1 day").collect()))
    assert sorted(map(tuple, spark.sql("SELECT * FROM counts").collect())) == want
