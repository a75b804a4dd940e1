"""The window functions give a stream the rows they give a batch."""

from tellgrid.streaming import events as stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 3, "ab"[i % 2], float(i)) for i in range(0, 50, 2)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "timestamp(t) ts", "user_id", "event_type", "value")
    df.union(df.limit(3)).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    once = stream.once_per_event(source)
    query = stream.tumbling(once, "10 minutes").writeStream.format("memory").queryName("windows").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.sql("select * from windows").collect()}
    want = {tuple(r) for r in stream.tumbling(df, "10 minutes").collect()}
    assert got <= want and len(got) >= len(want) - 4  # windows the watermark has not passed are still open
    sessions = stream.sessions(df, "7 minutes")
    assert sum(r.n for r in sessions.collect()) == len(rows)
