"""Windows of a stream against the same sums in batch."""

from pyspark.sql import functions as F

from kairoscope.streaming import ingest


def test_windows(spark, tmp_path):
    rows = [("g", 0, f"2024-01-01 {h:02d}:00:00", 1.0) for h in range(24)] + [("g", 0, "2024-01-05 00:00:00", 1.0), ("g", 0, "2024-01-08 00:00:00", 1.0)]
    data = spark.createDataFrame(rows, "gene string, rep int, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    got = []
    query = ingest.ingest(ingest.windowed(stream, "gene", "rep", "ts", "value"), lambda frame, _: got.extend(ingest.time_points(frame, "2024-01-01 00:00:00", 86400).collect()), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert sorted((r["tp"], r["value"]) for r in got) == [(0, 24.0), (4, 1.0)]
