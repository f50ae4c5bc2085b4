"""Streams read from files as they come, against the same operators on the whole."""

from pyspark.sql import functions as F

from driftline.streaming import sessions

SCHEMA = "volunteer string, timestamp timestamp, lat double, lon double, accuracy_m double"


def files(spark, tmp_path):
    rows = [("v", f"2024-01-01 10:{m:02d}:00", 55.9 + m / 1000, -3.2, 10.0 if m % 2 else 900.0) for m in (0, 1, 2, 30, 31)]
    rows += [("w", f"2024-01-01 11:{m:02d}:00", 55.8, -3.1, None) for m in (0, 5)] + [("z", "2024-01-03 00:00:00", 55.9, -3.2, 1.0)]  # the last moves the watermark
    df = spark.createDataFrame(rows, "volunteer string, at string, lat double, lon double, accuracy_m double").select("volunteer", F.to_timestamp("at").alias("timestamp"), "lat", "lon", "accuracy_m")
    for i, part in enumerate((df.where("volunteer = 'v'"), df.where("volunteer = 'w'"), df.where("volunteer = 'z'"))):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return df, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def run(spark, df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def test_sessions_of_a_stream(spark, tmp_path):
    batch, stream = files(spark, tmp_path)
    out = run(spark, sessions.session_summaries(stream, 600), "own_sessions", tmp_path)
    expected = sessions.session_summaries(batch.where("volunteer <> 'z'"), 600)
    key = lambda df: sorted((r.volunteer, r.n_points, str(r.start_time)) for r in df.collect())
    assert key(expected) == [("v", 2, "2024-01-01 10:30:00"), ("v", 3, "2024-01-01 10:00:00"), ("w", 2, "2024-01-01 11:00:00")]
    assert [r for r in key(out) if r[0] != "z"] == key(expected)


def test_flags_of_a_stream(spark, tmp_path):
    batch, stream = files(spark, tmp_path)
    flagged = run(spark, sessions.qc_points(stream), "own_flags", tmp_path)
    whole = sessions.qc_points(batch)
    assert sorted(map(str, flagged.collect())) == sorted(map(str, whole.collect())) and flagged.count() == 5  # three are too inaccurate
