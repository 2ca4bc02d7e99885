from __future__ import annotations

from parity import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakesearch.operators import health as H
from lakesearch.sources.tables import table
from lakesearch.streaming import health as SH
from lakesearch.streaming import windows as SW


def _drain(df, name, mode):
    stream = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return df.sparkSession.table(name)


def _split(spark, tmp_path, n=3):
    folder = tmp_path / "in"
    events = table(spark, SF, "events")
    order = Window.orderBy("ts", "event_id")
    cut = events.withColumn("k", F.ntile(n).over(order)).persist()
    for k in range(1, n + 1):
        cut.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder), events


def test_tumbling_matches_batch(spark, tmp_path):
    folder, events = _split(spark, tmp_path)
    got = _drain(SW.tumbling(SW.event_stream(spark, folder, 100)), "tumbling", "complete")
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert {(r["start"], r["event_type"], r["n"]) for r in got.collect()} == {(r["window"]["start"], r["event_type"], r["n"]) for r in batch.collect()}


def test_sessions_close(spark, tmp_path):
    folder, _ = _split(spark, tmp_path)
    got = _drain(SW.sessions(SW.event_stream(spark, folder)), "sessions", "append")
    assert got.count() > 0 and got.where("start >= `end`").count() == 0


def test_health_stream_matches_fold(spark, tmp_path):
    _, events = _split(spark, tmp_path)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    obs = events.select(F.concat(F.lit("s"), "user_id").alias("source"), F.row_number().over(w).cast("long").alias("sequence"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_type") == "error", "TIMEOUT").alias("code"), F.lit(False).alias("suspended"), (F.col("event_type") != "error").alias("succeeded"), F.lit(True).alias("complete"))
    folder = str(tmp_path / "obs")
    for k in range(3):
        obs.where(F.pmod(F.col("sequence"), F.lit(10)).between(k * 4, k * 4 + 3)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(obs.schema).parquet(folder)
    got = {r["source"]: (r["newest"], r["consecutive"]) for r in _drain(SH.health(stream), "health", "update").collect()}
    want = {r["source"]: (r["newest"], r["consecutive"]) for r in H.fold(obs).collect()}
    assert got == want
