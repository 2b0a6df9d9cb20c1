"""Streaming forms on files that arrive as a stream."""

from pyspark.sql import functions as F

from krysalis.operators import algebra, strategies
from krysalis.plans import fixtures
from krysalis.streaming import monitor


def run_stream(df, spark, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_samples_are_verified(spark, tmp_path):
    rows = [(0, 0, 0, 4.0), (0, 0, 1, 1.0), (0, 1, 0, 1.0), (0, 1, 1, 3.0)]
    a = spark.createDataFrame(rows, "matrix_id long, i int, j int, v double")
    counts = a.select("matrix_id").distinct().withColumn("rows", F.lit(6).cast("long"))
    pairs = strategies.gaussian_forward(a, counts)
    b = algebra.packed(pairs.select("system_id", "matrix_id", "i", F.col("rhs").alias("v")), "system_id", "matrix_id").withColumnRenamed("x", "rhs")
    x = algebra.packed(pairs.select("system_id", "i", F.col("solution").alias("v")), "system_id").withColumnRenamed("x", "solution")
    samples = b.join(x, "system_id").withColumnRenamed("system_id", "sample_id")
    samples = samples.withColumn("rhs", F.when(F.col("sample_id") == 0, F.transform("rhs", lambda v: v + 1)).otherwise(F.col("rhs")))
    samples.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in"))
    out = {r["sample_id"]: r["accurate"] for r in run_stream(monitor.verified(stream, a), spark, "verified", "append").collect()}
    assert out == {k: k != 0 for k in range(6)}


def test_windows_agree_with_the_batch(spark, sf_dir, tmp_path):
    runs = fixtures.runs(spark, sf_dir).orderBy("start_time")
    runs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "in"))
    out = run_stream(monitor.status_windows(stream, "1 day"), spark, "windows", "complete")
    batch = runs.groupBy(F.window(F.col("start_time").cast("timestamp"), "1 day").alias("w"), "status").count()
    assert {(r["start"], r["status"], r["n"]) for r in out.collect()} == {(r["w"]["start"], r["status"], r["count"]) for r in batch.collect()}
