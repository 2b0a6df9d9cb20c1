"""Streaming forms: samples verified as they arrive, runs counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed_matrices(matrices: DataFrame) -> DataFrame:
    """``(matrix_id, entries)``: each matrix as one array, the static side of a stream join; for matrices that fit a row."""
    return matrices.groupBy("matrix_id").agg(F.collect_list(F.struct("i", "j", "v")).alias("entries"))


def verified(samples: DataFrame, matrices: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """A stream ``samples(sample_id, matrix_id, rhs, solution)`` with ``residual`` and ``accurate``.

    Each row is joined to its matrix and judged alone, so no state is kept:
    ‖Ax − b‖² is the sum over rows of A, each added up from its entries.
    """
    both = samples.join(packed_matrices(matrices), "matrix_id")
    n = F.size("rhs")
    product = F.aggregate(
        "entries",
        F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.lit(0.0)),
        lambda acc, e: F.transform(acc, lambda value, k: value + F.when(k == e["i"], e["v"] * F.get("solution", e["j"])).otherwise(0.0)),
    )
    square = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    error = square(F.zip_with(product, "rhs", lambda a, b: a - b))
    norm = square("rhs")
    residual = F.when(norm > 0, error / norm).otherwise(error)
    return both.withColumn("residual", residual).withColumn("accurate", F.col("residual") <= tolerance).drop("entries")


def status_windows(runs: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream ``runs(start_time, status, ...)`` as counts by window and status; rows later than ``late`` are left out by the watermark."""
    counted = runs.withColumn("start_time", F.col("start_time").cast("timestamp")).withWatermark("start_time", late).groupBy(F.window("start_time", window).alias("w"), "status")
    return counted.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "n")
