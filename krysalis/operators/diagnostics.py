"""Error metrics and distributions of predictions ``pred(sample_id, y_true, y_pred)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parity_rows(pred: DataFrame) -> DataFrame:
    """``(sample_id, i, y_true, y_pred, residual)``: a row for each component."""
    rows = pred.select("sample_id", F.posexplode(F.arrays_zip("y_true", "y_pred")).alias("i", "p"))
    return rows.select("sample_id", "i", F.col("p.y_true").cast("double").alias("y_true"), F.col("p.y_pred").cast("double").alias("y_pred")).withColumn("residual", F.col("y_true") - F.col("y_pred"))


def mae_mse(pred: DataFrame) -> DataFrame:
    """Mean absolute and mean squared error over all components."""
    return parity_rows(pred).agg(F.avg(F.abs("residual")).alias("mae"), F.avg(F.col("residual") * F.col("residual")).alias("mse"))


def _stats(c: str) -> list[Column]:
    square = F.sqrt(F.sum(F.col(c) * F.col(c)))
    return [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.stddev_pop(c).alias(f"{c}_std"), square.alias(f"{c}_norm")]


def prediction_stats(pred: DataFrame) -> DataFrame:
    """One row: least, greatest, mean, median, deviation and norm of both, error figures and the ratio of norms."""
    found = parity_rows(pred).agg(*_stats("y_true"), *_stats("y_pred"), F.avg(F.abs("residual")).alias("mae"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"), F.max(F.abs("residual")).alias("max_abs"))
    return found.withColumn("scale_ratio", F.col("y_pred_norm") / F.greatest("y_true_norm", F.lit(1e-15)))


def synthetic_error(pred: DataFrame) -> DataFrame:
    """Norm of the error and of the truth, their ratio (infinite for a zero truth), greatest and mean error."""
    found = parity_rows(pred).agg(F.sqrt(F.sum(F.col("residual") * F.col("residual"))).alias("l2_error"), F.sqrt(F.sum(F.col("y_true") * F.col("y_true"))).alias("l2_true"), F.max(F.abs("residual")).alias("max_error"), F.avg(F.abs("residual")).alias("mean_error"))
    return found.withColumn("relative_error", F.when(F.col("l2_true") > 0, F.col("l2_error") / F.col("l2_true")).otherwise(F.lit(float("inf"))))


def histogram(values: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """``(bin, low, high, n)``: equal bins from the least to the greatest value, the last one closed; empty bins have no row.

    The two ends, one row, are joined to all.
    """
    ends = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    placed = values.join(F.broadcast(ends), how="cross")  # one row of ends
    number = F.when(F.col("width") > 0, F.least(F.floor((F.col(value) - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = placed.select(number.alias("bin"), "lo", "width").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("width").alias("width"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), "n")


def norm_histogram(samples: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """The distribution of the norms of an array column."""
    norm = F.sqrt(F.aggregate(F.transform(column, lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v * v))
    return histogram(samples.select(norm.alias("norm")), "norm", bins)


def value_histogram(pred: DataFrame, bins: int = 50) -> DataFrame:
    """Distributions of truths, predictions and errors: ``(series, bin, low, high, n)``."""
    rows = parity_rows(pred)
    out = None
    for name in ("y_true", "y_pred", "residual"):
        part = histogram(rows, name, bins).withColumn("series", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("series", "bin", "low", "high", "n")


def parity_stats(pred: DataFrame) -> DataFrame:
    """Mean absolute error, root mean square error and R², NaN where the truth is constant."""
    rows = parity_rows(pred)
    found = rows.agg(F.avg(F.abs("residual")).alias("mae"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"), F.sum(F.col("residual") * F.col("residual")).alias("sse"), F.var_pop("y_true").alias("var"), F.count(F.lit(1)).alias("n"))
    return found.select("mae", "rmse", F.when(F.col("var") > 0, 1 - F.col("sse") / (F.col("var") * F.col("n"))).otherwise(F.lit(float("nan"))).alias("r2"))
