"""Writers of datasets, predictions and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64


def write_dataset(samples: DataFrame, matrices: DataFrame, path: str) -> None:
    """Samples by dataset and hashed matrix bucket, matrices once, and the manifest; nothing is overwritten.

    Buckets keep folders few however many matrices there are, and rows of one
    matrix together for pruning.
    """
    bucket = F.pmod(F.xxhash64("matrix_id"), F.lit(BUCKETS)).cast("int")
    samples.withColumn("matrix_bucket", bucket).sortWithinPartitions("matrix_id").write.partitionBy("dataset_id", "matrix_bucket").parquet(f"{path}/samples")
    matrices.withColumn("matrix_bucket", bucket).sortWithinPartitions("matrix_id", "i", "j").write.partitionBy("matrix_bucket").parquet(f"{path}/matrices")
    build_manifest(samples, matrices).write.json(f"{path}/manifest")


def build_manifest(samples: DataFrame, matrices: DataFrame) -> DataFrame:
    """One row a dataset: samples, matrices, longest vector, standard rows and the layout."""
    found = samples.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_distinct("matrix_id").alias("n_matrices"), F.max(F.size("rhs")).alias("dimension"), F.sum((F.col("row_kind") == 0).cast("long")).alias("n_standard")
    )
    return found.withColumn("layout", F.when(F.col("n_matrices") == 1, "broadcast_single").otherwise("many_matrices"))


def resolve_dataset_scale(meta: DataFrame, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """``(matrix_norm, matrix_scale, shared)`` of ``meta(matrix_id, norm, scale)``: the first norm, and the scale if all agree, else 1."""
    found = meta.agg(F.min_by("norm", "matrix_id").alias("matrix_norm"), F.min_by("scale", "matrix_id").alias("first"), F.min("scale").alias("lo"), F.max("scale").alias("hi"))
    agree = F.greatest(F.col("hi") - F.col("first"), F.col("first") - F.col("lo")) <= atol + rtol * F.abs("first")
    return found.select("matrix_norm", F.when(agree, F.col("first")).otherwise(1.0).alias("matrix_scale"), agree.alias("shared"))


def guard_overwrite(spark: SparkSession, path: str, columns: list[str]) -> None:
    """An error if the folder holds samples of other columns."""
    try:
        held = spark.read.parquet(f"{path}/samples").columns
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return
        raise
    if sorted(c for c in held if c != "matrix_bucket") != sorted(columns):
        raise ValueError(f"{path} holds a dataset of another form")


def prediction_rows(pred: DataFrame, n: int) -> DataFrame:
    """``(sample_id, i, y_true, y_pred, error)`` of the ``n`` samples of least id."""
    first = pred.orderBy("sample_id").limit(n)
    rows = first.select("sample_id", F.posexplode(F.arrays_zip("y_true", "y_pred")).alias("i", "p"))
    return rows.select("sample_id", "i", F.col("p.y_true").alias("y_true"), F.col("p.y_pred").alias("y_pred"), (F.col("p.y_true") - F.col("p.y_pred")).alias("error"))


def export_prediction_rows(pred: DataFrame, n: int, path: str) -> None:
    """The same rows as CSV, a folder for each sample."""
    prediction_rows(pred, n).write.partitionBy("sample_id").csv(path, header=True)


def save_predictions(pred: DataFrame, path: str) -> None:
    """Predictions and targets as Parquet."""
    pred.write.parquet(path)


def comparison_scalars(solves: DataFrame) -> DataFrame:
    """Condition number, iterations and final residual of each solve, for a JSON sink."""
    return solves.select("system_id", "preconditioner", "condition_number", "iterations", F.col("residual").alias("final_residual"))


def save_systems(systems: DataFrame, path: str, dataset: str, rhs_kind: str) -> None:
    """Resolved systems with where they come from."""
    shape = {"n": F.size("rhs"), "dataset": F.lit(dataset), "rhs_kind": F.lit(rhs_kind)}
    systems.withColumns(shape).write.parquet(path)


def ranked(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The table with ``rank`` from 1 inside each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
