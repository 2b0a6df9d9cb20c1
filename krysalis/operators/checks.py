"""Verification of systems: residuals, angles, shapes and finite values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krysalis.operators.algebra import sizes, spmv
from krysalis.schemas import STANDARD


def relative_residuals(matrices: DataFrame, x: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``(system_id, residual, accurate)``: ‖Ax − b‖ over ‖b‖, absolute where b is zero."""
    both = spmv(matrices, x).join(b.select("system_id", "i", F.col("v").alias("b")), ["system_id", "i"])
    sums = both.groupBy("system_id").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("b"), 2))).alias("e"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("n"))
    residual = F.when(F.col("n") > 0, F.col("e") / F.col("n")).otherwise(F.col("e"))
    return sums.select("system_id", residual.alias("residual"), (residual <= tolerance).alias("accurate"))


def check_ax_b(matrices: DataFrame, x: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``(system_id, cosine, consistent)``: the angle of Ax and b, free of scale; true where either is zero."""
    both = spmv(matrices, x).join(b.select("system_id", "i", F.col("v").alias("b")), ["system_id", "i"])
    sums = both.groupBy("system_id").agg(F.sum(F.col("v") * F.col("b")).alias("ab"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("na"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    empty = (F.col("na") == 0) | (F.col("nb") == 0)
    cosine = F.when(~empty, F.col("ab") / (F.col("na") * F.col("nb")))
    return sums.select("system_id", cosine.alias("cosine"), F.when(empty, True).otherwise(cosine >= 1 - tolerance).alias("consistent"))


def check_matrices(matrices: DataFrame) -> DataFrame:
    """``(matrix_id, n_rows, n_cols, n_bad, ok)``: square and finite."""
    bad = F.isnan("v") | (F.abs("v") == float("inf")) | F.col("v").isNull()
    found = matrices.groupBy("matrix_id").agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols"), F.sum(bad.cast("long")).alias("n_bad"))
    return found.withColumn("ok", (F.col("n_rows") == F.col("n_cols")) & (F.col("n_bad") == 0))


def check_vectors(vectors: DataFrame, matrices: DataFrame) -> DataFrame:
    """``vectors(sample_id, matrix_id, x)`` with ``problem``: null, ``length`` or ``not finite``."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    problem = F.when(~F.size("x").eqNullSafe(F.col("n")), "length").when(~finite, "not finite")
    return vectors.join(sizes(matrices), "matrix_id", "left").withColumn("problem", problem).drop("n")


def check_symmetric(matrices: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """``(matrix_id, asymmetry, is_symmetric)``: the largest |a_ij − a_ji|, absent entries as 0."""
    turned = matrices.select("matrix_id", F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("v")).alias("v"))
    apart = matrices.select("matrix_id", "i", "j", "v").unionByName(turned).groupBy("matrix_id", "i", "j").agg(F.abs(F.sum("v")).alias("d"))
    return apart.groupBy("matrix_id").agg(F.max("d").alias("asymmetry")).withColumn("is_symmetric", F.col("asymmetry") <= tolerance)


def breakdown_reasons(solutions: DataFrame) -> DataFrame:
    """``solutions(system_id, x)`` with ``reason``: what is wrong with the values, or an empty string."""
    nan = F.exists("x", lambda v: F.isnan(v))
    inf = F.exists("x", lambda v: F.abs(v) == float("inf"))
    return solutions.withColumn("reason", F.concat_ws(", ", F.when(nan, "nan"), F.when(inf, "inf")))


def require_non_residual(samples: DataFrame) -> DataFrame:
    """The samples, an error if one is internal to a solver or not tagged."""
    return samples.withColumn("row_kind", F.when(F.col("row_kind") == STANDARD, F.col("row_kind")).otherwise(F.raise_error(F.lit("a row is no standard right-hand side")).cast("tinyint")))
