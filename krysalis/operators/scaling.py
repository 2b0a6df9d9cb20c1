"""Normalisation of systems: scales by matrix, right-hand side or spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krysalis.operators.algebra import gershgorin_bound, sizes, vector_norms
from krysalis.operators.models import NORMALIZATIONS

TINY = 1e-15


def matrix_scale(matrices: DataFrame) -> DataFrame:
    """``(matrix_id, n, bound, dimension_scale, scale)``: the bound of the spectral radius times the root of the size."""
    root = F.sqrt(F.col("n").cast("double"))
    return gershgorin_bound(matrices).join(sizes(matrices), "matrix_id").select("matrix_id", "n", "bound", root.alias("dimension_scale"), (F.col("bound") * root).alias("scale"))


def normalize_matrices(matrices: DataFrame, meta: DataFrame) -> DataFrame:
    """Every matrix over its scale."""
    return matrices.join(meta.select("matrix_id", "scale"), "matrix_id").select("matrix_id", "i", "j", (F.col("v") / F.col("scale")).alias("v"))


def scale_rhs(rhs: DataFrame, meta: DataFrame) -> DataFrame:
    """``rhs(system_id, matrix_id, i, v)`` over its matrix's scale: the solution stays."""
    return rhs.join(meta.select("matrix_id", "scale"), "matrix_id").select("system_id", "matrix_id", "i", (F.col("v") / F.col("scale")).alias("v"))


def normalize_by_matrix(systems: DataFrame) -> DataFrame:
    """``systems(a, b, scale, n)``: both over scale and root n; a scale that is not positive is an error."""
    by = F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.raise_error(F.lit("scale must be positive")).cast("double")) * F.sqrt(F.col("n").cast("double"))
    return systems.withColumns({"a": F.col("a") / by, "b": F.col("b") / by})


def normalize_by_rhs(matrices: DataFrame, rhs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A and b over ‖b‖√n for ``rhs(matrix_id, b array)``; a vanishing norm is an error."""
    norms = vector_norms(rhs, "b")
    safe = F.when(F.col("norm") >= TINY, F.col("norm")).otherwise(F.raise_error(F.lit("the right-hand side is zero")).cast("double"))
    by = norms.select("matrix_id", "b", (safe * F.sqrt(F.size("b").cast("double"))).alias("by"))
    a = matrices.join(by.select("matrix_id", "by"), "matrix_id").select("matrix_id", "i", "j", (F.col("v") / F.col("by")).alias("v"))
    return a, by.select("matrix_id", F.transform("b", lambda v: v / F.col("by")).alias("b"))


def normalize_by_spectral(matrices: DataFrame, systems: DataFrame, spectral: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A/(σ√n), and for ``systems(matrix_id, b, x)`` b/(‖b‖√n) and xσ/‖b‖, with ``spectral(matrix_id, sigma)``."""
    root = F.sqrt(F.col("n").cast("double"))
    meta = spectral.join(sizes(matrices), "matrix_id")
    a = matrices.join(meta, "matrix_id").select("matrix_id", "i", "j", (F.col("v") / (F.col("sigma") * root)).alias("v"))
    both = vector_norms(systems, "b").join(meta, "matrix_id")
    return a, both.select("matrix_id", F.transform("b", lambda v: v / (F.col("norm") * root)).alias("b"), F.transform("x", lambda v: v * F.col("sigma") / F.col("norm")).alias("x"))


def restore(matrices: DataFrame, meta: DataFrame) -> DataFrame:
    """Normalised matrices back to their scale; a matrix without one is an error."""
    scale = F.coalesce("scale", F.raise_error(F.concat(F.lit("no scale for matrix "), F.col("matrix_id").cast("string"))).cast("double"))
    return matrices.join(meta.select("matrix_id", "scale"), "matrix_id", "left").select("matrix_id", "i", "j", (F.col("v") * scale).alias("v"))


def system_scales(systems: DataFrame) -> DataFrame:
    """``systems(mode, rhs_kind, normalized, scale, rhs_norm, n)`` with the divisors ``a_by`` and ``b_by``.

    Modes: ``none``, ``matrix``, ``rhs``, ``both``. A stored matrix that is
    normalised already is not divided again; then only a right-hand side that
    comes raw from outside (``raw_rhs``) is, once, by the stored scale. A fresh
    matrix takes its right-hand side along, except synthetic ones (``gaussian``,
    ``sparse``), which are drawn for the scaled system. ``rhs`` and ``both``
    divide the right-hand side by its own norm. Modes that were registered
    (``models.register_source`` with ``NORMALIZATIONS``) are functions of their
    rows that return them with both divisors; a mode that nobody knows is an
    error.
    """
    known = ["none", "matrix", "rhs", "both"]
    own = {n: f for n, f in NORMALIZATIONS.items() if n not in known}
    wrong = F.raise_error(F.concat(F.lit("no such normalisation: "), F.col("mode"))).cast("string")
    rest = systems.withColumn("mode", F.when(F.col("mode").isin(*known), F.col("mode")).otherwise(wrong)) if not own else systems.filter(F.col("mode").isNull() | ~F.col("mode").isin(*own)).withColumn("mode", F.when(F.col("mode").isin(*known), F.col("mode")).otherwise(wrong))
    out = _built_in_scales(rest)
    for name, mode in own.items():
        out = out.unionByName(mode(systems.filter(F.col("mode") == name)).select(*out.columns))
    return out


def _built_in_scales(systems: DataFrame) -> DataFrame:
    by_matrix = F.col("mode").isin("matrix", "both")
    by_rhs = F.col("mode").isin("rhs", "both")
    synthetic = F.col("rhs_kind").isin("gaussian", "sparse")
    a_by = F.when(by_matrix & ~F.col("normalized"), F.col("scale")).otherwise(1.0)
    follows = F.when(F.col("normalized"), F.col("rhs_kind") == "raw_rhs").otherwise(~synthetic)
    b_scale = F.when(by_matrix & follows, F.col("scale")).otherwise(1.0)
    b_norm = F.when(by_rhs & (F.col("rhs_norm") > 0), F.col("rhs_norm") / b_scale).otherwise(1.0)
    return systems.withColumns({"a_by": a_by, "b_by": b_scale * b_norm})


def rhs_target_scale(rhs: DataFrame, mode: str) -> DataFrame:
    """``scale`` = ‖b‖/√n for mode ``rhs``, else 1, for ``rhs(b array)``."""
    norms = vector_norms(rhs, "b")
    value = F.col("norm") / F.sqrt(F.size("b").cast("double")) if mode == "rhs" else F.lit(1.0)
    return norms.withColumn("scale", value).drop("norm")
