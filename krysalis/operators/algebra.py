"""Matrix and vector algebra as joins and aggregations.

Matrices are rows ``(matrix_id, i, j, v)`` without zeros; vectors are rows
``(system_id, matrix_id, i, v)``, one per component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from krysalis.functions.lineage import once


def sizes(matrices: DataFrame) -> DataFrame:
    """``(matrix_id, n)``: one more than the largest index."""
    return matrices.groupBy("matrix_id").agg((F.greatest(F.max("i"), F.max("j")) + 1).cast("int").alias("n"))


def unpacked(vectors: DataFrame, x: str = "x", *keys: str) -> DataFrame:
    """Array vectors as component rows: ``keys, i, v``."""
    return vectors.select(*keys, F.posexplode(x).alias("i", "v"))


def packed(rows: DataFrame, *keys: str) -> DataFrame:
    """Component rows as array vectors in order of ``i``: ``keys, x``."""
    pairs = F.array_sort(F.collect_list(F.struct("i", "v")))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("x"))


def spmv(matrices: DataFrame, x: DataFrame) -> DataFrame:
    """``(system_id, matrix_id, i, v)`` of A x for every system; components of x that are absent are zero.

    Every index of the matrix and of the vector gets a row, so an empty row of
    A gives 0. Matrices are packed in blocks and multiplied with many vectors at
    once (``blocks``).
    """
    from krysalis.operators.blocks import Blocks

    x = once(x)
    blocks = Blocks(matrices, x.select("system_id", "matrix_id").distinct())
    return blocks.rows(blocks.product(blocks.chunked(x)).select("system_id", "matrix_id", "c", "v"), "v").select("system_id", "matrix_id", "i", "v")


def dot(a: DataFrame, b: DataFrame, name: str, key: str = "system_id") -> DataFrame:
    """``(key, name)``: inner products by system."""
    other = b.select(key, "i", F.col("v").alias("w"))
    return a.join(other, [key, "i"]).groupBy(key).agg(F.sum(F.col("v") * F.col("w")).alias(name))


def norm_one(matrices: DataFrame) -> DataFrame:
    """Largest column sum of absolute values by matrix."""
    return matrices.groupBy("matrix_id", "j").agg(F.sum(F.abs("v")).alias("s")).groupBy("matrix_id").agg(F.max("s").alias("norm_one"))


def norm_inf(matrices: DataFrame) -> DataFrame:
    """Largest row sum of absolute values by matrix."""
    return matrices.groupBy("matrix_id", "i").agg(F.sum(F.abs("v")).alias("s")).groupBy("matrix_id").agg(F.max("s").alias("norm_inf"))


def norm_frobenius(matrices: DataFrame) -> DataFrame:
    """Root of the sum of squares by matrix."""
    return matrices.groupBy("matrix_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_frobenius"))


def gershgorin_bound(matrices: DataFrame) -> DataFrame:
    """An upper bound of the spectral radius: the larger of the row and column norms."""
    both = norm_one(matrices).join(norm_inf(matrices), "matrix_id")
    return both.select("matrix_id", F.greatest("norm_one", "norm_inf").alias("bound"))


def one_norm_scale(matrices: DataFrame) -> DataFrame:
    """The one-norm over the size, by matrix."""
    return norm_one(matrices).join(sizes(matrices), "matrix_id").select("matrix_id", (F.col("norm_one") / F.col("n")).alias("scale"))


def diagonal(matrices: DataFrame) -> DataFrame:
    """``(matrix_id, i, v)`` of every diagonal place, absent ones as 0."""
    places = sizes(matrices).select("matrix_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    held = matrices.filter("i = j").select("matrix_id", "i", "v")
    return places.join(held, ["matrix_id", "i"], "left").select("matrix_id", "i", F.coalesce("v", F.lit(0.0)).alias("v"))


def check_diagonal(matrices: DataFrame, threshold: float = 1e-15) -> DataFrame:
    """The diagonal places under ``threshold``: a diagonal to divide by has none."""
    return diagonal(matrices).filter(F.abs("v") < threshold)


def vector_norms(vectors: DataFrame, x: str = "x") -> DataFrame:
    """The table with ``norm``, the Euclidean norm of its array column."""
    return vectors.withColumn("norm", F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)))


def vector_stats(rows: DataFrame, key: str = "system_id") -> DataFrame:
    """Norm, mean, population deviation, least and greatest component by system."""
    return rows.groupBy(key).agg(
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("greatest")
    )


def gram(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, i, j, v``: the sum over samples of x xᵀ. ``rows`` has ``keys, x``: each array is expanded against itself, no join."""
    first = rows.select(*keys, "x", F.posexplode("x").alias("i", "a"))
    pairs = first.select(*keys, "i", "a", F.posexplode("x").alias("j", "b"))
    return pairs.groupBy(*keys, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def galerkin(matrices: DataFrame, basis: DataFrame) -> DataFrame:
    """The coarse operators ``(matrix_id, a, b, v)`` = Φᵀ A Φ for ``basis(matrix_id, i, mode, v)``."""
    right = basis.select("matrix_id", F.col("i").alias("j"), F.col("mode").alias("b"), F.col("v").alias("w"))
    half = matrices.join(right, ["matrix_id", "j"]).groupBy("matrix_id", "i", "b").agg(F.sum(F.col("v") * F.col("w")).alias("w"))
    left = basis.select("matrix_id", "i", F.col("mode").alias("a"), "v")
    return half.join(left, ["matrix_id", "i"]).groupBy("matrix_id", "a", "b").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def dense(part: pd.DataFrame, n: int | None = None) -> np.ndarray:
    """One matrix's rows as a dense array, inside a task."""
    n = n or int(max(part["i"].max(), part["j"].max())) + 1
    a = np.zeros((n, n))
    np.add.at(a, (part["i"].to_numpy(), part["j"].to_numpy()), part["v"].to_numpy())
    return a


def guarded(matrices: DataFrame, largest: int) -> DataFrame:
    """The matrices with their ``n``, an error if one is too large for a task: over ``largest`` rows."""
    n = F.when(F.col("n") <= largest, F.col("n")).otherwise(F.raise_error(F.lit(f"a matrix has over {largest} rows")).cast("int"))
    return matrices.join(sizes(matrices).withColumn("n", n), "matrix_id").select(*matrices.columns, "n")


def singular_values(matrices: DataFrame, largest: int = 4096) -> DataFrame:
    """``(matrix_id, k, sigma)`` by a dense decomposition of each matrix in a task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        s = np.linalg.svd(dense(part), compute_uv=False)
        return pd.DataFrame({"matrix_id": part["matrix_id"].iloc[0], "k": np.arange(len(s)), "sigma": s})

    return guarded(matrices, largest).groupBy("matrix_id").applyInPandas(run, "matrix_id long, k int, sigma double")


def norm_nuclear(matrices: DataFrame) -> DataFrame:
    """The sum of singular values by matrix."""
    return singular_values(matrices).groupBy("matrix_id").agg(F.sum("sigma").alias("norm_nuclear"))


def norm_spectral(matrices: DataFrame) -> DataFrame:
    """The largest singular value by matrix; see ``iterate.power_norm`` for matrices beyond a task."""
    return singular_values(matrices).groupBy("matrix_id").agg(F.max("sigma").alias("norm_spectral"))


def condition_number_exact(matrices: DataFrame) -> DataFrame:
    """Largest over smallest singular value; NaN where the smallest is 0."""
    ends = singular_values(matrices).groupBy("matrix_id").agg(F.max("sigma").alias("hi"), F.min("sigma").alias("lo"))
    return ends.select("matrix_id", F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(F.lit(float("nan"))).alias("condition_number"))


def pod_basis(snapshots: DataFrame, rank: float | int, largest: int = 4096) -> DataFrame:
    """``(matrix_id, mode, i, v, eigenvalue, energy)``: leading modes of uncentred snapshots ``(matrix_id, x)``.

    A whole ``rank`` is the number of modes; a fraction in (0, 1] the least
    captured energy. The Gram matrix is summed by Spark, so a task sees n x n
    numbers however many snapshots there are.
    """
    whole = isinstance(rank, int)

    def modes(part: pd.DataFrame) -> pd.DataFrame:
        values, vectors = np.linalg.eigh(dense(part))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        energy = np.cumsum(values) / max(values.sum(), 1e-300)
        k = min(rank, len(values)) if whole else int(np.searchsorted(energy, rank - 1e-12) + 1)
        keep = vectors[:, :k]
        keep = keep * np.where(keep[np.abs(keep).argmax(0), np.arange(k)] < 0, -1, 1)
        mode, i = np.meshgrid(np.arange(k), np.arange(len(values)), indexing="ij")
        return pd.DataFrame({"matrix_id": part["matrix_id"].iloc[0], "mode": mode.ravel(), "i": i.ravel(), "v": keep.T.ravel(), "eigenvalue": values[mode.ravel()], "energy": energy[mode.ravel()]})

    return guarded(gram(snapshots, "matrix_id"), largest).groupBy("matrix_id").applyInPandas(modes, "matrix_id long, mode int, i int, v double, eigenvalue double, energy double")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """A value for comparison: rounded, and no negative zero."""
    return F.round(c, digits) + F.lit(0.0)
