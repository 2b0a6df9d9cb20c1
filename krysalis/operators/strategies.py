"""Sample generation: (right-hand side, solution) pairs for every matrix of a table.

A strategy takes matrices and ``budgets(matrix_id, rows)`` and gives component
rows ``(system_id, matrix_id, i, rhs, solution)``. Random numbers are keyed by
seed, row and component and not by matrix, so matrices with equal budgets see
equal vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from krysalis.functions.lineage import once
from krysalis.functions.rng import normal, uniform
from krysalis.operators.algebra import packed, sizes, spmv
from krysalis.operators.blocks import Blocks, gathered, summed
from krysalis.operators.iterate import eigenbasis, lanczos, solve_cg, solve_direct

ROWS = 1 << 24
#: Strategies by name; ``register`` adds to it.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {}
REPLACEMENT: dict[str, bool] = {}


def register(name: str, supports_replacement: bool = False) -> Callable:
    """A decorator that adds a strategy; a name is taken once."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in STRATEGIES:
            raise ValueError(f"{name} is registered already")
        STRATEGIES[name], REPLACEMENT[name] = function, supports_replacement
        return function

    return add


#: Rows that are numbered together.
SPAN = 64


def numbered_rows(budgets: DataFrame) -> DataFrame:
    """``(matrix_id, row)`` from 0 for each row of the budget, dealt out by spans of rows.

    These are rows of sources without an end: -1, all of them, is an error, and
    so are over ``ROWS`` of one matrix.
    """
    wrong = F.when(F.col("rows") > ROWS, F.raise_error(F.lit(f"over {ROWS} rows of a matrix"))).when(F.col("rows") < 0, F.raise_error(F.lit("all rows of a source without an end")))
    spans = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / SPAN))).alias("span")
    held = budgets.withColumn("rows", wrong.otherwise(F.col("rows"))).filter("rows > 0").select("matrix_id", "rows", spans)
    held = held.repartition(int(budgets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "matrix_id", "span")  # a number given is kept: few small rows make many
    last = F.least(F.col("rows"), (F.col("span") + 1) * SPAN) - 1
    return held.select("matrix_id", F.explode(F.sequence(F.col("span") * SPAN, last)).alias("row"))


def grid(matrices: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(system_id, matrix_id, row, i)``: a place for each component of each row of the budget; see ``numbered_rows``."""
    rows = numbered_rows(budgets).join(sizes(matrices), "matrix_id")
    return rows.select((F.col("matrix_id") * ROWS + F.col("row")).alias("system_id"), "matrix_id", "row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))


def random_vectors(matrices: DataFrame, budgets: DataFrame, value: Callable[[Column, Column], Column]) -> DataFrame:
    """Component rows ``(system_id, matrix_id, i, v)`` of ``value(row, i)``."""
    return grid(matrices, budgets).select("system_id", "matrix_id", "i", value(F.col("row"), F.col("i")).cast("double").alias("v"))


def forward(matrices: DataFrame, x: DataFrame) -> DataFrame:
    """Pairs with b = A x, as long as their matrix."""
    x = once(x)
    blocks = Blocks(matrices, x.select("system_id", "matrix_id").distinct())
    both = gathered_product(blocks, x)
    return blocks.rows(both, "rhs", "solution").select("system_id", "matrix_id", "i", "rhs", "solution")


def gathered_product(blocks: Blocks, x: DataFrame) -> DataFrame:
    """Component rows x as chunks ``solution`` with their products ``rhs`` beside them."""
    held = blocks.chunked(x).withColumnRenamed("v", "x")
    both = blocks.carried(held, "x") if blocks.single else gathered(held, blocks.times(held.withColumnRenamed("x", "v")))
    return both.selectExpr("system_id", "matrix_id", "c", f"{summed('ys', 'x')} AS rhs", "x AS solution")


def inverse(matrices: DataFrame, b: DataFrame, method: str = "direct", **options) -> DataFrame:
    """Pairs with A x = b, solved directly in tasks or by conjugate gradients over all systems."""
    if method == "cg":
        x = solve_cg(matrices, b, **options).select("system_id", "i", F.col("x").alias("solution"))
        return b.join(x, ["system_id", "i"]).select("system_id", "matrix_id", "i", F.col("v").alias("rhs"), "solution")
    solved = solve_direct(matrices, packed(b, "system_id", "matrix_id"))
    pairs = solved.select("system_id", "matrix_id", F.posexplode(F.arrays_zip("x", "solution")).alias("i", "p"))
    return pairs.select("system_id", "matrix_id", "i", F.col("p.x").alias("rhs"), F.col("p.solution").alias("solution"))


@register("random", True)
def random(matrices, budgets, seed=42, target_rhs_scale=1.0):
    """Normal solutions of deviation ``target_rhs_scale``."""
    return forward(matrices, random_vectors(matrices, budgets, lambda r, i: normal(seed, r, i) * target_rhs_scale))


register("normal", True)(random)


@register("gaussian_forward", True)
def gaussian_forward(matrices, budgets, seed=42, mu=0.0, sigma=1.0):
    """Normal solutions."""
    return forward(matrices, random_vectors(matrices, budgets, lambda r, i: normal(seed, r, i) * sigma + mu))


@register("gaussian_inverse", True)
def gaussian_inverse(matrices, budgets, seed=42, mu=0.0, sigma=1.0, method="direct", **options):
    """Normal right-hand sides, solved."""
    return inverse(matrices, random_vectors(matrices, budgets, lambda r, i: normal(seed, r, i) * sigma + mu), method, **options)


@register("uniform_forward")
def uniform_forward(matrices, budgets, seed=42, a=0.0, b=1.0):
    """Uniform solutions in [a, b)."""
    return forward(matrices, random_vectors(matrices, budgets, lambda r, i: uniform(seed, r, i) * (b - a) + a))


@register("uniform_inverse")
def uniform_inverse(matrices, budgets, seed=42, a=0.0, b=1.0, method="direct", **options):
    """Uniform right-hand sides, solved."""
    return inverse(matrices, random_vectors(matrices, budgets, lambda r, i: uniform(seed, r, i) * (b - a) + a), method, **options)


@register("constant_forward")
def constant_forward(matrices, budgets, seed=42, value=1.0):
    """Constant solutions: the right-hand side is the row sums times ``value``, summed once a matrix."""
    sums = matrices.groupBy("matrix_id", "i").agg((F.sum("v") * value).alias("rhs"))
    places = grid(matrices, budgets).join(sums, ["matrix_id", "i"], "left")
    return places.select("system_id", "matrix_id", "i", F.coalesce("rhs", F.lit(0.0)).alias("rhs"), F.lit(float(value)).alias("solution"))


@register("constant_inverse")
def constant_inverse(matrices, budgets, seed=42, value=1.0, method="direct", **options):
    """Constant right-hand sides, solved."""
    return inverse(matrices, random_vectors(matrices, budgets, lambda r, i: F.lit(float(value))), method, **options)


@register("neutral_ones")
def neutral_ones(matrices, budgets, seed=42):
    """The vector of ones as solution."""
    return constant_forward(matrices, budgets, seed, 1.0)


@register("sparse_rhs")
def sparse_rhs(matrices, budgets, seed=42, indices=(0,), values=(1.0,), method="direct", **options):
    """The same sparse right-hand side in each row, solved; negative places count from the end."""
    if len(indices) != len(values):
        raise ValueError("as many values as indices are needed")
    meta = sizes(matrices)
    places = grid(matrices, budgets).join(meta, "matrix_id")
    value = F.lit(0.0)
    for k, v in zip(indices, values, strict=True):
        value = F.when(F.col("i") == F.pmod(F.lit(k) + F.col("n"), F.col("n")), F.lit(float(v))).otherwise(value)
    return inverse(matrices, places.select("system_id", "matrix_id", "i", value.alias("v")), method, **options)


def _skip(budgets: DataFrame) -> Column:
    """The archived rows that earlier bindings took, as ``archive_offsets`` counts them; none where the budget does not say."""
    return F.coalesce(F.col("skip"), F.lit(0)).cast("long") if "skip" in budgets.columns else F.lit(0).cast("long")


def _held(archive: DataFrame, budgets: DataFrame) -> DataFrame:
    """The rows of ``archive(matrix_id, row, ...)`` under ``budgets(matrix_id, rows, skip)``, the last column optional.

    They begin after ``skip`` rows; -1 takes all of the rest, and an archive
    that ends before is an error.
    """
    budgets = budgets.withColumn("skip", _skip(budgets))
    supply = archive.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("supply"))
    short = budgets.join(supply, "matrix_id", "left").filter(F.coalesce("supply", F.lit(0)) < F.col("skip") + F.greatest("rows", F.lit(0))).select("matrix_id", "rows", "skip").first()
    if short:
        raise ValueError(f"the archive of matrix {short[0]} is shorter than its budget of {short[1]} rows after {short[2]}")
    return archive.join(budgets, "matrix_id").filter((F.col("row") >= F.col("skip")) & ((F.col("rows") < 0) | (F.col("row") < F.col("skip") + F.col("rows"))))


@register("solution_archive")
def solution_archive(matrices, budgets, seed=42, archive=None, scale=1.0):
    """Archived solutions ``archive(matrix_id, row, x)`` and their right-hand sides."""
    held = _held(archive, budgets)
    x = held.select((F.col("matrix_id") * ROWS + F.col("row")).alias("system_id"), "matrix_id", F.posexplode("x").alias("i", "v"))
    return forward(matrices, x.withColumn("v", F.col("v") * scale))


@register("scaled_solutions")
def scaled_solutions(matrices, budgets, seed=42, archive=None, scale=5.0):
    """Archived solutions times ``scale``."""
    return solution_archive(matrices, budgets, seed, archive, scale)


@register("rhs_archive")
def rhs_archive(matrices, budgets, seed=42, archive=None, method="direct", **options):
    """Archived right-hand sides ``archive(matrix_id, row, x)``, solved."""
    held = _held(archive, budgets)
    b = held.select((F.col("matrix_id") * ROWS + F.col("row")).alias("system_id"), "matrix_id", F.posexplode("x").alias("i", "v"))
    return inverse(matrices, b, method, **options)


@register("validated_archive")
def validated_archive(matrices, budgets, seed=42, solutions=None, rhs=None, tolerance=1e-6, fail=True):
    """Archived pairs whose residual is within ``tolerance``; others are an error, or left out."""
    pairs = solutions.join(rhs.withColumnRenamed("x", "b"), ["matrix_id", "row"])
    both = _held(pairs, budgets).select((F.col("matrix_id") * ROWS + F.col("row")).alias("system_id"), "matrix_id", F.posexplode(F.arrays_zip("x", "b")).alias("i", "p"))
    x = both.select("system_id", "matrix_id", "i", F.col("p.x").alias("v"))
    found = spmv(matrices, x).select("system_id", "i", F.col("v").alias("ax"))
    joined = both.join(found, ["system_id", "i"])
    sums = joined.groupBy("system_id").agg(F.sqrt(F.sum(F.pow(F.col("ax") - F.col("p.b"), 2))).alias("e"), F.sqrt(F.sum(F.col("p.b") * F.col("p.b"))).alias("n"))
    residual = F.when(F.col("n") > 0, F.col("e") / F.col("n")).otherwise(F.col("e"))
    good = sums.select("system_id", F.when(residual <= tolerance, True).otherwise(F.raise_error(F.lit("an archived pair is not a solution")).cast("boolean") if fail else F.lit(False)).alias("good"))
    return joined.join(good, "system_id").filter("good").select("system_id", "matrix_id", "i", F.col("p.b").alias("rhs"), F.col("p.x").alias("solution"))


def _combined(basis: DataFrame, budgets: DataFrame, count: int, seed: int, include: bool) -> DataFrame:
    """Unit-norm random mixes of ``count`` eigenvectors for each row; with ``include`` the vectors themselves come first."""
    rows = numbered_rows(budgets)
    weights = rows.select("matrix_id", "row", F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: normal(seed, F.col("row"), k)).alias("w"))
    length = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, v: s + v * v))
    weights = weights.select("matrix_id", "row", F.posexplode(F.transform("w", lambda v: v / length)).alias("k", "c"))
    if include:
        own = F.when(F.col("row") < count, (F.col("row") == F.col("k")).cast("double")).otherwise(F.col("c"))
        weights = weights.withColumn("c", own).filter("c <> 0")
    mixed = weights.join(basis, ["matrix_id", "k"]).groupBy("matrix_id", "row", "i").agg(F.sum(F.col("c") * F.col("v")).alias("v"))
    return mixed.select((F.col("matrix_id") * ROWS + F.col("row")).alias("system_id"), "matrix_id", "i", "v")


@register("eigenvector_forward")
def eigenvector_forward(matrices, budgets, seed=42, count=4, which="smallest", include=False):
    """Mixes of chosen eigenvectors as solutions."""
    return forward(matrices, _combined(eigenbasis(matrices, count, which, seed), budgets, count, seed, include))


@register("eigenvector_inverse")
def eigenvector_inverse(matrices, budgets, seed=42, count=4, which="smallest", include=False, method="direct", **options):
    """Mixes of chosen eigenvectors as right-hand sides, solved."""
    return inverse(matrices, _combined(eigenbasis(matrices, count, which, seed), budgets, count, seed, include), method, **options)


@register("krylov")
def krylov(matrices, budgets, seed=42, krylov_iters=8):
    """x = V Q Λ⁻¹ ε over a Lanczos basis V with T = Q Λ Qᵀ; the small problems are solved in tasks."""
    basis, steps = lanczos(matrices, krylov_iters, seed)

    def weights(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        m = len(part)
        beta = part["beta"].to_numpy()[: m - 1]
        values, q = np.linalg.eigh(np.diag(part["alpha"].to_numpy()) + np.diag(beta, 1) + np.diag(beta, -1))
        safe = np.where(np.abs(values) > 1e-14, values, np.inf)
        k, e = np.meshgrid(np.arange(m), np.arange(m), indexing="ij")
        return pd.DataFrame({"matrix_id": part["matrix_id"].iloc[0], "k": k.ravel(), "e": e.ravel(), "q": (q / safe).ravel()})

    small = steps.groupBy("matrix_id").applyInPandas(weights, "matrix_id long, k int, e int, q double")
    rows = numbered_rows(budgets)
    coefficients = small.join(rows, "matrix_id").groupBy("matrix_id", "row", "k").agg(F.sum(F.col("q") * normal(seed, F.lit("krylov"), F.col("row"), F.col("e"))).alias("c"))
    mixed = coefficients.join(basis, ["matrix_id", "k"]).groupBy("matrix_id", "row", "i").agg(F.sum(F.col("c") * F.col("v")).alias("v"))
    return forward(matrices, mixed.select((F.col("matrix_id") * ROWS + F.col("row")).alias("system_id"), "matrix_id", "i", "v"))


def _traces(matrices, x, iterations, every_n):
    """The trace rows of conjugate gradients on A x, with the true solution alongside."""
    b = spmv(matrices, x)
    steps = solve_cg(matrices, b, 1e-20, 1e-20, iterations, trace=True).filter(F.col("iter") % every_n == 0)
    return steps.join(x.select("system_id", "i", F.col("v").alias("truth")), ["system_id", "i"])


def _single(matrices, systems, single_rhs, iterations, every_n, starts=None, truth=True):
    """The trace rows of ``systems(matrix_id, rows)`` that all have their matrix's one right-hand side ``single_rhs(matrix_id, i, v)``.

    The exact solution is computed once a matrix. Without ``starts`` all systems
    of a matrix begin at zero and have the same trace, so one is run and
    repeated; with ``starts(matrix_id, row, i, v)`` each runs from its own.
    """
    rows = numbered_rows(systems).withColumn("system_id", F.col("matrix_id") * ROWS + F.col("row"))
    b = single_rhs.select("matrix_id", "i", "v")
    if starts is None:
        once = b.join(rows.select("matrix_id").distinct(), "matrix_id").select(F.col("matrix_id").alias("system_id"), "matrix_id", "i", "v")
        steps = solve_cg(matrices, once, 1e-20, 1e-20, iterations, trace=True).drop("system_id").join(rows.drop("row"), "matrix_id")
    else:
        own = rows.join(b, "matrix_id").select("system_id", "matrix_id", "i", "v")
        x0 = starts.join(rows, ["matrix_id", "row"]).select("system_id", "i", "v")
        steps = solve_cg(matrices, own, 1e-20, 1e-20, iterations, trace=True, x0=x0)
    steps = steps.filter(F.col("iter") % every_n == 0)
    if not truth:
        return steps
    solved = solve_direct(matrices, packed(b.select(F.col("matrix_id").alias("system_id"), "matrix_id", "i", "v"), "system_id", "matrix_id"))
    return steps.join(solved.select("matrix_id", F.posexplode("solution").alias("i", "truth")), ["matrix_id", "i"])


def _systems(budgets, per):
    """Budgets of trace rows as budgets of systems; -1 stays."""
    return budgets.withColumn("rows", F.when(F.col("rows") < 0, F.col("rows")).otherwise(F.ceil(F.col("rows") / per)).cast("long"))


def _archived(budgets, archive, per):
    """Component rows of the archived vectors that the budget's traces start from."""
    held = _held(archive, _systems(budgets, per))
    return held.select((F.col("matrix_id") * ROWS + F.col("row")).alias("system_id"), "matrix_id", F.posexplode("x").alias("i", "v"))


@register("residuals", True)
def residuals(matrices, budgets, seed=42, archive=None, iterations=8, every_n=1, single_rhs=None, starts=None):
    """Rows (r_k, x* − x_k) of conjugate gradients from zero, x* from the archive; ``iter`` tells the step.

    ``budgets.rows`` are trace rows a matrix: enough systems are run, and the
    rows over the budget are cut; -1 rows mean all rows of all archived systems.
    ``budgets.skip``, where there is one, counts archived systems. With
    ``single_rhs(matrix_id, i, v)`` all systems of a matrix have that right-hand
    side, x* is its exact solution, and -1 is an error; they start from
    ``starts(matrix_id, row, i, v)``, where given.
    """
    per = iterations // every_n + 1
    if single_rhs is not None:
        budgets = budgets.drop("skip")
        steps = _single(matrices, _systems(budgets, per), single_rhs, iterations, every_n, starts)
    else:
        steps = _traces(matrices, _archived(budgets, archive, per), iterations, every_n)
    return _cut(steps, budgets, per, every_n, F.col("r"), F.col("truth") - F.col("x"))


@register("gaussian_residuals", True)
def gaussian_residuals(matrices, budgets, seed=42, iterations=8, every_n=1, single_rhs=None, starts=None):
    """As ``residuals``, for normal x*; -1 rows are an error."""
    if single_rhs is not None:
        return residuals(matrices, budgets, seed, None, iterations, every_n, single_rhs, starts)
    per = iterations // every_n + 1
    x = random_vectors(matrices, _systems(budgets, per), lambda r, i: normal(seed, r, i))
    return _cut(_traces(matrices, x, iterations, every_n), budgets.drop("skip"), per, every_n, F.col("r"), F.col("truth") - F.col("x"))


@register("search_directions", True)
def search_directions(matrices, budgets, seed=42, archive=None, iterations=8, every_n=1, single_rhs=None, starts=None):
    """Rows (A p_k, p_k) of the same runs: on archived x*, as ``residuals`` takes them, else on normal ones; for ``single_rhs`` no exact solution is needed."""
    per = iterations // every_n + 1
    if single_rhs is not None:
        budgets = budgets.drop("skip")
        steps = _single(matrices, _systems(budgets, per), single_rhs, iterations, every_n, starts, truth=False)
    elif archive is not None:
        steps = _traces(matrices, _archived(budgets, archive, per), iterations, every_n)
    else:
        budgets = budgets.drop("skip")
        steps = _traces(matrices, random_vectors(matrices, _systems(budgets, per), lambda r, i: normal(seed, r, i)), iterations, every_n)
    return _cut(steps, budgets, per, every_n, F.col("ap"), F.col("p"))


def _cut(steps: DataFrame, budgets: DataFrame, per: int, every_n: int, rhs: Column, solution: Column) -> DataFrame:
    """The first rows of each matrix's traces, as many as its budget: a row's number is its system's after those skipped times ``per`` and its place among the steps kept."""
    budgets = budgets.withColumn("skip", _skip(budgets))
    numbered = steps.join(budgets, "matrix_id").withColumn("number", (F.col("system_id") - F.col("matrix_id") * ROWS - F.col("skip")) * per + F.floor(F.col("iter") / every_n))
    return numbered.filter((F.col("rows") < 0) | (F.col("number") < F.col("rows"))).select("system_id", "matrix_id", "iter", "i", rhs.alias("rhs"), solution.alias("solution"))


def generate(matrices: DataFrame, budgets: DataFrame, seed: int = 42, options: dict[str, dict] | None = None) -> DataFrame:
    """Component rows of all strategies of ``budgets(strategy, matrix_id, rows)``, with ``strategy``.

    Strategies are few and named by the caller's budget; each is one lazily
    built part of a union.
    """
    names = [r[0] for r in budgets.select("strategy").distinct().limit(len(STRATEGIES) + 1).collect()]
    out = None
    for name in sorted(names):
        part = STRATEGIES[name](matrices, budgets.filter(F.col("strategy") == name).drop("strategy"), seed=seed, **(options or {}).get(name, {}))
        part = part.withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


__all__ = ["STRATEGIES", "generate", "register"]
