"""Solvers and spectra that advance all systems together.

The state of a loop is a table of vectors in chunks; one step is a product with
packed matrices (``blocks``) and sums by system. Each step's state is written to
the shared folder, finished systems drop out, and a step's counts of both kinds
reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from krysalis.functions.lineage import discard, materialize, once
from krysalis.functions.rng import normal
from krysalis.operators.algebra import dense, diagonal, guarded, sizes
from krysalis.operators.blocks import CHUNK, KEY, PLACE, Blocks, by_system, gathered, inner, plus, scaled, summed, total, zeros
from krysalis.operators.preconditioners import Identity, Preconditioner, TwoGrid, named

RTOL, ATOL = 1e-6, 1e-14


#: Right-hand sides that one factorisation serves, about.
SOLVED_TOGETHER = 512


def solve_direct(matrices: DataFrame, rhs: DataFrame, largest: int = 4096) -> DataFrame:
    """``rhs(system_id, matrix_id, x)`` with ``solution``: one factorisation of a matrix for each chunk of its right-hand sides.

    Right-hand sides of a matrix are dealt out by hash to as many chunks as
    their number asks for, so a matrix with most of them is solved by many
    tasks; a singular one gives null.
    """
    count = rhs.groupBy("matrix_id").agg(F.ceil(F.count(F.lit(1)) / SOLVED_TOGETHER).alias("chunks"))
    parts = rhs.join(count, "matrix_id").withColumn("chunk", F.pmod(F.xxhash64("system_id"), F.col("chunks")).cast("int")).drop("chunks")
    wanted = parts.select(F.col("matrix_id").alias("m"), F.col("chunk").alias("c")).distinct()
    sent = guarded(matrices, largest).join(wanted, F.col("matrix_id") == F.col("m")).select("m", "c", "i", "j", "v")

    def run(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = b[["system_id", "matrix_id", "x"]].copy()
        out["solution"] = None
        if len(a) and len(b):
            m, v = dense(a, len(b["x"].iloc[0])), np.stack(b["x"].to_numpy()).T
            try:
                out["solution"] = list(np.linalg.solve(m, v).T)
            except np.linalg.LinAlgError:
                pass
        return out

    grouped = parts.groupBy("matrix_id", "chunk").cogroup(sent.groupBy("m", "c"))
    return grouped.applyInPandas(run, "system_id long, matrix_id long, x array<double>, solution array<double>")


def _apply(matrices: DataFrame, state: DataFrame, of: str, out: str) -> DataFrame:
    """The state with ``out`` = A · ``of``: products meet by (matrix, column), sums by (system, row)."""
    a = matrices.select("matrix_id", F.col("j").alias("i"), F.col("i").alias("row"), F.col("v").alias("a"))
    products = state.select("system_id", "matrix_id", "i", of).join(a, ["matrix_id", "i"])
    sums = products.groupBy("system_id", F.col("row").alias("i")).agg(F.sum(F.col("a") * F.col(of)).alias(out))
    return state.join(sums, ["system_id", "i"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


_START = "x", "r", "p", "ap"
_STEP = ("iter", "converged", "breakdown", "norm", "alpha", "rz", "goal")


def _in(names) -> str:
    """SQL: the row's preconditioner is one of these."""
    return "preconditioner IN (" + ", ".join("'" + n.replace("'", "\\'") + "'" for n in names) + ")" if names else "false"


def _next(blocks: Blocks, state: DataFrame, step: int, general: dict[str, Preconditioner], flexible: list[str], older: list[DataFrame], m_max: int, tolerance: float) -> tuple[DataFrame, list[DataFrame]]:
    """The state of ``step`` from the one before it, and tables to discard once it is written.

    x and r move along p; z comes from r, A z from one product. The direction is
    z + β p, and A times it A z + β A p, so a step has one product and one more
    shuffle, by system, or none where a vector is one chunk. Flexible systems take z less its parts along the last
    directions instead.
    """
    names = [*PLACE, "m", "rz", "goal"]
    r = plus("r", "-alpha", "ap") if step else "r"
    moved = state.selectExpr(*names, f"{plus('x', 'alpha', 'p')} AS x", f"{r} AS r", "p AS p0", "ap AS ap0") if step else state.selectExpr(*names, "x", "r")
    used: list[DataFrame] = []
    z_rows = None
    if general:
        moved = materialize(moved)
        used.append(moved)
        for name, preconditioner in general.items():
            rows = moved.filter(F.col("preconditioner") == name).select(*PLACE, F.col("r").alias("v"))
            part = preconditioner.apply(rows, step).select(*PLACE, "v")
            z_rows = part if z_rows is None else z_rows.unionByName(part)
        z_rows = materialize(z_rows)
        used.append(z_rows)
        for preconditioner in general.values():
            preconditioner.done()
    moved = moved.selectExpr("*", f"CASE WHEN {_in(general)} THEN NULL ELSE {scaled('r', 'm')} END AS z")
    vectors = moved.filter("z IS NOT NULL").select(*PLACE, F.col("z").alias("v"))
    extra = None
    if z_rows is not None:
        vectors = vectors.unionByName(z_rows)
        extra = z_rows.select(*KEY, "c", F.col("v").alias("z1"))
    single, back = blocks.single and not general and not flexible, flexible and step
    if back:
        parts = _along([t.filter(_in(flexible)) for t in older[-max(1, step % (m_max + 1)) :]], vectors.filter(_in(flexible)))
        extra = parts if extra is None else extra.unionByName(parts, allowMissingColumns=True)
    both = blocks.carried(moved, "z") if single else gathered(moved, blocks.times(vectors), extra)
    kept = [*names, "x", "r", *(("p0", "ap0") if step else ()), *(("dp", "dap") if back else ())]
    both = both.selectExpr(*kept, "coalesce(z, z1) AS z" if z_rows is not None else "z", "ys").selectExpr(*kept, "z", f"{summed('ys', 'z')} AS q")
    both = both.selectExpr("*", f"{by_system(inner('r', 'z'), single)} AS rz1", f"sqrt({by_system(inner('r', 'r'), single)}) AS norm")
    if step:
        beta = "CASE WHEN rz <> 0 THEN rz1 / rz ELSE 0D END"
        p, ap = plus("z", "beta", "p0"), plus("q", "beta", "ap0")
        if back:
            p, ap = (f"CASE WHEN {_in(flexible)} THEN {plus(v, '-1D', d)} ELSE {plain} END" for v, d, plain in (("z", "dp", p), ("q", "dap", ap)))
        both = both.selectExpr("*", f"{beta} AS beta").selectExpr("*", f"{p} AS p", f"{ap} AS ap")
    else:
        both = both.selectExpr("*", "z AS p", "q AS ap")
    both = both.selectExpr("*", f"{by_system(inner('p', 'ap'), single)} AS pap", f"CASE WHEN {_in(flexible)} THEN {by_system(inner('p', 'r'), single)} ELSE rz1 END AS along")
    stuck = f"(isnan(pap) OR isnan(norm) OR abs(pap) <= {tolerance!r}D OR along = 0)"
    last = (f"CASE WHEN {stuck} THEN 0D ELSE along / pap END AS alpha", f"{step} AS iter", "norm <= goal AS converged", f"{stuck} AND NOT norm <= goal AS breakdown", "rz1 AS rz")
    return both.selectExpr(*PLACE, "m", *_START, "pap", "norm", "goal", *last), used


def _along(directions: list[DataFrame], z: DataFrame) -> DataFrame:
    """``(KEY, c, dp, dap)``: the sums of p and A p over the last directions, each times (z · A p) / (p · A p)."""
    kept = None
    for k, t in enumerate(directions):
        part = t.select(*KEY, "c", "p", "ap", "pap", F.lit(k).alias("k"))
        kept = part if kept is None else kept.unionByName(part)
    both = kept.join(z.select(*KEY, "c", "v"), [*KEY, "c"]).repartition(*KEY)
    share = f"CASE WHEN pap <> 0 THEN sum({inner('v', 'ap')}) OVER (PARTITION BY {', '.join(KEY)}, k) / pap ELSE 0D END"
    parts = both.selectExpr(*KEY, "c", "p", "ap", f"{share} AS share").selectExpr(*KEY, "c", "transform(p, v -> v * share) AS p", "transform(ap, v -> v * share) AS ap")
    sums = parts.groupBy(*KEY, "c").agg(F.collect_list("p").alias("ps"), F.collect_list("ap").alias("aps"))
    return sums.selectExpr(*KEY, "c", f"{total('ps', 'ps[0]')} AS dp", f"{total('aps', 'aps[0]')} AS dap")


def cg_steps(matrices: DataFrame, rhs: DataFrame, preconditioners: dict[str, Preconditioner] | None = None, rtol: float = RTOL, atol: float = ATOL, max_iters: int = 100, m_max: int = 20, breakdown_tol: float = 0.0, trace: bool = False, x0: DataFrame | None = None, chunk: int = CHUNK) -> tuple[Blocks, DataFrame]:
    """Conjugate gradients, all systems in one loop: ``(blocks, states)``.

    ``rhs(system_id, matrix_id, i, v)`` and ``preconditioner``, a name in
    ``preconditioners``, where there is more than the identity: a system under
    two of them is two systems, told apart by both columns. States are chunks
    ``PLACE, x, r, p, ap, pap, iter, converged, breakdown, norm, ...`` at the
    end of each system, or with ``trace`` of every step. A system stops at
    ‖r‖ ≤ max(rtol ‖b‖, atol), after ``max_iters`` steps, or where |p·Ap| is at
    most ``breakdown_tol`` or not a number. Systems with a preconditioner that is
    not ``linear`` take flexible steps: a direction is made conjugate to the last
    ones, up to ``m_max`` of them, with a restart after as many. Systems start
    from ``x0(system_id, i, v)``, where it has them, else from zero.

    A step is written once; the step before it is deleted then, unless a trace
    or flexible directions still need it.
    """
    preconditioners, matrices, rhs = preconditioners or {"identity": Identity()}, once(matrices), once(rhs)
    blocks = Blocks(matrices, rhs.select("system_id", "matrix_id", *[c for c in ("preconditioner",) if c in rhs.columns]).distinct(), chunk)
    ready = {n: p.ready(matrices, blocks) for n, p in preconditioners.items()}
    scales = {n: p.scale() for n, p in ready.items()}
    general = {n: p for n, p in ready.items() if scales[n] is None and type(p) is not Identity}
    flexible = [n for n, p in ready.items() if not p.linear]
    start = blocks.chunked(rhs).withColumnRenamed("v", "r")
    held = None
    for name, m in scales.items():
        if m is not None:
            part = m.withColumn("preconditioner", F.lit(name))
            held = part if held is None else held.unionByName(part)
    start = start.join(held, ["matrix_id", "c", "preconditioner"], "left") if held is not None else start.withColumn("m", F.lit(None).cast("array<double>"))
    start = start.selectExpr("*", f"greatest(sqrt({by_system(inner('r', 'r'))}) * {rtol!r}D, {atol!r}D) AS goal", f"{zeros('r')} AS x")
    if x0 is not None:
        given = rhs.select("system_id", "matrix_id", F.col("preconditioner") if "preconditioner" in rhs.columns else F.lit("identity").alias("preconditioner")).distinct()
        guess = materialize(blocks.chunked(x0.select("system_id", "i", "v").join(given, "system_id")))
        image = blocks.product(guess).select(*KEY, "c", F.col("v").alias("ax"))
        start = start.drop("x").join(guess.select(*KEY, "c", F.col("v").alias("x")), [*KEY, "c"], "left").join(image, [*KEY, "c"], "left")
        start = start.selectExpr(*PLACE, "m", "goal", f"coalesce(x, {zeros('r')}) AS x", f"CASE WHEN ax IS NULL THEN r ELSE {plus('r', '-1D', 'ax')} END AS r")
    state = materialize(start.withColumn("rz", F.lit(0.0)))
    out: list[DataFrame] = []
    older: list[DataFrame] = []
    for step in range(max_iters + 1):
        new, used = _next(blocks, state, step, general, flexible, older, m_max, breakdown_tol)
        done = F.col("converged") | F.col("breakdown") | F.lit(step == max_iters) | (F.col("alpha") == 0)
        counts, live = Observation(), {n: F.count(F.when(~done & (F.col("preconditioner") == n), 1)).alias(f"live {n}") for n in general}
        new = materialize(new.observe(counts, F.count(F.when(done, 1)).alias("done"), F.count(F.when(~done, 1)).alias("live"), *live.values()), plain=True)
        seen = counts.get
        general = {n: p for n, p in general.items() if seen[f"live {n}"]}
        discard(*used)
        if trace:
            out.append(new)
        elif seen["done"] or not seen["live"]:
            out.append(new.filter(done) if not seen["live"] else materialize(new.filter(done)))
        older.append(new)
        keep = m_max if flexible else 1
        for t in older[:-keep] if not trace else ():
            discard(t)
        older = older[-keep:]
        if not seen["live"]:
            break
        state = new.filter(~done)
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return blocks, result


def solve_cg(matrices: DataFrame, rhs: DataFrame, rtol: float = RTOL, atol: float = ATOL, max_iters: int = 100, preconditioner: Preconditioner | None = None, trace: bool = False, m_max: int = 20, x0: DataFrame | None = None) -> DataFrame:
    """Conjugate gradients for every system of ``rhs(system_id, matrix_id, i, v)``, as component rows.

    ``(system_id, matrix_id, i, x, r, p, ap, iter, converged)``: the state at the
    end, or with ``trace`` of every step; see ``cg_steps``. ``preconditioner``
    holds for all systems.
    """
    rows = rhs.select("system_id", "matrix_id", "i", "v", F.lit("given").alias("preconditioner"))
    blocks, states = cg_steps(matrices, rows, {"given": preconditioner or Identity()}, rtol, atol, max_iters, m_max, trace=trace, x0=x0)
    flat = blocks.rows(states.select(*KEY, "matrix_id", "c", *_START, "iter", "converged"), *_START)
    return flat.select("system_id", "matrix_id", "i", *_START, "iter", "converged")


def power_extremes(matrices: DataFrame, max_iters: int = 1000, tolerance: float = 1e-6, preconditioner: Preconditioner | None = None) -> DataFrame:
    """``(matrix_id, lambda_max, lambda_min)`` of M⁻¹A by power iteration from ones, the smallest by a shifted operator.

    The operator is applied, never made: a product, then the preconditioner, A
    alone without one. A matrix stops when its estimate changes by less than
    ``tolerance`` of itself.
    """
    matrices = once(matrices)
    meta = sizes(matrices)
    ones = meta.select(F.col("matrix_id").alias("system_id"), "matrix_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).withColumn("v", F.lit(1.0))
    blocks = Blocks(matrices, meta)
    ready = preconditioner.ready(matrices, blocks) if preconditioner else None
    start = materialize(blocks.chunked(ones))
    top = materialize(_power(blocks, start.withColumn("shift", F.lit(0.0)), max_iters, tolerance, ready).withColumnRenamed("value", "lambda_max"))
    shifted = start.join(top.select("matrix_id", (F.col("lambda_max") * 1.01 + 1e-12).alias("shift")), "matrix_id")
    low = _power(blocks, shifted, max_iters, tolerance, ready)
    return top.join(low, "matrix_id").select("matrix_id", "lambda_max", (F.col("lambda_max") * 1.01 + 1e-12 - F.col("value")).alias("lambda_min"))


def _power(blocks: Blocks, start: DataFrame, max_iters: int, tolerance: float, preconditioner: Preconditioner | None = None) -> DataFrame:
    """``(matrix_id, value)``: the largest eigenvalue of M⁻¹A, or of shift − M⁻¹A where the shift is not 0, from chunks ``PLACE, v, shift``."""
    names = [*PLACE, "shift", "value"]
    state = start.selectExpr(*PLACE, "shift", "0D AS value", "v", f"sqrt({by_system(inner('v', 'v'))}) AS norm")
    unit = "transform({0}, a -> CASE WHEN norm > 0 THEN a / norm ELSE 0D END) AS v"
    state, out = materialize(state.selectExpr(*names, unit.format("v"))), []
    for step in range(max_iters):
        image, moved = None, state.select(*names, F.col("v").alias("x"))
        if preconditioner is not None:
            image = materialize(preconditioner.apply(blocks.product(state.select(*PLACE, "v")), step))
            preconditioner.done()
            both = gathered(moved, _no_partials(image), image.select(*KEY, "c", F.col("v").alias("ax")))
        else:
            both = blocks.carried(moved, "x") if blocks.single else gathered(moved, blocks.times(state))
            both = both.selectExpr(*names, "x", f"{summed('ys', 'x')} AS ax")
        both = both.selectExpr(*names, "x", "CASE WHEN shift <> 0 THEN zip_with(x, ax, (u, v) -> shift * u - v) ELSE ax END AS y")
        both = both.selectExpr("*", f"sqrt({by_system(inner('y', 'y'), blocks.single)}) AS norm", f"{by_system(inner('x', 'y'), blocks.single)} AS rayleigh")
        settled = f"abs(rayleigh - value) <= {tolerance!r}D * greatest(abs(rayleigh), 1e-30D) OR {'true' if step == max_iters - 1 else 'false'} OR norm = 0 OR isnan(norm)"
        counts = Observation()
        new = both.selectExpr(*PLACE, "shift", "rayleigh AS value", unit.format("y"), f"{settled} AS settled")
        new = materialize(new.observe(counts, F.count(F.when(F.col("settled"), 1)).alias("done"), F.count(F.when(~F.col("settled"), 1)).alias("live")), plain=True)
        discard(state, image)
        seen = counts.get
        if seen["done"] or not seen["live"]:
            out.append(materialize(new.filter("settled").groupBy("matrix_id").agg(F.max("value").alias("value"))))
        if not seen["live"]:
            discard(new)
            break
        state = new.filter("NOT settled").select(*names, "v")
        state.scratch_path = new.scratch_path
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def _no_partials(like: DataFrame) -> DataFrame:
    return like.filter(F.lit(False)).select(*KEY, "c", F.lit(None).cast("array<double>").alias("y"))


def power_norm(matrices: DataFrame, max_iters: int = 1000, tolerance: float = 1e-8) -> DataFrame:
    """``(matrix_id, norm_spectral)`` of matrices of any size: the root of the largest eigenvalue of AᵀA, by products with A and Aᵀ."""
    right = matrices.select("matrix_id", F.col("i").alias("k"), "j", "v")
    left = matrices.select("matrix_id", F.col("i").alias("k"), F.col("j").alias("i"), F.col("v").alias("w"))
    square = materialize(left.join(right, ["matrix_id", "k"]).groupBy("matrix_id", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v")))
    meta = sizes(square)
    start = meta.select(F.col("matrix_id").alias("system_id"), "matrix_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    blocks = Blocks(square, meta)
    chunks = blocks.chunked(start.withColumn("v", normal(7, F.col("i"))))  # not ones: they can be an eigenvector
    return _power(blocks, chunks.withColumn("shift", F.lit(0.0)), max_iters, tolerance).select("matrix_id", F.sqrt("value").alias("norm_spectral"))


def condition_numbers(matrices: DataFrame, preconditioners=("identity", "jacobi"), max_iters: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """``(matrix_id, preconditioner, condition_number)`` of M⁻¹A; NaN where the smallest eigenvalue is not positive.

    ``preconditioners``: names, or a mapping from names to preconditioners of
    any kind; see ``preconditioners.named``.
    """
    out = None
    for name, preconditioner in named(preconditioners).items():
        ends = power_extremes(matrices, max_iters, tolerance, None if type(preconditioner) is Identity else preconditioner)
        value = F.when(F.col("lambda_min") > 0, F.col("lambda_max") / F.col("lambda_min")).otherwise(F.lit(float("nan")))
        part = ends.select("matrix_id", F.lit(name).alias("preconditioner"), value.alias("condition_number"))
        out = part if out is None else out.unionByName(part)
    return out


def lanczos(matrices: DataFrame, m: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Basis ``(matrix_id, k, i, v)`` and recurrence ``(matrix_id, k, alpha, beta)`` of m steps for every matrix.

    A matrix ends at a beta of 1e-14 or less.
    """
    matrices = once(matrices)
    meta = sizes(matrices)
    start = meta.select(F.col("matrix_id").alias("system_id"), "matrix_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).withColumn("x", normal(seed, F.col("i")))
    norm = start.groupBy("system_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    state = start.join(norm, "system_id").withColumn("x", F.col("x") / F.col("norm")).drop("norm")
    state = materialize(state.withColumn("old", F.lit(0.0)).withColumn("beta", F.lit(0.0)))
    basis, steps = [], []
    for k in range(m):
        basis.append(state.select("matrix_id", F.lit(k).alias("k"), "i", F.col("x").alias("v")))
        y = materialize(_apply(matrices, state, "x", "ax"))
        alpha = y.groupBy("system_id").agg(F.sum(F.col("x") * F.col("ax")).alias("alpha"))
        w = materialize(y.join(alpha, "system_id").withColumn("w", F.col("ax") - F.col("alpha") * F.col("x") - F.col("beta") * F.col("old")).drop("beta"))
        beta = w.groupBy("system_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("beta"))
        w = materialize(w.join(beta, "system_id"))
        steps.append(w.groupBy("matrix_id").agg(F.max("alpha").alias("alpha"), F.max("beta").alias("beta")).withColumn("k", F.lit(k)))
        state = w.filter("beta > 1e-14").select("system_id", "matrix_id", "i", (F.col("w") / F.col("beta")).alias("x"), F.col("x").alias("old"), "beta")
        if state.isEmpty():
            break
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[:-1]).unionByName(parts[-1])
    return union(basis), union(steps).select("matrix_id", "k", "alpha", "beta")


def eigenbasis(matrices: DataFrame, count: int, which: str = "smallest", seed: int = 42, largest: int = 4096) -> DataFrame:
    """``(matrix_id, k, eigenvalue, i, v)``: chosen eigenvectors of symmetric matrices, one decomposition a task.

    ``which``: ``smallest``, ``largest`` or ``random`` (by hash). A matrix that is
    not symmetric within 1e-10, or has fewer than ``count`` vectors, is an error.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        a = dense(part)
        if np.abs(a - a.T).max() > 1e-10 * max(1.0, np.abs(a).max()):
            raise ValueError("a matrix is not symmetric")
        if count > len(a):
            raise ValueError(f"a matrix has only {len(a)} eigenvectors")
        values, vectors = np.linalg.eigh(a)
        n = len(values)
        picked = {"smallest": np.arange(count), "largest": np.arange(n - count, n), "random": np.random.default_rng([seed, n]).permutation(n)[:count]}[which]
        v = vectors[:, picked]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(count)] < 0, -1, 1)
        k, i = np.meshgrid(np.arange(count), np.arange(n), indexing="ij")
        return pd.DataFrame({"matrix_id": part["matrix_id"].iloc[0], "k": k.ravel(), "eigenvalue": values[picked][k.ravel()], "i": i.ravel(), "v": v.T.ravel()})

    return guarded(matrices, largest).groupBy("matrix_id").applyInPandas(run, "matrix_id long, k int, eigenvalue double, i int, v double")


def pcg_compare(matrices: DataFrame, rhs: DataFrame, preconditioners=("identity", "jacobi"), rtol: float = RTOL, atol: float = ATOL, max_iters: int = 100, m_max: int = 20, breakdown_tol: float = 0.0, truth: DataFrame | None = None, x0: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Solves ``(system_id, preconditioner, converged, iterations, residual, relative, rhs_norm, breakdown, error)`` and their history by step.

    Every system is solved under every preconditioner, in one loop: names, or a
    mapping from names to preconditioners (``preconditioners.named``); the
    identity is always among them. A solve without a finite residual counts as
    failed: an infinite residual, no iterations and what went wrong in
    ``error``. With ``truth(system_id, i, v)`` solves have ``exact_error`` too.
    """
    given = named(preconditioners)
    if not any(type(p) is Identity for p in given.values()):
        given["identity"] = Identity()
    grid = rhs.select("system_id", "matrix_id", "i", "v", F.explode(F.array(*map(F.lit, sorted(given)))).alias("preconditioner"))
    blocks, states = cg_steps(matrices, grid, given, rtol, atol, max_iters, m_max, breakdown_tol, trace=True, x0=x0)
    curve = materialize(states.groupBy(*KEY, "iter").agg(F.max("norm").alias("absolute"), F.max("converged").alias("converged"), F.max("breakdown").alias("breakdown")))
    norms = rhs.groupBy("system_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("rhs_norm"))
    curve = curve.join(norms, "system_id").withColumn("relative", F.when(F.col("rhs_norm") > 0, F.col("absolute") / F.col("rhs_norm")).otherwise(F.col("absolute")))
    history = curve.select(*KEY, "iter", "absolute", "relative")
    last = curve.groupBy(*KEY).agg(F.max("iter").alias("iterations"), *(F.max_by(c, "iter").alias(c) for c in ("absolute", "relative", "rhs_norm", "converged", "breakdown")))
    bad = F.isnan("absolute") | (F.abs("absolute") == float("inf"))
    infinite = F.lit(float("inf"))
    solves = last.select(
        *KEY, (F.col("converged") & ~bad).alias("converged"), F.when(bad, 0).otherwise(F.col("iterations")).alias("iterations"), F.when(bad, infinite).otherwise(F.col("absolute")).alias("residual"),
        F.when(bad, infinite).otherwise(F.col("relative")).alias("relative"), "rhs_norm", (F.col("breakdown") & ~bad).alias("breakdown"), F.when(bad, F.lit("the residual is not finite")).alias("error"),
    )
    if truth is not None:
        end = states.join(last.select(*KEY, F.col("iterations").alias("iter")), [*KEY, "iter"])
        x = blocks.rows(end.select(*KEY, "matrix_id", "c", "x"), "x").select(*KEY, "i", F.col("x").alias("v"))
        both = x.join(truth.select("system_id", "i", F.col("v").alias("t")), ["system_id", "i"])
        sums = both.groupBy(*KEY).agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("t"), 2))).alias("e"), F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("n"))
        solves = solves.join(sums.select(*KEY, F.when(F.col("n") > 0, F.col("e") / F.col("n")).otherwise(F.col("e")).alias("exact_error")), [*KEY], "left")
        solves = solves.withColumn("exact_error", F.when(F.col("error").isNull(), F.col("exact_error")))
    return solves, history


def exact_error(x: DataFrame, truth: DataFrame) -> DataFrame:
    """``(system_id, error)``: ‖x − x*‖ over ‖x*‖, absolute where x* is zero."""
    both = x.join(truth.select("system_id", "i", F.col("v").alias("t")), ["system_id", "i"])
    sums = both.groupBy("system_id").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("t"), 2))).alias("e"), F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("n"))
    return sums.select("system_id", F.when(F.col("n") > 0, F.col("e") / F.col("n")).otherwise(F.col("e")).alias("error"))


def two_grid(matrices: DataFrame, residual: DataFrame, basis: DataFrame, steps: int = 2, omega: float = 0.67) -> DataFrame:
    """``(system_id, matrix_id, i, v)``: one V-cycle on A z = r with ``basis(matrix_id, i, mode, v)`` as coarse space; see ``preconditioners.TwoGrid``."""
    return preconditioned(matrices, residual, TwoGrid(basis, steps, omega))


def preconditioned(matrices: DataFrame, residual: DataFrame, preconditioner: Preconditioner, iteration: int = 0) -> DataFrame:
    """z for component rows of residuals, outside a loop."""
    blocks = Blocks(matrices, residual.select("system_id", "matrix_id").distinct())
    z = preconditioner.ready(matrices, blocks).apply(blocks.chunked(residual), iteration)
    return blocks.rows(z.select("system_id", "matrix_id", "c", "v"), "v").select("system_id", "matrix_id", "i", "v")


def scheduled(primary: DataFrame, residual: DataFrame, iteration: int, start_iter: int = 0, limit_iters: int | None = None) -> DataFrame:
    """The preconditioned residual ``primary`` inside the window of iterations, the residual itself outside."""
    inside = iteration >= start_iter and (limit_iters is None or iteration < start_iter + limit_iters)
    return primary if inside else residual
