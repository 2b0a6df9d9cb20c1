"""Preconditioners inside the loops, against numpy and known spectra; products of matrices of several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from krysalis.operators import algebra, binding, blocks, iterate, models, scaling, strategies
from krysalis.operators.preconditioners import Identity, Jacobi, Learned, Preconditioner, Scheduled, TwoGrid
from krysalis.plans.fixtures import flow, flow_vectors
from krysalis.plans.linear import _flow_basis
from krysalis.plans.queries import QUERIES
from krysalis.sources import files
from tests.test_dense import dense, vectors
from tests.test_properties import matrix_rows


def spd(n, seed=0):
    m = np.random.default_rng(seed).standard_normal((n, n))
    return m.T @ m + 2 * np.eye(n)


def rhs_rows(spark, *pairs):
    """Component rows of (system, matrix, vector)."""
    return spark.createDataFrame([(s, m, i, float(v)) for s, m, x in pairs for i, v in enumerate(x)], "system_id long, matrix_id long, i int, v double")


def basis_rows(spark, *bases):
    return spark.createDataFrame([(m, i, k, float(q[i, k])) for m, q in enumerate(bases) for i in range(q.shape[0]) for k in range(q.shape[1])], "matrix_id long, i int, mode int, v double")


TRIDIAGONAL = np.array([[4.0, 1, 0], [1, 4, 1], [0, 1, 4]])
WIDE = np.array([[10.0, 2, 1], [2, 5, 0.5], [1, 0.5, 500]])


def power_steps(m, steps):
    """The condition number after so many steps of both power iterations of an operator, from ones."""

    def run(operator):
        x = np.ones(len(m)) / np.sqrt(len(m))
        for _ in range(steps):
            y = operator @ x
            value, x = x @ y, y / np.linalg.norm(y)
        return value

    top = run(m)
    shift = top * 1.01 + 1e-12
    low = shift - run(shift * np.eye(len(m)) - m)
    return top / low if low > 0 else np.nan


def test_condition_numbers_of_any_operator(spark):
    """The operators are never made: three steps of a cycle and of a model are those of their dense forms."""
    arrays = np.diag([1.0, 10, 100]), TRIDIAGONAL, WIDE
    a = matrix_rows(spark, *arrays)
    coarse = [np.linalg.eigh(x)[1][:, :1] for x in arrays]
    names = {"learned": Learned(lambda: lambda r: r / 3), "two_grid": TwoGrid(basis_rows(spark, *coarse))}
    got = {(r["preconditioner"], r["matrix_id"]): r["condition_number"] for r in iterate.condition_numbers(a, names, max_iters=3, tolerance=0.0).collect()}
    for m, x in enumerate(arrays):
        d = np.diag(1 / np.diag(x))
        assert got["learned", m] == pytest.approx(power_steps(x / 3, 3), nan_ok=True)
        s, phi = np.eye(3) - 0.67 * d @ x, coarse[m]
        c = np.eye(3) - phi @ np.linalg.solve(phi.T @ x @ phi, phi.T @ x)
        assert got["two_grid", m] == pytest.approx(power_steps(np.eye(3) - s @ s @ c @ s @ s, 3), rel=1e-6, nan_ok=True)


def test_condition_numbers_at_the_end(spark):
    """diag(1, 10, 100) has 100, and 1 with its diagonal; the tridiagonal matrix agrees with its eigenvalues."""
    a = matrix_rows(spark, np.diag([1.0, 10, 100]), TRIDIAGONAL)
    got = {(r["preconditioner"], r["matrix_id"]): r["condition_number"] for r in iterate.condition_numbers(a, max_iters=16).collect()}
    assert got["identity", 0] == pytest.approx(100, rel=1e-2) and got["jacobi", 0] == pytest.approx(1, rel=1e-2)
    w = np.linalg.eigvalsh(TRIDIAGONAL)
    assert got["identity", 1] == pytest.approx(w[-1] / w[0], rel=1e-2) and got["jacobi", 1] == pytest.approx(w[-1] / w[0], rel=1e-2)


def two_grid_steps(a, b, phi, steps):
    """Norms of the residuals of conjugate gradients under the V-cycle."""
    d = np.diag(a)

    def cycle(r):
        z = np.zeros_like(r)
        for k in range(4):
            if k == 2:
                z = z + phi @ np.linalg.solve(phi.T @ a @ phi, phi.T @ (r - a @ z))
            z = z + 0.67 * (r - a @ z) / d
        return z

    x, r = np.zeros_like(b), b.copy()
    z = cycle(r)
    p, rz, out = z, r @ z, [np.linalg.norm(r)]
    for _ in range(steps):
        alpha = rz / (p @ a @ p)
        x, r = x + alpha * p, r - alpha * (a @ p)
        z = cycle(r)
        p, rz = z + (r @ z) / rz * p, r @ z
        out.append(np.linalg.norm(r))
    return out


def test_two_grid_in_the_loop(spark, sf_dir):
    """Two steps are numpy's, and every system needs fewer steps than without."""
    rows = QUERIES["h9_two_grid_cg"](spark, sf_dir).toPandas()
    a, b = flow(spark, sf_dir), flow_vectors(flow(spark, sf_dir), 2)
    arrays, rhs, basis = dense(a), vectors(b, "matrix_id", "system_id"), vectors(_flow_basis(a), "matrix_id", "mode")
    ends = rows.groupby(["system_id", "preconditioner"])["iter"].max()
    for (m, s), v in rhs.items():
        phi = np.stack([basis[m, k] for k in range(3)], 1)
        got = rows[(rows.system_id == s) & (rows.preconditioner == "two_grid")].sort_values("iter")["absolute"].to_numpy()
        assert got[:3] == pytest.approx(two_grid_steps(arrays[m], v, phi, 2), rel=1e-6)
        assert ends[s, "two_grid"] < ends[s, "identity"]


@pytest.mark.parametrize("chunk", [4, 1024])
def test_flexible_equals_plain_for_a_fixed_preconditioner(spark, chunk):
    """One loop over both, over matrices of one and of several blocks."""

    class Nonlinear(Jacobi):
        linear = False

        def scale(self):
            return None

    arrays = [spd(6), spd(10, 1)]
    a = matrix_rows(spark, *arrays)
    rng = np.random.default_rng(4)
    pairs = [(10 * m + k, m, rng.standard_normal(len(x))) for m, x in enumerate(arrays) for k in range(2)]
    names = {"plain": Jacobi(), "flexible": Nonlinear(), "late": Scheduled(Jacobi(), start_iter=2)}
    grid = rhs_rows(spark, *pairs).withColumn("preconditioner", F.explode(F.array(*map(F.lit, names))))
    loop, states = iterate.cg_steps(a, grid, names, 1e-10, 0.0, 30, chunk=chunk)
    got = vectors(loop.rows(states.select("system_id", "preconditioner", "matrix_id", "c", "x"), "x"), "system_id", "preconditioner", value="x")
    assert len(got) == 3 * len(pairs)
    for s, m, b in pairs:
        truth = np.linalg.solve(arrays[m], b)
        for name in names:
            assert got[s, name] == pytest.approx(truth, abs=1e-7 * np.abs(truth).max())
    steps = {(r["system_id"], r["preconditioner"]): r["iter"] for r in states.select("system_id", "preconditioner", "iter").distinct().collect()}
    assert all(abs(steps[s, "plain"] - steps[s, "flexible"]) <= 1 for s, _, _ in pairs)


def test_nonlinear_preconditioner_needs_flexible_steps(spark):
    """A model that changes sign pattern by size still converges."""
    a = spd(8, 3)
    d = np.diag(a)

    def load():
        return lambda r: r / d * (1 + 0.5 * np.tanh(np.abs(r)))

    solves, history = iterate.pcg_compare(matrix_rows(spark, a), rhs_rows(spark, (1, 0, np.arange(1.0, 9))), {"nonlinear": Learned(load)}, rtol=1e-8, truth=rhs_rows(spark, (1, 0, np.linalg.solve(a, np.arange(1.0, 9)))))
    found = {r["preconditioner"]: r for r in solves.collect()}
    assert found["nonlinear"]["converged"] and found["identity"]["converged"]
    assert all(r["exact_error"] < 1e-6 and r["error"] is None and not r["breakdown"] for r in found.values())
    first = {r["preconditioner"]: r["relative"] for r in history.filter("iter = 0").collect()}
    assert first == {"nonlinear": 1.0, "identity": 1.0}


def test_failures_are_rows(spark):
    def load():
        def model(r):
            raise ValueError("no model")

        return model

    zero = np.zeros(3)
    solves, _ = iterate.pcg_compare(matrix_rows(spark, TRIDIAGONAL), rhs_rows(spark, (1, 0, np.ones(3)), (2, 0, zero)), {"broken": Learned(load)})
    found = {(r["system_id"], r["preconditioner"]): r for r in solves.collect()}
    assert found[1, "identity"]["converged"] and found[2, "identity"]["converged"] and found[2, "identity"]["iterations"] == 0
    assert not found[1, "broken"]["converged"] and found[1, "broken"]["iterations"] == 0
    indefinite = matrix_rows(spark, np.array([[0.0, 1], [1, 0]]))
    broken = iterate.pcg_compare(indefinite, rhs_rows(spark, (1, 0, [1.0, 0.0])))[0].filter("preconditioner = 'identity'").first()
    assert broken["breakdown"] and not broken["converged"]


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            import os

            f.write(f"{os.getpid()}\n")
        return lambda r: r / 4

    grid = rhs_rows(spark, (1, 0, np.ones(3))).withColumn("preconditioner", F.lit("m"))
    iterate.cg_steps(matrix_rows(spark, WIDE), grid, {"m": Learned(load)}, 0.0, 0.0, 3)
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))


@pytest.mark.parametrize("chunk", [1, 3, 7, 1024])
def test_products_of_blocks(spark, chunk, monkeypatch):
    monkeypatch.setattr(blocks, "TOGETHER", 2)
    monkeypatch.setattr(blocks, "STRIPE", 2)
    rng = np.random.default_rng(chunk)
    arrays = [rng.standard_normal((7, 7)), np.where(rng.random((9, 9)) < 0.2, rng.standard_normal((9, 9)), 0), np.diag([1.0, 0, 3, 0])]
    arrays[2][3, 0] = 5
    a = matrix_rows(spark, *arrays)
    pairs = [(10 * m + k, m, rng.standard_normal(len(x))) for m, x in enumerate(arrays) for k in range(5)]
    made = blocks.Blocks(a, spark.createDataFrame([(s, m) for s, m, _ in pairs], "system_id long, matrix_id long"), chunk)
    got = vectors(made.rows(made.product(made.chunked(rhs_rows(spark, *pairs))).select("system_id", "matrix_id", "c", "v"), "v"), "system_id")
    for s, m, x in pairs:
        n = int(max(np.nonzero(arrays[m])[0].max(), np.nonzero(arrays[m])[1].max())) + 1
        assert got[(s,)][:n] == pytest.approx((arrays[m] @ x)[:n])


def test_absent_components_are_zero(spark):
    a = matrix_rows(spark, TRIDIAGONAL)
    x = spark.createDataFrame([(5, 0, 1, 2.0), (6, 9, 0, 1.0)], "system_id long, matrix_id long, i int, v double")
    got = {(r["system_id"], r["i"]): r["v"] for r in algebra.spmv(a, x).collect()}
    assert got == {(5, 0): 2.0, (5, 1): 8.0, (5, 2): 2.0, (6, 0): 0.0}


def test_starts_of_their_own(spark):
    """Traces of one right-hand side from given starts are numpy's; without starts they are equal, and the solution is shared."""
    a = spd(5, 7)
    b, x0 = np.arange(1.0, 6), np.random.default_rng(1).standard_normal((2, 5))
    single = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(b)], "matrix_id long, i int, v double")
    starts = spark.createDataFrame([(0, k, i, float(v)) for k, x in enumerate(x0) for i, v in enumerate(x)], "matrix_id long, row long, i int, v double")
    budget = spark.createDataFrame([(0, 4)], "matrix_id long, rows long")
    matrices = matrix_rows(spark, a)
    got = vectors(strategies.residuals(matrices, budget, iterations=1, single_rhs=single, starts=starts), "system_id", "iter", value="solution")
    truth = np.linalg.solve(a, b)
    for k in range(2):
        r = b - a @ x0[k]
        assert got[k, 0] == pytest.approx(truth - x0[k])
        assert got[k, 1] == pytest.approx(truth - x0[k] - (r @ r) / (r @ a @ r) * r)
    same = vectors(strategies.residuals(matrices, budget, iterations=1, single_rhs=single), "system_id", "iter", value="rhs")
    assert same[0, 0] == pytest.approx(b) and same[1, 0] == pytest.approx(b) and same[0, 1] == pytest.approx(same[1, 1])
    with pytest.raises(Exception, match="without an end"):
        strategies.residuals(matrices, budget.withColumn("rows", F.lit(-1).cast("long")), iterations=1, single_rhs=single).collect()


def test_dispatch_refuses_unknown_names(spark):
    with pytest.raises(ValueError, match="no such right-hand side"):
        binding.resolve_rhs("nothing", {})
    with pytest.raises(ValueError, match="needs meta"):
        binding.resolve_rhs("gaussian", {})
    t = spark.createDataFrame([("odd", "gaussian", False, 2.0, 1.0)], "mode string, rhs_kind string, normalized boolean, scale double, rhs_norm double")
    with pytest.raises(Exception, match="no such normalisation"):
        scaling.system_scales(t).collect()
    assert "doubled" in models.NORMALIZATIONS and "alternating" in models.RHS_SOURCES


def test_unknown_ids_and_short_archives_are_errors(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(ValueError, match="unknown ids"):
        files.filter_ids(ids, include=[1, 7])
    with pytest.raises(ValueError, match="unknown ids"):
        files.filter_ids(ids, exclude=[7])
    assert files.filter_ids(ids, include=[2]).count() == 1
    listing = spark.createDataFrame([("a_1.txt",), ("a_2.txt",)], "path string")
    with pytest.raises(ValueError, match="are needed"):
        files.select_archive(listing, 2, skip=1)
    assert files.select_archive(listing, 2).count() == 2


def test_closest_match_of_skewed_values(spark, monkeypatch):
    """Nearly all values in a sliver of their range: ranges follow the rows."""
    monkeypatch.setattr(binding, "RANGE_ROWS", 20)
    rng = np.random.default_rng(0)
    b = [(k, float(v)) for k, v in enumerate(np.concatenate([rng.random(150) * 1e-6, [1e9, -1e9, 5.0, 5.0]]))]
    a = [(k, float(v)) for k, v in enumerate(np.concatenate([rng.random(60) * 1e-6, [2e9, 0.5, 5.0, -3.0]]))]
    got = {r["id"]: (r["b_id"], r["distance"]) for r in binding.closest_match(spark.createDataFrame(a, "id long, d double"), spark.createDataFrame(b, "id long, d double")).collect()}
    for i, v in a:
        want = min(b, key=lambda p: (abs(p[1] - v), p[1], p[0]))  # noqa: B023
        assert got[i] == (want[0], pytest.approx(abs(want[1] - v)))


def test_closest_match_goes_through_a_range_once(spark, monkeypatch):
    """No frame is taken anew for every row, nulls are near nothing, and a value that many rows share is matched in each."""
    monkeypatch.setattr(binding, "RANGE_ROWS", 4)
    b = spark.createDataFrame([(1, None), (9, 3.0), (4, 3.0), (2, 8.0)], "id long, d double")
    a = spark.createDataFrame([(k, 7.0) for k in range(30)] + [(30, -5.0), (31, None), (32, 5.5), (33, 9.0)], "id long, d double")
    matched = binding.closest_match(a, b)
    plan = matched._jdf.queryExecution().analyzed().toString()
    assert "unboundedfollowing" not in plan.lower()
    got = sorted((r["id"], r["b_id"], r["distance"]) for r in matched.collect())
    assert got == [(k, 2, 1.0) for k in range(30)] + [(30, 4, 8.0), (32, 4, 2.5), (33, 2, 1.0)]


class _Named(Preconditioner):
    pass


def test_names_with_quotes(spark):
    grid = rhs_rows(spark, (1, 0, np.ones(3))).withColumn("preconditioner", F.lit("o'clock"))
    _, states = iterate.cg_steps(matrix_rows(spark, TRIDIAGONAL), grid, {"o'clock": _Named()}, 1e-8)
    assert states.first()["converged"]
