"""Queries on eigenvectors and singular values, which SQL cannot express, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from krysalis.operators import iterate, strategies
from krysalis.plans.fixtures import archive, budgets, embeddings, flow, gram
from krysalis.plans.queries import QUERIES

COVERED = ("e15_eigenvector_forward", "e16_eigenvector_inverse", "e17_krylov", "f4_f11_singular", "f13_pod_basis", "f14_pod_from_predictions", "h5_eigenbasis", "h9_two_grid", "h9_two_grid_cg")


def dense(df):
    rows = df.toPandas()
    out = {}
    for m, part in rows.groupby("matrix_id"):
        a = np.zeros((part["i"].max() + 1, part["j"].max() + 1))
        a[part["i"], part["j"]] = part["v"]
        out[m] = a
    return out


def vectors(df, *keys, value="v"):
    return {k: part.sort_values("i")[value].to_numpy() for k, part in df.toPandas().groupby(list(keys))}


@pytest.fixture(scope="module")
def flows(spark, sf_dir):
    return dense(flow(spark, sf_dir))


@pytest.mark.parametrize("name, end", [("e15_eigenvector_forward", "largest"), ("e16_eigenvector_inverse", "smallest")])
def test_eigenvector_pairs(spark, sf_dir, flows, name, end):
    """Both sides lie in the space of the chosen eigenvectors and belong together."""
    rows = QUERIES[name](spark, sf_dir)
    x, b = vectors(rows, "matrix_id", "system_id", value="solution"), vectors(rows, "matrix_id", "system_id", value="rhs")
    assert len(x) == 3 * len(flows)
    for (m, s), v in x.items():
        q = np.linalg.eigh(flows[m])[1]
        q = q[:, -4:] if end == "largest" else q[:, :4]
        assert np.abs(v - q @ (q.T @ v)).max() < 1e-4 * max(1, np.abs(v).max()) and np.abs(v).max() > 0
        assert flows[m] @ v == pytest.approx(b[m, s], abs=1e-4 * np.abs(flows[m]).sum(1).max())


def test_krylov_pairs(spark, sf_dir, flows):
    rows = QUERIES["e17_krylov"](spark, sf_dir)
    basis, _ = iterate.lanczos(flow(spark, sf_dir), 4)
    basis = vectors(basis, "matrix_id", "k")
    x, b = vectors(rows, "matrix_id", "system_id", value="solution"), vectors(rows, "matrix_id", "system_id", value="rhs")
    for (m, s), v in x.items():
        q = np.linalg.qr(np.stack([basis[m, k] for k in range(4)], 1))[0]
        assert np.abs(v - q @ (q.T @ v)).max() < 1e-5 and np.abs(v).max() > 0
        assert flows[m] @ v == pytest.approx(b[m, s], abs=1e-5 * np.abs(flows[m]).sum(1).max())
    assert len({tuple(v.round(4)) for v in x.values()}) == len(x)


def test_singular_values(spark, sf_dir):
    a = dense(gram(spark, sf_dir))
    for r in QUERIES["f4_f11_singular"](spark, sf_dir).collect():
        s = np.linalg.svd(a[r["matrix_id"]], compute_uv=False)
        assert r["norm_spectral"] == pytest.approx(s[0]) and r["by_power"] == pytest.approx(s[0], rel=1e-3) and r["condition_number"] == pytest.approx(s[0] / s[-1])


@pytest.mark.parametrize("name, function, modes", [("f13_pod_basis", lambda x: x, 3), ("f14_pod_from_predictions", np.tanh, 2)])
def test_pod(spark, sf_dir, name, function, modes):
    rows = QUERIES[name](spark, sf_dir)
    got, values = vectors(rows, "matrix_id", "mode"), {(r["matrix_id"], r["mode"]): r["eigenvalue"] for r in rows.collect()}
    for m, part in embeddings(spark, sf_dir).select("matrix_id", "x").toPandas().groupby("matrix_id"):
        x = function(np.stack(part["x"]))
        w, q = np.linalg.eigh(x.T @ x)
        for k in range(modes):
            assert values[m, k] == pytest.approx(w[-1 - k], rel=1e-4) and abs(q[:, -1 - k] @ got[m, k]) == pytest.approx(1, abs=1e-4)


def test_eigenbasis(spark, sf_dir, flows):
    for r in QUERIES["h5_eigenbasis"](spark, sf_dir).select("matrix_id", "k", "eigenvalue").distinct().collect():
        assert r["eigenvalue"] == pytest.approx(np.linalg.eigvalsh(flows[r["matrix_id"]])[-3:][r["k"]])


def test_two_grid(spark, sf_dir, flows):
    rows = QUERIES["h9_two_grid"](spark, sf_dir)
    x, z = vectors(rows, "matrix_id", "system_id", value="x"), vectors(rows, "matrix_id", "system_id", value="z")
    for key, v in x.items():
        a = flows[key[0]]
        r, d, phi = a @ v, np.diag(a), np.linalg.eigh(a)[1][:, :3]
        want = np.zeros_like(v)
        for _ in range(2):
            want = want + 0.67 * (r - a @ want) / d
        want = want + phi @ np.linalg.solve(phi.T @ a @ phi, phi.T @ (r - a @ want))
        for _ in range(2):
            want = want + 0.67 * (r - a @ want) / d
        assert z[key] == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_skipped_archive_rows(spark, sf_dir):
    """Bindings with a skip take disjoint slices; traces count their rows from the first system taken."""
    a, held = gram(spark, sf_dir), archive(spark, sf_dir).drop("vec_id")
    place = F.col("system_id") - F.col("matrix_id") * strategies.ROWS
    taken = lambda rows, skip: {tuple(r) for r in strategies.rhs_archive(a, budgets(a, rows).withColumn("skip", F.lit(skip)), archive=held).select("matrix_id", place).distinct().collect()}
    matrices = [r[0] for r in a.select("matrix_id").distinct().collect()]
    assert taken(2, 0) == {(m, k) for m in matrices for k in (0, 1)} and taken(2, 2) == {(m, k) for m in matrices for k in (2, 3)}
    steps = strategies.residuals(a, budgets(a, 3).withColumn("skip", F.lit(1)), archive=held, iterations=1)
    assert {tuple(r) for r in steps.select("matrix_id", place, "iter").distinct().collect()} == {(m, *k) for m in matrices for k in ((1, 0), (1, 1), (2, 0))}
    with pytest.raises(ValueError, match="shorter"):
        strategies.solution_archive(a, budgets(a, -1).withColumn("skip", F.lit(1 << 20)), archive=held)


def test_refusals(spark, sf_dir):
    a = flow(spark, sf_dir)
    with pytest.raises(ValueError):
        iterate.condition_numbers(a, ("identity", "amg"))
    with pytest.raises(ValueError):
        iterate.pcg_compare(a, None, ("amg",))
    for name in ("random", "constant_forward", "gaussian_residuals", "search_directions"):
        with pytest.raises(Exception, match="without an end"):
            strategies.STRATEGIES[name](a, budgets(a, -1)).collect()
    with pytest.raises(Exception, match="rows of a matrix"):
        strategies.grid(a, budgets(a, strategies.ROWS + 1)).limit(1).agg(F.count("*")).collect()
