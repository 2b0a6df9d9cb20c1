"""Properties of solvers and generators on small systems."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from krysalis.operators import algebra, budgets, checks, compare, iterate, models, strategies
from krysalis.sources import files, sinks


def matrix_rows(spark, *arrays):
    rows = [(m, int(i), int(j), float(a[i, j])) for m, a in enumerate(arrays) for i, j in zip(*np.nonzero(a), strict=True)]
    return spark.createDataFrame(rows, "matrix_id long, i int, j int, v double")


def test_diagonal_condition(spark):
    """κ of diag(1, 50, 100) is 100; with its diagonal as preconditioner 1."""
    a = matrix_rows(spark, np.diag([1.0, 50.0, 100.0]))
    assert algebra.condition_number_exact(a).first()["condition_number"] == pytest.approx(100)
    found = {r["preconditioner"]: r["condition_number"] for r in iterate.condition_numbers(a, max_iters=10).collect()}
    assert found["identity"] == pytest.approx(100, rel=0.05)
    assert found["jacobi"] == pytest.approx(1)


def test_cg_solves_all_systems(spark):
    rng = np.random.default_rng(0)
    arrays = [(lambda m: m.T @ m + np.eye(6))(rng.standard_normal((6, 6))) for _ in range(3)]
    a = matrix_rows(spark, *arrays)
    truth = rng.standard_normal((3, 6))
    b = [(m, m, i, float(v)) for m in range(3) for i, v in enumerate(arrays[m] @ truth[m])]
    out = iterate.solve_cg(a, spark.createDataFrame(b, "system_id long, matrix_id long, i int, v double"), rtol=1e-12, max_iters=20)
    for r in out.collect():
        assert r["x"] == pytest.approx(truth[r["matrix_id"], r["i"]], abs=1e-8)
        assert r["converged"]


@pytest.mark.parametrize("partitions", [1, 8])
def test_partitions_do_not_matter(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        a = matrix_rows(spark, np.array([[4.0, 1], [1, 3]]), np.eye(2))
        counts = a.select("matrix_id").distinct().withColumn("rows", F.lit(2).cast("long"))
        rows = {(r["system_id"], r["i"]): round(r["rhs"], 9) for r in strategies.gaussian_forward(a, counts).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(rows) == 8
    # equal budgets see equal vectors whatever the matrix
    assert rows[(1 << 24, 0)] == pytest.approx(next(r["solution"] for r in strategies.gaussian_forward(a, counts).collect() if r["system_id"] == 0 and r["i"] == 0))


def test_budgets(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "strategy string, weight double")
    assert {r["strategy"]: r["samples"] for r in budgets.mix_counts(w, 10).collect()} == {"a": 4, "b": 3, "c": 3}
    mixed = spark.createDataFrame([("krylov", 2), ("random", 3)], "strategy string, samples int")
    assert budgets.check_mixable(mixed, 2).filter("problem is not null").count() == 2
    assert budgets.check_mixable(mixed, 1).filter("problem is not null").count() == 0


def test_archive_budgets(spark):
    a = matrix_rows(spark, np.array([[4.0, 1], [1, 3]]), np.eye(2))
    held = spark.createDataFrame([(m, r, [1.0 + r, 2.0]) for m in range(2) for r in range(3)], "matrix_id long, row long, x array<double>")
    budget = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "matrix_id long, rows long")
    systems = lambda out: sorted({(r["matrix_id"], r["system_id"] % strategies.ROWS) for r in out.collect()})
    whole = [(m, r) for m in range(2) for r in range(3)]
    assert systems(strategies.solution_archive(a, budget(-1, -1), archive=held)) == whole
    assert systems(strategies.scaled_solutions(a, budget(-1, 2), archive=held)) == whole[:5]
    assert systems(strategies.rhs_archive(a, budget(-1, 0), archive=held)) == whole[:3]
    rhs = strategies.solution_archive(a, budget(-1, -1), archive=held).groupBy("matrix_id", (F.col("system_id") % strategies.ROWS).alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "rhs"))), lambda p: p["rhs"]).alias("x"))
    assert systems(strategies.validated_archive(a, budget(-1, -1), solutions=held, rhs=rhs)) == whole
    traces = strategies.residuals(a, budget(-1, -1), archive=held, iterations=1)
    assert systems(traces) == whole
    assert traces.count() == 2 * 3 * 2 * 2
    with pytest.raises(ValueError, match="shorter than its budget"):
        strategies.solution_archive(a, budget(4, 1), archive=held).collect()
    with pytest.raises(ValueError, match="shorter than its budget"):
        strategies.rhs_archive(a, budget(1, 1), archive=held.filter("matrix_id = 0")).collect()


def test_direct_solve_of_a_singular_matrix_is_null(spark):
    a = matrix_rows(spark, np.array([[1.0, 1], [1, 1]]))
    b = spark.createDataFrame([(5, 0, [1.0, 2.0])], "system_id long, matrix_id long, x array<double>")
    assert iterate.solve_direct(a, b).first()["solution"] is None


def test_checks(spark):
    a = matrix_rows(spark, np.array([[4.0, 1], [1, 3]]))
    assert checks.check_symmetric(a).first()["is_symmetric"]
    bad = spark.createDataFrame([(1, [float("nan"), 1.0])], "system_id long, x array<double>")
    assert checks.breakdown_reasons(bad).first()["reason"] == "nan"
    with pytest.raises(Exception, match="no standard"):
        checks.require_non_residual(spark.createDataFrame([(1, 1)], "sample_id int, row_kind tinyint")).collect()


def test_npy_round_trip(spark, tmp_path):
    stack = np.arange(18, dtype=np.float64).reshape(2, 3, 3)
    np.save(tmp_path / "m_7.npy", stack)
    rows = files.read_matrix_npy(spark, str(tmp_path / "*.npy")).collect()
    back = np.zeros_like(stack)
    for r in rows:
        back[r["sample"], r["i"], r["j"]] = r["v"]
    assert (back == stack).all()
    np.save(tmp_path / "v.npy", np.ones((1, 4)))
    assert files.read_vectors(spark, str(tmp_path / "v.npy")).first()["x"] == [1.0] * 4


def test_overwriting_another_form_is_refused(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/samples")
    sinks.guard_overwrite(spark, str(tmp_path), ["id"])
    with pytest.raises(ValueError, match="another form"):
        sinks.guard_overwrite(spark, str(tmp_path), ["other"])


def test_registries():
    with pytest.raises(ValueError, match="registered already"):
        strategies.register("random")(lambda *a: None)
    models.register_source("mine")(lambda df: df)
    with pytest.raises(ValueError, match="registered already"):
        models.register_source("mine")(lambda df: df)
    assert len(strategies.STRATEGIES) == 20


def test_empty_tables(spark):
    a = spark.createDataFrame([], "matrix_id long, i int, j int, v double")
    assert algebra.norm_one(a).count() == 0
    assert algebra.condition_number_exact(a).count() == 0
    x = spark.createDataFrame([], "system_id long, matrix_id long, i int, v double")
    assert algebra.spmv(a, x).count() == 0
    assert iterate.solve_cg(a, x, max_iters=2).count() == 0


def test_condition_boxes_gather_no_label(spark):
    """Exact quartiles, by label, of repeated, absent and missing values, without a map of a label's values in one task."""
    rng = np.random.default_rng(5)
    values = {"a": np.round(rng.random(1001) * 50), "b": rng.standard_normal(7), "c": np.array([2.0]), None: rng.random(40)}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("d", None)]
    out = compare.condition_boxes(spark.createDataFrame(rows, "label string, condition_number double").repartition(5))
    assert "percentile" not in out._jdf.queryExecution().analyzed().toString().lower()
    got = {r["label"]: tuple(r)[1:] for r in out.collect()}
    for k, v in values.items():
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0, 0.25, 0.5, 0.75, 1])))
    assert got["d"] == (None,) * 5 and len(got) == 5
