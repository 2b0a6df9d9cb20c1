"""Queries on the algebra, scaling, generation, iteration and verification of systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from krysalis.operators import algebra, checks, iterate, scaling, strategies
from krysalis.operators.preconditioners import Identity, Jacobi, Learned, Preconditioner, Scheduled, TwoGrid
from krysalis.plans.fixtures import ARCHIVE, E, FLOW, GRAM, ORACLES, archive, archive_rows, budgets, embeddings, flow, flow_vectors, flow_vectors_sql, gram, normal_sql, query, r6, rounded, uniform_sql

SPMV = "ax AS (SELECT x.system_id, x.matrix_id, a.i, sum(a.v * x.v) AS v FROM x JOIN flow a ON a.matrix_id = x.matrix_id AND a.j = x.i GROUP BY 1, 2, 3)"
GRAM_SIZE = "size AS (SELECT matrix_id, greatest(max(i), max(j)) + 1 AS n FROM gram GROUP BY 1)"


@query("f1_spmv", f"WITH {GRAM}, {ARCHIVE} SELECT x.system_id, x.matrix_id, a.i, {r6('sum(a.v * x.v)')} AS v FROM av x JOIN gram a ON a.matrix_id = x.matrix_id AND a.j = x.i GROUP BY 1, 2, 3")
def f1_spmv(spark, d):
    return rounded(algebra.spmv(gram(spark, d), archive_rows(spark, d)), "v")


@query("f2_norms", f"WITH {GRAM}, c AS (SELECT matrix_id, j, sum(abs(v)) s FROM gram GROUP BY 1, 2), r AS (SELECT matrix_id, i, sum(abs(v)) s FROM gram GROUP BY 1, 2) SELECT matrix_id, {r6('a')} AS norm_one, {r6('b')} AS norm_inf FROM (SELECT matrix_id, max(s) a FROM c GROUP BY 1) JOIN (SELECT matrix_id, max(s) b FROM r GROUP BY 1) USING (matrix_id)")
def f2_norms(spark, d):
    a = gram(spark, d)
    return rounded(algebra.norm_one(a).join(algebra.norm_inf(a), "matrix_id"), "norm_one", "norm_inf")


@query("f3_norm_frobenius", f"WITH {GRAM} SELECT matrix_id, {r6('sqrt(sum(v * v))')} AS norm_frobenius FROM gram GROUP BY 1")
def f3(spark, d):
    return rounded(algebra.norm_frobenius(gram(spark, d)), "norm_frobenius")


BOUND = "bound AS (SELECT matrix_id, greatest(max(s1), max(s2)) AS bound FROM (SELECT matrix_id, i AS k, sum(abs(v)) AS s1, 0.0 AS s2 FROM {m} GROUP BY 1, 2 UNION ALL SELECT matrix_id, j, 0.0, sum(abs(v)) FROM {m} GROUP BY 1, 2) GROUP BY 1)"


@query("f6_gershgorin_bound", f"WITH {FLOW}, {BOUND.format(m='flow')} SELECT matrix_id, {r6('bound')} AS bound FROM bound")
def f6(spark, d):
    return rounded(algebra.gershgorin_bound(flow(spark, d)), "bound")


@query("f7_one_norm_scale", f"WITH {GRAM}, {GRAM_SIZE}, c AS (SELECT matrix_id, j, sum(abs(v)) s FROM gram GROUP BY 1, 2) SELECT matrix_id, {r6('max(s) / max(n)')} AS scale FROM c JOIN size USING (matrix_id) GROUP BY 1")
def f7(spark, d):
    return rounded(algebra.one_norm_scale(gram(spark, d)), "scale")


@query("f8_diagonal", f"WITH {FLOW} SELECT matrix_id, i, {r6('v')} AS v, abs(v) < 2.0 AS small FROM flow WHERE i = j")
def f8(spark, d):
    a = flow(spark, d)
    low = algebra.check_diagonal(a, 2.0).select("matrix_id", "i", F.lit(True).alias("s"))
    return rounded(algebra.diagonal(a).join(low, ["matrix_id", "i"], "left").select("matrix_id", "i", "v", F.coalesce("s", F.lit(False)).alias("small")), "v")


@query("f9_vector_norms", f"WITH {E} SELECT vec_id, {r6('sqrt(sum(v * v))')} AS norm FROM e GROUP BY 1")
def f9(spark, d):
    return rounded(algebra.vector_norms(embeddings(spark, d)).select("vec_id", "norm"), "norm")


@query("f10_vector_stats", f"WITH {ARCHIVE} SELECT system_id, {r6('sqrt(sum(v * v))')} AS norm, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std, {r6('min(v)')} AS least, {r6('max(v)')} AS greatest FROM av GROUP BY 1")
def f10(spark, d):
    return rounded(algebra.vector_stats(archive_rows(spark, d)), "norm", "mean", "std", "least", "greatest")


@query("f12_gram", f"WITH {E} SELECT x.matrix_id, x.i, y.i AS j, {r6('sum(x.v * y.v)')} AS v FROM e x JOIN e y ON x.vec_id = y.vec_id GROUP BY 1, 2, 3")
def f12(spark, d):
    return rounded(algebra.gram(embeddings(spark, d), "matrix_id"), "v")


def _basis(spark, d):
    """The first two archived vectors of each label as a basis."""
    return archive(spark, d).filter("row < 2").select("matrix_id", F.col("row").cast("int").alias("mode"), F.posexplode("x").alias("i", "v"))


@query("f15_galerkin", f"WITH {GRAM}, {ARCHIVE}, phi AS (SELECT matrix_id, row::INT AS mode, i, v FROM av WHERE row < 2), h AS (SELECT g.matrix_id, g.i, b.mode AS b, sum(g.v * b.v) AS v FROM gram g JOIN phi b ON b.matrix_id = g.matrix_id AND b.i = g.j GROUP BY 1, 2, 3) SELECT h.matrix_id, a.mode AS a, h.b, {r6('sum(h.v * a.v)')} AS v FROM h JOIN phi a ON a.matrix_id = h.matrix_id AND a.i = h.i GROUP BY 1, 2, 3")
def f15(spark, d):
    return rounded(algebra.galerkin(gram(spark, d), _basis(spark, d)), "v")


@query("f5_norm_nuclear", f"WITH {GRAM} SELECT matrix_id, {r6('sum(v)')} AS norm_nuclear FROM gram WHERE i = j GROUP BY 1")
def f5(spark, d):
    """The nuclear norm of a positive definite matrix is its trace."""
    return rounded(algebra.norm_nuclear(gram(spark, d)), "norm_nuclear")


@query("f4_f11_singular")
def f4_f11(spark, d):
    """Spectral norms, in a task and by power iteration, and condition numbers: no SQL, see tests/test_dense.py."""
    a = gram(spark, d)
    return algebra.norm_spectral(a).join(iterate.power_norm(a, 200, 1e-12).withColumnRenamed("norm_spectral", "by_power"), "matrix_id").join(algebra.condition_number_exact(a), "matrix_id")


@query("f13_pod_basis")
def f13(spark, d):
    """Three modes a label: no SQL, see tests/test_dense.py."""
    return algebra.pod_basis(embeddings(spark, d).select("matrix_id", "x"), 3)


META = GRAM + ", " + GRAM_SIZE + ", " + BOUND.format(m="gram") + ", meta AS (SELECT matrix_id, n, bound, sqrt(n) AS dimension_scale, bound * sqrt(n) AS scale FROM bound JOIN size USING (matrix_id))"


@query("g1_matrix_scale", f"WITH {META} SELECT matrix_id, n::INT AS n, {r6('bound')} AS bound, {r6('dimension_scale')} AS dimension_scale, {r6('scale')} AS scale FROM meta")
def g1(spark, d):
    return rounded(scaling.matrix_scale(gram(spark, d)), "bound", "dimension_scale", "scale")


@query("g2_normalize_matrices", f"WITH {META} SELECT matrix_id, i, j, {r6('v / scale')} AS v FROM gram JOIN meta USING (matrix_id)")
def g2(spark, d):
    a = gram(spark, d)
    return rounded(scaling.normalize_matrices(a, scaling.matrix_scale(a)), "v")


@query("g2_scale_rhs", f"WITH {META}, {ARCHIVE} SELECT system_id, matrix_id, i, {r6('v / scale')} AS v FROM av JOIN meta USING (matrix_id)")
def g2b(spark, d):
    return rounded(scaling.scale_rhs(archive_rows(spark, d), scaling.matrix_scale(gram(spark, d))), "v")


@query("g3_normalize_by_matrix", "SELECT o_orderkey, round(o_totalprice / (2.5 * sqrt(16.0)), 6) + 0.0 AS a, round(o_orderkey / (2.5 * sqrt(16.0)), 6) + 0.0 AS b FROM orders")
def g3(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("a"), F.col("o_orderkey").cast("double").alias("b"), F.lit(2.5).alias("scale"), F.lit(16).alias("n"))
    return rounded(scaling.normalize_by_matrix(t).drop("scale", "n"), "a", "b")


FIRST = "b AS (SELECT matrix_id, i, v FROM av WHERE row = 0), nb AS (SELECT matrix_id, sqrt(sum(v * v)) AS norm, sqrt(count(*)) AS root FROM b GROUP BY 1)"


@query("g4_normalize_by_rhs", f"WITH {GRAM}, {ARCHIVE}, {FIRST} SELECT matrix_id, i, j, {r6('v / (norm * root)')} AS v FROM gram JOIN nb USING (matrix_id)")
def g4(spark, d):
    first = archive(spark, d).filter("row = 0").select("matrix_id", F.col("x").alias("b"))
    return rounded(scaling.normalize_by_rhs(gram(spark, d), first)[0], "v")


@query("g5_normalize_by_spectral", f"WITH {META}, {ARCHIVE}, {FIRST}, x AS (SELECT matrix_id, i, v AS xv FROM av WHERE row = 1) SELECT matrix_id, i, {r6('v / (norm * dimension_scale)')} AS b, {r6('xv * bound / norm')} AS x FROM b JOIN x USING (matrix_id, i) JOIN nb USING (matrix_id) JOIN meta USING (matrix_id)")
def g5(spark, d):
    a, arc = gram(spark, d), archive(spark, d)
    systems = arc.filter("row = 0").select("matrix_id", F.col("x").alias("b")).join(arc.filter("row = 1").select("matrix_id", "x"), "matrix_id")
    sigma = algebra.gershgorin_bound(a).withColumnRenamed("bound", "sigma")
    out = scaling.normalize_by_spectral(a, systems, sigma)[1]
    rows = out.select("matrix_id", F.posexplode(F.arrays_zip("b", "x")).alias("i", "p")).select("matrix_id", "i", "p.b", "p.x")
    return rounded(rows, "b", "x")


@query("g6_restore", f"WITH {FLOW} SELECT matrix_id, i, j, {r6('v')} AS v FROM flow")
def g6(spark, d):
    a = flow(spark, d)
    meta = scaling.matrix_scale(a)
    return rounded(scaling.restore(scaling.normalize_matrices(a, meta), meta), "v")


_MODES = "(VALUES ('none'), ('matrix'), ('rhs'), ('both')) m(mode), (VALUES ('gaussian'), ('sparse'), ('raw_lhs'), ('raw_rhs'), ('dataset')) k(rhs_kind), (VALUES (true), (false)) z(normalized)"


@query("g7_normalize_system", f"""WITH s AS (SELECT o_orderkey, o_totalprice AS rhs_norm, 4.0::DOUBLE AS scale, mode, rhs_kind, normalized FROM orders, {_MODES}),
t AS (SELECT *, CASE WHEN mode IN ('matrix', 'both') AND NOT normalized THEN scale ELSE 1.0::DOUBLE END AS a_by, CASE WHEN mode NOT IN ('matrix', 'both') THEN 1.0 WHEN normalized THEN CASE WHEN rhs_kind = 'raw_rhs' THEN scale ELSE 1.0 END ELSE CASE WHEN rhs_kind IN ('gaussian', 'sparse') THEN 1.0 ELSE scale END END AS bs FROM s)
SELECT o_orderkey, mode, rhs_kind, normalized, {r6('a_by')} AS a_by, {r6("CASE WHEN mode IN ('rhs', 'both') AND rhs_norm > 0 THEN rhs_norm ELSE bs END")} AS b_by FROM t""")
def g7(spark, d):
    arr = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("rhs_norm"), F.lit(4.0).alias("scale"))
    t = t.withColumn("mode", arr(["none", "matrix", "rhs", "both"])).withColumn("rhs_kind", arr(["gaussian", "sparse", "raw_lhs", "raw_rhs", "dataset"])).withColumn("normalized", arr([True, False]))
    return rounded(scaling.system_scales(t).select("o_orderkey", "mode", "rhs_kind", "normalized", "a_by", "b_by"), "a_by", "b_by")


@query("g8_rhs_target_scale", f"WITH {E} SELECT vec_id, {r6('sqrt(sum(v * v)) / sqrt(count(*))')} AS scale FROM e GROUP BY 1")
def g8(spark, d):
    return rounded(scaling.rhs_target_scale(embeddings(spark, d).select("vec_id", F.col("x").alias("b")), "rhs").select("vec_id", "scale"), "scale")


@query("e0_random_vectors", f"WITH {flow_vectors_sql(4)} SELECT system_id, matrix_id, i, {r6('v')} AS v FROM x")
def e0(spark, d):
    return rounded(flow_vectors(flow(spark, d), 4), "v")


def _pairs_sql(value: str, rows: int = 3) -> str:
    base = flow_vectors_sql(rows).replace(normal_sql("42", "row", "i"), value)
    return f"WITH {base}, {SPMV} SELECT x.system_id, x.matrix_id, x.i, {r6('ax.v')} AS rhs, {r6('x.v')} AS solution FROM x JOIN ax USING (system_id, i)"


def _forward(name: str, expected: str, **options) -> None:
    @query(name, _pairs_sql(expected))
    def run(spark, d):
        a = flow(spark, d)
        out = strategies.STRATEGIES[name.split("_", 1)[1]](a, budgets(a, 3), **options)
        return rounded(out, "rhs", "solution")


_N = normal_sql("42", "row", "i")
_forward("e1_random", f"{_N} * 2.0", target_rhs_scale=2.0)
_forward("e2_normal", _N)
_forward("e3_gaussian_forward", f"{_N} * 0.5 + 1.0", mu=1.0, sigma=0.5)
_forward("e5_uniform_forward", f"{uniform_sql('42', 'row', 'i')} * 3.0 + (-1.0)", a=-1.0, b=2.0)
_forward("e7_constant_forward", "2.5::DOUBLE", value=2.5)
_forward("e9_neutral_ones", "1.0::DOUBLE")


def _archive_pairs(scale: float, which: str = "row < 5") -> str:
    return f"WITH {GRAM}, {ARCHIVE}, x AS (SELECT system_id, matrix_id, i, v * {scale} AS v FROM av WHERE {which}), ax AS (SELECT x.system_id, a.i, sum(a.v * x.v) AS v FROM x JOIN gram a ON a.matrix_id = x.matrix_id AND a.j = x.i GROUP BY 1, 2) SELECT x.system_id, x.matrix_id, x.i, {r6('ax.v')} AS rhs, {r6('x.v')} AS solution FROM x JOIN ax USING (system_id, i)"


@query("e11_solution_archive", _archive_pairs(1.0))
def e11(spark, d):
    a = gram(spark, d)
    return rounded(strategies.solution_archive(a, budgets(a, 5), archive=archive(spark, d).drop("vec_id")), "rhs", "solution")


@query("e13_scaled_solutions", _archive_pairs(5.0))
def e13(spark, d):
    a = gram(spark, d)
    return rounded(strategies.scaled_solutions(a, budgets(a, 5), archive=archive(spark, d).drop("vec_id")), "rhs", "solution")


@query("e11_solution_archive_whole", _archive_pairs(1.0, "true"))
def e11_whole(spark, d):
    a = gram(spark, d)
    return rounded(strategies.solution_archive(a, budgets(a, -1), archive=archive(spark, d).drop("vec_id")), "rhs", "solution")


@query("e11_solution_archive_rest", _archive_pairs(1.0, "row >= 2"))
def e11_rest(spark, d):
    """What two rows a matrix, taken by an earlier binding, leave of the archive."""
    a = gram(spark, d)
    return rounded(strategies.solution_archive(a, budgets(a, -1).withColumn("skip", F.lit(2)), archive=archive(spark, d).drop("vec_id")), "rhs", "solution")


@query("e13_scaled_solutions_whole", _archive_pairs(5.0, "true"))
def e13_whole(spark, d):
    a = gram(spark, d)
    return rounded(strategies.scaled_solutions(a, budgets(a, -1), archive=archive(spark, d).drop("vec_id")), "rhs", "solution")


@query("e14_validated_archive", f"WITH {flow_vectors_sql(4)}, {SPMV} SELECT x.system_id, x.matrix_id, x.i, {r6('ax.v')} AS rhs, {r6('x.v')} AS solution FROM x JOIN ax USING (system_id, i) WHERE x.row % 2 = 0")
def e14(spark, d, rows=4):
    """Every second archived pair is spoilt and left out."""
    a = flow(spark, d)
    x = flow_vectors(a, 4)
    named = lambda v: algebra.packed(v, "system_id", "matrix_id").select("matrix_id", (F.col("system_id") - F.col("matrix_id") * (1 << 24)).alias("row"), "x")
    b = named(algebra.spmv(a, x)).withColumn("x", F.when(F.col("row") % 2 == 1, F.transform("x", lambda v: v + 1.0)).otherwise(F.col("x")))
    return rounded(strategies.validated_archive(a, budgets(a, rows), solutions=named(x), rhs=b, fail=False), "rhs", "solution")


query("e14_validated_archive_whole", ORACLES["e14_validated_archive"])(lambda spark, d: e14(spark, d, -1))


def _image(a, pairs):
    """The right-hand side of each pair and what the matrix makes of its solution."""
    x = pairs.select("system_id", "matrix_id", "i", F.col("solution").alias("v"))
    both = pairs.join(algebra.spmv(a, x).select("system_id", "i", F.col("v").alias("image")), ["system_id", "i"])
    return rounded(both.select("system_id", "matrix_id", "i", "rhs", "image"), "rhs", "image")


def _inverse(name: str, expected: str, **options) -> None:
    """A x = b for the right-hand sides ``expected``: both sides are compared component by component."""
    base = flow_vectors_sql(3).replace(normal_sql("42", "row", "i"), expected)

    @query(name, f"WITH {base} SELECT system_id, matrix_id, i, {r6('v')} AS rhs, {r6('v')} AS image FROM x")
    def run(spark, d):
        a = flow(spark, d)
        return _image(a, strategies.STRATEGIES[name.split("_", 1)[1]](a, budgets(a, 3), **options))


_inverse("e4_gaussian_inverse", f"{_N} * 0.5 + 1.0", mu=1.0, sigma=0.5)
_inverse("e6_uniform_inverse", f"{uniform_sql('42', 'row', 'i')} * 2.0 + (-1.0)", a=-1.0, b=1.0)
_inverse("e8_constant_inverse", "2.0::DOUBLE", value=2.0)
_inverse("e10_sparse_rhs", "CASE i WHEN 0 THEN 1.0 WHEN 24 THEN 2.0 WHEN 5 THEN -3.0 ELSE 0.0 END::DOUBLE", indices=(0, -1, 5), values=(1.0, 2.0, -3.0))


def _spanned(name: str, **options) -> None:
    """Pairs from a basis of eigenvectors or of a Krylov space: no SQL, see tests/test_dense.py."""

    @query(name)
    def run(spark, d):
        a = flow(spark, d)
        return rounded(strategies.STRATEGIES[name.split("_", 1)[1]](a, budgets(a, 3), **options), "rhs", "solution")


_spanned("e15_eigenvector_forward", count=4, which="largest")
_spanned("e16_eigenvector_inverse", count=4, which="smallest")
_spanned("e17_krylov", krylov_iters=4)


@query("e12_rhs_archive", f"WITH {ARCHIVE} SELECT system_id, matrix_id, i, {r6('v')} AS rhs, {r6('v')} AS image FROM av WHERE row < 3")
def e12(spark, d):
    a = gram(spark, d)
    return _image(a, strategies.rhs_archive(a, budgets(a, 3), archive=archive(spark, d).drop("vec_id")))


@query("e12_rhs_archive_whole", f"WITH {ARCHIVE} SELECT system_id, matrix_id, i, {r6('v')} AS rhs, {r6('v')} AS image FROM av")
def e12_whole(spark, d):
    a = gram(spark, d)
    return _image(a, strategies.rhs_archive(a, budgets(a, -1), archive=archive(spark, d).drop("vec_id")))


def cg_sql(steps: int, m: str = "1.0", matrices: str = "flow") -> str:
    """Unrolled conjugate gradients on ``b(system_id, matrix_id, i, v)``: tables ``s0`` to ``s<steps>`` with x, r, p, ap."""
    d = "" if m == "1.0" else f" JOIN {matrices} dg ON dg.matrix_id = b.matrix_id AND dg.i = b.i AND dg.j = b.i"
    out = [f"t0 AS MATERIALIZED (SELECT b.system_id, b.matrix_id, b.i, 0.0 AS x, b.v AS r, b.v * ({m}) AS p, {m} AS m FROM b{d})"]
    for k in range(steps + 1):
        out.append(f"s{k} AS MATERIALIZED (SELECT t.*, coalesce(q.ap, 0.0) AS ap, sum(t.r * t.r * t.m) OVER (PARTITION BY t.system_id) AS rz, sum(t.p * coalesce(q.ap, 0.0)) OVER (PARTITION BY t.system_id) AS pap FROM t{k} t LEFT JOIN (SELECT p.system_id, a.i, sum(a.v * p.p) AS ap FROM t{k} p JOIN {matrices} a ON a.matrix_id = p.matrix_id AND a.j = p.i GROUP BY 1, 2) q USING (system_id, i))")
        if k < steps:
            out.append(f"u{k} AS MATERIALIZED (SELECT system_id, matrix_id, i, x + rz / pap * p AS x, r - rz / pap * ap AS r, p, m, rz FROM s{k})")
            out.append(f"t{k + 1} AS MATERIALIZED (SELECT system_id, matrix_id, i, x, r, r * m + sum(r * r * m) OVER (PARTITION BY system_id) / rz * p AS p, m FROM u{k})")
    return ", ".join(out)


_B = flow_vectors_sql(2) + ", b AS (SELECT system_id, matrix_id, i, v FROM x)"


@query("h2_solve_cg", f"WITH {_B}, {cg_sql(3)} " + " UNION ALL ".join(f"SELECT system_id, matrix_id, i, {k}::INT AS iter, {r6('x')} AS x, {r6('r')} AS r FROM s{k}" for k in range(4)))
def h2(spark, d):
    """The trace of three steps."""
    a = flow(spark, d)
    out = iterate.solve_cg(a, flow_vectors(a, 2), 0.0, 0.0, 3, trace=True)
    return rounded(out.select("system_id", "matrix_id", "i", "iter", "x", "r"), "x", "r")


def _trace_rows(rhs: str, solution: str) -> str:
    cte = f"WITH {flow_vectors_sql(1)}, {SPMV}, b AS (SELECT system_id, matrix_id, i, v FROM ax), {cg_sql(3)} "
    return cte + " UNION ALL ".join(f"SELECT s.system_id, s.matrix_id, {k}::INT AS iter, s.i, {r6(rhs)} AS rhs, {r6(solution)} AS solution FROM s{k} s JOIN x USING (system_id, i)" for k in range(3))


@query("e19_gaussian_residuals", _trace_rows("s.r", "x.v - s.x"))
def e19(spark, d):
    a = flow(spark, d)
    return rounded(strategies.gaussian_residuals(a, budgets(a, 3), iterations=3), "rhs", "solution").select("system_id", "matrix_id", "iter", "i", "rhs", "solution")


def _second_rows(rhs: str, solution: str) -> str:
    cte = f"WITH {flow_vectors_sql(2)}, {SPMV}, b AS (SELECT system_id, matrix_id, i, v FROM ax), {cg_sql(3)} "
    return cte + " UNION ALL ".join(f"SELECT s.system_id, s.matrix_id, {k}::INT AS iter, s.i, {r6(rhs)} AS rhs, {r6(solution)} AS solution FROM s{k} s JOIN x USING (system_id, i) WHERE x.row <= {most}" for k, most in ((0, 1), (2, 0)))


@query("e19_gaussian_residuals_every_second", _second_rows("s.r", "x.v - s.x"))
def e19_second(spark, d):
    """Three rows a matrix of steps 0 and 2: both of the first system and one of the second."""
    a = flow(spark, d)
    return rounded(strategies.gaussian_residuals(a, budgets(a, 3), iterations=3, every_n=2), "rhs", "solution").select("system_id", "matrix_id", "iter", "i", "rhs", "solution")


@query("e20_search_directions_every_second", _second_rows("s.ap", "s.p"))
def e20_second(spark, d):
    a = flow(spark, d)
    return rounded(strategies.search_directions(a, budgets(a, 3), iterations=3, every_n=2), "rhs", "solution").select("system_id", "matrix_id", "iter", "i", "rhs", "solution")


@query("e20_search_directions", _trace_rows("s.ap", "s.p"))
def e20(spark, d):
    a = flow(spark, d)
    return rounded(strategies.search_directions(a, budgets(a, 3), iterations=3), "rhs", "solution").select("system_id", "matrix_id", "iter", "i", "rhs", "solution")


@query("e18_residuals", f"WITH {GRAM}, {ARCHIVE}, x AS (SELECT * FROM av WHERE row = 0), b AS MATERIALIZED (SELECT x.system_id, x.matrix_id, a.i, sum(a.v * x.v) AS v FROM x JOIN gram a ON a.matrix_id = x.matrix_id AND a.j = x.i GROUP BY 1, 2, 3), {cg_sql(2, matrices='gram')} " + " UNION ALL ".join(f"SELECT s.system_id, s.matrix_id, {k}::INT AS iter, s.i, {r6('s.r')} AS rhs, {r6('x.v - s.x')} AS solution FROM s{k} s JOIN x USING (system_id, i)" for k in range(2)))
def e18(spark, d):
    a = gram(spark, d)
    out = strategies.residuals(a, budgets(a, 2), archive=archive(spark, d).drop("vec_id"), iterations=2)
    return rounded(out, "rhs", "solution").select("system_id", "matrix_id", "iter", "i", "rhs", "solution")


@query("e18_residuals_whole", f"WITH {GRAM}, {ARCHIVE}, x AS (SELECT * FROM av ), b AS MATERIALIZED (SELECT x.system_id, x.matrix_id, a.i, sum(a.v * x.v) AS v FROM x JOIN gram a ON a.matrix_id = x.matrix_id AND a.j = x.i GROUP BY 1, 2, 3), {cg_sql(2, matrices='gram')} " + " UNION ALL ".join(f"SELECT s.system_id, s.matrix_id, {k}::INT AS iter, s.i, {r6('s.r')} AS rhs, {r6('x.v - s.x')} AS solution FROM s{k} s JOIN x USING (system_id, i)" for k in range(3)))
def e18_whole(spark, d):
    """Two steps, with their start, of every archived vector."""
    a = gram(spark, d)
    out = strategies.residuals(a, budgets(a, -1), archive=archive(spark, d).drop("vec_id"), iterations=2)
    return rounded(out, "rhs", "solution").select("system_id", "matrix_id", "iter", "i", "rhs", "solution")


@query("h1_solve_direct", f"WITH {flow_vectors_sql(3)} SELECT system_id, matrix_id, i, {r6('v')} AS rhs, {r6('v')} AS image FROM x")
def h1(spark, d):
    """The matrix times each solution is the right-hand side."""
    a = flow(spark, d)
    return _image(a, strategies.inverse(a, flow_vectors(a, 3)))


def power_sql(matrices: str, steps: int) -> str:
    """Unrolled power iteration from ones: ``v<steps>(matrix_id, top)`` and ``w<steps>(matrix_id, low)``."""
    out = [f"n AS (SELECT matrix_id, (greatest(max(i), max(j)) + 1)::BIGINT AS n FROM {matrices} GROUP BY 1)", "ones AS MATERIALIZED (SELECT matrix_id, unnest(range(n))::INT AS i, 1 / sqrt(n) AS x FROM n)"]
    for tag, start, expr in (("v", "ones", "ax"), ("w", "ones", "(top * 1.01 + 1e-12) * x - ax")):
        prev = start
        for k in range(steps):
            shift = "" if tag == "v" else " JOIN top USING (matrix_id)"
            out.append(f"{tag}{k} AS MATERIALIZED (SELECT s.matrix_id, s.i, x, {expr} AS y FROM {prev} s JOIN (SELECT a.matrix_id, a.i, sum(a.v * x) AS ax FROM {matrices} a JOIN {prev} p ON p.matrix_id = a.matrix_id AND p.i = a.j GROUP BY 1, 2) q USING (matrix_id, i){shift})")
            out.append(f"{tag}{k}n AS MATERIALIZED (SELECT matrix_id, i, y / sqrt(sum(y * y) OVER (PARTITION BY matrix_id)) AS x FROM {tag}{k})")
            prev = f"{tag}{k}n"
        name = "top" if tag == "v" else "low"
        out.append(f"{name} AS MATERIALIZED (SELECT matrix_id, sum(x * y) AS {name} FROM {tag}{steps - 1} GROUP BY 1)")
    return ", ".join(out)


@query("h3_power_extremes", f"WITH {GRAM}, {power_sql('gram', 3)} SELECT matrix_id, {r6('top')} AS lambda_max, {r6('top * 1.01 + 1e-12 - low')} AS lambda_min FROM top JOIN low USING (matrix_id)")
def h3(spark, d):
    return rounded(iterate.power_extremes(gram(spark, d), 3, 0.0), "lambda_max", "lambda_min")


def lanczos_sql(matrices: str, steps: int) -> str:
    """Unrolled Lanczos steps: ``w<k>(matrix_id, i, x, alpha, w)`` and ``l<k>(matrix_id, i, x, old, beta)``."""
    norm = "sqrt(sum({0} * {0}) OVER (PARTITION BY matrix_id))"
    out = [f"l0 AS MATERIALIZED (SELECT matrix_id, i, v / {norm.format('v')} AS x, 0.0::DOUBLE AS old, 0.0::DOUBLE AS beta FROM (SELECT matrix_id, i, {normal_sql('42', 'i')} AS v FROM (SELECT DISTINCT matrix_id, i FROM {matrices})))"]
    for k in range(steps):
        image = f"SELECT a.matrix_id, a.i, sum(a.v * p.x) AS ax FROM {matrices} a JOIN l{k} p ON p.matrix_id = a.matrix_id AND p.i = a.j GROUP BY 1, 2"
        out.append(f"a{k} AS MATERIALIZED (SELECT l.*, ax, sum(x * ax) OVER (PARTITION BY matrix_id) AS alpha FROM l{k} l JOIN ({image}) q USING (matrix_id, i))")
        out.append(f"w{k} AS MATERIALIZED (SELECT matrix_id, i, x, alpha, ax - alpha * x - beta * old AS w FROM a{k})")
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT matrix_id, i, w / {norm.format('w')} AS x, x AS old, {norm.format('w')} AS beta FROM w{k})")
    return ", ".join(out)


@query("h4_lanczos", f"WITH {FLOW}, {lanczos_sql('flow', 4)} " + " UNION ALL ".join(f"SELECT w.matrix_id, {k}::INT AS k, w.i, {r6('w.x')} AS v, {r6('w.alpha')} AS alpha, {r6('l.beta')} AS beta FROM w{k} w JOIN l{k + 1} l USING (matrix_id, i)" for k in range(4)))
def h4(spark, d):
    """Four basis vectors and the recurrence of each matrix."""
    basis, steps = iterate.lanczos(flow(spark, d), 4)
    return rounded(basis.join(steps, ["matrix_id", "k"]).select("matrix_id", "k", "i", "v", "alpha", "beta"), "v", "alpha", "beta")


@query("h5_eigenbasis")
def h5(spark, d):
    """Three eigenvectors of each matrix: no SQL, see tests/test_dense.py."""
    return iterate.eigenbasis(flow(spark, d), 3, "largest")


_JAC = "jac AS (SELECT g.matrix_id, g.i, g.j, g.v / dg.v AS v FROM gram g JOIN gram dg ON dg.matrix_id = g.matrix_id AND dg.i = g.i AND dg.j = g.i)"


def _condition_sql(name: str, matrices: str) -> str:
    low = "(top * 1.01 + 1e-12 - low)"
    value = f"CASE WHEN {low} > 0 THEN top / {low} ELSE 'NaN'::DOUBLE END"
    return f"SELECT * FROM (WITH {GRAM}, {_JAC}, {power_sql(matrices, 4)} SELECT matrix_id, '{name}' AS preconditioner, {r6(value)} AS condition_number FROM top JOIN low USING (matrix_id))"


@query("h6_condition_numbers", _condition_sql("identity", "gram") + " UNION ALL " + _condition_sql("jacobi", "jac"))
def h6(spark, d):
    """Four steps of the power iterations of A and of D⁻¹A."""
    return rounded(iterate.condition_numbers(gram(spark, d), max_iters=4, tolerance=0.0), "condition_number")


def _compare_sql(steps: int) -> str:
    one = f"WITH {_B}, {cg_sql(steps)} "
    two = f"WITH {_B}, {cg_sql(steps, '(1 / dg.v)')} "
    rows = lambda name: " UNION ALL ".join(f"SELECT system_id, '{name}' AS preconditioner, {k}::INT AS iter, {r6('sqrt(sum(r * r))')} AS absolute FROM s{k} GROUP BY 1" for k in range(steps + 1))
    return f"SELECT * FROM ({one}{rows('identity')}) UNION ALL SELECT * FROM ({two}{rows('jacobi')})"


@query("h7_h8_pcg_compare", _compare_sql(3))
def h7(spark, d):
    """Three steps of every system without and with its diagonal as preconditioner."""
    a = flow(spark, d)
    _, history = iterate.pcg_compare(a, flow_vectors(a, 2), rtol=0.0, atol=0.0, max_iters=3)
    return rounded(history.select("system_id", "preconditioner", "iter", "absolute"), "absolute")


class _AsNonlinear(Preconditioner):
    """The diagonal, told to the loop as a preconditioner that is not linear."""

    linear = False

    def ready(self, matrices, blocks):
        self.primary = Jacobi().ready(matrices, blocks)
        return self

    def apply(self, residual, iteration):
        return self.primary.apply(residual, iteration)


def fcg_sql(steps: int, z: list[str], matrices: str = "flow", back: int = 20) -> str:
    """Unrolled flexible conjugate gradients on ``b``: ``z[k]`` is the preconditioned ``r`` of step k, ``dg`` the diagonal's row."""
    out = ["f0 AS MATERIALIZED (SELECT system_id, matrix_id, i, 0.0::DOUBLE AS x, v AS r FROM b)"]
    for k in range(steps + 1):
        last = range(k - max(1, k % (back + 1)), k) if k else ()
        joins = "".join(f" JOIN g{j} USING (system_id, i)" for j in last)
        out.append(f"z{k} AS MATERIALIZED (SELECT f.system_id, f.matrix_id, f.i, f.x, f.r, {z[k]} AS z FROM f{k} f JOIN {matrices} dg ON dg.matrix_id = f.matrix_id AND dg.i = f.i AND dg.j = f.i)")
        less = "".join(f" - sum(z * g{j}.ap) OVER (PARTITION BY system_id) / g{j}.pap * g{j}.p" for j in last)
        out.append(f"p{k} AS MATERIALIZED (SELECT system_id, z{k}.matrix_id, i, z{k}.x, z{k}.r, z{less} AS p FROM z{k}{joins})")
        out.append(f"g{k} AS MATERIALIZED (SELECT t.*, q.ap, sum(t.p * q.ap) OVER (PARTITION BY t.system_id) AS pap, sum(t.p * t.r) OVER (PARTITION BY t.system_id) AS pr FROM p{k} t JOIN (SELECT p.system_id, a.i, sum(a.v * p.p) AS ap FROM p{k} p JOIN {matrices} a ON a.matrix_id = p.matrix_id AND a.j = p.i GROUP BY 1, 2) q USING (system_id, i))")
        if k < steps:
            out.append(f"f{k + 1} AS MATERIALIZED (SELECT system_id, matrix_id, i, x + pr / pap * p AS x, r - pr / pap * ap AS r FROM g{k})")
    return ", ".join(out)


def _trace_sql(prefix: str, steps: int, tag: str) -> str:
    return " UNION ALL ".join(f"SELECT system_id, '{tag}' AS preconditioner, i, {k}::INT AS iter, {r6('x')} AS x, {r6('r')} AS r FROM {prefix}{k}" for k in range(steps + 1))


def _flexible_sql(tag: str, z: list[str], back: int = 20) -> str:
    return f"SELECT * FROM (WITH {_B}, {fcg_sql(len(z) - 1, z, back=back)} {_trace_sql('g', len(z) - 1, tag)})"


_INSIDE, _OUTSIDE = "f.r / dg.v", "f.r"


@query("h7_flexible_cg", _flexible_sql("flexible", [_INSIDE] * 4) + " UNION ALL " + _flexible_sql("scheduled", [_OUTSIDE, _INSIDE, _INSIDE, _OUTSIDE]))
def h7_flexible(spark, d):
    """Three flexible steps in one loop: the diagonal as a nonlinear preconditioner, and the diagonal in iterations 1 and 2 only."""
    a = flow(spark, d)
    names = {"flexible": _AsNonlinear(), "scheduled": Scheduled(Jacobi(), 1, 2)}
    grid = flow_vectors(a, 2).withColumn("preconditioner", F.explode(F.array(*map(F.lit, names))))
    blocks, states = iterate.cg_steps(a, grid, names, 0.0, 0.0, 3, trace=True)
    rows = blocks.rows(states.select("system_id", "preconditioner", "matrix_id", "c", "iter", "x", "r"), "x", "r")
    return rounded(rows.select("system_id", "preconditioner", "i", "iter", "x", "r"), "x", "r")


@query("h7_flexible_restart", _flexible_sql("scheduled", [_OUTSIDE, _INSIDE, _INSIDE, _OUTSIDE, _INSIDE], 2))
def h7_restart(spark, d):
    """Four flexible steps that look back two directions at most and begin anew after as many."""
    a = flow(spark, d)
    grid = flow_vectors(a, 2).withColumn("preconditioner", F.lit("scheduled"))

    class Odd(Scheduled):  # outside in iterations 0 and 3
        def apply(self, residual, iteration):
            return residual if iteration in (0, 3) else self.primary.apply(residual, iteration)

    blocks, states = iterate.cg_steps(a, grid, {"scheduled": Odd(Jacobi(), 1)}, 0.0, 0.0, 4, m_max=2, trace=True)
    rows = blocks.rows(states.select("system_id", "preconditioner", "matrix_id", "c", "iter", "x", "r"), "x", "r")
    return rounded(rows.select("system_id", "preconditioner", "i", "iter", "x", "r"), "x", "r")


def _flow_basis(a):
    """Three eigenvectors of least eigenvalue of each matrix as a coarse space."""
    return iterate.eigenbasis(a, 3, "smallest").select("matrix_id", "i", F.col("k").alias("mode"), "v")


_SOLVED = flow_vectors_sql(2)


@query("h7_solutions", f"WITH {_SOLVED} SELECT system_id, p.name AS preconditioner, i, {r6('v')} AS x, true AS converged FROM x, (VALUES ('identity'), ('jacobi'), ('two_grid'), ('scheduled'), ('learned')) p(name)")
def h7_solutions(spark, d):
    """Every system solved to the end under five preconditioners, in one loop: the vectors that the right-hand sides were made from."""
    a = flow(spark, d)
    x = flow_vectors(a, 2)
    names = {"identity": Identity(), "jacobi": Jacobi(), "two_grid": TwoGrid(_flow_basis(a)), "scheduled": Scheduled(Jacobi(), 0, 5), "learned": Learned(lambda: lambda r: r / 4)}
    grid = algebra.spmv(a, x).withColumn("preconditioner", F.explode(F.array(*map(F.lit, names))))
    blocks, states = iterate.cg_steps(a, grid, names, 1e-13, 0.0, 100)
    rows = blocks.rows(states.select("system_id", "preconditioner", "matrix_id", "c", "converged", "x"), "x")
    return rounded(rows.select("system_id", "preconditioner", "i", "x", "converged"), "x")


_FLAT = "wide AS (SELECT matrix_id, max(s) AS s FROM (SELECT matrix_id, i, sum(abs(v)) AS s FROM flow GROUP BY 1, 2) GROUP BY 1), flat AS MATERIALIZED (SELECT matrix_id, i, j, CASE WHEN i = j THEN 4.0 ELSE 4.0 * v / s END AS v FROM flow JOIN wide USING (matrix_id))"


def _flat(a):
    """The flows with 4 on the diagonal, the rest scaled to stay positive definite."""
    return a.join(algebra.norm_inf(a), "matrix_id").select("matrix_id", "i", "j", F.when(F.col("i") == F.col("j"), 4.0).otherwise(4.0 * F.col("v") / F.col("norm_inf")).alias("v"))


@query("m3_learned_in_cg", f"SELECT * FROM (WITH {_B}, {_FLAT}, {cg_sql(3, '(1 / dg.v)', 'flat')} {_trace_sql('s', 3, 'learned')})")
def m3_in_loop(spark, d):
    """A model that divides residuals by 4, called in every step, on matrices whose diagonal is 4: the steps of their diagonal."""
    flows = flow(spark, d)
    a = _flat(flows)
    grid = flow_vectors(flows, 2).withColumn("preconditioner", F.lit("learned"))
    blocks, states = iterate.cg_steps(a, grid, {"learned": Learned(lambda: lambda r: r / 4)}, 0.0, 0.0, 3, trace=True)
    rows = blocks.rows(states.select("system_id", "preconditioner", "matrix_id", "c", "iter", "x", "r"), "x", "r")
    return rounded(rows.select("system_id", "preconditioner", "i", "iter", "x", "r"), "x", "r")


@query("h6_condition_learned", f"SELECT * FROM (WITH {GRAM}, quarter AS MATERIALIZED (SELECT matrix_id, i, j, v / 4 AS v FROM gram), {power_sql('quarter', 4)} SELECT matrix_id, 'learned' AS preconditioner, {r6('CASE WHEN (top * 1.01 + 1e-12 - low) > 0 THEN top / (top * 1.01 + 1e-12 - low) END')} AS condition_number FROM top JOIN low USING (matrix_id))")
def h6_learned(spark, d):
    """Four steps of the power iterations of a model times A, neither of which is made."""
    return rounded(iterate.condition_numbers(gram(spark, d), {"learned": Learned(lambda: lambda r: r / 4)}, 4, 0.0), "condition_number")


@query("h9_two_grid_cg")
def h9_in_loop(spark, d):
    """Norms of residuals of every step with and without the two-grid cycle: no SQL, see tests/test_preconditioners.py."""
    a = flow(spark, d)
    _, history = iterate.pcg_compare(a, flow_vectors(a, 2), {"two_grid": TwoGrid(_flow_basis(a))}, rtol=1e-8)
    return history


_SINGLE = f"{flow_vectors_sql(2)}, one AS MATERIALIZED (SELECT matrix_id AS system_id, matrix_id, i, v FROM x WHERE row = 0), b AS MATERIALIZED (SELECT p.system_id, p.matrix_id, a.i, sum(a.v * p.v) AS v FROM one p JOIN flow a ON a.matrix_id = p.matrix_id AND a.j = p.i GROUP BY 1, 2, 3), {cg_sql(3)}"


def _single_rows(rhs: str, solution: str) -> str:
    return f"WITH {_SINGLE} " + " UNION ALL ".join(f"SELECT s.matrix_id * 16777216 + n.row AS system_id, s.matrix_id, {k}::INT AS iter, s.i, {r6(rhs)} AS rhs, {r6(solution)} AS solution FROM s{k} s JOIN one USING (system_id, i), (SELECT unnest(range(2)) AS row) n WHERE n.row * 4 + {k} < 6" for k in range(4))


def _single_rhs(a):
    """One right-hand side a matrix, made from its first vector."""
    x = flow_vectors(a, 2).filter(F.col("system_id") == F.col("matrix_id") * (1 << 24))
    return algebra.spmv(a, x).select("matrix_id", "i", "v")


@query("e18_residuals_single", _single_rows("s.r", "one.v - s.x"))
def e18_single(spark, d):
    """Six rows a matrix of traces of one right-hand side: the solution is found by one exact solve a matrix."""
    a = flow(spark, d)
    out = strategies.residuals(a, budgets(a, 6), iterations=3, single_rhs=_single_rhs(a))
    return rounded(out, "rhs", "solution").select("system_id", "matrix_id", "iter", "i", "rhs", "solution")


@query("e20_search_directions_single", _single_rows("s.ap", "s.p"))
def e20_single(spark, d):
    a = flow(spark, d)
    out = strategies.search_directions(a, budgets(a, 6), iterations=3, single_rhs=_single_rhs(a))
    return rounded(out, "rhs", "solution").select("system_id", "matrix_id", "iter", "i", "rhs", "solution")


@query("e20_search_directions_archive", f"WITH {GRAM}, {ARCHIVE}, x AS (SELECT * FROM av), b AS MATERIALIZED (SELECT x.system_id, x.matrix_id, a.i, sum(a.v * x.v) AS v FROM x JOIN gram a ON a.matrix_id = x.matrix_id AND a.j = x.i GROUP BY 1, 2, 3), {cg_sql(1, matrices='gram')} " + " UNION ALL ".join(f"SELECT system_id, matrix_id, {k}::INT AS iter, i, {r6('ap')} AS rhs, {r6('p')} AS solution FROM s{k}" for k in range(2)))
def e20_archive(spark, d):
    """All rows of all archived systems."""
    a = gram(spark, d)
    out = strategies.search_directions(a, budgets(a, -1), archive=archive(spark, d).drop("vec_id"), iterations=1)
    return rounded(out, "rhs", "solution").select("system_id", "matrix_id", "iter", "i", "rhs", "solution")


@query("h9_two_grid")
def h9(spark, d):
    """One cycle on residuals of known errors: no SQL, see tests/test_dense.py."""
    a = flow(spark, d)
    basis = iterate.eigenbasis(a, 3, "smallest").select("matrix_id", "i", F.col("k").alias("mode"), "v")
    x = flow_vectors(a, 3)
    z = iterate.two_grid(a, algebra.spmv(a, x), basis)
    return x.join(z.select("system_id", "i", F.col("v").alias("z")), ["system_id", "i"]).select("system_id", "matrix_id", "i", F.col("v").alias("x"), "z")


@query("h10_scheduled", f"WITH {flow_vectors_sql(2)}, k AS (SELECT unnest(range(4)) AS iter) SELECT x.system_id, x.matrix_id, x.i, k.iter::INT AS iter, {r6('CASE WHEN k.iter BETWEEN 1 AND 2 THEN x.v / a.v ELSE x.v END')} AS v FROM x JOIN flow a ON a.matrix_id = x.matrix_id AND a.i = x.i AND a.j = x.i, k")
def h10(spark, d):
    """The diagonal in iterations 1 and 2 of 4, the identity outside."""
    a = flow(spark, d)
    r = flow_vectors(a, 2)
    dg = algebra.diagonal(a).withColumnRenamed("v", "d")
    z = r.join(dg, ["matrix_id", "i"]).select("system_id", "matrix_id", "i", (F.col("v") / F.col("d")).alias("v"))
    out = None
    for k in range(4):
        part = iterate.scheduled(z, r, k, 1, 2).withColumn("iter", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "v")


@query("h11_exact_error", f"WITH {ARCHIVE}, t AS (SELECT matrix_id, i, v AS t FROM av WHERE row = 0) SELECT system_id, {r6('sqrt(sum((v - t) * (v - t))) / sqrt(sum(t * t))')} AS error FROM av JOIN t USING (matrix_id, i) GROUP BY 1")
def h11(spark, d):
    x = archive_rows(spark, d)
    first = x.filter(F.col("system_id") == F.col("matrix_id") * (1 << 24)).select("matrix_id", "i", "v")
    truth = x.select("system_id", "matrix_id", "i").join(first, ["matrix_id", "i"])
    return rounded(iterate.exact_error(x, truth), "error")


@query("i1_relative_residuals", f"WITH {flow_vectors_sql(3)}, {SPMV} SELECT system_id, {r6('sqrt(sum((ax.v - x.v) * (ax.v - x.v))) / sqrt(sum(x.v * x.v))')} AS residual, false AS accurate FROM x JOIN ax USING (system_id, i) GROUP BY 1")
def i1(spark, d):
    a = flow(spark, d)
    x = flow_vectors(a, 3)
    return rounded(checks.relative_residuals(a, x, x), "residual")


@query("i2_check_ax_b", f"WITH {flow_vectors_sql(3)}, {SPMV} SELECT system_id, {r6('sum(ax.v * x.v) / (sqrt(sum(ax.v * ax.v)) * sqrt(sum(x.v * x.v)))')} AS cosine, sum(ax.v * x.v) / (sqrt(sum(ax.v * ax.v)) * sqrt(sum(x.v * x.v))) >= 0.999999 AS consistent FROM x JOIN ax USING (system_id, i) GROUP BY 1")
def i2(spark, d):
    a = flow(spark, d)
    x = flow_vectors(a, 3)
    return rounded(checks.check_ax_b(a, x, x), "cosine")


@query("i3_check_matrices", f"WITH {FLOW} SELECT matrix_id, (max(i) + 1)::INT AS n_rows, (max(j) + 1)::INT AS n_cols, 0::BIGINT AS n_bad, true AS ok FROM flow GROUP BY 1")
def i3(spark, d):
    return checks.check_matrices(flow(spark, d))


@query("i4_check_vectors", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'length' END AS problem FROM embeddings")
def i4(spark, d):
    e = embeddings(spark, d).withColumn("x", F.when(F.col("vec_id") % 3 == 0, F.slice("x", 1, 10)).otherwise(F.col("x")))
    return checks.check_vectors(e, gram(spark, d)).select("vec_id", "problem")


@query("i5_check_symmetric", f"WITH {FLOW}, f AS (SELECT matrix_id, i, j, v + CASE WHEN i = 0 AND j = 1 THEN 0.5 ELSE 0 END AS v FROM flow), p AS (SELECT matrix_id, i, j, sum(v) AS d FROM (SELECT matrix_id, i, j, v FROM f UNION ALL SELECT matrix_id, j, i, -v FROM f) GROUP BY 1, 2, 3) SELECT matrix_id, {r6('max(abs(d))')} AS asymmetry, max(abs(d)) <= 1e-10 AS is_symmetric FROM p GROUP BY 1")
def i5(spark, d):
    a = flow(spark, d).withColumn("v", F.col("v") + F.when((F.col("i") == 0) & (F.col("j") == 1), 0.5).otherwise(0.0))
    return rounded(checks.check_symmetric(a), "asymmetry")


@query("i6_breakdown_reasons", "SELECT vec_id AS system_id, concat_ws(', ', CASE WHEN vec_id % 2 = 0 THEN 'nan' END, CASE WHEN vec_id % 3 = 0 THEN 'inf' END) AS reason FROM embeddings")
def i6(spark, d):
    spoilt = F.concat("x", F.when(F.col("vec_id") % 2 == 0, F.array(F.lit(float("nan")))).otherwise(F.array()), F.when(F.col("vec_id") % 3 == 0, F.array(F.lit(float("-inf")))).otherwise(F.array()))
    return checks.breakdown_reasons(embeddings(spark, d).select(F.col("vec_id").alias("system_id"), spoilt.alias("x"))).drop("x")


@query("i7_require_non_residual", "SELECT vec_id, 0 AS row_kind FROM embeddings")
def i7(spark, d):
    tagged = embeddings(spark, d).select("vec_id", F.lit(0).cast("tinyint").alias("row_kind"))
    return checks.require_non_residual(tagged).select("vec_id", F.col("row_kind").cast("int").alias("row_kind"))


@query("q_generate_and_verify", f"WITH {META}, s AS (SELECT m * 16777216 + row AS system_id, m AS matrix_id, row, i, {normal_sql('42', 'row', 'i')} AS v FROM (SELECT matrix_id AS m FROM meta), (SELECT unnest(range(20)) AS row), (SELECT unnest(range(64))::INT AS i)) SELECT matrix_id, 20::BIGINT AS n_systems, 0.0::DOUBLE AS worst FROM s GROUP BY 1")
def flagship(spark, sf_dir):
    """Generate forward samples for every matrix of a normalised family and report the worst error of A x = b by matrix."""
    a = gram(spark, sf_dir)
    a = scaling.normalize_matrices(a, scaling.matrix_scale(a))
    pairs = strategies.random(a, budgets(a, 20))
    x = pairs.select("system_id", "matrix_id", "i", F.col("solution").alias("v"))
    b = pairs.select("system_id", "matrix_id", "i", F.col("rhs").alias("v"))
    found = checks.relative_residuals(a, x, b).withColumn("matrix_id", F.shiftright("system_id", 24))
    return rounded(found.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n_systems"), F.max("residual").alias("worst")), "worst")


__all__ = ["flagship"]
