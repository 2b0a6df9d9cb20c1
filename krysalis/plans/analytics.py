"""Queries on comparisons, predictions, run catalogues and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from krysalis.operators import compare, diagnostics, models, runs
from krysalis.plans.fixtures import ARCHIVE, E, PRED, RUNS, archive_rows, artifacts, embeddings, predictions, query, r6, rounded, table
from krysalis.plans.fixtures import runs as run_table
from krysalis.sources import sinks

SOLVES = "solves AS (SELECT o_orderkey AS system_id, p AS preconditioner, (o_orderkey + length(p)) % 3 <> 0 AS converged, (o_custkey % 90)::INT AS iterations, o_totalprice / (1 + length(p)) AS residual, (o_orderkey + length(p)) % 5 = 0 AS breakdown, o_totalprice / 100 AS condition_number FROM orders, (VALUES ('identity'), ('jacobi'), ('pod 2/grid')) t(p))"


def _solves(spark, d):
    """Orders as systems, solved under three preconditioners."""
    o = table(spark, d, "orders").withColumn("preconditioner", F.explode(F.array(F.lit("identity"), F.lit("jacobi"), F.lit("pod 2/grid"))))
    mixed = F.col("o_orderkey") + F.length("preconditioner")
    return o.select(
        F.col("o_orderkey").alias("system_id"), "preconditioner", (mixed % 3 != 0).alias("converged"), (F.col("o_custkey") % 90).cast("int").alias("iterations"),
        (F.col("o_totalprice") / (1 + F.length("preconditioner"))).alias("residual"), (mixed % 5 == 0).alias("breakdown"), (F.col("o_totalprice") / 100).alias("condition_number"),
    )


def _history(spark, d):
    """Line items of an order as the residuals of a system."""
    by = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("system_id"))
    curve = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))), lambda x: x["l_extendedprice"])
    return by.agg(curve.alias("residuals"), F.sqrt(F.sum("l_quantity").cast("double") + 0.5).alias("b_norm")).withColumn("preconditioner", F.lit("identity"))


HISTORY = "h AS (SELECT l_orderkey AS system_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1)::INT AS iter, l_extendedprice AS absolute, l_extendedprice / sqrt(sum(l_quantity) OVER (PARTITION BY l_orderkey) + 0.5) AS relative FROM lineitem)"


@query("b7_comparison_scalars", f"WITH {SOLVES} SELECT system_id, preconditioner, {r6('condition_number')} AS condition_number, iterations, {r6('residual')} AS final_residual FROM solves")
def b7(spark, d):
    return rounded(sinks.comparison_scalars(_solves(spark, d)), "condition_number", "final_residual")


@query("j1_residual_history", f"WITH {HISTORY} SELECT system_id, 'identity' AS preconditioner, iter, {r6('absolute')} AS absolute, {r6('relative')} AS relative FROM h")
def j1(spark, d):
    return rounded(compare.residual_history(_history(spark, d)), "absolute", "relative")


@query("j2_rank_preconditioners", f"WITH {SOLVES} SELECT system_id, preconditioner, (row_number() OVER (PARTITION BY system_id ORDER BY residual, preconditioner))::INT AS rank FROM solves WHERE converged")
def j2(spark, d):
    return compare.rank_preconditioners(_solves(spark, d)).select("system_id", "preconditioner", "rank")


@query("j3_summary", f"WITH {SOLVES} SELECT system_id, preconditioner, printf('- %-18s status=%-4s iters=%3d  rel_res=%.3e%s', preconditioner, CASE WHEN converged THEN 'ok' ELSE 'fail' END, iterations, sqrt(residual), CASE WHEN breakdown AND NOT converged THEN '  note=breakdown' WHEN breakdown THEN '  note=breakdown_post_convergence' ELSE '' END) AS line FROM solves")
def j3(spark, d):
    return compare.summary(_solves(spark, d).withColumn("residual", F.sqrt("residual")))


@query("j4_solver_metrics", f"WITH {SOLVES}, {HISTORY}, s AS (SELECT *, CASE preconditioner WHEN 'pod 2/grid' THEN 'pod_2_grid' ELSE preconditioner END AS g FROM solves) SELECT system_id, 'condition_number/' || g AS key, 0::BIGINT AS step, {r6('condition_number')} AS value FROM s UNION ALL SELECT system_id, 'iterations/' || g, 0, iterations FROM s UNION ALL SELECT system_id, 'final_residual/' || g, 0, {r6('residual')} FROM s UNION ALL SELECT system_id, 'converged/' || g, 0, converged::INT FROM s UNION ALL SELECT system_id, 'residual/identity', iter, {r6('relative')} FROM h")
def j4(spark, d):
    return rounded(compare.solver_metrics(_solves(spark, d), compare.residual_history(_history(spark, d))), "value")


@query("j5_sanitize_metric_key", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(p_name || '/' || p_brand || ' ', '[^A-Za-z0-9_.\\-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'unnamed') AS key FROM part")
def j5(spark, d):
    named = table(spark, d, "part").withColumn("n", F.concat("p_name", F.lit("/"), "p_brand", F.lit(" ")))
    return named.select("p_partkey", compare.sanitize_metric_key("n").alias("key"))


@query("j6_noise_robustness", f"WITH {SOLVES} SELECT (system_id % 4)::BIGINT AS level, {r6(chr(39).join(['avg(CASE WHEN preconditioner = ', 'identity', ' THEN iterations END)']))} AS identity, {r6(chr(39).join(['avg(CASE WHEN preconditioner = ', 'jacobi', ' THEN iterations END)']))} AS jacobi FROM solves GROUP BY 1")
def j6(spark, d):
    s = _solves(spark, d).select((F.col("system_id") % 4).alias("level"), F.col("preconditioner").alias("method"), "iterations")
    return rounded(compare.noise_robustness(s, ["identity", "jacobi"]), "identity", "jacobi")


_SWEEP = "sweep AS (SELECT o_orderpriority AS method, max(o_totalprice) AS setup_seconds, avg(o_totalprice) AS solve_seconds FROM orders GROUP BY 1)"


@query("j7_break_even", f"WITH {_SWEEP}, t AS (SELECT k, method, setup_seconds / k + solve_seconds AS seconds FROM sweep, (VALUES (1), (10), (100), (1000)) v(k)) SELECT k, method, {r6('seconds')} AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seconds, method) AS r FROM t) WHERE r = 1")
def j7(spark, d):
    sweep = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.max("o_totalprice").alias("setup_seconds"), F.avg("o_totalprice").alias("solve_seconds"))
    return rounded(compare.break_even(sweep, [1, 10, 100, 1000]), "seconds")


@query("j8_fastest_of", f"SELECT method, repeat, {r6('seconds')} AS seconds FROM (SELECT o_orderpriority AS method, o_orderkey AS repeat, o_totalprice AS seconds, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1")
def j8(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("repeat"), F.col("o_totalprice").alias("seconds"))
    return rounded(compare.fastest_of(t), "seconds")


@query("j9_condition_boxes", f"WITH {SOLVES} SELECT preconditioner AS label, {r6('min(condition_number)')} AS least, {r6('quantile_cont(condition_number, 0.25)')} AS q1, {r6('quantile_cont(condition_number, 0.5)')} AS median, {r6('quantile_cont(condition_number, 0.75)')} AS q3, {r6('max(condition_number)')} AS greatest FROM solves GROUP BY 1")
def j9(spark, d):
    s = _solves(spark, d).withColumnRenamed("preconditioner", "label")
    return rounded(compare.condition_boxes(s), "least", "q1", "median", "q3", "greatest")


_NAMES = "CASE p_partkey % 4 WHEN 0 THEN 'collect-' || p_size || '-norm' WHEN 1 THEN 'generate-' || p_size || '-krylov' || (p_partkey % 97) || '-norm' WHEN 2 THEN 'generate-x-raw' ELSE 'odd-name' END"


@query("j10_dataset_name_parts", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'collect' WHEN 3 THEN 'unknown' ELSE 'generate' END AS source, CASE WHEN p_partkey % 4 < 2 THEN p_size END::INT AS dimension, p_partkey % 4 < 2 AS normalized, CASE WHEN p_partkey % 4 = 1 THEN p_partkey % 97 END::INT AS krylov_percent, {_NAMES} || '-a_b' AS slug FROM part")
def j10(spark, d):
    n = table(spark, d, "part").select("p_partkey", F.expr(_NAMES).alias("name"))
    out = compare.dataset_name_parts(n).withColumn("raw", F.concat("name", F.lit("/a b")))
    return out.select("p_partkey", "source", "dimension", "normalized", "krylov_percent", compare.sanitize_identifier("raw").alias("slug"))


@query("j11_preconditioner_family", "SELECT family, count(*) AS n FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'pod2g' WHEN 1 THEN 'amg' WHEN 2 THEN 'neural' WHEN 3 THEN 'neural' WHEN 4 THEN 'jacobi' ELSE 'identity' END AS family FROM part) GROUP BY 1")
def j11(spark, d):
    k = F.col("p_partkey") % 6
    t = table(spark, d, "part").select(F.when(k < 2, "amg").when(k == 2, "neural").when(k == 3, "neural_amg").when(k == 4, "jacobi").otherwise("identity").alias("kind"), F.when(k == 0, "pod").when(k == 1, "aggregation").alias("coarsening"))
    return t.groupBy(compare.preconditioner_family().alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("k1_mae_mse", f"WITH {PRED} SELECT {r6('avg(abs(residual))')} AS mae, {r6('avg(residual * residual)')} AS mse FROM pred")
def k1(spark, d):
    return rounded(diagnostics.mae_mse(predictions(spark, d)), "mae", "mse")


def _stats_sql(c: str) -> str:
    f = {"min": f"min({c})", "max": f"max({c})", "mean": f"avg({c})", "median": f"quantile_cont({c}, 0.5)", "std": f"stddev_pop({c})", "norm": f"sqrt(sum({c} * {c}))"}
    return ", ".join(f"{r6(e)} AS {c}_{n}" for n, e in f.items())


@query("k2_prediction_stats", f"WITH {PRED} SELECT {_stats_sql('y_true')}, {_stats_sql('y_pred')}, {r6('avg(abs(residual))')} AS mae, {r6('sqrt(avg(residual * residual))')} AS rmse, {r6('max(abs(residual))')} AS max_abs, {r6('sqrt(sum(y_pred * y_pred)) / sqrt(sum(y_true * y_true))')} AS scale_ratio FROM pred")
def k2(spark, d):
    out = diagnostics.prediction_stats(predictions(spark, d))
    return rounded(out, *out.columns)


@query("k3_synthetic_error", f"WITH {PRED} SELECT {r6('sqrt(sum(residual * residual))')} AS l2_error, {r6('sqrt(sum(y_true * y_true))')} AS l2_true, {r6('max(abs(residual))')} AS max_error, {r6('avg(abs(residual))')} AS mean_error, {r6('sqrt(sum(residual * residual)) / sqrt(sum(y_true * y_true))')} AS relative_error FROM pred")
def k3(spark, d):
    out = diagnostics.synthetic_error(predictions(spark, d))
    return rounded(out, *out.columns)


def _histogram_sql(source: str, value: str, extra: str = "") -> str:
    return f"SELECT {extra}least(floor(({value} - lo) / ((hi - lo) / 50)), 49)::INT AS bin, {r6('lo + least(floor((' + value + ' - lo) / ((hi - lo) / 50)), 49) * ((hi - lo) / 50)')} AS low, count(*) AS n FROM {source}, (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}) GROUP BY ALL"


@query("k4_norm_histogram", f"WITH {E}, n AS MATERIALIZED (SELECT vec_id, floor(sqrt(sum(round(v, 3) * round(v, 3))) * 1000) AS norm FROM e GROUP BY 1) {_histogram_sql('n', 'norm')}")
def k4(spark, d):
    """Norms of the vectors rounded to a grid, so that bin borders are exact."""
    e = embeddings(spark, d).withColumn("x", F.transform("x", lambda v: F.round(v, 3)))
    norm = F.floor(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)) * 1000)
    return rounded(diagnostics.norm_histogram(e.select(F.array(norm.cast("double")).alias("x")), "x").select("bin", "low", "n"), "low")


@query("k5_value_histogram", f"WITH {PRED}, p AS MATERIALIZED (SELECT round(y_true, 2) * 100 AS y_true, round(y_true, 2) * 100 - 1 AS y_pred, 1.0::DOUBLE AS residual FROM pred) {_histogram_sql('p', 'y_true', chr(39) + 'y_true' + chr(39) + ' AS series, ')}")
def k5(spark, d):
    """True values on a grid, as above."""
    p = predictions(spark, d).withColumn("y_true", F.transform("y_true", lambda v: F.round(v, 2) * 100))
    p = p.withColumn("y_pred", F.transform("y_true", lambda v: v - 1))
    return rounded(diagnostics.value_histogram(p).filter("series = 'y_true'").select("series", "bin", "low", "n"), "low")


@query("k6_parity_rows", f"WITH {PRED} SELECT sample_id, i, {r6('y_true')} AS y_true, {r6('y_pred')} AS y_pred, {r6('residual')} AS residual FROM pred")
def k6(spark, d):
    return rounded(diagnostics.parity_rows(predictions(spark, d)), "y_true", "y_pred", "residual")


@query("k6_parity_stats", f"WITH {PRED} SELECT {r6('avg(abs(residual))')} AS mae, {r6('sqrt(avg(residual * residual))')} AS rmse, {r6('1 - sum(residual * residual) / (var_pop(y_true) * count(*))')} AS r2 FROM pred")
def k6b(spark, d):
    return rounded(diagnostics.parity_stats(predictions(spark, d)), "mae", "rmse", "r2")


@query("l1_latest_run", f"WITH {RUNS} SELECT run_id, experiment, status FROM runs ORDER BY start_time DESC, run_id DESC LIMIT 1")
def l1(spark, d):
    return runs.latest_run(run_table(spark, d)).select("run_id", "experiment", "status")


_OK = f"{RUNS}, good AS (SELECT *, row_number() OVER (PARTITION BY assignment_id ORDER BY start_time DESC, run_id DESC) AS k FROM runs WHERE status = 'FINISHED' AND run_id IN (SELECT run_id FROM arts))"


@query("l2_latest_successful", f"WITH {_OK} SELECT assignment_id, run_id FROM good WHERE k = 1")
def l2(spark, d):
    return runs.latest_successful(run_table(spark, d), artifacts(spark, d)).select("assignment_id", "run_id")


@query("l3_pending_assignments", f"WITH {_OK} SELECT c_custkey AS assignment_id FROM customer WHERE c_custkey NOT IN (SELECT assignment_id FROM good)")
def l3(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("assignment_id"))
    return runs.pending_assignments(a, run_table(spark, d), artifacts(spark, d))


@query("l4_search_models", f"WITH {RUNS} SELECT run_id FROM runs WHERE status = 'FINISHED' ORDER BY start_time DESC, run_id DESC LIMIT 25")
def l4(spark, d):
    tagged = run_table(spark, d).withColumn("tags", F.create_map(F.lit("status"), "status"))
    return runs.search_models(tagged, "train", {"status": "FINISHED"}, 25).select("run_id")


@query("l5_resolve_version", "SELECT l_orderkey AS model, max(l_linenumber)::INT AS version, 'newest' AS kind FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 1, 'alias' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def l5(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("model"), F.col("l_linenumber").cast("int").alias("version"), F.lit("best.ckpt").alias("pinned_path")).distinct()
    alias = v.filter("version = 1").select("model", "version", F.lit("Champion ").alias("alias"))
    both = runs.resolve_version(v).withColumn("kind", F.lit("newest")).unionByName(runs.resolve_version(v, alias, "champion").withColumn("kind", F.lit("alias")))
    return both.select("model", "version", "kind")


@query("l6_metric_report", f"WITH {RUNS} SELECT run_id, {r6('CASE WHEN run_id % 3 = 0 THEN NULL ELSE value END')} AS value, run_id % 3 = 0 AS missing FROM runs")
def l6(spark, d):
    r = run_table(spark, d)
    key = F.when(F.col("run_id") % 3 == 1, "loss").otherwise("eval/loss")
    metrics = r.filter("run_id % 3 <> 0").select("run_id", key.alias("key"), F.lit(0).cast("long").alias("step"), "value")
    return rounded(runs.metric_report(r, metrics, "loss"), "value")


@query("l7_label_map", f"WITH {RUNS} SELECT 'R' || row_number() OVER (ORDER BY run_id) AS label, run_id::VARCHAR AS run, status FROM runs")
def l7(spark, d):
    out = runs.label_map(run_table(spark, d))
    return out.select("label", F.col("identity")["run_id"].alias("run"), F.col("identity")["status"].alias("status"))


@query("l8_dedupe_checkpoints", "SELECT l_orderkey AS run_id, CASE WHEN count(DISTINCT l_linenumber) = 1 OR l_orderkey % 3 = 0 THEN 'a/' || min(l_linenumber) || '/best.ckpt' WHEN l_orderkey % 3 = 1 THEN 'best.ckpt' END AS path FROM lineitem GROUP BY 1")
def l8(spark, d):
    """A third of the runs have copies of one file, a third one best among others, the rest several different ones."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber").distinct()
    n = F.col("l_linenumber").cast("string")
    deep = F.concat(F.lit("a/"), n, F.lit("/best.ckpt"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("run_id")) == 1
    first = F.col("l_linenumber") == F.min("l_linenumber").over(Window.partitionBy("run_id"))
    path = F.when((F.col("run_id") % 3 == 0) | alone, deep).when(F.col("run_id") % 3 == 1, F.when(first, "best.ckpt").otherwise(F.concat(F.lit("b/last-"), n))).otherwise(F.concat(F.lit("c/"), n))
    digest = F.when(F.col("run_id") % 3 == 0, "same").otherwise(n)
    return runs.dedupe_checkpoints(t.select("run_id", path.alias("path"), digest.alias("digest"))).select("run_id", "path")


@query("l9_batch_status", f"WITH {RUNS} SELECT assignment_id AS batch, count(*) FILTER (WHERE status <> 'FAILED') AS n_success, count(*) FILTER (WHERE status = 'FAILED') AS n_failed, CASE WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 THEN 'FAILED' ELSE 'FINISHED' END AS status FROM runs GROUP BY 1")
def l9(spark, d):
    return runs.batch_status(run_table(spark, d).select(F.col("assignment_id").alias("batch"), "status"))


@query("l10_latest_checkpoint", "SELECT 'u' || user_id AS folder, 'u' || user_id || '/e' || arg_max(event_id, (ts, 'u' || user_id || '/e' || event_id)) AS path FROM events GROUP BY user_id")
def l10(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/e"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("modificationTime"))
    return runs.latest_checkpoint(e)


@query("m2_predict", f"WITH {E} SELECT vec_id AS sample_id, i, {r6('2 * v + 1')} AS y_pred FROM e")
def m2(spark, d):
    s = embeddings(spark, d).select(F.col("vec_id").alias("sample_id"), "x")
    return rounded(models.predict(s, ["x"], lambda x: 2 * x + 1, 128).select("sample_id", F.posexplode("y_pred").alias("i", "y_pred")), "y_pred")


@query("m3_learned_preconditioner", f"WITH {ARCHIVE} SELECT system_id, matrix_id, i, {r6('v / 4')} AS v FROM av")
def m3(spark, d):
    return rounded(models.learned_preconditioner(archive_rows(spark, d), lambda r: r / 4), "v")


@query("f14_pod_from_predictions")
def f14(spark, d):
    """Two modes of the outputs of a model: no SQL, see tests/test_dense.py."""
    return models.pod_from_predictions(embeddings(spark, d).select("matrix_id", "x"), ["x"], np.tanh, 2)
