"""Analytics over solver comparisons: rankings, summaries, metric rows, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from krysalis.functions.lineage import materialize
from krysalis.operators.ordering import running_before


def residual_history(packed: DataFrame) -> DataFrame:
    """``packed(system_id, preconditioner, b_norm, residuals)`` as rows by step; relative where ‖b‖ > 0."""
    rows = packed.select("system_id", "preconditioner", "b_norm", F.posexplode("residuals").alias("iter", "absolute"))
    return rows.withColumn("relative", F.when(F.col("b_norm") > 0, F.col("absolute") / F.col("b_norm"))).drop("b_norm")


def rank_preconditioners(solves: DataFrame) -> DataFrame:
    """Converged solves with ``rank`` by residual inside each system; 1 is the best. Ties go by name."""
    order = Window.partitionBy("system_id").orderBy("residual", "preconditioner")
    return solves.filter("converged").withColumn("rank", F.row_number().over(order))


def summary(solves: DataFrame) -> DataFrame:
    """``line``: status, iterations, residual and notes of ``solves(preconditioner, converged, iterations, residual, breakdown)``."""
    status = F.when(F.col("converged"), "ok").otherwise("fail")
    note = F.when(F.col("breakdown") & ~F.col("converged"), "  note=breakdown").when(F.col("breakdown"), "  note=breakdown_post_convergence").otherwise("")
    line = F.concat(F.lit("- "), F.rpad("preconditioner", 18, " "), F.lit(" status="), F.rpad(status, 4, " "), F.lit(" iters="), F.lpad(F.col("iterations").cast("string"), 3, " "), F.lit("  rel_res="), F.format_string("%.3e", F.col("residual")), note)
    return solves.select("system_id", "preconditioner", line.alias("line"))


def sanitize_metric_key(name: str, default: str = "unnamed") -> Column:
    """A name as a segment of a metric key: other characters become underscores, ends are trimmed."""
    clean = F.regexp_replace(F.regexp_replace(F.col(name), r"[^A-Za-z0-9_.\-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(clean == "", default).otherwise(clean)


def solver_metrics(solves: DataFrame, history: DataFrame) -> DataFrame:
    """Metric rows ``(system_id, key, step, value)``: one for each figure of a solve, and its residuals by step."""
    named = solves.withColumn("segment", sanitize_metric_key("preconditioner"))
    figures = named.select("system_id", "segment", F.explode(F.create_map(
        F.lit("condition_number"), F.col("condition_number"), F.lit("iterations"), F.col("iterations").cast("double"),
        F.lit("final_residual"), F.col("residual"), F.lit("converged"), F.col("converged").cast("int").cast("double"),
    )).alias("what", "value"))
    rows = figures.select("system_id", F.concat_ws("/", "what", "segment").alias("key"), F.lit(0).cast("long").alias("step"), "value")
    steps = history.select("system_id", F.concat(F.lit("residual/"), sanitize_metric_key("preconditioner")).alias("key"), F.col("iter").cast("long").alias("step"), F.col("relative").alias("value"))
    return rows.unionByName(steps)


def noise_robustness(solves: DataFrame, methods: list[str]) -> DataFrame:
    """Mean iterations by ``level`` with a column for each method."""
    return solves.groupBy("level").pivot("method", methods).agg(F.avg("iterations"))


def break_even(sweep: DataFrame, counts: list[int]) -> DataFrame:
    """For each number of solves K the method of least setup/K + solve seconds: ``(k, method, seconds)``."""
    rows = sweep.withColumn("k", F.explode(F.array(*map(F.lit, counts)))).withColumn("seconds", F.col("setup_seconds") / F.col("k") + F.col("solve_seconds"))
    best = rows.groupBy("k").agg(F.min(F.struct("seconds", "method")).alias("best"))
    return best.select("k", F.col("best.method").alias("method"), F.col("best.seconds").alias("seconds"))


def fastest_of(timings: DataFrame) -> DataFrame:
    """The repeat of least seconds by method; ties go to the earliest: ``(method, repeat, seconds)``."""
    best = timings.groupBy("method").agg(F.min(F.struct("seconds", "repeat")).alias("best"))
    return best.select("method", F.col("best.repeat").alias("repeat"), F.col("best.seconds").alias("seconds"))


def condition_boxes(solves: DataFrame) -> DataFrame:
    """Least, quartiles and greatest condition number by label; quartiles are exact, interpolated between neighbours.

    Equal values are counted together and ordered by label and value over ranges,
    so a label with most of the rows is many tasks; of each quartile only the
    values on both sides of its place reach the label. Nulls don't count, a label
    with no others has nulls.
    """
    value = "condition_number"
    counts = solves.filter(F.col(value).isNotNull()).groupBy("label", value).agg(F.count(F.lit(1)).alias("n"))
    placed = materialize(running_before(counts, "n", "label", value))
    ends = materialize(placed.groupBy("label").agg(F.min("before").alias("start"), F.sum("n").alias("rows"), F.min(value).alias("least"), F.max(value).alias("greatest")))
    at = placed.withColumnRenamed("label", "of").join(ends.select("label", "start", "rows"), F.col("of").eqNullSafe(F.col("label"))).withColumn("first", F.col("before") - F.col("start"))
    quartiles = []
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        place = p * (F.col("rows") - 1)
        held = lambda k: (F.col("first") <= k) & (k < F.col("first") + F.col("n"))
        at = at.withColumns({f"{name}_lo": F.when(held(F.floor(place)), F.col(value)), f"{name}_hi": F.when(held(F.ceil(place)), F.col(value))})
        lo, hi, part = F.max(f"{name}_lo"), F.max(f"{name}_hi"), p * (F.max("rows") - 1) - F.floor(p * (F.max("rows") - 1))
        quartiles.append(F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi).cast("double").alias(name))
    boxes = at.filter(" OR ".join(f"{q}_{e} IS NOT NULL" for q in ("q1", "median", "q3") for e in ("lo", "hi"))).groupBy("label").agg(*quartiles).withColumnRenamed("label", "of")
    found = ends.join(boxes, F.col("of").eqNullSafe(F.col("label"))).select("label", "least", "q1", "median", "q3", "greatest")
    empty = solves.groupBy("label").agg(F.count(value).alias("n")).filter("n = 0")
    return found.unionByName(empty.select("label"), allowMissingColumns=True)


def dataset_name_parts(names: DataFrame, name: str = "name") -> DataFrame:
    """``source, dimension, normalized, krylov_percent`` of names such as ``generate-90-krylov50-norm``."""
    parts = F.split(F.col(name), "-")
    few = F.size(parts) < 3
    middle = F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0)))
    tags = F.filter(F.transform(middle, lambda p: F.when(p.startswith("krylov"), F.regexp_replace(p, "krylov", "").try_cast("int"))), lambda v: v.isNotNull())
    return names.withColumns({
        "source": F.when(few, "unknown").otherwise(parts[0]),
        "dimension": F.when(~few, F.element_at(parts, 2).try_cast("int")),
        "normalized": ~few & (F.element_at(parts, -1) == "norm"),
        "krylov_percent": F.when(~few & (F.size(tags) > 0), F.try_element_at(tags, F.lit(-1))),
    })


def sanitize_identifier(name: str, default: str = "run") -> Column:
    """A name as part of a file's: slashes become hyphens, other characters underscores, ends are trimmed."""
    clean = F.regexp_replace(F.trim(F.col(name)), r"[/\\]", "-")
    clean = F.regexp_replace(F.regexp_replace(clean, r"[^A-Za-z0-9._-]+", "_"), r"^[_.-]+|[_.-]+$", "")
    return F.when(clean == "", default).otherwise(F.coalesce(clean, F.lit(default)))


def preconditioner_family(kind: str = "kind", coarsening: str = "coarsening") -> Column:
    """``pod2g`` for multigrid with a basis of snapshots, ``amg`` for other multigrid, ``neural`` for learned ones, else the kind."""
    return F.when((F.col(kind) == "amg") & F.col(coarsening).isin("pod", "neural_pod"), "pod2g").when(F.col(kind).isin("neural", "neural_amg"), "neural").otherwise(F.col(kind))
