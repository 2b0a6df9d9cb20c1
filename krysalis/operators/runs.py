"""Queries over a catalogue of runs, metrics, artifacts and model versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _newest(runs: DataFrame, *keys: str) -> DataFrame:
    """The newest run of each key, ties to the larger id: one pass of partial aggregates, no sort."""
    best = F.max_by(F.struct(*runs.columns), F.struct("start_time", "run_id"))
    return runs.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(best.alias("best")).select("best.*")


def latest_run(runs: DataFrame, experiment: str | None = None, name: str | None = None) -> DataFrame:
    """The newest run of each experiment, or of one, of a name if given."""
    if experiment is not None:
        runs = runs.filter(F.col("experiment") == experiment)
    if name is not None:
        runs = runs.filter(F.col("run_name") == name)
    return _newest(runs, "experiment")


def latest_successful(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The newest finished run with an artifact, by assignment."""
    return _newest(runs.filter("status = 'FINISHED'").join(artifacts.select("run_id").distinct(), "run_id", "left_semi"), "assignment_id")


def pending_assignments(assignments: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Assignments without a finished run that has an artifact."""
    return assignments.join(latest_successful(runs, artifacts), "assignment_id", "left_anti")


def search_models(runs: DataFrame, experiment: str | None = None, tags: dict[str, str] | None = None, most: int = 100) -> DataFrame:
    """The newest ``most`` runs that have the tags (a map column)."""
    if experiment is not None:
        runs = runs.filter(F.col("experiment") == experiment)
    for key, value in (tags or {}).items():
        runs = runs.filter(F.col("tags")[key] == value)
    return runs.orderBy(F.desc("start_time"), F.desc("run_id")).limit(most)


def resolve_version(versions: DataFrame, aliases: DataFrame | None = None, alias: str | None = None, version: int | None = None) -> DataFrame:
    """For each model the version of an alias, the one given, or the largest; one without a pinned path is an error."""
    if alias is not None:
        chosen = versions.join(aliases.filter(F.lower(F.trim("alias")) == alias.strip().lower()).select("model", "version"), ["model", "version"], "left_semi")
    elif version is not None:
        chosen = versions.filter(F.col("version") == version)
    else:
        best = versions.groupBy("model").agg(F.max_by(F.struct(*versions.columns), "version").alias("best"))
        chosen = best.select("best.*")
    return chosen.withColumn("pinned_path", F.coalesce("pinned_path", F.raise_error(F.lit("the version has no pinned file"))))


def metric_report(runs: DataFrame, metrics: DataFrame, metric: str) -> DataFrame:
    """``(run_id, value, missing)``: the last value of the metric, or of ``eval/`` and the metric."""
    wanted = metrics.filter(F.col("key").isin(metric, f"eval/{metric}"))
    last = wanted.groupBy("run_id").agg(*(F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("step"))).alias(a) for k, a in ((metric, "plain"), (f"eval/{metric}", "prefixed"))))
    value = F.coalesce("plain", "prefixed")
    return runs.join(last, "run_id", "left").select("run_id", value.alias("value"), value.isNull().alias("missing"))


def label_map(runs: DataFrame) -> DataFrame:
    """``(label, identity)``: a short label by order of id and what it stands for; numbered within blocks of ids, so by two levels."""
    blocks = runs.withColumn("block", F.floor(F.col("run_id") / 65536))
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("block").orderBy("run_id"))
    named = blocks.withColumn("number", number).join(before, "block")
    return named.select(F.concat(F.lit("R"), (F.col("before") + F.col("number")).cast("string")).alias("label"), F.create_map(F.lit("run_id"), F.col("run_id").cast("string"), F.lit("status"), F.col("status")).alias("identity"))


def dedupe_checkpoints(files: DataFrame) -> DataFrame:
    """``files(run_id, path, digest)`` to one path a run.

    Copies of one file give the shallowest path; among different files a single
    ``best.ckpt`` wins; else ``path`` is null and ``problem`` tells.
    """
    name = F.element_at(F.split("path", "/"), -1)
    depth = F.size(F.split("path", "/"))
    found = files.withColumns({"name": name, "depth": depth}).groupBy("run_id").agg(
        F.count_distinct("name", "digest").alias("kinds"), F.min(F.struct("depth", "path")).alias("shallow"),
        F.sum((F.col("name") == "best.ckpt").cast("int")).alias("n_best"), F.min(F.when(F.col("name") == "best.ckpt", F.col("path"))).alias("best"),
    )
    path = F.when(F.col("kinds") == 1, F.col("shallow.path")).when(F.col("n_best") == 1, F.col("best"))
    return found.select("run_id", path.alias("path"), F.when(path.isNull(), "several different checkpoints").alias("problem"))


def batch_status(results: DataFrame) -> DataFrame:
    """``(batch, n_success, n_failed, status)``: a batch failed if any of its assignments did."""
    failed = F.sum((F.col("status") == "FAILED").cast("long"))
    return results.groupBy("batch").agg(F.sum((F.col("status") != "FAILED").cast("long")).alias("n_success"), failed.alias("n_failed"), F.when(failed > 0, "FAILED").otherwise("FINISHED").alias("status"))


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """The newest file of each folder: ``(folder, path)``."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.withColumn("folder", folder).groupBy("folder").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
