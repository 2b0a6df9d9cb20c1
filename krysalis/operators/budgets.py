"""Row budgets of generation strategies: counts, allocation, mixing, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from krysalis.functions.rng import rank_key, uniform
from krysalis.operators.ordering import numbered, running_before
from krysalis.schemas import CG_INTERNAL, STANDARD

#: Other names of strategies, and what holds of each kind.
ALIASES = {"rhs_bank": "rhs_archive", "rhs_repository": "rhs_archive", "solution_bank": "solution_archive", "solution_repository": "solution_archive"}
INTERNAL_STRATEGIES = ("residuals", "gaussian_residuals", "search_directions")
MULTI_MATRIX = ("random", "normal", "gaussian_forward", "gaussian_inverse", "residuals", "gaussian_residuals", "search_directions")


def canonical_name(name: str) -> Column:
    """Lower case, hyphens as underscores, other names resolved."""
    plain = F.regexp_replace(F.lower(F.trim(F.col(name))), "-", "_")
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))[plain], plain)


def mix_counts(weights: DataFrame, total: int) -> DataFrame:
    """``(strategy, samples)`` that sum to ``total``: largest remainders of ``weights(strategy, weight)``.

    Ties go to the larger weight, then the name. Strategies are few, so their
    one window holds a handful of rows.
    """
    every = Window.partitionBy()
    share = weights.withColumn("exact", F.col("weight") / F.sum("weight").over(every) * total).withColumn("whole", F.floor("exact"))
    left = F.lit(total) - F.sum("whole").over(every)
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("whole")), F.desc("weight"), "strategy"))
    return share.withColumns({"left": left, "rank": rank}).select("strategy", (F.col("whole") + (F.col("rank") <= F.col("left")).cast("int")).cast("long").alias("samples"))


def merge_budgets(specs: DataFrame) -> DataFrame:
    """``(strategy, samples)`` by canonical name: -1 (all) wins, counts above 0 add up, else the largest."""
    positive = F.sum(F.greatest("samples", F.lit(0)))
    value = F.when(F.min("samples") == -1, F.lit(-1)).when(F.max("samples") > 0, positive).otherwise(F.max("samples"))
    return specs.select(canonical_name("strategy").alias("strategy"), "samples").groupBy("strategy").agg(value.cast("long").alias("samples"))


def allocate_rows(bindings: DataFrame, count: int, replacement: bool = False, seed: int = 42) -> DataFrame:
    """``(binding, rows)``: an even split whose remainder goes to the first bindings, or draws with replacement.

    ``bindings(binding long)`` are ranked by id; -1 rows mean all of each.
    """
    if count < 0:
        return bindings.select("binding", F.lit(-1).cast("long").alias("rows"))
    m = bindings.count()
    ranked = numbered(bindings.select("binding"), "binding", name="rank")
    if not replacement:
        return ranked.select("binding", (F.lit(count // max(m, 1)) + (F.col("rank") < count % max(m, 1)).cast("int")).cast("long").alias("rows"))
    draws = bindings.sparkSession.range(count).select(F.floor(uniform(seed, F.col("id")) * m).cast("int").alias("rank")).groupBy("rank").count()
    return ranked.join(draws, "rank", "left").select("binding", F.coalesce("count", F.lit(0)).cast("long").alias("rows"))


def archive_offsets(allocation: DataFrame) -> DataFrame:
    """``allocation(binding, rows)`` with ``skip``, the rows that earlier bindings have taken."""
    return running_before(allocation, "rows", "binding", name="skip")


def trace_budget(budgets: DataFrame, iterations: int, every_n: int = 1) -> DataFrame:
    """``budgets(strategy, samples)`` with ``rows_per_system`` and ``systems``, enough for the samples."""
    per = iterations // every_n + 1
    return budgets.withColumns({"rows_per_system": F.lit(per).cast("long"), "systems": F.ceil(F.col("samples") / per).cast("long")})


def trim_rows(traces: DataFrame, n: int) -> DataFrame:
    """The first ``n`` trace rows by (system, iteration).

    Counts by system tell where each begins; only systems that begin inside are
    kept and ranked, each by itself.
    """
    per = traces.groupBy("system_id").agg(F.count(F.lit(1)).alias("rows"))
    starts = running_before(per, "rows", "system_id").filter(F.col("before") < n).select("system_id", "before")
    rank = F.row_number().over(Window.partitionBy("system_id").orderBy("iter"))
    return traces.join(starts, "system_id").withColumn("rank", rank).filter(F.col("before") + F.col("rank") <= n).select(*traces.columns)


def every_nth(traces: DataFrame, n: int) -> DataFrame:
    """Iterations 0, n, 2n, ..."""
    return traces.filter(F.col("iter") % n == 0)


def mix_union(blocks: list[DataFrame]) -> DataFrame:
    """Blocks of samples one after another, their ids shifted so that they stay apart."""
    out, shift = None, F.lit(0)
    for block in blocks:
        top = block.agg(F.coalesce(F.max("sample_id") + 1, F.lit(0)).alias("__top"))
        moved = block.withColumn("sample_id", F.col("sample_id") + shift)
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
        shift = shift + F.lit(top.first()["__top"])
    return out


def shuffle_within(samples: DataFrame, key: str = "matrix_id", seed: int = 42) -> DataFrame:
    """``position`` from 0 in a repeatable random order inside each ``key``; references by id need no change.

    The order is that of a hash, whose first digits cut each key into up to
    4,096 parts: places are counted inside parts, and parts by their sizes, so a
    key with most of the rows is many groups.
    """
    names = samples.columns
    dealt = samples.withColumn("__order", rank_key(seed, F.col("sample_id"))).withColumn("__part", F.substring("__order", 1, 3))
    sizes = dealt.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part")) - F.col("__n")
    starts = sizes.select(F.col(key).alias("__key"), F.col("__part").alias("__p"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(key, "__part").orderBy("__order", "sample_id")) - 1
    both = dealt.withColumn("__place", place).join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")))
    return both.select(*names, (F.col("__before") + F.col("__place")).cast("int").alias("position"))


def tag_row_kind(samples: DataFrame) -> DataFrame:
    """``row_kind``: iteration 0 and all strategies but the internal ones are standard."""
    kind = F.when(F.col("iter") == 0, STANDARD).when(F.col("strategy").isin(*INTERNAL_STRATEGIES), CG_INTERNAL).otherwise(STANDARD)
    return samples.withColumn("row_kind", kind.cast("tinyint"))


def check_alignment(samples: DataFrame) -> DataFrame:
    """Samples whose right-hand side, solution and tag do not belong together; a sound table has none."""
    return samples.filter(F.col("row_kind").isNull() | F.col("matrix_id").isNull() | ~F.size("rhs").eqNullSafe(F.size("solution")))


def check_mixable(budgets: DataFrame, n_matrices: int, replacement: bool = False, finite: tuple[str, ...] = ()) -> DataFrame:
    """``budgets(strategy, samples)`` with ``problem``, null where all is well.

    Over several matrices, strategies for one matrix do not mix with those for
    many, and only the latter draw with replacement, if their source is not
    ``finite``. Strategies without samples do not count.
    """
    active = F.col("samples") != 0
    multi = canonical_name("strategy").isin(*MULTI_MATRIX)
    every = Window.partitionBy()
    some = lambda c: F.coalesce(F.bool_or(c & active).over(every), F.lit(False))
    problem = F.when(F.lit(n_matrices <= 1) | ~active, None).when(some(multi) & some(~multi), "mixes one-matrix and many-matrix strategies")
    problem = problem.when(F.lit(replacement) & ~multi, "no replacement").when(F.lit(replacement) & canonical_name("strategy").isin(*finite or ("",)), "a finite source has no replacement")
    return budgets.withColumn("problem", problem)
