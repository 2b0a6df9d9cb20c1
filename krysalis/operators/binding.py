"""Joins that bind matrices, right-hand sides, solutions and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from krysalis.functions.lineage import materialize
from krysalis.functions.rng import normal, rank_key
from krysalis.operators.algebra import packed, spmv, unpacked
from krysalis.operators.models import RHS_SOURCES
from krysalis.schemas import STANDARD


def bind_systems(matrix_ids: DataFrame, rhs_ids: DataFrame | None = None, solution_ids: DataFrame | None = None, param_ids: DataFrame | None = None) -> DataFrame:
    """``(sample_id, matrix_id, rhs_id, solution_id, param_id)``.

    One matrix binds to every right-hand side (else solution, else itself); of
    several, ids must be the same everywhere. Each input has a column ``id``.
    Rows that lack a partner are an error that names the id.
    """
    one = matrix_ids.limit(2).count() == 1
    parts = {"rhs_id": rhs_ids, "solution_id": solution_ids, "param_id": param_ids}
    if one:
        base = rhs_ids if rhs_ids is not None else solution_ids if solution_ids is not None else matrix_ids
        only = matrix_ids.select(F.col("id").alias("matrix_id"))
        out = base.select(F.col("id").alias("sample_id")).join(F.broadcast(only), how="cross")  # one row, tested above
    else:
        out = matrix_ids.select(F.col("id").alias("sample_id"), F.col("id").alias("matrix_id"))
    for name, part in parts.items():
        if part is None:
            out = out.withColumn(name, F.lit(None).cast("long"))
            continue
        ids = part.select(F.col("id").alias(name))
        joined = out.join(ids, out["sample_id"] == ids[name], "full_outer")
        wrong = F.concat_ws(" ", F.lit(name), F.lit("has no partner for"), F.coalesce("sample_id", name).cast("string"))
        out = joined.withColumn("sample_id", F.when(F.col("sample_id").isNotNull() & F.col(name).isNotNull(), F.col("sample_id")).otherwise(F.raise_error(wrong).cast("long")))
    return out.select("sample_id", "matrix_id", *parts)


def binding_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(id, side)`` of the ids that only one of two sources has."""
    a, b = left.select("id", F.lit(True).alias("l")), right.select("id", F.lit(True).alias("r"))
    both = a.join(b, "id", "full_outer")
    return both.filter("l is null or r is null").select("id", F.when(F.col("r").isNull(), "missing").otherwise("extra").alias("side"))


def attach_params(samples: DataFrame, params: DataFrame, key: str = "matrix_id") -> DataFrame:
    """Every sample with its binding's parameter vector ``params(key, x)`` as ``params``."""
    return samples.join(params.select(key, F.col("x").alias("params")), key, "left")


def standard_rows(samples: DataFrame) -> DataFrame:
    """Samples for which A x = b holds."""
    return samples.filter(F.col("row_kind") == STANDARD)


def canonical_triplet(samples: DataFrame, matrices: DataFrame, sample_id: int | None = None, require_standard: bool = True) -> DataFrame:
    """One sample with its matrix's rows: the one asked for, or the first standard one of each dataset."""
    if sample_id is None:
        least = samples.groupBy("dataset_id").agg(F.min_by(F.struct(*[c for c in samples.columns if c != "dataset_id"]), F.struct("row_kind", "sample_id")).alias("row"))
        row = least.select("dataset_id", "row.*").select(*samples.columns)
    else:
        row = samples.filter(F.col("sample_id") == sample_id)
    if require_standard:
        row = row.withColumn("row_kind", F.when(F.col("row_kind") == STANDARD, F.col("row_kind")).otherwise(F.raise_error(F.lit("the row is not standard")).cast("tinyint")))
    return row.join(matrices, "matrix_id")


def comparison_grid(systems: DataFrame, preconditioners: DataFrame, most: int = 1000) -> DataFrame:
    """Every preconditioner on every system; the identity is added where it is absent.

    The preconditioners are the options of a study, ``most`` at most; more are
    an error, so their broadcast is bounded.
    """
    known = preconditioners.select("preconditioner").distinct().limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"over {most} preconditioners")
    names = sorted({r[0] for r in known} | {"identity"})
    return systems.withColumn("preconditioner", F.explode(F.array(*map(F.lit, names))))


#: Rows of a range, about.
RANGE_ROWS = 50_000


def closest_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each row of ``a(id, d)`` the row of ``b(id, d)`` of nearest ``d``; ties go to the smaller, then the lower id.

    An as-of match both ways over the distinct values: they are ranged by ``d``
    and the nearest values of b before and after are carried along, first inside
    ranges, once up and once down, then from range to range. No pairs are made,
    the work inside a range grows with its values, ranges hold like numbers of
    values wherever these lie, and a value that many rows share is one row until
    it is joined back. A null ``d`` is near nothing: such rows of b match no row,
    those of a have no match and are left out.
    """
    a, b = a.filter("d IS NOT NULL"), b.filter("d IS NOT NULL")
    both = b.select("d", "id", F.lit(True).alias("of_b")).unionByName(a.select("d", F.lit(None).cast(b.schema["id"].dataType).alias("id"), F.lit(False).alias("of_b")))
    values = both.groupBy("d").agg(F.min("id").alias("b_id"), F.max("of_b").alias("of_b"), F.max(~F.col("of_b")).alias("of_a"))
    held = values.select("d", F.when(F.col("of_b"), F.struct("d", "b_id")).alias("b"), "of_a")
    cells = max(1, -(-both.count() // RANGE_ROWS))
    # The ranges come from a sample, which only balances them, so they are written once and read by both.
    placed = materialize(held.repartitionByRange(cells, "d").withColumn("cell", F.spark_partition_id()))
    ends = placed.groupBy("cell").agg(F.max_by("b", F.when(F.col("b").isNotNull(), F.col("d"))).alias("last"), F.min_by("b", F.when(F.col("b").isNotNull(), F.col("d"))).alias("first"))
    along = Window.orderBy("cell")  # a row for each range
    back = Window.orderBy(F.desc("cell"))
    earlier = (Window.unboundedPreceding, -1)
    edge = ends.select("cell", F.last("last", True).over(along.rowsBetween(*earlier)).alias("far_below"), F.last("first", True).over(back.rowsBetween(*earlier)).alias("far_above"))
    inside = Window.partitionBy("cell")
    before = (Window.unboundedPreceding, Window.currentRow)  # a frame that ends at the partition's end is summed anew for every row
    near = placed.withColumn("below", F.last("b", True).over(inside.orderBy("d").rowsBetween(*before))).withColumn("above", F.last("b", True).over(inside.orderBy(F.desc("d")).rowsBetween(*before)))
    near = near.filter("of_a").join(edge, "cell").select("d", F.coalesce("below", "far_below").alias("below"), F.coalesce("above", "far_above").alias("above"))
    up = F.col("above.d") - F.col("d")
    down = F.col("d") - F.col("below.d")
    best = F.when(F.col("below").isNull() | (up < down), F.col("above")).otherwise(F.col("below"))
    return a.join(near.select("d", best.alias("best")), "d").select("id", "d", F.col("best.b_id").alias("b_id"), F.abs(F.col("best.d") - F.col("d")).alias("distance"))


def split_members(samples: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Samples in one split of their run: ``splits(run_id, split, sample_id)``."""
    return samples.join(splits.filter(F.col("split") == split), ["run_id", "sample_id"], "left_semi")


def gaussian_rhs(meta: DataFrame, seed: int, mu: float = 0.0, sigma: float = 1.0) -> DataFrame:
    """``(matrix_id, i, v)``: a normal right-hand side for ``meta(matrix_id, n)``."""
    return meta.select("matrix_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).withColumn("v", normal(seed, F.col("i")) * sigma + mu)


def sparse_rhs(meta: DataFrame, entries: DataFrame) -> DataFrame:
    """``(matrix_id, i, v)`` from ``entries(i, v)``; negative places count from the end, the last entry of a place wins, others are 0.

    ``entries`` has a row for each option given and at most a few; each is
    exploded against the sizes.
    """
    given = [(r["i"], float(r["v"])) for r in entries.limit(10_001).collect()]
    if len(given) > 10_000:
        raise ValueError("over 10,000 entries")
    placed = meta.select("matrix_id", "n", F.posexplode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in given])).alias("k", "e"))
    placed = placed.select("matrix_id", "k", F.pmod(F.col("e.i") + F.col("n"), F.col("n")).alias("i"), F.col("e.v").alias("v"))
    last = placed.groupBy("matrix_id", "i").agg(F.max_by("v", "k").alias("v"))
    zero = meta.select("matrix_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return zero.join(last, ["matrix_id", "i"], "left").select("matrix_id", "i", F.coalesce("v", F.lit(0.0)).alias("v"))


def lhs_rhs(matrices: DataFrame, solutions: DataFrame, scale: float = 1.0) -> DataFrame:
    """b = scale · A x for component rows ``solutions(system_id, matrix_id, i, v)``."""
    return spmv(matrices, solutions).withColumn("v", F.col("v") * scale)


def raw_rhs(rhs: DataFrame, scale: float = 1.0) -> DataFrame:
    """b = scale · rhs, component rows."""
    return rhs.withColumn("v", F.col("v") * scale)


def _gaussian(context: dict) -> DataFrame:
    return gaussian_rhs(context["meta"], context.get("seed", 42), context.get("mu", 0.0), context.get("sigma", 1.0))


#: Right-hand side sources that are built in: functions of a context, a mapping of tables and options.
BUILT_IN = {
    "gaussian": _gaussian,
    "sparse": lambda context: sparse_rhs(context["meta"], context["entries"]),
    "raw_lhs": lambda context: lhs_rhs(context["matrices"], context["solutions"], context.get("scale", 1.0)),
    "raw_rhs": lambda context: raw_rhs(context["rhs"], context.get("scale", 1.0)),
    "dataset": lambda context: raw_rhs(context["rhs"]),
}


def resolve_rhs(kind: str, context: dict) -> DataFrame:
    """``(matrix_id, i, v)``: the right-hand sides of a source by its name.

    Sources that were registered (``models.register_source``) come before those
    built in; each is a function of ``context``, which holds ``matrices``,
    ``meta(matrix_id, n)`` and what else the source needs. A name that is not
    known, and a context that lacks what a source needs, are errors.
    """
    source = RHS_SOURCES.get(kind) or BUILT_IN.get(kind)
    if source is None:
        raise ValueError(f"no such right-hand side source: {kind}")
    try:
        found = source(context)
    except KeyError as missing:
        raise ValueError(f"source {kind} needs {missing.args[0]}") from missing
    return found.select("matrix_id", "i", "v")


def pick_matrix(ids: DataFrame, seed: int = 42) -> DataFrame:
    """One matrix id, drawn by hash."""
    return ids.agg(F.min_by("matrix_id", F.struct(rank_key(seed, F.col("matrix_id")), F.col("matrix_id"))).alias("matrix_id"))


def derive_rhs(matrices: DataFrame, archive: DataFrame) -> DataFrame:
    """``(matrix_id, x)``: A times the first archive solution ``archive(matrix_id, name, x)`` of each matrix."""
    first = archive.groupBy("matrix_id").agg(F.min_by("x", "name").alias("x"))
    rows = unpacked(first, "x", "matrix_id").select(F.col("matrix_id").alias("system_id"), "matrix_id", "i", "v")
    return packed(spmv(matrices, rows), "matrix_id")
