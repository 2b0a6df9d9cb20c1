"""Queries on sources, sinks, bindings and budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from krysalis.functions.lineage import shared_folder
from krysalis.operators import algebra, binding, budgets, models, scaling
from krysalis.plans.fixtures import ARCHIVE, E, FLOW, PARTS, archive, archive_rows, embeddings, flow, gram, normal_sql, params, part_files, predictions, query, r6, rounded, table
from krysalis.sources import files, sinks

LISTED = f"{PARTS}, listed AS (SELECT path, p_partkey, row_number() OVER (ORDER BY path) - 1 AS id FROM files)"


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/krysalis-{uuid.uuid4().hex}"


@query("a1_read_matrix_text", f"WITH {FLOW} SELECT matrix_id, i, j, {r6('v')} AS v FROM flow")
def a1(spark, d):
    """The flow matrices, written as text, one file each, and read back."""
    a = flow(spark, d)
    row = a.groupBy("matrix_id", "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)).cast("string")), " ")
    text = row.groupBy("matrix_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
    path = _scratch(spark)
    text.repartition("matrix_id").write.partitionBy("matrix_id").text(path)
    back = files.read_matrix_text(spark, f"{path}/*/*.txt")
    key = F.regexp_extract("path", r"matrix_id=(\d+)", 1).cast("long")
    return rounded(back.select(key.alias("matrix_id"), "i", "j", "v"), "v")


@query("a3_read_vectors", f"WITH {E} SELECT matrix_id, i, {r6('avg(v)')} AS v FROM e GROUP BY 1, 2")
def a3(spark, d):
    """Mean vectors by label, written as text and read back."""
    mean = embeddings(spark, d).select("matrix_id", F.posexplode("x").alias("i", "v")).groupBy("matrix_id", "i").agg(F.avg("v").alias("v"))
    text = algebra.packed(mean, "matrix_id").select("matrix_id", F.array_join(F.transform("x", lambda v: v.cast("string")), "\n").alias("value"))
    path = _scratch(spark)
    text.repartition("matrix_id").write.partitionBy("matrix_id").text(path)
    back = files.read_vectors(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", r"matrix_id=(\d+)", 1).cast("long").alias("matrix_id"), F.posexplode("x").alias("i", "v"))
    return rounded(back, "v")


@query("a4_assign_ids_by_regex", f"WITH {PARTS} SELECT path, p_partkey AS id FROM files")
def a4(spark, d):
    return files.assign_ids_by_regex(part_files(spark, d)).select("path", "id")


@query("a4_duplicate_ids", "SELECT p_size::BIGINT AS id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def a4b(spark, d):
    named = table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit("_"), F.col("p_size").cast("string"), F.lit(".txt")).alias("path"))
    return files.duplicate_ids(files.assign_ids_by_regex(named))


@query("a5_assign_ids_by_order", f"WITH {LISTED} SELECT path, id FROM listed")
def a5(spark, d):
    return files.assign_ids_by_order(part_files(spark, d)).select("path", "id")


@query("a6_filter_ids", "SELECT o_orderkey AS id, 'include' AS kind FROM orders WHERE o_orderkey IN (1, 5, 7, 32, 99) UNION ALL SELECT o_orderkey, 'exclude' FROM orders WHERE o_orderkey NOT IN (1, 5, 7, 32, 99)")
def a6(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    chosen = [1, 5, 7, 32, 99]
    return files.filter_ids(ids, include=chosen).withColumn("kind", F.lit("include")).unionByName(files.filter_ids(ids, exclude=chosen).withColumn("kind", F.lit("exclude")))


@query("a7_select_archive", f"WITH {LISTED}, drawn AS (SELECT path, row_number() OVER (ORDER BY md5('42|' || path) || '|' || path) - 1 AS id FROM files) SELECT path, id - 10 AS row, 'ordered' AS kind FROM listed WHERE id >= 10 AND id < 60 UNION ALL SELECT path, id - 5 AS row, 'shuffled' FROM drawn WHERE id >= 5")
def a7(spark, d):
    listing = part_files(spark, d).select("path")
    ordered = files.select_archive(listing, 50, skip=10).withColumn("kind", F.lit("ordered"))
    return ordered.unionByName(files.select_archive(listing, -1, True, 42, 5).withColumn("kind", F.lit("shuffled")))


@query("a8_load_archive_pairs", f"WITH {ARCHIVE}, a AS (SELECT row, i, v FROM av WHERE matrix_id = 0 AND row < 20), b AS (SELECT row, i, v FROM av WHERE matrix_id = 1 AND row < 20) SELECT row, {r6('sum(a.v * b.v)')} AS product FROM a JOIN b USING (row, i) GROUP BY 1")
def a8(spark, d):
    arc = archive(spark, d).filter("row < 20")
    both = files.load_archive_pairs(arc.filter("matrix_id = 0"), arc.filter("matrix_id = 1"))
    product = F.aggregate(F.zip_with("x", "b", lambda x, b: x * b), F.lit(0.0), lambda s, v: s + v)
    return rounded(both.select("row", product.alias("product")), "product")


@query("a9_archive_or_random", f"WITH {FLOW}, {ARCHIVE} SELECT 'random' AS kind, m AS matrix_id, row, {r6(normal_sql('42', 'row', '3'))} AS v FROM (SELECT DISTINCT matrix_id AS m FROM flow), (SELECT unnest(range(5)) AS row) UNION ALL SELECT 'archive', matrix_id, row, {r6('v')} FROM av WHERE row < 5 AND i = 3")
def a9(spark, d):
    meta = algebra.sizes(flow(spark, d))
    drawn = files.archive_or_random(None, meta, 5).withColumn("kind", F.lit("random"))
    held = files.archive_or_random(archive(spark, d), meta, 5).withColumn("kind", F.lit("archive"))
    return rounded(drawn.unionByName(held).select("kind", "matrix_id", "row", F.col("x")[3].alias("v")), "v")


SAMPLES = "samples AS (SELECT 'gram' AS dataset_id, vec_id AS sample_id, label::BIGINT AS matrix_id, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS row_kind FROM embeddings)"


def _samples(spark, d):
    """Vectors as samples of one dataset, every fourth one internal."""
    kind = F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0).cast("tinyint")
    return embeddings(spark, d).select(F.lit("gram").alias("dataset_id"), F.col("vec_id").alias("sample_id"), "matrix_id", kind.alias("row_kind"), F.col("x").alias("rhs"), F.col("x").alias("solution"))


@query("a10_b1_dataset_round_trip", f"WITH {SAMPLES} SELECT dataset_id, sample_id, matrix_id, row_kind FROM samples")
def a10(spark, d):
    """A dataset written with its matrices and read back."""
    path = _scratch(spark)
    sinks.guard_overwrite(spark, path, ["dataset_id"])
    sinks.write_dataset(_samples(spark, d), flow(spark, d), path)
    return files.read_dataset(spark, path)[0].select("dataset_id", "sample_id", "matrix_id", F.col("row_kind").cast("int").alias("row_kind"))


@query("a11_matrix_ids_and_counts", "SELECT label::BIGINT AS matrix_id, (SELECT count(*) FROM embeddings) AS n_samples FROM embeddings GROUP BY 1")
def a11(spark, d):
    s = _samples(spark, d)
    ids = files.list_matrix_ids(s).withColumn("dataset_id", F.lit("gram"))
    return ids.join(files.sample_count(s), "dataset_id").select("matrix_id", "n_samples")


@query("a12_dense_to_coo", f"WITH {E} SELECT vec_id AS matrix_id, i // 8 AS i, i % 8 AS j, {r6('v')} AS v FROM e WHERE v <> 0")
def a12(spark, d):
    square = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("x", k * 8 + 1, 8))
    return rounded(files.dense_to_coo(embeddings(spark, d).select(F.col("vec_id").alias("matrix_id"), square.alias("rows"))), "v")


@query("a13_attach_extras", f"WITH {E} SELECT vec_id AS sample_id, {r6('max(CASE WHEN i = 0 AND vec_id % 2 = 0 THEN v END)')} AS even, {r6('max(CASE WHEN i = 1 AND vec_id % 3 = 0 THEN v END)')} AS third FROM e GROUP BY 1")
def a13(spark, d):
    e = embeddings(spark, d)
    part = lambda n, k, i: e.filter(F.col("vec_id") % k == 0).select(F.col("vec_id").alias("sample_id"), F.lit(n).alias("name"), F.col("x")[i].alias("x"))
    extras = part("even", 2, 0).unionByName(part("third", 3, 1)).unionByName(part("unused", 5, 2))
    return rounded(files.attach_extras(e.select(F.col("vec_id").alias("sample_id")), extras, ["even", "third"]), "even", "third")


@query("a14_select_rhs", f"WITH {ARCHIVE} SELECT CAST(matrix_id AS VARCHAR) AS source, 'first' AS kind, row AS sample_id, {r6('sum(v)')} AS total FROM av WHERE row = 0 GROUP BY 1, 2, 3 UNION ALL SELECT CAST(matrix_id AS VARCHAR), 'third', row, {r6('sum(v)')} FROM av WHERE row = 3 GROUP BY 1, 2, 3")
def a14(spark, d):
    v = archive(spark, d).select(F.col("matrix_id").cast("string").alias("source"), F.col("row").alias("sample_id"), "x")
    both = files.select_rhs(v).withColumn("kind", F.lit("first")).unionByName(files.select_rhs(v, 3).withColumn("kind", F.lit("third")))
    return rounded(both.select("source", "kind", "sample_id", F.aggregate("x", F.lit(0.0), lambda s, x: s + x).alias("total")), "total")


@query("a15_load_systems", f"WITH {E} SELECT vec_id, matrix_id, 64 AS n FROM e GROUP BY 1, 2")
def a15(spark, d):
    return files.load_systems(gram(spark, d), embeddings(spark, d).select("matrix_id", "x")).groupBy("matrix_id", "n").count().join(embeddings(spark, d).select("vec_id", "matrix_id"), "matrix_id").select("vec_id", "matrix_id", "n")


@query("b2_build_manifest", f"WITH {SAMPLES} SELECT dataset_id, count(*) AS n_samples, count(DISTINCT matrix_id) AS n_matrices, 64 AS dimension, count(*) FILTER (WHERE row_kind = 0) AS n_standard, 'many_matrices' AS layout FROM samples GROUP BY 1")
def b2(spark, d):
    return sinks.build_manifest(_samples(spark, d), flow(spark, d))


@query("b3_resolve_dataset_scale", "SELECT round(min_by(o_totalprice, o_orderkey), 6) + 0.0 AS matrix_norm, 1.0::DOUBLE AS matrix_scale, false AS shared, 'different' AS kind FROM orders UNION ALL SELECT round(min_by(o_totalprice, o_orderkey), 6) + 0.0, 3.5::DOUBLE, true, 'same' FROM orders")
def b3(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("matrix_id"), F.col("o_totalprice").alias("norm"), F.col("o_totalprice").alias("scale"))
    one = sinks.resolve_dataset_scale(t).withColumn("kind", F.lit("different"))
    return rounded(one.unionByName(sinks.resolve_dataset_scale(t.withColumn("scale", F.lit(3.5))).withColumn("kind", F.lit("same"))), "matrix_norm", "matrix_scale")


@query("b5_prediction_rows", f"WITH {E}, mean AS (SELECT matrix_id, i, avg(v) AS m FROM e GROUP BY 1, 2), f AS (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 20) SELECT e.vec_id AS sample_id, e.i, {r6('v')} AS y_true, {r6('m')} AS y_pred, {r6('v - m')} AS error FROM e JOIN mean ON e.matrix_id = mean.matrix_id AND e.i = mean.i JOIN f ON f.vec_id = e.vec_id")
def b5(spark, d):
    return rounded(sinks.prediction_rows(predictions(spark, d), 20), "y_true", "y_pred", "error")


@query("b6_b8_save_and_read", f"WITH {E} SELECT vec_id AS sample_id, {r6('sum(v)')} AS total FROM e GROUP BY 1")
def b6(spark, d):
    """Predictions saved as Parquet and read back."""
    path = _scratch(spark)
    sinks.save_predictions(predictions(spark, d), path)
    return rounded(spark.read.parquet(path).select("sample_id", F.aggregate("y_true", F.lit(0.0), lambda s, x: s + x).alias("total")), "total")


@query("c1_bind_systems", "SELECT p_partkey AS sample_id, p_partkey AS matrix_id, p_partkey AS rhs_id, 'many' AS kind FROM part UNION ALL SELECT s_suppkey, 7, s_suppkey, 'one' FROM supplier")
def c1(spark, d):
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    many = binding.bind_systems(ids, ids).withColumn("kind", F.lit("many"))
    one = binding.bind_systems(spark.range(7, 8), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))).withColumn("kind", F.lit("one"))
    return many.unionByName(one).select("sample_id", "matrix_id", "rhs_id", "kind")


@query("c1_binding_mismatches", "SELECT o_orderkey AS id, 'missing' AS side FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'extra' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")
def c1b(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return binding.binding_mismatches(ids.filter("id % 2 = 0"), ids.filter("id % 3 = 0"))


@query("c2_attach_params", "WITH p AS (SELECT year(o_orderdate) AS y, count(*)::DOUBLE AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_orderkey AS sample_id, year(o_orderdate)::BIGINT AS matrix_id, n AS first, round(s, 2) + 0.0 AS second FROM orders JOIN p ON y = year(o_orderdate)")
def c2(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.year("o_orderdate").cast("long").alias("matrix_id"))
    return binding.attach_params(s, params(spark, d)).select("sample_id", "matrix_id", F.col("params")[0].alias("first"), (F.round(F.col("params")[1], 2) + F.lit(0.0)).alias("second"))


@query("c3_canonical_triplet", f"WITH {FLOW}, s AS (SELECT o_orderkey AS sample_id, year(o_orderdate)::BIGINT AS matrix_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k, o_orderpriority AS dataset_id FROM orders WHERE o_orderkey % 4 <> 0) SELECT dataset_id, sample_id, matrix_id, i, j, {r6('v')} AS v FROM s JOIN flow USING (matrix_id) WHERE k = 1")
def c3(spark, d):
    kind = F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0).cast("tinyint")
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderkey").alias("sample_id"), F.year("o_orderdate").cast("long").alias("matrix_id"), kind.alias("row_kind"))
    return rounded(binding.canonical_triplet(s, flow(spark, d)).drop("row_kind"), "v")


@query("c4_standard_rows", f"WITH {SAMPLES} SELECT sample_id FROM samples WHERE row_kind = 0")
def c4(spark, d):
    return binding.standard_rows(_samples(spark, d)).select("sample_id")


@query("c5_comparison_grid", "SELECT o_orderkey AS system_id, p AS preconditioner FROM orders, (VALUES ('identity'), ('jacobi'), ('pod')) t(p)")
def c5(spark, d):
    names = spark.createDataFrame([("jacobi",), ("pod",)], "preconditioner string")
    return binding.comparison_grid(table(spark, d, "orders").select(F.col("o_orderkey").alias("system_id")), names)


@query("c6_closest_match", "WITH b AS (SELECT o_orderkey AS id, o_totalprice AS d FROM orders), a AS (SELECT c_custkey AS id, c_acctbal * 30 AS d FROM customer), below AS (SELECT a.id, a.d, max(b.d) AS bd FROM a JOIN b ON b.d <= a.d GROUP BY 1, 2), above AS (SELECT a.id, a.d, min(b.d) AS bd FROM a JOIN b ON b.d >= a.d GROUP BY 1, 2), pick AS (SELECT a.id, a.d, CASE WHEN below.bd IS NULL OR above.bd - a.d < a.d - below.bd THEN above.bd ELSE below.bd END AS bd FROM a LEFT JOIN below USING (id) LEFT JOIN above USING (id)) SELECT pick.id, round(pick.d, 6) + 0.0 AS d, min(b.id) AS b_id, round(abs(pick.bd - pick.d), 6) + 0.0 AS distance FROM pick JOIN b ON b.d = pick.bd GROUP BY 1, 2, 4")
def c6(spark, d):
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("d"))
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 30).alias("d"))
    return rounded(binding.closest_match(a, b), "d", "distance")


@query("c7_split_members", "SELECT vec_id AS sample_id, label::BIGINT AS run_id FROM embeddings WHERE vec_id % 10 = 0")
def c7(spark, d):
    s = embeddings(spark, d).select(F.col("vec_id").alias("sample_id"), F.col("matrix_id").alias("run_id"))
    split = F.when(F.col("sample_id") % 10 == 0, "test").when(F.col("sample_id") % 10 == 1, "validation").otherwise("train")
    return binding.split_members(s, s.withColumn("split", split), "test")


@query("c8_rhs_sources", f"WITH {FLOW}, ids AS (SELECT DISTINCT matrix_id, i FROM flow), {ARCHIVE} SELECT 'gaussian' AS kind, matrix_id, i, {r6(normal_sql('3', 'i') + ' * 0.5 + 1.0')} AS v FROM ids UNION ALL SELECT 'sparse', matrix_id, i, CASE i WHEN 2 THEN 1.5 WHEN 24 THEN -2.0 ELSE 0.0 END FROM ids UNION ALL SELECT 'raw_rhs', matrix_id, i, {r6('v * 2.0')} FROM av WHERE row = 0 UNION ALL SELECT 'raw_lhs', f.matrix_id, f.i, {r6('sum(f.v) * 3.0')} FROM flow f GROUP BY 2, 3")
def c8(spark, d):
    a = flow(spark, d)
    meta = algebra.sizes(a)
    entries = spark.createDataFrame([(2, 1.5), (-1, -2.0)], "i int, v double")
    ones = meta.select(F.col("matrix_id").alias("system_id"), "matrix_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), F.lit(1.0).alias("v"))
    first = archive_rows(spark, d).filter(F.col("system_id") == F.col("matrix_id") * (1 << 24))
    parts = {"gaussian": binding.gaussian_rhs(meta, 3, 1.0, 0.5), "sparse": binding.sparse_rhs(meta, entries), "raw_rhs": binding.raw_rhs(first, 2.0), "raw_lhs": binding.lhs_rhs(a, ones, 3.0)}
    out = None
    for kind, part in parts.items():
        part = part.select(F.lit(kind).alias("kind"), "matrix_id", "i", "v")
        out = part if out is None else out.unionByName(part)
    return rounded(out, "v")


@models.register_source("alternating")
def _alternating(context):
    """A source of the caller's own: 1 and -1 in turn, times ``height``."""
    places = context["meta"].select("matrix_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return places.withColumn("v", F.when(F.col("i") % 2 == 0, context["height"]).otherwise(-context["height"]))


@query("m4_source_dispatch", f"WITH {FLOW}, ids AS (SELECT DISTINCT matrix_id, i FROM flow), {ARCHIVE} SELECT 'gaussian' AS kind, matrix_id, i, {r6(normal_sql('3', 'i') + ' * 0.5 + 1.0')} AS v FROM ids UNION ALL SELECT 'alternating', matrix_id, i, CASE WHEN i % 2 = 0 THEN 2.5 ELSE -2.5 END FROM ids UNION ALL SELECT 'raw_lhs', f.matrix_id, f.i, {r6('sum(f.v) * 3.0')} FROM flow f GROUP BY 2, 3 UNION ALL SELECT 'dataset', matrix_id, i, {r6('v')} FROM av WHERE row = 0")
def m4(spark, d):
    """Right-hand sides by the names of their sources, a registered one among them."""
    a = flow(spark, d)
    meta = algebra.sizes(a)
    ones = meta.select(F.col("matrix_id").alias("system_id"), "matrix_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), F.lit(1.0).alias("v"))
    first = archive_rows(spark, d).filter(F.col("system_id") == F.col("matrix_id") * (1 << 24))
    context = {"matrices": a, "meta": meta, "solutions": ones, "rhs": first, "seed": 3, "mu": 1.0, "sigma": 0.5, "scale": 3.0, "height": 2.5}
    out = None
    for kind in ("gaussian", "alternating", "raw_lhs", "dataset"):
        part = binding.resolve_rhs(kind, context).select(F.lit(kind).alias("kind"), "matrix_id", "i", "v")
        out = part if out is None else out.unionByName(part)
    return rounded(out, "v")


@models.register_source("doubled", models.NORMALIZATIONS)
def _doubled(systems):
    """A mode of the caller's own: twice the matrix's scale on both sides."""
    return systems.withColumns({"a_by": F.col("scale") * 2, "b_by": F.col("scale") * 2})


@query("m4_mode_dispatch", "SELECT o_orderkey, mode, (CASE WHEN mode = 'doubled' THEN 8.0 WHEN mode = 'matrix' THEN 4.0 ELSE 1.0 END)::DOUBLE AS a_by, (CASE WHEN mode = 'doubled' THEN 8.0 WHEN mode = 'matrix' THEN 4.0 ELSE 1.0 END)::DOUBLE AS b_by FROM orders, (VALUES ('none'), ('matrix'), ('doubled')) m(mode)")
def m4_mode(spark, d):
    """Divisors by the names of normalisation modes, a registered one among them."""
    t = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("rhs_norm"), F.lit(4.0).alias("scale"), F.lit("raw_lhs").alias("rhs_kind"), F.lit(False).alias("normalized"))
    t = t.withColumn("mode", F.explode(F.array(*map(F.lit, ["none", "matrix", "doubled"]))))
    return rounded(scaling.system_scales(t).select("o_orderkey", "mode", "a_by", "b_by"), "a_by", "b_by")


@query("c9_pick_matrix", "SELECT arg_min(o_orderkey, md5('42|' || o_orderkey)) AS matrix_id FROM orders")
def c9(spark, d):
    return binding.pick_matrix(table(spark, d, "orders").select(F.col("o_orderkey").alias("matrix_id")))


@query("c10_derive_rhs", f"WITH {E}, f AS (SELECT matrix_id, min(vec_id) AS vec_id FROM e GROUP BY 1), x AS (SELECT e.* FROM e JOIN f USING (matrix_id, vec_id)), dots AS (SELECT y.matrix_id, y.vec_id, sum(y.v * x.v) AS c FROM e y JOIN x ON x.matrix_id = y.matrix_id AND x.i = y.i GROUP BY 1, 2), b AS (SELECT y.matrix_id, y.i, sum(y.v * c) AS v FROM e y JOIN dots ON dots.vec_id = y.vec_id GROUP BY 1, 2) SELECT b.matrix_id, b.i, {r6('b.v + x.v')} AS v FROM b JOIN x ON x.matrix_id = b.matrix_id AND x.i = b.i")
def c10(spark, d):
    arc = archive(spark, d).select("matrix_id", F.col("vec_id").alias("name"), "x")
    return rounded(binding.derive_rhs(gram(spark, d), arc).select("matrix_id", F.posexplode("x").alias("i", "v")), "v")


_WEIGHTS = "w AS (SELECT o_orderpriority AS strategy, count(*)::DOUBLE AS weight FROM orders GROUP BY 1)"


@query("d1_mix_counts", f"WITH {_WEIGHTS}, x AS (SELECT strategy, weight, weight / sum(weight) OVER () * 1001 AS e FROM w), y AS (SELECT strategy, floor(e) AS f, row_number() OVER (ORDER BY e - floor(e) DESC, weight DESC, strategy) AS k, 1001 - sum(floor(e)) OVER () AS rest FROM x) SELECT strategy, (f + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS samples FROM y")
def d1(spark, d):
    w = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return budgets.mix_counts(w, 1001)


@query("d2_merge_budgets", "WITH s AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'rhs_archive' WHEN 1 THEN 'solution_archive' WHEN 2 THEN 'uniform_forward' ELSE 'krylov' END AS strategy, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 40 = 1 THEN -1 ELSE o_custkey % 7 END AS samples FROM orders) SELECT strategy, CASE WHEN min(samples) = -1 THEN -1 ELSE sum(greatest(samples, 0)) END::BIGINT AS samples FROM s GROUP BY 1")
def d2(spark, d):
    key = F.col("o_orderkey")
    name = F.when(key % 4 == 0, "RHS-bank").when(key % 4 == 1, "solution_repository").when(key % 4 == 2, " Uniform-Forward ").otherwise("krylov")
    n = F.when((key % 4 == 1) & (key % 40 == 1), F.lit(-1)).otherwise(F.col("o_custkey") % 7)
    return budgets.merge_budgets(table(spark, d, "orders").select(name.alias("strategy"), n.alias("samples")))


_BINDINGS = "b AS (SELECT p_partkey AS binding, row_number() OVER (ORDER BY p_partkey) - 1 AS k, count(*) OVER () AS m FROM part)"


@query("d3_allocate_rows", f"WITH {_BINDINGS} SELECT binding, (10007 // m + CASE WHEN k < 10007 % m THEN 1 ELSE 0 END)::BIGINT AS rows FROM b")
def d3(spark, d):
    return budgets.allocate_rows(table(spark, d, "part").select(F.col("p_partkey").alias("binding")), 10007)


@query("d3_allocate_with_replacement", f"WITH {_BINDINGS}, dr AS (SELECT floor((('0x' || substr(md5('42|' || id), 1, 12))::BIGINT / 281474976710656.0) * (SELECT count(*) FROM part)) AS k, count(*) AS n FROM (SELECT unnest(range(5000)) AS id) GROUP BY 1) SELECT binding, coalesce(n, 0)::BIGINT AS rows FROM b LEFT JOIN dr USING (k)")
def d3b(spark, d):
    return budgets.allocate_rows(table(spark, d, "part").select(F.col("p_partkey").alias("binding")), 5000, True)


@query("d4_archive_offsets", "SELECT p_partkey AS binding, p_size::BIGINT AS rows, coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS skip FROM part")
def d4(spark, d):
    return budgets.archive_offsets(table(spark, d, "part").select(F.col("p_partkey").alias("binding"), F.col("p_size").cast("long").alias("rows")))


@query("d5_trace_budget", "SELECT o_orderkey AS strategy, o_custkey AS samples, 5::BIGINT AS rows_per_system, ceil(o_custkey / 5.0)::BIGINT AS systems FROM orders")
def d5(spark, d):
    return budgets.trace_budget(table(spark, d, "orders").select(F.col("o_orderkey").alias("strategy"), F.col("o_custkey").alias("samples")), 8, 2)


@query("d6_trim_rows", "SELECT l_orderkey AS system_id, l_linenumber::BIGINT AS iter FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 1234")
def d6(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("system_id"), F.col("l_linenumber").cast("long").alias("iter"))
    return budgets.trim_rows(t, 1234)


@query("d7_every_nth", "SELECT l_orderkey AS system_id, l_linenumber::BIGINT AS iter FROM lineitem WHERE l_linenumber % 3 = 0")
def d7(spark, d):
    return budgets.every_nth(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("system_id"), F.col("l_linenumber").cast("long").alias("iter")), 3)


@query("d8_mix_union", "SELECT p_partkey AS sample_id, 'part' AS strategy FROM part UNION ALL SELECT s_suppkey + (SELECT max(p_partkey) + 1 FROM part), 'supplier' FROM supplier UNION ALL SELECT c_custkey + (SELECT max(p_partkey) + 1 FROM part) + (SELECT max(s_suppkey) + 1 FROM supplier), 'customer' FROM customer")
def d8(spark, d):
    block = lambda t, c: table(spark, d, t).select(F.col(c).alias("sample_id"), F.lit(t).alias("strategy"))
    return budgets.mix_union([block("part", "p_partkey"), block("supplier", "s_suppkey"), block("customer", "c_custkey")])


@query("d9_shuffle_within", "SELECT o_orderkey AS sample_id, o_custkey AS matrix_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1)::INT AS position FROM orders")
def d9(spark, d):
    return budgets.shuffle_within(table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("matrix_id")))


_KIND = "CASE WHEN o_orderkey % 3 = 0 THEN 'residuals' WHEN o_orderkey % 3 = 1 THEN 'search_directions' ELSE 'random' END"


@query("d10_tag_row_kind", f"SELECT o_orderkey AS sample_id, CASE WHEN o_custkey % 5 = 0 THEN 0 WHEN {_KIND} <> 'random' THEN 1 ELSE 0 END AS row_kind FROM orders")
def d10(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.expr(_KIND).alias("strategy"), (F.col("o_custkey") % 5).alias("iter"))
    return budgets.tag_row_kind(s).select("sample_id", F.col("row_kind").cast("int").alias("row_kind"))


@query("d11_check_alignment", "SELECT vec_id AS sample_id FROM embeddings WHERE vec_id % 6 = 0")
def d11(spark, d):
    s = _samples(spark, d).withColumn("solution", F.when(F.col("sample_id") % 6 == 0, F.slice("solution", 1, 63)).otherwise(F.col("solution")))
    return budgets.check_alignment(s).select("sample_id")


@query("d12_check_mixable", "SELECT n_name AS strategy, 'mixes one-matrix and many-matrix strategies' AS problem FROM nation WHERE n_nationkey > 0 UNION ALL SELECT 'random', 'mixes one-matrix and many-matrix strategies'")
def d12(spark, d):
    """Nations as unknown, so one-matrix, strategies; one of them is replaced by a strategy for many."""
    name = F.when(F.col("n_nationkey") == 0, "random").otherwise(F.col("n_name"))
    return budgets.check_mixable(table(spark, d, "nation").select(name.alias("strategy"), F.lit(5).alias("samples")), 3).select("strategy", "problem")
