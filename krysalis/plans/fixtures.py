"""Linear systems, archives, runs and predictions derived from the driver's tables, and the same in SQL.

The SQL parts are common table expressions for DuckDB; the functions are their
DataFrame forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from krysalis.functions.lineage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """A decorator that registers a query and the SQL that checks it."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


E = "e AS (SELECT vec_id, label::BIGINT AS matrix_id, (unnest(range(len(embedding))))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
GRAM = E + ", gram AS MATERIALIZED (SELECT x.matrix_id, x.i, y.i AS j, sum(x.v * y.v) + CASE WHEN x.i = y.i THEN 1.0 ELSE 0.0 END AS v FROM e x JOIN e y ON x.vec_id = y.vec_id GROUP BY x.matrix_id, x.i, y.i)"
ARCHIVE = "arc AS MATERIALIZED (SELECT label::BIGINT AS matrix_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, embedding FROM embeddings), av AS MATERIALIZED (SELECT matrix_id, row, matrix_id * 16777216 + row AS system_id, (unnest(range(len(embedding))))::INT AS i, unnest(embedding)::DOUBLE AS v FROM arc)"
FLOW = """pairs AS (SELECT year(o_orderdate) AS y, c_nationkey AS a, s_nationkey AS b, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3),
w AS (SELECT y, a, b, sum(w)::DOUBLE AS w FROM (SELECT y, a, b, w FROM pairs UNION ALL SELECT y, b, a, w FROM pairs) GROUP BY 1, 2, 3),
yrs AS (SELECT DISTINCT y FROM pairs), deg AS (SELECT y, a, sum(w) AS d FROM w GROUP BY 1, 2),
flow AS MATERIALIZED (SELECT y::BIGINT AS matrix_id, a::INT AS i, b::INT AS j, -w AS v FROM w
  UNION ALL SELECT yrs.y::BIGINT, n_nationkey, n_nationkey, 1.0 + coalesce(d, 0) FROM yrs CROSS JOIN nation LEFT JOIN deg ON deg.y = yrs.y AND deg.a = n_nationkey)"""
RUNS = "runs AS (SELECT event_id AS run_id, 'train' AS experiment, user_id AS assignment_id, CASE event_type WHEN 'purchase' THEN 'FINISHED' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status, ts AS start_time, value FROM events), arts AS (SELECT run_id FROM runs WHERE run_id % 2 = 0)"
PRED = E + ", mean AS (SELECT matrix_id, i, avg(v) AS m FROM e GROUP BY 1, 2), pred AS (SELECT vec_id AS sample_id, e.i, e.v AS y_true, m AS y_pred, e.v - m AS residual FROM e JOIN mean ON e.matrix_id = mean.matrix_id AND e.i = mean.i)"
PARTS = "files AS (SELECT 'm_' || p_partkey || '_Kaa.txt' AS path, p_partkey FROM part)"


def r6(expression: str) -> str:
    """SQL: a value rounded for comparison, without negative zero."""
    return f"(round({expression}, 6) + 0.0)"


def uniform_sql(*parts: str) -> str:
    """SQL of ``rng.uniform``."""
    return "(('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 12))::BIGINT / 281474976710656.0)"


def normal_sql(*parts: str) -> str:
    """SQL of ``rng.normal``."""
    return f"(sqrt(-2.0 * ln(1.0 - {uniform_sql(*parts, chr(39) + 'a' + chr(39))})) * cos(2.0 * pi() * {uniform_sql(*parts, chr(39) + 'b' + chr(39))}))"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, matrix_id, x array<double>)``."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("matrix_id"), F.col("embedding").cast("array<double>").alias("x"))


def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense symmetric positive definite matrices: the sum of x xᵀ over a label's vectors, plus the identity."""
    from krysalis.operators.algebra import gram as product

    return product(embeddings(spark, sf_dir), "matrix_id").withColumn("v", F.col("v") + (F.col("i") == F.col("j")).cast("double"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(matrix_id, row, x)``: a label's vectors, numbered."""
    order = Window.partitionBy("matrix_id").orderBy("vec_id")
    return embeddings(spark, sf_dir).select("matrix_id", (F.row_number().over(order) - 1).cast("long").alias("row"), "vec_id", "x")


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive as component rows ``(system_id, matrix_id, i, v)``."""
    return archive(spark, sf_dir).select((F.col("matrix_id") * (1 << 24) + F.col("row")).alias("system_id"), "matrix_id", F.posexplode("x").alias("i", "v"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse graph Laplacians plus identity: line items between nations, a matrix for each year of order.

    Written once: a matrix has at most 25 x 25 entries, and what reads it many
    times does not join the line items anew each time. Nations are joined to
    orders and to line items first, so that these meet once, by order.
    """
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    items = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    items = items.select("l_orderkey", "s_nationkey").join(orders.select("o_orderkey", "y", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = items.filter("c_nationkey <> s_nationkey").groupBy("y", F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).count()
    both = materialize(pairs).withColumn("e", F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))))
    w = both.groupBy(F.col("y").cast("long").alias("matrix_id"), "e.i", "e.j").agg(F.sum("count").cast("double").alias("w"))
    degree = w.groupBy("matrix_id", "i").agg(F.sum("w").alias("d"))
    places = w.select("matrix_id").distinct().join(F.broadcast(t("nation").select(F.col("n_nationkey").alias("i"))), how="cross")  # the 25 nations
    diagonal = places.join(degree, ["matrix_id", "i"], "left").select("matrix_id", "i", F.col("i").alias("j"), (F.coalesce("d", F.lit(0.0)) + 1.0).alias("v"))
    return materialize(w.select("matrix_id", "i", "j", (-F.col("w")).alias("v")).unionByName(diagonal))


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(matrix_id, x)``: number and total price of a year's orders."""
    by = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("matrix_id"))
    return by.agg(F.array(F.count(F.lit(1)).cast("double"), F.sum("o_totalprice")).alias("x"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run catalogue: events as runs, users as assignments."""
    status = F.when(F.col("event_type") == "purchase", "FINISHED").when(F.col("event_type") == "error", "FAILED").otherwise("RUNNING")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.lit("train").alias("experiment"), F.col("user_id").alias("assignment_id"), status.alias("status"), F.col("ts").alias("start_time"), "value")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of even id have an artifact."""
    return runs(spark, sf_dir).filter("run_id % 2 = 0").select("run_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, y_true, y_pred)``: each vector and the mean of its label."""
    e = embeddings(spark, sf_dir)
    mean = e.select("matrix_id", F.posexplode("x").alias("i", "v")).groupBy("matrix_id", "i").agg(F.avg("v").alias("m"))
    packed = mean.groupBy("matrix_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("y_pred"))
    return e.join(packed, "matrix_id").select(F.col("vec_id").alias("sample_id"), F.col("x").alias("y_true"), "y_pred")


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of matrix files named after parts."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("m_"), F.col("p_partkey").cast("string"), F.lit("_Kaa.txt")).alias("path"), "p_partkey")


def budgets(matrices: DataFrame, rows: int) -> DataFrame:
    """The same budget for every matrix."""
    return matrices.select("matrix_id").distinct().withColumn("rows", F.lit(rows).cast("long"))


def flow_vectors(matrices: DataFrame, rows: int) -> DataFrame:
    """``(system_id, matrix_id, i, v)``: ``rows`` normal vectors for each matrix."""
    from krysalis.functions.rng import normal
    from krysalis.operators.strategies import random_vectors

    return random_vectors(matrices, budgets(matrices, rows), lambda r, i: normal(42, r, i))


#: The same vectors in SQL, for up to 8 rows of the flow matrices.
def flow_vectors_sql(rows: int) -> str:
    return FLOW + f", x AS MATERIALIZED (SELECT m * 16777216 + row AS system_id, m AS matrix_id, row, i, {normal_sql('42', 'row', 'i')} AS v FROM (SELECT DISTINCT matrix_id AS m FROM flow), (SELECT unnest(range({rows})) AS row), (SELECT n_nationkey AS i FROM nation))"
