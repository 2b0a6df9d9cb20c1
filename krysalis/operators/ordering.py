"""Places and running sums over all rows of a table, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from krysalis.functions.lineage import materialize

_PLACE = (1 << 33) - 1


def _placed(df: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows in ranges of the order, with ``__part`` and ``__place``, and the parts' earlier rows.

    The ranges come from a sample, so they are written once and read by both.
    """
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)
    placed = materialize(ranged.withColumns({"__part": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit(_PLACE))}).drop("__at"))
    return placed, placed.groupBy("__part")


def _before(parts: DataFrame, value: str) -> DataFrame:
    """Sums of the parts before each; as many rows as there are partitions."""
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("__part", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """The rows with their place from 0 in the order; order by columns that tell rows apart."""
    placed, parts = _placed(df, order)
    before = _before(parts.agg(F.count(F.lit(1)).alias("__n")), "__n")
    return placed.join(before, "__part").select(*df.columns, (F.col("__before") + F.col("__place")).alias(name))


def running_before(df: DataFrame, value: str, *order: str, name: str = "before") -> DataFrame:
    """The rows with the sum of ``value`` over all earlier ones: sums by range, then places inside a range."""
    placed, parts = _placed(df, order)
    before = _before(parts.agg(F.sum(value).alias("__n")), "__n")
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(before, "__part").select(*df.columns, (F.col("__before") + F.col("__own")).cast("long").alias(name))
