"""What the operators share: the separating white space, texts without null, tables that cut lineage."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from krysalis.functions.lineage import materialize, remove, shared_folder

__all__ = ["SPACE", "bucketed", "drop_shuffles", "materialize", "remove", "shared_folder", "text_of"]

#: The ASCII white space that separates words everywhere in this package.
SPACE = r"[\x20\x09-\x0D]"


def text_of(column: str) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def bucketed(df: DataFrame, column: str, files: int, compression: str = "uncompressed", row_group: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``column``; it leaves the catalogue when the driver ends.

    What is dealt out by ``repartition(files, column)`` joins it without moving the table.
    ``row_group``: bytes that a task gathers before it writes, for few and very large rows.
    """
    spark = df.sparkSession
    name = f"krysalis_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    sized = {} if row_group is None else {"parquet.block.size": row_group, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8}
    df.write.options(path=path, compression=compression, **sized).bucketBy(files, column).saveAsTable(name)
    atexit.register(_forget, spark, name, path)
    table = spark.table(name)
    table.scratch_path = path
    return table


def drop_shuffles(spark) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does so when the driver's plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def _forget(spark, name: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session may have ended
        pass
    remove(spark, path)
