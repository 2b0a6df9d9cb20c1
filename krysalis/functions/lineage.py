"""Tables written to the folder that all executors share, to cut a plan short."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests), a temporary folder is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-krysalis-"))
        folder = context.getCheckpointDir()
    return folder


def materialize(df: DataFrame, plain: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the table goes when the driver ends.

    ``plain``: for numbers that do not compress, without trying to.

    Later stages then re-read files if an executor is lost, and the plan of a
    loop stays one step long.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/krysalis-{uuid.uuid4().hex}"
    options = {"compression": "uncompressed", "parquet.enable.dictionary": "false"} if plain else {"compression": "zstd"}
    df.write.options(**options).parquet(path)
    atexit.register(remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def once(df: DataFrame) -> DataFrame:
    """The table, written if it is a plan still: what reads it several times does not compute it anew."""
    return df if "scratch_path" in df.__dict__ else materialize(df)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and nothing will read again."""
    for table in tables:
        path = getattr(table, "__dict__", {}).get("scratch_path")
        if path:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, at exit, if the gateway still answers."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  scratch space only
        pass
