"""Readers of matrices and vectors, their ids, and selections of archives."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from krysalis.functions.rng import normal, rank_key
from krysalis.operators.ordering import numbered

ID_PATTERN = r"(\d+)(?!.*\d)"


def file_stem(path: str = "path") -> Column:
    """A file's name without folders and ending."""
    return F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[^.]*$", "")


def assign_ids_by_regex(files: DataFrame, pattern: str = ID_PATTERN) -> DataFrame:
    """Files with ``id``, the last whole number of the stem (null if none)."""
    found = F.regexp_extract(file_stem(), pattern, 1)
    return files.withColumn("id", F.when(found != "", found.cast("long")))


def duplicate_ids(files: DataFrame) -> DataFrame:
    """``(id, n)`` of the ids that several files have; a sound listing has none."""
    return files.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assign_ids_by_order(files: DataFrame, by: str = "name") -> DataFrame:
    """Files with ``id`` from 0 in order of name or modification time."""
    if by not in ("name", "mtime"):
        raise ValueError("by name or mtime")
    return numbered(files, *(["path"] if by == "name" else ["modificationTime", "path"]), name="id")


def filter_ids(df: DataFrame, include: list[int] | None = None, exclude: list[int] | tuple = (), key: str = "id") -> DataFrame:
    """Rows of the ids to include, or without those to exclude; not both. The lists are the caller's own; an id that no row has is an error."""
    if include is not None and exclude:
        raise ValueError("include or exclude, not both")
    wanted = list(exclude if include is None else include)
    missing = sorted(r[0] for r in unknown_ids(df, wanted, key).collect()) if wanted else []  # of the caller's list
    if missing:
        raise ValueError(f"unknown ids: {missing}")
    if include is not None:
        return df.filter(F.col(key).isin(list(include)))
    return df.filter(~F.col(key).isin(list(exclude))) if exclude else df


def unknown_ids(df: DataFrame, wanted: list[int], key: str = "id") -> DataFrame:
    """The ids asked for that the table does not have."""
    ids = df.sparkSession.createDataFrame([(i,) for i in wanted], f"{key} long")
    return ids.join(df.select(key).distinct(), key, "left_anti")


def select_archive(files: DataFrame, count: int = -1, shuffle: bool = False, seed: int = 42, skip: int = 0) -> DataFrame:
    """Files ``skip`` to ``skip + count`` by name, or in a repeatable random order, with ``row`` from 0; -1 takes the rest, fewer than ``count`` are an error."""
    ordered = files.withColumn("__key", rank_key(seed, F.col("path")) if shuffle else F.col("path"))
    ranged = assign_ids_by_order(ordered.select(F.concat_ws("|", "__key", "path").alias("path"), F.col("path").alias("__path"), *(c for c in files.columns if c != "path")))
    kept = ranged.filter((F.col("id") >= skip) & ((F.lit(count) < 0) | (F.col("id") < skip + count)))
    return require_supply(kept.select(F.col("__path").alias("path"), *(c for c in files.columns if c != "path"), (F.col("id") - skip).alias("row")), count)


def require_supply(selected: DataFrame, count: int) -> DataFrame:
    """The selection, an error if it has fewer than ``count`` rows."""
    found = selected.agg(F.count(F.lit(1)).alias("n")).first()["n"] if count > 0 else 0
    if found < count:
        raise ValueError(f"{count} files are needed, {found} are there")
    return selected


def load_archive_pairs(solutions: DataFrame, rhs: DataFrame) -> DataFrame:
    """Solutions and right-hand sides ``(row, x)`` of the same place: ``(row, x, b)``; a place that one lacks is an error."""
    both = solutions.select("row", "x").join(rhs.select("row", F.col("x").alias("b")), "row", "full_outer")
    whole = F.col("x").isNotNull() & F.col("b").isNotNull()
    return both.withColumn("row", F.when(whole, F.col("row")).otherwise(F.raise_error(F.lit("archives of different length")).cast("long")))


def archive_or_random(archive: DataFrame | None, meta: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``(matrix_id, row, x)``: the first ``count`` archived vectors, or normal draws for ``meta(matrix_id, n)``."""
    if archive is not None:
        return archive.filter(F.col("row") < count).select("matrix_id", "row", "x")
    rows = meta.select("matrix_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("row"))
    return rows.select("matrix_id", "row", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: normal(seed, F.col("row"), i)).alias("x"))


def read_matrix_text(spark: SparkSession, glob: str) -> DataFrame:
    """``(path, i, j, v)`` of text matrices, a file each, zeros left out; numbers are divided by blanks or commas."""
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = files.select("path", F.posexplode(lines).alias("i", "line"))
    cells = rows.select("path", "i", F.posexplode(F.split(F.trim("line"), r"[\s,]+")).alias("j", "v"))
    return cells.select("path", "i", "j", F.col("v").cast("double").alias("v")).filter("v <> 0")


def read_matrix_npy(spark: SparkSession, glob: str) -> DataFrame:
    """``(path, sample, i, j, v)`` of ``.npy`` files with one matrix or a stack of them, zeros left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float64)
                if a.ndim not in (2, 3):
                    raise ValueError(f"{path} holds neither a matrix nor a stack")
                for k, m in enumerate(a if a.ndim == 3 else a[None]):
                    i, j = np.nonzero(m)
                    yield pd.DataFrame({"path": path, "sample": k, "i": i, "j": j, "v": m[i, j]})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string, sample long, i int, j int, v double")


def read_vectors(spark: SparkSession, glob: str) -> DataFrame:
    """``(path, sample, x)`` of ``.npy`` or text vectors; one row or column is a vector, a stack in ``.npy`` several."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                npy = path.endswith(".npy")
                a = np.load(io.BytesIO(content), allow_pickle=False) if npy else np.loadtxt(io.StringIO(content.decode().replace(",", " ")))
                a = np.atleast_1d(np.asarray(a, np.float64))
                if a.ndim == 2 and 1 in a.shape:
                    a = a.ravel()
                if a.ndim > 2 or (a.ndim == 2 and not npy):
                    raise ValueError(f"{path} is no vector")
                for k, x in enumerate(a if a.ndim == 2 else a[None]):
                    yield pd.DataFrame({"path": [path], "sample": [k], "x": [x]})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string, sample long, x array<double>")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples and matrices of a written dataset."""
    return spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/matrices")


def list_matrix_ids(samples: DataFrame) -> DataFrame:
    """The matrices that samples refer to."""
    return samples.select("matrix_id").distinct()


def sample_count(samples: DataFrame) -> DataFrame:
    """``n_samples`` by dataset."""
    return samples.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_samples"))


def dense_to_coo(packed_rows: DataFrame) -> DataFrame:
    """``packed(matrix_id, rows array<array<double>>)`` as non-zero entries."""
    rows = packed_rows.select("matrix_id", F.posexplode("rows").alias("i", "row"))
    return rows.select("matrix_id", "i", F.posexplode("row").alias("j", "v")).filter("v <> 0")


def attach_extras(samples: DataFrame, extras: DataFrame, names: list[str]) -> DataFrame:
    """Samples with a column for each named array of ``extras(sample_id, name, x)``; missing ones are null."""
    wide = extras.filter(F.col("name").isin(names)).groupBy("sample_id").pivot("name", names).agg(F.first("x", True))
    return samples.join(wide, "sample_id", "left")


def select_rhs(vectors: DataFrame, index: int = -1) -> DataFrame:
    """One vector of each source: the given number, or the first for -1; a number out of range is an error."""
    if index == -1:
        return vectors.groupBy("source").agg(F.min_by(F.struct("sample_id", "x"), "sample_id").alias("f")).select("source", "f.*")
    found = vectors.groupBy("source").agg(F.max_by(F.struct("sample_id", "x"), F.when(F.col("sample_id") == index, 1)).alias("f"))
    return found.select("source", F.when(F.col("f").isNotNull(), F.col("f.sample_id")).otherwise(F.raise_error(F.lit(f"no right-hand side {index}")).cast("long")).alias("sample_id"), F.col("f.x").alias("x"))


def load_systems(matrices: DataFrame, rhs: DataFrame) -> DataFrame:
    """``rhs(matrix_id, x)`` with its matrix's size; a length that differs is an error."""
    n = matrices.groupBy("matrix_id").agg((F.greatest(F.max("i"), F.max("j")) + 1).cast("int").alias("n"))
    fits = F.when(F.size("x") == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("a right-hand side does not fit its matrix")).cast("int"))
    return rhs.join(n, "matrix_id").select("matrix_id", "x", fits.alias("n"))
