"""Batched inference by user models, and registries of user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krysalis.operators.algebra import packed, pod_basis

#: Right-hand side sources and normalisation modes by name.
RHS_SOURCES: dict[str, Callable[..., DataFrame]] = {}
NORMALIZATIONS: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str, registry: dict[str, Callable[..., DataFrame]] = RHS_SOURCES) -> Callable:
    """A decorator that adds a function of DataFrames; a name is taken once."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in registry:
            raise ValueError(f"{name} is registered already")
        registry[name] = function
        return function

    return add


def predict(samples: DataFrame, features: list[str], model: Callable[..., np.ndarray], batch_size: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (``sample_id``) and ``y_pred``: the model on stacked feature arrays, ``batch_size`` rows at a time.

    All rows of a feature must have one length; an empty table gives none.
    """
    keep = keep or ["sample_id"]
    given = samples.select(*keep, *features)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keep)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), batch_size):
                rows = part.iloc[lo : lo + batch_size]
                out = np.asarray(model(*(np.stack(rows[f].to_numpy()) for f in features)), np.float64)
                if len(out) != len(rows):
                    raise ValueError("a model returns a row for each sample")
                yield rows[keep].assign(y_pred=list(out.reshape(len(rows), -1)))

    return given.mapInPandas(run, f"{kinds}, y_pred array<double>")


def pod_from_predictions(samples: DataFrame, features: list[str], model: Callable[..., np.ndarray], rank: float | int) -> DataFrame:
    """``pod_basis`` of the snapshots that a model predicts for each matrix's samples."""
    return pod_basis(predict(samples, features, model, keep=["matrix_id"]).withColumnRenamed("y_pred", "x"), rank)


def learned_preconditioner(residual: DataFrame, model: Callable[..., np.ndarray]) -> DataFrame:
    """``(system_id, matrix_id, i, v)``: z = model(r) for component rows of residuals."""
    rows = packed(residual, "system_id", "matrix_id")
    z = predict(rows, ["x"], model, keep=["system_id", "matrix_id"])
    return z.select("system_id", "matrix_id", F.posexplode("y_pred").alias("i", "v"))
