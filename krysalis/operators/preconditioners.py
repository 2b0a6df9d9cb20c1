"""Preconditioners: functions from the residuals of their systems to z, called in every iteration of a loop.

Residuals and z are chunks ``PLACE, v`` as in ``blocks``. A preconditioner is
made once for a family of matrices (``ready``), where it computes what all its
systems and iterations share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krysalis.functions.lineage import discard, materialize
from krysalis.operators.algebra import diagonal, galerkin
from krysalis.operators.blocks import KEY, PLACE, Blocks, gathered, lists, plus, scaled, stacked, summed, total, zeros

_CHUNKS = "system_id long, preconditioner string, matrix_id long, part int, stripes int, c int, v array<double>"


class Preconditioner:
    """z = r. ``linear``: z depends on r by one symmetric positive matrix, the same in every iteration."""

    linear = True

    def ready(self, matrices: DataFrame, blocks: Blocks) -> Preconditioner:
        """Compute what is shared; called once before a loop."""
        return self

    def scale(self) -> DataFrame | None:
        """``(matrix_id, c, m)`` if z = m · r component by component: loops then keep m beside the state and need no call."""
        return None

    def apply(self, residual: DataFrame, iteration: int) -> DataFrame:
        """z for chunks ``PLACE, v`` of residuals of the loop's ``iteration``."""
        return residual

    def done(self) -> None:
        """z has been written: what ``apply`` wrote on the way may go."""


class Identity(Preconditioner):
    """z = r."""


class Jacobi(Preconditioner):
    """z = r over the diagonal; a place without one keeps its residual."""

    def ready(self, matrices: DataFrame, blocks: Blocks) -> Jacobi:
        d = diagonal(matrices).withColumn("m", F.when(F.abs("v") > 0, 1 / F.col("v")).otherwise(1.0))
        chunk = F.floor(F.col("i") / blocks.chunk).cast("int").alias("c")
        pairs = d.groupBy("matrix_id", chunk).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
        self.m = materialize(pairs.select("matrix_id", "c", F.transform("p", lambda p: p["m"]).alias("m")))
        return self

    def scale(self) -> DataFrame:
        return self.m

    def apply(self, residual: DataFrame, iteration: int) -> DataFrame:
        return residual.join(self.m, ["matrix_id", "c"], "left").selectExpr(*PLACE, f"{scaled('v', 'm')} AS v")


class TwoGrid(Preconditioner):
    """A V-cycle over two levels: weighted Jacobi steps, a coarse correction in the space of a basis, the same steps again.

    ``basis(matrix_id, i, mode, v)``. The coarse operator of each matrix is
    summed and inverted once, before the loop: ``modes`` squared numbers a
    matrix, which all systems and iterations share. A matrix without a basis
    gets the smoothing steps alone; one with a coarse operator that cannot be
    inverted, or of over ``most`` modes, is an error.
    """

    def __init__(self, basis: DataFrame, steps: int = 2, omega: float = 0.67, most: int = 1024):
        self.basis, self.steps, self.omega, self.most = basis, steps, omega, most
        self.used: list[DataFrame] = []

    def ready(self, matrices: DataFrame, blocks: Blocks) -> TwoGrid:
        self.blocks, self.jacobi = blocks, Jacobi().ready(matrices, blocks)
        most = self.most

        def inverted(keys: tuple, table: pa.Table) -> pa.Table:
            a, b, v = (table[n].to_numpy() for n in ("a", "b", "v"))
            n = int(max(a.max(), b.max())) + 1
            if n > most:
                raise ValueError(f"over {most} modes")
            full = np.zeros((n, n))
            full[a, b] = v
            return pa.table({"matrix_id": pa.array([keys[0].as_py()], pa.int64()), "inverse": [np.linalg.inv(full).tobytes()]})

        self.factor = materialize(galerkin(matrices, self.basis).groupBy("matrix_id").applyInArrow(inverted, "matrix_id long, inverse binary"))
        chunk = blocks.chunk
        width = F.least(F.lit(chunk), F.col("n") - F.col("c") * chunk).alias("w")
        modes = self.basis.select("matrix_id", F.floor(F.col("i") / chunk).cast("int").alias("c"), "i", "mode", "v").join(blocks.meta.select("matrix_id", "n"), "matrix_id").select("matrix_id", "c", width, (F.col("i") - F.col("c") * chunk).alias("i"), "mode", "v")

        def pack(keys: tuple, table: pa.Table) -> pa.Table:
            i, mode, v = (table[n].to_numpy() for n in ("i", "mode", "v"))
            phi = np.zeros((int(mode.max()) + 1, int(table["w"][0].as_py())))
            phi[mode, i] = v
            return pa.table({"matrix_id": pa.array([keys[0].as_py()], pa.int64()), "c": pa.array([keys[1].as_py()], pa.int32()), "rows": pa.array([len(phi)], pa.int32()), "phi": [phi.tobytes()]})

        self.phi = materialize(modes.groupBy("matrix_id", "c").applyInArrow(pack, "matrix_id long, c int, rows int, phi binary"))
        return self

    def _residual(self, z: DataFrame) -> DataFrame:
        """``PLACE, v, r, m, e`` with e = r − A v."""
        both = gathered(z, self.blocks.times(z))
        return both.selectExpr(*PLACE, "v", "r", "m", f"{plus('r', '-1D', f'({summed("ys", "v")})')} AS e")

    def _smooth(self, z: DataFrame) -> DataFrame:
        """One step v + ω D⁻¹ (r − A v)."""
        return self._residual(z).selectExpr(*PLACE, f"{plus('v', f'{self.omega}D', f'({scaled("e", "m")})')} AS v", "r", "m")

    def apply(self, residual: DataFrame, iteration: int) -> DataFrame:
        start = residual.join(self.jacobi.m, ["matrix_id", "c"], "left")
        first = f"transform({scaled('v', 'm')}, a -> a * {self.omega}D)" if self.steps else zeros("v")
        z = start.selectExpr(*PLACE, f"{first} AS v", "v AS r", "m")
        for _ in range(self.steps - 1):
            z = self._smooth(z)
        z = materialize(self._residual(z))
        self.used.append(z)
        z = z.join(self._correction(z), [*KEY, "c"], "left").selectExpr(*PLACE, f"CASE WHEN up IS NULL THEN v ELSE {plus('v', '1D', 'up')} END AS v", "r", "m")
        for _ in range(self.steps):
            z = self._smooth(z)
        return z.select(*PLACE, "v")

    def done(self) -> None:
        discard(*self.used)
        self.used = []

    def _correction(self, z: DataFrame) -> DataFrame:
        """``(KEY, c, up)``: Φ (Φᵀ A Φ)⁻¹ Φᵀ e."""

        def down(keys: tuple, rows: pa.Table, phi: pa.Table) -> pa.Table:
            if not phi.num_rows or not rows.num_rows:
                return pa.table({"system_id": pa.array([], pa.int64()), "preconditioner": pa.array([], pa.string()), "matrix_id": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "k": pa.array([], pa.list_(pa.float64()))})
            p = np.frombuffer(phi["phi"][0].as_py()).reshape(phi["rows"][0].as_py(), -1)
            return pa.table({n: rows[n] for n in (*KEY, "matrix_id", "part")} | {"k": lists(stacked(rows["e"]) @ p.T)})

        def up(keys: tuple, rows: pa.Table, sent: pa.Table) -> pa.Table:
            columns: list[list] = [[], [], [], []]
            if rows.num_rows and sent.num_rows:
                k, tables = stacked(rows["k"]), sent.to_pylist()
                n = int(np.sqrt(len(tables[0]["inverse"]) // 8))
                k = (k if k.shape[1] == n else np.pad(k, ((0, 0), (0, n - k.shape[1])))) @ np.frombuffer(tables[0]["inverse"]).reshape(n, n).T
                for t in tables:
                    p = np.frombuffer(t["phi"]).reshape(t["rows"], -1)
                    for out, part in zip(columns, (rows["system_id"], rows["preconditioner"], pa.chunked_array([pa.array(np.full(len(k), t["c"], np.int32))]), pa.chunked_array([lists(k[:, : t["rows"]] @ p)])), strict=True):
                        out.extend(part.chunks)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64())]
            return pa.table({n: pa.chunked_array(v, t) for n, v, t in zip((*KEY, "c", "up"), columns, kinds, strict=True)})

        parts = self.blocks.meta.select("matrix_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        phi = self.phi.join(parts, "matrix_id")
        keys = ["matrix_id", "c", "part"]
        sums = z.select(*KEY, *keys, "e").groupBy(*keys).cogroup(phi.groupBy(*keys)).applyInArrow(down, "system_id long, preconditioner string, matrix_id long, part int, k array<double>")
        coarse = sums.groupBy(*KEY, "matrix_id", "part").agg(F.collect_list("k").alias("ks")).selectExpr(*KEY, "matrix_id", "part", f"{total('ks', 'ks[0]')} AS k")
        sent = phi.join(self.factor, "matrix_id")
        return coarse.groupBy("matrix_id", "part").cogroup(sent.groupBy("matrix_id", "part")).applyInArrow(up, "system_id long, preconditioner string, c int, up array<double>")


class Scheduled(Preconditioner):
    """``primary`` in iterations from ``start_iter`` on, ``limit_iters`` of them if not negative; z = r outside.

    Each row's own iteration decides where the rows have one (``iter``), else
    that of the loop.
    """

    def __init__(self, primary: Preconditioner, start_iter: int = 0, limit_iters: int = -1):
        self.primary, self.start, self.limit = primary, start_iter, limit_iters
        self.linear = primary.linear and not start_iter and limit_iters < 0

    def ready(self, matrices: DataFrame, blocks: Blocks) -> Scheduled:
        self.primary.ready(matrices, blocks)
        return self

    def scale(self) -> DataFrame | None:
        return self.primary.scale() if self.linear else None

    def done(self) -> None:
        self.primary.done()

    def _inside(self, k: int) -> bool:
        return k >= self.start and (self.limit < 0 or k < self.start + self.limit)

    def apply(self, residual: DataFrame, iteration: int) -> DataFrame:
        if "iter" not in residual.columns:
            return self.primary.apply(residual, iteration) if self._inside(iteration) else residual
        last = F.lit(True) if self.limit < 0 else F.col("iter") < self.start + self.limit
        inside = (F.col("iter") >= self.start) & last
        return self.primary.apply(residual.filter(inside).drop("iter"), iteration).unionByName(residual.filter(~inside).drop("iter"))


class Learned(Preconditioner):
    """z = model(r) for whole residuals.

    ``load`` gives the model, a function from a matrix of residuals, one a row,
    to one of the same shape. A worker process calls it once and keeps what it
    gives for all iterations. A batch that the model fails on is NaN, which ends
    its systems as failed.
    """

    linear = False

    def __init__(self, load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 1024):
        self.load, self.batch_size, self.name = load, batch_size, uuid.uuid4().hex

    def ready(self, matrices: DataFrame, blocks: Blocks) -> Learned:
        self.chunk = blocks.chunk
        return self

    def apply(self, residual: DataFrame, iteration: int) -> DataFrame:
        load, name, size = self.load, self.name, self.batch_size
        whole = residual.groupBy(*KEY, "matrix_id", "part", "stripes").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("p"))
        whole = whole.select(*KEY, "matrix_id", "part", "stripes", F.flatten(F.transform("p", lambda p: p["v"])).alias("r"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = loaded(name, load)
            for batch in batches:
                for lo in range(0, batch.num_rows, size):
                    part = batch.slice(lo, size)
                    lengths = pa.compute.list_value_length(part.column(5)).to_numpy()
                    z: list = [None] * part.num_rows
                    for n in np.unique(lengths):  # systems of one size together
                        at = np.flatnonzero(lengths == n)
                        r = stacked(part.column(5).take(pa.array(at)))
                        try:
                            out = np.asarray(model(r), np.float64).reshape(r.shape)
                        except (ValueError, ArithmeticError, RuntimeError):
                            out = np.full(r.shape, np.nan)
                        for k, v in zip(at, out, strict=True):
                            z[k] = v
                    yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(z, pa.list_(pa.float64()))], [*KEY, "matrix_id", "part", "stripes", "z"])

        made = whole.mapInArrow(run, _CHUNKS.replace("c int, v", "z"))
        chunk = self.chunk
        count = F.greatest(F.lit(1), F.ceil(F.size("z") / chunk).cast("int"))
        return made.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("c")).select(*PLACE, F.slice("z", F.col("c") * chunk + 1, F.lit(chunk)).alias("v"))


#: The model that this worker process loaded last, by name.
LOADED: dict[str, Callable] = {}


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """The worker's model; a function of the module, so that all tasks of a worker see one table."""
    if name not in LOADED:
        LOADED.clear()
        LOADED[name] = load()
    return LOADED[name]


#: Preconditioners by the names that options give.
NAMED: dict[str, Callable[[], Preconditioner]] = {"identity": Identity, "none": Identity, "jacobi": Jacobi}


def named(wanted) -> dict[str, Preconditioner]:
    """Names, or a mapping from names to preconditioners, as the mapping; a name that is not known is an error."""
    if isinstance(wanted, dict):
        return dict(wanted)
    other = sorted(set(wanted) - set(NAMED))
    if other:
        raise ValueError(f"no such preconditioner: {', '.join(other)}")
    return {n: NAMED[n]() for n in wanted}
