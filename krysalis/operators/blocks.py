"""Matrices as blocks and vectors in chunks: products are numpy calls in tasks, sums of chunks are Spark's.

A block covers ``CHUNK`` rows and columns of a matrix and is kept dense or as
sorted coordinates, whichever is smaller. A vector is one array a chunk. The
systems of a matrix are dealt out to parts of about ``TOGETHER``, which a task
multiplies at once, so a matrix with most of the systems is many groups; a group
holds one column of blocks, ``STRIPE`` of them at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krysalis.functions.lineage import materialize, once
from krysalis.operators.algebra import sizes

CHUNK, TOGETHER, STRIPE = 1024, 64, 16
#: What names a vector. Vectors carry these, and where the rest of their matrix's columns tell ``Blocks`` to send them.
KEY = ("system_id", "preconditioner")
PLACE = (*KEY, "matrix_id", "part", "stripes", "c")
_PARTIAL = "system_id long, preconditioner string, c int, y array<double>"
_BLOCK = "matrix_id long, c int, b int, stripe int, h int, w int, i binary, j binary, v binary"


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


def stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists as the rows of a matrix, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def block_times(block: dict, x: np.ndarray) -> np.ndarray:
    """The block's product with the rows of ``x``, as rows."""
    h, w = block["h"], block["w"]
    if x.shape[1] != w:
        x = x[:, :w] if x.shape[1] > w else np.pad(x, ((0, 0), (0, w - x.shape[1])))
    v = np.frombuffer(block["v"])
    if not block["i"]:
        return x @ v.reshape(h, w).T
    i, j = np.frombuffer(block["i"], np.int32), np.frombuffer(block["j"], np.int32)
    rows, first = np.unique(i, return_index=True)
    out, step = np.zeros((len(x), h)), max(1, (1 << 22) // len(v))
    for lo in range(0, len(x), step):
        out[lo : lo + step, rows] = np.add.reduceat(x[lo : lo + step, j] * v, first, axis=1)
    return out


class Blocks:
    """Packed matrices, with as many parts for each as its systems need.

    ``systems`` has a row for each vector that is to be multiplied, with
    ``matrix_id``.
    """

    def __init__(self, matrices: DataFrame, systems: DataFrame, chunk: int = CHUNK):
        self.chunk, matrices = chunk, once(matrices)
        count = systems.groupBy("matrix_id").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
        n = sizes(matrices).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
        self.meta = materialize(n.join(count, "matrix_id", "left").select("matrix_id", "n", "chunks", F.coalesce("parts", F.lit(1)).alias("parts"), F.ceil(F.col("chunks") / STRIPE).cast("int").alias("stripes")))
        at = lambda c: F.floor(F.col(c) / chunk).cast("int")
        placed = matrices.join(self.meta, "matrix_id").select("matrix_id", at("j").alias("c"), at("i").alias("b"), "n", F.pmod("i", F.lit(chunk)).cast("int").alias("i"), F.pmod("j", F.lit(chunk)).cast("int").alias("j"), "v")

        def pack(keys: tuple, table: pa.Table) -> pa.Table:
            m, c, b = (k.as_py() for k in keys)
            n, i, j, v = (table[x].to_numpy() for x in ("n", "i", "j", "v"))
            h, w = min(chunk, int(n[0]) - b * chunk), min(chunk, int(n[0]) - c * chunk)
            cell, inverse = np.unique(i.astype(np.int64) * w + j, return_inverse=True)
            v = np.bincount(inverse, v, len(cell))
            if 2 * len(cell) >= h * w:
                full = np.zeros(h * w)
                full[cell] = v
                row = b"", b"", full.tobytes()
            else:
                row = (cell // w).astype(np.int32).tobytes(), (cell % w).astype(np.int32).tobytes(), v.tobytes()
            values = [m, c, b, b // STRIPE, h, w, *row]
            kinds = [pa.int64(), *[pa.int32()] * 5, *[pa.binary()] * 3]
            return pa.table({name.split()[0]: pa.array([x], t) for name, x, t in zip(_BLOCK.split(", "), values, kinds, strict=True)})

        packed = placed.groupBy("matrix_id", "c", "b").applyInArrow(pack, _BLOCK)
        self.blocks = materialize(packed)
        self.single = not self.meta.filter("chunks > 1").limit(1).count()  # every vector is one row: what is summed by system is there
        parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        self.dealt = self.blocks.join(self.meta.select("matrix_id", "parts"), "matrix_id").select(*self.blocks.columns, parts)

    def chunked(self, rows: DataFrame) -> DataFrame:
        """Component rows ``(system_id, matrix_id, i, v)`` as chunks ``PLACE, v``; absent components are zero.

        A vector that is longer than its matrix keeps its length, one without a
        matrix too. Of a component that comes twice, any counts.
        """
        if "preconditioner" not in rows.columns:
            rows = rows.withColumn("preconditioner", F.lit("identity"))
        c = F.floor(F.col("i") / self.chunk).cast("int")
        held = rows.groupBy(*KEY, "matrix_id", c.alias("c")).agg(F.collect_list("i").alias("at"), F.collect_list("v").alias("v"))
        known = rows.select(*KEY, "matrix_id").distinct().join(self.meta, "matrix_id", "left")
        part = F.pmod(F.xxhash64(*KEY), F.coalesce("parts", F.lit(1))).cast("int")
        places = known.select(*KEY, "matrix_id", "n", part.alias("part"), F.coalesce("stripes", F.lit(1)).alias("stripes"), F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("c"))
        both = held.join(places.drop("part", "stripes"), [*KEY, "matrix_id", "c"], "full_outer")
        with_part = both.drop("n").join(known.select(*KEY, "matrix_id", "n", part.alias("part"), F.coalesce("stripes", F.lit(1)).alias("stripes")), [*KEY, "matrix_id"])
        chunk, schema = self.chunk, "system_id long, preconditioner string, matrix_id long, part int, stripes int, c int, v array<double>"

        def fill(batches):
            for batch in batches:
                t = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
                out = []
                for c, n, at, v in zip(t["c"].to_pylist(), t["n"].to_pylist(), t["at"], t["v"], strict=True):
                    at = np.zeros(0, np.int64) if at.values is None else at.values.to_numpy() - c * chunk
                    x = np.zeros(max(min(chunk, (n or 0) - c * chunk), int(at.max(initial=-1)) + 1))
                    if len(at):
                        x[at] = v.values.to_numpy(zero_copy_only=False)
                    out.append(x)
                yield pa.RecordBatch.from_arrays([*(t[name] for name in PLACE), pa.array(out, pa.list_(pa.float64()))], [*PLACE, "v"])

        return with_part.select(*PLACE, "n", "at", F.col("v").cast("array<double>").alias("v")).mapInArrow(fill, schema)

    def times(self, vectors: DataFrame) -> DataFrame:
        """``(KEY, c, y)``: parts of the products with chunks ``PLACE, v``; those of one ``(KEY, c)`` are still to be summed."""

        def multiply(keys: tuple, vectors: pa.Table, blocks: pa.Table) -> pa.Table:
            columns: list[list] = [[], [], [], []]
            if vectors.num_rows:
                x = stacked(vectors["v"])
                for block in blocks.to_pylist():
                    y = block_times(block, x)
                    for out, part in zip(columns, (vectors["system_id"], vectors["preconditioner"], pa.chunked_array([pa.array(np.full(len(y), block["b"], np.int32))]), pa.chunked_array([lists(y)])), strict=True):
                        out.extend(part.chunks)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64())]
            return pa.table({n: pa.chunked_array(v, t) for n, v, t in zip((*KEY, "c", "y"), columns, kinds, strict=True)})

        one = vectors.select(*PLACE, "v").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
        keys = ["matrix_id", "c", "stripe", "part"]
        return one.groupBy(*keys).cogroup(self.dealt.groupBy(*keys)).applyInArrow(multiply, _PARTIAL)

    def carried(self, state: DataFrame, column: str) -> DataFrame:
        """The state with ``ys``, as ``gathered`` gives it, where every vector is one chunk: rows go through the product and need no shuffle by system."""
        names, schema = state.columns, ", ".join(f"{n} {t}" for n, t in state.dtypes)

        def multiply(keys: tuple, rows: pa.Table, blocks: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.table({n: pa.array([], t) for n, t in zip((*names, "ys"), (*rows.schema.types, pa.list_(pa.list_(pa.float64()))), strict=True)})
            ys = [lists(block_times(block, stacked(rows[column]))) for block in blocks.to_pylist()]
            held = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * len(ys)), ys[0] if ys else pa.array([], pa.list_(pa.float64())))
            return rows.append_column("ys", held)

        keys = ["matrix_id", "c", "part"]
        return state.groupBy(*keys).cogroup(self.dealt.groupBy(*keys)).applyInArrow(multiply, f"{schema}, ys array<array<double>>")

    def product(self, vectors: DataFrame) -> DataFrame:
        """``PLACE, v``: A v for every vector."""
        both = gathered(vectors.select(*PLACE, F.col("v").alias("x")), self.times(vectors))
        return both.selectExpr(*PLACE, f"{summed('ys', 'x')} AS v")

    def rows(self, vectors: DataFrame, *columns: str) -> DataFrame:
        """Chunks as component rows ``i, columns``, with the other columns repeated."""
        kept = [c for c in vectors.columns if c not in (*columns, "part", "stripes", "c")]
        flat = vectors.select(*kept, "c", F.posexplode(F.arrays_zip(*columns)).alias("at", "__p"))
        return flat.select(*kept, (F.col("c") * self.chunk + F.col("at")).alias("i"), *(F.col(f"__p.{c}").alias(c) for c in columns))


def gathered(state: DataFrame, partials: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """The state's chunks with ``ys``, the partial products of each, and the other columns that ``extra(KEY, c, ...)`` has for them.

    All rows of a system are dealt to one place, in one shuffle, so that sums by
    system (``by_system``) need no other.
    """
    rows = state.unionByName(partials, allowMissingColumns=True)
    if extra is not None:
        rows = rows.unionByName(extra, allowMissingColumns=True)
    once = [F.expr(f"first({n}, true) AS {n}") for n in rows.columns if n not in (*KEY, "c", "y")]
    together = rows.repartition(*KEY).groupBy(*KEY, "c").agg(*once, F.expr("collect_list(y) AS ys"))
    return together.filter("matrix_id IS NOT NULL")  # a product may have chunks that the vector lacks only if it lacks rows


# Expressions over chunks, as SQL text: one call to the driver's JVM each, however many lambdas they hold.


def by_system(value: str, single: bool = False) -> str:
    """A sum over the rows of a system, which lie together; the value if a system is a single row."""
    if single:
        return f"({value})"
    return f"sum({value}) OVER (PARTITION BY {', '.join(KEY)})"


def zeros(like: str) -> str:
    """As many zeros."""
    return f"transform({like}, v -> 0D)"


def total(arrays: str, like: str) -> str:
    """The sum of an array of vectors; ``like`` is as long as the longest."""
    return f"reduce({arrays}, {zeros(like)}, (s, y) -> zip_with(s, y, (a, b) -> coalesce(a, 0D) + coalesce(b, 0D)))"


def summed(arrays: str, like: str) -> str:
    """The sum of an array of vectors, as long as ``like``; zeros if there is none."""
    return f"CASE WHEN size({arrays}) = 1 AND size({arrays}[0]) = size({like}) THEN {arrays}[0] ELSE {total(arrays, like)} END"


def plus(a: str, scale: str, b: str) -> str:
    """a + scale · b."""
    return f"zip_with({a}, {b}, (u, v) -> u + {scale} * v)"


def inner(a: str, b: str) -> str:
    """The inner product of two arrays."""
    return f"reduce(zip_with({a}, {b}, (u, v) -> u * v), 0D, (s, v) -> s + v)"


def scaled(v: str, m: str) -> str:
    """v · m component by component; v where there is no m."""
    return f"CASE WHEN {m} IS NULL THEN {v} ELSE zip_with({v}, {m}, (a, b) -> a * coalesce(b, 1D)) END"
