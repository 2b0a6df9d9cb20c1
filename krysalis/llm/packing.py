"""Packing token pieces into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from krysalis.llm.bpe import library_cache, tokenizer_path
from krysalis.llm.common import materialize, text_of

CAPACITY = 1024
END_ID = 2
#: Pieces of a hot length that are ranked together, about, and the parts of a length from which both grow with the root of the pieces.
RANKED_TOGETHER, MANY_PARTS = 500, 1 << 16


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``id, piece, start, length, ids_crc32`` and ``ids`` if asked.

    A document is its ids and then ``end_id``. Longer ones are cut from the end,
    so that only the first piece can be shorter. Null text counts as empty: one
    piece, the end alone. Repeated rows are packed once each.
    """
    path = path or tokenizer_path()
    given = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = library_cache(path)
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 22) / max(batch.nbytes, 1)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), cache.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    first = len(ids) % width or width
                    cuts = [0, *range(first, len(ids), width), len(ids)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b]), np.frombuffer(ids[a:b], "<i4") if with_ids else None))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], kinds[:n], strict=True)], ["id", "piece", "start", "length", "ids_crc32", "ids"][:n])

    return given.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def slack_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(times, [(length, uses)])``: bins by minimum bin slack.

    Each bin takes the largest length left and, by subset-sum over the lengths
    left as a bitset, the fullest feasible filling of its rest; it is repeated
    as long as the counts allow and removed. Each pattern brings some length
    under its number of uses in it, so their number is bounded by the
    capacity, not by the counts.
    """
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    out = []
    while left:
        largest = next(iter(left))
        room = capacity - largest
        use = {largest: 1}
        if room:
            mask = (1 << (room + 1)) - 1
            reached, steps = 1, []
            for n, c in left.items():
                if n > room:
                    continue
                before = reached
                for _ in range(min(c - (n == largest), room // n)):
                    more = (reached | reached << n) & mask
                    if more == reached:
                        break
                    reached = more
                steps.append((n, before))
                if reached >> room:
                    break
            goal = reached.bit_length() - 1
            for n, before in reversed(steps):
                while not before >> goal & 1:
                    use[n] = use.get(n, 0) + 1
                    goal -= n
        times = min(left[n] // k for n, k in use.items())
        out.append((times, sorted(use.items(), reverse=True)))
        for n, k in use.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces(id, piece, length, ...)`` with ``sequence_id`` and ``offset``; sequences are filled gapless from 0.

    Bins are planned on the histogram of lengths, at most ``capacity`` numbers
    whatever the data's size, and the plan (a few rows a length) goes out to all
    tasks. A piece finds its bin by its rank among the pieces of its length.
    Ranks come from two levels, so a length with a third of all rows is cut into
    parts: a count for each part, then places inside each part.
    """
    names = pieces.columns
    pieces = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    total = sum(counts.values())
    parts = max(1, min(total // RANKED_TOGETHER, max(MANY_PARTS, isqrt(total))))
    plan = _plan(counts, capacity)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    starts = materialize(sizes.select("length", "part", before.alias("before")))
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece", "__row")) - 1
    ranked = dealt.withColumn("place", place).join(starts, ["length", "part"]).select(*names, (F.col("before") + F.col("place")).alias("rank"))
    at = names.index("length")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, lo, uses, sequence, offset = plan
        for batch in batches:
            n, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            k = np.searchsorted(first, n * _SPAN + rank, "right") - 1
            inside = rank - lo[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[k] + inside // uses[k]), pa.array(offset[k] + inside % uses[k] * n)], [*names, "sequence_id", "offset"])

    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


_SPAN = 1 << 50


def _plan(counts: dict[int, int], capacity: int) -> list[np.ndarray]:
    """Ranges of ranks, by (length, first rank): first rank, uses in the pattern, first sequence, first offset."""
    rows, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for times, items in slack_patterns(counts, capacity):
        offset = 0
        for n, uses in items:
            rows.append((n * _SPAN + taken[n], taken[n], uses, sequence, offset))
            taken[n] += times * uses
            offset += uses * n
        sequence += times
    return list(np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy())


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of ``docs`` with their places in packed sequences; an empty table gives none.

    A null id is a document like any other; input columns but the two named are
    not read, so their names cannot clash.
    """
    return pack_pieces(token_pieces(docs, id_col, text_col, path, capacity, end_id, with_ids), capacity).withColumnRenamed("id", "doc_id")


def op1_best_fit_packing(spark, sf_dir):
    """Pieces of every document with their places."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
