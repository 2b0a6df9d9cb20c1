"""Hard negatives by exact inner products, scored from bit planes and subset-sum tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from krysalis.llm.common import materialize

#: Rows of a block of candidates, and of a block of anchors.
CANDIDATES, ANCHORS = 4096, 512
#: Candidates that are looked up at a time, which fit a cache; blocks of anchors that a task holds, about; parts of the candidates that pass by apart.
LOOKED, HELD, SPLITS = 256, 4, 16
#: Dimensions that a byte of a bit plane holds.
GROUP = 8
#: Anchors are the rows whose id this divides; labels of ids that the second divides are moved on by one, modulo the third.
EVERY, MOVED, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these percentages of the positive's.
LEAST, MOST = 50, 95

_BLOCK = "block long, ids binary, labels binary, planes int, groups int, bits binary, values binary"


def quantized(rows: DataFrame) -> DataFrame:
    """``(id, label, x array<long>)``: labels moved, components floor(256 x); rows with a null or non-finite part are left out.

    So are rows without an id, which nothing could name.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.when(F.pmod("vec_id", F.lit(MOVED)) == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    held = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)
    return held.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * 256.0)).alias("x"))


def bit_planes(values: np.ndarray) -> tuple[int, np.ndarray]:
    """``(planes, bits)``: integers (rows, dimensions) in two's complement, as bytes (plane, group, row) of eight dimensions.

    The planes run from the sign down.
    """
    n, d = values.shape
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    planes = max((-low - 1).bit_length() if low < 0 else 0, high.bit_length()) + 1
    padded = np.zeros((n, -(-d // GROUP) * GROUP), np.int64)
    padded[:, :d] = values
    bits = [np.packbits((padded >> p & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(planes - 1, -1, -1)]
    return planes, np.ascontiguousarray(np.stack(bits))


def subset_sums(values: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """``(group, byte, row)``: the sum of the components that each byte picks from eight dimensions of each row."""
    n, d = values.shape
    groups = -(-d // GROUP)
    padded = np.zeros((groups * GROUP, n), kind)
    padded[:d] = values.T
    tables = np.zeros((groups, 1 << GROUP, n), kind)
    for g in range(groups):
        for k in range(GROUP):  # each dimension doubles the table
            np.add(tables[g, : 1 << k], padded[g * GROUP + k], out=tables[g, 1 << k : 2 << k])
    return tables


def scores(tables: np.ndarray, bits: np.ndarray, kind: type | None = None) -> np.ndarray:
    """``(candidate, anchor)``: exact inner products, by looking a plane's bytes up and adding with shifts.

    A plane is added up in the tables' type, the planes in ``kind``.
    """
    planes, groups, n = bits.shape
    total = np.zeros((n, tables.shape[2]), kind or tables.dtype)
    plane = np.zeros(total.shape, tables.dtype)
    looked = np.empty_like(plane)
    for p in range(planes):
        if p == 1:
            np.negative(total, out=total)  # the first plane is the sign
        if p:
            total += total
        for g in range(min(groups, len(tables))):
            np.take(tables[g], bits[p, g], axis=0, out=looked if g else plane, mode="clip")
            if g:
                plane += looked
        total += plane
    return -total if planes == 1 else total


def blocks(rows: DataFrame, size: int, planes: bool) -> DataFrame:
    """Rows packed in order of id, ``size`` at most together, where they lie: no shuffle, so a hot id or label has no block of its own.

    Candidates carry bit planes, anchors their integers. Vectors of a block are
    filled up with zeros to its longest. A component beyond 40 bits is an error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, min(size, batch.num_rows - lo))
                ids = part.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")
                lengths = pa.compute.list_value_length(part.column(2)).to_numpy()
                values = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
                values[np.arange(values.shape[1]) < lengths[:, None]] = part.column(2).flatten().to_numpy()
                values = values[order]
                if int(np.abs(values).max(initial=0)) >> 40:
                    raise ValueError("a component is too large for exact scores")
                count, bits = bit_planes(values) if planes else (0, values)
                labels = part.column(1).to_numpy()[order]
                row = [0, ids[order].tobytes(), labels.tobytes(), count, -(-values.shape[1] // GROUP), bits.tobytes() if planes else b"", b"" if planes else values.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

    return materialize(rows.mapInArrow(run, _BLOCK).withColumn("block", F.monotonically_increasing_id()))


class _Anchors:
    """A block of anchors."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["a_labels"], np.int64)
        self.values = np.frombuffer(row["a_values"], np.int64).reshape(len(self.ids), -1)
        self.most = int(np.abs(self.values).sum(1).max(initial=0))  # what any bits of a plane can pick of a row

    def against(self, c: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(ids, labels, scores by anchor)`` of a block of candidates, ``LOOKED`` at a time."""
        ids, labels = np.frombuffer(c["ids"], np.int64), np.frombuffer(c["labels"], np.int64)
        bits = np.frombuffer(c["bits"], np.uint8).reshape(c["planes"], c["groups"], len(ids))
        bound = self.most << c["planes"]
        if bound >> 62:
            raise ValueError("components are too large for exact scores")
        tables = subset_sums(self.values, np.int16 if self.most < 1 << 15 else np.int32 if self.most < 1 << 31 else np.int64)
        for lo in range(0, len(ids), LOOKED):
            at = slice(lo, lo + LOOKED)
            yield ids[at], labels[at], scores(tables, bits[:, :, at].astype(np.intp), np.int32 if bound < 1 << 31 else np.int64)


class _First:
    """Of each row the ``k`` first by score, larger first, then by id, of all that it has met."""

    NONE = -(1 << 62)

    def __init__(self, rows: int, k: int):
        self.scores, self.ids, self.waiting, self.many = np.full((rows, k), self.NONE), np.zeros((rows, k), np.int64), [], 0

    def least(self) -> np.ndarray:
        """By row the score that is needed."""
        return self.scores[:, -1]

    def meet(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((rows, scores, ids))
        self.many += len(rows)
        if self.many >= len(self.scores):
            self.settle()

    def settle(self) -> None:
        if self.many:
            n, k = self.scores.shape
            held = (np.repeat(np.arange(n), k), self.scores.reshape(-1), self.ids.reshape(-1))
            rows, scores, ids = (np.concatenate([h, *w]).astype(np.int64) for h, w in zip(held, zip(*self.waiting, strict=True), strict=True))
            order = np.lexsort((ids, -scores, rows))
            first = np.searchsorted(rows[order], np.arange(n))  # each row has k at least
            order = order[first[:, None] + np.arange(k)]
            self.scores, self.ids = scores[order], ids[order]
        self.waiting, self.many = [], 0

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, score, id)``."""
        self.settle()
        row, place = np.nonzero(self.scores > self.NONE)
        return row, self.scores[row, place], self.ids[row, place]


class _Positives:
    """The first rows of the same label for each anchor of a block."""

    def __init__(self, a: dict):
        self.anchors = _Anchors(a)
        self.first = _First(len(self.anchors.ids), POSITIVES)

    def meet(self, c: dict) -> None:
        a = self.anchors
        for ids, labels, s in a.against(c):
            i, row = np.nonzero((s >= _bound(self.first.least(), s)) & (labels[:, None] == a.labels))
            other = ids[i] != a.ids[row]
            i, row = i[other], row[other]
            self.first.meet(row, s[i, row], ids[i])

    def found(self) -> list[np.ndarray]:
        row, score, other = self.first.found()
        return [row, self.anchors.ids[row], other, score]


class _Negatives:
    """The first rows of another label within the bounds of each anchor's positives."""

    def __init__(self, a: dict):
        self.anchors = _Anchors(a)
        place, slot, goal = (np.array([g[k] for g in a["goals"]], np.int64) for k in ("place", "slot", "positive_score"))
        shape = (POSITIVES, len(self.anchors.ids))
        self.low, self.high = np.full(shape, -_First.NONE), np.full(shape, _First.NONE)
        at = slot - 1, place
        self.low[at], self.high[at] = -_percent(LEAST, -goal), _percent(MOST, goal)
        self.first = _First(shape[0] * shape[1], NEGATIVES)

    def meet(self, c: dict) -> None:
        a = self.anchors
        for ids, labels, s in a.against(c):
            low = np.maximum(self.low, self.first.least().reshape(self.low.shape))
            i, row = np.nonzero((s >= _bound(low.min(0), s)) & (s <= _bound(self.high.max(0), s)) & (labels[:, None] != a.labels))
            score = s[i, row]
            for k in range(POSITIVES):
                at = np.flatnonzero((score >= low[k, row]) & (score <= self.high[k, row]))
                self.first.meet(k * len(a.ids) + row[at], score[at], ids[i[at]])

    def found(self) -> list[np.ndarray]:
        row, score, other = self.first.found()
        slot, place = np.divmod(row, len(self.anchors.ids))
        return [place, slot + 1, other, score]


def _bound(limit: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Limits in the type of what they limit."""
    return np.clip(limit, np.iinfo(s.dtype).min, np.iinfo(s.dtype).max).astype(s.dtype)


def _percent(part: int, of: np.ndarray) -> np.ndarray:
    """``floor(part * of / 100)``, without the product."""
    return part * (of // 100) + part * (of % 100) // 100


def _paired(candidates: DataFrame, anchors: DataFrame, parts: int, kind: type, columns: str) -> DataFrame:
    """What ``kind`` finds for every block of anchors in all blocks of candidates: the stated query set against all rows.

    A Cartesian product of partitions: a task holds a few blocks of anchors and
    what was found for them, and candidates' blocks pass by. So nothing is
    broadcast or sent to the driver, no pair of blocks is exchanged, and of an
    anchor ``SPLITS`` findings at most, whatever the number of rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = {}
        for batch in batches:
            for k in range(batch.num_rows):
                pair = {n: c[k].as_py() if n in plain else c[k].as_buffer() for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "goals"}
                if pair["a_block"] not in met:
                    met[pair["a_block"]] = kind(batch.slice(k, 1).to_pylist()[0])
                met[pair["a_block"]].meet(pair)
        for block, one in met.items():
            found = one.found()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (np.full(len(found[0]), block), *found)], names)

    plain, names = {"planes", "groups", "a_block"}, [c.split()[0] for c in columns.split(", ")]
    held = candidates.select("ids", "labels", "planes", "groups", "bits").coalesce(SPLITS)
    return held.hint("shuffle_replicate_nl").crossJoin(anchors.repartition(parts)).mapInArrow(run, columns)


def mine(rows: DataFrame) -> DataFrame:
    """Hard negatives of ``rows(vec_id, embedding, label)``: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id 50 divides. Each one's positives are its five
    best rows of another id and the same label; for each of them the three best
    rows of another label whose score is 50 to 95 percent of the positive's.
    Ties go to the smaller id. Rows that repeat an id are rows of their own, and
    so are anchors that do: each returns its triples. A vector that is shorter
    than another counts as filled up with zeros. Without anchors, positives or
    negatives nothing is returned; other input columns are not read.
    """
    held = quantized(rows)
    candidates = blocks(held, CANDIDATES, True)
    chosen = held.filter(F.pmod("id", F.lit(EVERY)) == 0)
    parts = max(1, -(-rows.filter(F.pmod("vec_id", F.lit(EVERY)) == 0).count() // (4 * ANCHORS)))
    anchors = blocks(chosen.repartition(parts), ANCHORS, False)
    anchors = anchors.select(*(F.col(c).alias(f"a_{c}") for c in ("block", "ids", "labels", "values")))
    parts = max(1, -(-anchors.count() // HELD))

    best = _paired(candidates, anchors, parts, _Positives, "a_block long, place long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("a_block", "place").orderBy(F.desc("positive_score"), "positive_id")
    best = materialize(best.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= POSITIVES))
    goals = best.groupBy("a_block").agg(F.collect_list(F.struct("place", "slot", "positive_score")).alias("goals"))  # 5 for each anchor of a block

    hard = _paired(candidates, anchors.join(goals.hint("merge"), "a_block"), parts, _Negatives, "a_block long, place long, slot long, negative_id long, negative_score long")
    order = Window.partitionBy("a_block", "place", "slot").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    return hard.join(best.hint("merge"), ["a_block", "place", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir):
    """Triples of every anchor."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_dot_product(a.q::DOUBLE[], c.q::DOUBLE[])::BIGINT AS score FROM v a, v c WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS MATERIALIZED (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
