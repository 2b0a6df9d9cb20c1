"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators, a linear hinge-loss model is fitted to them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from krysalis.llm.common import materialize, text_of

#: Indicators are hashed to so many places.
BITS = 20
#: The fit sees at most so many labelled documents, and so many indicators in all.
FIT_ROWS, FIT_FEATURES = 20_000, 16_000_000
#: Bounds of the dual variables, passes over the sample, and classes of the smoothing.
COST, PASSES, SMOOTHING = 1.0, 12, 1.0
#: Bytes that are looked at together; nothing but memory depends on it, save that a longer word or line is read in parts.
SLICE = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAGS = (1, 2, 3, 4, 8)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, for rolling hashes."""
    base = 0xD6E8FEB86659FD93
    up, down = np.full(SLICE + 1, base, np.uint64), np.full(SLICE + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _place(codes: np.ndarray, kind: int) -> np.ndarray:
    return (((codes.astype(np.uint64) + np.uint64(kind << 56)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def _spans(rolled: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A hash for each run of true bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    return (rolled[end] - rolled[start]) * _powers()[1][start]


def _slices(raw: bytes) -> Iterator[bytes]:
    """The text in slices that end at a line's end, or else at a space, where there is one."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            end = 1 + raw.rfind(b"\n", at, end) or 1 + raw.rfind(b" ", at, end) or end
        yield raw[at:end]
        at = end


def indicators(text: str) -> np.ndarray:
    """The places of a text's indicators, each once: bytes, pairs and triples of them, and word patterns.

    A-Z count as a-z. Patterns are n-grams without their letters: how many words
    equal the one 1, 2, 3, 4 or 8 places before, how many words and lines have
    occurred before, each in sixteenths of all, and the length in powers of two.
    An empty text has the last ones only.
    """
    raw = text.encode("utf-8", "surrogatepass").lower()
    found, words, lines, tail = [], [], [], b""
    for part in _slices(raw):
        b = np.frombuffer(tail + part, np.uint8).astype(np.uint32)
        found += [np.unique(b).astype(np.int32), _place(np.unique(b[:-1] << 8 | b[1:]), 2), _place(np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]), 3)]
        tail = (tail + part)[-2:]
        b = np.frombuffer(part, np.uint8)
        rolled = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers()[0][: len(b)], out=rolled[1:])
        words.append(_spans(rolled, (b != 32) & ((b < 9) | (b > 13))))
        lines.append(_spans(rolled, b != 10))
    w, ls = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (words, lines))
    share = lambda k, n: 0 if not k else 1 + k * 16 // n
    shape = [lag * 100 + share(int((w[lag:] == w[:-lag]).sum()), len(w)) for lag in _LAGS]
    shape += [5000 + share(len(w) - len(np.unique(w)), len(w)), 6000 + share(len(ls) - len(np.unique(ls)), len(ls)), 7000 + len(w).bit_length()]
    return np.unique(np.concatenate([*found, _place(np.array(shape), 9)]))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The logarithm of an indicator's share among those of class 1 over its share in class 0, smoothed."""
    counts = np.full((2, 1 << BITS), SMOOTHING)
    for x, y in zip(rows, labels, strict=True):
        counts[int(y), x] += 1
    shares = np.log(counts / counts.sum(1, keepdims=True))
    return shares[1] - shares[0]


def dual_descent(rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on scaled indicators, by dual coordinate descent.

    One dual variable a document, in [0, ``COST``]; each step minimises the dual
    along one of them, in an order drawn anew for each pass.
    """
    values = [ratios[x] for x in rows]
    square = np.array([v @ v + 1 for v in values])
    sign = np.where(labels > 0, 1.0, -1.0)
    w, bias, alpha, rng = np.zeros(1 << BITS), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            x, v = rows[k], values[k]
            slack = sign[k] * (w[x] @ v + bias) - 1
            new = min(max(alpha[k] - slack / square[k], 0.0), COST)
            if new != alpha[k]:
                step = (new - alpha[k]) * sign[k]
                w[x] += step * v
                bias += step
                moved, alpha[k] = max(moved, abs(step)), new
        if moved < 1e-4 * COST:
            break
    return w, bias


def fitted(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """``(weights, bias, slope, offset)``: the chance of label 1 is the logistic of slope · margin + offset.

    The slope and offset are fitted to margins of documents that the model did
    not see: two models of a half each judge the other half. Without two
    classes the chance is their share, one half for no document.
    """
    n, ones = len(rows), int(labels.sum())
    if not 0 < ones < n:
        share = (ones + 1) / (n + 2)
        return np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share)))

    def model(at):
        some = [rows[k] for k in at]
        ratios = log_count_ratios(some, labels[at])
        ratios /= np.sqrt(np.mean([ratios[x] @ ratios[x] for x in some]) + 1e-300)  # documents of unit length on average
        w, bias = dual_descent(some, ratios, labels[at])
        return w * ratios, bias

    margins = np.zeros(n)
    half = np.arange(n) % 2
    for side in (0, 1):
        w, bias = model(np.flatnonzero(half == side))
        other = np.flatnonzero(half != side)
        margins[other] = [w[rows[k]].sum() + bias for k in other]
    w, bias = model(np.arange(n))
    slope, offset = _logistic(margins, labels)
    return w, bias, slope, offset


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, the classes' targets drawn in by one case each; the slope is at least 0."""
    ones = labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.stack([margins, np.ones(len(margins))])
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -40, 40)))
        gradient = x @ (p - target) + 1e-6 * at
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), gradient)
        at = at - step * min(1.0, 4 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 0.0), float(at[1])


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is of the fold that nothing is learned from; a null id is of none."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> DataFrame:
    """``(doc_id, label, places)``: indicators of at most ``fit_rows`` labelled documents outside the held-out fold.

    They are the first by a hash of their ids, and of these the first whose
    indicators sum to ``fit_features`` at most. The ids, bounded, are broadcast.
    Of several labels of one id the greatest counts; an id that several
    documents bear stands for the least of their texts. Null labels are none.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [indicators(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "label", "places"])

    made = materialize(texts.mapInArrow(run, StructType([*texts.schema.fields[:2], *StructType.fromDDL("places array<int>").fields])))
    sizes = made.select("doc_id", F.size("places").alias("n"))
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # fit_rows rows at most
    kept = sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= fit_features).select("doc_id")
    return made.join(F.broadcast(kept), "doc_id")


def fit_classifier(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> tuple[np.ndarray, float, float, float]:
    """The model, as ``fitted`` gives it; the bounded sample is one group, and 2^20 weights reach the driver."""
    sample = labelled_sample(docs, labels, fit_rows, fit_features)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        rows = [np.asarray(x, np.int32) for x in np.split(table["places"].combine_chunks().flatten().to_numpy(), np.cumsum(table["places"].combine_chunks().value_lengths().to_numpy())[:-1])]
        w, bias, slope, offset = fitted(rows, table["label"].to_numpy())
        return pa.table({"w": pa.array([w.astype("<f4").tobytes()]), "ends": pa.array([[bias, slope, offset]], pa.list_(pa.float64()))})

    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "w binary, ends array<double>").collect()
    if not found:
        return fitted([], np.zeros(0))
    return np.frombuffer(found[0]["w"], "<f4"), *found[0]["ends"]


def classify(docs: DataFrame, model: tuple[np.ndarray, float, float, float], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) and ``score double, predicted int``, one narrow pass over whole texts.

    A null text counts as empty; every text has a score. Nothing but the text is
    read. Repeated rows are scored alike; input columns named like the two, in
    any case, are replaced; an empty table gives none.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("score", "predicted")]
    given = docs.select(*names, text_of(text_col).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^20 weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, slope, offset = sent.value
        for batch in batches:
            margins = np.array([w[indicators(t)].sum(dtype=np.float64) for t in batch.column(len(names)).to_pylist()]) + bias
            score = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return given.mapInArrow(run, StructType([*given.schema.fields[:-1], StructField("score", StructType.fromDDL("x double")[0].dataType), StructField("predicted", StructType.fromDDL("x int")[0].dataType)]))


def op13_quality_classifier(spark, sf_dir):
    """A score and verdict for every document, learned from the labels of the other folds."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, fit_classifier(docs, labels), carry=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
