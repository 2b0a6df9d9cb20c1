"""Quality rules: word rules and zstandard compression bands."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from krysalis.llm.common import text_of

WINDOW = 8
CHUNK_BYTES = 4096
#: (bytes below which the band holds, least ratio, greatest ratio): length-specific limits.
#: From 256 bytes on the least lies between wrapped base64 (at most 1.18 up to 512 bytes, 1.26 to 1 KB, 1.31 to 4 KB, 1.33 above) and prose (at least 1.34, 1.43, 1.68, 2.06).
BANDS = ((64, 0.0, 3.0), (256, 0.6, 4.0), (512, 1.26, 5.0), (1024, 1.34, 5.0), (4096, 1.45, 6.0), (65536, 1.6, 9.0), (1 << 62, 1.6, 12.0))
#: A text of more than one chunk goes if more than this share of its bytes is in chunks out of band.
CHUNK_SHARE = 0.5

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\r\x0b\x0c"
_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("zstd_ratio", pa.float64()), ("chunks_out", pa.int64()), ("n_chunks", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, chunks_out long, n_chunks long, base_failed boolean, kept boolean"


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more; exact.

    A 64-bit hash of each window shows the usual case, no repeat; otherwise the
    windows get exact ranks by doubling.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes: dict = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    if len(codes) == len(words):
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    rolled.sort()
    if not (rolled[1:] == rolled[:-1]).any():
        return 0
    ranks, size, left = ids, 1, window
    out = None
    while left:  # window as a sum of powers of two
        if left & size:
            out, done = (ranks.copy(), size) if out is None else (_joined(out, ranks, done), done + size)
            left -= size
        if left:
            ranks, size = _joined(ranks, ranks, size), size * 2
    _, inverse, counts = np.unique(out[:n], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def _joined(a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
    """Exact ranks of the sequences that ``a`` ranks at i followed by those that ``b`` ranks at i + at."""
    n = min(len(a), len(b) - at)
    pairs = a[:n] * np.int64(len(b) + 1) + b[at : at + n]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def _band(n: int) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in BANDS if n < below)


def measured(text: str, compressor: zstandard.ZstdCompressor, min_words: int = 20, max_repeat_percent: int = 30) -> tuple:
    """The columns of ``_FIELDS`` for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space only
    word_chars = len(text) - sum(raw.count(b) for b in _BLANKS)
    n_symbols = sum(raw.count(b) for b in _SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    failed = len(words) < min_words or 100 * n_repeat > max_repeat_percent * len(words)
    ratio, out, out_bytes, n_chunks = 1.0, 0, 0, -(-len(raw) // CHUNK_BYTES)
    good = True
    if raw:
        ratio = len(raw) / len(compressor.compress(raw))
        lo, hi = _band(len(raw))
        good = lo <= ratio <= hi
        if n_chunks > 1:
            for k in range(n_chunks):
                piece = raw[k * CHUNK_BYTES : (k + 1) * CHUNK_BYTES]
                lo, hi = _band(len(piece))
                if not lo <= len(piece) / len(compressor.compress(piece)) <= hi:
                    out, out_bytes = out + 1, out_bytes + len(piece)
            good = good and out_bytes <= CHUNK_SHARE * len(raw)
    return len(words), word_chars, n_symbols, n_dup, n_repeat, ratio, out, n_chunks, failed, not failed and good


def quality_rules(docs: DataFrame, text_col: str = "text", level: int = 3, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) plus a struct ``quality`` with counts, ratios and verdict.

    One narrow pass without a shuffle. A text fails the base rules with under 20
    words or over 30 percent of its words in repeated 8-word windows; it fails
    the compression bands if its zstandard ratio lies outside the limits for its
    length, or if more than half of its bytes are in 4,096-byte chunks that do; the
    last chunk is as long as is left. Null and
    empty texts have no words and fail. Rows are judged one by one, so repeated
    rows change nothing; an input column called ``quality`` is replaced, others
    pass through; an empty table gives an empty table.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() != "quality"]
    given = docs.select(text_of(text_col).alias("__text"), *names)
    schema = StructType([*given.schema.fields[1:], StructField("quality", StructType.fromDDL(_DDL))])
    fields = pa.struct(_FIELDS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            found = [measured(t, compressor) for t in batch.column(0).to_pylist()]
            columns = list(zip(*found, strict=True)) or [[] for _ in _FIELDS]
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.StructArray.from_arrays(arrays, fields=list(fields))], [*names, "quality"])

    return given.mapInArrow(run, schema)


def op10_quality_rules(spark, sf_dir):
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, carry=["doc_id"]).select("doc_id", "quality.*")
