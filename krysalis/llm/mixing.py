"""Language-model scoring by online logistic context mixing, with contexts across words."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krysalis.functions.lineage import discard
from krysalis.llm.common import bucketed, drop_shuffles, materialize, text_of
from krysalis.llm.spelling import SLOT_BITS, Speller

#: Text of a block and of a bucket; words of a block that a bucket gets at least.
BLOCK_BYTES, BUCKET_BYTES, LEAST_RUN = 1 << 23, 1 << 24, 32
#: With more classes of text, each a predictor, blocks, buckets and what is scored side by side are smaller by as much.
CLASSES = 16
#: A word is a context of its own up to this many training occurrences: whatever their number.
RARE = float("inf")
#: Pairs of words that are added up at a time, beside those that differ.
PAIRS = 1 << 21
#: Up to so many new words the speller learns in one pass on the driver; of more, each bucket learns its own and weights are averaged.
ONE_PASS = 20_000
#: Bins of the rate of new words in a document, by eighths of log-odds, and the weight of a fit's start.
RATES, RIDGE = 192, 16.0
#: Cells of the refinement, and its prior weight; step of the weights of a document.
CELLS, KAPPA, STEP, CALM = 24, 12.0, 0.6, 24.0
#: Earlier words of the document among equal codes count against this many of the corpus.
BACKOFF = 60.0
#: Tokens and documents that are scored side by side at most, and tokens of them in a piece.
SIDE_TOKENS, SIDE_DOCS, PIECE = 1 << 17, 1 << 12, 1 << 14
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.int64(-1)
_PATH = np.array([[(1 << b) | (c >> (8 - b)) for b in range(8)] for c in range(256)])
_BITS = np.array([[c >> (7 - b) & 1 for b in range(8)] for c in range(256)], np.float32)


#: The source of a guess by what there is (a word inside the document, over the corpus, both alike, one word's alike, one word's), and binary logarithms rounded up, 7 at most.
_SOURCES = np.array([(1 if k & 4 else 2) if k & 3 == 3 else 3 if k & 1 else (4 if k & 8 else 5 if k & 16 else 6) if k & 2 else 7 if k & 16 else 0 for k in range(32)])
_LOGS = np.minimum(7, np.ceil(np.log2(np.arange(128) + 1))).astype(np.int64)


def _packed(a: np.ndarray) -> bytes:
    """An array by bytes of equal weight, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T))


def _unpacked(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return raw.reshape(size, -1).T.copy().view(kind).reshape(-1) if size > 1 and len(raw) else raw.view(kind)


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _unpack_words(b: bytes, n: int) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(b).split(b" ") if n else []


def word_hashes(words: list[bytes] | np.ndarray) -> np.ndarray:
    """64 bits a word: 24 name it as a successor, 8 more are its code."""
    given = np.empty(len(words), object)
    given[:] = words
    return pd.util.hash_array(given, categorize=False)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    if len(new):
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(_firsts(keys))
    return keys[first], np.diff(np.r_[first, len(keys)])


def top_two(ctx: np.ndarray, succ: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs sorted by context: ``(contexts, best, its count, next best, its count, all)``; ties go to the smaller name."""
    first = np.flatnonzero(_firsts(ctx))
    if not len(first):
        return ctx, succ, times, succ, times, times
    size = np.diff(np.r_[first, len(ctx)])
    key = times.astype(np.int64) << 24 | (0xFFFFFF - succ)
    best = np.maximum.reduceat(key, first)
    second = np.full(len(first), 0xFFFFFF)  # no name, no count
    many = size > 1
    rest = key[np.repeat(many, size)]
    rest[rest == np.repeat(best[many], size[many])] = -1
    if len(rest):
        second[many] = np.maximum.reduceat(rest, np.cumsum(size[many]) - size[many])
    return ctx[first], *(x for k in (best, second) for x in (0xFFFFFF - (k & 0xFFFFFF), k >> 24)), np.add.reduceat(times, first)


class Block:
    """Documents of one block as numbers of the block's words; number 0 is the end."""

    def __init__(self):
        self.ids, self.held, self.group, self.texts, self.sizes, self.size = [], [], [], [], [], 0

    def add(self, doc, held: bool, group: int, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        self.texts.append(raw.lower())
        self.ids.append(doc)
        self.held.append(held)
        self.group.append(group)
        self.sizes.append(len(raw))
        self.size += len(raw) + 64

    def numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words with the end first, all texts by their numbers with an end each, and tokens by text."""
        split = pc.ascii_split_whitespace(pa.array(self.texts, pa.large_binary()).cast(pa.large_string(), safe=False))
        words = split.flatten()
        is_word = pc.not_equal(pc.binary_length(words), 0)
        coded = words.filter(is_word).cast(pa.large_binary()).dictionary_encode()
        upto = np.r_[0, np.cumsum(is_word.to_numpy(zero_copy_only=False))]
        n = np.diff(upto[split.offsets.to_numpy()]) + 1
        codes = np.zeros(len(coded) + len(n), np.int32)
        inner = np.ones(len(codes), bool)
        inner[np.cumsum(n) - 1] = False
        codes[inner] = coded.indices.to_numpy() + 1
        words = np.empty(len(coded.dictionary) + 1, object)
        words[0], words[1:] = b"", coded.dictionary.to_numpy(zero_copy_only=False)
        return words, codes, n

    def row(self, block: int, fit: bool, buckets: int, groups: int) -> pa.RecordBatch:
        words, codes, n = self.numbered()
        hashes = word_hashes(words)
        bucket = (hashes & np.uint64(0xFFFFFF)).astype(np.int64) % buckets  # words of equal name meet
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words))
        codes = rank[codes]
        words = words[order].tolist()
        doc = np.repeat(np.arange(len(n)), n)
        train = ~np.array(self.held, bool)[doc]
        group = np.where(train, np.array(self.group)[doc], groups)
        times = np.bincount(codes.astype(np.int64) * (groups + 1) + group, minlength=len(words) * (groups + 1)).reshape(-1, groups + 1)[:, :groups]
        pairs = _distinct(codes[train].astype(np.int64) * len(n) + doc[train])[0] // len(n)
        in_docs = np.minimum(2, np.bincount(pairs, minlength=len(words))).astype(np.uint8)
        # what follows words
        succ = (hashes[order] & np.uint64(0xFFFFFF)).astype(np.int64)
        ends = np.cumsum(n) - 1
        inner = train.copy()
        inner[ends] = False
        at = np.flatnonzero(inner)
        pair, many = _distinct(codes[at].astype(np.int64) << 24 | succ[codes[at + 1]])
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        cuts = np.searchsorted(pair >> 24, edges)
        sent = []
        for k in range(buckets):
            a, b, c, d = edges[k], edges[k + 1], cuts[k], cuts[k + 1]
            sent.append((b - a, _pack_words(words[a:b]), _packed(times[a:b].T.astype(np.int32)), _packed(in_docs[a:b]), _packed(((pair[c:d] >> 24) - a).astype(np.int32)), _packed((pair[c:d] & 0xFFFFFF).astype(np.int32)), _packed(many[c:d].astype(np.int32))))
        names = ["n_words", "words", "times", "in_docs", "before", "after", "often"]
        kinds = [pa.int32(), *[pa.binary()] * 6]
        columns = [
            pa.array([block], pa.int64()), pa.array([fit], pa.bool_()), pa.array([self.ids], pa.list_(pa.int64())), pa.array([self.held], pa.list_(pa.bool_())), pa.array([self.group], pa.list_(pa.int32())),
            pa.array([n], pa.list_(pa.int32())), pa.array([self.sizes], pa.list_(pa.int64())), pa.array([_packed(codes)], pa.binary()), *(pa.array([list(c)], pa.list_(t)) for c, t in zip(zip(*sent, strict=True), kinds, strict=True)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "fit", "ids", "held", "kind", "n", "sizes", "codes", *names])


_SENT = ("n_words", "words", "times", "in_docs", "before", "after", "often")
_BLOCK = "block long, fit boolean, ids array<long>, held array<boolean>, kind array<int>, n array<int>, sizes array<long>, codes binary, n_words array<int>, words array<binary>, times array<binary>, in_docs array<binary>, before array<binary>, after array<binary>, often array<binary>"


def _blocks(docs: DataFrame, buckets: int, block_bytes: int, groups: int) -> DataFrame:
    """Rows of some ``block_bytes`` of text; documents that are learned from are in blocks of their own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), count()
        state = {False: Block(), True: Block()}
        for batch in batches:
            for doc, held, group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fit = not held
                state[fit].add(doc, held, group, text)
                if state[fit].size >= block_bytes:
                    yield state[fit].row((task << 32) + next(number), fit, buckets, groups)
                    state[fit] = Block()
        for fit, rest in state.items():
            if rest.ids:
                yield rest.row((task << 32) + next(number), fit, buckets, groups)

    return docs.mapInArrow(run, _BLOCK)


def _added(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, often = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(_firsts(key))
    return key[first], np.add.reduceat(often[order], first) if len(first) else often


def _vocabulary(blocks: DataFrame, groups: int) -> DataFrame:
    """One row per bucket: its words with counts over all training texts by class, what follows them, how often other words of the same name occur, and each block's words as indices."""
    sent = blocks.select("block", F.posexplode(F.arrays_zip(*_SENT)).alias("bucket", "x")).select("block", "bucket", "x.*").filter("n_words > 0")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        number: dict = defaultdict(count().__next__)
        codes = [np.array([*map(number.__getitem__, _unpack_words(words, n))], np.int32) for n, words in zip(part["n_words"], part["words"], strict=True)]
        total, in_docs = np.zeros((groups, len(number)), np.int64), np.zeros(len(number), np.int64)
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for c, row in zip(codes, part.itertuples(index=False), strict=True):
            total[:, c] += _unpacked(row.times, "<i4").reshape(groups, -1)
            in_docs[c] += _unpacked(row.in_docs, "u1")
            pairs.append((c[_unpacked(row.before, "<i4")].astype(np.int64) << 24 | _unpacked(row.after, "<i4"), _unpacked(row.often, "<i4").astype(np.int64)))
            if sum(len(k) for k, _ in pairs[1:]) > max(PAIRS, len(pairs[0][0])):
                pairs = [_added(pairs)]
        key, often = _added(pairs)
        follows, times = np.full(len(number), _NONE), np.zeros(len(number), np.int64)
        w, best, n, *_ = top_two(key >> 24, key & 0xFFFFFF, often)
        follows[w], times[w] = best, n
        words = list(number)
        hashes, seen = word_hashes(words), total.sum(0)
        at = np.unique(hashes & np.uint64(0xFFFFFF), return_inverse=True)[1]
        others = np.bincount(at, seen)[at].astype(np.int64) - seen
        code = (hashes >> np.uint64(24) & np.uint64(255)).astype(np.int64)
        hist = np.stack([[np.bincount(code, t, 256), np.bincount(code, t * (in_docs == 1), 256)] for t in total]).astype(np.int64).reshape(-1)
        row = [int(part["bucket"].iloc[0]), _pack_words(words), len(words), _packed(total), _packed(np.minimum(in_docs, 2).astype(np.uint8)), _packed(follows), _packed(times), _packed(others), hist.tolist(), int(total.sum()), int(total.any(0).sum()), int((in_docs == 1).sum()), list(part["block"]), list(part["n_words"]), _packed(np.concatenate(codes))]
        return pd.DataFrame([row], columns=["bucket", "words", "n_words", "total", "in_docs", "follows", "times", "others", "hist", "n_tokens", "n_known", "n_once", "blocks", "sizes", "codes"])

    ddl = "bucket int, words binary, n_words int, total binary, in_docs binary, follows binary, times binary, others binary, hist array<long>, n_tokens long, n_known long, n_once long, blocks array<long>, sizes array<int>, codes binary"
    return sent.groupBy("bucket").applyInPandas(merge, ddl)


def _once(row) -> list[bytes]:
    """Words of a bucket that one training document has."""
    words, once = _unpack_words(row.words, row.n_words), _unpacked(row.in_docs, "u1") == 1
    return [words[i] for i in np.flatnonzero(once).tolist() if words[i]]


#: Numbers of a table of counts that a row holds, and such rows.
_CHUNK, _COUNTED = 1 << 18, "g int, order int, chunk int, counts binary"


def _chunks(g: int, tables: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame([(g, o, lo // _CHUNK, _packed(t[lo : lo + _CHUNK].astype(np.int64))) for o, t in enumerate(tables) for lo in range(0, len(t), _CHUNK)], columns=["g", "order", "chunk", "counts"])


def _summed(rows: DataFrame, parts: int, sizes: list[int]) -> list[np.ndarray]:
    """Tables of fixed sizes from the ``_chunks`` of ``parts`` parts, added in rounds of 32, so no task adds more whatever their number."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum((_unpacked(c, "<i8") for c in part["counts"]), np.zeros(1, np.int64))
        return pd.DataFrame([(part["g"].iloc[0], part["order"].iloc[0], part["chunk"].iloc[0], _packed(total))], columns=["g", "order", "chunk", "counts"])

    while parts > 1:
        rows = rows.withColumn("g", F.floor(F.col("g") / 32).cast("int")).groupBy("g", "order", "chunk").applyInPandas(add, _COUNTED)
        parts = -(-parts // 32)
    tables = [np.zeros(n, np.int64) for n in sizes]
    for r in rows.collect():
        counts = _unpacked(r["counts"], "<i8")
        tables[r["order"]][r["chunk"] * _CHUNK : r["chunk"] * _CHUNK + len(counts)] = counts
    return tables


def _speller(vocabulary: DataFrame, n_once: int, buckets: int, one_pass: int = ONE_PASS) -> Speller:
    """Bit counts of all words that occur in one document, and weights fitted on all of them."""

    def count_bits(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                words = _once(row)
                into = [np.zeros(2 << b, np.int32) for b in SLOT_BITS]
                Speller().count(words, np.ones(len(words), np.int64), into)
                yield _chunks(row.bucket, into)

    known = vocabulary.select("bucket", "words", "n_words", "in_docs")
    step = min(10.0, 255 / np.log2(64 * n_once + 2))
    tables = [np.minimum(255, np.round(step * np.log2(1 + t))).astype(np.uint8) for t in _summed(known.mapInPandas(count_bits, _COUNTED), buckets, [2 << b for b in SLOT_BITS])]
    speller = Speller(tables=tables, step=step)
    in_order = lambda words: sorted(words, key=lambda w: (zlib.crc32(w), w))
    if n_once <= one_pass:
        found = known.mapInPandas(lambda parts: (pd.DataFrame({"w": _once(row)}) for part in parts for row in part.itertuples(index=False)), "w binary").collect()
        speller.fit(in_order(bytes(r["w"]) for r in found))
        return speller
    begun = vocabulary.sparkSession.sparkContext.broadcast(speller)

    def learn(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                yield pd.DataFrame({"learned": [begun.value.learned(in_order(_once(row)))]})

    rows = known.mapInPandas(learn, "learned array<double>").select(F.posexplode("learned").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    speller.take(np.array([r["x"] for r in sorted(rows, key=lambda r: r["k"])]))
    return speller


def contexts(hashes: np.ndarray, codes: np.ndarray, n: np.ndarray, ctx_bits: int) -> np.ndarray:
    """For each token the hash of the two words before it; a document's first words follow its begin."""
    h = hashes[codes]
    one, two = np.r_[np.uint64(0), h[:-1]], np.r_[np.uint64(0), np.uint64(0), h[:-2]][: len(h)]
    start = np.cumsum(n) - n
    one[start] = 1
    two[start] = 0
    two[start[n > 1] + 1] = 1
    mixed = (one * _K1 ^ two * _K2) * _K1
    mixed ^= mixed >> np.uint64(29)
    return (mixed * _K2) >> np.uint64(64 - ctx_bits)


def _tokens(row, ctx_bits: int):
    """``(codes, n, train by document, hashes, contexts, successor names)`` of a block."""
    words = [w for k, part in zip(row.n_words, row.words, strict=True) for w in _unpack_words(part, k)]
    codes, n = _unpacked(row.codes, "<i4"), np.array(row.n, np.int64)
    hashes = word_hashes(words)
    succ = (hashes & np.uint64(0xFFFFFF)).astype(np.int64)
    return codes, n, ~np.array(row.held, bool), hashes, contexts(hashes, codes, n, ctx_bits), succ


def _own_pairs(ctx: np.ndarray, succ: np.ndarray, train: np.ndarray, ctx_bits: int) -> tuple[np.ndarray, ...]:
    """The block's distinct contexts, each token's number among them, and the distinct (number, successor, times in training texts)."""
    bits = int(len(ctx)).bit_length()
    if ctx_bits + bits < 64:  # sorted with their places
        packed = np.sort(ctx << np.uint64(bits) | np.arange(len(ctx), dtype=np.uint64))
        order, ordered = (packed & np.uint64((1 << bits) - 1)).astype(np.int64), packed >> np.uint64(bits)
    else:
        order = np.argsort(ctx)
        ordered = ctx[order]
    new = _firsts(ordered)
    which = np.empty(len(ctx), np.int64)
    which[order] = np.cumsum(new) - 1
    pair, times = _distinct(which[train] << 24 | succ[train])
    return ordered[new], which, pair >> 24, pair & 0xFFFFFF, times


def _context_replies(blocks: DataFrame, buckets: int, ctx_bits: int) -> DataFrame:
    """By block and bucket: which of the block's contexts other blocks have as well, and these contexts' two best successors over all texts."""

    def send(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                codes, n, train, _, ctx, succ = _tokens(row, ctx_bits)
                every, _, at, after, times = _own_pairs(ctx, succ[codes], np.repeat(train, n), ctx_bits)
                edges = np.searchsorted(every, _edges(buckets, ctx_bits))
                cuts = np.searchsorted(at, edges)
                out = []
                for k, (a, b, c, d) in enumerate(zip(edges, edges[1:], cuts, cuts[1:], strict=False)):
                    if b > a:
                        own = np.bincount(at[c:d] - a, minlength=b - a)
                        out.append((row.block, k, _packed(np.diff(every[a:b], prepend=np.uint64(0))), _packed(own.astype(np.uint32)), _packed(_three(after[c:d])), _packed(times[c:d].astype(np.uint32))))
                yield pd.DataFrame(out, columns=["block", "bucket", "ctx", "own", "after", "times"])

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        asked = [np.cumsum(_unpacked(c, "<u8"), dtype=np.uint64) for c in part["ctx"]]
        own = [_unpacked(c, "<u4").astype(np.int64) for c in part["own"]]
        ctx = np.concatenate([np.repeat(c, n) for c, n in zip(asked, own, strict=True)])
        after = np.concatenate([_numbers(_unpacked(c, "u1")).astype(np.int32) for c in part["after"]])
        times = np.concatenate([_unpacked(c, "<u4") for c in part["times"]])
        order = np.argsort(ctx)
        ctx = ctx[order]
        new = _firsts(ctx)
        many = ~(new & np.r_[new[1:], True]) if len(new) else new
        order[many] = order[many][np.argsort((np.cumsum(new)[many] << 24) | after[order[many]])]
        after, times = after[order], times[order]
        first = np.flatnonzero(_firsts(ctx, after))
        merged = np.add.reduceat(times, first, dtype=np.int64) if len(first) else times.astype(np.int64)
        ctx, after = ctx[first], after[first]
        del order, new, many, times
        known, *best = top_two(ctx, after, merged)
        out = []
        for block, c, n, a, t in zip(part["block"], asked, own, part["after"], part["times"], strict=True):
            pair, many = np.repeat(np.arange(len(c)), n), _unpacked(t, "<u4")
            mine = np.bincount(pair, many, len(c)).astype(np.int64)
            at = np.minimum(np.searchsorted(known, c), max(len(known) - 1, 0))
            total = np.where(known[at] == c, best[4][at], 0) if len(known) else np.zeros(len(c), np.int64)
            more = total > mine
            own1 = np.bincount(pair, many * (_numbers(_unpacked(a, "u1")) == best[0][at[pair]]), len(c)).astype(np.int64) if len(known) else mine
            at, own1 = at[more], own1[more]
            s1, n1, s2, n2, total = (b[at] for b in best)
            wins = n1 - own1 < n2  # the next best can only be the best without a document of this block
            out.append((block, part["bucket"].iloc[0], np.packbits(more).tobytes(), len(c), _packed(_three(s1)), _packed(_three(np.where(wins, s2, 0))), _packed(n1), _packed(np.where(wins, n2, 0)), _packed(total - n1)))
        return pd.DataFrame(out, columns=["block", "bucket", "more", "n", "s1", "s2", "n1", "n2", "rest"])

    ddl = "block long, bucket int, ctx binary, own binary, after binary, times binary"
    sent = blocks.select("block", "held", "n", "codes", "n_words", "words").mapInPandas(send, ddl)
    return sent.groupBy("bucket").applyInPandas(meet, "block long, bucket int, more binary, n int, s1 binary, s2 binary, n1 binary, n2 binary, rest binary")


def _edges(buckets: int, ctx_bits: int) -> np.ndarray:
    return np.array([(k << ctx_bits) // buckets for k in range(buckets)] + [1 << ctx_bits], np.uint64)


def _three(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^24 as their bytes, by weight."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.copy().reshape(-1) if len(x) else np.zeros(0, np.uint8)


def _numbers(b: np.ndarray) -> np.ndarray:
    p = b.reshape(3, -1).astype(np.int64)
    return p[0] | p[1] << 8 | p[2] << 16


def _ranks(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(order, group of each sorted row, first rows, place within the group)`` of rows sorted by key, document and place; they come by document."""
    bits = int(len(key)).bit_length()
    packed = np.sort(key.astype(np.int64) << bits | np.arange(len(key)))
    order = packed & ((1 << bits) - 1)
    new = _firsts(packed >> bits, doc[order])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order, group, first, np.arange(len(order)) - first[group] if len(order) else group


def _counted(order: np.ndarray, group: np.ndarray, first: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """For each row how many of its group are hits."""
    out = np.empty(len(order), np.int64)
    out[order] = (np.add.reduceat(hit[order].astype(np.int64), first) if len(first) else first)[group]
    return out


def _parts(groups: int) -> int:
    return -(-groups // CLASSES)


def features(row, told: dict, ctx_bits: int) -> Iterator[dict]:
    """What each token's bits are predicted from, for documents that are scored side by side.

    ``told`` has the block's words' counts and successors, and its contexts'
    best successors; contexts that no other block has are looked up in the block.
    """
    codes, n, train, hashes, ctx, succ = _tokens(row, ctx_bits)
    every, which, at, pair, times = _own_pairs(ctx, succ[codes], np.repeat(train, n), ctx_bits)
    best = [np.zeros(len(every), np.int64) for _ in range(5)]
    c, *mine = top_two(at, pair, times)
    for k in range(5):
        best[k][c] = mine[k]
        best[k][told["more"]] = told["best"][k]
    told = {k: v for k, v in told.items() if k not in ("best", "more")}
    del ctx, every, at, pair, times, c, mine  # memory
    which, seen = which.astype(np.int32), told["total"].sum(0)
    order = np.argsort(succ, kind="stable")
    same = succ[order][1:] == succ[order][:-1]
    others = told.get("others", np.zeros(len(succ), np.int64))
    clash = others > 0
    clash[order[1:][same]] = clash[order[:-1][same]] = True
    told = told | {"counts": told["total"].astype(np.float32), "others": others, "clash": clash}
    kind = np.array(row.kind)
    ends = np.cumsum(n)
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = min(max(lo + 1, int(np.searchsorted(ends, base + SIDE_TOKENS // _parts(len(told["total"])), "right"))), lo + SIDE_DOCS)
        t = slice(base, ends[hi - 1])
        yield _side(codes[t], n[lo:hi], train[lo:hi], kind[lo:hi], hashes, succ, which[t], best, told, seen)
        lo = hi


def _side(codes, n, train, kind, hashes, succ, which, best, told, seen) -> dict:
    """``features`` of some documents, each left out of all counts but for what came before in it.

    A guess of the next word comes from the same two words earlier in the
    document, else from two words over the corpus, else from one word over the
    corpus.
    """
    doc = np.repeat(np.arange(len(n)), n)
    trained = train[doc]
    after = succ[codes]
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    # words
    order, group, first, place = _ranks(codes, doc)
    earlier = np.empty(len(codes), np.int64)
    earlier[order] = place
    own = np.empty(len(codes), np.int64)
    own[order] = np.diff(np.r_[first, len(codes)])[group]
    own = np.where(trained, own, 0)
    code8 = (hashes >> np.uint64(24) & np.uint64(255)).astype(np.int64)[codes]
    order, _, _, place = _ranks(code8, doc)
    same_code = np.empty(len(codes), np.int64)
    same_code[order] = place
    # two words before
    order, group, first, place = _ranks(which, doc)
    s1, n1, s2, n2, total = (b[which] for b in best)
    n1 = n1 - np.where(trained, _counted(order, group, first, after == s1), 0)
    n2 = n2 - np.where(trained, _counted(order, group, first, after == s2), 0)
    total = total - np.where(trained, _counted(order, group, first, np.ones(len(codes), bool)), 0)
    swap = n2 > n1
    guess, often = np.where(swap, s2, s1), np.maximum(n1, n2)
    rest = np.maximum(0, total - often)
    before = np.r_[0, after[order][:-1]] if len(order) else after
    inside = np.empty(len(codes), np.int64)
    inside[order] = np.where(place > 0, before, _NONE)
    # one word before
    has = pos > 0
    prev = np.where(has, np.r_[np.int32(0), codes[:-1]], len(succ))  # the begin is a word of its own
    order, group, first, _ = _ranks(prev, doc)
    prev = np.where(has, prev, 0)
    s0 = np.where(has, told["follows"][prev], _NONE)
    n0 = np.where(has, told["times"][prev], 0) - np.where(trained, _counted(order, group, first, has & (after == s0)), 0)
    s0 = np.where(n0 > 0, s0, _NONE)
    corpus = np.where(often > 0, guess, _NONE)
    source = _SOURCES[(inside >= 0) + 2 * (corpus >= 0) + 4 * (inside == corpus) + 8 * (s0 == corpus) + 16 * (s0 >= 0)]
    said = np.where(inside >= 0, inside, np.where(corpus >= 0, corpus, s0))
    known = seen[codes] - own + earlier > 0
    hit = (source > 0) & (said == after) & known
    often = np.where(source == 7, n0, np.where(corpus >= 0, often, 0))
    rest = np.where(source == 7, np.maximum(0, seen[prev] - np.r_[0, own[:-1]] - n0), rest)
    # hits in a row before, over the document's guesses
    guessed = np.flatnonzero(source > 0)
    run = np.zeros(len(codes), np.int64)
    if len(guessed):
        y, d = hit[guessed], doc[guessed]
        k = np.arange(len(guessed))
        begin = np.maximum.accumulate(np.where(_firsts(d), k, 0))
        miss = np.maximum.accumulate(np.where(~y, k, -1))
        last = np.r_[-1, miss[:-1]]
        run[guessed] = k - np.maximum(begin, last + 1)
    log = lambda x: _LOGS[np.clip(x, 0, 127)]
    before = np.where(has, (hashes >> np.uint64(32) & np.uint64(255)).astype(np.int64)[prev], 0)
    match = np.stack([(source * 8 + log(often)) * 8 + log(rest), source * 16 + np.minimum(run, 15), source * 256 + before]).T
    counts = np.take(told["counts"], codes, 1)
    counts[kind[doc], np.arange(len(codes))] -= own
    return {
        "n": n, "doc": doc, "pos": pos, "code": code8, "hit": hit, "source": source, "match": match, "counts": counts, "earlier": earlier, "same_code": same_code,
        "known": known, "flags": _flags(source, known, pos), "spelt": told["spelt"][codes], "total": seen[codes],
        "alike": _alike(codes, doc, trained, after, own, earlier, told, seen),
    }


def _alike(codes, doc, trained, after, own, earlier, told, seen) -> np.ndarray:
    """For each token what share its word has of all occurrences of its name, in other training texts and before in the document: a name that comes may be that of several words."""
    out = np.ones(len(codes))
    at = np.flatnonzero(told["clash"][codes])
    if len(at):
        order, group, first, place = _ranks(after[at], doc[at])
        before, mine = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        before[order], mine[order] = place, np.diff(np.r_[first, len(at)])[group]
        word = seen[codes[at]] - own[at] + earlier[at]
        every = (seen + told["others"])[codes[at]] - np.where(trained[at], mine, 0) + before
        out[at] = word / np.maximum(every, 1)
    return out


def _flags(source: np.ndarray, known: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Five bits: whether there is a guess, and which of the four tokens before were new."""
    flags = (source > 0).astype(np.uint8)
    new = (~known).astype(np.uint8)
    for k in (1, 2, 3, 4):
        flags <<= 1
        flags[k:] |= new[:-k] & (pos[k:] >= k)
    return flags


def _fresh(known: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each token the new words before it in its document."""
    new = np.cumsum(~known) - ~known
    return new - np.repeat(new[np.cumsum(n) - n], n)


#: What ``Model.outcomes`` gives for each token (``over``, the class beyond a byte, with more than 256 classes only), for those with a guess and for those whose code is asked for; a byte each.
_OUTCOMES = ("state", "run", "top", "over", "how", "before", "code")
#: What stands beside them by document.
_MEASURED = ("ids", "held", "n", "sizes", "known", "base", "fixed")


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-5, 1 - 1e-5)
    return np.log(p / (1 - p))


class Model:
    """Bit predictors mixed by gated weights and refined, document by document.

    A token is one bit, whether the guessed name comes and which known word of that name it is, else a bit for whether
    other texts or the document have the word, then eight bits of its code and
    the word among those of its code, or its spelling. The bits of the guess are
    predicted by hashed contexts, those of the code by the classes' counts.
    Weights start as fitted, by gate, and learn in every document in order: all
    bits of a stretch are predicted from what was learned before it, and
    stretches grow with the place in the document. So does the refinement.
    """

    def __init__(self, hist: np.ndarray, shares: np.ndarray):
        """``hist[class, 0 or 1, code]``: training tokens of the code, and those of words that one document has."""
        self.groups = len(hist)
        self.hist = hist.astype(np.float64)
        self.shares = np.log(shares)
        nodes = np.zeros((self.groups, 512))
        nodes[:, 256:] = self.hist[:, 0] - self.hist[:, 1]
        for k in range(255, 0, -1):
            nodes[:, k] = nodes[:, 2 * k] + nodes[:, 2 * k + 1]
        one, zero = nodes[:, 2 * _PATH + 1], nodes[:, 2 * _PATH]
        self.path = np.concatenate([np.log((one + 0.4) / (zero + 0.4)), np.full((1, 256, 8), 0.3)]).transpose(1, 2, 0).astype(np.float32)
        self.size = self.hist[:, 0] + 1  # all tokens of a code: the shares of its words sum to one at most
        once, every = self.hist.sum(2).T[::-1]
        self.fresh = _logit((once + 0.5) / (every + 1))
        g = self.groups
        self.weights = {"match": np.tile([0.5, 0.3, 0.2, 0.0], (8, 1)), "code": np.concatenate([np.eye(g), np.zeros((g, 1))], 1), "known": np.tile([0.4, 0.2, 0.4, 0.0], (g, 1))}
        self.tables = [np.zeros(k) for k in (8 * 64, 8 * 16, 8 * 256, 2 * 16)]
        middle = 1 / (1 + np.exp(-(np.arange(CELLS) - CELLS // 2) / 1.5))
        self.refined = {k: middle.copy() for k in self.weights}

    def classes(self, f: dict) -> np.ndarray:
        """Chance of each class, by class and token, from the tokens before."""
        each = np.log(f["counts"] + np.float32(0.05))
        each -= np.log(self.hist[:, 0].sum(1) + 1000.0).astype(np.float32)[:, None]
        total = np.zeros(each.shape)
        np.cumsum(each[:, :-1], 1, np.float64, total[:, 1:])
        start = np.cumsum(f["n"]) - f["n"]
        total += np.take(self.shares[:, None] - total[:, start], f["doc"], 1)
        total -= total.max(0)
        p = np.exp(total.astype(np.float32))
        p *= np.float32(0.998) / p.sum(0)
        p += np.float32(0.002 / self.groups)
        return p

    @staticmethod
    def _top(pi: np.ndarray) -> np.ndarray:
        """The first of the likeliest classes."""
        best, top = pi[0].copy(), np.zeros(pi.shape[1], np.uint8 if len(pi) <= 256 else np.int32)
        for g in range(1, len(pi)):
            top[pi[g] > best] = g
            np.maximum(best, pi[g], out=best)
        return top

    def outcomes(self, f: dict) -> dict:
        """What the mixed bits of the tokens are predicted from, and ``fixed``, the bits by token that no weight changes: spellings, and words among those of their code or of their name."""
        pi = self.classes(f)
        top = self._top(pi)
        m, k = np.flatnonzero(f["source"] > 0), np.flatnonzero(f["known"] & ~f["hit"])
        code = f["code"][k]
        share = np.zeros(len(k), np.float32)
        for g in range(self.groups):
            share += pi[g][k] * f["counts"][g][k] * (1 / self.size[g]).astype(np.float32)[code]
        p = (BACKOFF * share.astype(np.float64) + f["earlier"][k]) / (BACKOFF + f["same_code"][k])
        fixed = np.where(f["known"], 0.0, f["spelt"])
        fixed[k] -= np.log2(np.clip(p, 1e-12, 1))
        named = np.flatnonzero(f["hit"] & (f["alike"] < 1))
        fixed[named] -= np.log2(f["alike"][named])
        byte = lambda x: x.astype(np.uint8)
        match = f["match"]
        return {
            "n": f["n"], "fixed": fixed, "state": byte(f["source"] | f["hit"].astype(np.int64) << 3 | f["known"].astype(np.int64) << 4), "run": byte(match[:, 1] & 15), "top": byte(top & 255), "over": byte(top >> 8 if self.groups > 256 else top[:0]),
            "how": byte(match[m, 0] & 63), "before": byte(match[m, 2] & 255), "code": byte(code),
        }

    @staticmethod
    def _class(o: dict) -> np.ndarray:
        """The likeliest class of each token."""
        return o["top"] | o["over"].astype(np.int32) << 8 if len(o["over"]) else o["top"]

    def bits(self, f: dict) -> np.ndarray:
        """Bits of each token."""
        o = self.outcomes(f)
        return o["fixed"] + self.mixed(o)

    def mixed(self, o: dict) -> np.ndarray:
        """Bits of each token by guess, known word and code."""
        n = o["n"]
        doc = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        step = stretches(np.arange(pos.max() + 1)).astype(np.uint8)[pos] if len(pos) else pos
        source, hit, known, top = o["state"] & 7, o["state"] >> 3 & 1 > 0, o["state"] >> 4 > 0, self._class(o)
        cost = np.zeros(len(doc))
        m = np.flatnonzero(source)
        at = source[m].astype(np.int64)
        cost[m] = self._bits("match", self.match_inputs(at * 64 + o["how"], at * 16 + o["run"][m], at * 256 + o["before"])[:, None], hit[m, None], at, doc[m], step[m])
        i = np.flatnonzero(~hit)
        rates = self.rates(top[i], _fresh(known, n)[i], pos[i])
        cost[i] += self._bits("known", self.known_inputs(top[i], _flags(source, known, pos)[i], rates)[:, None], known[i, None], top[i], doc[i], step[i])
        i = i[known[i]]
        cost[i] += self._bits("code", o["code"], np.unpackbits(o["code"][:, None], axis=1), top[i], doc[i], step[i])
        return cost

    def _bits(self, kind: str, inputs: np.ndarray, y: np.ndarray, gate: np.ndarray, doc: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Bits that outcomes ``y[token, bit]`` take, by token; each stretch teaches the next. Tokens are sorted by document, ``inputs`` theirs or, for codes, the codes."""
        order = np.argsort(step, kind="stable")
        inputs, y, gate, doc, step = inputs[order], y[order].astype(np.int64), gate[order], doc[order], step[order]
        n_docs, wide, refined = int(doc.max()) + 1 if len(doc) else 0, y.shape[1], (self.refined[kind] * KAPPA).astype(np.float32)
        moved = np.zeros((n_docs, self.weights[kind].shape[1]), np.float32)
        hits, seen = np.zeros((n_docs, CELLS), np.float32), np.zeros((n_docs, CELLS), np.float32)
        weights, out = self.weights[kind].astype(np.float32), np.empty(len(doc))
        runs = np.flatnonzero(_firsts(step, doc))  # a stretch is taken in pieces of whole runs of a document, which fit a cache
        edges = np.r_[runs[_firsts(step[runs], runs // PIECE)], len(doc)]
        for a, b in zip(edges, edges[1:], strict=False):
            d = doc[a:b]
            new = _firsts(d)
            first = np.flatnonzero(new)
            docs, size = d[first], np.diff(np.r_[first, b - a]) * wide
            x = self.path.take(inputs[a:b], 0) if kind == "code" else inputs[a:b]
            z = np.ascontiguousarray(np.einsum("tbk,tk->tb", x, weights[gate[a:b]] + moved[d]).T)
            cell = np.rint(z * np.float32(1.5)).astype(np.int64)
            np.clip(cell, -(CELLS // 2), CELLS - 1 - CELLS // 2, out=cell)
            cell += (np.cumsum(new) - 1) * CELLS + CELLS // 2
            np.clip(z, np.float32(-20), np.float32(20), out=z)
            np.exp(np.negative(z, out=z), out=z)
            z += 1
            p = np.reciprocal(z, out=z)
            right = np.ascontiguousarray(y[a:b].T)
            wrong = (1 - right).astype(np.float32)
            q = ((refined + hits[docs]) / (np.float32(KAPPA) + seen[docs])).reshape(-1)[cell]
            q += p
            q *= np.float32(0.5)
            q -= wrong
            np.abs(q, out=q)
            np.clip(q, np.float32(1e-6), np.float32(1 - 1e-6), out=q)
            q = q if wide == 1 else q[: wide // 2] * q[wide // 2 :]
            out[a:b] = np.log(q if wide == 1 else q[::2] * q[1::2]).sum(0)
            slope = np.einsum("tb,tbk->tk", np.ascontiguousarray((1 - wrong - p).T), x)
            moved[docs] += np.float32(STEP) * np.add.reduceat(slope, first) / (size[:, None] + CALM).astype(np.float32)
            cell *= 2
            cell += right
            came = np.bincount(cell.reshape(-1), minlength=2 * len(docs) * CELLS).reshape(-1, CELLS, 2).astype(np.float32)
            hits[docs] += came[:, :, 1]
            seen[docs] += came.sum(2)
        bits = np.empty(len(doc))
        bits[order] = out * (-1 / np.log(2))
        return bits

    def match_inputs(self, *at: np.ndarray) -> np.ndarray:
        return np.stack([*(t.astype(np.float32)[k] for t, k in zip(self.tables, at, strict=False)), np.full(len(at[0]), 0.3, np.float32)], 1)

    def rates(self, top: np.ndarray, fresh_in_doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Log-odds of a new word by the share of those before in the document."""
        return _logit((fresh_in_doc + (8 / (1 + np.exp(-self.fresh)))[top]) / (pos + 8))

    def known_inputs(self, top: np.ndarray, flags: np.ndarray, rates: np.ndarray) -> np.ndarray:
        return -np.stack([self.fresh[top], self.tables[3][flags], rates, np.full(len(top), -0.3)], 1).astype(np.float32)

    def sizes(self) -> list[int]:
        """Lengths of what ``tally`` counts: the guess by its contexts and outcome, the known word by class, flags, rate and outcome, codes by class."""
        return [len(self.tables[0]) * 16 * 256 * 2, self.groups * 32 * RATES * 2, self.groups * 256]

    def tally(self, o: dict, into: list[np.ndarray]) -> None:
        """Add to ``into`` all that a fit needs of the ``outcomes`` of tokens."""
        n = o["n"]
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        source, hit, known, top = o["state"] & 7, o["state"] >> 3 & 1, o["state"] >> 4, self._class(o)
        m, i = np.flatnonzero(source), np.flatnonzero(hit == 0)
        cells = [(((source[m].astype(np.int64) * 64 + o["how"]) * 16 + o["run"][m]) * 256 + o["before"]) * 2 + hit[m]]
        rate = np.clip(np.round(self.rates(top, _fresh(known > 0, n), pos)[i] * 8) + RATES // 2, 0, RATES - 1).astype(np.int64)
        cells.append(((top[i].astype(np.int64) * 32 + _flags(source, known > 0, pos)[i]) * RATES + rate) * 2 + known[i])
        cells.append(top[i[known[i] > 0]].astype(np.int64) * 256 + o["code"])
        for c, t in zip(cells, into, strict=True):
            if len(c) > len(t) // 8:
                t += np.bincount(c, minlength=len(t))
            else:
                at, n = _distinct(c)
                t[at] += n

    def fit(self, sides: list[dict]) -> None:
        """Fit to the tokens of ``sides``."""
        counts = [np.zeros(n, np.int64) for n in self.sizes()]
        for f in sides:
            self.tally(self.outcomes(f), counts)
        self.fit_counts(counts)

    def fit_counts(self, counts: list[np.ndarray]) -> None:
        """Contexts' hits, first weights and refinement from what ``tally`` counted."""
        match, known, code = counts[0].reshape(8, 64, 16, 256, 2), counts[1].reshape(self.groups, 32, RATES, 2), counts[2]
        sums = [match.sum((2, 3)), match.sum((1, 3)), match.sum((1, 2)), known.sum((0, 2))[:, ::-1]]
        for k, t in enumerate(sums):
            t = t.reshape(-1, 2)
            self.tables[k] = _logit((t[:, 1] + 0.4) / (t.sum(1) + 0.8))
        at = np.flatnonzero(match.reshape(-1, 2).any(1))
        source, run, before = at // (64 * 16 * 256), at // 256 % 16, at % 256
        x = np.stack([self.tables[0][at // 4096], self.tables[1][source * 16 + run], self.tables[2][source * 256 + before], np.full(len(at), 0.3)], 1)
        self._fitted("match", x, source, match.reshape(-1, 2)[at])
        at = np.flatnonzero(known.reshape(-1, 2).any(1))
        top = at // (32 * RATES)
        x = -np.stack([self.fresh[top], self.tables[3][at // RATES % 32], (at % RATES - RATES // 2) / 8, np.full(len(at), -0.3)], 1)
        self._fitted("known", x, top, known.reshape(-1, 2)[at])
        at = np.flatnonzero(code)
        bits = _BITS[at % 256].reshape(-1).astype(np.int64)
        self._fitted("code", self.path[at % 256].reshape(-1, self.groups + 1), np.repeat(at // 256, 8), np.stack([1 - bits, bits], 1) * np.repeat(code[at], 8)[:, None])

    def _fitted(self, kind: str, x: np.ndarray, gate: np.ndarray, times: np.ndarray, turns: int = 12) -> None:
        """Weights of each gate by Newton's steps on rows of inputs that came with outcomes 0 and 1 so many ``times``; then what came of such sums."""
        x, w = x.astype(np.float64), self.weights[kind].astype(np.float64)
        for g in range(len(w)):
            at = np.flatnonzero(gate == g)
            a, hits, seen, start = x[at], times[at, 1], times[at].sum(1), w[g].copy()
            for _ in range(turns if len(at) else 0):
                p = 1 / (1 + np.exp(-np.clip(a @ w[g], -20, 20)))
                slope = a.T @ (hits - seen * p) - RIDGE * (w[g] - start)
                move = np.linalg.solve((a * (seen * p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(start)), slope)
                w[g] += move / max(1.0, np.abs(move).max())
        cell = np.clip(np.round((w[gate] * x).sum(1) * 1.5) + CELLS // 2, 0, CELLS - 1).astype(np.int64)
        self.weights[kind] = w.astype(np.float32)
        self.refined[kind] = (np.bincount(cell, times[:, 1], CELLS) + 8 * self.refined[kind]) / (np.bincount(cell, times.sum(1), CELLS) + 8)


def stretches(pos: np.ndarray) -> np.ndarray:
    """Number of the stretch of each place: 16 tokens each at first, then a quarter more each time."""
    edges = [0]
    while len(pos) and edges[-1] <= pos.max():
        edges.append(edges[-1] + max(16, edges[-1] // 4))
    return np.searchsorted(edges, pos, "right") - 1


def _told(row, groups: int) -> dict:
    """The replies of a block, in the order of its words and contexts."""
    words, ctx = row.by_word, [] if row.by_context is None else row.by_context
    cat = lambda parts, kind, empty=0: np.concatenate([np.zeros(empty, kind), *parts])
    best = [cat(((_numbers(_unpacked(r[c], "u1")) if c[0] == "s" else _unpacked(r[c], "<i8")) for r in ctx), np.int64) for c in ("s1", "n1", "s2", "n2", "rest")]
    return {
        "total": np.concatenate([_unpacked(r["total"], "<i8").reshape(groups, -1) for r in words], 1), "spelt": cat((_unpacked(r["spelt"], "<f4") for r in words), np.float32),
        "follows": cat((_unpacked(r["follows"], "<i8") for r in words), np.int64), "times": cat((_unpacked(r["times"], "<i8") for r in words), np.int64), "others": cat((_unpacked(r["others"], "<i8") for r in words), np.int64),
        "more": cat((np.unpackbits(np.frombuffer(r["more"], np.uint8), count=r["n"]).astype(bool) for r in ctx), bool),
        "best": [*best[:4], best[1] + best[4]],
    }


def mixing_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, block_bytes: int = BLOCK_BYTES, class_col: str | None = None) -> DataFrame:
    """One row per document: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, n_bytes, bits_per_byte``.

    Texts whose ``crc32(id) mod folds`` is ``held_fold`` are not learned from.
    Tokens are the lower-cased words and an end for each text. ``base_score`` is
    the add-one unigram log10 probability. ``score`` is that of ``Model``: of a
    document nothing is known but what the other training texts hold and what
    came before in it. White space counts as one separator, as in the base.
    ``class_col`` (a language, say) gives the predictors of a word's code, one
    for each of its values; a text's own class is not looked at. Counts of a
    word are held for every class, so a task's work grows with their number.

    All counts cover all training texts and grow with them: words by class, and
    what follows each two words and each word. Blocks of text send their
    distinct words and contexts to buckets and get counts and best successors
    back; the blocks stay where they are. Broadcast are only tables of fixed
    size. First weights are fitted on all tokens of all training texts, which a
    pass of its own counts in cells of a fixed number, and the speller on all
    words that one training text has. How documents are dealt out
    changes no score. Null text is empty (the end alone), a null id falls in
    the fold of the empty text. Repeated rows are documents of their own; other
    columns are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    names = [] if class_col is None else [r[0] for r in docs.filter(F.col(class_col).isNotNull()).groupBy(class_col).count().orderBy(F.desc("count"), class_col).collect()]
    group = F.lit(len(names))  # without a class
    if names:
        group = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(class_col)), F.lit(0)) - 1, group)
    groups = len(names) + 1
    block_bytes = max(1, block_bytes // _parts(groups))
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    held = F.crc32(key) % folds == held_fold
    given = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), group.cast("int").alias("kind"), text_of(text_col).alias("text"))
    buckets = int(min(max(6, size * _parts(groups) // BUCKET_BYTES), max(6, block_bytes // (24 * LEAST_RUN))))
    files = int(min(1 << 15, max(12, size * _parts(groups) // BLOCK_BYTES)))
    ctx_bits = int(min(60, max(30, int(size).bit_length() + 2)))
    sent = bucketed(_blocks(given, buckets, block_bytes, groups), "block", files)
    vocabulary = materialize(_vocabulary(sent, groups))
    drop_shuffles(spark)
    blocks = bucketed(sent.select("block", "fit", "ids", "held", "kind", "n", "sizes", "codes", "n_words", "words"), "block", files)
    discard(sent)
    n_tokens, n_known, n_once = (int(x or 0) for x in vocabulary.agg(F.sum("n_tokens"), F.sum("n_known"), F.sum("n_once")).first())
    hist = np.zeros((groups, 2, 256))
    for r in vocabulary.select(F.posexplode("hist").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        hist.reshape(-1)[r["k"]] = r["n"]
    speller = spark.sparkContext.broadcast(_speller(vocabulary, n_once, buckets))
    drop_shuffles(spark)

    def answer(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                words, total, in_docs = _unpack_words(row.words, row.n_words), _unpacked(row.total, "<i8").reshape(groups, -1), _unpacked(row.in_docs, "u1")
                spelt = np.zeros(len(words), np.float32)
                for k in (0, 1):
                    at = [i for i in np.flatnonzero(in_docs == k).tolist() if words[i]]
                    spelt[at] = speller.value.bits_of([words[i] for i in at], left_out=bool(k))
                follows, times, others = (_unpacked(x, "<i8") for x in (row.follows, row.times, row.others))
                codes, at, out = _unpacked(row.codes, "<i4"), 0, []
                for block, n in zip(row.blocks, row.sizes, strict=True):
                    c = codes[at : at + n]
                    at += n
                    out.append((block, row.bucket, _packed(total[:, c]), _packed(spelt[c]), _packed(follows[c]), _packed(times[c]), _packed(others[c])))
                yield pd.DataFrame(out, columns=["block", "bucket", "total", "spelt", "follows", "times", "others"])

    replies = vocabulary.drop("hist").mapInPandas(answer, "block long, bucket int, total binary, spelt binary, follows binary, times binary, others binary")
    words = replies.repartition(files, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "total", "spelt", "follows", "times", "others"))).alias("by_word"))
    words = bucketed(words, "block", files)
    discard(vocabulary)
    drop_shuffles(spark)  # one exchange's files at a time
    answers = _context_replies(blocks, buckets, ctx_bits).repartition(files, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "more", "n", "s1", "n1", "s2", "n2", "rest"))).alias("by_context"))
    answers = bucketed(answers, "block", files)
    drop_shuffles(spark)
    joined = blocks.join(words, "block").join(answers, "block", "left")

    shares = np.maximum(hist[:, 0].sum(1), 1) + 0.5
    model = Model(hist, shares / shares.sum())
    begun = spark.sparkContext.broadcast(model)

    def follow(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Outcomes of the tokens of every block, and counts of those that are learned from."""
        from pyspark import TaskContext

        model, seen = begun.value, None
        for part in parts:
            for row in part.itertuples(index=False):
                done = 0
                for f in features(row, _told(row, groups), ctx_bits):
                    o = model.outcomes(f)
                    if row.fit:
                        seen = [np.zeros(n, np.int64) for n in model.sizes()] if seen is None else seen
                        model.tally(o, seen)
                    start, docs = np.cumsum(f["n"]) - f["n"], slice(done, done + len(f["n"]))
                    done = docs.stop
                    known, base = (np.add.reduceat(x, start) for x in ((f["total"] > 0).astype(np.int64), np.log10((f["total"] + 1) / (n_tokens + n_known + 1))))
                    out = (row.ids[docs], row.held[docs], f["n"], row.sizes[docs], known, base, np.add.reduceat(o["fixed"], start), *(_packed(o[k]) for k in _OUTCOMES))
                    del f, o  # before the next are made
                    yield pd.DataFrame([out], columns=[*_MEASURED, *_OUTCOMES])
        if seen is not None:
            yield _chunks(TaskContext.get().partitionId(), seen)

    measured = "ids array<long>, held array<boolean>, n array<long>, sizes array<long>, known array<long>, base array<double>, fixed array<double>, " + ", ".join(f"{k} binary" for k in _OUTCOMES)
    either = [*_MEASURED, *_OUTCOMES, "g", "order", "chunk", "counts"]
    followed = materialize(joined.mapInPandas(lambda parts: (p.assign(**{k: None for k in either if k not in p})[either] for p in follow(parts)), f"{measured}, {_COUNTED}"))
    model.fit_counts(_summed(followed.filter("counts is not null").select("g", "order", "chunk", "counts"), files, model.sizes()))
    fitted = spark.sparkContext.broadcast(model)
    kinds = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits double, n_bytes long, bits_per_byte double"

    def score(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                n, n_bytes = np.array(row.n), np.array(row.sizes, np.int64)
                o = {"n": n} | {k: _unpacked(getattr(row, k), "u1") for k in _OUTCOMES}
                bits = np.add.reduceat(fitted.value.mixed(o), np.cumsum(n) - n) + row.fixed
                yield pd.DataFrame({
                    "id": pd.array([None if i is None or i != i else int(i) for i in row.ids], "Int64"), "held_out": row.held, "n_tokens": n, "n_known": row.known, "train_tokens": n_tokens,
                    "base_score": row.base, "score": -bits * np.log10(2.0), "bits": bits, "n_bytes": n_bytes, "bits_per_byte": bits / np.maximum(n_bytes, 1),
                })

    return followed.filter("counts is null").select(*_MEASURED, *_OUTCOMES).mapInPandas(score, kinds)


def op3_lm_scoring(spark, sf_dir):
    """Scores of every document."""
    return mixing_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), class_col="lang").withColumnRenamed("id", "doc_id")
