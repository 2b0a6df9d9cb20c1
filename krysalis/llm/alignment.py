"""Alignment of two tokenizers over a corpus: how often their tokens meet, counted under minimal perfect hashes."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krysalis.llm.bpe import _byte_alphabet, tokenizer_path
from krysalis.llm.common import bucketed, materialize, text_of

#: Bytes of text that are aligned together, and the most files that blocks are dealt out to.
BLOCK_BYTES, MOST_FILES = 4 << 20, 4096
#: Parts of the pairs, by their B id: one has the pairs of 125 of 32,000 B ids, each with 50,257 A ids at most.
BUCKETS = 256
#: Pieces and characters that a worker remembers; when full it forgets what it met since then after each batch. Speed only.
CACHE, CACHE_CHARS = 400_000, 1 << 23

_FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Aligned:
    """The alignment of many texts' tokens, laid end to end.

    ``a`` and ``b`` are ids, ``a_size`` and ``b_size`` bytes by id. The ends of
    tokens of both sides cut the bytes into stretches; each lies in one token of
    either side, which are linked there. Groups end where both end, so that one
    text's never reach into the next. ``texts`` are the numbers of bytes of each.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, texts: np.ndarray):
        self.a, self.b = a, b
        ends = np.concatenate([np.cumsum(a_size[a]) << 1, np.cumsum(b_size[b]) << 1 | 1])
        ends.sort(kind="stable")  # two sorted runs: a merge
        place = ends >> 1
        start = np.ones(len(ends), bool)
        start[1:] = place[1:] != place[:-1]
        shared = np.zeros(len(ends), bool)
        shared[:-1] = ~start[1:]
        first, shared = ends[start], shared[start]
        self.ends, has_a, self.shared = first >> 1, (first & 1) == 0, shared
        has_b = ~has_a | shared
        self.of_a, self.of_b = np.cumsum(has_a) - has_a, np.cumsum(has_b) - has_b
        self.links = b[self.of_b].astype(np.int64) << 32 | a[self.of_a]
        self.cuts = np.searchsorted(self.ends, np.concatenate([[0], np.cumsum(texts)]), "right")

    def sums(self, of_links: np.ndarray) -> np.ndarray:
        """By text."""
        total = np.zeros(len(of_links) + 1, np.int64)
        np.cumsum(of_links, out=total[1:])
        return total[self.cuts[1:]] - total[self.cuts[:-1]]

    def counts(self) -> list[np.ndarray]:
        """Numbers of tokens of A and of B, of groups and of links of each text."""
        groups, links = self.sums(self.shared), np.diff(self.cuts)
        n_a = self.sums(np.diff(self.of_a, prepend=-1) > 0)
        return [n_a, links + groups - n_a, groups, links]

    def shown(self, a_words: np.ndarray, b_words: np.ndarray) -> list[str]:
        """Each text's groups: decimal ids of A, a bar, those of B, groups parted by semicolons.

        ``a_words`` and ``b_words``: the ids as text with a comma, then all of
        them with what ends their side of a group.
        """
        n_groups = int(self.shared.sum())
        group = np.cumsum(self.shared) - self.shared
        group_a, group_b = np.empty(len(self.a), np.int64), np.empty(len(self.b), np.int64)
        group_a[self.of_a], group_b[self.of_b] = group, group
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[upto_a - 1] = last_b[upto_b - 1] = True
        words = np.empty(len(self.a) + len(self.b), object)
        words[np.arange(len(self.a)) + (upto_b - in_b)[group_a]] = a_words[self.a.astype(np.int64) + last_a * (len(a_words) // 2)]
        words[np.arange(len(self.b)) + upto_a[group_b]] = b_words[self.b.astype(np.int64) + last_b * (len(b_words) // 2)]
        tokens = np.cumsum(self.counts()[0] + self.counts()[1])
        return ["".join(words[lo:hi].tolist())[:-1] for lo, hi in zip([0, *tokens[:-1].tolist()], tokens.tolist(), strict=True)]


class Aligner:
    """Both tokenizers and the ids that they give each piece of text.

    Space and text are cut before every space that follows another character
    than white space. Neither tokenizer joins anything across such a place: the
    pre-tokenizer of A begins anew there, and no piece of B has a space after
    another character (a vocabulary that has one is an error). So a text is the
    sum of its pieces, and most pieces have been seen before. A piece's key is
    without its first space, which B adds itself.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(a_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        model = json.load(open(a_path, encoding="utf-8"))
        to_byte, special = _byte_alphabet(), {t["content"]: t["id"] for t in model["added_tokens"]}
        self.a_bytes = {i: bytes(to_byte[c] for c in t) for t, i in model["model"]["vocab"].items() if t not in special}
        self.quick = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={t: i for i, t in self.a_bytes.items()}, special_tokens={}).encode_ordinary
        self.plain = re.compile("[\x00-⿿]*", re.S)
        self.a_bytes |= {i: t.encode() for t, i in special.items()}
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = [self.pieces.id_to_piece(i) for i in range(len(self.pieces))]
        if any(re.search("[^▁]▁", p) for p in shown):
            raise ValueError("a piece of B goes on after a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
        self.blank = self.pieces.piece_to_id("▁")
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_size = np.array(list(map(len, self.b_bytes)))
        words = lambda n, end: np.array([f"{i}," for i in range(n)] + [f"{i}{end}" for i in range(n)], object)
        self.a_words, self.b_words = words(len(self.a_size), "|"), words(len(self.b_size), ";")
        self.kind = "<u2" if max(len(self.a_size), len(self.b_size)) <= 1 << 16 else "<u4"
        self.index: dict[str, tuple | bool] = {}  # of the parts between spaces; False: its end is white space
        self.merged: dict[str, tuple | bool] = {}  # of pieces with more than one part
        self.chars = 0

    def _a_ids(self, keys: list[str]) -> list[list[int]]:
        plain = [self.plain.fullmatch(k) is not None for k in keys]
        rest = iter(self.tokenizer.encode_batch_fast([" " + k for k, p in zip(keys, plain, strict=True) if not p], add_special_tokens=False) if not all(plain) else ())
        return [self.quick(" " + k) if p else next(rest).ids for k, p in zip(keys, plain, strict=True)]

    def _learn(self, keys: list[str], index: dict[str, tuple | bool]) -> None:
        """Ids of both as packed bytes; a piece that a tokenizer changes has none."""
        for key, a, b in zip(keys, self._a_ids(keys), self.pieces.encode(keys, num_threads=1) if keys else (), strict=True):
            b = b or [self.blank]
            raw = (" " + key).encode()
            self.chars += len(key)
            same = b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])
            index[key] = (np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()) if same else (b"", b"", True)

    def _known(self, keys: list[str]) -> list:
        at = list(map(self.index.get, keys))
        if None in at:
            new = {k for k, i in zip(keys, at, strict=True) if i is None}
            odd = {k for k in new if not k or k[-1].isspace()}
            self.index.update(dict.fromkeys(odd, False))
            if new - odd:
                self._learn(sorted(new - odd), self.index)
            at = list(map(self.index.get, keys))
        return at

    def ids(self, text: str) -> tuple[bytes, bytes]:
        """A text's ids; none of an empty text or of one that either tokenizer changes."""
        if not text:
            return b"", b""
        parts = text.split(" ")
        at = self._known(parts)
        if False in at:  # white space before a space: what follows it belongs to the same piece
            keys, whole = [], []
            for k, part in enumerate(parts):
                whole.append(part)
                if (part and not part[-1].isspace()) or k == len(parts) - 1:
                    keys.append(" ".join(whole))
                    whole = []
            self._learn(sorted(set(keys).difference(self.merged)), self.merged)
            at = list(map(self.merged.get, keys))
        if any([len(x) > 2 for x in at]):
            return b"", b""
        return b"".join([x[0] for x in at]), b"".join([x[1] for x in at])

    def all_ids(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """``ids`` of each text; see ``CACHE`` for what is remembered."""
        found = []
        for text in texts:
            found.append(self.ids(text))
            if len(self.index) > CACHE or len(self.merged) > CACHE // 4 or self.chars > CACHE_CHARS:
                self._shrink()
        return found

    def _shrink(self) -> None:
        """Forget the later half of the pieces: the frequent ones came early."""
        for name in ("index", "merged"):
            held = getattr(self, name)
            setattr(self, name, dict(islice(held.items(), len(held) // 2)))
        self.chars = sum(map(len, self.index)) + sum(map(len, self.merged))
        if self.chars > CACHE_CHARS // 2:
            self.index, self.merged, self.chars = {}, {}, 0

    def aligned(self, a: pa.ChunkedArray, b: pa.ChunkedArray) -> Aligned:
        """The alignment of texts whose ids ``all_ids`` gave."""
        a, b = a.to_pylist(), b.to_pylist()
        flat_a, flat_b = (np.frombuffer(b"".join(x), self.kind) for x in (a, b))
        ends = np.zeros(len(flat_a) + 1, np.int64)
        np.cumsum(self.a_size[flat_a], out=ends[1:])
        upto = ends[np.cumsum(np.array([0, *map(len, a)]) // np.dtype(self.kind).itemsize)]
        return Aligned(flat_a, flat_b, self.a_size, self.b_size, np.diff(upto))


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of vocabularies."""
    return Aligner(a_path, b_path)


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def perfect_hash(keys: np.ndarray) -> list[np.ndarray]:
    """A minimal perfect hash of distinct keys: levels of bits.

    A key that is alone in its place of a level sets the bit there; the others
    go on to the next level, of twice as many places as keys are left. A key's
    number is how many bits are set before its own.
    """
    levels, left = [], keys
    while len(left):
        size = 2 * len(left)
        at = _mixed(left, len(levels)) % np.uint64(size)
        n = np.bincount(at.astype(np.int64), minlength=size)
        levels.append(n == 1)
        left = left[n[at.astype(np.int64)] > 1]
    return levels


def numbered(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The keys' numbers; a key that was not hashed may get any number, or -1."""
    out, before = np.full(len(keys), -1, np.int64), 0
    left = np.arange(len(keys))
    for k, bits in enumerate(levels):
        at = (_mixed(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
        rank = np.cumsum(bits)
        hit = bits[at]
        out[left[hit]] = before + rank[at[hit]] - 1
        before += int(rank[-1])
        left = left[~hit]
    return out


def _levels_out(levels: list[np.ndarray]) -> bytes:
    return np.array([len(levels), *map(len, levels)], "<i8").tobytes() + b"".join(np.packbits(b).tobytes() for b in levels)


def _levels_in(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8).tolist(), 8 + 8 * n, []
    for size in sizes:
        out.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at), count=size).astype(bool))
        at += -(-size // 8)
    return out


class PairTable:
    """A bucket's pairs under their hash: keys in order of their numbers, to verify what is asked."""

    def __init__(self, row: dict):
        self.levels, self.keys = _levels_in(row["hash"]), np.frombuffer(row["keys"], "<i8")

    def at(self, keys: np.ndarray) -> np.ndarray:
        found = numbered(self.levels, keys)
        if len(keys) and (found.min() < 0 or (self.keys[found] != keys).any()):
            raise ValueError("a pair is not in its bucket")
        return found


def _best(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair's count is the highest of its B id."""
    b = keys >> 32
    order = np.argsort(b, kind="stable")
    first = np.flatnonzero(np.diff(b[order], prepend=-1))
    top = np.empty(len(keys), np.int64)
    if len(keys):
        top[order] = np.repeat(np.maximum.reduceat(counts[order], first), np.diff(np.append(first, len(keys))))
    return counts == top


def _longs(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    return (np.frombuffer(x, "<i8") for x in column.to_pylist())


def _union(column: pa.ChunkedArray) -> np.ndarray:
    """The distinct numbers of many arrays; merged as they come, so no more is held than twice the result and one array."""
    out, waiting, size = np.zeros(0, np.int64), [], 0
    for x in _longs(column):
        waiting.append(x)
        size += len(x)
        if size > max(1 << 16, len(out)):
            out, waiting, size = np.unique(np.concatenate([out, *waiting])), [], 0
    return np.unique(np.concatenate([out, *waiting]))


def pair_counts(partials: DataFrame, parts: int) -> DataFrame:
    """``(bucket, hash, keys, counts, best)`` over ``partials(bucket, part, block, keys, counts)``.

    First the distinct pairs, by part and then by bucket, get a minimal perfect
    hash; then each part sums its blocks' counts into a dense vector indexed by
    it, and the parts' vectors are summed.
    """

    def union(keys: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"bucket": pa.array([keys[0].as_py()], pa.int32()), "keys": [_union(table["keys"]).tobytes()]})

    def hashed(keys: tuple, table: pa.Table) -> pa.Table:
        found = _union(table["keys"])
        levels = perfect_hash(found)
        placed = np.empty_like(found)
        placed[numbered(levels, found)] = found
        return pa.table({"bucket": pa.array([keys[0].as_py()], pa.int32()), "hash": [_levels_out(levels)], "keys": [placed.tobytes()]})

    distinct = partials.select("bucket", "part", "keys").groupBy("bucket", "part").applyInArrow(union, "bucket int, keys binary")
    tables = materialize(distinct.groupBy("bucket").applyInArrow(hashed, "bucket int, hash binary, keys binary"))

    def summed(keys: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "vector": pa.array([], pa.binary())})
        pairs = PairTable(table.to_pylist()[0])
        vector = np.zeros(len(pairs.keys), np.int64)
        for k, c in zip(_longs(rows["keys"]), _longs(rows["counts"]), strict=True):
            vector[pairs.at(k)] += c  # a block has a pair once
        return pa.table({"bucket": pa.array([keys[0].as_py()], pa.int32()), "vector": [vector.tobytes()]})

    vectors = partials.groupBy("bucket", "part").cogroup(_to_parts(tables, parts).groupBy("bucket", "part")).applyInArrow(summed, "bucket int, vector binary")

    def total(keys: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        pairs, counts = np.frombuffer(row["keys"], "<i8"), sum(_longs(rows["vector"]))
        return pa.table({"bucket": pa.array([row["bucket"]], pa.int32()), "hash": [row["hash"]], "keys": [row["keys"]], "counts": [counts.tobytes()], "best": [_best(pairs, counts).tobytes()]})

    schema = "bucket int, hash binary, keys binary, counts binary, best binary"
    return materialize(vectors.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(total, schema))


def _to_parts(tables: DataFrame, parts: int) -> DataFrame:
    return tables.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``: what each document's alignment holds, and ``(a, b, count, best)`` for each pair of ids in the corpus.

    A encodes a space and the text, B the text, to which it adds the space. A
    null or empty text, and one that a tokenizer changes, has no tokens: zeros
    and an empty digest. Rows are dealt out to blocks of about 8 MiB by their
    place, as ids, so copies and hot ids spread; a block's distinct pairs are
    counted in its task and looked up for its second pass, which aligns again. Repeated rows count once each;
    input columns but the two named are not read, so their names cannot clash;
    an empty table gives none.
    """
    a_path, b_path = a_path or tokenizer_path(), b_path or tokenizer_path("piece_bpe_32k.model")
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    parts, files = isqrt(n_blocks - 1) + 1, min(n_blocks, MOST_FILES)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(a_path, b_path)
        for batch in batches:
            step = max(1, int(batch.num_rows * BLOCK_BYTES / max(batch.nbytes, 1)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids = by.all_ids(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[k] for x in ids], pa.binary()) for k in (0, 1))], ["doc_id", "a", "b"])

    rows = texts.mapInArrow(encode, "doc_id long, a binary, b binary").withColumn("place", F.monotonically_increasing_id())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(n_blocks))).drop("place")
    held = bucketed(rows.repartition(files, "block"), "block", files, "zstd")

    def count(keys: tuple, table: pa.Table) -> pa.Table:
        found, counts = np.unique(aligner(a_path, b_path).aligned(table["a"], table["b"]).links, return_counts=True)
        counts = counts.astype(np.int64)
        bucket = (found >> 32) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        held_, first = np.unique(bucket[order], return_index=True)
        cut = np.split(order, first[1:]) if len(first) else []
        block = keys[0].as_py()
        return pa.table({"bucket": pa.array(held_, pa.int32()), "part": pa.array([block % parts] * len(cut), pa.int32()), "block": pa.array([block] * len(cut), pa.int64()), "keys": pa.array([found[c].tobytes() for c in cut], pa.binary()), "counts": pa.array([counts[c].tobytes() for c in cut], pa.binary())})

    partials = materialize(held.groupBy("block").applyInArrow(count, "bucket int, part int, block long, keys binary, counts binary"))
    pairs = pair_counts(partials, parts)

    def answer(keys: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "keys": [], "counts": [], "best": []}
        if rows.num_rows:
            row = table.to_pylist()[0]
            known, counts, best = PairTable(row), np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["best"], bool)
            for block, asked in zip(rows["block"].to_pylist(), _longs(rows["keys"]), strict=True):
                at = known.at(asked)
                for name, value in (("block", block), ("keys", asked.tobytes()), ("counts", counts[at].tobytes()), ("best", best[at].tobytes())):
                    out[name].append(value)
        return pa.table({n: pa.array(v, pa.int64() if n == "block" else pa.binary()) for n, v in out.items()})

    asked = partials.drop("counts").groupBy("bucket", "part").cogroup(_to_parts(pairs, parts).groupBy("bucket", "part"))
    answers = asked.applyInArrow(answer, "block long, keys binary, counts binary, best binary")

    def measure(keys: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        by = aligner(a_path, b_path)
        both = by.aligned(table["a"], table["b"])
        known, counts, best = (np.frombuffer(b"".join(found[c].to_pylist()), t) for c, t in (("keys", "<i8"), ("counts", "<i8"), ("best", bool)))
        order = np.argsort(known)
        place = order[np.searchsorted(known[order], both.links)] if len(known) else np.zeros(0, np.int64)
        sums = [*both.counts(), both.sums(best[place]), both.sums(counts[place])]
        digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in both.shown(by.a_words, by.b_words)]
        return pa.table({"doc_id": table["doc_id"], **dict(zip(_FIELDS, map(pa.array, sums), strict=True)), "groups_sha256": pa.array(digests, pa.string())})

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in _FIELDS) + ", groups_sha256 string"
    documents = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(measure, schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys & 0xFFFFFFFF), pa.array(keys >> 32), pa.array(np.frombuffer(row["counts"], "<i8")), pa.array(np.frombuffer(row["best"], bool))], ["a", "b", "count", "best"])

    return documents, pairs.mapInArrow(listed, "a long, b long, count long, best boolean")


def op11_tokenizer_alignment(spark, sf_dir):
    """Every document's alignment, with the corpus-wide counts of its links."""
    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
