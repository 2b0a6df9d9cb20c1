"""Removal of repeated byte strings by a distributed merge sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krysalis.llm.common import bucketed, materialize, text_of

LENGTH = 50
#: Bytes that an anchor's order is drawn from; each window of LENGTH bytes has one anchor, the least of LENGTH - SEED + 1.
SEED = 24
#: Text of a block, of a bucket and of the pieces that anchors are searched in; codes of a block that a bucket gets at least.
BLOCK_BYTES, BUCKET_BYTES, PIECE_BYTES, LEAST_RUN = 1 << 24, 1 << 24, 1 << 18, 32
#: Sorted suffixes that are compared at once; a group of common first bytes is never cut.
MERGED_ROWS = 1 << 16
#: Low bits of an anchor's key hold its place in a piece: the same number for every piece, so equal windows always have equal anchors.
_PLACE = np.uint64((1 << 24) - 1)
_A, _B, _C = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _packed(data) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data.tobytes() if isinstance(data, np.ndarray) else data)


def _unpacked(data: bytes, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)


def seed_hashes(buf: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of all ``seed`` bytes in a row, from those of powers of two."""
    h = (buf.astype(np.uint64) + np.uint64(1)) * _A
    h ^= h >> np.uint64(32)
    whole, have, size, part = None, 0, 1, h
    left = seed
    while left:
        if left & size:
            whole = part.copy() if whole is None else whole[: len(part) - have] * _C + part[have : have + len(whole)]
            have += size
            left -= size
        if left:
            part = part[:-size] * (_B + np.uint64(2 * size)) + part[size:]
            size *= 2
    h = whole[: len(buf) - seed + 1]
    return (h ^ h >> np.uint64(29)) * _B


class Anchors:
    """The anchors of concatenated documents: for each window, the byte whose next SEED bytes hash least, the first of equals.

    Equal windows have equal anchors at equal places, so equal windows are found
    among suffixes that start at anchors, one byte in fourteen or so. The text is
    searched in pieces that overlap by a window, so memory does not follow its
    length; where a piece ends changes no anchor.
    """

    def __init__(self, text: bytes, lengths: np.ndarray, length: int = LENGTH, seed: int = SEED, piece: int = PIECE_BYTES):
        self.buf = np.frombuffer(text, np.uint8)
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        n = len(self.buf)
        self.at, self.code, self.around = np.zeros(0, np.int32), np.zeros(0, np.uint64), None
        found, last = [], -1
        for lo in range(0, n - length + 1, piece):
            at, code = self._piece(lo, min(n, lo + piece + length - 1), length, seed)
            new = int(np.searchsorted(at, last, "right"))
            if new < len(at):
                last = int(at[-1])
                found.append((at[new:].astype(np.int32), code[new:]))
        if found:
            self.at, self.code = (np.concatenate(x) for x in zip(*found, strict=True))

    def _piece(self, lo: int, hi: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of the windows within [lo, hi) that lie in one document."""
        places = length - seed + 1
        h = seed_hashes(self.buf[lo:hi], seed)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= places:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if places > size:
            key = np.minimum(key[: len(key) - (places - size)], key[places - size :])
        a, b = np.searchsorted(self.end, lo, "right"), np.searchsorted(self.start, hi, "left")
        first, last = np.maximum(self.start[a:b] - lo, 0), np.minimum(self.end[a:b] - lo, hi - lo) - length
        fits = last >= first
        edge = np.zeros(len(key) + 1, np.int32)
        np.add.at(edge, first[fits], 1)
        np.add.at(edge, last[fits] + 1, -1)
        at = (key[np.cumsum(edge[:-1]) > 0] & _PLACE).astype(np.int64)
        at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
        mixed = (h[at] ^ h[at] >> np.uint64(32)) * _C
        return at + lo, mixed ^ mixed >> np.uint64(31)

    def docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, "right")

    def suffixes(self, at: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Rows of LENGTH bytes from each anchor on and, backwards, the bytes before it; and the offsets that have a window, as bits."""
        before = length - seed
        doc = self.docs(at)
        right, left = np.minimum(length, self.end[doc] - at), np.minimum(before, at - self.start[doc])
        if self.around is None:
            padded = np.concatenate([np.zeros(before, np.uint8), self.buf, np.zeros(length, np.uint8)])
            self.around = np.lib.stride_tricks.sliding_window_view(padded, before + length)
        both = self.around[at]
        rows = np.concatenate([both[:, before:], both[:, before - 1 :: -1] if before else both[:, :0]], 1)
        for i in np.flatnonzero((right < length) | (left < before)).tolist():
            rows[i, right[i] : length] = 0
            rows[i, length + left[i] :] = 0
        low, high = np.maximum(0, length - right), left
        valid = np.where(low <= high, (1 << (high + 1)) - (1 << low), 0).astype(np.uint32)
        return rows, valid


def _marked(anchors: Anchors, at: np.ndarray) -> np.ndarray:
    """The rows of ``suffixes`` with the bits of their windows behind, as bytes."""
    rows, valid = anchors.suffixes(at)
    return np.concatenate([rows, valid.astype(">u4").view(np.uint8).reshape(-1, 4)], 1)


def first_equals(anchors: Anchors, at: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """For each of the places ``at`` the index of the first whose row is equal, or its own.

    Rows are made in slices, told apart by a hash and compared byte by byte with
    the first of their hash; one that differs from it stays by itself. So memory
    is some numbers a place, not a row: in a run of one byte every byte is an
    anchor, and all rows are equal.
    """
    hashes = np.empty(len(at), np.uint64)
    for lo in range(0, len(at), at_once):
        words = _marked(anchors, at[lo : lo + at_once]).view("<u8")
        h = words[:, 0] * _A
        for k in range(1, words.shape[1]):
            h = (h ^ h >> np.uint64(32)) * _C + words[:, k]
        hashes[lo : lo + at_once] = (h ^ h >> np.uint64(29)) * _B
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    hashes = hashes[order]
    new = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(at) else np.zeros(0, np.int64)
    first = np.empty(len(at), np.int32)
    first[order] = np.repeat(order[new], np.diff(np.r_[new, len(at)]))
    for lo in range(0, len(at), at_once):
        part = first[lo : lo + at_once]
        k = lo + np.flatnonzero(part != np.arange(lo, lo + len(part)))
        if len(k):
            leads, which = np.unique(first[k], return_inverse=True)
            alone = k[(_marked(anchors, at[k]).view("<u8") != _marked(anchors, at[leads]).view("<u8")[which]).any(1)]
            first[alone] = alone
    return first


def front_coded(rows: np.ndarray) -> bytes:
    """Sorted rows as the length of the prefix shared with the row before, and the rest of each."""
    if not len(rows):
        return _packed(b"")
    shared = np.zeros(len(rows), np.uint8)
    differ = rows[1:] != rows[:-1]
    shared[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    rest = rows[np.arange(rows.shape[1]) >= shared[:, None]]
    return _packed(shared.tobytes() + rest.tobytes())


def front_rows(data: bytes, n: int, width: int) -> Iterator[tuple[bytes, int]]:
    """The rows of ``front_coded``, each with the length of the prefix it shares with the row before."""
    raw = _unpacked(data)
    row, at = b"", n
    for shared in raw[:n]:
        row = row[:shared] + raw[at : at + width - shared]
        at += width - shared
        yield row, shared


def front_decoded(data: bytes, n: int, width: int) -> tuple[list[bytes], list[int]]:
    """``front_rows`` as two lists."""
    rows = list(front_rows(data, n, width))
    return [r for r, _ in rows], [s for _, s in rows]


def merged(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge of sorted runs with known shared prefixes: ``(run, place in the run, prefix shared with the row before)``."""
    parts = [part[:3] for part in merged_parts([zip(*run, strict=True) for run in runs], width)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def merged_parts(runs: list[Iterable[tuple[bytes, int]]], width: int, together: int = SEED, most: int = MERGED_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """``merged`` and its rows in parts of about ``most`` rows, cut where a row shares under ``together`` bytes with the one before.

    A loser tree in which every loser knows how many bytes it shares with the
    winner that beat it. Of two candidates the one that shares more with the
    last row out is the smaller; only where both share the same number are
    bytes compared, from that byte on, and the loser keeps what was found.
    """
    size = 1
    while size < len(runs):
        size *= 2
    rest = [iter(r) for r in runs] + [iter(())] * (size - len(runs))
    place = [0] * size
    first = [next(r, (None, -1)) for r in rest]
    head: list[bytes | None] = [row for row, _ in first]
    common = [-1 if row is None else 0 for row in head]  # an empty run loses to all
    tree = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; sets what the loser shares with the winner."""
        x, y = common[a], common[b]
        if x > y:
            return a, b
        if x < y:
            return b, a
        if x < 0:
            return a, b
        p, q = head[a][x:], head[b][x:]
        if p == q:
            common[b] = width
            return a, b
        differ = int.from_bytes(p) ^ int.from_bytes(q)
        same = x + len(p) - (differ.bit_length() + 7) // 8
        if p < q:
            common[b] = same
            return a, b
        common[a] = same
        return b, a

    winners = list(range(size))
    at = size
    while at > 1:
        at //= 2
        nxt = []
        for k in range(at):
            win, lose = play(winners[2 * k], winners[2 * k + 1])
            tree[at + k] = lose
            nxt.append(win)
        winners = nxt
    win = winners[0]
    out_run, out_place, out_common, out_rows = [], [], [], []
    while head[win] is not None:
        if len(out_run) >= most and common[win] < together:
            yield np.array(out_run, np.int64), np.array(out_place, np.int64), np.array(out_common, np.int64), out_rows
            out_run, out_place, out_common, out_rows = [], [], [], []
        out_run.append(win)
        out_place.append(place[win])
        out_common.append(common[win])
        out_rows.append(head[win])
        place[win] += 1
        head[win], common[win] = next(rest[win], (None, -1))
        node = (win + size) // 2
        while node:
            lose = tree[node]
            x, y = common[win], common[lose]
            if x < y:
                win, tree[node] = lose, win
            elif x == y and x >= 0:
                win, tree[node] = play(win, lose)
            node //= 2
    if out_run:
        yield np.array(out_run, np.int64), np.array(out_place, np.int64), np.array(out_common, np.int64), out_rows


def repeated_windows(rows: np.ndarray, common: np.ndarray, doc: np.ndarray, valid: np.ndarray, length: int = LENGTH, few: int = 8) -> np.ndarray:
    """For each sorted row the offsets, as bits, whose window also is in a row of a smaller document.

    The window that starts ``o`` bytes before the anchor is the row's first
    ``length - o`` bytes and the ``o`` bytes before. Rows that share too few
    first bytes for any window are in different groups. In groups of up to
    ``few`` rows each two are compared; larger ones are ranked offset by offset.
    """
    found = np.zeros(len(rows), np.uint32)
    most = rows.shape[1] - length
    group = np.cumsum(common < length - most)
    size = np.bincount(group)[group] if len(group) else group
    small = (size > 1) & (size <= few)
    for away in range(1, few):
        a = np.flatnonzero(small[:-away] & (group[:-away] == group[away:])) if len(rows) > away else np.zeros(0, np.int64)
        if not len(a):
            break
        for lo in range(0, len(a), 1 << 15):
            i = a[lo : lo + (1 << 15)]
            j = i + away
            differ = rows[i] != rows[j]
            after = np.where(differ[:, :length].any(1), differ[:, :length].argmax(1), length)
            before = np.where(differ[:, length:].any(1), differ[:, length:].argmax(1), most) if most else np.zeros(len(i), np.int64)
            low = length - after
            bits = np.where(low <= before, (1 << (before + 1)) - (1 << np.minimum(low, before + 1)), 0).astype(np.uint32) & valid[i] & valid[j]
            np.bitwise_or.at(found, i, np.where(doc[i] > doc[j], bits, 0).astype(np.uint32))
            np.bitwise_or.at(found, j, np.where(doc[j] > doc[i], bits, 0).astype(np.uint32))
    large = np.flatnonzero(size > few)
    if len(large):
        found[large] = _ranked_windows(rows[large], common[large], doc[large], valid[large], length)
    return found


def _ranked_windows(rows: np.ndarray, common: np.ndarray, doc: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """``repeated_windows`` for groups of any size.

    The first part of a window is equal along the sort as far as the shared
    prefixes reach; the bytes before get exact ranks, one byte at a time.
    """
    found = np.zeros(len(rows), np.uint32)
    rank = np.zeros(len(rows), np.int64)
    for o in range(rows.shape[1] - length + 1):
        if o:
            rank = np.unique(rank * 256 + rows[:, length + o - 1], return_inverse=True)[1]
        group = np.cumsum(common < length - o)
        has = np.flatnonzero(valid >> np.uint32(o) & np.uint32(1))
        if not len(has):
            continue
        key = group[has] * (int(rank.max()) + 1) + rank[has]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.minimum.reduceat(doc[has][order], first)
        least = np.repeat(least, np.diff(np.r_[first, len(key)]))
        again = has[order[doc[has][order] > least]]
        found[again] |= np.uint32(1 << o)
    return found


def _blocks(docs: DataFrame, buckets: int, code_bits: int, block_bytes: int) -> DataFrame:
    """Rows of some ``block_bytes`` of text: the documents, and by bucket the anchors' codes, sorted, as differences."""

    def row(block: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        text, lengths = b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        code, many = block_codes(Anchors(text, lengths), _ranks(ids)[1], code_bits)
        edges = np.searchsorted(code, _edges(buckets, code_bits))
        parts = [(code[a:b], many[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        codes = [_packed(np.diff(c, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy()) for c, _ in parts]
        columns = [
            pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([_packed(text)], pa.binary()),
            pa.array([codes], pa.list_(pa.binary())), pa.array([[np.packbits(m).tobytes() for _, m in parts]], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "lengths", "text", "codes", "many"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), count()
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc)
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1]) + 64
                if size >= block_bytes:
                    yield row((task << 32) + next(number), ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield row((task << 32) + next(number), ids, texts)

    return docs.mapInArrow(run, "block long, ids array<long>, lengths array<long>, text binary, codes array<binary>, many array<binary>")


def block_codes(anchors: Anchors, rank: np.ndarray, code_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of a block, sorted, and which of them two of its documents have."""
    code = anchors.code >> np.uint64(64 - code_bits)
    if not len(code):
        return code, np.zeros(0, bool)
    order = np.argsort(code, kind="stable").astype(np.int32)
    code, doc = code[order], rank[anchors.docs(anchors.at)][order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)


def _ranks(ids) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ``ids``, ascending, and the place of each id among them."""
    numbers, rank = np.unique(_numbers(ids), return_inverse=True)
    return numbers, rank.astype(np.int32)


def _numbers(ids) -> np.ndarray:
    """Ids as integers, null after all others."""
    return np.array([np.iinfo(np.int64).max if i is None or i != i else i for i in ids], np.int64)


def _edges(buckets: int, code_bits: int) -> np.ndarray:
    return np.array([(k << code_bits) // buckets for k in range(buckets + 1)], np.uint64)


def _codes(data: bytes) -> np.ndarray:
    raw = _unpacked(data, np.uint8)
    return np.cumsum(raw.reshape(8, -1).T.copy().view("<u8")[:, 0], dtype=np.uint64) if len(raw) else np.zeros(0, np.uint64)


def _shared_codes(blocks: DataFrame) -> DataFrame:
    """For each block and bucket, which of its codes occur in two documents or more, as bits."""

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        codes = [_codes(c) for c in part["codes"]]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(c)).astype(bool) for m, c in zip(part["many"], codes, strict=True)]
        every, n = np.unique(np.concatenate(codes), return_counts=True)
        twice = n > 1
        for c, m in zip(codes, many, strict=True):
            twice[np.searchsorted(every, c[m])] = True
        bits = [np.packbits(twice[np.searchsorted(every, c)]).tobytes() for c in codes]
        return pd.DataFrame({"block": part["block"], "bucket": part["bucket"], "bits": bits, "n": [len(c) for c in codes]})

    sent = blocks.select("block", F.posexplode(F.arrays_zip("codes", "many")).alias("bucket", "x")).select("block", "bucket", "x.*")
    return sent.groupBy("bucket").applyInPandas(meet, "block long, bucket int, bits binary, n int")


def bucket_run(anchors: Anchors, at: np.ndarray, doc: np.ndarray, numbers: np.ndarray) -> tuple:
    """What ``_runs`` keeps of a block's anchors ``at``, of the documents ``numbers[doc]``, in one bucket."""
    by_doc = np.argsort(doc, kind="stable").astype(np.int32)
    at, doc = at[by_doc], doc[by_doc]
    first = first_equals(anchors, at)
    lead = np.flatnonzero(first == np.arange(len(at), dtype=np.int32))
    mark = np.concatenate([_marked(anchors, at[lead]), np.ones((len(lead), 1), np.uint8)], 1)  # the last byte keeps numpy from cutting zeros
    key = np.ascontiguousarray(mark).view(f"S{mark.shape[1]}")[:, 0]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    spot = np.zeros(len(at), np.int32)
    spot[lead[order]] = np.cumsum(new) - 1
    rows = mark[order[new]][:, :-1]
    lead = lead[order[new]]
    follows = np.ones(len(at), bool)
    follows[lead] = False
    leader = spot[first[follows]]
    other = doc[follows] != doc[lead][leader]
    valid = np.ascontiguousarray(rows[:, -4:]).view(">u4")[:, 0].astype("<u4")
    return len(lead), front_coded(rows), _packed(numbers[doc[lead]]), _packed(valid), _packed(at[lead]), _packed(leader), _packed(at[follows]), _packed(np.packbits(other))


def _runs(blocks: DataFrame, bits: DataFrame, files: int, buckets: int, code_bits: int) -> DataFrame:
    """Front-coded sorted runs of the suffixes at shared anchors, one for each block and bucket.

    Equal suffixes of a block are one row, of the smallest document; the others
    follow it as places, which stay with the block.
    """
    told = bits.repartition(files, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits", "n"))).alias("told"))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                anchors = Anchors(_unpacked(row.text), np.array(row.lengths, np.int64))
                code = anchors.code >> np.uint64(64 - code_bits)
                shared = np.concatenate([np.unpackbits(np.frombuffer(t["bits"], np.uint8), count=t["n"]).astype(bool) for t in row.told])
                keep = shared[np.searchsorted(np.unique(code), code)] if len(code) else np.zeros(0, bool)
                at, bucket = anchors.at[keep], (np.searchsorted(_edges(buckets, code_bits), code[keep], "right") - 1).astype(np.int32)
                del code, keep
                numbers, rank = _ranks(row.ids)
                doc = rank[anchors.docs(at)]
                for b in np.unique(bucket).tolist():
                    own = bucket == b
                    yield pd.DataFrame([(row.block, b, *bucket_run(anchors, at[own], doc[own], numbers))], columns=["block", "bucket", "n", "rows", "docs", "valid", "at", "leader", "follower", "other"])

    ddl = "block long, bucket int, n int, rows binary, docs binary, valid binary, at binary, leader binary, follower binary, other binary"
    return blocks.select("block", "ids", "lengths", "text").join(told, "block").drop("codes").mapInPandas(run, ddl)


def _marks(runs: DataFrame) -> DataFrame:
    """For each block and bucket the offsets of the windows to remove, as bits, of the rows in its run."""
    width = 2 * LENGTH - SEED + 4

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        docs = [_unpacked(d, "<i8") for d in part["docs"]]
        base = np.cumsum([0, *(len(d) for d in docs)])
        doc_of = np.concatenate(docs)
        found = np.zeros(base[-1], "<u4")
        runs = [front_rows(r, n, width) for r, n in zip(part["rows"], part["n"], strict=True)]
        for run, place, common, sorted_rows in merged_parts(runs, width):
            rows = np.frombuffer(b"".join(sorted_rows), np.uint8).reshape(-1, width)
            valid = np.ascontiguousarray(rows[:, -4:]).view(">u4")[:, 0].astype(np.uint32)
            spot = base[run] + place
            found[spot] = repeated_windows(rows[:, :-4], common, doc_of[spot], valid)
        masks = [_packed(found[a:b]) for a, b in zip(base, base[1:], strict=False)]
        return pd.DataFrame({"block": part["block"], "bucket": part["bucket"], "mask": masks})

    return runs.select("block", "bucket", "n", "rows", "docs").groupBy("bucket").applyInPandas(merge, "block long, bucket int, mask binary")


def _places(home: Iterable[dict], told: Iterable[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and offsets of a block's windows to remove, by bucket.

    What follows a row of another document in the block loses all its windows,
    what follows one of its own document the windows that the row loses.
    """
    masks = {t["bucket"]: t["mask"] for t in told}
    for run in home:
        mask, leader = _unpacked(masks[run["bucket"]], "<u4"), _unpacked(run["leader"], "<i4")
        other = np.unpackbits(_unpacked(run["other"], np.uint8), count=len(leader)).astype(bool)
        yield _unpacked(run["at"], "<i4"), mask
        yield _unpacked(run["follower"], "<i4"), np.where(other, _unpacked(run["valid"], "<u4")[leader], mask[leader])


def removed_bytes(n: int, places: Iterable[tuple[np.ndarray, np.ndarray]], length: int = LENGTH) -> np.ndarray:
    """True for each byte of a block that a window of ``places``, each with distinct places, covers."""
    edge = np.zeros(n + length + 1, np.int32)
    for at, mask in places:
        for o in range(LENGTH - SEED + 1):
            start = at[(mask >> np.uint32(o) & np.uint32(1)) > 0] - o
            edge[start] += 1
            edge[start + length] -= 1
    return np.cumsum(edge, dtype=np.int32)[:n] > 0


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, digest: bool = False) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans`` of every document, with ``kept`` (binary), or ``kept_sha256`` if ``digest``.

    A byte goes if a 50-byte string covers it that also starts in a document of
    smaller id. Suffixes are taken at anchors only. First the anchors' codes
    meet, as sorted differences by code range, and what no other document has
    is left out; then the suffixes at the rest are exchanged as front-coded
    sorted runs and merged by loser trees that compare no byte twice; equal
    windows show as shared prefixes of the sorted order. Hash codes only choose
    what to send: strings are compared byte by byte.

    A block's run for a bucket has ``LEAST_RUN`` codes or more, so what is
    exchanged follows the text; a bucket is merged as a stream. The blocks of
    text and their runs are written once, bucketed by block, and the answers, a
    mask for each row of a run, are dealt out alike, so that they join without
    moving text. A string that a block repeats is sent once; its other places
    stay with the block, be they a run of one byte or a line on every page. Null text is empty; a null id comes after
    all others; documents under 50 bytes and repeated rows of one id remove
    nothing of each other; an empty table gives none.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    buckets = int(min(max(8, size // BUCKET_BYTES), max(8, block_bytes // (14 * LEAST_RUN))))
    code_bits = min(64, max(24, int(size).bit_length() + 6))
    files = int(min(1 << 16, max(12, 4 * size // BLOCK_BYTES)))
    given = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    blocks = bucketed(_blocks(given, buckets, code_bits, block_bytes), "block", files, row_group=1 << 23)
    bits = materialize(_shared_codes(blocks))
    runs = bucketed(_runs(blocks, bits, files, buckets, code_bits), "block", files, row_group=1 << 23)
    marks = materialize(_marks(runs))
    told = marks.repartition(files, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "mask")).alias("told"))
    home = runs.groupBy("block").agg(F.collect_list(F.struct("bucket", "valid", "at", "leader", "follower", "other")).alias("home"))

    def finish(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                text, lengths = _unpacked(row.text), np.array(row.lengths, np.int64)
                gone = removed_bytes(len(text), _places(row.home, row.told) if row.told is not None else [])
                end = np.cumsum(lengths)
                start = end - lengths
                total = np.r_[0, np.cumsum(gone)]
                opens = gone & ~np.r_[False, gone[:-1]]
                opens[start[lengths > 0]] = gone[start[lengths > 0]]
                spans = np.r_[0, np.cumsum(opens)]
                buf = np.frombuffer(text, np.uint8)
                kept = [(text[a:b] if c == d else buf[a:b][~gone[a:b]].tobytes()) for a, b, c, d in zip(start.tolist(), end.tolist(), total[start].tolist(), total[end].tolist(), strict=True)]
                yield pd.DataFrame({"id": pd.array([None if i is None or i != i else int(i) for i in row.ids], "Int64"), "n_bytes": lengths, "n_removed": total[end] - total[start], "n_spans": spans[end] - spans[start], "kept": [hashlib.sha256(k).hexdigest() for k in kept] if digest else kept})

    joined = blocks.select("block", "ids", "lengths", "text").join(home, "block", "left").join(told, "block", "left")
    out = joined.mapInPandas(finish, f"id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out


def op2_suffix_dedup(spark, sf_dir):
    """What is removed from every document, and the digest of the rest."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).withColumnRenamed("id", "doc_id")
