"""Bits of words that were never seen: context mixing over the bytes of a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Slots of the tables as powers of two: contexts of one to three bytes and of the word so far saturate there, whatever the corpus.
SLOT_BITS = (16, 18, 20, 20)
PRIOR = 0.4
GATES = (8, 6)
REFINED = 33
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Speller:
    """Bit predictors over hashed contexts of a new word's bytes, mixed by gated weights and refined.

    A word is its bytes and a blank; each bit of a byte is predicted from the
    counts of that bit in four contexts of the word (the byte before, the two,
    the three, the word so far), each a slot of a hashed table. The
    predictions' log-odds are added with weights chosen by how often the two
    longest contexts were seen, and the sum is refined by a table of what came
    of such sums. Words are types here: what is spelt has not been seen before.
    """

    def __init__(self, bits: tuple[int, ...] = SLOT_BITS, tables: list[np.ndarray] | None = None, step: float = 10.0):
        """``tables`` hold a byte for each slot and bit: ``step`` times the binary logarithm of one more than the count."""
        self.bits = bits
        self.tables = tables
        n = (2.0 ** (np.arange(256) / step) - 1).astype(np.float32)
        odds = lambda zero, one: np.log((np.maximum(one, 0) + PRIOR)[:, None] / (np.maximum(zero, 0) + PRIOR)[None, :]).astype(np.float32).reshape(-1)
        #: By two logarithms of counts, as two bytes: log-odds as they are and, by the bit, without the bit itself, and what gates see of the sum.
        self.odds, self.without = odds(n, n), np.concatenate([odds(n - 1, n), odds(n, n - 1)])
        self.log_seen = np.log2(n[:, None] + n[None, :] + 1).reshape(-1)
        self.weights = np.tile(np.array([0.1, 0.2, 0.35, 0.45, 0.0], np.float64), (GATES[0] * GATES[1], 1))
        self.refine = None

    def _contexts(self, words: list[bytes]):
        buf = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.cumsum(length) - length
        pos = np.arange(len(buf)) - np.repeat(start, length)
        power = np.cumprod(np.full(int(length.max()), _K1 | np.uint64(1), np.uint64))[pos]
        total = np.r_[np.uint64(0), np.cumsum((buf + np.uint64(1)) * power, dtype=np.uint64)]
        prefix = (total[:-1] - total[np.repeat(start, length)]) * _K2 + pos.astype(np.uint64)
        before = [np.where(pos >= k, np.r_[np.zeros(min(k, len(buf)), np.uint64), buf[:-k]], np.uint64(0)) for k in (1, 2, 3)]
        two = before[0] | before[1] << np.uint64(8)
        return buf, start, [before[0], two, two | before[2] << np.uint64(16), prefix]

    def _slots(self, context: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
        mixed = (context + np.uint64(order + 1)) * _K2 + node * _K3
        mixed ^= mixed >> np.uint64(31)
        return ((mixed * _K1) >> np.uint64(64 - self.bits[order])).astype(np.int64)

    def count(self, words: list[bytes], times: np.ndarray, into: list[np.ndarray]) -> None:
        """Add the words' bits, ``times`` each, to tables of (slot, bit)."""
        for lo in _cuts(words):
            part = words[lo]
            buf, start, contexts = self._contexts(part)
            n = np.repeat(times[lo], np.diff(np.r_[start, len(buf)]))
            for k in range(8):
                node = np.uint64(1 << k) | buf >> np.uint64(8 - k)
                bit = (buf >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
                for order, context in enumerate(contexts):
                    np.add.at(into[order], self._slots(context, node, order) * 2 + bit, n.astype(into[order].dtype))

    def _inputs(self, buf, contexts, k, left_out: bool):
        node = np.uint64(1 << k) | buf >> np.uint64(8 - k)
        bit = (buf >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
        x = np.empty((5, len(buf)), np.float32)
        seen = []
        for order, context in enumerate(contexts):
            pair = self.tables[order].view("<u2")[self._slots(context, node, order)].astype(np.int64)
            if order > 1:
                seen.append(self.log_seen[pair])
            x[order] = self.without[pair + (bit << 16)] if left_out else self.odds[pair]
        x[4] = 0.3
        gate = np.minimum(GATES[0] - 1, seen[1]).astype(np.int64) * GATES[1] + np.minimum(GATES[1] - 1, seen[0] / 2).astype(np.int64)
        return bit.astype(np.float32), x, gate
    @staticmethod
    def _cell(z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return gate * REFINED + np.clip(np.round(z * 2) + REFINED // 2, 0, REFINED - 1).astype(np.int64)

    def fit(self, words: list[bytes], rate: float = 0.02) -> None:
        """One online pass over words that the tables have counted once each, their own count left out."""
        self.take(self.learned(words, rate))

    def learned(self, words: list[bytes], rate: float = 0.02) -> np.ndarray:
        """Of such a pass each gate's bits, its weights times these, and what came of its sums; passes over parts of the words may be added."""
        gates = len(self.weights)
        weights, cells, many = self.weights.copy(), np.zeros((gates * REFINED, 2)), np.zeros(gates)
        size = np.full((gates, 5), 1e-6)
        for lo in _cuts(words, 1 << 12):
            buf, start, contexts = self._contexts(words[lo])
            for k in range(8):
                bit, x, gate = self._inputs(buf, contexts, k, True)
                z = np.einsum("tk,kt->t", weights.astype(np.float32)[gate], x)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                g = np.stack([np.bincount(gate, (bit - p) * x[i], gates) for i in range(5)], 1)
                seen = np.bincount(gate, minlength=gates)
                many += seen
                size = np.where(seen[:, None] > 0, 0.98 * size + 0.02 * g * g, size)
                weights += rate * g / np.sqrt(size)
                cell = self._cell(z, gate)
                cells[:, 0] += np.bincount(cell, 1 - bit, len(cells))
                cells[:, 1] += np.bincount(cell, bit, len(cells))
            rate = max(0.002, rate * 0.998)
        return np.concatenate([many, (weights * many[:, None]).reshape(-1), cells.reshape(-1)])

    def take(self, learned: np.ndarray) -> None:
        """Go by a pass, or by the mean of several whose arrays were added."""
        gates = len(self.weights)
        many, weights, cells = np.split(learned, [gates, 6 * gates])
        self.weights = np.where(many[:, None] > 0, weights.reshape(gates, 5) / np.maximum(many, 1)[:, None], self.weights)
        self.refine = _refinement(cells.reshape(-1, 2))

    def bits_of(self, words: list[bytes], left_out: bool = False) -> np.ndarray:
        """Bits that each word takes, its own count left out if the tables hold it."""
        out = []
        for lo in _cuts(words):
            buf, start, contexts = self._contexts(words[lo])
            weights, refine, cost = self.weights.astype(np.float32), self.refine.astype(np.float32), np.zeros(len(buf))
            for k in range(8):
                bit, x, gate = self._inputs(buf, contexts, k, left_out)
                z = np.einsum("tk,kt->t", weights[gate], x)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                p = (p + refine[self._cell(z, gate)]) / 2
                cost -= np.log2(np.maximum(np.where(bit > 0, p, 1 - p), np.float32(1e-9)))
            out.append(np.add.reduceat(cost, start))
        return np.concatenate(out) if out else np.zeros(0)


def _cuts(words: list[bytes], most: int = 1 << 16) -> Iterator[slice]:
    """Runs of words of about ``most`` bytes."""
    if not words:
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


def _refinement(cells: np.ndarray) -> np.ndarray:
    middle = 1 / (1 + np.exp(-(np.arange(len(cells)) % REFINED - REFINED // 2) / 2))
    return (cells[:, 1] + 8 * middle) / (cells.sum(1) + 8)
