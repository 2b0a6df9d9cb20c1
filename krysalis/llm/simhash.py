"""SimHash near-deduplication by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from krysalis.llm.common import bucketed, drop_shuffles, materialize, text_of
from krysalis.llm.components import connected_components

SEED = 42
BITS = 64
#: Distinct fingerprints that one task joins at most; larger groups are dealt out in pairs of parts.
GROUP_CAP = 4096
#: Fingerprints of whole groups whose tries are joined at once, and the pairs of a node pair that are compared outright.
JOINED, FEW = 4096, 4


def fingerprint(text: str, words_in_shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash; ties of a bit give 0, and so does a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = words_in_shingle
    parts = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(p, SEED) for p in parts], np.uint64))


def fingerprints(docs: DataFrame, text_col: str = "text", words_in_shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) and ``fp``, the fingerprint as a signed long; one narrow pass."""
    names = [c for c in (docs.columns if carry is None else carry) if c != "fp"]
    given = docs.select(text_of(text_col).alias("__text"), *names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words_in_shingle) for t in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], [*names, "fp"])

    return given.mapInArrow(run, StructType([*given.schema.fields[1:], StructField("fp", LongType())]))


def trie_links(group: np.ndarray, fp: np.ndarray, errors: int, wide: np.ndarray | None = None, wide_errors: int = 0, outright: int = 1, tally: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``errors`` bits of each other and in one group; sorted by (group, fp), fp unsigned.

    Where ``wide`` (rows of 64-bit words) is given, pairs must be within
    ``wide_errors`` bits there as well.

    Each group is a binary trie over its sorted fingerprints, a node being a
    range. All node pairs of a level move down together: a pair of equal nodes
    gives its two children and their cross pair, a pair of different nodes its
    four child pairs, and a child pair on opposite bits adds one to its error
    count. Pairs over the budget are pruned, subtrees and all. Node pairs of at
    most ``outright`` pairs of fingerprints are compared as they are. ``tally``
    gets the numbers of node pairs visited and pruned, and of pairs compared.
    """
    if not len(fp):
        return
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(fp)]
    node = np.stack([starts, ends, starts, ends], 1).astype(np.int64)
    spent = np.zeros(len(node), np.int64)
    for bit in range(BITS - 1, -2, -1):
        size = (node[:, 1] - node[:, 0]) * (node[:, 3] - node[:, 2])
        same = node[:, 0] == node[:, 2]
        small = (size <= outright) | (bit < 0)
        alone = same & (size == 1)
        if tally is not None:
            tally["visited"] = tally.get("visited", 0) + len(node)
            tally["compared"] = tally.get("compared", 0) + int(size[small & ~alone].sum())
        yield from _compared(node[small & ~alone], fp, errors, wide, wide_errors)
        node, spent, same = node[~small], spent[~small], same[~small]
        if not len(node):
            return
        ones = np.r_[0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        a0, a2, b0, b2 = node.T
        a1, b1 = a2 - (ones[a2] - ones[a0]), b2 - (ones[b2] - ones[b0])
        down = [np.stack(x, 1) for x in ((a0, a1, b0, b1), (a1, a2, b1, b2), (a0, a1, b1, b2))]
        cost = [spent, spent, spent + 1]
        other = ~same
        down.append(np.stack((a1, a2, b0, b1), 1)[other])
        cost.append(spent[other] + 1)
        node, spent = np.concatenate(down), np.concatenate(cost)
        held = (node[:, 0] < node[:, 1]) & (node[:, 2] < node[:, 3])
        if tally is not None:
            tally["pruned"] = tally.get("pruned", 0) + int((held & (spent > errors)).sum())
        held &= spent <= errors
        node, spent = node[held], spent[held]


def _compared(node: np.ndarray, fp: np.ndarray, errors: int, wide: np.ndarray | None, wide_errors: int, at_once: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of each node pair, tested; in pieces of bounded size."""
    size = (node[:, 1] - node[:, 0]) * (node[:, 3] - node[:, 2])
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + at_once, "right")))
        part, n = node[lo:hi], size[lo:hi]
        lo = hi
        row = np.repeat(np.arange(len(part)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        width = (part[:, 3] - part[:, 2])[row]
        a, b = part[row, 0] + k // width, part[row, 2] + k % width
        near = (a < b) | (part[row, 0] != part[row, 2])
        near &= np.bitwise_count(fp[a] ^ fp[b]) <= errors
        a, b = a[near], b[near]
        if wide is not None:
            near = np.bitwise_count(wide[a] ^ wide[b]).sum(1) <= wide_errors
            a, b = a[near], b[near]
        yield a, b


def forest(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index of each index's component: links are folded in piece by piece, so only n labels are held."""
    label = np.arange(n)
    for a, b in links:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def tables_for(n: int, errors: int, least: int = 1, group: int = GROUP_CAP // 2) -> list[int]:
    """Bit masks such that fingerprints within ``errors`` bits agree on one mask at least.

    The 64 bits are cut into blocks; the masks are the choices of blocks that
    stay when ``errors`` are spoilt, of each block no more than the first bits,
    as few as give groups of some ``group`` of ``n`` fingerprints. So a mask cuts
    the trie (its levels in another order) into subtrees that are large enough for
    the join to prune, and tasks stay alike for any number of rows. Where one
    block has too few bits, there are more blocks, ``least`` more than errors at
    least.
    """
    need, extra = (max(1, n) // max(1, group)).bit_length(), least
    while extra < BITS - errors and extra * (BITS // (errors + extra)) < need:
        extra += 1
    edges = [BITS * k // (errors + extra) for k in range(errors + extra + 1)]
    widths = [min(hi - lo, -(-need // extra)) for lo, hi in zip(edges, edges[1:], strict=False)]
    blocks = [((1 << w) - 1) << (hi - w) for w, hi in zip(widths, edges[1:], strict=True)]
    return sorted({sum(c) for c in combinations(blocks, extra)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hamming_links(distinct: DataFrame, errors: int = 3, group_cap: int = GROUP_CAP, wide: tuple[str, ...] = (), wide_errors: int = 0, least: int = 1) -> DataFrame:
    """Edges ``(u, v)`` of a spanning forest of all pairs of ``distinct(fp)`` within ``errors`` bits.

    With ``wide`` columns pairs must also be within ``wide_errors`` bits over
    these words, and nodes are named by the column ``node``, else by ``fp``.

    Fingerprints meet under each mask of ``tables_for``, half of ``group_cap`` to
    a group; a group of over ``group_cap`` is cut into parts by hash and each pair
    of parts is a group of its own, so every pair still meets and no task holds
    more than two parts' rows. In a group the trie self-join finds the links, of
    which a spanning forest is emitted: components are those of all links, and
    rows stay under one per member.
    """
    grouped = subtrees(distinct, errors, group_cap, wide, least)
    width = len(grouped.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, width, JOINED):
            yield _edges(rows, errors, wide_errors)

    return grouped.mapInArrow(run, "u long, v long")


def subtrees(distinct: DataFrame, errors: int, group_cap: int, wide: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """``(g, node, fp, wide ...)``: the groups of ``hamming_links``, sorted by group."""
    if "node" not in distinct.columns:
        distinct = distinct.withColumn("node", F.col("fp"))
    columns = ["node", "fp", *wide]
    masks = tables_for(distinct.count(), errors, least, group_cap // 2)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    return _dealt(distinct.select(*columns, F.explode(keys).alias("k")).select(*columns, "k.t", "k.key"), columns, group_cap)


def _dealt(keyed: DataFrame, columns: list[str], group_cap: int) -> DataFrame:
    """``(g, columns ...)`` of ``keyed(columns ..., t, key)``, sorted by group; groups over ``group_cap`` are dealt out in pairs of parts."""
    large = keyed.groupBy("t", "key").count()
    large = materialize(large.filter(F.col("count") > group_cap).select("t", "key", F.ceil(F.col("count") / group_cap).cast("int").alias("parts")))
    if large.isEmpty():
        dealt = keyed.select(*columns, "t", "key", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        sized = keyed.join(large, ["t", "key"], "left").select(*columns, "t", "key", F.coalesce("parts", F.lit(1)).alias("parts"))
        part = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        dealt = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*columns, "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.select(F.xxhash64("t", "key", "i", "j").alias("g"), *columns).repartition("g").sortWithinPartitions("g")


def _whole_groups(batches: Iterable[pa.RecordBatch], width: int, at_once: int = 100_000) -> Iterator[np.ndarray]:
    """Rows that come sorted by group, whole groups some ``at_once`` rows at a time."""
    held = np.zeros((0, width), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], 1)])
        whole = int(np.searchsorted(held[:, 0], held[-1, 0], "left")) if len(held) else 0
        if whole < at_once:
            continue
        edges = np.r_[np.flatnonzero(np.r_[True, held[1:whole, 0] != held[: whole - 1, 0]]), whole]
        lo = 0
        while lo < whole:
            hi = int(edges[max(np.searchsorted(edges, lo + at_once, "right") - 1, np.searchsorted(edges, lo, "right"))])
            yield held[lo:hi]
            lo = hi
        held = held[whole:]
    yield held


def _edges(rows: np.ndarray, errors: int, wide_errors: int) -> pa.RecordBatch:
    """The forest of rows (group, node, fp, wide words)."""
    rows = rows[np.lexsort((rows[:, 2].view(np.uint64), rows[:, 0]))]
    node, fp = rows[:, 1], np.ascontiguousarray(rows[:, 2]).view(np.uint64)
    wide = np.ascontiguousarray(rows[:, 3:]).view(np.uint64) if rows.shape[1] > 3 else None
    root = forest(len(rows), trie_links(rows[:, 0], fp, errors, wide, wide_errors, FEW))
    i = np.flatnonzero(root != np.arange(len(rows)))
    return pa.RecordBatch.from_arrays([pa.array(node[root[i]]), pa.array(node[i])], ["u", "v"])


def near_components(fps: DataFrame, id_col: str = "doc_id", errors: int = 3, group_cap: int = GROUP_CAP, wide: tuple[str, ...] = (), wide_errors: int = 0, least: int = 1) -> DataFrame:
    """``fps(id, fp, wide ...)`` with ``component_id``: the smallest id reachable over links.

    Rows link within ``errors`` bits of ``fp`` and ``wide_errors`` bits of
    ``wide``. Equal fingerprints are one node, so copies cost no pairs. A null
    id is never a component's name unless all its ids are null. Repeated rows
    keep a row each.
    """
    node = F.xxhash64("fp", *wide) if wide else F.col("fp")
    fps = materialize(fps.withColumn("node", node))
    nodes = materialize(fps.groupBy("node").agg(F.min(id_col).alias("least"), *(F.min(c).alias(c) for c in ("fp", *wide))))
    edges = materialize(hamming_links(nodes.drop("least"), errors, group_cap, wide, wide_errors, least))
    roots = connected_components(edges).withColumnRenamed("node", "n")
    placed = nodes.join(roots, nodes["node"] == roots["n"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    placed = materialize(placed)
    names = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    by_node = materialize(placed.join(names, "root").select("node", "component_id"))
    return fps.join(by_node, "node").drop("node")


#: Near duplicates on word shingles: words in a shingle, and the words of 256 fingerprint bits.
SHINGLE_WORDS, WIDE = 5, ("w0", "w1", "w2", "w3")
#: Min-hash bands that bring candidates together: at similarity 0.8 a pair shares none with probability (1 - 0.8 ** 4) ** 16 < 0.0003.
BANDS, BAND_ROWS = 16, 4
#: Budget of the trie join on 64 bits of the shingle fingerprint: at similarity 0.8 they differ in 9.7 on average, with deviation 2.9.
#: LOOSE_ERRORS is that of all 256 bits: 38.8 on average, with deviation 5.7, so one pair in 10,000 is over it. Both only spare comparisons of shingles.
TRIE_ERRORS, LOOSE_ERRORS, OUTRIGHT = 24, 60, 64
#: Words of the parity bits of a shingle set. Two sets differ in as many shingles at least as their parities in bits.
ODD = tuple(f"s{k}" for k in range(16))
#: Text of a bucket of the table that all rounds read.
BUCKET_BYTES = 1 << 23
#: Rounds of nearest candidates go on while this share of the pairs compared is linked.
WORTH = 1 / 16
_XOR, _ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
_ODD |= np.uint64(1)


def shingle_set(text: str) -> set[bytes]:
    """The 5-word shingles of a text; a shorter text is one shingle, and one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    k = SHINGLE_WORDS
    return set(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))) if len(words) >= k else {b" ".join(words)} - {b""}


def _digests(parts: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], np.uint64)


def _wide(base: np.ndarray) -> list[int]:
    """256 bits of SimHash of the shingle digests ``base``."""
    out = []
    for r in range(len(WIDE)):
        mixed = (base + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(mixed ^ mixed >> np.uint64(29)))
    return out


def band_keys(base: np.ndarray) -> np.ndarray:
    """A key for each band, which two sets share with probability J ** BAND_ROWS for their Jaccard similarity J."""
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(base), 1 << 12):
        mixed = (base[lo : lo + (1 << 12)] ^ _XOR) * _ODD
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, (mixed * np.uint64(0x94D049BB133111EB)).min(axis=1), out=least)
    key = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key


def _majority(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big") if len(hashes) else 0


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cap: int = GROUP_CAP) -> DataFrame:
    """``(id, component_id)``: documents that share four fifths of their 5-word shingles are in one component.

    Candidates share a min-hash band and are within the loose budgets of the trie
    join on the shingle fingerprint; those whose shingle sets have a Jaccard
    similarity of 0.8 or more are linked. Equal sets are one node. In each round
    every node is compared with its nearest candidates of other components, which
    joins a large group in a few rounds by rows in proportion to its members;
    when that hardly links any more, all candidates of different components are
    compared but those whose parity bits show that they cannot be similar enough,
    so no link between components is lost.
    """
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    files = int(min(1 << 15, max(12, size // BUCKET_BYTES)))
    members = _shingled(docs, id_col, text_col, files)
    drop_shuffles(docs.sparkSession)
    nodes = members.groupBy("node").agg(*(F.first(c).alias(c) for c in ("bands", *WIDE, "size", *ODD)))
    nodes = materialize(_shared_bands(materialize(nodes)).withColumn("root", F.col("node")))
    links, nearest = None, True
    while True:
        pairs = materialize(_candidates(nodes, group_cap, nearest))
        found = _linked(pairs, members, files)
        links = found if links is None else links.unionByName(found)
        roots = connected_components(links)
        if not nearest:
            return _named(members.select("id", "node"), roots)
        nodes = materialize(nodes.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        nearest = found.count() > WORTH * pairs.count()


def _shared_bands(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``bands`` as an array of (t, key), without the keys that no other node has.

    A key that occurs once names its node in the count itself, so only keys and
    nodes are exchanged, and the rounds deal out what can have a partner.
    """
    keyed = nodes.select("node", F.posexplode("bands").alias("t", "key"))
    alone = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n = 1")
    masks = alone.groupBy("node").agg(F.expr("bit_or(shiftleft(1, t))").alias("alone"))
    shared = F.expr("filter(transform(bands, (x, i) -> named_struct('t', i, 'key', x)), x -> coalesce(alone, 0) & shiftleft(1, x.t) = 0)")
    return nodes.join(masks, "node", "left").withColumn("bands", shared).drop("alone")


def _candidates(nodes: DataFrame, group_cap: int, nearest: bool) -> DataFrame:
    """Distinct pairs ``(u, v)`` of ``nodes(node, bands of (t, key), w0 ... w3, root)`` of different roots within the loose budgets.

    With ``nearest`` a group gives the pair of least distance of each member
    only, else all.
    """
    columns = ["node", "root", *WIDE, *(() if nearest else ("size", *ODD))]
    grouped = _dealt(nodes.select(*columns, F.explode("bands").alias("band")).select(*columns, "band.t", "band.key"), columns, group_cap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, 1 + len(columns)):
            rows = rows[np.lexsort((rows[:, 3].view(np.uint64), rows[:, 0]))]
            wide = np.ascontiguousarray(rows[:, 3 : 3 + len(WIDE)]).view(np.uint64)
            best = np.full(len(rows), np.iinfo(np.int64).max)
            for a, b in trie_links(rows[:, 0], np.ascontiguousarray(wide[:, 0]), TRIE_ERRORS, wide, LOOSE_ERRORS, OUTRIGHT):
                apart = rows[a, 2] != rows[b, 2]
                a, b = a[apart], b[apart]
                if nearest:
                    away = np.bitwise_count(wide[a] ^ wide[b]).sum(1, dtype=np.int64) << 40
                    np.minimum.at(best, a, away + b)
                    np.minimum.at(best, b, away + a)
                    continue
                for lo in range(0, len(a), 1 << 16):
                    i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                    could = can_be_similar(rows[i, 3 + len(WIDE) :], rows[j, 3 + len(WIDE) :])
                    yield _pairs(rows[i[could], 1], rows[j[could], 1])
            found = np.flatnonzero(best < np.iinfo(np.int64).max)
            yield _pairs(rows[found, 1], rows[best[found] & ((1 << 40) - 1), 1])

    return grouped.mapInArrow(run, "u long, v long").distinct()


def can_be_similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of (size, parity words) of two sets, whether their Jaccard similarity can be four fifths; no pair that has it is lost.

    It is (n - d) / (n + d) for n the sum of the sizes and d the number of
    shingles that only one has, which the parities' differing bits do not exceed.
    """
    d = np.maximum(np.abs(a[:, 0] - b[:, 0]), np.bitwise_count((a[:, 1:] ^ b[:, 1:]).view(np.uint64)).sum(1, dtype=np.int64))
    return 9 * d <= a[:, 0] + b[:, 0]


def parity(base: np.ndarray) -> np.ndarray:
    """Bits that an odd number of the digests ``base`` fall on."""
    odd = np.bincount((base >> np.uint64(20) & np.uint64(64 * len(ODD) - 1)).astype(np.int64), minlength=64 * len(ODD)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])


def _linked(pairs: DataFrame, members: DataFrame, files: int) -> DataFrame:
    """The pairs of nodes whose shingle sets have a Jaccard similarity of 0.8 or more, counted from the texts of ``members(node, text)``.

    Nodes are dealt out as ``members`` is bucketed, so of the texts only those of
    candidates are moved.
    """
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).repartition(files, "node").distinct()
    texts = materialize(members.select("node", "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lru_cache(64)(shingle_set)
        for batch in batches:
            alike = [similar(sets(a.as_py()), sets(b.as_py())) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(alike, pa.bool_()))

    return materialize(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))


def similar(a: set, b: set) -> bool:
    """Whether the Jaccard similarity is four fifths or more."""
    common = len(a & b)
    return 5 * common >= 4 * (len(a) + len(b) - common)


def _shingled(docs: DataFrame, id_col: str, text_col: str, files: int) -> DataFrame:
    """A table ``(id, text, node, bands, w0 ... w3, size, s0 ... s15)`` in ``files`` buckets by node: a row for each document, its node being a digest of its shingle set.

    Texts are exchanged once here and by no later round.
    """
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, bands, wide, odd = [], [], [], []
            for text in batch.column(1).to_pylist():
                base = np.sort(_digests(shingle_set(text)))
                node.append(xxhash.xxh64_intdigest(base.tobytes(), SEED))
                bands.append(band_keys(base).view(np.int64))
                wide.append(_wide(base))
                odd.append(np.r_[np.int64(len(base)), parity(base)])
            columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (node, *(zip(*wide, strict=True) if wide else [[]] * len(WIDE)))]
            columns += [pa.array(c) for c in np.array(odd, np.int64).reshape(-1, 1 + len(ODD)).T.copy()]
            yield pa.RecordBatch.from_arrays([*batch.columns, columns[0], pa.array(bands, pa.list_(pa.int64())), *columns[1:]], ["id", "text", "node", "bands", *WIDE, "size", *ODD])

    schema = StructType([*given.schema.fields, *StructType.fromDDL("node long, bands array<long>").fields, *(StructField(c, LongType()) for c in (*WIDE, "size", *ODD))])
    return bucketed(given.mapInArrow(run, schema).repartition(files, "node"), "node", files, "zstd")


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members(id, node)`` as ``(id, component_id)``, the smallest id of the node's component in ``roots(node, root)``."""
    nodes = members.groupBy("node").agg(F.min("id").alias("least"))
    placed = materialize(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    names = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    by_node = materialize(placed.join(names, "root").select("node", "component_id"))
    return members.join(by_node, "node").select("id", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows of which one document of each near-duplicate group stays, the one of smallest id.

    Null text counts as empty; all empty texts are one group. Rows that repeat
    the id that stays all stay. Rows with a null id stay only in groups without ids.
    """
    gone = materialize(near_duplicates(docs, id_col, text_col).filter("not (id <=> component_id)").select(F.col("id").alias("__id")).distinct())
    drop_shuffles(docs.sparkSession)  # a table of ids: its size, known now, says how rows are joined
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left_anti")


def op8_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_components(fingerprints(docs, carry=["doc_id"]))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
