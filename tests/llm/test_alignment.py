"""Alignment against whole-text tokenizations and plain dictionaries."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from krysalis.llm import alignment, bpe, queries
from tests.llm.test_operators import awkward


def slow(rows):
    """One row a document: encodes whole texts with the libraries and compares all pairs of byte ranges."""
    a_model = Tokenizer.from_file(bpe.tokenizer_path())
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))
    to_byte = bpe._byte_alphabet()

    def ranges(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends[:-1]], ends, strict=True))

    held = []
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        a_parts = [bytes(to_byte[c] for c in a_model.id_to_token(k)) for k in a]
        b_parts = [bytes([int(b_model.id_to_piece(k)[3:5], 16)]) if b_model.is_byte(k) else b_model.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            held.append((i, [], [], [], []))
            continue
        ra, rb = ranges(a_parts), ranges(b_parts)
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = []
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
            side = lambda ids, r: ",".join(str(k) for k, (s, e) in zip(ids, r, strict=True) if lo <= s and e <= hi)  # noqa: B023, E731
            groups.append((side(a, ra), side(b, rb))) if len(a) < 400 else groups.append((lo, hi))
        links, j = [], 0
        for k, (s, e) in enumerate(ra):
            while rb[j][1] <= s:
                j += 1
            m = j
            while m < len(rb) and rb[m][0] < e:
                links.append((a[k], b[m]))
                m += 1
        held.append((i, a, b, groups, links))
    counts = Counter(x for *_, links in held for x in links)
    top = {}
    for (_, b), c in counts.items():
        top[b] = max(top.get(b, 0), c)
    out = []
    for i, a, b, groups, links in held:
        digest = hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if groups and len(a) < 400 else "" if not groups else None
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out, counts


EXTRA = ["a  b ", " ", "  ", " x", "x ", "\n x\ty  ", "a \n b", "▁ literal", "half ▁", "<s> <unk> <0x41> <|endoftext|>x", "it's we'll  I'D", "日本語 テスト　全角", "é ﬁ ½   nbsp  x", "\x00 \x1c y", "tab\t\t  z", "a" * 3000, " " * 500, "0123 4567 89!!??", "🙂🙂 🙃", "  line  x \u0085 y"]


def rows():
    base = [(i, t) for i, t in awkward() if t is None or len(t) < 20000]
    return base + [(900 + k, t) for k, t in enumerate(EXTRA)]


def shown(found):
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_alignment(spark, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows()], "doc_id long, text string, block int, n_a int").repartition(3)
    documents, pairs = alignment.align_tokenizers(docs)
    want, counts = slow(rows())
    got = {}
    for r in documents.collect():
        got.setdefault(r[0], []).append(tuple(r))
    for i in {r[0] for r in want}:
        mine, theirs = sorted(got.pop(i)), sorted(r for r in want if r[0] == i)
        assert [m[:7] for m in mine] == [t[:7] for t in theirs], i
        assert all(t[7] in (None, m[7]) for m, t in zip(mine, theirs, strict=True)), i
    assert not got
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(counts)


@pytest.mark.parametrize("cache", [400_000, 50])
def test_pieces_are_whole_texts(spark, cache, monkeypatch):
    """Texts cut into pieces have the ids that the libraries give whole texts, over all documents of sf0.001."""
    monkeypatch.setattr(alignment, "CACHE", cache)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + EXTRA
    by = alignment.Aligner(bpe.tokenizer_path(), bpe.tokenizer_path("piece_bpe_32k.model"))
    a_model = Tokenizer.from_file(bpe.tokenizer_path())
    a_model.encode_special_tokens = True
    for text, (a, b) in zip(texts, by.all_ids(texts), strict=True):
        if "▁" in text:
            assert not a and not b
            continue
        assert np.frombuffer(a, by.kind).tolist() == a_model.encode(" " + text, add_special_tokens=False).ids
        assert np.frombuffer(b, by.kind).tolist() == by.pieces.encode(text)


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(0, 1 << 47, n))
        levels = alignment.perfect_hash(keys)
        assert sorted(alignment.numbered(levels, keys).tolist()) == list(range(len(keys)))
        again = alignment._levels_in(alignment._levels_out(levels))
        assert all((a == b).all() for a, b in zip(levels, again, strict=True))
    levels = alignment.perfect_hash(keys)
    placed = np.empty_like(keys)
    placed[alignment.numbered(levels, keys)] = keys
    table = alignment.PairTable({"hash": alignment._levels_out(levels), "keys": placed.tobytes()})
    with pytest.raises(ValueError, match="not in its bucket"):
        table.at(np.array([1 << 48]))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    documents, pairs = alignment.align_tokenizers(none)
    assert documents.count() == 0 and pairs.count() == 0
    documents, pairs = alignment.align_tokenizers(spark.createDataFrame([(1, None), (1, ""), (None, None)], "doc_id long, text string"))
    assert sorted(map(str, documents.collect())) == sorted(map(str, documents.filter(F.col("n_links") == 0).collect())) and documents.count() == 3
    assert pairs.count() == 0


def test_query(spark, sf_dir):
    got = [tuple(r) for r in queries.QUERIES["op11_tokenizer_alignment"](spark, sf_dir).collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = slow(docs)
    assert [r[:7] for r in shown(got)] == [r[:7] for r in shown(want)]
    assert all(w[7] in (None, g[7]) for g, w in zip(shown(got), shown(want), strict=True))
