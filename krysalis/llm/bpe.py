"""Byte-level BPE: exact encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from krysalis.llm.common import text_of

#: Strings a worker remembers; when full it starts anew. Speed only, no result depends on it.
CACHE = 600_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that end a word: a run of them after a letter or digit is a pre-token of its own.
MARKS = ".,!?;:*%&$#|"


def atoms(piece: str, lead: str) -> list[str]:
    """A piece of text, after ``lead`` (a space or nothing), cut where the pre-tokenizer always cuts.

    That is around a line break between other characters, and between a letter
    or digit and closing marks.
    """
    parts = piece.split("\n")
    if len(parts) > 1 and any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
        return [lead + piece]
    out = []
    for k, part in enumerate(parts):
        if k:
            out.append("\n")
            lead = ""
        core = part.rstrip(MARKS)
        if core and core != part and core[-1].isalnum():
            out += (lead + core, part[len(core) :])
        else:
            out.append(lead + part)
    return out


class SpaceCache:
    """Ids of whole texts from ids of their pieces, as little-endian 32-bit bytes.

    The pre-tokenizer always begins a new piece at a single space between two
    other characters, so a text can be cut there and the pieces looked up; a
    new piece is made of atoms. Where white space follows white space the text
    is encoded as one: a cut inside such a run could move its last blank.
    ``encode_all`` encodes strings as the tokenizer would whole texts.
    """

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]]):
        self.encode_all = encode_all
        self.spaced: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _joined(self, cut: list[list[str]]) -> list[bytes]:
        new = {a for c in cut for a in c}.difference(self.known)
        self.known.update(zip(new, self.encode_all(list(new)), strict=True))
        get = self.known.__getitem__
        return [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) + len(self.known) > CACHE:
            self.spaced, self.known = {}, {}
        cut = [t.split(" ") for t in texts]
        known = self.spaced
        new = set().union(*(c[1:] for c in cut)).difference(known)
        odd = {p for p in new if not p or p[0].isspace()}
        fine = list(new - odd)
        known.update(zip(fine, self._joined([atoms(p, " ") for p in fine]), strict=True))
        whole = [i for i, c in enumerate(cut) if odd and not odd.isdisjoint(c[1:])]
        for i in whole:
            cut[i] = [""]
        heads = self._joined([atoms(c[0], "") for c in cut])
        get = known.__getitem__
        out = [h + b"".join(map(get, c[1:])) for h, c in zip(heads, cut, strict=True)]
        for i, ids in zip(whole, self.encode_all([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


class PrefixEncoder:
    """BPE by dynamic programming: every prefix has one last token.

    An automaton over the vocabulary lists the tokens that end at each byte. A
    token is the last one of a prefix if the prefix is that token, or if the
    last token of what stands before it is compatible with it: if BPE, given
    the two tokens' bytes, would give the two tokens back. Exactly one token is,
    for each prefix; back-pointers from the end give the ids. Time is linear in
    the text whatever its words are.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from public_tokenizers import PATTERN

        model = json.load(open(path, encoding="utf-8"))
        self.words = regex.compile(PATTERN)
        special = [t["content"] for t in model["added_tokens"]]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        to_byte = _byte_alphabet()
        vocab = model["model"]["vocab"]
        raw = {t: "".join(chr(to_byte[c]) for c in t) for t in vocab if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        made = {a + b: (a, b) for a, b in merges}
        order = [t for t in raw if t not in made] + [a + b for a, b in merges if a + b in raw]  # by rank
        rank = {t: k for k, t in enumerate(order)}
        self.id = [vocab[t] for t in order]
        self.left = [rank[made[t][0]] if t in made else k for k, t in enumerate(order)]
        self.right = [rank[made[t][1]] if t in made else k for k, t in enumerate(order)]
        self.size = [len(raw[t]) for t in order]
        self.pair = {(rank[a], rank[b]): rank[a + b] for a, b in merges}
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(order):
            self.automaton.add_word(raw[t], k)
        self.automaton.make_automaton()
        self.tested: dict[tuple[int, int], bool] = {}
        self.bytes = {vocab[t]: raw[t].encode("latin-1") for t in order} | {i: s.encode() for s, i in self.special.items()}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps token ``a`` before token ``b`` apart, whole.

        It would not if some merge across their border came before the merges
        inside them: the last merge of either side is undone, the later one
        first, and at each step the pair at the border must not merge earlier
        than what was undone.
        """
        limit = len(self.id)
        while True:
            joined = self.pair.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit = a
                a = self.right[a]
                if a == limit:
                    limit = b + 1
                    b = self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.left[b]
                if b + 1 == limit:
                    limit = a
                    a = self.right[a]
                    if a == limit:
                        return True

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        last, size, tested = [-1] * (len(raw) + 1), self.size, self.tested
        for end, token in self.automaton.iter(raw):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size[token]
            if not start:
                last[end] = token
                continue
            pair = (last[start], token)
            fits = tested.get(pair)
            if fits is None:
                fits = tested[pair] = self.compatible(*pair)
            if fits:
                last[end] = token
        ids, at = [], len(raw)
        while at:
            ids.append(self.id[last[at]])
            at -= size[last[at]]
        ids.reverse()
        return ids

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.tested) > 4 * CACHE:
            self.tested = {}
        return [_packed(self.ids(t)) for t in texts]

    def ids(self, text: str) -> list[int]:
        parts = self.at_special.split(text) if self.at_special else [text]
        return [i for k, part in enumerate(parts) for i in ([self.special[part]] if k % 2 else [i for w in self.words.findall(part) for i in self.word(w)])]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, malformed UTF-8 replaced; unknown ids are skipped."""
        return b"".join([self.bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit bytes."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def prefix_encoder(path: str) -> tuple[PrefixEncoder, SpaceCache]:
    """One encoder per worker process and vocabulary."""
    encoder = PrefixEncoder(path)
    return encoder, SpaceCache(encoder.encode_all)


class LibraryEncoder:
    """The ids that the tokenizers library gives, as little-endian 32-bit bytes.

    Whole texts of characters below U+3000 without special tokens go through
    tiktoken with the file's vocabulary as ranks, which the tests hold against
    the tokenizers library over all these characters and over whole documents;
    the library does the rest, piece by piece, and everything if the file's ids
    are not in order of its merges.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.load(open(path, encoding="utf-8"))
        special = [t["content"] for t in model["added_tokens"]]
        to_byte, vocab = _byte_alphabet(), model["model"]["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        ordered = merged == sorted(merged)
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in special} if ordered else {}
        self.quick = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ordered else None
        self.special, self.plain = special, re.compile("[\x00-\u2fff]*", re.S)
        self.pieces = SpaceCache(self.by_library)

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for lo in range(0, len(texts), 1024) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 1024], add_special_tokens=False)]

    def is_plain(self, text: str) -> bool:
        return self.quick is not None and (text.isascii() or self.plain.fullmatch(text) is not None) and not any(x in text for x in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.is_plain(t) for t in texts]
        rest = iter(self.pieces.encode([t for t, p in zip(texts, plain, strict=True) if not p]) if not all(plain) else ())
        return [_packed(self.quick(t)) if p else next(rest) for t, p in zip(texts, plain, strict=True)]


@lru_cache(maxsize=2)
def library_cache(path: str) -> LibraryEncoder:
    """One encoder per worker process and vocabulary."""
    return LibraryEncoder(path)


def bpe_encode(docs: DataFrame, text_col: str = "text", path: str | None = None, carry: list[str] | None = None, derive: tuple[str, Callable] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) and ``ids array<int>``, one narrow pass.

    ``derive = (ddl, function)`` gives other columns in place of ``ids``: the
    function gets the encoder and a list of id lists and returns a list for each
    column. Null and empty texts have no ids; strings of special tokens become
    their ids, as in the tokenizers library. Repeated rows are rows of their
    own; input columns with an output's name are replaced.
    """
    path = path or tokenizer_path()
    made = StructType.fromDDL(derive[0]) if derive else StructType([StructField("ids", ArrayType(IntegerType()))])
    names = [c for c in (docs.columns if carry is None else carry) if c not in made.names]
    given = docs.select(*names, text_of(text_col).alias("__text"))
    function = derive[1] if derive else (lambda encoder, ids: [ids])
    kinds = _arrow(made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cache = prefix_encoder(path)
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 22) / max(batch.nbytes, 1)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids = [np.frombuffer(b, "<u4").tolist() for b in cache.encode(part.column(part.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, t) for c, t in zip(function(encoder, ids), kinds, strict=True))], [*names, *made.names])

    return given.mapInArrow(run, StructType([*given.schema.fields[:-1], *made.fields]))


def bpe_decode(docs: DataFrame, ids_col: str = "ids", path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) and ``decoded``, the text of ``ids_col``; null ids give an empty text."""
    path = path or tokenizer_path()
    names = [c for c in (docs.columns if carry is None else carry) if c != "decoded"]
    given = docs.select(*names, docs[ids_col].alias("__ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = prefix_encoder(path)
        for batch in batches:
            texts = [encoder.decode(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*names, "decoded"])

    return given.mapInArrow(run, StructType([*given.schema.fields[:-1], *StructType.fromDDL("decoded string").fields]))


def _arrow(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def op4_bpe_encode_decode(spark, sf_dir):
    """Ids of every document and the text they decode to, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def digests(encoder, ids):
        import hashlib

        shown = _decimals(len(encoder.bytes))
        joined = [hashlib.sha256(",".join([shown[i] for i in x]).encode()).hexdigest() for x in ids]
        decoded = [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids]
        return [[len(x) for x in ids], joined, decoded]

    return bpe_encode(docs, carry=["doc_id"], derive=("n_tokens long, ids_sha256 string, decoded_sha256 string", digests))


@lru_cache(maxsize=2)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]
