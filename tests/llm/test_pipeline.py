"""The pipeline against a brute-force version of its stages."""

import random
import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from krysalis.llm import bpe, secrets, simhash


#: Least and greatest zstandard ratios by bytes, written down again.
LIMITS = [(64, 0.0, 3.0), (256, 0.6, 4.0), (512, 1.26, 5.0), (1024, 1.34, 5.0), (4096, 1.45, 6.0), (65536, 1.6, 9.0), (float("inf"), 1.6, 12.0)]
SPACES = "[\\x20\\x09-\\x0D]+"


def keeps(text):
    """The quality rules in plain Python."""
    import zstandard

    def fits(raw):
        low, high = next((lo, hi) for below, lo, hi in LIMITS if len(raw) < below)
        return low <= len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw)) <= high

    words = [w for w in re.split(SPACES, text) if w]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    if len(words) < 20 or 100 * len(covered) > 30 * len(words):
        return False
    raw = text.encode()
    chunks = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
    return fits(raw) and (len(chunks) == 1 or 2 * sum(len(c) for c in chunks if not fits(c)) <= len(raw))


def least_similar(texts):
    """The smallest id reachable over Jaccard similarities of 0.8 and more of 5-word shingle sets, by all pairs."""
    words = {i: [w.lower() for w in t.encode().split()] for i, t in sorted(texts.items())}
    sets = {i: set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} - {()} for i, w in words.items()}
    label = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and label[i] != label[j] and 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_stages_and_run(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {i: t for i, t in docs.items() if keeps(t)}
    first: dict = {}
    for i, t in sorted(kept.items()):
        first.setdefault(re.sub(SPACES, " ", t), i)
    kept = {i: kept[i] for i in first.values()}
    label = least_similar(kept)
    kept = {i: t for i, t in kept.items() if label[i] == i}
    table = spark.createDataFrame(sorted(kept.items()), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(table).collect()}
    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = Counter({i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()})
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    got: Counter = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == want
    assert all(r["length"] <= 1024 for r in rows)


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(30), sf_dir)
        assert out.dtypes == docs.dtypes
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_near_stage_keeps_what_is_less_similar(spark, sf_dir):
    """Against exact similarities; candidates miss a pair at 0.8 with a probability under 0.0005."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label = least_similar({r["doc_id"]: r["text"] or "" for r in docs.collect()})
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, sf_dir).collect())
    assert kept == [i for i in label if label[i] == i]


def test_large_group_of_near_copies(spark):
    """Copies of one text with an edit each, and texts below the threshold, are told apart in rounds of nearest candidates."""
    rng = random.Random(5)
    words = ["w%d" % rng.randint(0, 9999) for _ in range(300)]
    copies = [" ".join(w if rng.random() > 0.01 else "x%d" % rng.randint(0, 999) for w in words) for _ in range(60)]
    apart = [" ".join(w if rng.random() > 0.06 else "y%d" % rng.randint(0, 999) for w in words) for _ in range(40)]
    texts = dict(enumerate(copies + apart))
    label = least_similar(texts)
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(df, group_cap=32).collect()}
    assert got == label and len(set(label.values())) > 10


def test_rounds_exchange_no_texts(spark):
    """Texts are dealt out by node once: what a round wants of them moves the wanted nodes only."""
    rows = [(k, f"a text of some words with number {k}") for k in range(50)]
    members = simhash._shingled(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 12)
    wanted = members.select("node").limit(5).repartition(12, "node").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = members.select("node", "text").join(wanted, "node", "left_semi").groupBy("node").count()
        plan = texts._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and texts.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_parities_lose_no_similar_pair():
    rng = np.random.default_rng(2)
    for size in (1, 5, 40, 500, 5000):
        for spoilt in (0.0, 0.05, 0.1, 0.12, 0.3):
            a = rng.integers(0, 1 << 63, size).astype(np.uint64)
            b = np.where(rng.random(size) < spoilt, rng.integers(0, 1 << 63, size).astype(np.uint64), a)
            rows = [np.r_[np.int64(len(set(x.tolist()))), simhash.parity(np.unique(x))][None] for x in (a, b)]
            if simhash.similar(set(a.tolist()), set(b.tolist())):
                assert simhash.can_be_similar(*rows)[0]
            elif spoilt == 0.3 and 40 <= size <= 500:
                assert not simhash.can_be_similar(*rows)[0]
