"""The classifier's parts against slow versions, its isolation from held-out labels, and held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from krysalis.llm import classifier, queries


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def slow_indicators(text):
    """Distinct byte n-grams and word patterns by plain loops, as keys instead of places."""
    raw = text.encode().lower()
    grams = {raw[k : k + n] for n in (1, 2, 3) for k in range(len(raw) - n + 1)}
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    share = lambda k, n: 0 if not k else 1 + k * 16 // n
    shape = [(lag, share(sum(a == b for a, b in zip(words[lag:], words, strict=False)), len(words))) for lag in (1, 2, 3, 4, 8)]
    shape += [("words", share(len(words) - len(set(words)), len(words))), ("lines", share(len(lines) - len(set(lines)), len(lines))), ("length", len(words).bit_length())]
    return grams, shape


@pytest.mark.parametrize("slice_", [1 << 20, 64])
def test_indicators(slice_, monkeypatch):
    monkeypatch.setattr(classifier, "SLICE", slice_)
    classifier._powers.cache_clear()
    texts = ["", "a", "ab", "One two TWO two\none two\n\none two\n", "é ü é", "x " * 300, "the cat sat on the mat " * 40 + "end", "\n\n \t", "short line\nshort line\nother words\n" * 30]
    texts = [t for t in texts if max(map(len, t.split("\n"))) < slice_]
    place = lambda codes, kind: {int(p) for p in classifier._place(np.array(codes, np.uint64), kind)} if codes else set()
    for text in texts:
        grams, shape = slow_indicators(text)
        want = {g[0] for g in grams if len(g) == 1} | place([g[0] << 8 | g[1] for g in grams if len(g) == 2], 2) | place([g[0] << 16 | g[1] << 8 | g[2] for g in grams if len(g) == 3], 3)
        numbers = [k * 100 + v if isinstance(k, int) else {"words": 5000, "lines": 6000, "length": 7000}[k] + v for k, v in shape]
        assert set(classifier.indicators(text).tolist()) == want | place(numbers, 9), text
    classifier._powers.cache_clear()


def test_log_count_ratios():
    rows = [np.array([1, 2]), np.array([2, 3]), np.array([3])]
    r = classifier.log_count_ratios(rows, np.array([1, 1, 0]))
    n = 1 << classifier.BITS
    assert np.isclose(r[2], np.log(3 / (n + 4)) - np.log(1 / (n + 1)))
    assert np.isclose(r[3], np.log(2 / (n + 4)) - np.log(2 / (n + 1)))


def test_dual_descent_reaches_the_optimum(monkeypatch):
    """The duality gap closes: the primal hinge loss meets the dual value."""
    monkeypatch.setattr(classifier, "PASSES", 400)
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    y = rng.integers(0, 2, 60)
    ratios = np.zeros(1 << classifier.BITS)
    ratios[:40] = rng.normal(0, 0.4, 40)
    w, bias = classifier.dual_descent(rows, ratios, y)
    sign = np.where(y > 0, 1, -1)
    dense = np.zeros((60, 41))
    for k, x in enumerate(rows):
        dense[k, x], dense[k, 40] = ratios[x], 1
    v = np.append(w[:40], bias)
    primal = 0.5 * v @ v + np.maximum(0, 1 - sign * (dense @ v)).sum()
    best = min(0.5 * u @ u + np.maximum(0, 1 - sign * (dense @ u)).sum() for u in (v + rng.normal(0, s, 41) for s in (0.001, 0.01, 0.1) for _ in range(200)))
    assert primal <= best + 1e-2


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "alone"), (3, "a b c " * 50), (4, "a b c " * 50), (5, "x" * 3_000_000)]
    rows += [(10 + k, ("good prose here " if k % 2 else "### $$$ ### ") * 20) for k in range(60)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, Score string, predicted string").repartition(3)
    labels = spark.createDataFrame([(10 + k, k % 2) for k in range(60)] + [(10, None), (None, 1), (999, 1), (11, 0)], "doc_id long, quality int")
    got = classifier.classify(docs, classifier.fit_classifier(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    verdict = {r["doc_id"]: r["predicted"] for r in got}
    assert all(verdict[10 + k] == k % 2 for k in range(60) if k > 1)
    none = docs.limit(0)
    assert classifier.classify(none, classifier.fit_classifier(none, labels)).count() == 0
    flat = classifier.classify(docs, classifier.fit_classifier(docs, labels.limit(0))).collect()
    assert {r["score"] for r in flat} == {0.5}


def test_held_out_labels_change_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (classifier.fit_classifier(docs, x) for x in (labels, flipped))
    assert (a[0] == b[0]).all() and a[1:] == b[1:]


def test_bounds_of_the_sample(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert classifier.labelled_sample(docs, labels, fit_rows=10).count() <= 10
    few = classifier.labelled_sample(docs, labels, fit_features=5000)
    assert 0 < few.agg(F.sum(F.size("places"))).first()[0] <= 5000


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_quality_classifier"](spark, sf_dir).collect()
    want = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    judged = [r["predicted"] == want[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in want]
    assert np.mean(judged) >= 0.93
