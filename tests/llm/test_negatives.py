"""Hard negatives against all pairs in plain Python."""

import numpy as np
import pytest

from krysalis.llm import negatives, queries
from tests.conftest import canonical


def slow(rows):
    """Triples by the definition, one anchor row at a time."""
    held = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        held.append((i, [int(np.floor(256 * v)) for v in x], (label + 1) % 10 if i % 7 == 0 else label))
    score = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, x, label in held:
        if i % 50:
            continue
        positives = sorted(((score(x, y), j) for j, y, other in held if other == label and j != i), key=lambda p: (-p[0], p[1]))[:5]
        for goal, j in positives:
            fits = [(score(x, y), k) for k, y, other in held if other != label and 50 * goal <= 100 * score(x, y) <= 95 * goal]
            out += [(i, j, rank + 1, k, goal, s) for rank, (s, k) in enumerate(sorted(fits, key=lambda p: (-p[0], p[1]))[:3])]
    return out


def awkward():
    rng = np.random.default_rng(5)
    vector = lambda n=12: [float(v) for v in rng.normal(0, 0.5, n)]
    rows = [(i, vector(), int(rng.integers(0, 10))) for i in range(400)]
    same = [0.5, -0.25] * 6
    rows += [(1000 + i, same, i % 3) for i in range(300)]  # ties of a common vector
    rows += [(50, vector(), 2), (50, vector(), 2), (51, same, 1), (51, same, 1)]  # ids that repeat
    rows += [(2000, None, 1), (2050, vector(), None), (None, same, 1), (2100, [1.0, None], 1), (2150, [float("nan")] * 12, 2), (2200, [float("inf")] * 12, 2)]
    rows += [(2250, [], 1), (2300, [0.5], 1), (2350, vector(30), 1), (-50, same, 4), (-49, same, 4)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("sizes", [(4096, 512), (64, 4)])
def test_mine(spark, sizes, monkeypatch):
    rows = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x], y) for i, x, y in awkward()]
    monkeypatch.setattr(negatives, "CANDIDATES", sizes[0])
    monkeypatch.setattr(negatives, "ANCHORS", sizes[1])
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", block int, score int").repartition(3)
    got = [tuple(r) for r in negatives.mine(df).collect()]
    assert sorted(got) == sorted(slow(rows))
    assert got


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_small_and_large_components(spark, scale, monkeypatch):
    """Tables of 16 and of 32 bits, sums of 32 and of 64, by many parts of the candidates."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in scale * rng.normal(0.1, 0.2, 12)], i % 4) for i in range(500)]
    monkeypatch.setattr(negatives, "CANDIDATES", 50)
    monkeypatch.setattr(negatives, "LOOKED", 16)
    got = [tuple(r) for r in negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert sorted(got) == sorted(slow(rows)) and got


def test_nothing_is_broadcast(spark):
    """The driver holds no blocks, and anchors are not repeated by the number of candidates."""
    df = spark.createDataFrame([(i, [0.5, 0.1 * (i % 7)], i % 3) for i in range(200)], SCHEMA)
    plan = negatives.mine(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    assert "Broadcast" not in plan and "Generate" not in plan


def test_empty_and_without_anchors(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 1)], SCHEMA)).count() == 0


def test_scores_by_lookup():
    rng = np.random.default_rng(1)
    for top, n, d in ((1, 5, 3), (200, 40, 64), (1 << 20, 9, 17)):
        c, a = rng.integers(-top, top, (n, d)), rng.integers(-top, top, (7, d))
        assert (negatives.scores(negatives.subset_sums(a), negatives.bit_planes(c)[1]) == c @ a.T).all()
    for c in (np.zeros((3, 4), np.int64), -np.ones((3, 4), np.int64), np.full((3, 4), 7)):
        assert (negatives.scores(negatives.subset_sums(c), negatives.bit_planes(c)[1]) == c @ c.T).all()


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        negatives.mine(spark.createDataFrame([(50, [1e30], 1), (1, [1e30], 1)], SCHEMA)).collect()


def test_query(spark, sf_dir, duck):
    df = queries.QUERIES["op12_hard_negatives"](spark, sf_dir)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op12_hard_negatives']})").fetchall()
    assert canonical([tuple(r) for r in df.select(*columns).collect()]) == canonical(expected)
