import math
import random

import numpy as np
import pytest

from hexfeat.llm import topk


def brute(rows, k=10, every=100):
    able = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, w) in enumerate(able):
        if q is None or q % every:
            continue
        others = [(sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, v) in enumerate(able) if m != n and len(v) == len(w)]
        others = sorted(((min(max(s, -(1 << 63)), (1 << 63) - 1), i) for s, i in others), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, r, i, s) for r, (s, i) in enumerate(others[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, label int, score double").repartition(3)
    return sorted((tuple(r) for r in topk.top_k(frame, **how).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Clusters, a common vector, nulls, components that are null or not finite, zeros, other lengths, ids that repeat or are missing."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = [(n, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for n in range(260)]
    rows += [(300 + n, centres[0]) for n in range(80)] + [(700, None), (800, [None] * 12), (900, [1.0] * 11 + [math.inf]), (1000, [math.nan] * 12), (1100, [0.0] * 12), (1200, []), (1300, []), (1400, [0.5, -0.5]), (None, centres[1]), (100, centres[2]), (100, centres[2])]
    assert searched(spark, rows, block=64, group=3) == brute(rows)


def test_equal_scores_go_to_smaller_ids(spark):
    rows = [(n, [1.0, -1.0]) for n in range(200)] + [(n, [2.0, 0.0]) for n in range(200, 203)]
    assert searched(spark, rows, block=50) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(n, [float(1 << 40) + n, 3.0 - n]) for n in range(0, 300, 25)] + [(1001, [1e300, 1.0]), (1002, [-1e305, 0.0]), (1100, [1e299, -1.0])]
    assert searched(spark, rows, block=64) == brute(rows)


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0]), (1, [0.5]), (2, [-0.5])]
    assert searched(spark, rows) == brute(rows)
    assert searched(spark, rows[:1]) == []


def test_empty_and_without_queries(spark):
    frame = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(frame).count() == 0
    assert topk.top_k(frame.filter("false")).count() == 0


def test_bounds_keep_the_best_and_stop_early(monkeypatch):
    """Whatever is out is truly behind the k-th score, and reading stops before the lists end where few are near."""
    rng = np.random.default_rng(5)
    vectors = np.floor(rng.normal(0, 100, (500, 16)))
    vectors[:12] = 5 * vectors[0] + np.floor(rng.normal(0, 50, (12, 16)))  # near each other, and long
    queries = np.vstack([vectors[:3], vectors[100:103]])
    own = np.array([0, 1, 2, 100, 101, -1])
    found = topk.remaining(topk.Lists(vectors), queries, own, 5)
    for q, o, left in zip(queries, own, found, strict=True):
        scores = vectors @ q
        scores[o if o >= 0 else []] = -np.inf
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(left) and o not in left
    read = []
    monkeypatch.setattr(topk.np, "hstack", lambda x, f=np.hstack: read.append(1) or f(x))
    topk.remaining(topk.Lists(vectors), queries[:3], own[:3], 5)
    assert len(read) < len(topk.DEPTHS) - 1
