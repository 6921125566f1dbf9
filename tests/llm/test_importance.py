import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hexfeat.llm import importance


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(w, most):
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, len(words(t)), Counter(map(at, runs(words(t), most)))) for i, t in rows]
    s, t = sum((c for *_, c in found), Counter()), sum((Counter(map(at, runs(words(x), most))) for x in target), Counter())
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in range(buckets)}
    out = []
    for i, n_words, c in found:
        n = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[2], x[1]))
    rank = {id(x): r for r, x in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*x[:4], rank.get(id(x))) for x in out), key=str)


def sampled(docs, target, **how):
    return sorted((tuple(r) for r in importance.importance_sample(docs, target, **how).collect()), key=str)


def _targets(spark, texts):
    return spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "item_id long, text string, buckets string")


AIMS = ["alpha1 beta2 gamma3 delta", None, "", "Füße 漢字 tis don", "word word alpha"]


@pytest.mark.parametrize("how", [{}, {"percent": 50, "least": 2}, {"most": 3, "buckets": 97, "percent": 60, "least": 1, "seed": 7}])
def test_against_brute_force(spark, docs, texts, how):
    """Null and empty texts, copies, rows that repeat or lack a doc_id, one very long text; runs of several words as well."""
    renamed = {"least_words" if k == "least" else k: v for k, v in how.items()}
    assert sampled(docs, _targets(spark, AIMS), **renamed) == brute(texts, AIMS, **how)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_stretches_lose_no_run(monkeypatch, most):
    """Texts cut every few characters give the runs of the whole, those across the cuts included; a word without an end stays whole."""
    monkeypatch.setattr(importance, "STRETCH", 7)
    split = importance.Split(importance.Regex(importance._WORD), behavior="removed", invert=True)
    rng = random.Random(most)
    for _ in range(200):
        text = "".join(rng.choice("aBé漢7 _.\x00\x7f-\n") for _ in range(rng.randint(0, 80)))
        parts = list(importance.runs(text, split, most))
        assert Counter(f for _, found in parts for f in found) == Counter(runs(words(text), most))
        assert sum(n for n, _ in parts) == len(words(text))
    assert [f for _, found in importance.runs("漢" * 500, split, most) for f in found] == ["漢" * 500]


def test_ranks_over_many_partitions(spark):
    """Ties within and across partitions: equal texts have equal weights, repeated ids equal noise."""
    rng = random.Random(3)
    bodies = [" ".join(rng.choices(["a", "b", "c", "d"], k=25)) for _ in range(3)]
    rows = [(rng.randrange(300), rng.choice(bodies)) for _ in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert sampled(frame, _targets(spark, ["a a b"])) == brute(rows, ["a a b"])


def test_favours_the_target(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["sun", "sea", "sand"] if i % 4 == 0 else ["tax", "form", "line"], k=40))) for i in range(400)]
    ranks = [r for r in importance.importance_sample(spark.createDataFrame(rows, "doc_id long, text string"), _targets(spark, ["sun sea sand " * 30])).collect() if r["rank"]]
    assert len(ranks) == 40 and np.mean([r["doc_id"] % 4 == 0 for r in ranks]) > 0.8


def test_empty_tables(spark, docs, empty, texts):
    assert importance.importance_sample(empty, _targets(spark, AIMS)).count() == 0
    assert sampled(docs, _targets(spark, AIMS).filter("false")) == brute(texts, [])
    assert sampled(docs, _targets(spark, AIMS), least_words=10**6) == brute(texts, AIMS, least=10**6)
