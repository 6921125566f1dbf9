import random
import re
from collections import Counter
from itertools import permutations

import pytest

from hexfeat.llm import filter_audit

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    """Every order played document by document. rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": t in first and (i is None or i > first[t]),
        }
        mine = [x for x in labels if i is not None and x[0] == i]
        docs.append((s or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in docs if d[0] == part)
                out[part, order, step] = [len(left), len(removed), sum(d[1][f] for d in gone), alone, sum(d[2] for d in removed), sum(d[3] for d in removed)]
                shapley[part, f] += len(removed)
                gone += removed
    return {k: tuple(v) + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def audited(frame, labels):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in filter_audit.filter_audit(frame, labels).collect()}


def _labels(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, quality int, toxic int, mask string, n int")


def test_awkward_rows_against_brute_force(spark, docs, texts):
    """Null and empty texts, copies, rows that repeat or lack a doc_id, one very long text, extra columns with clashing names."""
    rows = [(i, t, None if n % 3 else "src0") for n, (i, t) in enumerate(texts)]
    labels = [(3, 1, 0), (6, None, 1), (11, 1, None), (11, 0, 1), (12, 1, 1), (99, 1, 1), (None, 1, 1)]
    assert audited(docs, _labels(spark, labels)) == brute(rows, labels)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["LOUD", "A|B", "x"]
    bodies = [" ".join(rng.choices(words[: rng.choice([5, 40, 63])], k=rng.choice([0, 10, 49, 50, 51, 120]))) for _ in range(25)]
    rows = [(rng.choice([None, *range(80)]), rng.choice([None, *bodies]), rng.choice(["a", "b", "", None])) for _ in range(150)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 80, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert audited(frame, _labels(spark, labels)) == brute(rows, labels)


def test_thresholds_on_both_sides(spark):
    fifty = [f"w{k}" for k in range(50)]
    cases = {
        "49 words": (" ".join(fifty[:49]), 1), "50 words": (" ".join(fifty), 0), "65 %": (" ".join([*(f"v{k}" for k in range(65)), *["v0"] * 35]), 0),
        "64 %": (" ".join([*(f"v{k}" for k in range(64)), *["v0"] * 36]), 2), "5 % capitals": ("é" * 93 + "\x0b" + " A" * 3 + "A" * 2 + "é" * 0, 1 | 4 * (5 * 100 > 5 * 102)),
        "symbol": (" ".join(fifty) + " |", 8),
    }
    frame = spark.createDataFrame([(n, t, "s") for n, (t, _) in enumerate(cases.values())], "doc_id long, text string, part string")
    found = {r["doc_id"]: r["mask"] for r in filter_audit.text_failures(frame).collect()}
    assert found == {n: m for n, (_, m) in enumerate(cases.values())}


def test_ranks_of_removal():
    orders, ranks, masks = filter_audit.removal_ranks(3)
    for o, order in enumerate(orders):
        for m, mask in enumerate(masks):
            assert ranks[o, m] == next((step for step, f in enumerate(order) if mask[f]), 3)


def test_empty(spark, empty):
    assert filter_audit.filter_audit(empty, _labels(spark, [(1, 1, 1)])).count() == 0


def test_no_labels(docs, spark):
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in filter_audit.filter_audit(docs, _labels(spark, [(1, 1, 1)]).filter("false")).collect())
