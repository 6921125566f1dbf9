import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from hexfeat.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        longest, _, keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, keep, len(groups[norm]), i == keep and len(t) == -longest, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(docs, texts):
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(docs).collect()), key=str) == brute(texts)


def test_colliding_digests_are_told_apart_by_content(docs, texts):
    weak = lambda norm: F.encode(F.substring(norm, 1, 1), "UTF-8")
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(docs, salts=2, digest=weak).collect()), key=str) == brute(texts)


def test_repeated_ids_with_texts_of_different_length(spark):
    rows = [(5, "a b"), (5, "ab"), (6, "a  b c"), (6, "abc"), (7, "ab c"), (None, "a  bc"), (None, "a   b   c")]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)
    assert sum(r["kept"] for r in found) == 2


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
