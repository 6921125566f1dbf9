import random
from itertools import combinations

import numpy as np
import pytest

from hexfeat.llm import ngram_join


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[i : i + 4]) for i in range(len(w) - 3)])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    top = {n: n for n in range(len(sets))}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 85 * len(x | y) or sets[a][0] is not None and sets[a][0] == sets[b][0]:
            top[find(b)] = find(a)
    low = {}
    for n, (i, s) in enumerate(sets):
        if i is not None:
            low[find(n)] = min(low.get(find(n), i), i)
    return sorted(((i, len(s), low.get(find(n)) if s else i) for n, (i, s) in enumerate(sets)), key=str)


def test_against_brute_force(docs, texts):
    assert sorted((tuple(r) for r in ngram_join.jaccard_join(docs).collect()), key=str) == brute(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_families_around_the_threshold(spark, seed):
    """Copies with more and more edits, chains of them, and a passage that most texts share."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 20, 60, 150]))] + (passage if rng.random() < 0.6 else [])
        for edits in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                base = copy
    rng.shuffle(rows)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def family(rng, n, places=40, edits=5, words=200, fresh=True):
    """Near copies of one text; each has other words at some of a few places, new ones or one of three."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    spots = rng.sample(range(words), places)
    out = []
    for k in range(n):
        copy = list(base)
        for at in rng.sample(spots, edits):
            copy[at] = f"x{rng.randrange(10**9)}" if fresh else f"y{at}v{rng.randrange(3)}"
        out.append(" ".join(copy))
    return out


def test_rows_are_linear_in_an_unlinked_family(spark, monkeypatch):
    """Four and sixteen times the family: as many tables, and no more rows for each document."""
    told = []
    plain = ngram_join.common.stored
    monkeypatch.setattr(ngram_join.common, "stored", lambda df: tables.append(plain(df)) or tables[-1])
    for n in (60, 240, 960):
        tables = []
        rows = list(enumerate(family(random.Random(n), n)))
        got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert len({r["component_id"] for r in got}) == n  # none is linked
        told.append((len(tables), sum(t.count() for t in tables) / n))
    assert len({t for t, _ in told}) == 1 and told[2][1] <= 1.2 * told[0][1]


@pytest.mark.parametrize(("edits", "fresh"), [(1, True), (2, True), (3, False), (4, False), (2, False)])
def test_families_with_links_besides_their_hub(spark, edits, fresh):
    """Members that aren't linked with the centre but with each other, by differences that few share or many."""
    rng = random.Random(10 * edits + fresh)
    texts = family(rng, 120, 30, edits, 90, fresh) + family(rng, 40, 12, edits + 2, 60, False) + family(rng, 5, 10, 1, 30)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_prefix_lemma():
    """Linked sets share as many shingles of their l-prefixes as the level says, and more than both can do without."""
    rng = np.random.default_rng(3)
    linked = 0
    for _ in range(6000):
        n = int(rng.integers(1, 160))
        x = set(rng.choice(700, n, replace=False).tolist())
        y = set(x)
        for _ in range(int(rng.integers(0, max(1, n // 9) + 1))):
            y.discard(next(iter(y), None))
            y.add(int(rng.integers(700)))
        if not y or 100 * len(x & y) < 85 * len(x | y):
            continue
        linked += 1
        a, b = sorted(x), sorted(y)
        levels = [ngram_join.level(np.sort(rng.integers(1, 90, len(s)))) for s in (a, b)]
        assert all(ngram_join.least_level(len(s)) <= k for s, k in zip((a, b), levels))
        shared = set(a[: ngram_join.slack(len(a)) + levels[0]]) & set(b[: ngram_join.slack(len(b)) + levels[1]])
        assert len(shared) >= min(levels) >= ngram_join.least_level(-(-85 * len(a) // 100))
    assert linked > 1000


def test_levels_follow_the_cost():
    """A prefix grows while shingles are about as rare, and stops before those of which each brings many candidates."""
    levels = [ngram_join.level(np.r_[np.ones(k, np.int64), np.full(400 - k, 5000)]) for k in (78, 80, 400)]
    assert ngram_join.least_level(400) < levels[0] < levels[1] < levels[2] == ngram_join.level(np.full(400, 5000))


def test_empty(empty):
    assert ngram_join.jaccard_join(empty).count() == 0


def test_an_id_with_several_texts(spark):
    """Each of its texts is compared; spellings of the same set are one text."""
    base = [f"w{k}" for k in range(120)]
    near = " ".join([*base[:60], "changed", *base[61:]])
    rows = [(1, " ".join(base)), (1, " ".join(base).upper()), (2, near), (3, near.upper()), (4, "one two three four five"), (4, "six seven eight nine ten")]
    found = {tuple(r) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {(1, 117, 1), (2, 117, 1), (3, 117, 1), (4, 2, 4)}


def test_rows_without_and_with_repeated_ids(spark):
    """Every text is compared, whatever its id: rows without one are linked, and all texts of an id lead on."""
    rng = random.Random(9)
    texts = [[f"t{t}w{rng.randrange(900)}" for _ in range(110)] for t in range(6)]
    near = lambda t: " ".join([*texts[t][:50], "changed", *texts[t][51:]])
    whole = lambda t: " ".join(texts[t])
    rows = [(9, whole(0)), (9, whole(1)), (9, whole(2)), (5, near(0)), (4, near(1)), (30, near(2)), (None, whole(3)), (None, near(3)), (None, whole(4)), (20, near(4)), (7, whole(5)), (7, None), (None, "")]
    for n in (1, 4):
        got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)
