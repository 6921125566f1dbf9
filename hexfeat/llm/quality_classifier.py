"""Quality classifier from weak labels.

Nine heuristics look at a text and vote good, bad or nothing. How often each is right is not known: expectation
maximisation estimates it from how the votes agree over the whole corpus. Votes only matter by their pattern, so Spark
counts patterns (3**9 at most, whatever the corpus) and the iterations run on that small table. The posterior of a
pattern is a soft label; on a bounded sample, chosen by hash, the soft labels train a logistic scorer over hashed word
shapes, which also generalises to texts on which all heuristics abstain.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows with the smallest hashes train the scorer; hashed dimensions; rounds of the estimation; least score to be kept.
SAMPLE, DIMENSIONS, ROUNDS, KEPT_FROM = 20_000, 512, 50, 0.2
LABELLERS = ("marks", "letters", "words", "repeats", "separators", "capitals", "lines", "sentences", "compression")
_HEAP = re.compile(r"[^\w\s]{2,}$")
_PLAIN = re.compile(r"[\"'(«„“]*[^\W_]+(?:[-'’][^\W_]+)*[.,;:!?\"')»”…]?$")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _vote(value: float, good: float, bad: float) -> int:
    """1 up to good, 0 from bad on, else -1 (nothing). For values where less is better."""
    return 1 if value <= good else 0 if value >= bad else -1


def votes(text: str) -> list[int]:
    """One vote for each of LABELLERS: 1 good, 0 bad, -1 none."""
    words = text.split()
    n = len(words)
    if not n:
        return [-1, -1, 0, -1, -1, -1, -1, 0, -1]
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text)) or 1
    raw = text.encode()
    ends = sum(1 for w in words if w[-1] in ".!?…")
    sentence = n / ends if ends else math.inf
    return [
        _vote(sum(1 for w in words if _HEAP.search(w)) / n, 0.05, 0.2),
        _vote(1 - letters / sum(map(len, words)), 0.08, 0.14),
        _vote(1 - sum(1 for w in words if _PLAIN.match(w)) / n, 0.1, 0.25),
        _vote(sum(map(operator.eq, words, words[1:])) / n, 0.03, 0.2),
        _vote(sum(w in "|»·•" for w in words) / n, 0.02, 0.1),
        _vote(sum(map(str.isupper, text)) / letters, 0.2, 0.6),
        -1 if len(lines) < 2 else _vote(1 - len(set(lines)) / len(lines), 0.1, 0.4),
        -1 if n < 15 else _vote(abs(math.log(sentence / 12)) if ends else 9.0, 1.6, 2.2),
        -1 if len(raw) < 300 else _vote(len(raw) / len(zlib.compress(raw, 1)), 4.0, 6.0),
    ]


def estimate(patterns: list[tuple[list[int], int]], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """(share of good texts, accuracy[labeller, class, vote + 1]) by expectation maximisation on (votes, count) rows."""
    votes_, counts = np.array([p for p, _ in patterns], int).reshape(len(patterns), -1), np.array([c for _, c in patterns], float)
    good = (votes_ == 1).sum(1)
    bad = (votes_ == 0).sum(1)
    posterior = (good + 1) / (good + 5 * bad + 2)  # a bad vote is rarer and says more
    share, table = 0.5, np.zeros((votes_.shape[1], 2, 3))
    for _ in range(rounds):
        for y, weight in ((0, counts * (1 - posterior)), (1, counts * posterior)):
            for j in range(votes_.shape[1]):
                table[j, y] = [weight[votes_[:, j] == v].sum() + 1 for v in (-1, 0, 1)]
        table /= table.sum(2, keepdims=True)
        share = float((counts * posterior).sum() / counts.sum())
        posterior = posteriors(votes_, share, table)
    return share, table


def posteriors(votes_: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    logs = np.log([1 - share + 1e-9, share + 1e-9])[:, None] + np.array([sum(np.log(table[j, y, votes_[:, j] + 1]) for j in range(votes_.shape[1])) for y in (0, 1)])
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


#: Longest word whose place is remembered; the shapes of longer ones are made anew each time.
_REMEMBERED = 64


class Shapes:
    """Hashed word shapes of a text as a vector of length one; shapes of words are remembered up to a bound."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.known: dict[str, int] = {}

    def _place(self, word: str) -> int:
        shape = _DIGITS.sub("0", _LETTERS.sub(lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a", word))
        return zlib.crc32(shape.encode()) % self.dimensions

    def vector(self, text: str) -> np.ndarray:
        if len(self.known) > 200_000:
            self.known.clear()
        words = text.split()
        known, places = self.known, []
        for w in words:
            if (at := known.get(w)) is None:
                at = self._place(w)
                if len(w) <= _REMEMBERED:
                    known[w] = at
            places.append(at)
        again = sum(map(operator.eq, words, words[1:]))
        counts = np.bincount(np.array([*places, *[zlib.crc32(b"\0again") % self.dimensions] * again, *[zlib.crc32(b"\0line") % self.dimensions] * text.count("\n")], int), minlength=self.dimensions)
        out = np.log1p(counts)
        size = np.linalg.norm(out)
        return out / size if size else out


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def fit(docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Scorer:
    """The scorer learnt from docs (doc_id, text) without any label. An empty table gives a scorer that says 0.5.

    Accuracies are estimated over all rows; the scorer is fitted on at most `sample` rows, chosen by the hash of id and
    text, so rows without an id or with a repeated one take part like others, and copies of one id and text once.
    """
    rows = common.id_and_text(docs)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(x.as_py()) for x in batch.column("text")], pa.list_(pa.int32()))], ["votes"])

    patterns = [(list(r["votes"]), r["count"]) for r in rows.select("text").mapInArrow(voted, "votes array<int>").groupBy("votes").count().collect()]
    if not patterns:
        return Scorer(np.zeros(dimensions), 0.0)
    share, table = estimate(sorted(patterns))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes(dimensions)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            soft = posteriors(np.array([votes(t) for t in texts], int).reshape(len(texts), -1), share, table) if texts else []
            yield pa.RecordBatch.from_arrays([pa.array(soft, pa.float64()), pa.array([shapes.vector(t) for t in texts], pa.list_(pa.float64()))], ["soft", "shape"])

    learnt = common.stored(common.picked(rows, sample).select("text").mapInArrow(featured, "soft double, shape array<double>"))
    both = learnt.select(array_to_vector("shape").alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("soft").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("soft")).alias("weight")))).alias("x")).select("features", "x.label", "x.weight")
    if not learnt.agg(F.count("*")).first()[0]:
        return Scorer(np.zeros(dimensions), 0.0)
    line = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60, standardization=False).fit(both)
    return Scorer(line.coefficients.toArray(), line.intercept)


def score_quality(docs: DataFrame, scorer: Scorer, kept_from: float = KEPT_FROM) -> DataFrame:
    """doc_id, score (0 to 1, higher is better) and kept of every row of docs (doc_id, text).

    A null or empty text has no shapes and is never kept (score 0). A null doc_id stays null, repeated rows give
    repeated answers, an empty table gives an empty result, other columns are not read. Long texts are read whole;
    rows are independent and nothing is shuffled.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes(len(scorer.weights))
        for batch in batches:
            found = [1 / (1 + math.exp(-float(scorer.weights @ shapes.vector(t) + scorer.bias))) if t.strip() else 0.0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return common.id_and_text(docs).mapInArrow(score, "doc_id long, score double").withColumn("kept", F.col("score") >= kept_from)
