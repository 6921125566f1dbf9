"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and the first four letters of longer ones, hashed to `dimensions` places. All of them enter
the machine, which learns a weight for each place and a vector for each place whose products weigh pairs: an insult next to
the mention of a group can count although neither says anything alone. Long texts hold many terms, so what single terms
tell is not to drown: terms whose share of toxic documents differs from the average beyond chance (a likelihood-ratio
test, Bonferroni-corrected) are scaled to a length of their own, and all others together to another. That only sets
the scale of a term; none is left out. A third of the sample is kept from the machine: its margins on those rows are
turned into probabilities by an isotonic fit. The model has a fixed size. Small steps over batches of rows, one after the
other, find pairs that single terms don't hint at; steps over all rows at once don't. They run in one task, over places
of a sample of bounded size.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labels and labelled rows that the model is fitted on at most, and places of their terms in the one task of the machine.
SAMPLE, PLACES = 20_000, 1 << 24
#: Hashed places of terms, dimensions of their vectors.
DIMENSIONS, FACTORS = 1 << 14, 8
#: Rows of a batch, size of a step, passes over the sample at most, loss from which it is learnt.
BATCH, STEP_SIZE, PASSES, LEARNT = 256, 0.05, 40, 0.015
#: Lengths of the part of a text's vector that single terms speak in, and of the rest.
LOUD, QUIET = 3.0, 0.3
#: Margin of a model that has learnt nothing.
NEVER = -1e9
#: Significance of a term, score from which a text is toxic.
ALPHA, TOXIC_FROM = 0.01, 0.7
_WORDS = re.compile(r"\w+")


def terms(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Places of the distinct words and of the stems of longer ones, in order."""
    words = set(_WORDS.findall(text.lower()))
    found = {zlib.crc32(w.encode()) % dimensions for w in words}
    found.update(zlib.crc32(s.encode(), 1) % dimensions for s in {w[:4] for w in words if len(w) > 4})
    return np.array(sorted(found), np.int64)


def scaled(places: np.ndarray, loud: np.ndarray) -> np.ndarray:
    """The value of each of the places of a text."""
    own = loud[places]
    k = int(own.sum())
    return np.where(own, LOUD / math.sqrt(max(k, 1)), QUIET / math.sqrt(max(len(places) - k, 1)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the doc_id as text has the remainder 1 by 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(rows: list[np.ndarray], labels: np.ndarray, loud: np.ndarray, factors: int) -> tuple[float, np.ndarray]:
    """Bias, and weights (first column) and vectors of all places, by adaptive steps on the logistic loss (Kingma and Ba 2015)."""
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (len(loud), factors + 1)).astype(np.float32)
    table[:, 0] = 0
    first, second = np.zeros_like(table), np.zeros_like(table)
    bias = np.zeros(3)  # itself, and its moments
    order = np.arange(len(rows))
    values = [scaled(x, loud).astype(np.float32) for x in rows]
    for _ in range(PASSES):
        rng.shuffle(order)
        loss = 0.0
        for start in range(0, len(order), BATCH):
            batch = [i for i in order[start : start + BATCH] if len(rows[i])]
            if not batch:
                continue
            lengths = np.array([len(rows[i]) for i in batch])
            at, value = np.concatenate([rows[i] for i in batch]), np.concatenate([values[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), lengths)
            parts = table[at] * value[:, None]
            sums = np.add.reduceat(parts, np.r_[0, np.cumsum(lengths)[:-1]], axis=0)
            margin = bias[0] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - np.bincount(row, (parts[:, 1:] ** 2).sum(1)))
            truth = labels[batch]
            share = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            loss -= np.log(np.where(truth > 0, share, 1 - share) + 1e-12).sum()
            off = (share - truth) / len(batch)
            each = (off[row] * value).astype(np.float32)
            slope = np.concatenate([each[:, None], each[:, None] * (sums[row, 1:] - parts[:, 1:])], axis=1)
            rank = np.argsort(at, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(at[rank]) != 0])
            used = at[rank][edge]
            slope = np.add.reduceat(slope[rank], edge, axis=0) + 1e-5 * table[used]
            first[used] = 0.9 * first[used] + 0.1 * slope
            second[used] = 0.99 * second[used] + 0.01 * slope * slope
            table[used] -= STEP_SIZE * first[used] / (np.sqrt(second[used]) + 1e-8)
            bias[1:] = 0.9 * bias[1] + 0.1 * off.sum(), 0.99 * bias[2] + 0.01 * off.sum() ** 2
            bias[0] -= STEP_SIZE * bias[1] / (math.sqrt(bias[2]) + 1e-8)
        if loss < LEARNT * len(order):
            break
    return float(bias[0]), table


class Model:
    """Weights and vectors of all places, those that are loud; margins map to probabilities along the points (at, share)."""

    def __init__(self, loud: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.loud, self.bias, self.weights, self.vectors = loud, bias, weights, vectors
        self.at, self.share = np.zeros(1), np.zeros(1)

    def margin(self, text: str) -> float:
        return self.of_places(terms(text, len(self.loud)))

    def of_places(self, places: np.ndarray) -> float:
        values = scaled(places, self.loud)
        v = self.vectors[places] * values[:, None]
        return float(self.bias + self.weights[places] @ values + 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum())

    def score(self, text: str) -> float:
        margin = self.margin(text)  # the margin itself orders texts of one plateau
        return float(0.99 * np.interp(margin, self.at, self.share) + 0.01 * (0.5 + margin / (2 + 2 * abs(margin))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, factors: int = FACTORS) -> Model:
    """The model learnt from the labelled rows that are not held out. Without both classes it scores 0 everywhere.

    At most `sample` labels are taken, and of the rows that have them at most `sample`, both by hash: an id that many
    rows share brings no more, and rows that share id and text are one. The machine is fitted in one task, on the first
    rows that have PLACES places of terms together (12 bytes each in that task).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("label")).filter("doc_id is not null and label is not null")
    chosen = known.filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([terms(x.as_py(), dimensions) for x in batch.column("text")], pa.list_(pa.int64()))], ["doc_id", "label", "terms"])

    labelled = common.id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # at most `sample` labels
    texts = common.picked(labelled, sample).select("doc_id", "label", "text")
    rows = common.stored(texts.mapInArrow(hashed, "doc_id long, label double, terms array<long>"))
    nothing = Model(np.zeros(dimensions, bool), NEVER, np.zeros(dimensions), np.zeros((dimensions, factors)))
    inside = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) < 2
    fitted = rows.filter(inside)
    counted = {r["label"] > 0: r["n"] for r in fitted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counted) < 2:
        return nothing
    n = sum(counted.values())
    rate = counted[True] / n
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = 2 * (part(F.col("a"), F.col("n") * rate) + part(F.col("n") - F.col("a"), F.col("n") * (1 - rate)))
    counts = fitted.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("a"))  # dimensions rows at most
    loud = np.zeros(dimensions, bool)
    loud[[r["term"] for r in counts.filter(ratio > 2 * math.log(dimensions / ALPHA)).select("term").collect()]] = True

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if table.num_rows:
            found = [x.values.to_numpy().astype(np.int32) for x in table.column("terms")]
            bias, weights = train(found, table.column("label").to_numpy(), loud, factors)
            yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([weights.tobytes()])], ["bias", "weights"])

    at = F.xxhash64("doc_id", "terms")
    sizes = sorted((r["at"], r["n"]) for r in fitted.select(at.alias("at"), F.size("terms").alias("n")).collect())  # at most `sample` rows
    upto = np.searchsorted(np.cumsum([n for _, n in sizes]), PLACES, side="right")
    fitted = fitted if upto >= len(sizes) else fitted.filter(at < F.lit(sizes[upto][0]))
    learnt = fitted.repartition(1).sortWithinPartitions("doc_id").select("label", "terms").mapInArrow(learn, "bias double, weights binary").first()
    weights = np.frombuffer(learnt["weights"], np.float32).reshape(dimensions, factors + 1).astype(float)
    model = Model(loud, learnt["bias"], weights[:, 0], weights[:, 1:])
    unseen = rows.filter(~inside)

    @F.pandas_udf("double")
    def margin(places: pd.Series) -> pd.Series:
        return pd.Series([model.of_places(np.array(x, np.int64)) for x in places], dtype=float)

    margins = (rows if unseen.isEmpty() else unseen).select("label", array_to_vector(F.array(margin("terms"))).alias("features"))
    steps = IsotonicRegression().fit(margins)
    model.at, model.share = steps.boundaries.toArray(), steps.predictions.toArray()
    return model


def scores(text: str, model: Model) -> Column:
    """The score of a text column, for use beside other columns of a row."""

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series([model.score(x or "") for x in values], dtype=float)

    return score(text)


def score_toxicity(docs: DataFrame, model: Model, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    Only the text enters the score. Null and empty texts have no terms and get the score of the bias, repeated rows
    repeated scores, a null doc_id stays null and is not held out, an empty table gives an empty result, other columns
    are not read. Long texts are read whole; rows are independent and nothing is shuffled.
    """

    scored = common.id_and_text(docs).select("doc_id", held_out().alias("held_out"), scores("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxic_from).cast("int"))
