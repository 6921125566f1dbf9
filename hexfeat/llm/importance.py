"""Importance resampling towards a target distribution.

An untrained pre-tokeniser of the tokenizers library (a Split by a pattern, nothing learnt) cuts the lower-cased text
into words with their offsets. Windows over these pairs of offsets are the features: every run of up to `most` words.
A feature falls into a bucket by the CRC of its bytes; the histograms of the corpus and of the target give each bucket a
gain, a document the mean gain of its features, and Gumbel noise by doc_id turns the highest scores into a sample
without replacement in proportion to the weights.

Texts are cut once: the pass over them writes each document's buckets and their counts (in the shared folder), from which
the histogram, at most one row for each bucket and task, and then the weights are taken. A ranking needs only the drawn
rows: a coarse histogram of the scores finds a bound above which the drawn ones lie, and only rows above it are sorted,
by range, with the sizes of the sorted partitions added up.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from . import common

MOST, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters after which a text is cut at the next gap between words, so that a task holds few offsets at a time; words kept by hash.
STRETCH, REMEMBERED = 1 << 16, 1 << 19
#: Width of the steps of the coarse histogram of scores.
COARSE = 64


class _Buckets(dict):
    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        found = self[feature] = zlib.crc32(feature.encode()) % self.buckets
        return found


def _stretches(text: str) -> Iterator[str]:
    """The text in parts that end between words."""
    gap, start = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"), 0
    while len(text) - start > STRETCH and (found := gap.search(text, start + STRETCH)):
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def runs(text: str, split: Split, most: int) -> Iterator[tuple[int, list[str]]]:
    """Stretch by stretch: the number of new words, and the features that end in them."""
    carried: list[str] = []
    for part in _stretches(text.encode().lower().decode()):  # bytes only lower A to Z
        spans = [span for _, span in split.pre_tokenize_str(part)]
        words = carried + [part[a:b] for a, b in spans]
        found = words[len(carried) :]
        for n in range(2, most + 1):
            found += [" ".join(words[i : i + n]) for i in range(max(0, len(carried) - n + 1), len(words) - n + 1)]
        yield len(spans), found
        carried = words[len(words) - most + 1 :] if most > 1 else []


def bucketed(rows: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features, and the buckets of the features with their counts, of every row (id, text; a null text has none)."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = Split(Regex(_WORD), behavior="removed", invert=True), _Buckets(buckets)
        for batch in batches:
            out = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                n_words, n_features, held = 0, 0, []
                for n, found in runs(text.as_py() or "", split, most):
                    n_words, n_features = n_words + n, n_features + len(found)
                    if len(at) > REMEMBERED:
                        at.clear()
                    held.append(np.unique(np.fromiter(map(at.__getitem__, found), np.int32, len(found)), return_counts=True))
                if len(held) > 1:
                    ids, where = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
                    counts = np.zeros(len(ids), np.int64)
                    np.add.at(counts, where, np.concatenate([c for _, c in held]))
                else:
                    ids, counts = held[0]
                out.append((key, n_words, n_features, ids, counts))
            columns = zip(*out, strict=True) if out else ((),) * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return rows.select("id", "text").mapInArrow(cut, "id long, n_words long, n_features long, buckets array<int>, counts array<long>")


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows of `bucketed`. Each task sends one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counted = found.select("buckets", "counts").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most one row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths of a nat, from its smoothed shares of the target and of the corpus."""
    size = float(len(corpus))
    all_corpus, all_target = float(corpus.sum()) + size, float(target.sum()) + size
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the hash of seed and doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(found: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of `bucketed`."""
    shared = found.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            lists = batch.column("buckets")
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()] * batch.column("counts").flatten().to_numpy())])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            n = batch.column("n_features").to_numpy()
            weight = np.where(n > 0, (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1), 0).astype(np.int64)
            score = weight + np.array([noise(i, seed) for i in batch.column("id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight), pa.array(score)], names)

    return found.mapInArrow(weigh, ", ".join(f"{c} long" for c in names))


def ranked(scored: DataFrame, drawn: int, eligible: str) -> DataFrame:
    """scored with rank: 1, 2, 3 ... of the `drawn` eligible rows with the highest scores (ties to the smaller doc_id), null of the others."""
    step = F.floor(F.col("score") / COARSE)
    steps = scored.filter(eligible).groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # bounded by the range of scores
    least, above = None, 0
    for r in steps:
        if above >= drawn:
            break
        least, above = r["step"], above + r["n"]
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select("*", none)
    near = F.expr(eligible) & (step >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    run = common.stored(scored.filter(near).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in run.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    bases, before = [], 0
    for p in sorted(sizes):
        bases.append((p, before))
        before += sizes[p]
    starts = run.sparkSession.createDataFrame(bases, "part long, before long")
    rank = F.col("before") + within + 1
    placed = run.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= drawn, rank))
    return placed.select(*scored.columns, "rank").unionByName(scored.filter(~near).select("*", none))


def importance_sample(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text); target has text.

    rank is null where a row isn't drawn. A null or empty text has no features and weight 0, and is not eligible, as are
    all texts of fewer words than least_words. Rows that repeat a doc_id have the same noise and are ranked one by one,
    by weight and then features where scores tie; a null doc_id has noise of its own (that of an empty string) and loses
    ties. Without eligible rows nothing is drawn; an empty target or table gives flat shares and is no error. Other columns
    are not read. Long texts are cut in stretches between words, so only a word without an end is held whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    found = common.stored(bucketed(rows, most, buckets))
    aims = bucketed(target.select(F.lit(0).cast("long").alias("id"), "text"), most, buckets)
    scored = common.stored(weighed(found, gains(histogram(found, buckets), histogram(aims, buckets)), seed))
    eligible = f"n_words >= {least_words}"
    drawn = percent * scored.filter(eligible).count() // 100
    return ranked(scored, drawn, eligible).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
with poly as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), aims as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark
), words as (
  select r, unnest(w) as word from docs
), hashed as (
  select word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(word), 2 * i - 1, 2))::bigint)),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select word from words union select word from aims), poly
), corpus as (
  select bucket, count(*) as n from words join hashed using (word) group by 1
), target as (
  select bucket, count(*) as n from aims join hashed using (word) group by 1
), totals as (
  select coalesce((select sum(n) from corpus), 0)::double + 10000 as s, coalesce((select sum(n) from target), 0)::double + 10000 as t
), gain as (
  select bucket, floor(1000 * ln(((coalesce(target.n, 0) + 1)::double * s) / ((corpus.n + 1)::double * t)))::bigint as gain from corpus left join target using (bucket), totals
), weights as (
  select r, floor(sum(gain) / count(*))::bigint as weight from words join hashed using (word) join gain using (bucket) group by 1
), scored as (
  select doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from docs left join weights using (r)
), placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n from scored
)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from placed
"""
