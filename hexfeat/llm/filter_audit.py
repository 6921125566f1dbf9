"""Filter interaction audit by min-plus removal ranks.

What a filter removes depends on the filters before it. Which filters a document fails doesn't: that is one bit mask for
each document, and documents with the same mask share their fate in every order. So the documents are counted by part
and mask once, and the orders are played through on matrices only:

1. the position matrix holds the inverse permutation of each order: at which step a filter has its turn;
2. the mask matrix holds 0 where a mask fails a filter and a barrier beyond the last step where it doesn't;
3. their min-plus product, the minimum over filters of position plus mask, is the step at which an order removes a mask;
4. the counts of the masks are scattered to these steps: removed and kept, lost labels, and what was redundant.

The pass over the texts is map only. Copies are found on slim rows: those of one text and part are summed before they
travel, so a text with any number of copies is one row from each task. What comes out for a part is at most one row for
each mask, whatever the size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A: few words, B: few different words, C: many capitals, D: symbols, E: the text of a smaller doc_id.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SYMBOLS, CAPITALS = b"#$%&*|", bytes(range(ord("A"), ord("Z") + 1))
_COPY = 1 << FILTERS.index("E")
#: Orders a null doc_id behind all others, and the tasks that rows without one are dealt to.
_LAST, _SALTS = (1 << 63) - 1, 4096


def text_failures(rows: DataFrame) -> DataFrame:
    """doc_id, part, mask of the filters A to D, and digest of the text of every row (doc_id, part, text; a null text is empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("")
            masks, digests = [], []
            for raw, length in zip(texts.cast(pa.binary()), pc.utf8_length(texts).to_pylist(), strict=True):
                raw = raw.as_py()
                words = raw.split()  # at the six ASCII blanks
                n, size = len(words), len(raw)
                fails = (
                    n < LEAST_WORDS,
                    100 * len(set(words)) < DISTINCT_PERCENT * n,
                    100 * (size - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * length,
                    len(raw.translate(None, SYMBOLS)) < size,
                )
                masks.append(sum(fail << i for i, fail in enumerate(fails)))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], schema=schema)

    return rows.select("doc_id", "part", "text").mapInArrow(judge, "doc_id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: the documents of each part that fail just these filters, and those among them that have a label of 1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    judged = text_failures(rows).withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(_SALTS))).otherwise(F.lit(0).cast("long")))
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = told.withColumn("salt", F.lit(0).cast("long"))
    labelled = judged.join(told, ["doc_id", "salt"], "left").fillna(0, ["good", "toxic"])
    key = ["digest", "part", "mask", "good", "toxic"]
    by_id = labelled.groupBy(F.coalesce("doc_id", F.lit(_LAST)).alias("at"), *key).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct("at", "n")).alias("least"))
    first = F.min("least.at").over(Window.partitionBy("digest"))
    leading = F.when(F.col("least.at") == first, F.col("least.n")).otherwise(F.lit(0))
    split = by_text.withColumn("leading", leading).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("leading").alias("n")), F.struct((F.col("mask") + _COPY).alias("mask"), (F.col("n") - F.col("leading")).alias("n")))).alias("x"))
    weighted = split.select("part", "x.mask", "x.n", (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic")).filter("n > 0")
    return weighted.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def removal_ranks(filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All orders (filter at each step), and for each order and mask the step (from 0) that removes it, `filters` if none does; masks as a matrix."""
    orders = np.array(list(permutations(range(filters))))
    positions = np.argsort(orders, axis=1)  # inverse permutations
    masks = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1
    barrier = np.where(masks == 1, 0, filters)
    ranks = np.minimum((positions[:, None, :] + barrier[None, :, :]).min(axis=2), filters)
    return orders, ranks, masks


def play(weights: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Counts by order and step of masks with weights (n, good and toxic of each mask)."""
    orders, ranks, masks = removal_ranks(filters)
    scattered = np.zeros((len(orders), filters + 1, 3), np.int64)
    np.add.at(scattered, (np.arange(len(orders))[:, None], ranks), weights.T[None, :, :])
    removed = scattered[:, :filters, 0]
    failing = masks.T[orders]  # order, step, mask
    earlier = ranks[:, None, :] < np.arange(filters)[None, :, None]
    by_filter = np.zeros(filters, np.int64)
    np.add.at(by_filter, orders, removed)
    return {
        "kept": weights[0].sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": (failing * earlier) @ weights[0], "unique_fails": weights[0][1 << orders],
        "good_lost": scattered[:, :filters, 1], "toxic_lost": scattered[:, :filters, 2], "shapley": by_filter[orders],
    }


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def played(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of counts by part and mask (part, mask, n, good, toxic; bit i is the i-th of filters)."""
    orders = ["".join(x) for x in permutations(filters)]
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in _COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [o for o in orders for _ in filters]
        steps = list(range(1, len(filters) + 1)) * len(orders)
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                weights = np.zeros((3, 1 << len(filters)), np.int64)
                for x in masks:
                    weights[:, x["mask"]] = x["n"], x["good"], x["toxic"]
                found = play(weights, len(filters))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names)), pa.array(names), pa.array(steps, pa.int32()), *(pa.array(found[c].ravel(), pa.int64()) for c in _COUNTS)], schema=schema)

    gathered = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most one of each mask
    return gathered.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and seven counts, for each part, order of the five filters, and step.

    part is a value of source, null being the empty string. A null text is empty: it has few words and fails A alone,
    and E unless its doc_id is the smallest of the empty texts. doc_ids that are equal don't fail E by each other; rows
    without one come last, fail E if any row with an id has their text, and have no labels. A label counts if any of its
    rows says 1, null says nothing. Rows that repeat are counted one by one. An empty table has no parts and gives an
    empty result. Other columns are not read; texts of any length are read whole, in one task each.
    """
    return played(mask_counts(docs, labels))


ORACLE_SQL = r"""
with told as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1
), texts as (
  select coalesce(d.source, '') as part, coalesce(d.text, '') as text, coalesce(t.good, false) as good, coalesce(t.toxic, false) as toxic,
         coalesce(d.doc_id, 9223372036854775807) as id from documents d left join told t on d.doc_id = t.doc_id
), judged as (
  select part, good, toxic,
         case when len(w) < 50 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end
         || case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) then 'C' else '' end
         || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when id > min(id) over (partition by text) then 'E' else '' end as fails
  from (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from texts)
), counted as (
  select part, fails, count(*) as n, count_if(good) as good, count_if(toxic) as toxic from judged group by 1, 2
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as f
), orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
  where b.f <> a.f and c.f not in (a.f, b.f) and d.f not in (a.f, b.f, c.f) and e.f not in (a.f, b.f, c.f, d.f)
), turns as (
  select filter_order, step::int as step, substr(filter_order, step::int, 1) as f from orders, range(1, 6) s(step)
), fates as (
  select o.filter_order, m.fails, coalesce(min(t.step), 6) as gone
  from orders o cross join (select distinct fails from counted) m left join turns t on t.filter_order = o.filter_order and contains(m.fails, t.f) group by 1, 2
), steps as (
  select c.part, t.filter_order, t.step, t.f, sum(case when g.gone > t.step then n else 0 end)::bigint as kept, sum(case when g.gone = t.step then n else 0 end)::bigint as removed,
         sum(case when g.gone < t.step and contains(c.fails, t.f) then n else 0 end)::bigint as redundant, sum(case when c.fails = t.f then n else 0 end)::bigint as unique_fails,
         sum(case when g.gone = t.step then good else 0 end)::bigint as good_lost, sum(case when g.gone = t.step then toxic else 0 end)::bigint as toxic_lost
  from counted c join fates g on g.fails = c.fails join turns t on t.filter_order = g.filter_order group by 1, 2, 3, 4
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, f)::bigint as shapley from steps
"""
