"""Exact top-k search by no-random-access aggregation.

A score is an inner product, the sum of one contribution from each dimension. Each dimension is a list of the vectors,
sorted by their component; a query reads it from the end where its contributions are largest (the low end where the
query's own component is negative). Lists are read in order only, a stretch of all of them at a time. After each stretch
a vector has two bounds: what has been seen of it, plus, for each list in which it hasn't turned up yet,
at most the contribution at which the reading stands and at least that of the list's far end. The k-th highest of the
lower bounds is the mark: whoever cannot reach it by the upper bound is out, those never seen in any list included. When
few are left, or the lists are at their end, the final scores of those that remain are resolved from their components.

Vectors are dealt to blocks of bounded size by the hash of a row's number, queries to groups; each block meets each group
in one task, which sorts the block's lists, reads them for the whole group, and sends k rows a query at most. The best k
of a query are then taken from those. No key of the data decides where a row goes, so neither common vectors nor labels
can fill a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, SCALE, EVERY = 10, 1024, 100
#: Vectors of a block, queries of a group, and queries that read the lists together.
BLOCK, GROUP, TOGETHER = 2048, 4096, 256
#: Parts of the lists after which bounds are drawn, and remaining vectors (times k) from which a query is resolved at once.
DEPTHS, FEW = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 1.0), 4
_LONG = (-(1 << 63), (1 << 63) - 1)


class Lists:
    """The sorted lists of a block: one for each dimension, by rising component."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, (self.n, self.dims) = vectors, vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty_like(order)  # where in its list a vector stands
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None], axis=0)


def remaining(lists: Lists, weights: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query (a row of weights), the vectors that can be among its k highest scores; own is its row in the block, or -1.

    Components and weights are whole numbers; where sums of their products can be inexact in a double, the bounds get a
    margin, and where they can overflow, all vectors remain.
    """
    largest = lambda x: float(np.abs(x).max(initial=0.0))
    with np.errstate(over="ignore"):
        bound = largest(lists.vectors) * largest(weights) * lists.dims
    everyone = np.arange(lists.n)
    if lists.n <= k or not lists.dims or bound > 1e300:
        return [everyone[everyone != o] for o in own]
    margin = 0.0 if bound < 2.0**53 else bound * 2.0**-40
    found: list[np.ndarray] = [everyone] * len(weights)
    open_ = np.arange(len(weights))
    high, low = np.maximum(weights, 0).T, np.minimum(weights, 0).T  # read from the upper and from the lower end
    seen = np.zeros((lists.n, len(weights)))
    depth = 0
    for share in DEPTHS:
        before, depth = depth, max(depth, min(lists.n, int(np.ceil(share * lists.n))))
        new_high = (lists.place >= lists.n - depth) & (lists.place < lists.n - before)
        new_low = (lists.place >= before) & (lists.place < depth)
        seen += np.where(new_high, lists.vectors, 0.0) @ high + np.where(new_low, lists.vectors, 0.0) @ low
        if depth < lists.n:
            # What is still unread of a list lies between the value at which the reading stands and that of its far end.
            unread = np.hstack([lists.place < lists.n - depth, lists.place >= depth]).astype(float)
            stands = np.vstack([high * lists.sorted[lists.n - depth - 1][:, None], low * lists.sorted[depth][:, None]])
            ends = np.vstack([high * lists.sorted[0][:, None], low * lists.sorted[-1][:, None]])
            upper, lower = seen + unread @ stands, seen + unread @ ends
        else:
            upper = lower = seen
        itself = np.flatnonzero(own[open_] >= 0)
        lower = lower.copy()
        lower[own[open_][itself], itself] = -np.inf
        mark = np.partition(lower, lists.n - k, axis=0)[lists.n - k]
        left = upper + margin >= mark - margin
        left[own[open_][itself], itself] = False
        done = (left.sum(axis=0) <= FEW * k) | (depth == lists.n)
        for q in np.flatnonzero(done):
            found[open_[q]] = np.flatnonzero(left[:, q])
        if done.all():
            break
        open_, high, low, seen = open_[~done], high[:, ~done], low[:, ~done], seen[:, ~done]
    return found


def resolve(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The whole scores of vectors for one query, held within a long."""
    bound = float(np.abs(vectors).max(initial=0.0)) * float(np.abs(weights).max(initial=0.0)) * len(weights)
    if bound < 2.0**53:
        return (vectors @ weights).astype(np.int64)
    whole = [int(w) for w in weights]
    exact = [sum(int(x) * w for x, w in zip(v, whole, strict=True)) for v in vectors]
    return np.array([min(max(x, _LONG[0]), _LONG[1]) for x in exact], np.int64)


def _whole(table: pa.Table, scale: int) -> np.ndarray:
    """The components of a block in whole numbers, as doubles (of one length in a block)."""
    flat = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64)
    return np.floor(scale * flat).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, at (a number of the row's own), v and dims of the rows (vec_id, embedding) that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.filter(F.col("embedding").isNotNull()).filter(finite)
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("at"), F.col("embedding").alias("v"), F.size("embedding").alias("dims"))


def top_k(vectors: DataFrame, is_query: str = f"id % {EVERY} = 0", k: int = K, scale: int = SCALE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query, rank, vec_id and score of the k highest scores of each query among all other rows (vec_id, embedding).

    Rows whose vector is null, or holds null or non-finite components (after scaling), take no part. Vectors only meet
    those of their own length; empty ones score 0 with each other. A row is never its own candidate, but rows that repeat
    its vec_id are; each of them that is a query is answered, under the same vec_id. A null vec_id is no query and loses
    ties. Scores beyond a long stay at its limits. An empty table, or one without queries, gives an empty result; other
    columns are not read.
    """
    rows = common.stored(usable(vectors, scale))  # the numbers of rows are fixed by this
    asked = rows.filter(is_query)
    n, n_asked = rows.count(), asked.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-n_asked // group))
    spread = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    met = rows.select("dims", "id", "at", "v", spread("block", blocks).alias("b"), every(groups).alias("g")).groupBy("dims", "b", "g")
    asks = asked.select("dims", "id", "at", "v", spread("group", groups).alias("g"), every(blocks).alias("b")).groupBy("dims", "b", "g")
    schema = pa.schema([("query_at", pa.int64()), ("query", pa.int64()), ("at", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            lists, all_weights = Lists(_whole(left, scale)), _whole(right, scale)
            ids, ats = left.column("id").to_pylist(), left.column("at").to_pylist()
            row_of, by_id = {a: i for i, a in enumerate(ats)}, np.array([i if i is not None else _LONG[1] for i in ids], np.int64)
            asks_at, asks_id = right.column("at").to_pylist(), right.column("id").to_pylist()
            own = np.array([row_of.get(a, -1) for a in asks_at])
            for start in range(0, len(own), TOGETHER):
                stop = start + TOGETHER
                for q, chosen in enumerate(remaining(lists, all_weights[start:stop], own[start:stop], k), start):
                    scores = resolve(lists.vectors[chosen], all_weights[q])
                    best = np.lexsort((by_id[chosen], -scores.astype(object) if scores.min(initial=0) == _LONG[0] else -scores))[:k]
                    out += [(asks_at[q], asks_id[q], ats[chosen[i]], ids[chosen[i]], int(scores[i])) for i in best]
        columns = zip(*out, strict=True) if out else ((),) * len(schema)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    found = met.cogroup(asks).applyInArrow(search, "query_at long, query long, at long, vec_id long, score long")
    order = Window.partitionBy("query_at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("at"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "vec_id", "score")


ORACLE_SQL = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query, v.vec_id, list_inner_product(q.e, v.e)::bigint as score from v q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0
)
select query, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query order by score desc, vec_id) as rank from scored) where rank <= 10
"""
