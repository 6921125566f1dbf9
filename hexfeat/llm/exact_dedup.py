"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after all ASCII blanks are deleted. Copies are combined in three steps, and
the whole normalised text is part of the grouping key in each of them, so that a digest alone never decides:

1. every map task combines the copies it has read (partial aggregation, one row for each text and salt);
2. salted digest groups are merged: a text with billions of copies meets in `salts` reducers instead of one;
3. the winners of the salts, at most `salts` rows for each text, are combined globally.

Counts and the best row are kept in fixed-width buffers (a long and a decimal), so the aggregation stays in the hash
map of Tungsten and no member list is ever built. Documents then find their group by digest in a slim join; only the
digests that hold several texts (a hash collision) are joined by the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SALTS = 16
#: Largest doc_id, which stands for a null one, and the number of different ids.
_LAST, _IDS = "9223372036854775807", "18446744073709551616"


def _number(digits: str) -> Column:
    return F.lit(digits).cast("decimal(20,0)")


def _best(n: Column, doc_id: Column) -> Column:
    """One number that is larger for more code points, then for the smaller doc_id (null as the largest id)."""
    rest = _number(_LAST) - F.coalesce(doc_id.cast("decimal(20,0)"), _number(_LAST))
    return (n.cast("decimal(11,0)") * _number(_IDS) + rest).cast("decimal(38,0)")


def _best_id(best: Column) -> Column:
    found = (_number(_LAST) - best % _number(_IDS)).cast("long")
    return F.nullif(found, F.lit(_LAST).cast("long"))


def _best_length(best: Column) -> Column:
    return F.floor(best / _number(_IDS)).cast("int")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (columns doc_id and text).

    Of equal texts the row with the most code points in the original text stays, then the one with the smallest
    doc_id. A null text counts as empty; all empty texts form one group. A null doc_id loses every tie and is only
    kept (keep_id null) in a group that has no other longest row. Rows that repeat a doc_id get a row each; of those with
    equal texts only the ones of the greatest length are kept, all of them if several have it. An empty table gives an empty result. `digest` is replaceable for tests.
    """
    rows = common.id_and_text(docs).select("doc_id", F.char_length("text").alias("n"), F.regexp_replace("text", common.BLANKS, "").alias("norm")).withColumn("digest", digest(F.col("norm")))
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "norm").agg(F.count("*").alias("size"), F.max(_best(F.col("n"), F.col("doc_id"))).alias("best"))
    groups = salted.repartition("digest").groupBy("digest", "norm").agg(F.sum("size").alias("size"), F.max("best").alias("best"))
    by_digest = common.stored(groups.groupBy("digest").agg(F.count("*").alias("texts"), F.max("size").alias("size"), F.max("best").alias("best")))
    sha = F.col("digest") if digest is sha256 else sha256(F.col("norm"))
    out = rows.select("doc_id", "n", "digest", sha.alias("sha")).join(by_digest.filter("texts = 1"), "digest").select("doc_id", "n", "sha", "size", "best")
    several = by_digest.filter("texts > 1").select("digest")
    if not several.isEmpty():  # a digest that several texts share: the whole text decides
        whole = rows.join(several, "digest", "left_semi").join(groups, ["digest", "norm"])
        out = out.unionByName(whole.select("doc_id", "n", sha256(F.col("norm")).alias("sha"), "size", "best"))
    keep = _best_id(F.col("best"))
    return out.select("doc_id", keep.alias("keep_id"), F.col("size").alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & (F.col("n") == _best_length(F.col("best")))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE_SQL = r"""
with r as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
), g as (
  select *, count(*) over (partition by norm) as group_size,
         first_value(doc_id) over (partition by norm order by n desc, doc_id rows between unbounded preceding and unbounded following) as keep_id
  from r
)
select doc_id, keep_id, group_size, doc_id = keep_id and n = max(n) over (partition by norm) as kept, sha256(norm) as text_sha256 from g
"""
