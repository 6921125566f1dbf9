"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct 4-word shingles; equal sets (copies) are one class, and only classes are compared.
All sets are sorted by one global order: shingles that are rare by estimate first, then by hash. If two sets are similar
enough to be linked, then for every level l their l-prefixes (the first |x| - ceil(t|x|) + l shingles) share at least l
shingles. Each class picks its own level: it lengthens its prefix as long as that lowers the estimated cost of its
candidates, and in return it has to share that many more shingles before anything is verified.

The prefixes produce all candidates; the work on them is laid out so that nothing grows with the square of a group:

1. A first pass takes digests and counts shingles that repeat. The heaviest, a bounded table, define the order (any table
   gives the same links). Heavy shingles are dealt by shingle and class, so that none meets in one task.
2. A second pass shows the prefixes. Shingles that one class alone shows go; a class that is left with fewer than its
   level or that of any possible partner goes as well. What a candidate costs is known then: classes without any are
   done, the others lengthen their prefixes and have to share a third of their shingles within them.
3. Of the classes that show a shingle, the most central is their hub. A class follows the hubs of its shingles, but for
   those that make up less than half of the matches it needs: two classes that share enough follow one hub together.
4. A class is compared with each of its hubs once, in whole numbers on the full sets: what it lacks of the hub and what it
   has besides. Every member is one row, however large the group.
5. Members that are linked with their hub are one component. The others are measured from the centre of their group, the
   set that holds what most members hold: two sets differ by the symmetric difference of their differences from it, so
   shingles of the family no longer count, and members have to show a rare difference both before they are compared, in
   cells of bounded size. That is done once, whatever the size of the family.

Shingles are 64-bit hashes of their words; the digest of a set has 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, PERCENT = 4, 85
#: Entries of the table of heavy shingles, and repeats among STRETCH shingles from which one is counted.
HEAVY, REPEATED, STRETCH = 1 << 16, 4, 1 << 21
#: Parts of a set that its level is at least at first, and when it has candidates.
LEAST_PART, LONGER_PART = 24, 3
#: Tasks that a heavy shingle is dealt to, members that meet one copy of their hub, copies of a hub at most.
SALTS, TOGETHER, COPIES = 64, 128, 4096
#: Buckets of the filter on candidate ids (bounds memory, not results).
BUCKETS = 1 << 18
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sorted hashes of the distinct shingles of a text."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.words = size, _Words()

    def __call__(self, text: str) -> np.ndarray:
        if len(self.words) > 400_000:
            self.words.clear()
        words = text.encode().lower().split()  # both only know ASCII
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        ids = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        if n < self.size:
            h = n
            for i in ids.tolist():
                h = (h * int(_P) + i) & _MASK
            hashes = np.array([h], np.uint64)
        else:
            hashes = ids[: n - self.size + 1]
            for k in range(1, self.size):
                hashes = hashes * _P + ids[k : n - self.size + 1 + k]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * _M
        return np.unique(hashes ^ (hashes >> np.uint64(29)))


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Both halves of the digest of a set, as longs."""
    found = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (found >> 64) - (1 << 63), (found & _MASK) - (1 << 63)


class Order:
    """The global order: shingles of the heavy table last, by their count; others by hash."""

    def __init__(self, heavy: dict[int, int]):
        keys = np.array(sorted(heavy), np.uint64)
        self.keys, self.counts = keys, np.array([heavy[int(k)] for k in keys], np.int64)

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Estimated classes of each shingle; 1 for those that are not in the table."""
        if not len(self.keys):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.counts[at], 1)

    def sorted(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """hashes (which are sorted) in the global order, and their counts."""
        counts = self.count(hashes)
        rank = np.argsort(counts, kind="stable")
        return hashes[rank], counts[rank]


def slack(n: int) -> int:
    """Shingles that a set of n can lack in any set that it is linked with."""
    return n - -(-PERCENT * n // 100)


def least_level(n: int) -> int:
    """The lowest level that a set of n picks; it never falls as n grows."""
    return 1 + n // LEAST_PART


def longer_level(n: int) -> int:
    """The level of a class that has candidates at its first level."""
    return 1 + n // LONGER_PART


def level(counts: np.ndarray) -> int:
    """The level of a set whose shingles have these counts, in order: the cheapest by scanned postings and candidates.

    At level l at most (sum of the counts in the prefix) / l sets can share l shingles; each costs a verification.
    """
    n = len(counts)
    levels = np.arange(least_level(n), max(least_level(n), n // 8) + 1)
    scanned = np.cumsum(counts)[slack(n) + levels - 1].astype(float)
    return int(levels[np.argmin(scanned + (1 + n / 64) * scanned / levels)])


def profiles(rows: DataFrame) -> DataFrame:
    """For each document (kind 0): doc_id, size and digest of its set; for shingles that repeat in a stretch (kind 1): hash as doc_id, count as n."""
    names = ["kind", "doc_id", "n", "hi", "lo"]

    def repeated(sets: list[np.ndarray]) -> list[tuple]:
        found, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= REPEATED
        return [(1, h - (1 << 63), c, 0, 0) for h, c in zip(found[often].tolist(), counts[often].tolist(), strict=True)]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            out, sets, held, seen = [], [], 0, set()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                h = shingle(text.as_py())
                both = digest(h)
                out.append((0, doc, len(h), *both))
                if both not in seen:
                    seen.add(both)
                    sets.append(h)
                    held += len(h)
                if held > STRETCH:
                    out += repeated(sets)
                    sets, held = [], 0
            out += repeated(sets) if sets else []
            columns = zip(*out, strict=True) if out else ((),) * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return rows.mapInArrow(profile, ", ".join(f"{c} long" for c in names))


class Ids:
    """The number of a class: the lower half of its digest, or another where two classes have the same."""

    def __init__(self, shared: list[tuple[int, int]]):
        self.other = {both: xxhash.xxh3_64_intdigest(repr(both).encode(), seed=1) - (1 << 63) for both in shared}

    def __call__(self, both: tuple[int, int]) -> int:
        return self.other.get(both, both[1]) if self.other else both[1]


def _postings(classes: Iterator[tuple[int, int, np.ndarray]], order: Order, longer: bool) -> Iterator[pa.RecordBatch]:
    """token, id, n, level, own and heavy of the prefixes of classes (id, own, sorted set), in batches of bounded size."""
    schema = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("level", pa.int32()), ("own", pa.int32()), ("heavy", pa.bool_())])
    parts, held = [], 0
    for number, own, hashes in classes:
        tokens, counts = order.sorted(hashes)
        n = len(tokens)
        at = longer_level(n) if longer else level(counts)
        k = slack(n) + at
        parts.append((tokens[:k].view(np.int64), np.full(k, number), np.full(k, n, np.int32), np.full(k, at, np.int32), np.full(k, own, np.int32), counts[:k] > 1))
        held += k
        if held > STRETCH // 2:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)
            parts, held = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)


_POSTINGS = "token long, id long, n int, level int, own int, heavy boolean"


def prefixes(rows: DataFrame, order, ids) -> DataFrame:
    """Every shingle in the prefix of every class (copies in other batches repeat it)."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, number = Shingler(), ids.value

        def classes():
            for batch in batches:
                seen = set()
                for text in batch.column("text"):
                    h = shingle(text.as_py())
                    both = digest(h)
                    if len(h) and both not in seen:
                        seen.add(both)
                        yield number(both), 0, h

        yield from _postings(classes(), order.value, False)

    return rows.select("text").mapInArrow(show, _POSTINGS)


def longer_prefixes(texts: DataFrame, order) -> DataFrame:
    """The same of classes (id, own, text), lengthened, with own."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        yield from _postings(((number, own, shingle(text.as_py())) for batch in batches for number, own, text in zip(*(batch.column(c).to_pylist() for c in ("id", "own")), batch.column("text"), strict=True)), order.value, True)

    return texts.select("id", "own", "text").mapInArrow(show, _POSTINGS)


def _needed(n: Column) -> Column:
    """The least size of a set that one of n can be linked with."""
    return F.ceil(F.lit(PERCENT) * n / 100)


def _dealt(postings: DataFrame) -> tuple[DataFrame, Window]:
    """postings with `lowest`, and the window of a shingle: heavy ones are dealt to SALTS tasks, where nothing is asked of others."""
    dealt = postings.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)))
    return dealt, Window.partitionBy("token", "salt")


def _lowest(part: int) -> Column:
    """A bound for the level of any class that shows the shingle and has a size to be linked; a set of n has at least 1 + n // part."""
    partner = (1 + F.floor(_needed(F.col("n")) / part)).cast("int")
    return F.greatest(partner, F.when(~F.col("heavy"), F.col("least"))).alias("lowest")


def _enough(level: Column, lowest: Column) -> Column:
    """Whether a class that shows shingles with these sorted bounds can be linked.

    Two linked classes share at least as many shingles as the lower of their levels, and the bound of each of these is no
    more: so k bounds up to k are needed, or as many shingles as the own level.
    """
    return (F.size(lowest) >= level) | F.exists(F.transform(lowest, lambda x, i: x <= i + 1), lambda x: x)


def candidates(postings: DataFrame) -> DataFrame:
    """id and own of the classes that show enough shingles which others show too; own is lower for more central ones."""
    dealt, apart = _dealt(postings)
    alone = F.min("id").over(apart) == F.max("id").over(apart)
    again = F.coalesce(F.lag("id").over(apart.orderBy("id")) == F.col("id"), F.lit(False))  # a copy from another batch
    live = dealt.withColumns({"alone": alone, "least": F.min("level").over(apart), "again": again}).filter("not again and (heavy or not alone)")
    gathered = live.select("id", "n", "level", _lowest(LEAST_PART)).groupBy("id", "n", "level").agg(F.sort_array(F.collect_list("lowest")).alias("lowest")).filter(_enough(F.col("level"), F.col("lowest")))
    length = F.col("n") - _needed(F.col("n")) + F.col("level")
    return gathered.select("id", (1000 * (length - F.size("lowest")) / length).cast("int").alias("own"))


def shown(postings: DataFrame) -> DataFrame:
    """id, rank, spare and shows (heavy, key) of the classes that still show enough: key is the hub of a light shingle, and
    a heavy shingle itself. spare are the matches that a class can do without: those of two linked classes are fewer than the
    matches they need."""
    dealt, apart = _dealt(postings)
    rank = F.struct("own", F.xxhash64("id").alias("at"), "id")
    live = dealt.withColumns({"least": F.min("level").over(apart), "top": F.min(rank).over(apart), "of": F.count("*").over(apart)}).filter("heavy or of > 1")
    key = F.when(F.col("heavy"), F.col("token")).otherwise(F.col("top.id")).alias("key")
    gathered = live.select("id", "n", "level", "own", _lowest(LONGER_PART), "heavy", key).groupBy("id", "n", "level", "own").agg(F.sort_array(F.collect_list(F.struct("lowest", "heavy", "key"))).alias("shows"))
    gathered = gathered.filter(_enough(F.col("level"), F.col("shows.lowest")))
    spare = F.floor((F.least(F.col("level"), F.col("shows")[0].lowest) - 1) / 2).alias("spare")
    return gathered.select("id", rank.alias("rank"), spare, "shows")


def followed(classes: DataFrame) -> DataFrame:
    """id and hub: the hubs that each class is compared with."""
    postings = classes.select("id", "spare", "rank", F.explode("shows").alias("x")).select("id", "spare", "rank", "x.heavy", "x.key")
    heavy = postings.filter("heavy")
    tops = heavy.groupBy("key").agg(F.min("rank").alias("hub"))  # at most HEAVY rows
    met = postings.filter("not heavy").select("id", "spare", F.col("key").alias("hub")).unionByName(heavy.join(F.broadcast(tops), "key").select("id", "spare", F.col("hub.id").alias("hub")))
    counted = met.filter("id <> hub").groupBy("id", "spare", "hub").agg(F.count("*").alias("met"))
    dropped = F.sum("met").over(Window.partitionBy("id").orderBy("met", "hub"))
    return counted.withColumn("sum", dropped).filter("sum > spare").select("id", "hub")


_ITEMS = "g long, a long, n int, n_g int, lacks array<long>, extras array<long>"


def texts_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """id, own and text of the classes (id, own, rep: the doc_id of one of its documents), thinned by a filter of at most BUCKETS numbers first."""
    chosen = classes.withColumnRenamed("rep", "doc_id")
    bucket = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")
    buckets = chosen.select(bucket()).distinct()  # at most BUCKETS rows
    return rows.withColumn("bucket", bucket()).join(F.broadcast(buckets), "bucket", "left_semi").select("doc_id", "text").join(chosen, "doc_id").select("id", "own", "text")


def beside_hubs(texts: DataFrame, follows: DataFrame) -> DataFrame:
    """For each class a and hub g that it follows: their sizes, what a lacks of g, and what it has besides. Sets travel once, to a copy of their hub."""
    copies = follows.groupBy("hub").agg(F.least(1 + F.floor(F.count("*") / TOGETHER), F.lit(COPIES)).alias("copies"))
    members = follows.join(copies, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("copies")).alias("copy"))
    hubs = copies.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    wanted = members.unionByName(hubs).groupBy("id").agg(F.collect_list(F.struct("hub", "copy")).alias("to"))
    texts = texts.join(wanted, "id")
    sent = pa.schema([("g", pa.int64()), ("copy", pa.int64()), ("a", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            out, held = [], 0
            for text, number, to in zip(batch.column("text"), batch.column("id").to_pylist(), batch.column("to").to_pylist(), strict=True):
                tokens = shingle(text.as_py()).view(np.int64)
                for x in to:
                    out.append((x["hub"], x["copy"], number, tokens))
                    held += len(tokens)
                    if held > STRETCH // 4:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), sent.types, strict=True)], schema=sent)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), sent.types, strict=True)], schema=sent)

    found = pa.schema([("g", pa.int64()), ("a", pa.int64()), ("n", pa.int32()), ("n_g", pa.int32()), ("lacks", pa.list_(pa.int64())), ("extras", pa.list_(pa.int64()))])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, np.zeros(0, np.int64)
        for batch in batches:
            out = []
            lists = batch.column("tokens")
            edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (g, copy, a) in enumerate(zip(batch.column("g").to_pylist(), batch.column("copy").to_pylist(), batch.column("a").to_pylist(), strict=True)):
                own = np.sort(flat[edges[i] : edges[i + 1]])
                if (g, copy) != at:  # its hub comes first
                    at, hub = (g, copy), own
                elif a != g:
                    out.append((g, a, len(own), len(hub), np.setdiff1d(hub, own, assume_unique=True), np.setdiff1d(own, hub, assume_unique=True)))
            columns = zip(*out, strict=True) if out else ((),) * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, found.types, strict=True)], schema=found)

    sides = texts.select("text", "id", "to").mapInArrow(send, "g long, copy long, a long, tokens array<long>")
    met = sides.repartition("g", "copy").sortWithinPartitions("g", "copy", F.col("a") != F.col("g"))
    return met.mapInArrow(differ, _ITEMS)


#: Sets are linked when 37 |x - y or y - x| <= 3 (|x| + |y|): 85 % of the union, in whole numbers.
def _linked(items: DataFrame) -> DataFrame:
    differing = F.size("lacks") + F.size("extras")
    return items.withColumn("d", differing).withColumn("linked", 37 * differing <= 3 * (F.col("n") + F.col("n_g")))


def _able(items: DataFrame) -> DataFrame:
    """g, a, n, d, settled, lacks and shares (extras that others of g have, too) of the members that can have links still.

    Members linked with their hub are settled: one component. Another is able if what it has of the hub and the extras
    that it shares reach the least overlap with any partner, and its differences that can be shared the least of those.
    """
    members = items.withColumn("settled", F.col("linked"))
    groups = members.groupBy("g").agg(F.count("*").alias("of"), F.min("settled").alias("all"), F.min("n").alias("least")).filter("of > 1 and not all").select("g", "least")
    members = members.join(groups, "g")
    extras = members.select("g", "a", F.explode("extras").alias("token"))
    several = extras.groupBy("g", "token").agg(F.count("*").alias("of")).filter("of > 1").select("g", "token")
    shares = extras.join(several, ["g", "token"]).groupBy("g", "a").agg(F.collect_list("token").alias("shares"))
    members = members.join(shares, ["g", "a"], "left").withColumn("shares", F.coalesce("shares", F.array().cast("array<long>")))
    partner = F.greatest(_needed(F.col("n")), F.col("least"))
    reached = PERCENT * (F.col("n") + partner) <= (100 + PERCENT) * (F.col("n_g") - F.size("lacks") + F.size("shares"))
    over = 37 * F.col("d") - 3 * (F.col("n") + F.col("n_g"))
    kept = members.filter(F.col("settled") | (reached & (40 * (F.size("lacks") + F.size("shares")) >= over)))
    return kept.select("g", "a", "n", "d", "settled", "lacks", "shares")


def centred(members: DataFrame) -> DataFrame:
    """g, a, n, settled, margin and shared of members, measured from the centre of their group.

    The centre is the set that holds what most members hold: differences from the hub that more than half of a group have
    are turned round, so they count for those that don't have them. The distance of two members is the symmetric difference
    of their differences from the centre, as it is of those from the hub, but these are as few as can be. margin is
    3 n - 37 times their number: two members whose margins sum to 0 or more are linked, others have to share
    -(sum) / 74 of them. shared are those that others have as well, as (members that have it, token), rarest first.
    """
    size = members.groupBy("g").agg(F.count("*").alias("group_size"), F.min("settled").alias("all")).filter("group_size > 1 and not all").select("g", "group_size")
    members = members.join(size, "g")
    tokens = members.select("g", "a", "group_size", F.explode(F.concat("lacks", "shares")).alias("token"))
    counts = tokens.groupBy("g", "token", "group_size").agg(F.count("*").alias("of"))
    most = 2 * F.col("of") > F.col("group_size")
    turned = counts.filter(most).groupBy("g").agg(F.collect_list(F.struct((F.col("group_size") - F.col("of")).alias("of"), "token")).alias("turned"))
    told = tokens.join(counts.filter("of > 1").select("g", "token", "of"), ["g", "token"])
    own = told.groupBy("g", "a").agg(F.collect_list(F.when(~most, F.struct("of", "token"))).alias("minor"), F.collect_list(F.when(most, F.col("token"))).alias("mine"))
    none = F.array().cast("array<struct<of:bigint,token:bigint>>")
    whole = members.drop("lacks", "shares").join(own, ["g", "a"], "left").join(turned, "g", "left").withColumns({"minor": F.coalesce("minor", none), "mine": F.coalesce("mine", F.array().cast("array<long>")), "turned": F.coalesce("turned", none)})
    lacking = F.filter("turned", lambda x: ~F.array_contains("mine", x["token"]) & (x["of"] > 1))
    distance = F.col("d") + F.size("turned") - 2 * F.size("mine")
    return whole.select("g", "a", "n", "settled", (3 * F.col("n") - 37 * distance).cast("long").alias("margin"), F.sort_array(F.concat("minor", lacking)).alias("shared"))


_ASKED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _meet(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between the asking and the asked rows of a cell, as many as join their components."""
    asks, ids = rows.column("asks").to_numpy(zero_copy_only=False), rows.column("a").to_numpy()
    n, margin = rows.column("n").to_numpy(), rows.column("margin").to_numpy()
    lists = rows.column("tokens").combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lengths)
    distance = (3 * n.astype(np.int64) - margin) // 37
    order = np.argsort(flat, kind="stable")
    flat_sorted, row_sorted = flat[order], row[order]
    ends, top, out = np.r_[0, np.cumsum(lengths)], {}, []

    def find(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x]
        return x

    asked = ~asks
    for u in np.flatnonzero(asks):
        own = flat[ends[u] : ends[u + 1]]
        low, high = np.searchsorted(flat_sorted, own, "left"), np.searchsorted(flat_sorted, own, "right")
        met = np.concatenate([row_sorted[i:j] for i, j in zip(low, high, strict=True)]) if len(own) else np.zeros(0, np.int64)
        overlap = np.bincount(met, minlength=len(ids))
        linked = asked & (37 * (distance[u] + distance - 2 * overlap) <= 3 * (n[u].astype(np.int64) + n)) & (ids != ids[u])
        for v in np.flatnonzero(linked):
            a, b = find(int(ids[u])), find(int(ids[v]))
            if a != b:
                top[a] = b
                out.append((int(ids[u]), int(ids[v])))
    columns = zip(*out, strict=True) if out else ((), ())
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ASKED)


#: Rows of a cell that ask, and that are asked.
CELL = 128


def within(items: DataFrame) -> DataFrame:
    """Links (a, b) between members of one group that aren't both linked with its hub, enough to join their components.

    Members are measured from the centre of their group (`centred`). Around the member b with the greatest margin, all
    whose margins sum to 0 or more with its own are linked with it. If a settled member is among those, they are settled;
    whoever isn't is open. An open member shows a prefix of its shared differences, rarest first, as long as its least
    overlap with any member demands, the others one as long as their least overlap with an open one does: two that are
    linked show one token both. Members that show a token meet in cells of bounded size, the open ones asking, and are
    compared there as sets. Unlinked members, as long as what they share is common to most of the family, meet nowhere,
    and nothing is done twice: the number of steps doesn't depend on the family.
    """
    table = common.stored(centred(common.stored(_able(items))))
    best = table.groupBy("g").agg(F.max(F.struct("margin", "a")).alias("best"))
    near = table.join(best, "g").withColumn("beside", F.col("margin") + F.col("best.margin") >= 0)
    homes = near.filter((F.col("beside") | (F.col("a") == F.col("best.a"))) & F.col("settled")).select("g").distinct().withColumn("home", F.lit(True))
    placed = near.join(homes, "g", "left").withColumn("open", ~F.col("settled") & ~(F.coalesce("home", F.lit(False)) & (F.col("beside") | (F.col("a") == F.col("best.a")))))
    placed = common.stored(placed)
    certain = placed.filter("beside and a <> best.a").select("a", F.col("best.a").alias("b"))
    asking = placed.filter("open").groupBy("g").agg(F.max("margin").alias("most"))
    able = placed.join(asking, "g").select("g", "a", "n", "margin", "open", F.transform("shared", lambda x: x["token"]).alias("tokens"), F.greatest(F.ceil((-F.col("margin") - F.when(F.col("open"), F.col("best.margin")).otherwise(F.col("most"))) / 74), F.lit(1)).cast("int").alias("needed")).filter("size(tokens) >= needed")
    shown = able.select("g", "a", "open", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("needed") + 1)).alias("token"))
    blocks = shown.groupBy("g", "token").agg(F.count("*").alias("of"), F.count_if("open").alias("asking")).filter("of > 1 and asking > 0")
    parts = blocks.select("g", "token", *[F.ceil(F.col(c) / CELL).cast("int").alias(f"{c}_parts") for c in ("of", "asking")])
    met = shown.join(parts, ["g", "token"])
    place = lambda of: F.pmod(F.xxhash64("a"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asks = met.filter("open").select("g", "token", "a", F.lit(True).alias("asks"), place("asking_parts").alias("i"), every("of_parts").alias("j"))
    asked = met.select("g", "token", "a", F.lit(False).alias("asks"), place("of_parts").alias("j"), every("asking_parts").alias("i")).select("g", "token", "a", "asks", "i", "j")
    sides = asks.unionByName(asked).join(able.select("g", "a", "n", "margin", "tokens"), ["g", "a"])
    links = sides.groupBy("g", "token", "i", "j").applyInArrow(_meet, "a long, b long")
    return certain.unionByName(links)


def links(rows: DataFrame, classes: DataFrame, order, ids) -> DataFrame:
    """Links (a, b) between classes: not all, but enough to join every component."""
    able = common.stored(candidates(prefixes(rows, order, ids)))
    texts = common.stored(texts_of(rows, able.join(classes, "id")))
    able = common.stored(shown(longer_prefixes(texts, order)))
    items = common.stored(_linked(beside_hubs(texts, common.stored(followed(able)))))
    return items.filter("linked").select("a", F.col("g").alias("b")).unionByName(within(items))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links lead to, itself included. Documents without a word have no shingles
    and no links; a null text counts as empty. A null doc_id stays null; rows without one are compared like others, and
    their component is null if no row in it has an id. Rows that repeat a doc_id are answered one by one, each text is
    compared, and all of them are one node: what links one links the others. An empty table gives an empty result;
    other columns are not read.
    """
    rows, key = common.keyed(common.id_and_text(docs))
    if key == "doc_id":
        return _joined(rows)
    found = common.stored(_joined(rows.select(F.col(key).alias("doc_id"), "text")))
    ids = rows.select(F.col(key).alias("key"), F.col("doc_id").alias("id"))
    answered = common.stored(found.withColumnRenamed("doc_id", "key").join(ids, "key"))
    several = answered.filter("n_shingles > 0 and id is not null").select("id", "component_id").distinct()
    first = several.groupBy("id").agg(F.min("component_id").alias("a"), F.count("*").alias("of")).filter("of > 1")
    merged = components(several.join(first, "id").select("a", F.col("component_id").alias("b")).filter("a <> b"))
    labelled = answered.join(merged.withColumnRenamed("node", "component_id"), "component_id", "left").withColumn("component", F.coalesce("component", "component_id"))
    # Keys follow the order of the ids, those without one last: the smallest key of a component has its smallest id.
    lowest = labelled.join(ids.select(F.col("key").alias("component"), F.col("id").alias("low")), "component")
    return lowest.select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("id")).alias("component_id"))


def _joined(rows: DataFrame) -> DataFrame:
    """The same for rows with a doc_id of their own each."""
    spark = rows.sparkSession
    found = common.stored(profiles(rows))
    heavy = found.filter("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "doc_id").limit(HEAVY).collect()
    order = spark.sparkContext.broadcast(Order({r["doc_id"] + (1 << 63): r["n"] for r in heavy}))
    profile = found.filter("kind = 0").drop("kind")
    classes = profile.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    # Halves that two classes share are there by chance, not by the data: one in 2^64 pairs.
    halves = classes.groupBy("lo").agg(F.collect_list("hi").alias("his")).filter("size(his) > 1").collect()
    number = Ids([(hi, r["lo"]) for r in halves for hi in r["his"]])
    number_column = F.col("lo")
    for (hi, lo), other in number.other.items():
        number_column = F.when((F.col("hi") == hi) & (F.col("lo") == lo), F.lit(other)).otherwise(number_column)
    classes = common.stored(classes.withColumn("id", number_column))
    named = classes.select("id", "rep")
    edges = links(rows, named, order, spark.sparkContext.broadcast(number))
    by_rep = edges.join(named.toDF("a", "rep_a"), "a").join(named.toDF("b", "rep_b"), "b")
    linked = components(by_rep.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    labels = classes.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    out = profile.join(labels, ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
