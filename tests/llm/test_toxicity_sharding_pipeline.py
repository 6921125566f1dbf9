import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from hexfeat.llm import common, sharding, toxicity


def corpus(spark, n=900):
    """Toxic texts name a group next to an insult; either alone is harmless."""
    rng = random.Random(8)
    plain = [f"term{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["idiot"] * insult + ["villagers"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(insult and group)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_pairs_are_learnt(spark, docs, texts):
    rows, labels = corpus(spark)
    model = toxicity.fit(rows, labels)
    out = toxicity.score_toxicity(rows, model).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in out)
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    odd = toxicity.score_toxicity(docs, model).collect()
    assert len(odd) == len(texts) and all(r.score is not None for r in odd)
    assert toxicity.score_toxicity(docs.filter("false"), model).count() == 0
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = toxicity.fit(rows, flipped)
    assert (again.loud == model.loud).all() and np.allclose(again.weights, model.weights)
    nothing = toxicity.fit(rows, labels.filter("toxic = 0"))
    assert toxicity.score_toxicity(rows, nothing).filter("predicted = 1").count() == 0


def test_sample_is_bounded_in_rows_and_places(spark, monkeypatch):
    """One labelled id that most rows share doesn't fill the fit; copies of one id and text are one row."""
    rows, labels = corpus(spark)
    shared = next(i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1)
    many = rows.unionByName(spark.createDataFrame([(shared, f"other{k} words{k % 7}", "en", "s") for k in range(500)] + [(shared, "same", "en", "s")] * 200, rows.schema))
    known = common.id_and_text(many).join(labels, "doc_id").select("doc_id", "text")
    assert common.picked(known, 300).count() == 300 and common.picked(known, 10**6).count() == 900 + 500 + 1
    seen = []
    plain = toxicity.common.stored
    monkeypatch.setattr(toxicity.common, "stored", lambda df: seen.append(plain(df)) or seen[-1])
    model = toxicity.fit(many, labels, sample=300)
    assert seen[0].count() <= 300 and len(model.weights) == toxicity.DIMENSIONS
    monkeypatch.setattr(toxicity, "PLACES", 200)
    toxicity.fit(many, labels, sample=300)
    assert toxicity.score_toxicity(many, model).count() == many.count()


def test_pairs_without_any_effect_of_their_words(spark):
    """Toxic when both words or neither occur: each alone says nothing, so an additive score is right by half."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(4000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"term{rng.randrange(300)}" for _ in range(30)] + ["idiot"] * insult + ["villagers"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult == group)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, labels)
    assert not model.loud.any()
    held = toxicity.score_toxicity(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in held) >= 0.93 * len(held)


def test_hilbert_curve_steps_by_one():
    for dims, bits in ((2, 4), (3, 3)):
        points = np.array(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
        index = sharding.hilbert_index(list(points), bits)
        assert sorted(index) == list(range(1 << bits * dims))
        assert set(np.abs(np.diff(points[:, np.argsort(index)], axis=1)).sum(0)) == {1}


def test_shards(spark, docs, texts):
    rows, _ = corpus(spark)
    for table, n in ((rows, 900), (docs, len(texts))):
        out = sharding.hilbert_shards(table).toPandas()
        assert len(out) == n and set(out.law) == {"bytes"} and out.grown_shard.isna().all() and out.shard.between(0, 7).all()
        for _, own in out.groupby("shard"):
            assert sorted(own.slot) == list(range(len(own)))
    sizes = sharding.hilbert_shards(rows).toPandas()
    loads = sizes.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() - loads.min() <= 2 * sizes["size"].max() + 0.01 * loads.mean()
    texts_of = {r.doc_id: r.text for r in rows.collect()}
    assert all(zlib.crc32(texts_of[i].encode()) == c and len(texts_of[i].encode()) + 1 == s for i, c, s in zip(sizes.doc_id, sizes.text_crc32, sizes["size"]))
    assert sharding.hilbert_shards(docs.filter("false")).count() == 0


def test_cuts_copies_and_pruning(spark):
    """Shards are what cutting the sorted run by hand gives, copies lie side by side, and sources that share a long beginning are pruned."""
    rng = random.Random(4)
    rows = [(i, f"text {rng.randrange(10**9)} " + "w " * rng.randrange(60), rng.choice(["de", "en"]), f"https://common-crawl-{rng.randrange(8)}") for i in range(2000)]
    rows += [(5000 + i, "a text of many copies", "en", "https://common-crawl-3") for i in range(700)] + [(7, "twice the id", None, None)]
    out = sharding.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).toPandas()
    by_text = {zlib.crc32(t.encode()): (t, s) for _, t, _, s in rows}
    out = out.sort_values(["shard", "slot"]).reset_index(drop=True)
    total, start = out["size"].sum(), out["size"].cumsum() - out["size"]
    copies = out.index[out.text_crc32 == zlib.crc32(b"a text of many copies")]
    assert len(out) == len(rows) and list(copies) == list(range(copies[0], copies[0] + 700))
    by_hand = (start * 8 // total).astype(int)
    moved = (by_hand != out.shard).sum()
    assert moved <= 8 * sharding.TOLERANCE * len(out) / 8 + 8
    spread = [out[[by_text[c][1] == f"https://common-crawl-{k}" for c in out.text_crc32]].shard.nunique() for k in range(8)]
    assert sum(spread) <= 32


def test_every_stage_keeps_what_it_should(spark, tmp_path):
    rows, labels = corpus(spark)
    base = rows.selectExpr("doc_id", "text", "lang", "source", "length(text) as n_chars", "'x' as digest", "doc_id % 2 = 0 as kept")
    more = base.filter("doc_id < 5").selectExpr("doc_id + 5000 as doc_id", "concat(text, ' ') as text", "lang", "source", "n_chars", "digest", "kept").unionByName(
        spark.createDataFrame([(7000, "the password=abcdef123456 is here", "en", "s", 33, "x", True), (7001, None, None, None, None, None, None), (None, "without id", "en", "s", 1, "x", True)], "doc_id long, text string, lang string, source string, n_chars int, digest string, kept boolean")
    )
    base.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = common.read(spark, str(tmp_path), "documents")
    names = docs.columns
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, str(tmp_path)))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == names
    after = {r.doc_id for r in kept["toxicity"].collect()}
    assert sum((truth[i] == 0) == (i in after) for i in truth) >= 0.97 * len(truth)
    unique = {r.doc_id for r in kept["exact_dedup"].collect()}
    assert {i for i in unique if i is not None} <= after and all((i in unique) != (i + 5000 in unique) for i in range(5) if i in after and i + 5000 in after)
    masked = {r.doc_id: (r.text, r.n_chars) for r in kept["secret_scans"].collect()}
    assert masked[7000] == ("the [SECRET] is here", 20) and masked[7001] == (None, None)
    assert {r.doc_id for r in kept["packing"].collect()} == set(masked)
    assert math.isclose(corpus_pipeline.run(spark, str(tmp_path)).count(), kept["packing"].count(), rel_tol=0.01)


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_harmonic_pack", "op7_hilbert_shards", "op8_exact_dedup", "op10_secret_scans"])
def test_registered_queries_cover_the_table(spark, name):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    n = common.read(spark, d, "documents").count()
    assert entry.queries()[name](spark, d).select("doc_id").distinct().count() == n


def test_stages_keep_rows_without_or_with_repeated_ids(spark):
    """One row of each group stays, whatever its doc_id; extra columns may have any name."""
    base = [f"w{k}" for k in range(120)]
    near, other = " ".join([*base[:60], "changed", *base[61:]]), "a text of its own"
    rows = [(None, " ".join(base) + "  "), (1, " ".join(base)), (2, " ".join(base)), (3, near), (3, other), (3, other), (3, near + " "), (None, "alone"), (None, None), (None, "alone "), (4, "one two three")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row_key string").repartition(3)
    unique = common.stored(corpus_pipeline.drop_copies(spark, docs, ""))
    want = [(None, " ".join(base) + "  "), (3, near + " "), (3, other), (None, "alone "), (None, None), (4, "one two three")]
    assert unique.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in unique.collect()), key=str) == sorted(want, key=str)
    apart = corpus_pipeline.drop_near_copies(spark, unique, "")
    assert sorted(((r.doc_id, r.text) for r in apart.collect()), key=str) == sorted(want[1:], key=str)
