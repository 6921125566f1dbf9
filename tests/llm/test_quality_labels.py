"""The weak-label scorer, which sees no label, against labels.quality."""

from pathlib import Path

import pytest

from hexfeat.llm import common, queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_scorer_agrees_with_labels(spark):
    found = queries.QUERIES["op1_quality_classifier"](spark, DATA).join(common.read(spark, DATA, "labels"), "doc_id")
    kept = {r.quality: (r.kept, r.n) for r in found.groupBy("quality").agg({"*": "count"}).withColumnRenamed("count(1)", "n").join(found.filter("kept").groupBy("quality").count().withColumnRenamed("count", "kept"), "quality", "left").fillna(0).collect()}
    assert kept[1][0] >= 0.97 * kept[1][1] and kept[0][0] <= 0.15 * kept[0][1]
