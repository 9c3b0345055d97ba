"""Edges of exact quantiles, curves, samples and JSON documents that small tables do not show by themselves."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datascry.operators import quantiles as q
from datascry.operators.evaluate import pr_curve, roc_curve
from datascry.operators.sampling import sample_n, sample_stratified
from datascry.sources.tables import read_json_document

COLUMNS = {
    "two": [0.0, 1.0] * 400,
    "few": [0.0, 0.05, 0.1] * 266 + [0.0, 0.1],
    "equal": [7.0] * 800,
    "ties": [1.0] * 399 + [2.0] * 2 + [3.0] * 399,
    "heavy": [5.0] * 700 + [float(k) for k in range(100)],
    "all": [float(k) for k in range(800)],
    "odd": [float("nan")] * 200 + [float("inf")] * 150 + [float("-inf")] * 150 + [None] * 100 + [float(k % 9) for k in range(200)],
    "none": [None] * 800,
}
PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("buffer", [2, 40])
def test_bracketed_quantiles_end_and_are_exact(spark, monkeypatch, buffer):
    monkeypatch.setattr(q, "BUFFER_ROWS", buffer)
    names = list(COLUMNS)
    df = spark.createDataFrame(list(zip(*COLUMNS.values())), ", ".join(f"`{c}` double" for c in names)).cache()
    small = {r["column"]: r for r in q.quantiles(df, names, PROBS, limit=10 ** 6).collect()}
    for r in q.quantiles(df, names, PROBS, limit=0).collect():
        kept = sorted(v for v in COLUMNS[r["column"]] if v is not None and not math.isnan(v))
        assert r["n"] == len(kept) == small[r["column"]]["n"]
        if not kept:
            assert r["q"] is None
            continue
        for p, got in zip(PROBS, r["q"]):
            at = p * (len(kept) - 1)
            low, high = kept[math.floor(at)], kept[math.ceil(at)]
            want = low if low == high else low + (at - math.floor(at)) * (high - low)
            assert got == want or abs(got - want) < 1e-9 or (math.isnan(got) and math.isnan(want))


def test_areas_of_tiny_scores_and_margins(spark):
    rng = random.Random(0)
    tiny = spark.createDataFrame([(k % 2, 1e-5 * (k % 2) + 1e-9 * k) for k in range(200)], "label int, score double")
    assert all(abs(r.auc - 1) < 1e-9 for r in roc_curve(tiny, "label", "score").collect())
    assert abs(pr_curve(tiny, "label", "score").first().average_precision - 1) < 1e-12
    rows = [(int(rng.random() < 0.4), round(rng.gauss(0, 40), rng.choice([0, 9]))) for _ in range(3000)]
    got = roc_curve(spark.createDataFrame(rows + [(1, float("nan")), (0, None)], "label int, score double"), "label", "score").collect()
    scores, labels = np.array([s for _, s in rows]), np.array([y for y, _ in rows])
    ahead = scores[labels == 1][:, None] - scores[labels == 0][None]
    assert abs(got[0].auc - ((ahead > 0).mean() + (ahead == 0).mean() / 2)) < 1e-9
    assert len(got) <= 101 and max(r.tpr for r in got) == 1.0
    assert roc_curve(spark.createDataFrame([], "label int, score double"), "label", "score").count() == 0


def test_small_samples_of_large_tables_are_not_empty(spark):
    df = spark.range(50_000).withColumn("t", F.col("id") % 2)
    assert sample_n(df, "id", 3).count() == 3
    assert sample_stratified(df, "id", "t", 20).count() == 20
    assert sample_n(df, "id", 3).collect() == sample_n(df.repartition(7), "id", 3).collect()


def test_small_shares_follow_the_hash_of_the_key(spark):
    df = spark.range(600_000).withColumn("t", F.col("id") % 2)
    bucket = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long") % 1_000_000
    for n in (150, 500):
        want = sorted(r.id for r in df.filter(bucket < round(n / 0.6)).collect())
        assert sorted(r.id for r in sample_n(df, "id", n).collect()) == want
        assert sorted(r.id for r in sample_stratified(df, "id", "t", n).collect()) == want


def test_every_json_document_gives_its_own_list(spark, tmp_path):
    documents = [{"total": 2, "rows": [{"a": 1}, {"a": 2}]}, {"items": [{"a": 3, "b": "x"}], "rows": [{"a": 9}]}, {"rows": []}, [{"a": 4}], {"a": 5}]
    for k, document in enumerate(documents):
        (tmp_path / f"{k}.json").write_text(json.dumps(document))
    got = read_json_document(spark, str(tmp_path))
    assert sorted(r.a for r in got.collect()) == [1, 2, 3, 4, 5]
    assert [r.b for r in got.collect() if r.a == 3] == ["x"]
