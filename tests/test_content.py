import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from datascry import catalog
from datascry.functions import words as w
from datascry.operators import boxes as bx
from datascry.operators import correlate as co
from datascry.operators import plugins as pg
from datascry.operators import text as tx
from datascry.operators import vectors as vec
from datascry.operators.cleaning import fit_cleaner
from datascry.streaming import flows as fl


def test_every_oracle_has_a_query():
    catalog.load_all()
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 180


def test_sentiment_signs(spark):
    df = spark.createDataFrame([("I love this, great!",), ("A terrible, awful mess.",), ("The table is brown",), (None,)], "t string")
    got = [r[0] for r in df.select(w.sentiment_polarity("t")).collect()]
    assert got[0] == 1.0 and got[1] == -1.0 and got[2] == 0.0 and got[3] == 0.0


def test_tfidf_follows_the_rule(spark):
    texts = ["the cat sat", "the cat cat ran fast", "a dog ran"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r["id"], r["term"]): r["weight"] for r in tx.tfidf(df, "id", "t", 10, ["the"]).collect()}
    idf = lambda d: np.log(4 / (1 + d)) + 1
    row = np.array([2 * idf(2), idf(2), idf(1)])
    assert [got[(1, t)] for t in ("cat", "ran", "fast")] == pytest.approx(list(row / np.linalg.norm(row)))
    assert len({t for _, t in got}) <= 10


def test_svd_directions_match_numpy(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aa bb", "aa aa cc", "bb cc", "dd aa", "dd dd bb"] * 3)], "id long, t string")
    got = np.array([[r["x1"], r["x2"]] for r in tx.svd_projection(df, ["id"], "t").orderBy("id").collect()])
    model = tx.Tfidf.fit(df, "t")
    x = np.array([r["features"].toArray() for r in model.vectors(df, "t").orderBy("id").collect()])
    s = np.linalg.svd(x, compute_uv=False)
    assert np.linalg.norm(got, axis=0) == pytest.approx(s[:2])


def test_pair_products_equal_aggregates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, size=(400, 4))
    x[:, 1] += x[:, 0]
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    one = {(r["x"], r["y"]): (r["n"], r["r"]) for r in co._pair_aggregates(df, list("abcd")).collect()}
    two = {(r["x"], r["y"]): (r["n"], r["r"]) for r in co._pair_products(df, list("abcd")).collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert one[k][0] == two[k][0] and one[k][1] == pytest.approx(two[k][1], abs=1e-9)


def boxes(spark, n, seed, score=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        cx, cy = rng.uniform(0.2, 0.8, 2)
        bw, bh = rng.choice([0.05, 0.1, 0.2, 0.4], 2)
        rows.append((f"im{i % 2}", int(i % 2), float(cx), float(cy), float(bw), float(bh), f"p{i}", float(np.round(rng.random(), 3))))
    rows += [(*rows[0][:6], f"copy{i}", float(i / 100)) for i in range(5)]
    df = spark.createDataFrame(rows, "image_stem string, class_id int, cx double, cy double, w double, h double, p_id string, score double")
    return df if score else df.drop("p_id", "score")


def test_grid_finds_the_same_overlaps(spark):
    truth, pred = boxes(spark, 150, 1), boxes(spark, 150, 2)
    for least in (0.3, 0.5, 0.8):
        a, b = (sorted(map(str, bx.box_iou_pairs(truth, pred, least, limit).select("t_cx", "t_cy", "p_cx", "p_cy", F.round("iou", 9)).collect())) for limit in (1000, 1))
        assert a == b and (least > 0.6 or len(a) > 5)


def test_hierarchical_grid_at_any_overlap(spark):
    rng = np.random.default_rng(4)

    def many(n):
        size = 2.0 ** rng.uniform(-9, 0, (n, 2))
        size[: n // 3] = 2.0 ** rng.integers(-6, 0, (n // 3, 2))  # widths at and just under powers of two
        size[: n // 6] = np.nextafter(size[: n // 6], 0)
        return [("a", 1, float(x), float(y), float(w), float(h)) for (x, y), (w, h) in zip(rng.uniform(0, 1, (n, 2)).round(2), size)]

    truth, pred = many(240), many(240)
    pred += truth[:60] + [(*r[:4], r[4] / 2, r[5]) for r in truth[:40]] + [(r[0], r[1], r[2] + r[4] / 3, *r[3:]) for r in truth[:40]]  # equal, at exactly a half, shifted to a half
    pred += [("a", 1, 0.5, 0.5, 0.0, 0.1), ("a", 1, None, 0.5, 0.1, 0.1)]
    schema = "image_stem string, class_id int, cx double, cy double, w double, h double"
    t, p = spark.createDataFrame(truth, schema), spark.createDataFrame(pred, schema)
    for least in (0.01, 0.5, 1.0):
        a, b = (sorted(map(str, bx.box_iou_pairs(t, p, least, limit).collect())) for limit in (10**6, 0))
        assert a == b and len(a) >= 50  # the overlap of some equal boxes rounds to just under 1
        cells = [bx._placed(bx._distinct_boxes(df, q), q, least, q == "t_").groupBy(f"{q}cx", f"{q}cy", f"{q}w", f"{q}h").count().agg(F.max("count")).first()[0] for df, q in ((t, "t_"), (p, "p_"))]
        steps = math.ceil(math.log2(1 / least))
        assert cells[0] <= (steps + 1) ** 2 and cells[1] <= 9 * (steps + 2) ** 2


def test_grid_repeats_boxes_few_times(spark):
    rng = np.random.default_rng(6)
    rows = [("a", 1, *map(float, rng.uniform(0, 1, 2)), *map(float, 2.0 ** rng.uniform(-6, 0, 2))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "image_stem string, class_id int, cx double, cy double, w double, h double")
    placed = [bx._placed(bx._distinct_boxes(df, q), q, 0.5, q == "t_").count() / len(rows) for q in ("t_", "p_")]
    assert placed[0] < 3 and placed[1] < 8


def test_matching_in_groups_equals_rounds(spark):
    truth = boxes(spark, 60, 1)
    pred = boxes(spark, 90, 1, score=True)
    a, b = (sorted(map(str, bx.match_detections(truth, pred, [0.3, 0.6], pair_limit=limit).select("limit", "image_stem", "class_id", "p_id").collect())) for limit in (10**6, 0))
    assert a == b and len(a) > 50


def test_many_groups_are_matched_in_one_call_and_predictions_stay_one_row(spark, monkeypatch):
    truth, pred = boxes(spark, 60, 1), boxes(spark, 90, 1, score=True)
    hits = bx._hits(truth, pred, [0.3, 0.6], 10**6)
    assert hits.groupBy("image_stem", "class_id", "p_id").count().filter("count > 1").isEmpty()
    whole = sorted(map(str, bx.match_detections(truth, pred, [0.3, 0.6]).collect()))
    monkeypatch.setattr(bx, "BUCKET_PAIRS", 5)
    assert sorted(map(str, bx.match_detections(truth, pred, [0.3, 0.6]).collect())) == whole


def test_perfect_and_useless_detections(spark):
    truth = boxes(spark, 40, 1).dropDuplicates()
    hit = truth.withColumns({"p_id": F.concat_ws("-", "image_stem", "cx"), "score": F.lit(0.9)})
    overall = bx.detection_map(truth, hit).filter("class_id is null").first()
    assert overall["map50"] == pytest.approx(1.0) and overall["map50_95"] == pytest.approx(1.0)
    miss = hit.withColumn("cx", F.col("cx") + 5)
    assert bx.detection_map(truth, miss).filter("class_id is null").first()["map50"] == 0.0


def test_pca_shape(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(20, 12)))], "id int, v array<double>")
    assert len(vec.pca_compress(df, "v", 5)[1].first()["components"]) == 5


def test_plugins(spark):
    pg.register_plugin("add", lambda df, c, by: df.withColumn(c, F.col(c) + by), {"c": None, "by": 0})
    df = spark.range(3)
    assert [r[0] for r in pg.apply_plugin(df, "plugin:add:c=id,by=2").collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        pg.apply_plugin(df, "plugin:add:nope=1")

    def spoil(pdf):
        raise RuntimeError("broken plugin")

    pg.register_pandas_plugin("spoil", spoil, "id long")
    with pytest.raises(Exception, match="broken plugin"):
        pg.apply_plugin(df, "plugin:spoil").collect()
    names = {r["id"]: r["kind"] for r in pg.plugin_catalog(spark).collect()}
    assert names["add"] == "spark" and names["spoil"] == "pandas"
    assert [pg.parse_value(x) for x in ("1", "1.5", "true", "x")] == [1, 1.5, True, "x"]


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(200).select("id", F.when(F.col("id") % 9 != 0, F.col("id").cast("double")).alias("v"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    model = fit_cleaner(rows, [{"column": "v", "actionType": "impute_mean"}, {"column": "id", "actionType": "remove_less_than:10"}])
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    fl.write_stream(fl.stream_clean(stream, model, training=True), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, model.transform(rows, training=True).collect()))
    with pytest.raises(ValueError):
        fl.check_streamable(fit_cleaner(rows, [{"column": "all", "actionType": "remove_duplicates"}]), True)


def test_stream_with_dedup_and_donor_table_equals_batch(spark, tmp_path):
    from datascry.operators.cleaning import CleanerModel
    from datascry.operators.imputers import KnnImputer
    rows = spark.range(120).select((F.col("id") % 100).alias("id"), F.timestamp_seconds(F.col("id") % 100 + 1_700_000_000).alias("at"), F.lit("clash").alias("__instant"),
                                   F.when(F.col("id") % 100 % 7 != 0, (F.col("id") % 100) * 1.5).alias("v"), F.when(F.col("id") % 100 % 5 != 0, (F.col("id") % 100) * 2.0).alias("w"))
    rows.filter("id >= 10").repartition(2).write.parquet(str(tmp_path / "in"))
    fitted = fit_cleaner(rows, [{"column": "all", "actionType": "remove_duplicates"}, {"column": "id", "actionType": "rename:key"}, {"column": "v", "actionType": "impute_knn"}])
    stored = KnnImputer.fit(rows.withColumnRenamed("id", "key"), ["key", "v", "w"], limit=10)
    assert stored.donors is None
    model = CleanerModel(fitted.renames, fitted.actions, {("v", "impute_knn"): stored})
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run():
        fl.write_cleaned(stream, model, str(tmp_path / "out"), str(tmp_path / "ck"), training=True, ts="at").awaitTermination()

    run()
    rows.filter("id < 10 or id = 50").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))  # an old copy comes again, within the watermark
    run()
    key = lambda df: sorted(map(str, df.select("key", "v", "w", "__instant").collect()))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert key(got) == key(model.transform(rows, training=True)) and got.count() == 100
    with pytest.raises(ValueError):
        fl.stream_clean(stream, model, training=True, ts="at")
    with pytest.raises(ValueError):
        fl.write_cleaned(stream, model, str(tmp_path / "no"), str(tmp_path / "ck2"), training=True)


def test_sketches_of_arriving_files_stay_within_their_bounds(spark, tmp_path):
    rows = spark.range(40000).select("id", F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, float("nan")).otherwise((F.col("id") * 7919 % 40000).cast("double")).alias("v"),
                                     (F.col("id") % 1000).cast("string").alias("s"), F.lit(None).cast("double").alias("none"), F.array("id").alias("a"),
                                     F.create_map(F.lit("k"), "id").alias("m"), F.lit(5.5).alias("same"))
    source, out = str(tmp_path / "in"), str(tmp_path / "p")
    rows.repartition(5).write.parquet(source)
    fl.scheduled_profile(spark, source, out, rows.schema, max_files=1)
    assert len(list((tmp_path / "p" / "parts").glob("batch=*"))) == 5
    got = {r["column"]: r for r in fl.scheduled_profile(spark, source, out, rows.schema, max_files=1).collect()}
    finite = rows.filter("v is not null and not isnan(v)")
    n = finite.count()
    for q, value in zip((0.25, 0.5, 0.75), got["v"]["quartiles"]):
        assert abs(finite.filter(F.col("v") <= value).count() / n - q) < 0.015
    assert got["same"]["quartiles"] == [5.5] * 3 and got["same"]["distinct"] == 1 and got["none"]["quartiles"] is None and got["none"]["distinct"] == 0
    assert got["s"]["quartiles"] is None and abs(got["s"]["distinct"] - 1000) < 30 and abs(got["id"]["distinct"] - 40000) < 1200
    assert abs(got["a"]["distinct"] - 40000) < 1200 and got["m"]["distinct"] is None and got["id"]["rows"] == 40000


def test_scheduled_profile_counts_new_files_once(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") * 1.0 + 1e9).alias("v"))
    source, out = str(tmp_path / "in"), str(tmp_path / "p")
    rows.filter("id < 40").write.parquet(source)
    fl.scheduled_profile(spark, source, out, rows.schema)
    rows.filter("id >= 40").write.mode("append").parquet(source)
    got = {r["column"]: r for r in fl.scheduled_profile(spark, source, out, rows.schema).collect()}
    want = rows.agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev("v").alias("s")).first()
    assert got["v"]["rows"] == 100 and got["v"]["mean"] == pytest.approx(want["m"]) and got["v"]["std"] == pytest.approx(want["s"])


def test_late_rows_are_dropped(spark, tmp_path):
    def push(rows, name):
        spark.createDataFrame(rows, "ts string, k string, v double").select(F.col("ts").cast("timestamp").alias("ts"), "k", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    schema = "ts timestamp, k string, v double"

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        fl.write_stream(fl.stream_window_profile(stream, "ts", "v", "k"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    push([("2026-01-01 10:00:00", "a", 1.0), ("2026-01-03 10:00:00", "a", 3.0)], "one")
    run()
    push([("2026-01-01 11:00:00", "a", 99.0), ("2026-01-05 10:00:00", "a", 5.0)], "two")
    run()
    days = {str(r["start"])[:10]: (r["n"], r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert days["2026-01-01"] == (1, 1.0) and days["2026-01-03"] == (1, 3.0)


@pytest.mark.parametrize("limits", [(1 << 17, 500, 10_000), (64, 3, 40), (64, 3, 4), (1, 500, 10_000)])
def test_ngrams_are_exact_however_few_buckets_are_told_apart(spark, monkeypatch, limits):
    import random
    from collections import Counter
    for name, value in zip(("GRAM_BUCKETS", "FULL_BUCKETS", "MOST_BUCKETS"), limits):
        monkeypatch.setattr(tx, name, value)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "ab", "cd", "ef", "gh", "ij", "kl"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "ab", "x y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for n in (2, 3):
        want: Counter = Counter()
        for t in texts:
            words = [w for w in (t or "").split() if len(w) > 1 and w != "the"]
            want.update(" ".join(words[i:i + n]) for i in range(len(words) - n + 1))
        top = sorted(want.items(), key=lambda x: (-x[1], x[0]))
        assert [tuple(r) for r in tx.ngrams(df, "text", n, 10, ["the"]).collect()] == top[:10]
        assert [tuple(r) for r in tx.ngrams(df, "text", n, 10_000, ["the"]).collect()] == top
    assert tx.ngrams(df.limit(0), "text").count() == 0


def test_kmeans_counts_equal_rows_once(spark, monkeypatch):
    from datascry.operators import cluster as cu
    rng = np.random.default_rng(6)
    points = [(float(x + 20 * (i % 2)), float(y - 15 * (i % 2))) for i, (x, y) in enumerate(rng.normal(size=(90, 2)))] + [(None, 1.0)]
    df = spark.createDataFrame([p for i, p in enumerate(points) for _ in range(2 + 5 * (i % 2))], "a double, b double")
    used, plain = [], cu.KMeans
    monkeypatch.setattr(cu, "KMeans", lambda **settings: (used.append(settings.get("weightCol")), plain(**settings))[1])
    labelled, table = cu.kmeans_auto_k(df, ["a", "b"], ks=(2,))
    assert used == ["__weight"] and labelled.count() == df.count() and "__weight" not in labelled.columns
    monkeypatch.setattr(cu, "REPEATED", 10 ** 9)
    _, whole = cu.kmeans_auto_k(df, ["a", "b"], ks=(2,))
    assert used[1:] == [None]
    for x, y in zip(table.orderBy("k").collect(), whole.orderBy("k").collect()):
        assert x["chosen"] == y["chosen"] and x["silhouette"] == pytest.approx(y["silhouette"], abs=1e-9)


def test_detection_quality_writes_no_pairs_and_equals_whole_matching(spark, monkeypatch):
    rng = np.random.default_rng(9)
    box = lambda: (float(rng.integers(1, 5)) / 5, 0.5, float(rng.integers(1, 4)) / 5, 0.4 * float(rng.integers(0, 4) > 0))
    place = lambda: (f"i{rng.integers(3)}" if rng.random() > 0.05 else None, int(rng.integers(2)))
    truth = spark.createDataFrame([(*place(), *box()) for _ in range(80)], "image_stem string, class_id int, cx double, cy double, w double, h double")
    # Some predictions share a p_id: they are one, and each row counts at its own score.
    pred = spark.createDataFrame([(*place(), *box(), f"p{rng.integers(70)}", float(rng.integers(9)) / 8) for _ in range(120)], f"{truth.schema.simpleString()[7:-1].replace(':', ' ')}, p_id string, score double")
    kept, plain = [], bx.stored
    monkeypatch.setattr(bx, "stored", lambda df, name: kept.append(name) or plain(df, name))
    rows = lambda df: sorted(map(str, df.collect()))
    got = rows(bx.detection_map(truth, pred))
    assert kept == ["bins"]
    whole = bx._hits(truth, pred, bx.IOU_STEPS, 10 ** 6).collect()
    limits = {(r.image_stem, r.class_id, r.p_id): r.limits for r in whole}
    every = pred.withColumn("bin", F.round(F.col("score") * 1000, 0).cast("int"))
    want = sorted((r.class_id, r.bin, tuple(limits[r.image_stem, r.class_id, r.p_id])) for r in every.collect() if (r.image_stem, r.class_id, r.p_id) in limits)
    found = bx._group_hits(truth, every.drop("label"), bx.IOU_STEPS).collect()
    assert want and sorted((r.class_id, r.bin, tuple(r.limits)) for r in found) == want
    monkeypatch.setattr(bx, "_group_hits", None)
    monkeypatch.setattr(bx, "_match_rounds", lambda pairs: spark.createDataFrame([(*k, v) for k, v in limits.items()], "image_stem string, class_id int, p_id string, limits array<double>"))
    assert rows(bx.detection_map(truth, pred, pair_limit=0)) == got


def test_kmeans_of_many_points_fits_every_k_in_the_same_passes(spark, monkeypatch):
    from datascry.operators import cluster as cu
    rng = np.random.default_rng(6)
    centres = np.array([[0, 0], [9, 0], [0, 9], [30, 30]])
    points = [tuple(map(float, centres[i % 4] + rng.normal(size=2))) for i in range(400)] + [(None, 1.0)]
    df = spark.createDataFrame(points, "a double, b double").repartition(3)
    copies = [df.withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(n)]))) for n in (1, 4)]
    want = [cu.kmeans_auto_k(rows, ["a", "b"], ks=(2, 4))[1].orderBy("k").collect() for rows in copies]
    passes, run = [], cu._in_tasks
    monkeypatch.setattr(cu, "_in_tasks", lambda points, *f: passes.append(points.count()) or run(points, *f))
    monkeypatch.setattr(cu, "MANY_POINTS", 100)
    for rows, plain in zip(copies, want):
        passes.clear()
        labelled, table = cu.kmeans_auto_k(rows, ["a", "b"], ks=(2, 4))
        assert 0 < len(passes) <= cu.ROUNDS + 2 * cu.PICKS + 3 and set(passes) == {401} and labelled.count() == rows.count()
        for x, y in zip(table.orderBy("k").collect(), plain):
            assert x["chosen"] == y["chosen"] and x["silhouette"] == pytest.approx(y["silhouette"], abs=1e-9)
            assert not x["chosen"] or labelled.select("cluster").distinct().count() == x["k"]
