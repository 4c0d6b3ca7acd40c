"""Operators whose keys may hold any share of the rows: same results as plain Python, and rows spread over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from serialspark.functions import boxes as B
from serialspark.operators import detections as D
from serialspark.operators import pixels as P
from serialspark.sources import store

BOX = "image_id long, x1 int, y1 int, x2 int, y2 int"


def most_in_a_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def most_in_a_file(df):
    """Of a stored table, the rows that one task wrote at most."""
    return max(r["count"] for r in df.groupBy(F.input_file_name()).count().collect())


def test_percentiles_of_hot_keys(spark, monkeypatch, uncoalesced):
    kept = []
    monkeypatch.setattr(D, "stored", lambda df, name: kept.append(store.stored(df, name)) or kept[-1])
    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") * 7919 % 30_011) / 7).alias("v"))
    rows = df.toPandas()
    out = {r.k: r for r in D.percentiles(df, "v", "k").collect()}
    assert set(out) == set(rows.k)
    for k, own in rows.dropna().groupby("k").v:
        np.testing.assert_allclose([out[k][c] for c in ("n", "min", "p25", "p50", "p75", "max", "mean")], [len(own), *np.percentile(own, [0, 25, 50, 75, 100])[:4], own.max(), own.mean()], rtol=1e-12)
    assert most_in_a_file(kept[0]) < 0.5 * kept[0].count()
    few = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 1.0), ("c", 1.0), (None, 5.0)], "k string, v double")
    assert {(r.k, r.n, r.p25, r.p50, r.p75) for r in D.percentiles(few.where("k is not null"), "v", "k").collect()} == {("a", 1, 2.0, 2.0, 2.0), ("c", 2, 1.0, 1.0, 1.0)}
    assert D.percentiles(few.limit(0), "v", "k").count() == 0


def boxes(n, wide, seed, image=1):
    rng = np.random.default_rng(seed)
    at, size = rng.integers(-50, wide, (n, 2)), rng.integers(1, 120, (n, 2))
    return [(image, *map(int, (*a, *(a + s)))) for a, s in zip(at, size, strict=True)]


@pytest.mark.parametrize("cell", [64, 256, 5000])
def test_windows_of_a_hot_image(spark, cell):
    windows = spark.createDataFrame(list(dict.fromkeys(boxes(1500, 3000, 1) + boxes(20, 300, 2, 2))) + [(3, 0, 0, 9, 9)], BOX)
    truth = spark.createDataFrame([(*b, i, "negative" if i % 3 == 0 else "positive") for i, b in enumerate(boxes(300, 3000, 3) + boxes(5, 300, 4, 2))], f"{BOX}, gt_id long, category string")
    w, t = windows.toPandas(), truth.toPandas()
    expected = {}
    for r in w.itertuples(index=False):
        own = t[t.image_id == r.image_id]
        iou, _ = P.best_overlaps(np.array([r[1:5]]), own[["x1", "y1", "x2", "y2"]].to_numpy())
        pos, neg = (iou[0][(own.category == c).to_numpy()].max(initial=0) for c in ("positive", "negative"))
        expected[tuple(r[:5])] = ("pos" if pos >= 0.1 and pos >= neg else "neg" if neg >= 0.1 else "undef", max(pos, neg))
    got = {tuple(r)[:5]: (r["class"], r.best_iou) for r in D.classify_windows(windows, truth, 0.1, cell).collect()}
    assert got.keys() == expected.keys() and all(got[k][0] == c and abs(got[k][1] - v) < 1e-12 for k, (c, v) in expected.items())
    read = windows.withColumns({"matched": F.lit(True), "conf": F.lit(0.9)})
    covered = {r.gt_id: r.best_iou for r in D.coverage(truth, read, cell=cell).collect()}
    iou, _ = P.best_overlaps(w[["x1", "y1", "x2", "y2"]].to_numpy(), t[["x1", "y1", "x2", "y2"]].to_numpy())
    same = w.image_id.to_numpy()[:, None] == t.image_id.to_numpy()[None]
    for j in np.flatnonzero((t.category == "positive").to_numpy()):
        assert abs(covered[int(t.gt_id[j])] - (iou * same)[:, j].max()) < 1e-12


def test_a_hot_image_is_spread(spark):
    windows = spark.range(60_000).select(F.lit(1).cast("long").alias("image_id"), *[((F.col("id") * k % 20_000) + add).cast("int").alias(c) for c, k, add in (("x1", 7919, 0), ("y1", 104_729, 0), ("x2", 7919, 100), ("y2", 104_729, 100))])
    in_cells = D._in_cells(windows, D.CORNERS, D.CELL).repartition(16, "image_id", "cell_x", "cell_y")
    assert most_in_a_task(in_cells) < 2 * in_cells.count() / 16


def fold(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if not kept or not D._meets(np.array([k[4:] for k in kept], float), np.array(r[4:], float), threshold).any():
            kept.append(r)
    return sorted(r[1] for r in kept)


@pytest.mark.parametrize(("tile", "wide"), [(64, 600), (200, 2000), (4096, 600)])
def test_suppression_by_tiles(spark, tile, wide):
    rng = np.random.default_rng(tile)
    rows = [(1, i, "t", float(rng.integers(0, 50)) / 50, *b[1:]) for i, b in enumerate(boxes(1200, wide, 7))]
    # a chain over many tiles, each link of which hangs on the one before
    rows += [(1, 5000 + i, "t", 0.5 - i / 1000, 5000 + 40 * i, 0, 5100 + 40 * i, 10) for i in range(60)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, text string, conf double, x1 int, y1 int, x2 int, y2 int")
    out = D.nms_tiled(df, 0.3, tile=tile)
    assert set(out.columns) == set(df.columns) and sorted(r.det_id for r in out.collect()) == fold(rows, 0.3)
    assert D.nms_tiled(df.limit(0)).count() == 0


def test_tiles_spread_one_key(spark, monkeypatch, uncoalesced):
    kept = []
    monkeypatch.setattr(D, "stored", lambda df, name: kept.append(store.stored(df, name)) or kept[-1])
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("det_id"), F.lit("t").alias("text"), (F.col("id") % 97 / 97).alias("conf"), *[((F.col("id") * k % 9973) * 3 + add).cast("int").alias(c) for c, k, add in (("x1", 7919, 0), ("y1", 104_729, 0), ("x2", 7919, 50), ("y2", 104_729, 50))])
    got = sorted(r.det_id for r in D.nms_tiled(df).collect())
    assert got == sorted(r.det_id for r in D.nms_streamed(df).collect()) and most_in_a_file(kept[0]) < 0.6 * kept[0].count()


@pytest.mark.parametrize(("width", "height", "scales"), [(300, 100, (1.0,)), (131, 35, (1.0, 0.5)), (2500, 700, (0.5, 1.0, 2.0)), (40, 10, (1.0,))])
def test_windows_in_a_task_are_those_of_the_operator(spark, width, height, scales):
    df = spark.createDataFrame([(1, width, height)], "image_id long, width int, height int")
    expected = sorted(tuple(r)[1:] for r in D.sliding_windows(df, scales=scales).collect())
    assert sorted(map(tuple, P.windows_of(width, height, (128, 32), (32, 16), scales).tolist())) == expected


def test_diagnosis_of_images_with_and_without_truth(spark):
    grey = np.full((32, 160), 20, np.uint8)
    grey[:, 16:80:4] = 220
    images = spark.createDataFrame([(i, 160, 32, np.repeat(grey[:, :, None], 3, axis=2).tobytes()) for i in (1, 2)] + [(3, 5, 5, bytes(25))], "image_id long, width int, height int, data binary")
    truth = spark.createDataFrame([(1, 7, "positive", 16, 0, 80, 32), (1, 8, "negative", 96, 0, 160, 32), (1, 9, "positive", 0, 0, 0, 0)], "image_id long, gt_id long, category string, x1 int, y1 int, x2 int, y2 int")
    reader = lambda: lambda batch: (["E300MM000001"] * len(batch), np.full(len(batch), 0.75))
    out = {r.image_id: r for r in P.diagnose(images, truth, reader, "^E300MM[0-9]{6}\\z", (64, 32), (16, 16)).collect()}
    classes = {c["class"]: c for c in out[1].classes}
    assert out[1].n_windows == 7 and sum(c.n for c in classes.values()) == 7 and classes["pos"].n_high == classes["pos"].n_passed > 0
    assert [(t.gt_id, t.best_iou, t.recognised) for t in out[1].truths] == [(7, 1.0, True), (9, 0.0, False)]
    assert len(classes["pos"].samples) == min(5, classes["pos"].n_matched) and classes["pos"].edge.max >= classes["pos"].edge.p75
    assert not out[2].truths and [c.n for c in out[2].classes] == [0, 0, 7] and out[3].n_windows == 0
    with pytest.raises(Exception, match="windows in one image"):
        P.windows_of(4000, 4000, (2, 2), (1, 1), (1.0,))


def test_scores_as_arrays(spark):
    tensors = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0]) for i in range(5)], "image_id long, tensor array<float>")
    make = lambda: lambda batch: np.stack([batch, 2 * batch], axis=1)
    assert {r.image_id: list(r.logits) for r in P.logits(tensors, make, (4,), 2).collect()} == {i: [i, 1, 2, 3, 2 * i, 2, 4, 6] for i in range(5)}


def test_boxes_that_share_an_edge_do_not_meet(spark):
    df = spark.createDataFrame([(1, 0, 0, 10, 10)], BOX)
    other = spark.createDataFrame([(1, 10, 0, 20, 10)], "o_image long, gx1 int, gy1 int, gx2 int, gy2 int")
    assert D.overlapping(df, other, ["gx1", "gy1", "gx2", "gy2"]).count() == 0 and df.select(B.iou(B.box(), B.box()).alias("i")).first().i == 1.0


@pytest.mark.parametrize("most", [1000, 20])
def test_sliding_windows_with_their_truth(spark, most):
    """Truth that travels with its image, and images with more of it than may travel, give what the joins by squares give."""
    images = spark.createDataFrame([(1, 900, 500), (2, 300, 200), (3, 200, 90), (4, 50, 20)], "image_id long, width int, height int")
    truth = spark.createDataFrame([(*b, i, "negative" if i % 3 == 0 else "positive") for i, b in enumerate(boxes(60, 900, 3) + boxes(5, 300, 4, 2) + boxes(2, 50, 5, 4))], f"{BOX}, gt_id long, category string")
    read = lambda w: w.withColumns({"matched": F.col("x1") % 64 == 0, "conf": F.lit(0.9)})
    windows = D.sliding_windows(images)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(D.classify_sliding(images, truth, most=most)) == rows(D.classify_windows(windows, truth))
    assert rows(D.coverage_sliding(images, truth, read, most=most)) == rows(D.coverage(truth, read(windows)))


def test_generated_rows_are_not_broadcast(spark):
    images = spark.range(10).select(F.col("id").alias("image_id"), F.lit(400).alias("width"), F.lit(300).alias("height"))
    truth = images.select("image_id", *[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (0, 0, 90, 30), strict=True)], F.col("image_id").alias("gt_id"), F.lit("positive").alias("category"))
    read = D.sliding_windows(images).withColumns({"matched": F.lit(True), "conf": F.lit(0.9)})
    for df in (D.classify_windows(read, truth), D.coverage(truth, read)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_windows_are_generated_without_arrays_of_them(spark):
    """Only an image's columns and rows are arrays; places meet by two generators, with and without the corner that both miss."""
    df = spark.createDataFrame([(1, 150, 40), (2, 128, 40), (3, 150, 32), (4, 128, 32)], "image_id long, width int, height int")
    for corner, n in ((False, [3, 2, 2, 1]), (True, [4, 2, 2, 1])):
        out = D.sliding_windows(df, corner=corner, keep=("width",))
        assert [r["count"] for r in out.groupBy("image_id").count().orderBy("image_id").collect()] == n and out.where("x2 > width").count() == 0
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "transform(" not in plan and "flatten(" not in plan and plan.count("Generate explode") == 2


def test_tiles_of_many_small_keys(spark):
    """Small keys are settled side by side; rows whose text is missing are a key too."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        n = 90 if k % 50 == 7 else int(rng.integers(1, 14))  # some keys are beyond what is settled side by side
        rows += [(k, 1000 * k + i, None if k % 9 == 0 else "t", float(rng.integers(0, 20)) / 20, *b[1:]) for i, b in enumerate(boxes(n, 160, k))]
    df = spark.createDataFrame(rows, "image_id long, det_id long, text string, conf double, x1 int, y1 int, x2 int, y2 int")
    expected = sorted(i for k in range(400) for i in fold([r for r in rows if r[0] == k], 0.2))
    assert sorted(r.det_id for r in D.nms_tiled(df, 0.2, tile=150).collect()) == expected
