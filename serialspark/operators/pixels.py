"""Window features, model tensors, pluggable detectors and scorers over image rows, in numpy inside Spark tasks.

An image row is (image_id, width, height, data), data holding pixels row by row: a grey byte each, or blue, green, red
(and alpha) bytes, as the image source gives them. Colour counts by its luminance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def images_of_pixels(pixels: DataFrame) -> DataFrame:
    """Image rows from (image_id, x, y, v)."""
    g = pixels.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"].cast("int")).alias("v"))
    return g.select("image_id", "width", "height", F.to_binary(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), ""), F.lit("hex")).alias("data"))


# The shares of red, green and blue in luminance (ITU-R BT.709).
LUMINANCE = (0.2126, 0.7152, 0.0722)


def grey_of(width: int, height: int, data: bytes) -> np.ndarray:
    """(height, width) of grey values; the number of bytes tells the channels."""
    channels, rest = divmod(len(data), max(1, width * height))
    if rest or channels not in (1, 3, 4):
        raise ValueError(f"{len(data)} bytes for {width} x {height} pixels")
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return pixels[:, :, 0] if channels == 1 else pixels[:, :, 2::-1] @ np.array(LUMINANCE)


def brightness(images: DataFrame) -> DataFrame:
    """(image_id, width, height, luminance): each image's mean."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["image_id", "width", "height"]].assign(luminance=[float(grey_of(w, h, d).mean()) for w, h, d in pdf[["width", "height", "data"]].itertuples(index=False)])

    return images.select("image_id", "width", "height", "data").mapInPandas(measure, "image_id long, width int, height int, luminance double")


def edges(grey: np.ndarray) -> np.ndarray:
    """Sobel magnitudes; 0 on the border."""
    out, g = np.zeros(grey.shape), grey.astype(float)
    if min(g.shape) > 2:
        dx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
        dy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
        out[1:-1, 1:-1] = np.sqrt(dx * dx + dy * dy)
    return out


def summed(a: np.ndarray) -> np.ndarray:
    out = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    np.cumsum(np.cumsum(a, axis=0), axis=1, out=out[1:, 1:])
    return out


def variances(grey: np.ndarray, k: int = 5) -> np.ndarray:
    """Variance in the k x k square around each pixel, of the part inside the image."""
    h, w = grey.shape
    y0, y1 = np.maximum(np.arange(h) - k // 2, 0)[:, None], np.minimum(np.arange(h) + k // 2 + 1, h)[:, None]
    x0, x1 = np.maximum(np.arange(w) - k // 2, 0)[None], np.minimum(np.arange(w) + k // 2 + 1, w)[None]
    part = lambda s: s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0]
    n, g = (y1 - y0) * (x1 - x0), grey.astype(float)
    mean = part(summed(g)) / n
    return np.maximum(part(summed(g * g)) / n - mean * mean, 0)


def window_features(images: DataFrame, windows: DataFrame, k: int = 5) -> DataFrame:
    """windows (image_id, box) with edge_mean and var_mean, the maps made once for each image; 0 for an empty box."""
    boxes = windows.groupBy("image_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("boxes"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for image_id, w, h, data, own in pdf[["image_id", "width", "height", "data", "boxes"]].itertuples(index=False):
                grey = grey_of(w, h, data)
                maps = [summed(edges(grey)), summed(variances(grey, k))]
                for b in own:
                    x1, x2 = (min(max(int(b[c]), 0), w) for c in ("x1", "x2"))
                    y1, y2 = (min(max(int(b[c]), 0), h) for c in ("y1", "y2"))
                    n = max(x2 - x1, 0) * max(y2 - y1, 0)
                    means = [(s[y2, x2] - s[y1, x2] - s[y2, x1] + s[y1, x1]) / n if n else 0.0 for s in maps]
                    rows.append((image_id, b["x1"], b["y1"], b["x2"], b["y2"], *means))
            yield pd.DataFrame(rows, columns=["image_id", "x1", "y1", "x2", "y2", "edge_mean", "var_mean"])

    return images.join(boxes, "image_id").mapInPandas(measure, "image_id long, x1 int, y1 int, x2 int, y2 int, edge_mean double, var_mean double")


def prefilter(features: DataFrame, edge: float | None = 30.0, variance: float | None = 100.0) -> DataFrame:
    out = features if edge is None else features.where(F.col("edge_mean") >= edge)
    return out if variance is None else out.where(F.col("var_mean") >= variance)


#: What a task holds of tensors at once.
TENSOR_BYTES = 4_000_000


def crop_tensors(images: DataFrame, windows: DataFrame, width: int = 128, height: int = 32) -> DataFrame:
    """windows with tensor: the part of the image as height x width floats from -1 to 1, by area means. A task holds some MB of them at once."""
    boxes = windows.groupBy("image_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("boxes"))
    names, held = ["image_id", "x1", "y1", "x2", "y2", "tensor"], max(1, TENSOR_BYTES // (4 * width * height))

    def packed(ids: list[int], corners: list[np.ndarray], tensors: list[np.ndarray]) -> pa.RecordBatch:
        at, flat = np.concatenate(corners), np.concatenate(tensors).reshape(-1)
        ends = np.arange(len(at) + 1, dtype=np.int32) * (width * height)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(c) for c in corners]), pa.int64()), *[pa.array(at[:, i], pa.int32()) for i in range(4)], pa.ListArray.from_arrays(ends, flat)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, corners, tensors, n = [], [], [], 0
            for i in range(len(batch)):
                own = batch["boxes"].slice(i, 1).flatten()
                own = np.stack([own.field(c).to_numpy() for c in names[1:5]], axis=1)
                total = summed(grey_of(*(batch[c][i].as_py() for c in ("width", "height", "data"))).astype(float))
                for lo in range(0, len(own), held):
                    ids.append(batch["image_id"][i].as_py())
                    corners.append(own[lo : lo + held])
                    tensors.append(tensors_of(total, corners[-1], width, height))
                    n += len(corners[-1])
                    if n >= held:
                        yield packed(ids, corners, tensors)
                        ids, corners, tensors, n = [], [], [], 0
            if n:
                yield packed(ids, corners, tensors)

    rows = images.join(boxes, "image_id").select(F.col("image_id").cast("long").alias("image_id"), "width", "height", "data", "boxes")
    return _over_tasks(rows).mapInArrow(cut, "image_id long, x1 int, y1 int, x2 int, y2 int, tensor array<float>")


def detect(images: DataFrame, detector: Callable[[np.ndarray], list[tuple[int, int, int, int]]]) -> DataFrame:
    """(image_id, box) of what a detector, a function from grey pixels to boxes, finds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *map(int, b)) for i, w, h, d in pdf[["image_id", "width", "height", "data"]].itertuples(index=False) for b in detector(grey_of(w, h, d))]
            yield pd.DataFrame(rows, columns=["image_id", "x1", "y1", "x2", "y2"])

    return images.mapInPandas(run, "image_id long, x1 int, y1 int, x2 int, y2 int")


def score(tensors: DataFrame, make_scorer: Callable, shape: tuple[int, ...] = (32, 128), batch_size: int = 64) -> DataFrame:
    """tensors with score from a model that make_scorer loads once in each worker: a function from (n, *shape) to n floats."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import FloatType

    udf = predict_batch_udf(make_scorer, return_type=FloatType(), batch_size=batch_size, input_tensor_shapes=[list(shape)])
    return tensors.withColumn("score", udf("tensor"))


def logits(tensors: DataFrame, make_scorer: Callable, shape: tuple[int, ...] = (32, 128), batch_size: int = 64) -> DataFrame:
    """tensors with logits, the flat row-major scores of a model that make_scorer loads once in each worker: a function from (n, *shape) to (n, steps, classes)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    def make():
        scorer = make_scorer()
        return lambda batch: np.asarray(scorer(batch), np.float32).reshape(len(batch), -1)

    udf = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[list(shape)])
    return tensors.withColumn("logits", udf("tensor"))


def grid(width: int, height: int, size: tuple[int, int], stride: tuple[int, int]) -> np.ndarray:
    """(n, 4) windows of that size: the grid, then the right column and the bottom row where the grid leaves a rest."""
    (ww, wh), (sx, sy) = size, stride
    if width < ww or height < wh:
        return np.zeros((0, 4), int)
    xs, ys = np.arange(0, width - ww + 1, sx), np.arange(0, height - wh + 1, sy)
    at = [np.stack(np.meshgrid(xs, ys), axis=-1).reshape(-1, 2)]
    if (width - ww) % sx:
        at.append(np.stack([np.full(len(ys), width - ww), ys], axis=1))
    if (height - wh) % sy:
        at.append(np.stack([xs, np.full(len(xs), height - wh)], axis=1))
    at = np.concatenate(at)
    return np.concatenate([at, at + [ww, wh]], axis=1)


def windows_of(width: int, height: int, size: tuple[int, int], stride: tuple[int, int], scales: Sequence[float], most_side: int = 1024, limit: int = 20000) -> np.ndarray:
    """The windows of detections.sliding_windows for one image, in the order of the scales."""
    k = min(1.0, most_side / max(width, height))
    half_up = lambda x: np.floor(np.asarray(x) + 0.5).astype(int)
    found = [grid(int(half_up(width * k)), int(half_up(height * k)), (round(size[0] * s), round(size[1] * s)), stride) for s in scales]
    if max(map(len, found), default=0) > limit:
        raise ValueError(f"{max(map(len, found))} windows in one image")
    return half_up(np.concatenate(found) / k)


def best_overlaps(boxes: np.ndarray, truths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(boxes, truths) matrices of intersection over union, and of the share of the truth inside the box."""
    side = np.minimum(boxes[:, None, 2:], truths[None, :, 2:]) - np.maximum(boxes[:, None, :2], truths[None, :, :2])
    inter = np.maximum(side, 0).prod(axis=2).astype(float)
    area = lambda b: (b[:, 2:] - b[:, :2]).prod(axis=1).astype(float)
    union, own = area(boxes)[:, None] + area(truths)[None] - inter, np.broadcast_to(area(truths), inter.shape)
    share = lambda of: np.divide(inter, of, out=np.zeros_like(inter), where=of > 0)
    return share(union), share(own)


def box_means(total: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Means of a summed map over boxes inside it; 0 for an empty box."""
    h, w = total.shape[0] - 1, total.shape[1] - 1
    x1, x2, y1, y2 = (boxes[:, c].clip(0, m) for c, m in ((0, w), (2, w), (1, h), (3, h)))
    n = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
    sums = total[y2, x2] - total[y1, x2] - total[y2, x1] + total[y1, x1]
    return np.divide(sums, n, out=np.zeros(len(boxes)), where=n > 0)


def tensors_of(total: np.ndarray, boxes: Sequence[Sequence[int]], width: int = 128, height: int = 32) -> np.ndarray:
    """(n, height, width) area means of n boxes in a summed grey image, from -1 to 1."""
    h, w, boxes = total.shape[0] - 1, total.shape[1] - 1, np.asarray(boxes).reshape(-1, 4)
    xs, ys = np.linspace(boxes[:, 0], boxes[:, 2], width + 1, axis=1).clip(0, w), np.linspace(boxes[:, 1], boxes[:, 3], height + 1, axis=1).clip(0, h)
    y0, x0 = np.minimum(ys.astype(int), h - 1), np.minimum(xs.astype(int), w - 1)
    dy, dx = (ys - y0)[:, :, None], (xs - x0)[:, None]
    rows = total[y0] * (1 - dy) + total[y0 + 1] * dy
    at = np.take_along_axis(rows, x0[:, None], axis=2) * (1 - dx) + np.take_along_axis(rows, x0[:, None] + 1, axis=2) * dx
    n = np.diff(ys, axis=1)[:, :, None] * np.diff(xs, axis=1)[:, None]
    sums = at[:, 1:, 1:] - at[:, :-1, 1:] - at[:, 1:, :-1] + at[:, :-1, :-1]
    return (np.divide(sums, n, out=np.zeros_like(sums), where=n > 0) / 127.5 - 1).astype(np.float32)


def tensor_of(total: np.ndarray, box: Sequence[int], width: int = 128, height: int = 32) -> np.ndarray:
    """(height, width) area means of the box in a summed grey image, from -1 to 1."""
    return tensors_of(total, [box], width, height)[0]


def _over_tasks(rows: DataFrame) -> DataFrame:
    """rows dealt to as many tasks as shuffles have: few bytes make much work here, and Spark joins small partitions by their bytes.

    The hash makes it a partitioning of its own; one by the bare id is that of the join before, and Spark would leave it out.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("image_id"))


SUMMARY = ("n", "min", "p25", "p50", "p75", "max", "mean")
_SUMMARY = "struct<n: long, min: double, p25: double, p50: double, p75: double, max: double, mean: double>"
DIAGNOSIS = f"""image_id long, n_windows int,
  classes array<struct<class: string, n: long, n_passed: long, n_matched: long, n_high: long, n_nonempty: long, conf_sum: double, edge: {_SUMMARY}, var: {_SUMMARY},
    samples array<struct<text: string, conf: double, x1: int, y1: int, x2: int, y2: int>>>>,
  truths array<struct<gt_id: long, best_iou: double, best_containment: double, recognised: boolean>>"""


def _summary(values: np.ndarray) -> dict | None:
    if not len(values):
        return None
    quarters = np.percentile(values, [0, 25, 50, 75, 100])
    return dict(zip(SUMMARY, (len(values), *map(float, quarters), float(values.mean())), strict=True))


def diagnose(images: DataFrame, truth: DataFrame, make_reader: Callable, pattern: str, size: tuple[int, int] = (128, 32), stride: tuple[int, int] = (32, 16), scales: Sequence[float] = (1.0,), edge: float | None = 30.0, variance: float | None = 100.0, threshold: float = 0.3, confident: float = 0.5, samples: int = 5, k: int = 7, batch_size: int = 64) -> DataFrame:
    """What a detector by windows does to each image, in one pass over it; no window leaves its task.

    images (image_id, width, height, data), truth (image_id, gt_id, category, box). For each image the maps of edges and
    variances are summed once, its windows are made, measured, classed by their best overlap with the truth (pos, neg
    or undef), and gated by edge and variance; those that pass are cut and read in batches by what make_reader loads once in a task,
    a function from (n, 32, 128) to texts and confidences. Others count as empty readings of confidence 0. A row has the counts
    and distributions of each class, its most confident samples whose text matches the pattern, and of each positive truth box
    the best overlap and whether a confident reading that matches covers it. Images without truth have classes alone.
    """
    import re

    boxes = truth.groupBy("image_id").agg(F.collect_list(F.struct("gt_id", "category", "x1", "y1", "x2", "y2")).alias("truth"))
    joined = images.select("image_id", "width", "height", "data").join(boxes, "image_id", "left")
    matches = re.compile(pattern.replace("\\z", "\\Z")).search

    def one(reader, image_id: int, w: int, h: int, data: bytes, truth) -> tuple:
        grey = grey_of(w, h, data).astype(float)
        windows = windows_of(w, h, size, stride, scales)
        edge_mean, var_mean = box_means(summed(edges(grey)), windows), box_means(summed(variances(grey, k)), windows)
        passed = np.ones(len(windows), bool) if edge is None else edge_mean >= edge
        passed &= True if variance is None else var_mean >= variance
        truth = sorted(truth if truth is not None else (), key=lambda t: t["gt_id"])
        corners = np.array([[t[c] for c in ("x1", "y1", "x2", "y2")] for t in truth], int).reshape(-1, 4)
        positive = np.array([t["category"] == "positive" for t in truth], bool)
        iou, inside = best_overlaps(windows, corners)
        pos, neg = iou[:, positive].max(axis=1, initial=0), iou[:, ~positive].max(axis=1, initial=0)
        kind = np.where((pos >= threshold) & (pos >= neg), "pos", np.where(neg >= threshold, "neg", "undef"))
        texts, confs, total = np.full(len(windows), "", object), np.zeros(len(windows)), summed(grey)
        at = np.flatnonzero(passed)
        for lo in range(0, len(at), batch_size):
            own = at[lo : lo + batch_size]
            texts[own], confs[own] = reader(tensors_of(total, windows[own]))
        matched = np.array([bool(matches(t)) for t in texts], bool)
        high = matched & (confs >= confident)
        classes = []
        for c in ("pos", "neg", "undef"):
            own = np.flatnonzero(kind == c)
            best = own[matched[own]]
            best = best[np.lexsort((best, -confs[best]))][:samples]
            shown = [{"text": texts[i], "conf": float(confs[i]), **dict(zip(("x1", "y1", "x2", "y2"), windows[i].tolist(), strict=True))} for i in best]
            counts = {"n": len(own), "n_passed": int(passed[own].sum()), "n_matched": int(matched[own].sum()), "n_high": int(high[own].sum()), "n_nonempty": int((texts[own] != "").sum()), "conf_sum": float(confs[own].sum())}
            classes.append({"class": c, **counts, "edge": _summary(edge_mean[own]), "var": _summary(var_mean[own]), "samples": shown})
        truths = []
        for j in np.flatnonzero(positive):
            read = bool((high & (iou[:, j] >= 0.3)).any())
            truths.append({"gt_id": truth[j]["gt_id"], "best_iou": float(iou[:, j].max(initial=0)), "best_containment": float(inside[:, j].max(initial=0)), "recognised": read})
        return image_id, len(windows), classes, truths

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make_reader()
        for pdf in batches:
            rows = [one(reader, *r) for r in pdf[["image_id", "width", "height", "data", "truth"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["image_id", "n_windows", "classes", "truths"])

    return _over_tasks(joined).mapInPandas(run, DIAGNOSIS)


def class_stats(diagnosed: DataFrame) -> DataFrame:
    """Counts of each image and class, and of each class over all images (null image_id)."""
    rows = diagnosed.select("image_id", F.explode("classes").alias("c")).select("image_id", "c.*")
    return rows.groupingSets([["image_id", "class"], ["class"]], "image_id", "class").agg(*[F.sum(c).alias(c) for c in ("n", "n_passed", "n_matched", "n_high", "n_nonempty", "conf_sum")])


def class_samples(diagnosed: DataFrame, most: int = 5) -> DataFrame:
    """The most confident matching readings of each class over all images, each image's own best being all that is looked at."""
    rows = diagnosed.select("image_id", F.explode("classes").alias("c")).select("image_id", "c.class", F.explode("c.samples").alias("s")).select("image_id", "class", "s.*")
    order = [F.desc("conf"), F.asc("image_id"), F.asc("x1"), F.asc("y1")]
    part = rows.withColumn("part", F.pmod(F.xxhash64("image_id"), F.lit(256)))
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("class", "part").orderBy(*order))).where(F.col("r") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(*order))).where(F.col("rank") <= most).select("class", "rank", "image_id", "text", "conf", "x1", "y1")


def truth_coverage(diagnosed: DataFrame) -> DataFrame:
    """detections.coverage's rows, for detections.coverage_summary."""
    out = diagnosed.select("image_id", F.explode("truths").alias("t")).select("image_id", "t.*")
    for t in (0.3, 0.5, 0.7):
        out = out.withColumn(f"covered_{int(t * 10)}", F.col("best_iou") >= t)
    return out.withColumn("contained_9", F.col("best_containment") >= 0.9)


def sharp_frames(frames: DataFrame, interval: int, least: float = 100.0) -> DataFrame:
    """Of image rows with ord every interval-th whose Laplacian varies by more than the least, with sharpness."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, h, d in pdf[["width", "height", "data"]].itertuples(index=False):
                g = grey_of(w, h, d).astype(float)
                lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
                out.append(max(float((lap * lap).mean() - lap.mean() ** 2), 0.0) if lap.size else 0.0)
            yield pdf[["image_id"]].assign(sharpness=out)

    picked = frames.where(F.col("ord") % interval == 0)
    return picked.select("image_id", "width", "height", "data").mapInPandas(measure, "image_id long, sharpness double").where(F.col("sharpness") > least)
