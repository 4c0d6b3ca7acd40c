"""Regions and crop manifests: checks, assignment to splits, sampling weights, synthetic rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialspark import schemas as S
from serialspark.functions import boxes as B


def violations(category: Column, text: Column, visible: Column) -> Column:
    """The names of the rules that a region breaks, in fixed order."""
    text, visible = F.coalesce(text, F.lit("")), F.coalesce(visible, F.lit(""))
    pos = category == "positive"
    rules = [
        ("negative_has_text", (category == "negative") & (text != "")), ("positive_lacks_text", pos & (text == "")), ("positive_not_dummy", pos & (text != "") & ~text.rlike(S.TRUTH_STRICT)),
        ("visible_serial", visible.rlike(S.SERIAL_PARTIAL)), ("visible_digits", visible.rlike("[0-9]{5,}")),
    ]
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules]))


def unsafe(path: Column) -> Column:
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")


def crops(regions: DataFrame, splits: DataFrame, images: DataFrame, require_verified: bool = True, margin: int = 4) -> DataFrame:
    """The crop manifest of regions (image, id, category, text, subkind, confidence, verified, box) whose image has a split and a size.

    Each image's first mapping to a split counts. Boxes are those to cut out.
    """
    first = splits.groupBy("image").agg(F.min_by("split", "ord").alias("split"))
    df = regions.where(~unsafe(F.col("image"))).join(first, "image").join(images, "image")
    if require_verified:
        df = df.where("verified")
    pos = F.col("category") == "positive"
    stem = F.regexp_replace("image", r"\.[^.]*\z", "")
    name = F.format_string("%s_%s%02d.png", stem, F.when(pos, "l").otherwise("n"), F.col("id"))
    cut = B.crop(B.box(), pos, F.col("width"), F.col("height"), margin)
    return df.select(
        F.concat_ws("/", "split", F.when(pos, "real").otherwise("real_neg"), name).alias("filename"), F.when(pos, F.col("text")).otherwise("").alias("text"), "split", stem.alias("source"),
        F.when(pos, F.coalesce("confidence", F.lit(1.0))).otherwise(1.0).alias("confidence"), "category", F.when(pos, "").otherwise(F.coalesce("subkind", F.lit("background"))).alias("subkind"),
        *[c.alias(n) for n, c in zip(B.CORNERS, cut, strict=True)],
    )


def split_counts(manifest: DataFrame) -> DataFrame:
    """Rows by split and category with all totals; null stands for all."""
    return manifest.cube("split", "category").agg(F.count("*").alias("n"))


def counts_of_splits(manifest: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """(split, n, n_pos, n_neg) of the named splits, those without rows too, and of all rows (null)."""
    named = manifest.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    neg = F.col("category") == "negative"
    found = manifest.rollup("split").agg(F.count("*").alias("n"), F.count_if(~neg).alias("n_pos"), F.count_if(neg).alias("n_neg"), F.grouping("split").alias("all"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    own = F.broadcast(named).join(found.where("all = 0"), "split", "left")  # three names
    return own.select("split", zero("n"), zero("n_pos"), zero("n_neg")).unionByName(found.where("all = 1").select(F.lit(None).cast("string").alias("split"), "n", "n_pos", "n_neg"))


def background_library(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """(filename, target) of safe background negatives whose file is present (filename)."""
    df = manifest.where("category = 'negative' and subkind = 'background'").where(~unsafe(F.col("filename")))
    base = F.element_at(F.split("filename", "/"), -1)
    return df.join(present.select("filename").distinct(), "filename", "left_semi").select("filename", F.concat_ws("_", "source", base).alias("target"))


def append_negatives(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New negatives (image_id, ord, box) that overlap no positive and repeat no negative, with ids that go on from the largest."""
    e = existing.select(F.col("image_id").alias("e_image"), "category", F.col("id").alias("e_id"), *[F.col(c).alias("e" + c) for c in B.CORNERS])
    theirs = [F.col("e" + c) for c in B.CORNERS]
    same = [F.col(c) == F.col("e" + c) for c in B.CORNERS]
    kept = new.join(e.where("category = 'positive'"), (F.col("image_id") == F.col("e_image")) & B.overlaps(B.box(), theirs), "left_anti")
    kept = kept.join(e.where("category = 'negative'"), (F.col("image_id") == F.col("e_image")) & same[0] & same[1] & same[2] & same[3], "left_anti")
    top = existing.groupBy("image_id").agg(F.max("id").alias("top"))
    ids = F.coalesce("top", F.lit(-1)) + F.row_number().over(Window.partitionBy("image_id").orderBy("ord"))
    return kept.join(top, "image_id", "left").select("image_id", ids.alias("id"), *B.CORNERS)


def split_leaks(manifest: DataFrame) -> DataFrame:
    """Sources that stand in several splits, and test rows of synthetic sources."""
    several = manifest.groupBy("source").agg(F.count_distinct("split").alias("n_splits"), F.count_if((F.col("split") == "test") & F.startswith("source", F.lit("synth"))).alias("n_synthetic_test"))
    return several.where("n_splits > 1 or n_synthetic_test > 0")


def sampler_weights(manifest: DataFrame, ratio: float) -> DataFrame:
    """manifest with weight, so that negatives make up that share of a weighted draw."""
    sizes = manifest.agg(F.count_if(F.col("category") != "negative").alias("n_pos"), F.count_if(F.col("category") == "negative").alias("n_neg"))
    neg = F.col("category") == "negative"
    out = manifest.crossJoin(F.broadcast(sizes))  # one row
    weight = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), 1.0)
    if ratio <= 0 or ratio >= 1:
        weight = weight.otherwise(F.when(neg == (ratio >= 1), 1.0).otherwise(0.0))
    else:
        weight = weight.otherwise(F.when(neg, ratio / F.col("n_neg")).otherwise((1 - ratio) / F.col("n_pos")))
    return out.withColumn("weight", weight).drop("n_pos", "n_neg")


def uniform(seed: int, *parts: Column) -> Column:
    """A number from 0 up to 1 that depends on the parts alone, however rows are dealt out: 40 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("long") / float(1 << 40)


def weighted_sample(manifest: DataFrame, draws: DataFrame, ratio: float, seed: int = 0, order: str = "filename") -> DataFrame:
    """For each draw (i) a row of the manifest, negative with probability ratio, with replacement.

    Rows get ordinals within their class from counts by hash bucket, so no window spans a class.
    """
    m = manifest.withColumn("neg", F.col("category") == "negative").withColumn("bucket", F.floor(uniform(seed + 2, F.col(order)) * 256))
    counts = m.groupBy("neg", "bucket").count()
    base = counts.withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy("neg").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 512 rows at most
    m = m.withColumn("ordinal", F.row_number().over(Window.partitionBy("neg", "bucket").orderBy(order)) - 1).join(F.broadcast(base.drop("count")), ["neg", "bucket"]).withColumn("ordinal", F.col("base") + F.col("ordinal"))
    total = F.broadcast(counts.groupBy("neg").agg(F.sum("count").alias("total")))
    d = draws.select("i", (uniform(seed, F.col("i")) < ratio).alias("neg")).join(total, "neg").withColumn("ordinal", F.floor(uniform(seed + 1, F.col("i")) * F.col("total")))
    return d.join(m, ["neg", "ordinal"]).select("i", *manifest.columns)


def synthetic_serial(key: Column, seed: int = 0) -> Column:
    return F.format_string("E300MM%06d", F.floor(uniform(seed, key) * 1_000_000).cast("long"))


def synthetic_negative(key: Column, seed: int = 0) -> Column:
    """5 to 15 characters of the alphabet that aren't a serial; one that would be loses its first character."""
    n = F.floor(uniform(seed, key, F.lit("n")) * 11).cast("int") + 5
    char = lambda i: F.substring(F.lit(S.CTC_ALPHABET), F.floor(uniform(seed, key, i) * 36).cast("int") + 1, F.lit(1))
    text = F.array_join(F.transform(F.sequence(F.lit(1), n), char), "")
    return F.when(text.rlike(S.SERIAL_STRICT), F.substring(text, 2, 15)).otherwise(text)


def synthetic_manifest(real: DataFrame, variants: int = 2, other_text: float = 0.5, seed: int = 0) -> DataFrame:
    """For each real row that many replaced texts (positive) or negatives, of which a share shows other text."""
    each = real.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    pos = F.col("category") != "negative"
    key = F.concat_ws("#", "filename", F.col("variant").cast("string"))
    kind = F.when(pos, "").when(F.col("variant") < int(variants * other_text), "other_text").otherwise("background")
    return each.select(F.format_string("synth/%s_%02d.png", F.col("filename"), F.col("variant")).alias("filename"), F.when(pos, synthetic_serial(key, seed)).otherwise("").alias("text"), F.lit("train").alias("split"), F.concat(F.lit("synth_"), "source").alias("source"), F.lit(1.0).alias("confidence"), "category", kind.alias("subkind"))


def scheduled(epochs: DataFrame, schedule: list[tuple[int, float]]) -> DataFrame:
    """epochs with ratio: linear between the schedule's points, its end values beyond them, 0 if it is empty."""
    if len(schedule) > 1000 or any(not 0 <= r <= 1 for _, r in schedule):
        raise ValueError("up to 1000 points with ratios from 0 to 1")
    points = sorted(schedule)
    if not points:
        return epochs.withColumn("ratio", F.lit(0.0))
    e = F.col("epoch")
    ratio = F.when(e <= points[0][0], float(points[0][1]))
    for (a, x), (b, y) in zip(points, points[1:], strict=False):
        ratio = ratio.when(e <= b, x + (y - x) * (e - a) / (b - a) if b > a else float(y))
    return epochs.withColumn("ratio", ratio.otherwise(float(points[-1][1])))


def scheduled_by_table(epochs: DataFrame, points: DataFrame, schedule: str = "schedule", limit: int | None = 1000) -> DataFrame:
    """epochs (schedule, epoch) with ratio from a table of points (schedule, epoch, ratio), as scheduled gives it for each schedule.

    Different epochs and the points are put in one order for each schedule, where the last point before an epoch tells its
    segment; the ratios go back to all rows by schedule and epoch. A schedule without points gives 0; more points than the
    limit, if there is one, or a ratio beyond 0 to 1 is an error.
    """
    at = points.groupBy(schedule, "epoch").agg(F.min("ratio").alias("low"), F.max("ratio").alias("high"), F.count("*").alias("n"))
    by = Window.partitionBy(schedule).orderBy("epoch")
    wrong = (F.col("low") < 0) | (F.col("high") > 1)
    if limit is not None:
        wrong |= F.sum("n").over(Window.partitionBy(schedule)) > limit
    rule = "ratios from 0 to 1" if limit is None else f"up to {limit} points with ratios from 0 to 1"
    at = at.withColumn("low", F.when(wrong, F.raise_error(F.concat(F.lit("schedule "), F.col(schedule).cast("string"), F.lit(f": {rule}")))).otherwise(F.col("low")))
    at = at.select(schedule, "epoch", F.struct(F.col("epoch").alias("a"), "low", "high", F.lead("epoch").over(by).alias("b"), F.lead("low").over(by).alias("next")).alias("s"), F.first("low").over(by).alias("first"))
    wanted = epochs.where(F.col("epoch").isNotNull()).select(schedule, "epoch").distinct()
    both = wanted.withColumn("mine", F.lit(True)).unionByName(at, allowMissingColumns=True)
    upto = Window.partitionBy(schedule).orderBy("epoch").rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("s", F.last("s", ignorenulls=True).over(upto)).withColumn("first", F.max("first").over(Window.partitionBy(schedule))).where("mine")
    e, s = F.col("epoch"), F.col("s")
    slope = s["high"] + (s["next"] - s["high"]) * (e - s["a"]) / (s["b"] - s["a"])
    ratio = F.when(s.isNull(), F.coalesce("first", F.lit(0.0))).when(s["a"] == e, s["low"]).when(s["b"].isNull(), s["high"]).otherwise(slope)
    return epochs.join(both.select(schedule, "epoch", ratio.alias("ratio")), [schedule, "epoch"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))


def append_new(rows: DataFrame, path: str, keys: Sequence[str], part: str) -> None:
    """Adds to a table partitioned by part the rows whose keys it doesn't hold yet.

    The keys are read from the table itself, and the partitions that get rows are written anew as a whole, so a run
    that is repeated, or broke off, leaves what one run leaves.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = rows
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        held = spark.read.schema(rows.schema).parquet(path)
        new = rows.join(held.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)
        fresh = held.join(new.select(part).distinct(), part, "left_semi").select(*rows.columns).unionByName(new)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def label_quality(regions: DataFrame, documents: DataFrame) -> DataFrame:
    """(n_clear, n_blur, engine_seconds): positives by their quality, whatever isn't clear being blurred, and the documents' summed primary engine time (meta)."""
    pos = F.col("category") == "positive"
    seconds = F.coalesce(F.get_json_object(F.col("meta")["ocr_elapsed_sec"], "$.primary").cast("double"), F.lit(0.0))
    counts = regions.agg(F.count_if(pos & (F.col("quality") == "clear")).alias("n_clear"), F.count_if(pos & F.coalesce(F.col("quality") != "clear", F.lit(True))).alias("n_blur"))
    return counts.withColumn("engine_seconds", documents.agg(F.coalesce(F.sum(seconds), F.lit(0.0))).scalar())


def label_report(regions: DataFrame) -> DataFrame:
    """Counts of images, positives, negatives, by confidence and quality; an absent confidence counts as 0."""
    pos, conf = F.col("category") == "positive", F.coalesce("confidence", F.lit(0.0))
    n = lambda c: F.count_if(pos & c)
    out = regions.agg(F.count_distinct("image").alias("n_images"), F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"), n(conf >= 0.95).alias("conf_high"), n((conf >= 0.8) & (conf < 0.95)).alias("conf_mid"), n(conf < 0.8).alias("conf_low"))
    return out.withColumn("per_image", F.col("n_pos") / F.col("n_images")).withColumn("n_clear", F.col("conf_high") + F.col("conf_mid")).withColumn("n_blur", F.col("conf_low"))
