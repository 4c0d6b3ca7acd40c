"""Automatic labels from two engines' readings: what is accepted, what is put aside and why, and the report, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from serialspark.functions import boxes as B
from serialspark.functions import text as X
from serialspark.operators import detections as D
from serialspark.operators import manifests as G
from serialspark.sources import files as S
from serialspark.sources.store import shuffles_dropped

OUTCOMES = ("accepted", "quarantined", "rejected")


def labelled(primary: DataFrame, secondary: DataFrame, images: DataFrame, strict: bool = False) -> DataFrame:
    """Every reading of the primary engine (image_id, det_id, raw, conf, box) with its outcome; images: (image_id, width, height).

    rejected: no serial in the text. quarantined: a label that breaks a rule (violations); with strict that is an error.
    accepted: a label, verified if the secondary engine (image_id, det_id, text, box) reads the same at the same place. Boxes are padded
    and stay inside the image; quality is clear from a confidence of 0.8 on, else blur.
    """
    found = primary.withColumn("c", X.candidate(X.normalized(F.col("raw"), strip_spaces=True)))
    found = found.select("image_id", "det_id", "raw", "conf", *B.CORNERS, "c.text", "c.match_kind").join(images.select("image_id", "width", "height"), "image_id")
    found = D.verified(found, secondary)
    broken = F.when(F.col("text").isNotNull(), G.violations(F.lit("positive"), F.col("text"), F.lit("")))
    sound = F.coalesce(F.size(broken) == 0, F.lit(True))
    if strict:
        broken = F.when(sound, broken).otherwise(F.raise_error(F.concat(F.lit("label "), F.col("det_id").cast("string"), F.lit(": "), F.array_join(broken, ", "))))
    outcome = F.when(F.col("text").isNull(), "rejected").when(F.size("violations") > 0, "quarantined").otherwise("accepted")
    cut = B.padded(B.box(), F.col("width"), F.col("height"))
    return found.select(
        "image_id", "det_id", "raw", "text", "match_kind", F.when(F.col("conf") >= 0.8, "clear").otherwise("blur").alias("quality"), F.round("conf", 4).alias("confidence"),
        "verified", *[c.alias(n) for n, c in zip(B.CORNERS, cut, strict=True)], broken.alias("violations"),
    ).withColumn("outcome", outcome)


def write_labels(rows: DataFrame, path: str) -> dict[str, int]:
    """Writes labelled rows to a folder for each outcome and returns the counts, all in one pass over the rows."""
    seen = Observation()
    counts = [F.count("*").alias("n_raw"), *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES], F.count_if((F.col("outcome") == "accepted") & F.col("verified")).alias("n_verified"), F.count_if((F.col("outcome") == "accepted") & (F.col("quality") == "clear")).alias("n_clear")]
    with shuffles_dropped(rows.sparkSession):
        rows.observe(seen, *counts).write.option("compression", "zstd").partitionBy("outcome").parquet(path)
    return seen.get


def read_labels(like: DataFrame, path: str, outcome: str) -> DataFrame:
    """The labels of one outcome that write_labels wrote."""
    return like.sparkSession.read.schema(like.schema).parquet(path).where(F.col("outcome") == outcome).drop("outcome")


def documents(accepted: DataFrame, images: DataFrame) -> DataFrame:
    """One annotation document (image, json) for each image with accepted labels, regions by id."""
    found = F.array_sort(F.collect_list(F.struct("det_id", *B.CORNERS, "text", "quality", "confidence", "match_kind", "verified")))
    none = lambda kind: F.lit(None).cast(kind)
    # what is the same for all comes in after the shuffle
    region = lambda r: F.struct(
        r["det_id"].alias("id"), F.lit("positive").alias("category"), F.array(*[r[c] for c in B.CORNERS]).alias("bbox"), r["text"].alias("text"), none("array<int>").alias("text_bbox"), none("string").alias("vendor"), *[r[c].alias(c) for c in ("quality", "confidence", "match_kind")],
        none("string").alias("subkind"), none("string").alias("text_visible"), r["verified"].alias("claude_verified"),
    )
    own = accepted.groupBy("image_id").agg(found.alias("found")).join(images, "image_id").withColumn("regions", F.transform("found", region))
    own = own.withColumn("image", F.format_string("img_%d.jpg", "image_id"))
    return own.select("image", S.document_json(image_size=F.array("width", "height")).alias("json"))
