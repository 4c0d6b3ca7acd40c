"""Results of different reading engines in one schema: (engine, image_id, det_id, text, confidence, box), confidence from 0 to 100."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serialspark.functions import boxes as B

RESULT = ("image_id", "det_id", "text", "confidence", *B.CORNERS)


def from_detections(rows: DataFrame) -> DataFrame:
    """An engine that gives a row for each box, with conf from 0 to 1."""
    return rows.select("image_id", "det_id", "text", (F.col("conf") * 100).alias("confidence"), *B.CORNERS)


def from_pages(pages: DataFrame) -> DataFrame:
    """An engine that gives a page for each image: result.words, an array of (text, confidence from 0 to 100, bbox of x0, y0, x1, y1); no words, no rows."""
    words = pages.select("image_id", F.posexplode("result.words").alias("det_id", "w"))
    corner = {"x1": "x0", "y1": "y0", "x2": "x1", "y2": "y1"}
    return words.select("image_id", F.col("det_id").cast("long").alias("det_id"), "w.text", F.col("w.confidence").cast("double").alias("confidence"), *[F.col(f"w.bbox.{corner[c]}").cast("int").alias(c) for c in B.CORNERS])


def results(engines: Mapping[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """The results of named engines, each with its adapter; an adapter that leaves out a column is an error."""
    out = None
    for name, (rows, adapter) in engines.items():
        own = adapter(rows)
        if missing := [c for c in RESULT if c not in own.columns]:
            raise ValueError(f"engine {name!r} gives no {', '.join(missing)}")
        own = own.select(F.lit(name).alias("engine"), *RESULT)
        out = own if out is None else out.unionByName(own)
    return out


def best(found: DataFrame, images: DataFrame, engines: Sequence[str]) -> DataFrame:
    """Each engine's most confident result of each image (image_id), the first of equal ones; nulls where it has none."""
    order = F.struct("confidence", -F.col("det_id"))
    one = found.groupBy("engine", "image_id").agg(F.max_by(F.struct("text", "confidence", *B.CORNERS), order).alias("r"))
    every = images.select("image_id").distinct().withColumn("engine", F.explode(F.array(*[F.lit(e) for e in engines])))
    return every.join(one, ["engine", "image_id"], "left").select("engine", "image_id", "r.*")


def agreement(found: DataFrame) -> DataFrame:
    """Of best's rows: how many images each number of engines reads alike, and the engines' mean confidences there."""
    own = Window.partitionBy("image_id", "text")
    marked = found.where("text is not null").withColumn("alike", F.count("*").over(own))
    return marked.groupBy("engine", "alike").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))
