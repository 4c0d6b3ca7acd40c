"""Annotation documents, crop manifests and images as sources and sinks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serialspark import schemas as S
from serialspark.sources.store import shuffles_dropped


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row of JSON text (json) for each file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def parse_annotations(documents: DataFrame, json: str = "json", extra: bool = False) -> DataFrame:
    """Documents of either generation as (image, image_size, source_video, vendor, schema_version, regions, meta).

    Old labels become positive regions: quality by is_clear (clear if absent), vendor from the image. Only the known
    meta keys are kept. A document without regions and labels, image or size raises an error. With extra a column of that
    name has each region's fields that the schema doesn't know, as maps of texts at the regions' places.
    """
    d = F.from_json(F.col(json), S.DOCUMENT)
    upgraded = F.transform(
        F.col("d.labels"),
        lambda x: F.struct(x["id"].alias("id"), F.lit("positive").alias("category"), x["bbox"].alias("bbox"), x["text"].alias("text"), x["text_bbox"].alias("text_bbox"), F.col("d.vendor").alias("vendor"), F.when(F.coalesce(x["is_clear"], F.lit(True)), "clear").otherwise("blur").alias("quality"), x["confidence"].alias("confidence"), x["match_kind"].alias("match_kind"), F.lit(None).cast("string").alias("subkind"), F.lit(None).cast("string").alias("text_visible"), x["claude_verified"].alias("claude_verified")),
    )
    meta = F.map_filter(F.from_json(F.col(json), "map<string,string>"), lambda k, v: k.isin(*S.META_KEYS))
    out = documents.withColumn("d", d).withColumn("regions", F.coalesce("d.regions", upgraded)).withColumn("meta", meta)
    sound = F.col("d.image").isNotNull() & F.col("d.image_size").isNotNull() & F.col("regions").isNotNull()
    version = F.coalesce("d.schema_version", F.when(F.col("d.labels").isNotNull(), 1).otherwise(2))
    more = [_unknown(json).alias("extra")] if extra else []
    return out.select(F.when(sound, F.col("d.image")).otherwise(F.raise_error(F.lit("an annotation needs image, image_size and regions or labels"))).alias("image"), "d.image_size", "d.source_video", "d.vendor", version.alias("schema_version"), "regions", "meta", *more)


def _unknown(json: str) -> Column:
    """Of each region the fields that the schema doesn't know; no regions, no maps."""
    whole = F.from_json(F.col(json), "regions array<map<string,string>>")["regions"]
    return F.coalesce(F.transform(whole, lambda r: F.map_filter(r, lambda k, v: ~k.isin(*S.REGION_FIELDS))), F.array().cast("array<map<string,string>>"))


def regions_of(parsed: DataFrame) -> DataFrame:
    """One row for each region of parsed documents, with extra where they were parsed with it.

    Spark would test for regions before it makes rows of them, and read the JSON again for each test, so documents without regions go after.
    """
    own = ["extra"] if "extra" in parsed.columns else []
    rows = lambda c, to: parsed.select("image", "schema_version", F.posexplode_outer(c).alias("at", to)).where("at is not null")
    r = rows(F.arrays_zip("regions", "extra"), "z").select("image", "schema_version", "z.extra", F.col("z.regions").alias("r")) if own else rows("regions", "r")
    return r.select("image", "schema_version", *own, "r.id", "r.category", "r.text", "r.vendor", "r.quality", "r.confidence", "r.subkind", "r.text_visible", F.coalesce("r.claude_verified", F.lit(False)).alias("verified"), *[F.element_at("r.bbox", i + 1).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def extras(documents: DataFrame, json: str = "json") -> DataFrame:
    """(image, id, extra): the region fields that the schema doesn't know, as a map of texts."""
    whole = F.from_json(F.col(json), "image string, regions array<map<string,string>>")
    r = documents.select(whole.alias("d")).select("d.image", F.explode("d.regions").alias("r"))
    return r.select("image", F.col("r")["id"].cast("long").alias("id"), F.map_filter("r", lambda k, v: ~k.isin(*S.REGION_FIELDS)).alias("extra"))


def with_extra(documents: DataFrame, extra: DataFrame, json: str = "json") -> DataFrame:
    """documents (image, json) whose regions carry their extra fields again, from (image, id, extra) maps of texts.

    Fields of the schema are never overridden. An extra field comes back as a text.
    """
    whole = documents.select("image", F.from_json(json, "map<string,string>").alias("head"), F.explode(_written(json)).alias("r"))
    keyed = whole.withColumn("id", F.col("r")["id"].cast("long")).join(extra, ["image", "id"], "left")
    regions = keyed.groupBy("image").agg(F.first("head").alias("head"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", _region_text(F.col("r"), F.col("extra")).alias("t")))), lambda s: s["t"]), ",").alias("regions"))
    return regions.select("image", _document_text(F.col("head"), F.col("regions")).alias(json))


def with_own_extra(documents: DataFrame, json: str = "json") -> DataFrame:
    """As with_extra, from the documents' own column extra: maps at the regions' places, as parse_annotations gives them; no row leaves its task."""
    regions = F.array_join(F.zip_with(_written(json), "extra", _region_text), ",")
    return documents.select("image", _document_text(F.from_json(json, "map<string,string>"), regions).alias(json))


def _written(json: str) -> Column:
    """A document's regions as maps of texts."""
    return F.from_json(F.get_json_object(json, "$.regions"), "array<map<string,string>>")


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def _region_text(region: Column, extra: Column) -> Column:
    """A region's JSON with its extra fields behind those of the schema."""
    free = F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*S.REGION_FIELDS))
    cell = lambda k, v: F.concat(_quoted(k), F.lit(":"), F.when(k.isin("bbox", "text_bbox", "id", "confidence", "claude_verified"), v).otherwise(_quoted(v)))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(F.map_concat(region, free)), lambda e: cell(e["key"], e["value"])), ","), F.lit("}"))


def _document_text(head: Column, regions: Column) -> Column:
    rest = F.map_filter(head, lambda k, v: ~k.isin("regions"))
    quoted = lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.when(e["key"].isin("image_size", "schema_version"), e["value"]).otherwise(_quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(rest), quoted), ","), F.lit(',"regions":['), regions, F.lit("]}"))


def document_json(image: str = "image", regions: str = "regions", **more: Column) -> Column:
    """Current-generation JSON: absent fields left out, negatives' text empty, verified only where true."""
    clean = F.transform(
        F.col(regions),
        lambda r: F.struct(r["id"].alias("id"), r["category"].alias("category"), r["bbox"].alias("bbox"), F.when(r["category"] == "negative", "").otherwise(r["text"]).alias("text"), *[r[f].alias(f) for f in ("text_bbox", "vendor", "quality", "confidence", "match_kind", "subkind", "text_visible")], F.when(r["claude_verified"], True).alias("claude_verified")),
    )
    return F.to_json(F.struct(F.col(image).alias("image"), *[c.alias(n) for n, c in more.items()], F.lit(2).alias("schema_version"), clean.alias("regions")))


def write_annotations(documents: DataFrame, path: str, json: str = "json") -> None:
    """One line of JSON text for each document, in gzip files."""
    with shuffles_dropped(documents.sparkSession):
        documents.select(F.col(json).alias("value")).write.option("compression", "gzip").text(path)


def read_annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_annotations wrote: one row of JSON text (json) for each line."""
    return spark.read.text(path).withColumnRenamed("value", "json")


def with_defaults(manifest: DataFrame) -> DataFrame:
    """A manifest of either generation with its absent values filled in."""
    absent = [c for c in S.MANIFEST_FIELDS if c not in manifest.columns]
    out = manifest.withColumns({c: F.lit(None).cast(S.MANIFEST[c].dataType) for c in absent})
    fill = {"text": "", "category": "positive", "subkind": "", "source": ""}
    return out.select(*[F.coalesce(c, F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in S.MANIFEST_FIELDS])


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Tab-separated manifests under path; a split without rows raises ValueError."""
    df = with_defaults(spark.read.schema(S.MANIFEST).csv(path, sep="\t", header=True))
    if split is not None:
        df = df.where(F.col("split") == split)
        if df.isEmpty():
            raise ValueError(f"no rows of the split {split}")
    return df


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A folder all with the whole manifest and one folder for each split, fields in their fixed order; quotes are kept as they are."""
    manifest.select(*S.MANIFEST_FIELDS).write.csv(f"{path}/all", sep="\t", header=True, emptyValue="")
    manifest.select(*S.MANIFEST_FIELDS, F.col("split").alias("part")).write.partitionBy("part").csv(f"{path}/splits", sep="\t", header=True, emptyValue="")


IMAGE_FILES = "*.{png,jpg,jpeg,bmp,PNG,JPG,JPEG,BMP}"


def read_images(spark: SparkSession, path: str, drop_invalid: bool = True, files: str = IMAGE_FILES) -> DataFrame:
    """Spark's image rows (origin, height, width, nChannels, mode, data in blue, green, red) of the files with those endings; what can't be read is left out, or has no size."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).option("pathGlobFilter", files).load(path).select("image.*")


def image_files(spark: SparkSession, path: str, files: str = IMAGE_FILES) -> DataFrame:
    """(path, length, content) of the image files under path, in any store that Spark reads, for decoded()."""
    return spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def encode_bmp(width: int, height: int, data: bytes) -> bytes:
    """A 24-bit BMP file of pixels row by row in blue, green, red."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width * 3)[::-1]
    body = np.pad(rows, ((0, 0), (0, -width * 3 % 4))).tobytes()
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(body), 0, 54, 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def decode_bmp(content: bytes) -> tuple[int, int, bytes]:
    """(width, height, pixels row by row in blue, green, red) of an uncompressed BMP file of 24 bits; ValueError tells what is wrong."""
    if len(content) < 54 or content[:2] != b"BM":
        raise ValueError("no BMP file")
    start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", content, 10)
    if bits != 24 or packed or width <= 0 or not height:
        raise ValueError(f"{bits} bits, packing {packed}, {width} x {height}")
    line, rows = (3 * width + 3) // 4 * 4, abs(height)
    if start < 54 or len(content) < start + line * rows:
        raise ValueError(f"{len(content)} bytes, {start + line * rows} needed")
    pixels = np.frombuffer(content, np.uint8, line * rows, start).reshape(rows, line)[:, : 3 * width]
    return width, rows, (pixels[::-1] if height > 0 else pixels).tobytes()


def bmp_files(images: DataFrame, folder: str) -> DataFrame:
    """(path, length, content) of image rows (image_id, width, height, data in blue, green, red), one BMP file each.

    The rows have the shape that image_files reads. Stored by Spark's own writers they lie in any store of the cluster;
    Spark has no writer for a file of bytes a row.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [encode_bmp(w, h, d) for w, h, d in pdf[["width", "height", "data"]].itertuples(index=False)]
            yield pd.DataFrame({"path": [f"{folder}/image_{i:012d}.bmp" for i in pdf["image_id"]], "length": [len(x) for x in found], "content": found})

    return images.select("image_id", "width", "height", "data").mapInPandas(encode, "path string, length long, content binary")


def decoded(files: DataFrame) -> DataFrame:
    """(path, width, height, data in blue, green, red, problem) of BMP files (path, content); of one that can't be read only path and problem.

    One pass gives both: keep the rows without a problem, report the others.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((path, *decode_bmp(content or b""), None))
                except ValueError as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "data", "problem"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(decode, "path string, width int, height int, data binary, problem string")


def samples_of_reports(spark: SparkSession, path: str) -> DataFrame:
    """(source, pred) of the test and validation samples in JSON run reports; entries of another shape have a null pred."""
    return _samples(spark.read.text(path, wholetext=True))


def samples_of_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """As samples_of_reports, of files with a report in each line."""
    return _samples(spark.read.text(path))


def _samples(reports: DataFrame) -> DataFrame:
    text = reports.select(F.from_json("value", "test_samples array<string>, val_samples array<string>").alias("r"))
    parts = [text.select(F.lit(k).alias("source"), F.explode_outer(f"r.{k}").alias("s")).select("source", F.get_json_object("s", "$.pred").alias("pred")) for k in ("test_samples", "val_samples")]
    return parts[0].unionByName(parts[1])
