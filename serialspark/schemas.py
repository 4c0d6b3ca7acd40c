"""Schemas and fixed values of annotations, manifests and model outputs."""

from __future__ import annotations

from pyspark.sql import types as T

# Alphabets, sizes and patterns that models and labels agree on.
CTC_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CTC_BLANK = 36
FIXED_ALPHABET = "0123456789EM"
FIXED_EMPTY = 12
FIXED_LENGTH = 16
SERIAL_STRICT = "^E[39][0-9]{2}MM[0-9]{6}\\z"
SERIAL_PARTIAL = "E[39][0-9]{2}MM[0-9]{6}"
TRUTH_STRICT = "^E300MM[0-9]{6}\\z"
# Field names of annotation documents and manifests, in their order on disk.
META_KEYS = ("ocr_engine", "mode", "ocr_elapsed_sec", "rejected_by_regex_primary", "claude_verification", "secondary_engine", "secondary_candidates_count", "disagreements")
REGION_FIELDS = ("id", "category", "bbox", "text", "text_bbox", "vendor", "quality", "confidence", "match_kind", "subkind", "text_visible", "claude_verified")
MANIFEST_FIELDS = ("filename", "text", "split", "source", "confidence", "category", "subkind")

BOX = T.ArrayType(T.IntegerType())
REGION = T.StructType(
    [T.StructField(n, t) for n, t in (("id", T.LongType()), ("category", T.StringType()), ("bbox", BOX), ("text", T.StringType()), ("text_bbox", BOX), ("vendor", T.StringType()), ("quality", T.StringType()), ("confidence", T.DoubleType()), ("match_kind", T.StringType()), ("subkind", T.StringType()), ("text_visible", T.StringType()), ("claude_verified", T.BooleanType()))]
)
OLD_LABEL = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("bbox", BOX), ("text_bbox", BOX), ("text", T.StringType()), ("confidence", T.DoubleType()), ("is_clear", T.BooleanType()), ("match_kind", T.StringType()), ("claude_verified", T.BooleanType()))])
DOCUMENT = T.StructType(
    [T.StructField(n, t) for n, t in (("image", T.StringType()), ("image_size", BOX), ("source_video", T.StringType()), ("vendor", T.StringType()), ("schema_version", T.IntegerType()), ("regions", T.ArrayType(REGION)), ("labels", T.ArrayType(OLD_LABEL)))]
)
MANIFEST = T.StructType([T.StructField(n, T.DoubleType() if n == "confidence" else T.StringType()) for n in MANIFEST_FIELDS])
