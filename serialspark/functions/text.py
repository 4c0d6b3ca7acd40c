"""Column functions over recognised text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from serialspark import schemas as S


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Full-width forms of the printable ASCII characters, which NFKC maps by a fixed distance.
FULL_WIDTH = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
ASCII = "".join(map(chr, range(0x21, 0x7F)))


def normalized(raw: Column, strip_spaces: bool = False, exact: bool = False) -> Column:
    """Compatibility form, upper case, no hyphens. exact sends text through Python; else full-width forms are mapped natively."""
    plain = _nfkc(raw) if exact else F.translate(raw, FULL_WIDTH + "　", ASCII + " ")
    out = F.replace(F.upper(plain), F.lit("-"), F.lit(""))
    return F.replace(out, F.lit(" "), F.lit("")) if strip_spaces else out


def corrected(text: Column, strict: str = S.SERIAL_STRICT, partial: str = S.SERIAL_PARTIAL) -> Column:
    """(text, stage) of normalised text: 1 strict, 2 strict with O read as 0, 5 part with O read as 0, 6 part; else nulls."""
    zero = F.translate(text, "O", "0")
    stage = lambda t, n: F.struct(t.alias("text"), F.lit(n).alias("stage"))
    part = lambda t: F.regexp_extract(t, f"({partial})", 1)
    none = F.lit(None).cast("struct<text:string,stage:int>")
    return F.when(text.rlike(strict), stage(text, 1)).when(zero.rlike(strict), stage(zero, 2)).when(part(zero) != "", stage(part(zero), 5)).when(part(text) != "", stage(part(text), 6)).otherwise(none)


def candidate(text: Column, strict: str = S.SERIAL_STRICT, partial: str = S.SERIAL_PARTIAL) -> Column:
    """(text, match_kind): the whole text if strict, else the first part that matches; else null."""
    part = F.regexp_extract(text, f"({partial})", 1)
    pick = lambda t, kind: F.struct(t.alias("text"), F.lit(kind).alias("match_kind"))
    return F.when(text.rlike(strict), pick(text, "strict")).when(part != "", pick(part, "partial"))


def accepted(pred: Column, confidence: Column | None = None, threshold: float | Column | None = None, strict: str = S.SERIAL_STRICT) -> Column:
    """Whether a prediction counts: it matches the pattern and, with a threshold, is confident enough."""
    ok = (F.coalesce(pred, F.lit("")) != "") & F.coalesce(pred.rlike(strict), F.lit(False))
    return ok if threshold is None else ok & F.coalesce(confidence >= threshold, F.lit(False))


def vendor_pattern(vendor: str, patterns: dict[str, str]) -> str:
    """The strict pattern of a vendor; ValueError for one that isn't known."""
    if vendor not in patterns:
        raise ValueError(f"unknown vendor {vendor!r}; known: {sorted(patterns)}")
    return patterns[vendor]


def vendors_of(rows: DataFrame, text: Column, patterns: dict[str, str], column: str = "vendor") -> DataFrame:
    """rows once for each vendor whose strict pattern the text fits; without a join, as patterns are a handful."""
    fitting = F.filter(F.array(*[F.when(text.rlike(p), name) for name, p in patterns.items()]), lambda v: v.isNotNull())
    return rows.withColumn(column, F.explode(fitting))


def known_vendor(vendor: Column, patterns: dict[str, str]) -> Column:
    """The vendor itself, or an error for rows that name one that isn't known; null stays null."""
    return F.when(vendor.isNull() | vendor.isin(*patterns), vendor).otherwise(F.raise_error(F.concat(F.lit("unknown vendor "), vendor)))


def error_rate(pred: Column, truth: Column) -> Column:
    """Levenshtein distance by the truth's length; against an empty truth 1 for any output, else 0."""
    n = F.length(truth)
    return F.when(n == 0, F.when(F.length(pred) > 0, 1.0).otherwise(0.0)).otherwise(F.levenshtein(pred, truth) / n)


def memorized(text: Column) -> Column:
    """The first serial-like run if it doesn't begin as dummies do; else null."""
    first = F.regexp_extract(text, "(E[39][0-9]{2}MM[0-9]+)", 1)
    return F.when((first != "") & ~F.startswith(first, F.lit("E300MM")), first)


def memorized_runs(text: Column) -> Column:
    """All serial-like runs of a text that don't begin as dummies do."""
    return F.filter(F.regexp_extract_all(text, F.lit("(E[39][0-9]{2}MM[0-9]+)"), 1), lambda run: ~F.startswith(run, F.lit("E300MM")))


def leak_counts(text: Column) -> tuple[Column, Column]:
    """(serials, runs of five digits or more) in free text."""
    n = lambda p: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
    return n(S.SERIAL_PARTIAL), n("[0-9]{5,}")


def encoded(text: Column, alphabet: str) -> Column:
    """Positions of the text's characters in the alphabet; null if one isn't there."""
    ids = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(alphabet), c) - 1)
    return F.when(~F.exists(ids, lambda i: i < 0), ids)


def encoded_fixed(text: Column) -> Column:
    """Fixed-head ids padded with the empty class; null if too long or with a foreign character."""
    ids = encoded(text, S.FIXED_ALPHABET)
    return F.when(F.length(text) <= S.FIXED_LENGTH, F.concat(ids, F.array_repeat(F.lit(S.FIXED_EMPTY), F.lit(S.FIXED_LENGTH) - F.length(text))))
