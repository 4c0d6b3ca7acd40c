"""WARC archives with revisit records, written and read back by Spark.

Headers alone (page, payload digest, length) are shuffled by digest, payloads only where theirs may be one that repeats, to choose, for each payload of at least
``min_bytes`` bytes that occurs more than once, the record with the largest page id as the response; the
others become revisit records without a payload, which name that response. Records get fresh headers and are
written as gzipped archives through Spark's text writer, whose line separator is the blank lines that end a
record; a file holds about ``FILE_BYTES`` of payload. Reading unzips piece by piece, takes records by their Content-Length and joins revisits to their responses.

A null payload counts as empty, a null URL as an empty one; line ends in a URL become spaces. Rows of one
page id and payload repeat each other: all are responses if the id is the largest. A row with a null id is a
response. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import join_counted, new_path, sifted, written

FILE_BYTES, LARGE, MOST_BYTES, HEAD = 64_000_000, 65_536, 1_900_000_000, 1_000  # HEAD: bytes of a record's header, with a long URL
VERSION, END, DATE = "WARC/1.1", "\r\n\r\n", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@F.pandas_udf(StringType())
def payload_digest(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Base32 of the SHA-1 of a payload's UTF-8 bytes."""
    for batch in payloads:
        yield pd.Series([base64.b32encode(hashlib.sha1(p.encode("utf-8", "surrogatepass")).digest()).decode() for p in batch], dtype=object)


def _record_id(page_id: Column, digest: Column) -> Column:
    """A record's name by rule: a UUID made of a hash of its page id and digest."""
    h = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with digest, payload_bytes and refers_to, the response's page id of a revisit.

    Digests are computed once and stored with the pages; groups are chosen from headers alone.
    """
    digested = written(pages.withColumn("digest", payload_digest("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")), "warc_digests")
    heads = digested.where(F.col("payload_bytes") >= min_bytes).select("page_id", "digest")
    many = written(heads.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc_groups")
    # pages whose digest can't be one of these pass without a shuffle of their payloads
    parted = sifted(digested, many, "digest", "maybe", "string")
    found = join_counted(parted.where("maybe").drop("maybe"), many, "digest", "n").unionByName(parted.where("not maybe").drop("maybe"), allowMissingColumns=True)
    return found.withColumn("refers_to", F.when(F.col("page_id") < F.col("first"), F.col("first"))).drop("first")


def records(planned: DataFrame, date: str = DATE) -> DataFrame:
    """One column, value: each record's fresh header and its payload, if it is a response."""
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    lines = F.array_compact(
        F.array(
            F.lit(VERSION),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", url),
            F.when(F.col("page_id").isNotNull(), line("WARC-Page-ID", F.col("page_id").cast("string"))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(revisit, line("WARC-Profile", F.lit(PROFILE))),
            F.when(revisit, line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest")))),
            line("Content-Type", F.lit("text/html; charset=utf-8")),
            line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        )
    )
    return planned.select(F.concat(F.array_join(lines, "\r\n"), F.lit(END), F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages (page_id, url, payload text) as deduplicated archives under path, of about file_bytes of payload each.

    Pages of over LARGE bytes have files of their own, of so few records that even the largest pages together stay below
    MOST_BYTES; so do the others' files, whatever pages meet in one. A single page may have up to MOST_BYTES.
    """
    planned = written(plan_revisits(pages.withColumn("payload", F.coalesce("payload", F.lit(""))), min_bytes), "warc_plan")
    sizes = planned.groupBy((F.col("payload_bytes") > LARGE).alias("large")).agg(F.avg("payload_bytes").alias("mean"), F.max("payload_bytes").alias("most")).collect()
    for r in sorted(sizes, key=lambda r: r.large):  # two classes at most
        most = int(max(1, min(file_bytes // (r["mean"] + HEAD), MOST_BYTES // (r["most"] + HEAD))))
        own = records(planned.where((F.col("payload_bytes") > LARGE) == r.large))
        own.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    if not sizes:
        records(planned).write.option("lineSep", END).option("compression", "gzip").text(path)


def unzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """An archive's bytes piece by piece, gzipped (in any number of members) or not."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    unzip = zlib.decompressobj(31)
    for at in range(0, len(data), step):
        left = data[at : at + step]
        while left:
            out = unzip.decompress(left, 4 * step)
            if out:
                yield out
            left = unzip.unconsumed_tail
            if unzip.eof:
                left, unzip = unzip.unused_data, zlib.decompressobj(31)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record in an archive's bytes, gzipped or not; no more than a record and a piece are held unzipped."""
    held, pieces, passed = bytearray(), unzipped(data), 0

    def have(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while have(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not have(seen + 1):
                raise ValueError("cut off")
        version, *lines = held[:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins at byte {passed}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        size = end + 4 + int(headers["Content-Length"])
        if not have(size):
            raise ValueError("cut off")
        payload = bytes(held[end + 4 : size])
        have(size + 4)
        del held[: size + 4]
        passed += size + 4
        yield headers, payload


RECORD = "page_id long, url string, record_id string, record_type string, refers_to_id string, payload_digest string, payload_bytes long"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record under path; digest and length of a response are of the bytes read, a revisit has no length yet."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                out = []
                for h, payload in parse(data):
                    own = h["WARC-Type"] != "revisit"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if own else h["WARC-Payload-Digest"].removeprefix("sha1:")
                    page = h.get("WARC-Page-ID")
                    row = (None if page is None else int(page), h["WARC-Target-URI"], h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Refers-To"), digest, len(payload) if own else None)
                    out.append((*row, payload.decode("utf-8", "surrogatepass")) if payloads else row)
                    if len(out) >= 2000:
                        yield frame(out)
                        out = []
                if out:
                    yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        return pdf.astype({"page_id": "Int64", "payload_bytes": "Int64"})

    schema = RECORD + (", payload string" if payloads else "")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInPandas(rows, schema)


def resolve(found: DataFrame) -> DataFrame:
    """Records with revisits' lengths and page ids taken from the responses that they refer to."""
    found = written(found, "warc_records")
    asked = found.where("refers_to_id is not null").groupBy("refers_to_id").agg(F.first("payload_digest").alias("asked_digest"), F.count("*").alias("n"))
    own = found.where("refers_to_id is null").groupBy("record_id").agg(F.max("page_id").alias("first_page"), F.max("payload_bytes").alias("first_bytes"), F.first("payload_digest").alias("first_digest"))
    known = written(asked.join(own, F.col("refers_to_id") == F.col("record_id")).where("asked_digest = first_digest").select(F.col("refers_to_id"), "n", "first_page", "first_bytes"), "warc_responses")
    # responses refer to nothing; a response that many revisits name is kept out of the shuffle
    revisits, responses = found.where("refers_to_id is not null"), found.where("refers_to_id is null")
    out = join_counted(revisits, known, "refers_to_id", "n").unionByName(responses, allowMissingColumns=True)
    return out.select("page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first_page").alias("refers_to"), "url")


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, reads them back and resolves their revisits."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages.select("page_id", "url", F.col("html").cast("string").alias("payload")), path, min_bytes)
    return resolve(read_archives(spark, path))
