"""One query for each operator of this package, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import os
import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, importance, langid, lm_score, media, merkle, pii, simhash, token_counts, toxicity, url_filter, warc
from .common import id_bucket, read

#: Another folder of vocabulary files may be named.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR")

#: The keyed pseudonyms' secret. Values stay linked across runs only if a deployment names one; else each driver draws its own.
PII_KEY = os.environ.get("PII_KEY") or secrets.token_hex(32)
#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str) -> str:
    """Where the vocabulary file of that name lies."""
    return f"{TOKENIZERS}/{name}" if TOKENIZERS else public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = token_counts.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    return token_counts.counts(read(spark, sf_dir, "documents"), ranks, BYTE_PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    judged = url_filter.judge(pages, url_filter.labelled_urls(pages, read(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, docs)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.tiles(media.store(read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_kind", "tile")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PII_KEY, count_as="n_replaced", kinds_as="kinds")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(id_bucket(F.col("doc_id"), 5) == 0, merkle.leaf(*columns[:-1], lowered))
    found = merkle.manifest(docs, columns, F.col("source"), F.col("doc_id"), tampered)
    proof = merkle.siblings_digest(F.col("before"), F.col("after"))
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("other", "leaf"), F.col("before"), F.col("after")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_counts, op3_toxicity, op4_url_filter, op5_warc, op6_language_id, op7_media, op8_pii, op9_bpe, op10_simhash, op11_importance, op12_merkle, op13_lm_score, pipeline)}

_HOST = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The table of CRC-32 as a list, and the sum of a text's UTF-8 bytes by it.
_CRC_TABLE = "SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM range(0, 256) r(i)"
_CRC = "xor(list_reduce(list_transform(range(0, octet_length(encode({0}))), lambda k: ('0x' || substr(hex(encode({0})), (2 * k + 1)::INT, 2))::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"

ORACLE_SQL = {
    "op11_importance": f"""
WITH tab AS ({_CRC_TABLE}),
held AS (
  SELECT 1 AS kind, doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
  UNION ALL SELECT 2, item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
hashed AS (SELECT w, {_CRC.format("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM held), tab),
cells AS (SELECT kind, doc_id, bucket, count(*) AS n FROM held JOIN hashed USING (w) GROUP BY ALL),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 2), 0)::DOUBLE AS t FROM cells GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
sums AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM cells JOIN gains USING (bucket) WHERE kind = 1 GROUP BY doc_id),
weighed AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS g
  FROM documents LEFT JOIN sums USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY weight + g DESC, doc_id) AS place FROM weighed WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + g AS score, CASE WHEN place <= (SELECT count(*) FROM placed) * 10 // 100 THEN place END AS rank
FROM weighed LEFT JOIN placed USING (doc_id)""",
    # every set of up to three tokens that a labelled URL holds, in place of FP-growth
    "op4_url_filter": f"""
WITH split AS (
  SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, lower(coalesce(regexp_extract(url, '(?s)^(.*?)://', 1), '')) AS scheme FROM pages),
held AS (
  SELECT page_id, host, path, list_sort(list_distinct(list_filter(list_concat(['s:' || scheme],
    list_transform(string_split(host, '.'), lambda x: 'h:' || x), list_transform(string_split(lower(path), '/'), lambda x: 'p:' || x)),
    lambda x: length(x) > 2 AND NOT regexp_matches(x, '^p:[0-9]+([.][a-z]+)?$')))) AS tokens FROM split),
marks AS (SELECT doc_id, bool_or(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
numbered AS (SELECT page_id, tokens, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(\\.[a-z]+)?/?$', 1), '') AS BIGINT) AS doc_id FROM held),
baskets AS (SELECT page_id, tokens, bad FROM numbered JOIN marks USING (doc_id)),
one AS (SELECT page_id, unnest(tokens) AS t FROM held),
sets AS (
  SELECT page_id, [t] AS s FROM one
  UNION ALL SELECT a.page_id, [a.t, b.t] FROM one a JOIN one b ON a.page_id = b.page_id AND a.t < b.t
  UNION ALL SELECT a.page_id, [a.t, b.t, c.t] FROM one a JOIN one b ON a.page_id = b.page_id AND a.t < b.t JOIN one c ON a.page_id = c.page_id AND b.t < c.t),
base AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (bad) / count(*)::DOUBLE AS q FROM baskets),
counted AS (SELECT s, count(*) AS n_all, count(*) FILTER (bad) AS n_bad, count(*) FILTER (bad) / count(*)::DOUBLE AS p FROM sets JOIN baskets USING (page_id) GROUP BY s),
frequent AS (SELECT counted.*, q, ceil(greatest({url_filter.MIN_SUPPORT}, {url_filter.MIN_COUNT} / n) * n) AS least FROM counted, base WHERE n_all >= ceil(greatest({url_filter.MIN_SUPPORT}, {url_filter.MIN_COUNT} / n) * n)),
good AS (
  SELECT s FROM frequent WHERE n_bad >= least AND p > q AND q < 1
     AND n_all * (p * ln(p / q) + CASE WHEN p < 1 THEN (1 - p) * ln((1 - p) / (1 - q)) ELSE 0 END) >= ln((SELECT count(*) FROM frequent) / {url_filter.ALPHA}::DOUBLE)),
hit AS (SELECT DISTINCT page_id FROM sets JOIN good USING (s)),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM held)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN page_id IN (SELECT page_id FROM hit) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    # proofs are folded level by level: at most 16 siblings a level, any number of levels
    "op12_merkle": f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
heads AS (SELECT doc_id, source, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')).list_aggregate('string_agg', '') AS head,
  text, CASE WHEN doc_id IS NOT NULL AND {_CRC.format("doc_id::VARCHAR")} % 5 = 0 THEN {_LOWER.format("text")} ELSE text END AS other FROM documents, tab),
leaves AS (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS changed,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM heads),
nodes AS (
  SELECT 0 AS level, source, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, source, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, source, idx // 16, n),
subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 16, n),
runs AS (
  SELECT 0 AS part, level, source, idx // 16 AS run, list(digest ORDER BY idx) AS run_digests FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT 1, level, NULL, idx // 16, list(digest ORDER BY idx) FROM tops WHERE n > 1 GROUP BY ALL),
own AS (
  SELECT l.doc_id, r.part, r.level, (CASE WHEN r.part = 0 THEN l.idx ELSE s.idx END // pow(16, r.level)::BIGINT) % 16 AS place, r.run_digests
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  JOIN runs r ON (r.part = 1 OR r.source IS NOT DISTINCT FROM l.source) AND r.run = CASE WHEN r.part = 0 THEN l.idx ELSE s.idx END // pow(16, r.level + 1)::BIGINT),
cut AS (SELECT doc_id, part, level, array_to_string(run_digests[1:place], '') AS before, array_to_string(run_digests[place + 2:], '') AS after FROM own),
way AS (SELECT doc_id, list({{'b': before, 'a': after}} ORDER BY part, level) AS steps FROM cut GROUP BY doc_id),
folded AS (
  SELECT l.doc_id, leaf, source, sha256(coalesce(array_to_string(list_transform(steps, lambda p: p.b || p.a), ''), '')) AS proof_sha256,
    list_reduce(list_concat([changed], list_transform(coalesce(steps, []), lambda p: p.b || '|' || p.a)), lambda x, p: sha256(split_part(p, '|', 1) || x || split_part(p, '|', 2))) AS folded_root
  FROM leaves l LEFT JOIN way USING (doc_id))
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, proof_sha256, folded_root, folded_root = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM folded f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM d""",
}
