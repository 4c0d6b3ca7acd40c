"""URL filtering by association rules that FP-growth mines from labelled URLs, with fixed rules before them.

A URL's tokens are its scheme, the labels of its host and the directories of its path; numbers in the path are
left out, as they name single pages. FP-growth runs over the tokens of labelled URLs, bad ones with a mark of
their own; rules from tokens to the mark are pruned by support, by length and by confidence. A rule's confidence must be so far above the
share of bad URLs that, if labels fell at random, the chance of even one such rule among all sets tried would be at most
``ALPHA`` (Chernoff's bound on the binomial tail, divided by the number of sets). Each rule stands in an inverted index under its rarest token; URLs meet it there and must hold all its other tokens. Fixed rules
(host, path prefix, verdict) come first, the longest that fits wins. Only SQL functions and Spark's own
FP-growth are used.

A null URL, or one without "://", has an empty host and path, fits no rule and is allowed. Repeated URLs get
the same verdict; without labelled URLs no rule is mined. Other columns play no part, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

BAD = "!bad"
MIN_SUPPORT, MIN_COUNT, ALPHA, MAX_TOKENS = 0.001, 5, 0.01, 3
FIXED_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens, sorted: s: scheme, h: host labels, p: directories."""
    scheme = F.translate(F.regexp_extract(url, "(?s)^(.*?)://", 1), UPPER, LOWER)
    mark = lambda kind: lambda x: F.concat(F.lit(kind), x)
    found = F.concat(F.transform(F.array(scheme), mark("s:")), F.transform(F.split(host_of(url), r"\."), mark("h:")), F.transform(F.split(F.translate(path_of(url), UPPER, LOWER), "/"), mark("p:")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & ~x.rlike(r"^p:[0-9]+(\.[a-z]+)?$"))))


def excess(confidence: Column, base: float) -> Column:
    """Kullback-Leibler divergence of a confidence above the base share, per row that holds the tokens; 0 below it."""
    part = lambda p, q: F.when(p <= 0, 0.0).otherwise(p * F.ln(p / q))
    return F.when(confidence <= base, 0.0).otherwise(part(confidence, F.lit(base)) + part(1 - confidence, F.lit(1 - base)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, alpha: float = ALPHA, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support, anchor) from labelled (url, bad boolean); anchor is the rarest token."""
    spark = labelled.sparkSession
    baskets = written(labelled.select(F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")), "baskets")
    n, bad = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", BAD))).first()
    empty = "rule_id long, tokens array<string>, confidence double, support double, anchor string"
    if bad < min_count or bad == n:
        return spark.createDataFrame([], empty)
    fit = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=bad / n).fit(baskets)
    tried = fit.freqItemsets.where(~F.array_contains("items", BAD) & (F.size("items") <= max_tokens)).count()
    rules = fit.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.size("antecedent") <= max_tokens))
    holders = F.round(F.col("support") * n / F.col("confidence"))
    rules = rules.where(holders * excess(F.col("confidence"), bad / n) >= math.log(max(1, tried) / alpha))
    rules = written(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    seen = baskets.select(F.explode("items").alias("token")).groupBy("token").count()
    each = rules.withColumn("rule_id", F.xxhash64("tokens")).select("*", F.explode("tokens").alias("token")).join(seen, "token")
    return each.groupBy("rule_id").agg(F.first("tokens").alias("tokens"), F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.min_by("token", F.struct("count", "token")).alias("anchor"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, n, confidence, n_rules) of the distinct urls (url, n) that hold all tokens of a rule."""
    index = written(rules.select("rule_id", F.col("tokens").alias("needed"), "confidence", F.col("anchor").alias("token")), "rule_index")
    held = urls.select("url", "n", tokens_of(F.col("url")).alias("held"))
    met = held.select("url", "n", "held", F.explode("held").alias("token")).join(index, "token")
    return met.where(F.size(F.array_except("needed", "held")) == 0).groupBy("url").agg(F.first("n").alias("n"), F.max("confidence").alias("confidence"), F.count("*").alias("n_rules"))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = FIXED_RULES) -> Column:
    """(rule, verdict) of the longest fixed rule that fits, else null; the first of equal length."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def judge(pages: DataFrame, labelled: DataFrame, fixed: Sequence[tuple[str, str, str]] = FIXED_RULES, id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence, n_rules) of every row."""
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = plain.where("url is not null")
    found = written(matched(urls.groupBy("url").agg(F.count("*").alias("n")), mine(labelled, **mining)), "url_hits")
    # rows without a URL meet no rule; a URL that many rows share is kept out of the shuffle
    out = join_counted(urls, found, "url", "n").unionByName(plain.where("url is null"), allowMissingColumns=True).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    verdict = F.coalesce("fixed.verdict", F.when(F.col("n_rules") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "confidence", F.coalesce("n_rules", F.lit(0)).alias("n_rules"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose URL ends in the number of a labelled document; bad is toxic or of low quality."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    return numbered.join(marks, "doc_id").select("url", "bad")
