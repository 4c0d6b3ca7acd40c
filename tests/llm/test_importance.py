"""Importance weights and draws against plain Python over all features."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from serialspark.llm import importance, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, weight string, Rank string"


def features(text, longest, buckets):
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())
    return words, [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    rows = [(i, *features(t, longest, buckets)) for i, t in docs]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in features(x, longest, buckets)[1])
    more, less = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * more / ((s[b] + 1) * less)))
    out = []
    for i, words, f in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = fit[: len(fit) * percent // 100]
    # rows that repeat each other in all of these are alike
    ranks = {}
    for n, r in enumerate(drawn, 1):
        ranks.setdefault(tuple(r), []).append(n)
    return [(*r, ranks[tuple(r)].pop(0) if ranks.get(tuple(r)) else None) for r in out]


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = queries.op11_importance(spark, SF)
    assert dict(found.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    expected = brute(docs, target)
    assert sorted(map(str, ((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()))) == sorted(str((i, f, w, s, k)) for i, _, f, w, s, k in expected)
    assert sum(r[-1] is not None for r in expected) > 10


@pytest.mark.parametrize("longest", [1, 3])
def test_odd_rows(spark, longest):
    long = " ".join(f"word{i % 700} Straße" for i in range(40_000))
    rows = [(None, None), (1, None), (2, ""), (3, "..."), (4, long), (5, "same " * 25), (5, "same " * 25), (5, "same " * 24), (None, "x1 " * 30), (6, "日本語 é " * 12), (7, "q" * 100_000 + " b" * 30)]
    rows += [(100 + i, f"tail{i % 3} of words " * 8) for i in range(60)]
    target = [None, "", "tail1 of words", "日本語"]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)
    found = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=30, buckets=997)
    expected = brute(rows, target, longest, 997, 30)
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(map(str, expected))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a " * 30, None, None)], DOCS)
    none = df.select("text").limit(0)
    assert importance.resample(df.limit(0), none).count() == 0
    assert [(r.n_features, r["rank"]) for r in importance.resample(df, none, percent=100).collect()] == [(30, 1)]


def test_bit_sliced_sums_are_exact():
    rng = np.random.default_rng(1)
    for lo, hi in ((-9000, 9000), (0, 1), (-1, 0), (-8, 8), (5, 5000)):
        gains = rng.integers(lo, hi, 997)
        row = np.sort(rng.integers(0, 1500, 40_000))
        bucket = np.where(rng.random(40_000) < 0.3, 3, rng.integers(0, 997, 40_000))
        expected = np.zeros(1500, np.int64)
        np.add.at(expected, row, gains[bucket])
        assert (importance.sums_of(bucket, row, 1500, importance.gain_planes(gains), 997) == expected).all()
