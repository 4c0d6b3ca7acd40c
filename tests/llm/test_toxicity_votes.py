"""Neighbours, votes, calibration and evidence against a plain computation; odd inputs under a fitted model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from serialspark.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def fitted(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return d, labels, toxicity.fit(d, labels), {r.doc_id: r.text for r in d.collect()}


def unit(index, text):
    own = {t: (1 + math.log(c)) * index.idf[index.term_no[t]] for t, c in toxicity.term_counts(text).items() if t in index.term_no}
    norm = math.sqrt(sum(w * w for w in own.values()))
    return {t: w / norm for t, w in own.items()}


def dense(index, texts):
    out = np.zeros((len(texts), len(index.terms)))
    for i, t in enumerate(texts):
        for term, w in unit(index, t).items():
            out[i, index.term_no[term]] = w
    return out


def brute(index, vectors, text, leave_out=None):
    own = dense(index, [text or ""])[0]
    cosines = np.round(vectors @ own, 12)
    if leave_out is not None:
        cosines[leave_out] = 0
    near = sorted((-c, i) for i, c in enumerate(cosines.tolist()) if c > 0)[: index.k]
    total = sum(c * c for c, _ in near)
    votes = (sum(c * c for c, i in near if index.toxic[i]) + toxicity.PRIOR_VOTES * index.share) / (total + toxicity.PRIOR_VOTES)
    return bool(own.any()), [(int(index.doc_ids[i]), int(index.toxic[i]), -c) for c, i in near], votes


def test_scores_and_evidence(fitted):
    _, _, index, texts = fitted
    vectors = dense(index, [texts[i] for i in index.doc_ids.tolist()])
    some = [None, "", "7 ½", *[t for _, t in sorted(texts.items())[:80]], "word " * 50000]
    for text, (score, evidence) in zip(some, index.scores(some), strict=True):
        known, near, votes = brute(index, vectors, text)
        assert [(e["doc_id"], e["toxic"]) for e in evidence] == [x[:2] for x in near]
        assert np.allclose([e["cosine"] for e in evidence], [x[2] for x in near])
        assert math.isclose(score, float(np.interp(votes, index.x, index.y)) if near else index.blank_score, abs_tol=1e-9)
        assert known or not near


def test_calibration_is_the_best_rising_fit(fitted):
    _, _, index, texts = fitted
    vectors = dense(index, [texts[i] for i in index.doc_ids.tolist()])
    n, toxic = len(vectors), int(index.toxic.sum())
    rows = [(brute(index, vectors, texts[i], leave_out=j)[2], int(t), index.share / toxic if t else (1 - index.share) / (n - toxic)) for j, (i, t) in enumerate(zip(index.doc_ids.tolist(), index.toxic.tolist(), strict=True))]
    x = sorted({round(r[0], 9) for r in rows})
    by = [[r for r in rows if round(r[0], 9) == v] for v in x]
    weight = np.cumsum([0.0] + [sum(w for _, _, w in b) for b in by])
    hits = np.cumsum([0.0] + [sum(w * t for _, t, w in b) for b in by])
    mean = (hits[None, :] - hits[:, None]) / np.where(weight[None, :] > weight[:, None], weight[None, :] - weight[:, None], 1)  # of lo to hi - 1
    for i in range(0, len(x), max(1, len(x) // 40)):  # min-max formula of isotonic regression
        want = max(mean[lo, i + 1 :].min() for lo in range(i + 1))
        assert math.isclose(float(np.interp(x[i], index.x, index.y)), (want * n + index.share) / (n + 1), abs_tol=1e-6)


def test_ties_go_to_the_earlier_example():
    examples = [(i, i % 2, {"same": 1}) for i in range(40)]
    index = toxicity.Index(examples, 0.5, ["same"], np.array([40]), 40, k=3)
    assert [e["doc_id"] for e in index.score("same")[1]] == [0, 1, 2]


def test_repeated_ids_and_empty_tables(spark, fitted):
    d, labels, index, _ = fitted
    many = d.unionByName(d.withColumn("text", F.concat("text", F.lit(" zzz"))))
    again = toxicity.fit(many, labels)
    assert sorted(again.doc_ids.tolist()) == sorted(index.doc_ids.tolist()) and "zzz" not in again.term_no
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None)], DOCS)
    out = toxicity.score_documents(odd.withColumn("score", F.lit("x")), labels).collect()
    assert len(out) == 3 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_documents(d.limit(0), labels).count() == 0
    assert toxicity.score_documents(odd, labels.limit(0)).select("score").distinct().collect() == [(0.0,)]
