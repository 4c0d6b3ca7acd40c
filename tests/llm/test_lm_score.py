"""Language model scores: counts and bases against plain Python, the network against slow loops and finite differences."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from serialspark.llm import gru, lm_score, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score string, key string"
ODD = [(None, None), (1, None), (2, ""), (3, " \n "), (4, "One two\x00 TWO é"), (4, "One two\x00 TWO é"), (4, "other words"), (5, "word " * 30000), (6, "日本語 ñ é 🙂 \x1c x"), (7, "z" * 200_000), (2**60, "one")]


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()), None]


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = c.total(), len(c)
    base = lambda text: sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(text))
    return [(i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(base(t), 6)) for i, t in rows]


def contract(rows):
    return sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in rows)


def test_query_equals_counts_and_beats_them(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op13_lm_score(spark, SF).collect()
    assert contract(found) == sorted(map(str, brute(rows)))
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in found)


@pytest.mark.parametrize("frequent", [lm_score.FREQUENT, 3])
def test_odd_rows(spark, frequent, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    df = spark.createDataFrame([(i, t, "x", None) for i, t in ODD], DOCS).repartition(3)
    found = lm_score.scored(df).collect()
    assert contract(found) == sorted(map(str, brute(ODD)))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)
    assert lm_score.scored(df.limit(0)).count() == 0


def test_without_training_documents(spark):
    df = spark.createDataFrame([(i, "a b", None, None) for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1], DOCS)
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm_score.scored(df).collect()} == {(True, 3, 0, 0, 0.0)}


def test_repeated_words_are_learnt(spark):
    """Of two words that follow their own kind, counts know only the share; the state carried through the text knows which."""
    df = spark.createDataFrame([(i, " ".join(["ab" if i % 2 else "cd"] * 60), None, None) for i in range(2000)], DOCS)
    out = [r for r in lm_score.scored(df).collect() if r.held_out]
    assert sum(r.score for r in out) > 0.5 * sum(r.base_score for r in out)


def network(seed=0, scale=1.0):
    shape = gru.Shape(12, 4, 8, 5)
    rng = np.random.default_rng(seed)
    net = gru.Network(shape, gru.initial(shape, np.full(8, 1 / 8), np.full(12, 1 / 4)))
    net.p = {k: (v + scale * rng.standard_normal(v.shape)).astype(np.float32) for k, v in net.p.items()}
    return net


def slow(net, ids):
    """Log-probabilities of one sequence, step by step."""
    p, s = {k: v.astype(float) for k, v in net.p.items()}, net.shape
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, x, out = np.zeros(s.hidden), s.ids, []
    for y in ids:
        e, n = p["embed"][x], s.hidden
        g = sig(e[: 2 * n] + h @ p["gates"])
        z, r = g[:n], g[n:]
        new = np.tanh(e[2 * n :] + r * (h @ p["inner"]))
        h = (1 - z) * new + z * h
        c = h @ p["to_class"] + p["class_bias"]
        c -= np.log(np.exp(c).sum())
        if y < s.heads:
            w = h @ p["to_word"][y // s.width] + p["word_bias"][y // s.width]
            out.append(c[y // s.width] + w[y % s.width] - np.log(np.exp(w).sum()))
        else:
            out.append(c[y - s.heads + s.heads // s.width])
        x = y
    return out


@pytest.mark.parametrize(("lanes", "window"), [(1, 1), (3, 4), (16, 7)])
def test_scores_carry_the_state(lanes, window):
    net, rng = network(), np.random.default_rng(1)
    size = np.array([0, 5, 1, 30, 0, 9, 2, 2, 17])
    ids = rng.integers(0, net.shape.ids, int(size.sum()))
    expected = np.concatenate([slow(net, x) for x in np.split(ids, np.cumsum(size)[:-1])])
    np.testing.assert_allclose(net.score(ids, size, lanes, window), expected, rtol=2e-4, atol=2e-4)


def test_stretches_keep_all_ids():
    size = np.array([0, 1, 1024, 1025, 5000])
    assert gru.stretches(size).tolist() == [0, 1, 1024, 1024, 1, 1024, 1024, 1024, 1024, 904]
    assert gru.stretches(np.zeros(0, int)).tolist() == []


def test_probabilities_add_up():
    net = network()
    h = np.random.default_rng(2).uniform(-1, 1, (6, net.shape.hidden)).astype(np.float32)
    total = sum(np.exp(net.log_likelihood(h, np.full(6, y))) for y in range(net.shape.ids))
    np.testing.assert_allclose(total, 1, rtol=1e-4)


def test_gradients_are_those_of_the_cost():
    net, rng = network(scale=0.5), np.random.default_rng(3)
    own = gru.dealt(rng.integers(0, net.shape.ids, 40), np.array([11, 3, 20, 6]), 3)
    place, there, y, x, begins = next(own.windows(net.shape.ids, 25))
    h = rng.uniform(-1, 1, (x.shape[1], net.shape.hidden)).astype(np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, _, _ = net.gradients(x, y, begins, there, h, 10)
    for name, v in net.p.items():
        for i in rng.choice(v.size, min(25, v.size), replace=False):
            old, cost = v.flat[i], []
            for d in (1e-3, -1e-3):
                v.flat[i] = old + d
                cost.append(net.gradients(x, y, begins, there, h, 10)[2])
            v.flat[i] = old
            assert math.isclose((cost[0] - cost[1]) / 2e-3, g[name].flat[i], rel_tol=2e-2, abs_tol=2e-4), name


def test_the_network_learns_from_every_share():
    from serialspark.llm import lm_score

    assert lm_score.ROUNDS == lm_score.SHARES


def test_sums_of_exponentials_make_no_copies():
    """What a step of the network spends most on works in place, and large sums don't overflow."""
    a = np.array([[0, 1, 100], [-200, 0, 0]], np.float32)
    e, total = gru._exp_and_sum(a)
    assert e is a and np.isfinite(total).all() and abs(total[1] - 2) < 1e-6
    np.testing.assert_allclose(gru._sigmoid(np.array([-1000, -20, 0, 20, 1000], np.float32)), [0, 2.06e-9, 0.5, 1, 1], rtol=1e-2, atol=1e-12)


@pytest.mark.parametrize("scale", [1, 40])
def test_words_of_all_classes_are_computed_at_once(scale, monkeypatch):
    """Exponentials are taken twice for a window, of classes and of words, however many classes there are; large weights don't overflow."""
    net, rng, calls = network(), np.random.default_rng(5), []
    net.p |= {k: net.p[k] * np.float32(scale) for k in ("to_class", "to_word", "embed")}
    assert net.weights().bounded == (scale == 1)
    exp_and_sum = gru._exp_and_sum
    monkeypatch.setattr(gru, "_exp_and_sum", lambda *a: calls.append(a[0].shape) or exp_and_sum(*a))
    ids = rng.integers(0, net.shape.ids, 60)
    x, begins = np.r_[net.shape.ids, ids[:-1]][:, None], np.arange(60)[:, None] == 0
    h = np.zeros((1, net.shape.hidden), np.float32)
    states = net.states(net.weights(), x, begins, h)[0]
    found = net.log_likelihood(states[:, :, 0], ids)
    assert calls == [(60, net.shape.classes), (int((ids < net.shape.heads).sum()), net.shape.width)]
    assert np.isfinite(found).all()
    if scale == 1:
        np.testing.assert_allclose(found, slow(net, ids), rtol=2e-4, atol=2e-4)
    g, _, cost = net.gradients(x, ids[:, None], begins, np.ones_like(begins), h, 60)
    assert len(calls) == 4 and math.isfinite(cost) and all(np.isfinite(v).all() for v in g.values())
