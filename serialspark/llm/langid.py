"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters, lower-cased. A word's features are its character n-grams of two to four letters
with marks at both ends (those that touch a mark are its affixes) and the word itself as an entry of the
lexicon; all are hashed. Features score each language, learned transitions score each pair of neighbours'
languages, and forward-backward gives every word's distribution. A text's language is the one with the
largest share of its words; the score is that share. Training sequences join stretches of several documents,
so that the model learns to switch within a text.

The model is fitted on a bounded sample: at most ``per_language`` texts of each language, chosen by a hash of the
id, and of their stretches of ``STRETCH`` words at most ``TRAINING_WORDS`` words, as many of each language, at
random. Null texts and texts without a letter get ``und`` and score 0, as do all
texts if there is nothing to learn from. Ties go to the language first in order. Whole texts are labelled. An
empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import chunks, free_name, id_bucket, words_of

UNKNOWN = "und"
PER_LANGUAGE, MOST_LANGUAGES, TRAINING_WORDS, BUCKETS, STRETCH, ROUNDS, RATE, DECAY = 150, 1000, 400_000, 1 << 16, 16, 40, 0.5, 1e-6
BATCH_CHARS = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PREDICTED = StructType().add("lang_pred", StringType()).add("score", DoubleType())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all words one after the other, number of features of each word)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    numbers, owners = [], []
    for n in (2, 3, 4):
        h = np.full(max(len(flat) - n + 1, 0), n, np.uint64)
        for j in range(n):
            h = (h ^ flat[j : j + len(h)]) * MULTIPLIER
            h ^= h >> np.uint64(31)
        whole = word[: len(h)] == word[n - 1 :][: len(h)]
        numbers.append(h[whole])
        owners.append(word[: len(h)][whole])
    start = np.cumsum(size) - size
    place = (np.arange(len(flat)) - np.repeat(start, size)).astype(np.uint64)
    numbers.append(np.add.reduceat((flat + (place << np.uint64(21))) * MULTIPLIER ^ (flat >> np.uint64(3)), start) * MULTIPLIER)
    owners.append(np.arange(len(words)))
    numbers, owners = np.concatenate(numbers), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (numbers[order] >> np.uint64(48)).astype(np.int64) % BUCKETS, np.bincount(owners, minlength=len(words))


def forward_backward(emission: np.ndarray, transition: np.ndarray, first: np.ndarray, size: np.ndarray, messages: np.ndarray | None = None) -> np.ndarray:
    """Every word's distribution over languages; messages, if given, gets the forward and backward ones. emission: (words, languages) and transition, both exponentiated.

    first, size: where each sequence begins and how long it is, longest first; all sequences advance together.
    """
    forward = np.empty_like(emission)
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
    state = None
    for t in range(longest):
        at = first[: alive[t]] + t
        state = emission[at] if state is None else (state[: alive[t]] @ transition) * emission[at]
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    back = np.ones((len(size), emission.shape[1]), emission.dtype)
    turned = np.ascontiguousarray(transition.T)
    for t in range(longest - 2, -1, -1):
        n = alive[t + 1]
        at = first[:n] + t
        step = (emission[at + 1] * back[:n]) @ turned
        step /= step.sum(axis=1, keepdims=True)
        back[:n] = step
        if messages is not None:
            messages[1, at] = step
        else:
            forward[at] *= step
    if messages is not None:
        messages[0] = forward
        forward = forward * messages[1]
    forward /= forward.sum(axis=1, keepdims=True)
    return forward


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray):
        self.languages, self.weights, self.transition = languages, weights, transition

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of each word's scores, the best of a word being 1."""
        numbers, size = features(words)
        if not len(size):
            return np.zeros((0, len(self.languages)), np.float32)
        scores = np.add.reduceat(self.weights[numbers], np.cumsum(size) - size, axis=0)
        return np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), 1e-20).astype(np.float32)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        for lo, hi in chunks(texts, BATCH_CHARS):
            number: defaultdict[str, int] = defaultdict(count().__next__)
            rows = []
            for t in texts[lo:hi]:
                words = words_of(t)
                rows.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            if not self.languages:
                yield from [(UNKNOWN, 0.0)] * len(rows)
                continue
            size = np.array([len(r) for r in rows])
            emission = self.emissions(list(number))[np.concatenate(rows)]
            first = np.cumsum(size) - size
            order = np.argsort(-size, kind="stable")
            order = order[size[order] > 0]
            posterior = forward_backward(emission, self.transition, first[order], size[order])
            shares = np.zeros((len(rows), len(self.languages)))
            if len(order):
                own = np.sort(order)
                shares[own] = np.add.reduceat(posterior.astype(np.float64), first[own], axis=0) / size[own, None]
            for n, share in zip(size.tolist(), shares, strict=True):
                best = int(share.argmax())
                yield (self.languages[best], min(1.0, float(share[best]))) if n else (UNKNOWN, 0.0)

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """Each word with its likeliest language."""
        words = words_of(text)
        if not words or not self.languages:
            return [(w, UNKNOWN) for w in words]
        p = forward_backward(self.emissions(words), self.transition, np.array([0]), np.array([len(words)]))
        return [(w, self.languages[i]) for w, i in zip(words, p.argmax(axis=1).tolist(), strict=True)]


def train(rows: list[tuple[str, str]], rounds: int = ROUNDS, most_words: int = TRAINING_WORDS, seed: int = 6) -> Model:
    """Fits the field to (language, text) rows by gradient ascent on the sequences' log likelihood.

    Stretches of texts are joined in random order; if there are more than most_words words, random stretches of each language are left out.
    """
    languages = sorted({lang for lang, _ in rows})
    rng = np.random.default_rng(seed)
    number: defaultdict[str, int] = defaultdict(count().__next__)
    stretches: list[tuple[int, list[int]]] = []
    for lang, text in rows:
        ids = [number[w] for w in words_of(text)]
        stretches += [(languages.index(lang), ids[i : i + STRETCH]) for i in range(0, len(ids), STRETCH)]
    if not stretches:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))
    by_language = defaultdict(list)
    for s in stretches:
        by_language[s[0]].append(s)
    most = max(1, most_words // STRETCH // len(by_language))
    stretches = [own[i] for own in by_language.values() for i in rng.permutation(len(own))[:most].tolist()]
    stretches = [stretches[i] for i in rng.permutation(len(stretches)).tolist()]
    runs = [stretches[i : i + 4] for i in range(0, len(stretches), 4)]
    word = np.concatenate([np.array(s[1]) for run in runs for s in run])
    label = np.concatenate([np.full(len(s[1]), s[0]) for run in runs for s in run])
    size = np.array([sum(len(s[1]) for s in run) for run in runs])
    first = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    words, word = np.unique(word, return_inverse=True)
    names = list(number)
    numbers, per_word = features([names[w] for w in words.tolist()])
    owner = np.repeat(np.arange(len(words)), per_word)
    n_lang, start = len(languages), np.cumsum(per_word) - per_word
    weights, transition = np.zeros((BUCKETS, n_lang)), np.zeros((n_lang, n_lang))
    seen_w, seen_t = np.full(weights.shape, 1e-8), np.full(transition.shape, 1e-8)
    truth = np.eye(n_lang)[label]
    inside = np.ones(len(word), bool)
    inside[first] = False
    at = np.flatnonzero(inside)
    true_pairs = np.zeros_like(transition)
    np.add.at(true_pairs, (label[at - 1], label[at]), 1)
    for _ in range(rounds):
        scores = np.add.reduceat(weights[numbers], start, axis=0)
        e = np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), 1e-20)[word]
        t = np.exp(transition - transition.max())
        messages = np.ones((2, *e.shape))
        p = forward_backward(e, t, first[order], size[order], messages)
        by_word = np.stack([np.bincount(word, weights=(truth - p)[:, k], minlength=len(words)) for k in range(n_lang)], axis=1)
        grad = np.stack([np.bincount(numbers, weights=by_word[owner, k], minlength=BUCKETS) for k in range(n_lang)], axis=1) / len(word) - DECAY * weights
        # of neighbours: the left one's forward message, the transition, the right one's score and backward message
        pair = messages[0, at - 1][:, :, None] * t[None] * (e[at] * messages[1, at])[:, None, :]
        pairs = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        grad_t = (true_pairs - pairs) / len(word) - DECAY * transition
        seen_w += grad**2
        seen_t += grad_t**2
        weights += RATE * grad / np.sqrt(seen_w)
        transition += RATE * grad_t / np.sqrt(seen_t)
    return Model(languages, weights.astype(np.float32), np.exp(transition - transition.max()).astype(np.float32))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_languages: int = MOST_LANGUAGES) -> list[tuple[str, str]]:
    """At most per_language (language, text) rows of each language, those of the smallest hashes of the id; an id counts once in a language, with the first of its texts.

    What reaches the driver is bounded by per_language and by most_languages; more languages raise ValueError.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.ids for r in known.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return []
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    # about three times the wanted ids pass; the exact bound follows
    limit = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, (3 * per_language + 30) / n) * (1 << 30)))])
    near = known.where(draw < F.element_at(limit, F.col("lang"))).groupBy("lang", "id").agg(F.min("text").alias("text"), F.first(draw).alias("draw"))
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))).where(F.col("place") <= per_language)
    return [(r.lang, r.text) for r in first.sort("lang", "draw", "id").select("lang", "text").collect()]


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the id as text, mod 3, isn't 1."""
    return docs.where(id_bucket(F.col(id_col), 3) != 1)


def predictor(docs: DataFrame, model: Model):
    """A function of a text column: (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTED)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(list(shared.value.predict(list(texts))), columns=PREDICTED.names)

    return predict


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sampling) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs, by a model fitted to the learnable rows of training."""
    predict = predictor(docs, train(sample(learnable(training), **sampling)))
    out = docs.select(F.col(id_col).alias("doc_id"), (id_bucket(F.col(id_col), 3) == 1).alias("held_out"), predict(F.col(text_col).cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, training: DataFrame, least: float = 0.3, text_col: str = "text", **sampling) -> DataFrame:
    """docs without those of no language (und) or whose likeliest language has less than that share; columns stay as they are."""
    predict = predictor(docs, train(sample(learnable(training), **sampling)))
    name = free_name(docs, "_lang")
    out = docs.withColumn(name, predict(F.col(f"`{text_col}`").cast("string")))
    return out.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)
