"""Toxicity scores from nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are words: runs of letters, lower-cased. All terms of the labelled sample count; document frequencies are
of all documents. A text's weights are (1 + ln tf) idf times a factor that rises from ``LEAST_FACTOR`` to 1 with
the dependence of the term's presence on the label (chi-squared), scaled to length 1. Examples lie in blocks; the
index has the postings of each term and block and their largest weight. Texts are searched many at a time: a
sparse product gives each text's upper bound for each block, the blocks of the highest bounds are scored first,
and of the others only those that can still hold one of the ``k`` nearest, so the neighbours are exact. Terms of
many examples have their weights in full rows, the others as lists. The neighbours vote with the square of their
cosine; votes are calibrated by isotonic regression on the examples themselves, each left out of its own search
and weighted by its class's share among all labelled rows. The evidence is all voters. Texts without a term of
the sample get the share of toxic ones among such examples.

The sample is bounded: at most ``per_class`` whole texts of each label, those of the smallest hash of the id; an
id counts once, with the first of its texts. Null texts count as empty. Ties between neighbours go to the
earlier example. Without examples of both labels every score is the share of toxic labels, or 0. An empty table
gives an empty one.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from .common import chunks, gathered, id_bucket, words_of, written

PER_CLASS, NEIGHBOURS, BLOCK, CHI_SQUARED, LEAST_FACTOR, PRIOR_VOTES = 1500, 15, 64, 25.0, 0.1, 0.5
FIRST_BLOCKS, SCORED_ROWS, BATCH_CHARS = 8, 128, 1_000_000
FULL_SHARE = 0.05  # terms of more than this share of the examples have full rows of weights
EVIDENCE = ArrayType(StructType().add("doc_id", LongType()).add("toxic", LongType()).add("cosine", DoubleType()))
SCORED = StructType().add("score", DoubleType()).add("evidence", EVIDENCE)


def term_counts(text: str | None) -> Counter:
    """How often each term occurs."""
    return Counter(words_of(text))


def batch_counts(texts: list[str | None], term_no: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, known term, how often) of each known term of each text, text by text."""
    found = [term_counts(t) for t in texts]
    size = [len(c) for c in found]
    term = np.fromiter(map(term_no.get, chain.from_iterable(found), repeat(-1)), np.int64, sum(size))
    times = np.fromiter(chain.from_iterable(c.values() for c in found), np.int64, sum(size))
    own = term >= 0
    return np.repeat(np.arange(len(found)), size)[own], term[own], times[own]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best rising step function of y on x with weights w, as (x, value) points, by pooling of neighbours."""
    xs, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at, weights=w)
    value = np.bincount(at, weights=w * y) / weight
    pools: list[list[float]] = []
    for i, (v, u) in enumerate(zip(value.tolist(), weight.tolist(), strict=True)):
        pools.append([v, u, i])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, u2, _ = pools.pop()
            v1, u1, first = pools.pop()
            pools.append([(v1 * u1 + v2 * u2) / (u1 + u2), u1 + u2, first])
    fitted = np.concatenate([np.full(int(b) - int(a), v) for (v, _, a), b in zip(pools, [*[p[2] for p in pools[1:]], len(xs)], strict=True)]) if len(xs) else value
    return xs, fitted


class Index:
    """Examples as (doc_id, toxic, term counts), and the share of toxic rows among all labelled ones."""

    def __init__(self, examples: list[tuple[int, int, dict[str, int]]], share: float, terms: list[str], have: np.ndarray, n_docs: int, k: int = NEIGHBOURS, chi_squared: float = CHI_SQUARED):
        """terms: all terms of the examples; have: how many of the n_docs documents have them."""
        self.k, self.share = k, share
        n, toxic = len(examples), sum(t for _, t, _ in examples)
        self.trained = 0 < toxic < n
        if not self.trained:
            return
        self.terms = terms
        self.term_no = {t: i for i, t in enumerate(self.terms)}
        chi = dependence(examples, self.term_no)
        self.idf = (np.log((1 + n_docs) / (1 + have)) + 1) * (LEAST_FACTOR + (1 - LEAST_FACTOR) * np.minimum(chi / chi_squared, 1))
        vectors = [self.vector(c) for _, _, c in examples]
        # examples whose heaviest terms agree lie together, which keeps the blocks' bounds low
        order = sorted(range(n), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, examples[i][0]))
        self.doc_ids = np.array([examples[i][0] for i in order], np.int64)
        self.toxic = np.array([examples[i][1] for i in order], np.int64)
        vectors = [vectors[i] for i in order]
        self._post(vectors)
        class_weight = np.where(self.toxic == 1, share / toxic, (1 - share) / (n - toxic))
        votes = np.full(n, -1.0)
        for i in range(0, n, SCORED_ROWS):
            some = range(i, min(n, i + SCORED_ROWS))
            row = np.repeat(np.arange(len(some)), [len(vectors[j][0]) for j in some])
            cosine, example = self._search(row, np.concatenate([vectors[j][0] for j in some]), np.concatenate([vectors[j][1] for j in some]), np.array(some))
            votes[i : i + SCORED_ROWS] = self._votes(cosine, example)
        blank = np.array([len(v[0]) == 0 for v in vectors])
        # one toxic and one clean example's weight keep shares off 0 and 1
        low = lambda own: float((class_weight[own & (self.toxic == 1)].sum() + share / n) / (class_weight[own].sum() + 1 / n))
        self.blank_score = min(1.0, max(0.0, low(blank)))
        self.x, self.y = isotonic(votes[~blank], self.toxic[~blank].astype(float), class_weight[~blank]) if (~blank).any() else (np.array([0.0]), np.array([share]))
        self.y = ((self.y * n + share) / (n + 1)).clip(0, 1)

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(known terms, weights) of a text, rising by term."""
        found = sorted((no, c) for t, c in counts.items() if (no := self.term_no.get(t)) is not None)
        row = np.zeros(len(found), np.int64)
        return self._weighted(row, np.array([no for no, _ in found], np.int64), np.array([c for _, c in found], float))

    def _weighted(self, row: np.ndarray, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(times)) * self.idf[term]
        return term, weight / np.sqrt(np.bincount(row, weights=weight**2))[row]

    def _post(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Postings sorted by term, block and example."""
        self.blocks = -(-len(vectors) // BLOCK)
        term = np.concatenate([t for t, _ in vectors])
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors])
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype(np.int32), weight[order]
        self.postings = np.bincount(term, minlength=len(self.terms)).astype(np.int32)
        self._derive()

    def _derive(self) -> None:
        """What follows from the postings: the cells of terms and blocks with their largest weights, and full rows for frequent terms."""
        term = np.repeat(np.arange(len(self.terms)), self.postings)
        cell = term * self.blocks + self.example // BLOCK
        self.cell_at = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))  # where each cell's postings begin
        self.cell_size = np.diff(self.cell_at)
        self.cell = cell[self.cell_at[:-1]]
        self.cell_block = self.cell % self.blocks
        self.cell_most = np.maximum.reduceat(self.weight, self.cell_at[:-1]) if len(cell) else np.zeros(0)
        self.cells_of = np.searchsorted(self.cell, np.arange(len(self.terms) + 1) * self.blocks)
        frequent = np.flatnonzero(self.postings > FULL_SHARE * len(self.toxic))
        self.row_of = np.full(len(self.terms), -1)
        self.row_of[frequent] = np.arange(len(frequent))
        self.full, self.full_most = np.zeros((len(frequent), len(self.toxic))), np.zeros((len(frequent), self.blocks))
        own = self.row_of[term] >= 0
        self.full[self.row_of[term[own]], self.example[own]] = self.weight[own]
        own = self.row_of[self.cell // self.blocks] >= 0
        self.full_most[self.row_of[self.cell[own] // self.blocks], self.cell_block[own]] = self.cell_most[own]

    @property
    def start(self) -> np.ndarray:
        """Where the postings of each term and block begin, as one row for all terms."""
        return np.append(self.cell_at[np.searchsorted(self.cell, np.arange(len(self.terms) * self.blocks))], len(self.example))

    def __getstate__(self) -> dict:
        """Executors get the postings alone; the rest is several times their size."""
        return {k: v for k, v in self.__dict__.items() if k in ("k", "share", "trained", "terms", "idf", "doc_ids", "toxic", "blocks", "example", "weight", "postings", "blank_score", "x", "y")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.trained:
            self.term_no = {t: i for i, t in enumerate(self.terms)}
            self._derive()

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], leave_out: int = -1) -> list[tuple[float, int]]:
        """The k examples of the largest cosine above 0, as (cosine, example), best first."""
        cosine, example = self._search(np.zeros(len(vector[0]), np.int64), *vector, np.array([leave_out]))
        return [(c, i) for c, i in zip(cosine[0].tolist(), example[0].tolist(), strict=True) if c > 0]

    def _search(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, leave_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples) of the k nearest of each text, best first, cosine 0 where there are fewer; leave_out: an example each that doesn't count, or -1."""
        n, blocks = len(leave_out), self.blocks
        at = self.row_of[term]
        often, rare = at >= 0, at < 0
        full = np.zeros((n, len(self.full)))
        full[row[often], at[often]] = weight[often]
        size = self.cells_of[term[rare] + 1] - self.cells_of[term[rare]]
        cells = gathered(self.cells_of[term[rare]], size)
        cell_row, cell_weight, block = np.repeat(row[rare], size), np.repeat(weight[rare], size), self.cell_block[cells]
        bound = full @ self.full_most + np.bincount(cell_row * blocks + block, weights=cell_weight * self.cell_most[cells], minlength=n * blocks).reshape(n, blocks)
        first = np.zeros((n, blocks), bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        score, least = np.zeros((n, len(self.toxic))), np.zeros(n)
        own = np.flatnonzero(leave_out >= 0)
        # what can't hold one of the nearest is left out
        for need in (first, ~first):
            need = need & (bound > 0) & (bound >= least[:, None] - 1e-12)
            some = need[cell_row, block]
            found = self.cell_size[cells[some]]
            posts = gathered(self.cell_at[cells[some]], found)
            place = np.repeat(cell_row[some] * len(self.toxic), found) + self.example[posts]
            score += np.bincount(place, weights=np.repeat(cell_weight[some], found) * self.weight[posts], minlength=score.size).reshape(score.shape)
            for b in np.flatnonzero(need.any(axis=0)).tolist() if len(self.full) else ():
                rows = np.flatnonzero(need[:, b])
                score[rows, b * BLOCK : (b + 1) * BLOCK] += full[rows] @ self.full[:, b * BLOCK : (b + 1) * BLOCK]
            score[own, leave_out[own]] = 0
            if self.k <= score.shape[1]:
                least = np.partition(score, -self.k, axis=1)[:, -self.k]
        rounded = np.round(score, 12)
        r, e = np.nonzero((rounded > 0) & (rounded >= np.round(least, 12)[:, None]))
        order = np.lexsort((e, -rounded[r, e], r))
        r, e = r[order], e[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        r, e, rank = r[rank < self.k], e[rank < self.k], rank[rank < self.k]
        cosine, example = np.zeros((n, self.k)), np.zeros((n, self.k), np.int64)
        cosine[r, rank], example[r, rank] = rounded[r, e], e
        return cosine, example

    def _votes(self, cosine: np.ndarray, example: np.ndarray) -> np.ndarray:
        square = cosine**2
        return ((square * self.toxic[example]).sum(axis=1) + PRIOR_VOTES * self.share) / (square.sum(axis=1) + PRIOR_VOTES)

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        """Each text's (calibrated score, voters)."""
        if not self.trained:
            return [(self.share, [])] * len(texts)
        row, term, times = batch_counts(texts, self.term_no)
        cosine, example = self._search(row, *self._weighted(row, term, times), np.full(len(texts), -1))
        value = np.where(cosine[:, 0] > 0, np.interp(self._votes(cosine, example), self.x, self.y), self.blank_score)
        ids, toxic = self.doc_ids[example].tolist(), self.toxic[example].tolist()
        evidence = [[{"doc_id": i, "toxic": t, "cosine": min(1.0, c)} for c, i, t in zip(*own, strict=True) if c > 0] for own in zip(cosine.tolist(), ids, toxic, strict=True)]
        return list(zip(value.tolist(), evidence, strict=True))

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        return self.scores([text])[0]


def dependence(examples: list[tuple[int, int, dict[str, int]]], term_no: dict[str, int]) -> np.ndarray:
    """Chi-squared of each term's presence against the label; 0 for terms of all examples."""
    n, t = float(len(examples)), float(sum(toxic for _, toxic, _ in examples))
    have, hit = np.zeros(len(term_no)), np.zeros(len(term_no))
    for _, toxic, counts in examples:
        own = [term_no[x] for x in counts]
        have[own] += 1
        hit[own] += toxic
    gap = hit * (n - t) - (have - hit) * t
    below = t * (n - t) * have * (n - have)
    return np.divide(n * gap * gap, below, out=np.zeros_like(gap), where=below > 0)


def document_counts(docs: DataFrame, terms: list[str], text_col: str = "text") -> tuple[np.ndarray, int]:
    """(how many documents have each of the terms, how many documents there are); counted in each task, then added."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value
        have, n = np.zeros(len(number) + 1, np.int64), 0
        for pdf in batches:
            texts = list(pdf["text"])
            for lo, hi in chunks(texts, BATCH_CHARS):
                have[:-1] += np.bincount(batch_counts(texts[lo:hi], number)[1], minlength=len(number))[: len(number)]
            n += len(pdf)
        have[-1] = n
        found = np.flatnonzero(have)
        yield pd.DataFrame({"term": found, "have": have[found]})

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInPandas(tally, "term long, have long").groupBy("term").agg(F.sum("have").alias("have")).collect()
    have = np.zeros(len(terms) + 1, np.int64)
    for r in rows:
        have[r.term] = r.have
    return have[:-1], int(have[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Index:
    """An index of a bounded sample of the labelled rows that may be learned from: crc32 of the id as text, mod 5, isn't 0.

    A document with several labels counts as toxic if one of them is 1; labels other than 0 and 1 are left out.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (id_bucket(F.col(id_col), 5) != 0))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("toxic"))
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    chosen = [r for t in (0, 1) for r in known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not chosen:
        return Index([], share, [], np.zeros(0), 0)
    # at most 2 * per_class rows of two numbers, and one text for each
    small = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "doc_id long, toxic int"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).join(small, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [term_counts(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "terms": [list(c) for c in found], "counts": [list(c.values()) for c in found]})

    examples = written(texts.mapInPandas(terms, "doc_id long, toxic int, terms array<string>, counts array<int>"), "examples")
    rows = [(r.doc_id, r.toxic, dict(zip(map(sys.intern, r.terms), r.counts, strict=True))) for r in examples.toLocalIterator()]
    rows.sort(key=lambda r: r[0])
    known_terms = sorted({t for _, _, counts in rows for t in counts})
    return Index(rows, share, known_terms, *document_counts(docs, known_terms, text_col), **options)


def scorer(docs: DataFrame, index: Index):
    """A function of a text column: (score, evidence)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(SCORED)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch)
            for lo, hi in chunks(texts, BATCH_CHARS, SCORED_ROWS):
                yield pd.DataFrame(shared.value.scores(texts[lo:hi]), columns=SCORED.names)
            if not texts:
                yield pd.DataFrame([], columns=SCORED.names)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row."""
    score = scorer(docs, fit(docs, labels, id_col=id_col, text_col=text_col, **options))
    out = docs.select(F.col(id_col).alias("doc_id"), (id_bucket(F.col(id_col), 5) == 0).alias("held_out"), score(F.col(f"`{text_col}`").cast("string")).alias("s"))
    return out.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.evidence")
