"""Benchmark decontamination by CGK embeddings and bit-sampling LSH, with exact edit verification.

Texts are sequences of words (runs of letters, digits and underscores, lower-cased). A benchmark item leaks
into a document if some run of the document's words has a word edit distance of at most ``1 - similarity``
times the item's length from it.

The CGK walk reads a sequence with a pointer that advances, after each step, by a random bit that depends on
the step and on the word read; sequences at a small edit distance get outputs at a small Hamming distance.
Items of about one length form a class. Windows of that size start at every ``stride``-th word of a document,
counted from its first, or closer where the class has shorter items, so that a copy of any item holds a start;
of the items, the suffixes from each of the first ``stride`` words are embedded too, so that one of them lies
flush with a window. Each repetition has a walk and a few sampled steps of its own; the words put out there
are the bucket key. Repetitions are added until copies of the items with as many random edits as are allowed
meet their item in at least ``recall`` of the cases; a class that misses that after ``MOST_REPETITIONS`` has all
its items aligned at all windows. Walks stray from each other as they get longer, so items of more than
``LONGEST`` words are looked for by pieces of about equal length: of an item's edits, some piece has no more
than its share. A walk's steps follow from a hash of step and word, so no tables are kept. Windows that hold too
few of the items' word trigrams to be within the distance (by the q-gram lemma, so without loss) aren't
embedded. Where an item and a window meet, the whole item is aligned with the words around by Myers' bit-vector
algorithm, which is exact.

The benchmark is taken in blocks of at most ``block_chars`` characters (or one item); each block has its own
index and its own job over the documents, so neither driver nor executors hold more than a block.

Items without words are left out. Null and empty texts hold no item. Whole texts are searched; items that
repeat each other are all reported. With an empty benchmark nothing is found. Other columns play no part.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from .common import chunks, free_name, written

SIMILARITY, RECALL, STRIDE, SAMPLES, MOST_REPETITIONS, LONGEST, BLOCK_CHARS, SEED = 0.8, 0.99, 4, 2, 64, 128, 4_000_000, 20
BATCH_CHARS = 2_000_000
WORD = re.compile(r"\w+")
FILTER_BITS = 22
LEAKS = ArrayType(StructType().add("item_id", LongType()).add("distance", IntegerType()).add("similarity", DoubleType()).add("first_word", IntegerType()).add("n_words", IntegerType()))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def best_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(least edit distance between the item and any run of words, where the first such run ends)."""
    n = len(item)
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item.tolist()):
        peq[w] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(words.tolist()):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class SizeClass:
    """Pieces of about one length, with the buckets of each repetition."""

    pieces: list[int]
    shortest: int
    longest: int
    gram: int
    least_grams: int
    window: int
    stride: int
    steps: int = 0
    exact: bool = False
    salts: list[np.ndarray] = field(default_factory=list)
    sampled: list[np.ndarray] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    owners: list[np.ndarray] = field(default_factory=list)


def embed(ids: np.ndarray, starts: np.ndarray, salts: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """The bucket key of the walk from each start: a hash of the words put out at the sampled steps. salts: a random number for each step."""
    at, key = starts.copy(), np.zeros(len(starts), np.uint64)
    wanted, words, last = set(sampled.tolist()), ids.astype(np.uint64), len(ids) - 1
    for step in range(int(sampled.max()) + 1):
        w = words[np.minimum(at, last)]
        if step in wanted:
            key = (key ^ w) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        turn = (w + salts[step]) * np.uint64(0xD6E8FEB86659FD93)
        turn = (turn ^ (turn >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        at += (turn >> np.uint64(63)).astype(np.int64)
    return key


class Index:
    """A benchmark's items, ready for search. similarity is of words; recall is what the repetitions must reach."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, recall: float = RECALL, stride: int = STRIDE, samples: int = SAMPLES):
        self.vocabulary: dict[str, int] = {}
        self.similarity, self.stride = similarity, stride
        self.ids, self.words = [], []
        self.pieces, self.item_of = [], []
        for item_id, text in items:
            if words := words_of(text):
                self.ids.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
                parts = np.array_split(self.words[-1], -(-len(words) // LONGEST))
                self.pieces += parts
                self.item_of += [len(self.words) - 1] * len(parts)
        self.filters: dict[int, np.ndarray] = {}
        self.classes = []
        rng = np.random.default_rng(SEED)
        by_size = sorted(range(len(self.pieces)), key=lambda i: len(self.pieces[i]))
        while by_size:
            n = len(self.pieces[by_size[0]])
            own = [i for i in by_size if len(self.pieces[i]) <= max(n * 5 // 4, n) and (len(self.pieces[i]) >= 8) == (n >= 8)]
            by_size = by_size[len(own) :]
            self.classes.append(self._size_class(own, rng, recall, samples))
        for q in {c.gram for c in self.classes}:
            self.filters[q] = np.zeros(1 << FILTER_BITS, bool)
            for c in self.classes:
                for i in c.pieces if c.gram == q else ():
                    self.filters[q][self._gram_hash(self.pieces[i], q)] = True

    def edits(self, n: int) -> int:
        """The most edits that leave an item of n words similar enough."""
        return int((1 - self.similarity) * n + 1e-9)

    def _gram_hash(self, ids: np.ndarray, q: int) -> np.ndarray:
        h = np.zeros(max(len(ids) - q + 1, 0), np.uint64)
        for j in range(q):
            h = (h + ids[j : j + len(h)].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return h >> np.uint64(64 - FILTER_BITS)

    def _size_class(self, own: list[int], rng: np.random.Generator, recall: float, samples: int) -> SizeClass:
        sizes = [len(self.pieces[i]) for i in own]
        shared = lambda q: min(n - q + 1 - q * self.edits(n) for n in sizes)
        gram = 3 if min(sizes) >= 8 and shared(3) > 0 else 1
        c = SizeClass(own, min(sizes), max(sizes), gram, max(shared(gram), 1), max(n + self.edits(n) for n in sizes), min(self.stride, *[n - self.edits(n) for n in sizes]))
        c.steps = max(1, 3 * c.shortest // 2)
        offsets = [(i, o) for i in own for o in range(c.stride)]
        place, rows = {x: r for r, x in enumerate(offsets)}, self._rows([self.pieces[i][o:] for i, o in offsets], c.steps + 1)
        tries = [i for _ in range(max(1, 400 // len(own))) for i in own]
        copies = [self._edited(self.pieces[i], rng) for i in tries]
        met = np.zeros(len(copies), bool)
        while met.mean() < recall and len(c.keys) < MOST_REPETITIONS or not c.keys:
            sampled = np.sort(rng.choice(c.steps, min(samples, c.steps), replace=False))
            salts = rng.integers(0, 1 << 63, int(sampled.max()) + 1, np.uint64)
            keys = embed(*rows, salts, sampled)
            by_key = np.argsort(keys, kind="stable")
            c.salts.append(salts), c.sampled.append(sampled), c.keys.append(keys[by_key]), c.owners.append(np.array([i for i, _ in offsets])[by_key])
            starts = rng.integers(0, c.stride, len(copies)).tolist()
            seen = embed(*self._rows([w[o:] for w, o in zip(copies, starts, strict=True)], c.steps + 1), salts, sampled)
            for o in range(c.stride):
                met |= keys[[place[i, o] for i in tries]] == seen
        c.exact = bool(met.mean() < recall)
        return c

    @staticmethod
    def _rows(rows: list[np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(the rows one after the other, cut or filled with foreign words to that reach; where each begins)."""
        flat = np.zeros((len(rows), reach), np.int64)
        for to, r in zip(flat, rows, strict=True):
            to[: len(r)] = r[:reach]
        return flat.ravel(), np.arange(len(rows)) * reach

    def _edited(self, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The words after as many edits as are allowed: substitutions, insertions and deletions alike; what follows is foreign."""
        out = words.tolist()
        for _ in range(self.edits(len(words))):
            kind, at = int(rng.integers(0, 3)), int(rng.integers(0, len(out) or 1))
            if kind == 0 and out:
                out[at] = 0
            elif kind == 1:
                out.insert(at, 0)
            elif len(out) > 1:
                del out[at]
        return np.array(out, np.int64)

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, float, int, int]]]:
        """Of each text the items that it holds: (item id, distance, similarity, first word, words of the text's run)."""
        out: list[list[tuple[int, int, float, int, int]]] = [[] for _ in texts]
        if not self.classes:
            return out
        gap = max(c.window for c in self.classes) * 2 + 2
        known, rows, sizes = self.vocabulary.get, [], []
        for t in texts:
            words = words_of(t)
            rows.append(np.fromiter((known(w, 0) for w in words), np.int64, len(words)))
            rows.append(np.zeros(gap, np.int64))
            sizes.append(len(words))
        ids = np.concatenate(rows)
        first = np.cumsum([0] + [s + gap for s in sizes])
        flags = {}
        for q, bits in self.filters.items():
            hit = bits[self._gram_hash(ids, q)]
            for j in range(q):  # grams with a foreign word are in no item
                hit &= ids[j : j + len(hit)] > 0
            flags[q] = np.concatenate(([0], np.cumsum(hit), np.full(gap, hit.sum())))
        met: dict[tuple[int, int], list[int]] = {}
        for c in self.classes:
            # every window that overlaps a run within the distance, from its first words on, holds that many grams or begins up to a stride later
            seen = flags[c.gram]
            n_starts = -(-np.array(sizes) // c.stride)
            base = np.repeat(first[:-1], n_starts) + c.stride * (np.arange(n_starts.sum()) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts))
            lo = np.maximum(base - c.stride + 1, 0)
            starts = base[seen[np.minimum(base + c.window, len(ids))] - seen[lo] >= c.least_grams]
            if not len(starts):
                continue
            text_of = np.searchsorted(first, starts, side="right") - 1
            if c.exact:
                for t, at in zip(text_of.tolist(), starts.tolist(), strict=True):
                    for i in {self.item_of[p] for p in c.pieces}:
                        met.setdefault((t, i), []).append(at)
                continue
            for salts, sampled, keys, owners in zip(c.salts, c.sampled, c.keys, c.owners, strict=True):
                key = embed(ids, starts, salts, sampled)
                a, b = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
                for w in np.flatnonzero(b > a).tolist():
                    for i in {self.item_of[p] for p in owners[a[w] : b[w]].tolist()}:
                        met.setdefault((int(text_of[w]), i), []).append(int(starts[w]))
        for (t, i), at in met.items():
            item = self.words[i]
            n, end = len(item), int(first[t]) + sizes[t]
            best = None
            for lo, hi in self._regions(sorted(set(at)), 2 * n + self.stride, int(first[t]), end):
                distance, stop = best_match(item, ids[lo:hi])
                if distance <= self.edits(n) and (best is None or distance < best[0]):
                    back, size = best_match(item[::-1], ids[lo : lo + stop][::-1])
                    best = (distance, lo + stop - size - int(first[t]), size)
            if best:
                out[t].append((self.ids[i], best[0], 1 - best[0] / n, best[1], best[2]))
        for found in out:
            found.sort(key=lambda m: (m[0] is not None, m[0] or 0, *m[1:]))
        return out

    @staticmethod
    def _regions(at: list[int], reach: int, first: int, end: int) -> Iterator[tuple[int, int]]:
        """Runs of words around the places, merged where they touch."""
        lo = hi = None
        for p in at:
            a, b = max(first, p - reach), min(end, p + reach)
            if hi is not None and a <= hi:
                hi = b
            else:
                if hi is not None:
                    yield lo, hi
                lo, hi = a, b
        if hi is not None:
            yield lo, hi


def searches(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, **options) -> Iterator:
    """(a function of a text column, whether more come) for each block of items, made when it is asked for; the block before is given up then."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars)
    for b in range(blocks):
        rows = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).sort("item_id", "text").collect()]
        if rows:
            shared = spark.sparkContext.broadcast(Index(rows, **options))
            yield _search_column(shared), b + 1 < blocks
            if b + 1 < blocks:
                shared.unpersist()


def _search_column(shared):
    @F.pandas_udf(LEAKS)
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = LEAKS.elementType.names
        for batch in batches:
            texts = list(batch)
            rows = [r for lo, hi in chunks(texts, BATCH_CHARS) for r in shared.value.search(texts[lo:hi])]
            yield pd.Series([[dict(zip(names, m, strict=True)) for m in r] for r in rows], index=batch.index, dtype=object)

    return leaks


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, distance, similarity, first_word, n_words) of each item that a document holds. Blocks but the last are searched and stored at once."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = []
    for search, more in searches(benchmark, **options):
        part = own.select("doc_id", F.explode(search("text")).alias("leak")).select("doc_id", "leak.*")
        found.append(written(part, "leaks") if more else part)
    none = own.limit(0).select("doc_id", F.explode(F.array().cast(LEAKS)).alias("leak")).select("doc_id", "leak.*")
    return reduce(DataFrame.unionByName, found) if found else none


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay as they are, whatever their names."""
    name = free_name(docs, "_leaks")
    for search, more in searches(benchmark, **options):
        docs = docs.withColumn(name, F.size(search(F.col(f"`{text_col}`").cast("string")))).where(F.col(name) == 0).drop(name)
        docs = written(docs, "leak_free") if more else docs
    return docs
