"""Word BPE encoding and decoding by a pair occurrence index.

Each batch of a partition lists the distinct words of its new pieces as one row of symbols. An index maps every mergeable
pair to all its positions; the active ranks are applied in ascending order, each to all its positions at
once, and the lists of the pairs that a merge makes are updated. Stale positions are told by their symbols
when their rank comes up. A token file of the kind "lower case, split by a pattern, byte-level symbols with
an end-of-word mark" is read on the driver (its size is bounded by the vocabulary) and sent to the executors.

Null texts count as empty: no ids, an empty decoded text. Repeated rows are encoded alike; whole texts are
encoded; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import chunks, free_name, gathered

# The printable stand-ins of bytes in byte-level vocabularies keep these ranges as they are.
PRINTABLE = ((33, 126), (161, 172), (174, 255))
BATCH_CHARS = 1_000_000
KNOWN_CHARS = 1_500_000  # what a task remembers of pieces; beyond it starts afresh
ODD_SPACE = re.compile("[\x1c-\x1f]")
BEYOND_LATIN = re.compile("[\u0370-\U0010ffff]")  # below it there are no marks or capitals that need the tables here
SPECIAL = "\n"  # no word holds white space, so this marks pieces that are special tokens
# Capitals whose small forms Python's tables don't have, as (first, last, distance); a final sigma isn't told from others.
NEWER_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
LOWER = {c: c + by for first, last, by in NEWER_CAPITALS for c in range(first, last + 1)} | {ord("Σ"): "σ"}


# Letters and numbers that the regex module knows and the tokenizers library (Unicode 16) doesn't, as ranges.
NEWER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NEWER_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))


# Marks that Python's tables reorder or compose and the library's don't, as ranges.
NEWER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0),
    (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE),
    (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
NEWER_MARK = regex.compile(f"([{''.join(f'{chr(a)}-{chr(b)}' for a, b in NEWER_MARKS)}])")


def composed(text: str) -> str:
    """Normal form C with the library's tables: newer marks stay where they are and part what is around them."""
    if not NEWER_MARK.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join([part if i % 2 else unicodedata.normalize("NFC", part) for i, part in enumerate(NEWER_MARK.split(text))])


def library_pattern(pattern: str) -> regex.Pattern:
    """The split pattern with the library's classes of letters, numbers and white space."""
    less = lambda name, ranges: rf"[\p{{{name}}}--[{''.join(f'{chr(a)}-{chr(b)}' for a, b in ranges)}]]"
    return regex.compile(pattern.replace(r"\p{L}", less("L", NEWER_LETTERS)).replace(r"\p{N}", less("N", NEWER_NUMBERS)).replace(r"\s", r"\p{White_Space}"), regex.V1)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    kept = {b for lo, hi in PRINTABLE for b in range(lo, hi + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says, as arrays: merges sorted by pair, ids of bytes within and at the end of words."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        known = ["NFC", "Replace", "Lowercase"]
        plain = [n["type"] for n in spec["normalizer"]["normalizers"]] == known and [s["type"] for s in steps] == ["Split", "ByteLevel"] and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        if model["type"] != "BPE" or not plain or spec["decoder"] or any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "byte_fallback", "continuing_subword_prefix")):
            raise ValueError("this tokenizer file needs steps that are not implemented")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in [*ids.items(), *self.special.items()]:
            self.token[i] = t
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int32)
        self.last = np.array([ids[s + end] for s in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = self.left << 32 | self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.pattern = library_pattern(steps[0]["pattern"]["Regex"])
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """Runs of the normalised text that no word crosses; special tokens, found in the raw text only, alone and with a mark."""
        if not (self.split and any(s in text for s in self.special)):
            return self._plain_pieces(text)
        parts = self.split.split(text)
        return [x for part in parts for x in ([SPECIAL + part] if part in self.special else self._plain_pieces(part))]

    def _plain_pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = composed(text).translate(LOWER) if BEYOND_LATIN.search(text) else unicodedata.normalize("NFC", text)
        plain = text.lower()
        # these are white space to str.split, but not to the pattern
        return self.pattern.findall(plain) if ODD_SPACE.search(plain) else plain.split()

    def words(self, piece: str) -> list[str]:
        return [piece] if piece.startswith(SPECIAL) else self.pattern.findall(piece)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, -1 for none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(len(key), np.int64)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.by_key[at], -1) if len(self.keys) else np.full(len(key), -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        special = np.array([self.special[w[len(SPECIAL) :]] if w.startswith(SPECIAL) else -1 for w in words], np.int64)
        blobs = [b"" if s >= 0 else w.encode("utf-8", "surrogatepass") for w, s in zip(words, special.tolist(), strict=True)]
        size = np.maximum(np.fromiter(map(len, blobs), np.int64, len(blobs)), special >= 0)  # a special token takes one place
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        word = np.repeat(np.arange(len(words)), size)
        sym = np.full(total + 1, -1, np.int64)  # one place more: the mark beyond either end
        plain = special[word] < 0
        raw = np.frombuffer(b"".join(blobs), np.uint8)
        sym[:-1][plain] = self.inner[raw]
        tail = end[special < 0] - 1
        sym[tail] = self.last[np.array([b[-1] for b in blobs if b], np.int64)] if len(tail) else sym[tail]
        after, before = np.arange(1, total + 2), np.arange(-1, total)
        after[end - 1], after[-1] = total, total
        before[end - size], before = total, np.append(before, total)
        self._merge(sym, after, before)
        sym[:-1][~plain] = special[word[~plain]]
        live = sym[:-1] >= 0
        return sym[:-1][live].astype(np.uint32), np.bincount(word[live], minlength=len(words))

    def _merge(self, sym: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        """Applies all merges to linked rows of symbols, where they lie; swallowed symbols become -2."""
        nowhere = len(sym) - 1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate(([0], cut))].tolist(), np.split(at, cut) if len(cut) else [at], strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        first = np.flatnonzero(after[:-1] != nowhere)
        add(first, self.ranks(sym[first], sym[after[first]]))
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            a, b, new = self.left[r], self.right[r], self.made[r]
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[sym[at] == a]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of equal symbols every other pair is taken, from the left
                taken, last = [], -1
                for p, n in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != last:
                        taken.append(p)
                        last = n
                at = np.array(taken)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at], sym[gone] = new, -2
            after[at], before[beyond] = beyond, at
            before[nowhere] = nowhere
            left = before[at]
            both = np.concatenate((left, at))
            add(both, self.ranks(sym[both], np.concatenate((np.full(len(at), new), sym[after[at]]))))


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


class Pieces:
    """The pieces that a task has met, with their ids and decoded texts. Only new ones are split and merged, all of a chunk at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._start_afresh()

    def _start_afresh(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.chars = 0
        self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.decoded: list[str] = []

    def rows(self, texts: list) -> list[np.ndarray]:
        """The numbers of each text's pieces, good until the next call."""
        if self.chars > KNOWN_CHARS:
            self._start_afresh()
        rows = [np.fromiter(map(self.number.__getitem__, self.vocabulary.pieces(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        self._learn(list(islice(self.number, len(self.decoded), None)))
        return rows

    def _learn(self, pieces: list[str]) -> None:
        word_no: defaultdict[str, int] = defaultdict(count().__next__)
        words = [[word_no[w] for w in self.vocabulary.words(p)] for p in pieces]
        ids, size = self.vocabulary.encode_words(list(word_no))
        flat = np.fromiter(chain.from_iterable(words), np.int64)
        ids = ids[gathered((np.cumsum(size) - size)[flat], size[flat])]
        each = np.fromiter(map(len, words), np.int64, len(words))
        size = np.bincount(np.repeat(np.arange(len(words)), each), weights=size[flat], minlength=len(words)).astype(np.int64)
        tokens = [self.vocabulary.token[i] for i in ids.tolist()]
        self.decoded += [" ".join(tokens[end - n : end]) for end, n in zip(np.cumsum(size).tolist(), size.tolist(), strict=True)]
        self.ids, self.size = np.concatenate((self.ids, ids)), np.concatenate((self.size, size))
        self.start = np.cumsum(self.size) - self.size
        self.chars += sum(map(len, pieces))


def encode_batch(texts, vocabulary: Vocabulary, known: Pieces | None = None) -> Iterator[tuple[np.ndarray, str]]:
    """(token ids, decoded text) of each text. Pieces that recur, here or in earlier batches if those are given, are split and merged once."""
    texts, known = list(texts), known or Pieces(vocabulary)
    for lo, hi in chunks(texts, BATCH_CHARS):
        for row in known.rows(texts[lo:hi]):
            row = row[known.size[row] > 0]
            yield known.ids[gathered(known.start[row], known.size[row])], " ".join([known.decoded[p] for p in row.tolist()])


KINDS = {"n_tokens": LongType(), "ids": ArrayType(IntegerType()), "ids_sha256": StringType(), "decoded": StringType(), "decoded_sha256": StringType()}


def codes_column(spark: SparkSession, path: str, *fields: str):
    """A function of a text column that returns those of n_tokens, ids, decoded and the hashes that are named."""
    shared = spark.sparkContext.broadcast(load(path))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    make = {
        "n_tokens": lambda ids, text: len(ids),
        "ids": lambda ids, text: ids.astype(np.int32),
        "ids_sha256": lambda ids, text: sha(ids.astype("<u4").tobytes()),
        "decoded": lambda ids, text: text,
        "decoded_sha256": lambda ids, text: sha(text.encode()),
    }

    @F.pandas_udf(StructType([StructField(f, KINDS[f]) for f in fields]))
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Pieces(shared.value)
        for texts in batches:
            # frames of one chunk each: the results of a whole batch aren't held at once
            texts = list(texts)
            for lo, hi in chunks(texts, BATCH_CHARS):
                rows = [[make[f](ids, text) for f in fields] for ids, text in encode_batch(texts[lo:hi], shared.value, known)]
                yield pd.DataFrame(dict(zip(fields, map(list, zip(*rows, strict=True)), strict=True)))
            if not texts:
                yield pd.DataFrame({f: [] for f in fields})

    return codes


def encode_decode(docs: DataFrame, path: str, *fields: str, text_col: str = "text") -> DataFrame:
    """docs with the named results of each whole text's coding; a column that has such a name is replaced."""
    at = free_name(docs, "_codes")
    out = docs.withColumn(at, codes_column(docs.sparkSession, path, *fields)(F.col(f"`{text_col}`").cast("string")))
    return out.withColumns({f: F.col(f"{at}.{f}") for f in fields}).drop(at)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    codes = codes_column(docs.sparkSession, path, "n_tokens", "ids_sha256", "decoded_sha256")
    return docs.select(F.col(id_col).alias("doc_id"), codes(F.col(text_col).cast("string")).alias("c")).select("doc_id", "c.*")
