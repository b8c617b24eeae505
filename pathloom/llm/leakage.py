"""Evaluation texts that occur, in full or in part, in a training corpus.

Every window of ``PASSAGE_WORDS`` consecutive words, of items and of documents
alike, gets a 64-bit SimHash. The item windows form an index of ``radius + 1``
Hamming blocks: two fingerprints at most ``radius`` bits apart agree in at
least one block, so block look-ups find every pair within the radius, and equal
windows are always among them. Each candidate is then verified exactly on its
weighted word shingles. The corpus is scanned once per slice of the item set
and nothing of it is shuffled but the found pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE_WORDS = 12
#: Bits two fingerprints may differ in: of equal windows none; of windows alike to 0.8 nearly all are within ``NEAR_RADIUS``.
RADIUS, NEAR_RADIUS = 3, 8
SHINGLE_WORDS = 5
#: Bytes of index held at once, and what an item's word takes in it at most. A larger item set is searched in slices of
#: this size, each with a pass of its own.
SLICE_BYTES, WORD_BYTES = 64 << 20, 64
#: Word positions fingerprinted at once, and remembered words of a worker.
CHUNK_WORDS, VOCABULARY_WORDS = 1 << 15, 500_000

_WORD = re.compile(r"[^\W_]+")
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def words(text: str | None) -> list[str]:
    """Longest runs of Unicode letters and digits, each in lower case."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


class Vocabulary:
    """Number of each word and the +1/-1 vector of its hash bits, one row per number."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.signs = np.empty((1024, 64), dtype=np.int16)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        known = self.number
        fresh = [w for w in dict.fromkeys(tokens) if w not in known]
        if fresh:
            start = len(known)
            known.update(zip(fresh, range(start, start + len(fresh))))
            if len(known) > len(self.signs):
                grown = np.empty((max(len(known), 2 * len(self.signs)), 64), dtype=np.int16)
                grown[:start] = self.signs[:start]
                self.signs = grown
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in fresh], dtype=np.uint64)
            self.signs[start : start + len(fresh)] = np.where(hashes[:, None] & _POWERS != 0, 1, -1)
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.int32, count=len(tokens))


def simhashes(signs: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each run of ``window`` rows of ``signs``: the sign of the summed word vectors, bit by bit."""
    sums = np.zeros((len(signs) + 1, 64), dtype=np.int16)
    np.cumsum(signs, axis=0, out=sums[1:])  # wraps around, differences stay right
    bits = (sums[window:] - sums[:-window]) > 0
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def _hashes(numbers: np.ndarray, window: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ``window`` rows of word hashes: a polynomial in an odd factor, modulo 2**64."""
    factor = np.uint64(seed | 1)
    out = np.zeros(len(numbers) - window + 1, dtype=np.uint64)
    for k in range(window):
        out = out * factor + numbers[k : k + len(out)]
    return out


class PassageIndex:
    """Distinct windows of items by Hamming block, as arrays.

    A window takes about 50 bytes: its fingerprint, where its words stand, its
    place and value in each block and its owners; the words of the items stand
    once, as numbers of distinct words. Windows are told apart by two 64-bit
    hashes.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int, radius: int):
        self.window, self.radius = window, radius
        vocabulary = Vocabulary()
        numbers, owner, first = [], [], []
        at = 0
        for item, text in items:
            w = words(text)
            if len(w) >= window:
                numbers.append(vocabulary.numbers(w))
                owner.append(np.full(len(w) - window + 1, item, dtype=np.int64))
                first.append(np.arange(at, at + len(w) - window + 1))
                at += len(w)
        self.names = list(vocabulary.number)
        self.numbers = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int32)
        owner = np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)
        first = np.concatenate(first) if first else np.zeros(0, dtype=np.int64)
        self.texts = np.cumsum([0, *map(len, numbers)])
        self.weights: Counter | None = None
        if not len(owner):
            self.prints, self.blocks = np.zeros(0, dtype=np.uint64), []
            return
        words_ = np.array([xxhash.xxh64_intdigest(w, 1) for w in self.names], dtype=np.uint64)[self.numbers]
        one, two = (_hashes(words_, window, seed)[first] for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
        order = np.lexsort((owner, two, one))
        one, two, owner, first = one[order], two[order], owner[order], first[order]
        fresh = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        kept = fresh | np.r_[True, owner[1:] != owner[:-1]]  # an item owns a window once
        self.start = first[fresh].astype(np.int32 if at < 2**31 else np.int64)
        group = np.cumsum(fresh)[kept] - 1
        self.owned = owner[kept]
        self.offsets = np.searchsorted(group, np.arange(len(self.start) + 1)).astype(np.int64)
        # in parts that overlap by a window, so that one part's sign vectors fit in memory
        parts = (self.numbers[i : i + CHUNK_WORDS + window - 1] for i in range(0, at - window + 1, CHUNK_WORDS))
        self.prints = np.concatenate([simhashes(vocabulary.signs[part], window) for part in parts])[self.start]
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(cuts[:-1], cuts[1:]):
            mask = np.uint64((1 << int(high - low)) - 1)
            values = (self.prints >> np.uint64(low)) & mask
            order = np.argsort(values, kind="stable").astype(np.int32)
            values = values[order].astype(np.uint16 if high - low <= 16 else np.uint32 if high - low <= 32 else np.uint64)
            self.blocks.append((np.uint64(low), mask, values, order))

    def __len__(self) -> int:
        return len(self.prints)

    def owners(self, which: int) -> np.ndarray:
        return self.owned[self.offsets[which] : self.offsets[which + 1]]

    def words_of(self, which: int) -> tuple[str, ...]:
        at = self.start[which]
        return tuple(self.names[n] for n in self.numbers[at : at + self.window])

    def nbytes(self) -> int:
        """Bytes of the arrays and of the distinct words."""
        arrays = (self.numbers, self.start, self.owned, self.offsets, self.prints, *(x for b in self.blocks for x in b[2:]))
        return sum(a.nbytes for a in arrays) + sum(len(w) + 57 for w in self.names)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``prints`` and index windows within the radius of each other."""
        found_at, found = [], []
        for low, mask, values, order in self.blocks:
            own = ((prints >> low) & mask).astype(values.dtype)
            distinct, inverse = np.unique(own, return_inverse=True)
            first = np.searchsorted(values, distinct, "left")[inverse]
            count = np.searchsorted(values, distinct, "right")[inverse] - first
            hit = np.flatnonzero(count)
            reps = count[hit]
            at = np.repeat(hit, reps)
            within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            which = order[np.repeat(first[hit], reps) + within]
            near = np.bitwise_count(prints[at] ^ self.prints[which]) <= self.radius
            found_at.append(at[near])
            found.append(which[near])
        pairs = np.unique(np.stack([np.concatenate(found_at), np.concatenate(found)], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def similarity(self, own: tuple[str, ...], which: int) -> float:
        """Weighted Jaccard of the word shingles of a window and an indexed one; 1 only for equal windows.

        A shingle weighs less the more items of the index hold it.
        """
        theirs = self.words_of(which)
        if own == theirs:
            return 1.0
        if self.weights is None:
            texts = (tuple(self.names[n] for n in self.numbers[low:high]) for low, high in zip(self.texts[:-1], self.texts[1:]))
            self.weights = Counter(s for text in texts for s in set(shingles(text)))
        a, b = Counter(shingles(own)), Counter(shingles(theirs))
        weight = lambda s: 1.0 / self.weights.get(s, 1)
        both = sum(weight(s) * n for s, n in (a & b).items())
        either = sum(weight(s) * n for s, n in (a | b).items())
        return min(both / either if either else 0.0, 1.0 - 1e-9)


def shingles(w: tuple[str, ...]) -> list[tuple[str, ...]]:
    n = min(SHINGLE_WORDS, len(w))
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _search(index: PassageIndex, min_similarity: float):
    """A mapInArrow function from (document, text) to (document, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_least, vocabulary = index.value.window, Vocabulary()
        passages = index.value
        for batch in batches:
            tokens, doc_of = [], []
            texts = batch.column(1)
            for k in range(len(texts)):
                w = words(texts[k].as_py())
                if len(w) >= at_least:
                    tokens += w
                    doc_of.append((k, len(w)))
            pairs: set[tuple[int, int]] = set()
            if tokens:
                if len(vocabulary.number) > VOCABULARY_WORDS:
                    vocabulary = Vocabulary()
                docs = np.repeat(np.array([k for k, _ in doc_of]), [n for _, n in doc_of])
                numbers = vocabulary.numbers(tokens)
                for start in range(0, len(tokens) - at_least + 1, CHUNK_WORDS):
                    part = numbers[start : start + CHUNK_WORDS + at_least - 1]
                    prints = simhashes(vocabulary.signs[part], at_least)
                    first = docs[start : start + len(prints)]
                    whole = np.flatnonzero(first == docs[start + at_least - 1 : start + at_least - 1 + len(prints)])
                    at, which = passages.candidates(prints[whole])
                    for i, j in zip(whole[at].tolist(), which.tolist()):
                        doc = int(first[i])
                        fresh = [item for item in passages.owners(j).tolist() if (doc, item) not in pairs]
                        if not fresh:
                            continue
                        own = tuple(tokens[start + i : start + i + at_least])
                        if own == passages.words_of(j) or min_similarity < 1 and passages.similarity(own, j) >= min_similarity:
                            pairs.update((doc, item) for item in fresh)
            rows = sorted(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([d for d, _ in rows], pa.int64())),
                    pa.array([i for _, i in rows], pa.int64()),
                ],
                names=["doc", "item"],
            )

    return run


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = PASSAGE_WORDS,
    radius: int | None = None,
    min_similarity: float = 1.0,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Distinct ``(id_col, item_id_col)`` of documents holding ``window`` consecutive words of an item.

    Null, empty and short texts on either side give nothing; items that share
    text all come out; item ids must be integers and rows without one are
    ignored. Extra columns, clashing names included, are pruned. With
    ``min_similarity`` below 1 near-equal windows within the SimHash radius
    (``NEAR_RADIUS`` where none is given) count too. The items of one slice (an index of about ``slice_bytes``, unless
    one item alone is longer) are indexed on the driver and broadcast; more
    items mean more slices, not larger ones.
    """
    spark = docs.sparkSession
    radius = radius if radius is not None else RADIUS if min_similarity >= 1 else NEAR_RADIUS
    items = items.select(
        F.col(item_id_col).cast("long").alias("item"), F.col(item_text_col).alias("text")
    ).filter("item is not null and text is not null")
    count = F.size(F.split("text", r"[^\p{L}\p{N}]+"))
    total = items.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-int(total) * WORD_BYTES // slice_bytes))
    key_type = docs.schema[id_col].dataType.simpleString()
    corpus = docs.select(F.col(id_col).alias("doc"), F.col(text_col)).filter(F.col(text_col).isNotNull())
    found = None
    for k in range(slices):
        part = items if slices == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        index = PassageIndex([tuple(r) for r in part.collect()], window, radius)
        if not len(index):
            continue
        shared = spark.sparkContext.broadcast(index)
        hits = corpus.mapInArrow(_search(shared, min_similarity), f"doc {key_type}, item bigint")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = corpus.limit(0).select("doc", F.lit(0).cast("long").alias("item"))
    return found.distinct().select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col))
