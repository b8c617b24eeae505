"""Byte-level BPE encoding of a whole corpus.

Text is cut into pieces by the vocabulary's public pattern; each piece is
merged with a segment tree over its byte positions. A tree node keeps the
leftmost minimum pair rank of its span, so every merge is one read of the root
and a few logarithmic point updates at the merged position's live neighbours:
a piece of n bytes costs O(n log n), also where a text is one enormous piece.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.environ.get("PATHLOOM_BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the public pattern that goes with the vocabulary.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces longer than this are not remembered; beyond this many remembered pieces a worker forgets all of them.
CACHE_PIECE_CHARS, CACHE_PIECES = 48, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece, by lowest pair rank first, leftmost on ties."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    width = 1 << (n - 1).bit_length()
    none = len(ranks) * width + width  # above every key
    right = list(range(1, n + 1))  # start of the next live symbol, n at the end
    left = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    tree = [none] * (2 * width)

    def key(i: int) -> int:
        j = right[i]
        if j >= n:
            return none
        rank = ranks.get(piece[i : end[j]])
        return none if rank is None else rank * width + i

    for i in range(n - 1):
        tree[width + i] = key(i)
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a <= b else b

    def put(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a <= b else b
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    while tree[1] < none:
        i = tree[1] % width
        j = right[i]
        end[i] = end[j]
        right[i] = k = right[j]
        if k < n:
            left[k] = i
        put(j, none)
        put(i, key(i))
        if left[i] >= 0:
            put(left[i], key(left[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


class Encoder:
    """Encodes texts with one vocabulary; remembers the ids of short pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cut = regex.compile(PIECE_PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; the empty list for null and for empty texts."""
        if not text:
            return []
        known, missing = self.known, []
        pieces = self.cut(text)
        for p in set(pieces):
            if p not in known:
                missing.append(p)
        long: dict[str, tuple[int, ...]] = {}
        for p in missing:
            ids = tuple(merge_piece(p.encode("utf-8", "surrogatepass"), self.ranks))
            (known if len(p) <= CACHE_PIECE_CHARS else long)[p] = ids
        get = known.__getitem__ if not long else (lambda p: long[p] if p in long else known[p])
        ids = list(chain.from_iterable(map(get, pieces)))
        if len(known) > CACHE_PIECES:
            known.clear()
        return ids


def encode_corpus(
    docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, ids array<int>)``, one row per input row.

    Null and empty texts give the empty list; strings that look like special
    tokens are ordinary text. Repeated rows stay repeated. Other columns, of
    whatever name, are pruned from the scan. The vocabulary (under 1 MB, read
    on the driver) is sent to the executors once; it does not grow with data.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            flat, offsets = [], np.zeros(len(texts) + 1, dtype=np.int64)
            for k, text in enumerate(texts):
                flat.extend(encoder.encode(text))
                offsets[k + 1] = len(flat)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["key", "ids"])

    out = docs.select(F.col(id_col).alias("key"), F.col(text_col)).mapInArrow(run, f"key {id_type}, ids array<int>")
    return out.withColumnRenamed("key", id_col)
