"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

Each text is cut by the vocabulary's pattern into pieces; the ids of a piece come from a segment tree whose
leaves are the ranks of adjacent pairs. The root names the lowest rank, leftmost among equals; a merge
changes three leaves, each in logarithmic time, until no pair can be merged. A long text without white
space therefore costs n log n. Pieces recur, so each Python worker keeps a bounded cache of their ids.

The stage is narrow: one scan of (doc_id, text), no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.textscan import int_list
from tessera.session import bound_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file larger than this isn't broadcast.
VOCABULARY_BYTES = 64 << 20
CACHED_PIECES, CACHED_LENGTH = 100_000, 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece. Keys in the tree are rank * size + position, so that the least is the leftmost."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    none = (1 << 40) * size
    tree = [none] * (2 * size)
    ends = list(range(1, n + 1))  # of the token that begins at a place
    before = list(range(-1, n - 1))  # where the token before it begins
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(at: int, key: int) -> None:
        k = size + at
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    def pair(at: int) -> int:
        nxt = ends[at]
        rank = ranks.get(piece[at : ends[nxt]]) if nxt < n else None
        return none if rank is None else rank * size + at

    while (top := tree[1]) < none:
        i = top % size
        j = ends[i]
        ends[i] = ends[j]
        if ends[i] < n:
            before[ends[i]] = i
        put(j, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return ids


class Encoder:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        self.ranks = read_ranks(vocabulary)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts have none."""
        ids: list[int] = []
        if not text:
            return ids
        known, extend = self.known, ids.extend
        for piece in self.find(text):
            of = known.get(piece)
            if of is None:
                of = encode_piece(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= CACHED_LENGTH:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = of
            extend(of)
        return ids


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) for each row of ``documents`` (doc_id, text; other columns are ignored).

    Null and empty texts give an empty list, blank texts are encoded as they are, strings that look like
    special tokens are ordinary text. Repeated rows give repeated rows; an empty table gives no row.
    ``vocabulary`` is a path that the driver reads; the file is broadcast behind a check of its size.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    data = Path(vocabulary).read_bytes()
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has {len(data)} bytes, more than {VOCABULARY_BYTES}")
    sent = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, pattern)
        for batch in batches:
            lists = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int64)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            values = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), int_list(offsets, values)], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")
