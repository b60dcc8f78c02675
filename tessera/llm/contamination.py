"""Problem 8: passages of evaluation items inside a corpus.

A document holds an item when at least ``RUN`` consecutive words of its text are consecutive words of the
item's prompt or of its reference answer. The patterns are all windows of ``RUN`` words of the items, all of
one length, so Wu-Manber search works on words as its alphabet: blocks of two words index a shift table, an
unknown block skips RUN - 1 words at once, a block that ends a pattern selects its patterns by a hash of the window
(its prefix with the block), and direct comparison of the words confirms. So the time at a place doesn't grow with the number of
items that end in the same words.

Words are numbered by the items' vocabulary. The tables are sorted arrays, built once on the driver for a block of items of
a checked size and broadcast; about 5 bytes for each character of the items reach a worker. The corpus is scanned once for each
block of items, narrow, without a shuffle, so any number of items works.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textscan import mix, words
from tessera.session import bound_batches

RUN = 12
#: Characters of items that one scan searches for; more items take more scans.
BLOCK_CHARS = 8 << 20


class WuManber:
    """Search for all windows of ``run`` words of ``items`` (id, text)."""

    def __init__(self, items: Iterable[tuple[int, str | None]], run: int = RUN) -> None:
        self.run = run
        self.number: dict[str, int] = {}  # of each word of the items, from 1
        numbered, ids, lengths = self.number, [], []
        flat: list[np.ndarray] = [np.zeros(0, np.int32)]
        for item, text in items:
            ws = words(text)
            if len(ws) >= run:
                flat.append(np.fromiter((numbered.setdefault(w, len(numbered) + 1) for w in ws), np.int32, len(ws)))
                ids.append(item)
                lengths.append(len(ws))
        self.words = np.concatenate(flat)
        size = np.array(lengths, dtype=np.int64)
        start = np.cumsum(size) - size
        windows = size - run + 1
        first = np.repeat(start, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        owner = np.repeat(np.array(ids, dtype=np.int64), windows)
        # shift table: the least distance of a block from the end of a window that has it; all but the first windows' blocks end one
        inside = np.arange(len(self.words)) - np.repeat(start, size)
        ends = np.flatnonzero(inside)
        block, shift = self._block(self.words, ends - 1), np.maximum(run - 1 - inside[ends], 0).astype(np.uint8)
        order = np.lexsort((shift, block))
        block, shift = block[order], shift[order]
        least = np.r_[True, block[1:] != block[:-1]] if len(block) else np.zeros(0, bool)
        self.blocks, self.shifts = block[least], shift[least]
        # windows by hash, each once an item
        key = self._hash(self.words, first)
        order = np.lexsort((owner, key))
        key, owner, first = key[order], owner[order], first[order]
        again = np.zeros(len(key), dtype=bool)
        if len(key):
            again[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
            near = np.flatnonzero(again)
            same = np.ones(len(near), dtype=bool)
            for k in range(run):
                same &= self.words[first[near] + k] == self.words[first[near - 1] + k]
            again[near] = same
        self.keys, self.owners, self.firsts = key[~again], owner[~again], first[~again].astype(np.int32 if len(self.words) < 1 << 31 else np.int64)

    @staticmethod
    def _block(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (numbers[at].astype(np.int64) << 32) | numbers[at + 1]

    def _hash(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A hash of the window that begins at each place."""
        total = np.zeros(len(first), dtype=np.uint64)
        for k in range(self.run):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + numbers[first + k].astype(np.uint64))
        return total

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a text's index and an item that shares a run with it, each once."""
        run, get = self.run, self.number.get
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.keys):
            return none
        lists = [words(t) for t in texts]
        ends = np.cumsum([len(ws) for ws in lists])
        n = int(ends[-1]) if len(ends) else 0
        if n < run:
            return none
        numbers = np.fromiter((get(w, 0) for ws in lists for w in ws), np.int32, n)
        # the shift at each place, as far as its block is known
        known = np.flatnonzero((numbers[1:] > 0) & (numbers[:-1] > 0)) + 1
        block = self._block(numbers, known - 1)
        spot = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
        hit = self.blocks[spot] == block
        shift = np.full(n, run - 1, dtype=np.uint8)
        shift[known[hit]] = self.shifts[spot[hit]]
        steps, ended = shift.tobytes(), []
        begin = 0
        for end in ends.tolist():
            at = begin + run - 1
            while at < end:
                skip = steps[at]
                if skip:
                    at += skip
                else:
                    ended.append(at)
                    at += 1
            begin = end
        first = np.array(ended, dtype=np.int64) - (run - 1)
        key = self._hash(numbers, first)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        count = high - low
        place = np.repeat(first, count)
        entry = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        same = np.ones(len(place), dtype=bool)
        for k in range(run):
            same &= numbers[place + k] == self.words[self.firsts[entry] + k]
        text, item = np.searchsorted(ends, place[same], "right"), self.owners[entry[same]]
        pairs = np.unique(np.stack([text, item]), axis=1)
        return pairs[0], pairs[1]


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    """The texts of the items, a block of bounded size at a time."""
    size = F.coalesce(F.length("prompt"), F.lit(0)) + F.coalesce(F.length("reference_answer"), F.lit(0))
    chars = items.agg(F.sum(size)).first()[0] or 0
    n = -(-2 * chars // block_chars) if chars > block_chars else 1  # twice, as hashed blocks differ in size
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        rows = part.collect()
        yield [(r[0], r[i]) for r in rows if r[0] is not None for i in (1, 2)]


def leaked(documents: DataFrame, eval_items: DataFrame, run: int = RUN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id), one row for each document and item that share ``run`` consecutive words.

    Null, empty and short texts share none; prompt and answer aren't joined; items that share a run each
    count; documents repeated under several ids each count; rows with equal doc_id give equal rows once
    for each of them. Empty tables give no row. Other columns are ignored.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull())

    def scan(items: list[tuple[int, str | None]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(WuManber(items, run))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = sent.value
            for batch in batches:
                text, item = machine.search(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(item)], ["doc_id", "item_id"])

        return docs.mapInArrow(search, "doc_id bigint, item_id bigint")

    items = eval_items.select("item_id", "prompt", "reference_answer")
    return reduce(DataFrame.unionByName, [scan(block) for block in _blocks(items, block_chars)])
