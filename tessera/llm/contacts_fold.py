"""Problem 1: records that are identical but for white space, case, punctuation or field order.

Bytes stream through a skip-and-fold lookup table into rolling polynomial hashes, one for each field; no
canonical string is made. Field hashes are combined without regard to their order. Rows with equal
128-bit keys are grouped, and each is compared with its group's first row by two pointers that skip what
doesn't count. Rows that fail the comparison (a collision) are grouped again under another seed until none is left.

Grouping is a partial aggregate, so a group that holds a third of all rows reaches the shuffle as one row
for each task. The first row's value rides in it (a sort-based aggregate), which spares a second shuffle of all rows. The join back to
the rows touches only groups of two or more and is one that adaptive execution splits, so a large group's rows are compared by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textscan import code_points, fold_table, mix
from tessera.operators.joins import split_join
from tessera.session import bound_batches, cut

SEPARATORS = ";|"
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))  # odd, so powers never vanish


def _codes(texts: list[str], separators: str) -> tuple[np.ndarray, np.ndarray]:
    """What each character of the texts counts as, and its text's index."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return fold_table(separators)[code_points("".join(texts))], np.repeat(np.arange(len(texts)), lengths)


def field_hashes(texts: list[str], seed: int = 0, separators: str = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each non-empty field of the texts: the text's index and two rolling hashes of its folded characters."""
    code, owner = _codes(texts, separators)
    field = np.cumsum(code == 1) + owner  # differs between fields and between texts
    kept = code > 1
    code, owner, field = code[kept].astype(np.uint64), owner[kept], field[kept]
    if not len(code):
        return owner, code, code
    starts = np.flatnonzero(np.r_[True, (field[1:] != field[:-1]) | (owner[1:] != owner[:-1])])
    place = np.arange(len(code)) - np.repeat(starts, np.diff(np.r_[starts, len(code)]))
    longest = int(place.max()) + 1
    out = []
    for base in _BASES:
        powers = np.full(longest, base + np.uint64(2 * seed), dtype=np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        out.append(mix(np.add.reduceat(mix(code + np.uint64(seed)) * powers[place], starts)))
    return owner[starts], out[0], out[1]


def record_keys(texts: list[str], seed: int = 0, separators: str = SEPARATORS) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text, equal for texts with the same fields in any order; without ``separators`` a text is one field."""
    owner, a, b = field_hashes(texts, seed, separators)
    keys = []
    for h in (a, b):
        total = np.zeros(len(texts), dtype=np.uint64)
        np.add.at(total, owner, h)
        keys.append(mix(total).view(np.int64))
    return keys[0], keys[1]


def same_folded(a: str, b: str, i: int = 0, j: int = 0, end_i: int | None = None, end_j: int | None = None) -> bool:
    """Whether two stretches of text agree in their letters and digits; two pointers skip the rest."""
    table = fold_table(SEPARATORS)
    end_i = len(a) if end_i is None else end_i
    end_j = len(b) if end_j is None else end_j
    while True:
        while i < end_i and table[ord(a[i])] < 2:
            i += 1
        while j < end_j and table[ord(b[j])] < 2:
            j += 1
        if i == end_i or j == end_j:
            return i == end_i and j == end_j
        if table[ord(a[i])] != table[ord(b[j])]:
            return False
        i, j = i + 1, j + 1


def _fields(text: str) -> list[tuple[int, int]]:
    """Where the fields of a text that have letters or digits begin and end."""
    table, out, at, filled = fold_table(SEPARATORS), [], 0, False
    for k, ch in enumerate(text):
        code = table[ord(ch)]
        if code == 1:
            if filled:
                out.append((at, k))
            at, filled = k + 1, False
        elif code:
            filled = True
    return [*out, (at, len(text))] if filled else out


def same_in_order(left: list[str], right: list[str], separators: str = SEPARATORS) -> np.ndarray:
    """For each pair of texts, whether their letters, digits and separators agree in order.

    Both pointers of all pairs move at once: the places that count of one side are laid beside those of the other, pair by pair.
    """
    (a, of_a), (b, of_b) = _codes(left, separators), _codes(right, separators)
    at_a, at_b = np.flatnonzero(a), np.flatnonzero(b)
    n_a, n_b = (np.bincount(of[at], minlength=len(left)) for of, at in ((of_a, at_a), (of_b, at_b)))
    same = n_a == n_b
    at_a, at_b = at_a[same[of_a[at_a]]], at_b[same[of_b[at_b]]]
    same[of_a[at_a[a[at_a] != b[at_b]]]] = False
    return same


def same_record(a: str, b: str) -> bool:
    """Whether two values have the same fields in any order: each field of one is matched with one of equal hash of the other."""
    if a == b:
        return True
    left, right = _fields(a), _fields(b)
    if len(left) != len(right):
        return False
    owner, h, _ = field_hashes([a, b])
    of_left, of_right = h[owner == 0].tolist(), h[owner == 1].tolist()
    candidates: dict[int, list[tuple[int, int]]] = {}
    for key, place in zip(of_right, right):
        candidates.setdefault(key, []).append(place)
    for key, (i, end_i) in zip(of_left, left):
        places = candidates.get(key, [])
        found = next((k for k, (j, end_j) in enumerate(places) if same_folded(a, b, i, j, end_i, end_j)), None)
        if found is None:
            return False
        places.pop(found)
    return True


_KEYED = "id bigint, scope string, kind string, value string, k0 bigint, v0 bigint, v1 bigint"


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (id, scope, kind, value) with the keys of kind, as one field, and of value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, _ = record_keys(batch.column(2).to_pylist(), seed, "")
            v0, v1 = record_keys(batch.column(3).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kind), pa.array(v0), pa.array(v1)], names=["id", "scope", "kind", "value", "k0", "v0", "v1"])

    return rows.select("id", "scope", "kind", "value").mapInArrow(run, _KEYED)


def _verified(pairs: DataFrame) -> DataFrame:
    """(first_id, copy_id, same) of pairs of rows with equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, va, kb, vb = (c.to_pylist() for c in batch.columns[2:])
            same = same_in_order(va, vb)
            for i in np.flatnonzero(~same):  # fields in another order, or empty ones between them
                same[i] = same_record(va[i], vb[i])
            same &= same_in_order(ka, kb, "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], names=["first_id", "copy_id", "same"])

    return pairs.select("first_id", "copy_id", "first_kind", "first_value", "kind", "value").mapInArrow(run, "first_id bigint, copy_id bigint, same boolean")


_KEY = ["scope", "k0", "v0", "v1"]


def copies(rows: DataFrame, seed: int = 0, rounds: int = 8) -> DataFrame:
    """(first_id, copy_id) for each row but the first of its group, by smallest id.

    ``rows`` has id, scope, kind and value; rows with a null in any of them take no part. Two rows are
    copies when scope is equal, kind agrees in its letters and digits, and value has the same fields in any
    order, each compared by letters and digits in lower case; empty fields don't count. Ids are unique.
    Rows that collide under one seed are grouped among themselves under the next. Keyed rows are written down once, as grouping
    and joining both read them.
    """
    bound_batches(rows.sparkSession)
    rows = rows.select("id", "scope", "kind", "value").dropna()
    found: DataFrame | None = None
    for k in range(rounds):
        keyed = cut(_keyed(rows, seed + k))
        groups = keyed.groupBy(*_KEY).agg(F.min_by(F.struct("id", "kind", "value"), "id").alias("first"), F.count("*").alias("n")).where("n > 1")
        groups = groups.select(*_KEY, F.col("first.id").alias("first_id"), F.col("first.kind").alias("first_kind"), F.col("first.value").alias("first_value"))
        pairs = split_join(keyed, groups, _KEY).where(F.col("id") != F.col("first_id")).withColumnRenamed("id", "copy_id")
        checked = cut(_verified(pairs))
        good = checked.where("same").select("first_id", "copy_id")
        found = good if found is None else found.unionByName(good)
        if checked.where("not same").isEmpty():
            return found
        rows = rows.join(checked.where("not same").select(F.col("copy_id").alias("id")), "id", "left_semi")
    raise RuntimeError(f"rows still collide after {rounds} seeds")


def contacts_of_crawls(page_contacts: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, scope, kind, value) of each contact whose page has a crawl; scope is the crawl."""
    of = pages.select(F.col("id").alias("page_id"), F.col("crawl_id").alias("scope"))
    return page_contacts.select("id", "page_id", "kind", "value").join(of, "page_id").select("id", "scope", "kind", "value")


def collapsed(page_contacts: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, crawl_id, kind, value, copies): the first row of each contact of a crawl and how many copies it had."""
    rows = contacts_of_crawls(page_contacts, pages).dropna()
    found = copies(rows)
    counts = found.groupBy(F.col("first_id").alias("id")).agg(F.count("*").alias("more"))
    firsts = rows.join(found.select(F.col("copy_id").alias("id")), "id", "left_anti")
    return firsts.join(counts, "id", "left").select("id", F.col("scope").alias("crawl_id"), "kind", "value", (F.coalesce("more", F.lit(0)) + 1).alias("copies"))
