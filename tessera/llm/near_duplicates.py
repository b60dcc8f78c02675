"""Problem 5: near-duplicate records with small edits.

MinHash banding. A page's different word n-grams are hashed and reduced to a signature of BANDS x ROWS minima; each
band's rows make one key, and pages that share a key are candidates. At similarity s a pair is found with
probability 1 - (1 - s^ROWS)^BANDS: 0.992 at 0.6, 0.9994 at 0.65. Candidates that agree in far fewer minima
than the threshold are left out (SLACK below it: a pair at the threshold is lost so with a probability under 1e-7); all others are verified on
their full n-gram sets.

For scale: pages with equal n-gram sets are one class, represented by its least page, and only representatives
are banded; members are joined at the end, where the result asks for their pairs. A key shared by more than
``HOT`` representatives (furniture of one site) isn't paired as it is: its pages are spread over SUB_BANDS finer
keys, each with SUB_ROWS more minima, drawn anew for each key and level, and these are looked at again in the same way. A pair of similarity 0.6 has one of a
key's finer keys with probability 0.995, and usually several keys. Where finer keys would not halve the pairs (pages of a key that are alike), and
after LEVELS, a hot key is paired in blocks, so no task gets a key whole and no pair is capped. The text is scanned twice and never shuffled but for pages that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textscan import distinct, int_list, mix, words
from tessera.operators.joins import pair_up, split_join
from tessera.session import bound_batches, cut

BANDS, ROWS = 60, 5
HOT, SUB_BANDS, SUB_ROWS, LEVELS, TRIED = 256, 22, 3, 3, 4
SLACK = 0.15
CACHED_WORDS = 500_000
_RNG = np.random.default_rng(20_240_229)
_A = (_RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Shingler:
    """Hashed word n-grams of texts; words' hashes are kept, in bounded number."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, {}

    def __call__(self, text: str | None, least_words: int = 0) -> np.ndarray | None:
        """The sorted different n-grams of a text, or None if it has fewer words than asked for."""
        ws = words(text)
        if len(ws) < max(least_words, self.size):
            return None
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        h = np.empty(len(ws), dtype=np.uint64)
        for i, w in enumerate(ws):
            x = known.get(w)
            if x is None:
                x = known[w] = xxhash.xxh3_64_intdigest(w)
            h[i] = x
        n = len(ws) - self.size + 1
        total = np.zeros(n, dtype=np.uint64)
        for k in range(self.size):
            total = mix(total + h[k : k + n] * _K[k % 3])
        return distinct(total)


def _fold(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key of each row of minima."""
    total = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        total = mix(total + rows[:, k].astype(np.uint64) * _K[0] + np.uint64(k + 1))
    return total


def signature(grams: np.ndarray) -> np.ndarray:
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):  # a long text in blocks that stay in the cache
        np.minimum(out, (_A * x[None, at : at + 2048] + _B).min(axis=1), out=out)
    return out


_SIGNED = "page_id bigint, n int, set0 bigint, set1 bigint, keys array<bigint>, sig binary"


def _sign(size: int, least_words: int):
    salt = np.arange(BANDS, dtype=np.uint64) * _K[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in batches:
            ids, n, s0, s1, keys, sigs = [], [], [], [], [], []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = shingle(text, least_words)
                if grams is None:
                    continue
                sig = signature(grams)
                ids.append(page)
                n.append(len(grams))
                s0.append(int(grams.sum().view(np.int64)))
                s1.append(int(np.bitwise_xor.reduce(mix(grams)).view(np.int64)))
                keys.append(mix(_fold(sig.reshape(BANDS, ROWS)) + salt).view(np.int64))
                sigs.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
            empty = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()),
                    int_list(np.arange(len(ids) + 1) * BANDS, np.concatenate([empty, *keys])), pa.array(sigs, pa.binary()),
                ],
                names=["page_id", "n", "set0", "set1", "keys", "sig"],
            )

    return run


def _agreeing(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in at least this part of their minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(len(batch), -1) for k in (2, 3))
            keep = (left == right).mean(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def _grams_of(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in batches:
            grams = [g if (g := shingle(t)) is not None else np.zeros(0, np.uint64) for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, grams)])
            yield pa.RecordBatch.from_arrays([batch.column(0), int_list(offsets, np.concatenate([np.zeros(0, np.uint64), *grams]).view(np.int64))], names=["page_id", "grams"])

    return texts.mapInArrow(run, "page_id bigint, grams array<bigint>")


def _finer(hot: DataFrame, level: int, bands: int = SUB_BANDS) -> DataFrame:
    """(above, key, page_id, n) under finer keys of rows (key, page_id, n, sig) of hot keys; minima are drawn by the key's hash."""

    def one(k: Column) -> Column:
        spots = [F.pmod(F.xxhash64("key", k, F.lit(1000 * level + r)), F.lit(BANDS * ROWS)).cast("int") + 1 for r in range(SUB_ROWS)]
        return F.xxhash64("key", k, *[F.substring("sig", spot, F.lit(1)) for spot in spots])

    keys = F.transform(F.sequence(F.lit(1), F.lit(bands)), one)
    return hot.select(F.col("key").alias("above"), F.explode(keys).alias("key"), "page_id", "n")


def _candidates(signed: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, once each: pages of ``signed`` that share a key and whose sets are of similar size."""
    columns = ["page_id", "n"]
    sigs = signed.select("page_id", "sig")
    buckets = signed.select(F.explode("keys").alias("key"), *columns)
    parts: list[DataFrame] = []
    for level in range(LEVELS + 1):
        sizes = cut(buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))  # read several times, small beside the buckets
        hot = sizes.where(F.col("m") > HOT)
        if level == LEVELS or hot.isEmpty():
            parts.append(pair_up(buckets, sizes, ["key"], "page_id", columns, HOT))
            break
        parts.append(pair_up(buckets, sizes.where(F.col("m") <= HOT), ["key"], "page_id", columns, HOT))
        rows = cut(split_join(buckets, hot, ["key"]).select("key", *columns))
        # a few finer keys tell whether they part a key's pages; where most are alike, all pairs are looked at anyway
        tried = _finer(rows.join(sigs, "page_id"), level, TRIED).groupBy("above", "key").agg(F.count("*").alias("m"))
        cost = tried.groupBy("above").agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("cost"))
        loose = cut(hot.join(cost, hot["key"] == cost["above"]).where(F.col("cost") * SUB_BANDS / TRIED < F.col("m") * F.col("m") / 2).select("key"))
        parts.append(pair_up(rows, hot.join(loose, "key", "left_anti"), ["key"], "page_id", columns, HOT))
        buckets = _finer(split_join(rows, loose, ["key"], "left_semi").join(sigs, "page_id"), level).drop("above")
    close = F.least("n", "n_2") >= F.lit(threshold) * F.greatest("n", "n_2")  # sets of very different size can't be similar
    return reduce(DataFrame.unionByName, [p.where(close).select(F.col("page_id").alias("a"), F.col("page_id_2").alias("b")) for p in parts]).distinct()


def similar_representatives(texts: DataFrame, size: int, threshold: float, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b, similarity) and membership (page_id, rep) of ``texts`` (page_id, text)."""
    bound_batches(texts.sparkSession)
    signed = cut(texts.select("page_id", "text").where("text is not null and page_id is not null").mapInArrow(_sign(size, least_words), _SIGNED))
    same = ["n", "set0", "set1"]
    reps = signed.groupBy(*same).agg(F.min("page_id").alias("rep"))
    members = split_join(signed.select("page_id", *same), reps, same).select("page_id", "rep")
    banded = signed.join(reps.select(F.col("rep").alias("page_id")), "page_id", "left_semi")
    pairs = _candidates(banded, threshold)
    sigs = signed.select("page_id", "sig")
    pairs = pairs.join(sigs.select(F.col("page_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("page_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    candidates = cut(_agreeing(pairs, threshold - SLACK))
    involved = candidates.select(F.explode(F.array("a", "b")).alias("page_id")).distinct()
    grams = _grams_of(texts.select("page_id", "text").join(involved, "page_id", "left_semi"), size)
    both = candidates.join(grams.select(F.col("page_id").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("page_id").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    verified = both.select("a", "b", common.alias("i"), (F.size("ga") + F.size("gb") - common).alias("u"))
    return verified.where(F.col("i") >= F.col("u") * F.lit(threshold)).select("a", "b", (F.col("i") / F.col("u")).alias("similarity")), members


def near_duplicate_pages(page_content: DataFrame, pages: DataFrame, size: int = 3, threshold: float = 0.6, least_words: int = 100) -> DataFrame:
    """(page_id_a, page_id_b), smaller id first: each pair of pages with different canonical_url and at least
    ``least_words`` words each whose different ``size``-word sequences agree to ``threshold`` (Jaccard).

    Pages without Markdown or canonical_url take no part. Each pair comes once. Page ids are unique. N copies of a page make about N^2 / 2 pairs,
    as the definition asks; ``near_duplicate_classes`` gives the same links without them.
    """
    links, members = similar_representatives(page_content.select("page_id", F.col("raw_markdown").alias("text")), size, threshold, least_words)
    members = cut(members.join(pages.select(F.col("id").alias("page_id"), "canonical_url").where("canonical_url is not null"), "page_id"))
    one = members.select(F.col("rep").alias("a"), F.col("page_id").alias("p"), F.col("canonical_url").alias("url_p"))
    two = members.select(F.col("rep").alias("b"), F.col("page_id").alias("q"), F.col("canonical_url").alias("url_q"))
    between = links.select("a", "b").join(one, "a").join(two, "b").where("url_p <> url_q")
    sizes = members.groupBy("rep").agg(F.count("*").alias("m")).where("m > 1")
    within = pair_up(members, sizes, ["rep"], "page_id", ["page_id", "canonical_url"]).where("canonical_url <> canonical_url_2")
    found = between.select("p", "q").unionByName(within.select(F.col("page_id").alias("p"), F.col("page_id_2").alias("q")))
    return found.select(F.least("p", "q").alias("page_id_a"), F.greatest("p", "q").alias("page_id_b"))


def near_duplicate_classes(page_content: DataFrame, size: int = 3, threshold: float = 0.6, least_words: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rep_a, rep_b, similarity) of similar classes and (page_id, rep, links) of each page with ``least_words`` words or more.

    A class is all pages with the same set of sequences, named by its least page; ``links`` counts the other classes like a page's own. No pair of
    copies is given, and no link between different texts is lost. Empty tables give no row.
    """
    links, members = similar_representatives(page_content.select("page_id", F.col("raw_markdown").alias("text")), size, threshold, least_words)
    links = cut(links)
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    counted = split_join(members, n, ["rep"], "left").select("page_id", "rep", F.coalesce("links", F.lit(0)).alias("links"))
    return links.select(F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b"), "similarity"), counted


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(page_id, group_id): pages whose classes hang together by links; group_id is the least page of a group.

    Least labels travel along links and then jump to their own label's label, until none changes: the rounds grow with the
    logarithm of a group's diameter. Each round is written down, so a lost executor costs one round.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.select(F.col("a").alias("v"), F.col("a").alias("label")).distinct())
    while True:
        seen = both.join(labels.select(F.col("v").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("v")).agg(F.min("near").alias("near"))
        least = labels.join(seen, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = least.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = cut(split_join(least, jump, ["label"]).select("v", "old", F.least("label", "far").alias("label")))
        if new.where("label <> old").isEmpty():
            break
        labels = new.select("v", "label")
    named = members.join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left")
    return named.select("page_id", F.coalesce("label", "rep").alias("group_id"))


def near_duplicate_groups(page_content: DataFrame, size: int = 3, threshold: float = 0.6, least_words: int = 100) -> DataFrame:
    """(page_id, group_id) of each page with ``least_words`` words or more; pages like no other are groups of one."""
    links, members = similar_representatives(page_content.select("page_id", F.col("raw_markdown").alias("text")), size, threshold, least_words)
    return groups(cut(links), members)
