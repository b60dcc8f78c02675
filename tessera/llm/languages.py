"""Problem 9: the language of each document and of each paragraph.

One Bloom filter for each language holds the character n-grams that are typical of it. The filters share
their hash functions and are stored bit-sliced: slot h of a slice is a bit mask of languages, so one lookup in
each slice, and the AND of the masks, returns all languages whose filter holds an n-gram. The n-grams of a
paragraph are counted for each language; the counts are corrected for the filters' rate of false positives, and
the largest decides.

The filters are fitted on a bounded sample of the labelled rows. A wrong label does little harm: an n-gram is
typical of a language only when its share of that language's documents is near its largest share in any.
Scoring is one narrow pass over (doc_id, text, lang), on whole texts, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textscan import code_points, letter_table, mix
from tessera.session import bound_batches

#: Languages told apart, and the ways in which a column may state them (fixed values).
NAMES = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "inglese"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "francese"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol"),
    "it": ("it", "ita", "italian", "italiano", "italienisch", "italien"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "niederländisch", "néerlandais"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais"),
}
LANGUAGES = tuple(NAMES)
STATES_NOTHING = ("", "und", "unknown")
_CODES = {name: code for code, names in NAMES.items() for name in names}

GRAM = 4
#: Rows of the training sample, about; at most twice as many.
SAMPLE_ROWS = 6_000
#: An n-gram is typical of a language when its share of documents is at least this part of its largest share.
TYPICAL = 0.35
#: ... and when at least this share of the language's sampled documents holds it.
LEAST_SHARE = 0.01
SLOT_BITS, SLICES = 19, 3
#: A paragraph has a language when it has this many words in a row and this part of its n-grams is typical.
SENTENCE_WORDS, LEAST_PART = 4, 0.2
#: ... and leads the second best by this part of its count.
LEAST_LEAD = 0.15
_RUN = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]++(?:['’\-][^\W\d_]++)*+[,:;]?[^\S\n]++){%d}[^\W\d_]" % (SENTENCE_WORDS - 1))  # linear in the text
_BLANK = re.compile(r"\n\s*\n")


def stated(label: str | None) -> str | None:
    """The two-letter code that a label states; an unknown language stays as it is written; null if it states none."""
    if label is None:
        return None
    low = label.strip().lower()
    if low in STATES_NOTHING:
        return None
    return _CODES.get(low) or _CODES.get(head := re.split(r"[-_]", low)[0]) or head


def paragraphs(text: str | None) -> list[str]:
    """The non-blank parts of a text between blank lines."""
    if not text or text.isspace():
        return []
    if not _BLANK.search(text):
        return [text]
    return ["\n".join(run) for filled, run in groupby(text.split("\n"), key=lambda line: bool(line.strip())) if filled]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of lower-case letters, any other run being one space, and each one's index in ``texts``."""
    cp = code_points("\x00".join(x.replace("\x00", " ") for x in texts))
    if not len(texts) or not len(cp):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.cumsum(cp == 0)
    c = letter_table()[cp]
    space = c == 32
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1]) | (cp[1:] == 0)
    c, owner = c[keep].astype(np.uint64), owner[keep]
    n = len(c) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(1_000_003) + c[k : k + n]
    inside = owner[:n] == owner[GRAM - 1 :]
    return mix(h[inside]), owner[:n][inside]


class Filters:
    """Bit-sliced Bloom filters of all languages."""

    def __init__(self, slices: np.ndarray, rates: np.ndarray) -> None:
        self.slices, self.rates = slices, rates

    @staticmethod
    def _slots(h: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(SLICES):
            yield (h >> np.uint64(20 * k)) & np.uint64((1 << SLOT_BITS) - 1)

    @classmethod
    def fit(cls, hashes: np.ndarray, masks: np.ndarray) -> Filters:
        slices = np.zeros((SLICES, 1 << SLOT_BITS), dtype=np.uint8)
        for k, slots in enumerate(cls._slots(hashes)):
            np.bitwise_or.at(slices[k], slots, masks)
        bits = (slices[:, :, None] >> np.arange(len(LANGUAGES), dtype=np.uint8)) & 1
        return cls(slices, bits.mean(axis=1).prod(axis=0))

    def languages(self, h: np.ndarray) -> np.ndarray:
        mask = np.full(len(h), 255, dtype=np.uint8)
        for k, slots in enumerate(self._slots(h)):
            mask &= self.slices[k][slots]
        return mask

    def score(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """The language and a confidence of each text: its lead over the second best as a part of its count."""
        h, owner = _grams(texts)
        mask = self.languages(h)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        counts = np.stack([np.bincount(owner[(mask >> np.uint8(k)) & 1 == 1], minlength=len(texts)) for k in range(len(LANGUAGES))], axis=1).astype(float)
        counts = np.maximum((counts - total[:, None] * self.rates) / (1 - self.rates), 0)
        best = counts.argmax(axis=1)
        order = np.sort(counts, axis=1)
        out: list[tuple[str | None, float]] = []
        for i, text in enumerate(texts):
            top, second = order[i, -1], order[i, -2]
            if top - second <= LEAST_LEAD * top or top < LEAST_PART * total[i] or not _RUN.search(text):
                out.append((None, 0.0))
            else:
                out.append((LANGUAGES[best[i]], round(float((top - second) / top), 4)))
        return out


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language index and n-gram of a batch, the number of its documents; gram 0 counts the documents."""
    for batch in batches:
        labels = [stated(x) for x in batch.column(1).to_pylist()]
        rows = [(LANGUAGES.index(s), t) for s, t in zip(labels, batch.column(0).to_pylist()) if s in NAMES]
        if not rows:
            continue
        h, owner = _grams([t for _, t in rows])
        pairs = pd.DataFrame({"doc": owner, "gram": h.view(np.int64)}).drop_duplicates()
        pairs["lang"] = np.array([k for k, _ in rows], dtype=np.int32)[pairs.doc]
        df = pairs.groupby(["lang", "gram"], sort=False).size().reset_index(name="n")
        ones = pd.Series([k for k, _ in rows]).value_counts()
        df = pd.concat([df, pd.DataFrame({"lang": ones.index, "gram": 0, "n": ones.values})])
        yield pa.RecordBatch.from_pandas(df.astype({"lang": "int32", "gram": "int64", "n": "int64"})[["lang", "gram", "n"]], preserve_index=False)


def fit_filters(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Fit on about ``sample_rows`` labelled rows, chosen by a hash of doc_id over the whole table."""
    labelled = documents.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    every = max(1, documents.select("lang").where("lang is not null").count() // sample_rows)  # without reading the texts
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text", "lang").limit(2 * sample_rows)
    counted = sample.mapInArrow(_document_grams, "lang int, gram bigint, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    # n-grams of one or two documents tell nothing, so what reaches the driver is bounded by the sample
    got = counted.where((F.col("n") > 2) | (F.col("gram") == 0)).toPandas()
    sizes = got[got.gram == 0].groupby("lang").n.sum().reindex(range(len(LANGUAGES)), fill_value=0)
    grams = got[got.gram != 0].pivot_table(index="gram", columns="lang", values="n", fill_value=0).reindex(columns=range(len(LANGUAGES)), fill_value=0)
    shares = grams.to_numpy(dtype=float) / np.maximum(sizes.to_numpy(dtype=float), 1)
    most = shares.max(axis=1, keepdims=True) if len(shares) else shares
    typical = (shares >= TYPICAL * most) & (shares >= LEAST_SHARE)
    typical &= typical.sum(axis=1, keepdims=True) < len(LANGUAGES)  # what all share decides nothing
    masks = (typical * (1 << np.arange(len(LANGUAGES)))).sum(axis=1).astype(np.uint8)
    return Filters.fit(grams.index.to_numpy(dtype=np.int64).view(np.uint64), masks)


_SCHEMA = "doc_id bigint, seg_no int, stated string, lang string, confidence double"


def label_segments(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, seg_no, stated, lang, confidence): a row for each paragraph, and one with null seg_no for the document.

    ``stated`` is the code of the lang column. ``lang`` is null, with confidence 0, where the text has no
    sentence (symbols, numbers, code) or two languages tie. Null, empty and blank texts have only the
    document's row. Other columns are ignored; repeated rows repeat; an empty table gives no row.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    filters = fit_filters(documents, sample_rows)
    sent = spark.sparkContext.broadcast((filters.slices, filters.rates))  # 2^SLOT_BITS bytes a slice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filters(*sent.value)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            labels = [stated(x) for x in batch.column(2).to_pylist()]
            at, seg, pieces = [], [], []
            for i, text in enumerate(texts):
                parts = paragraphs(text)
                at += [i] * (1 + len(parts))
                seg += [None, *range(len(parts))]
                pieces += [text or "", *parts]
            scored = known.score(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array([docs[i] for i in at], pa.int64()), pa.array(seg, pa.int32()), pa.array([labels[i] for i in at], pa.string()), pa.array([x for x, _ in scored], pa.string()), pa.array([x for _, x in scored], pa.float64())],
                ["doc_id", "seg_no", "stated", "lang", "confidence"],
            )

    return documents.select("doc_id", "text", "lang").mapInArrow(run, _SCHEMA)


def wrong_segments(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, seg_no, lang): the paragraphs whose language isn't the one that the column states."""
    rows = label_segments(documents, sample_rows)
    return rows.where(F.col("seg_no").isNotNull() & F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("stated"))).select("doc_id", "seg_no", "lang")
