"""Code points, words and lookup tables shared by the text operators.

A word is a maximal run of letters or digits, in lower case.
"""

from __future__ import annotations

import re
import sys
from functools import cache

import numpy as np

WORD = re.compile(r"[^\W_]+")
#: The same words on the JVM side.
JVM_NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@cache
def fold_table(separators: str = "") -> np.ndarray:
    """Code point -> what it counts as: 0 is skipped, 1 parts fields, anything else is the folded letter or digit.

    A letter whose lower case has several code points is folded to the first of them that is a letter.
    """
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if (ch := chr(c)).isalnum():
            table[c] = ord(next((x for x in ch.lower() if x.isalnum()), ch))
    for ch in separators:
        table[ord(ch)] = 1
    return table


@cache
def letter_table() -> np.ndarray:
    """Code point -> lower-case letter, or 32 for anything else."""
    table = fold_table().copy()
    for c in np.flatnonzero(table):
        if not chr(c).isalpha():
            table[c] = 0
    table[table == 0] = 32
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes; wraps on overflow."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted different values."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def int_list(offsets: np.ndarray, values: np.ndarray):
    """An Arrow list array of ``values`` cut at ``offsets``."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
