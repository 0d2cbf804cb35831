"""Sets of hashed word shingles."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tabloom.llm.batches import NOT_BLANK, UPPER, as_bytes, grams, mix, words

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Sets(NamedTuple):
    """Distinct n-gram hashes of each text, ascending: ``first[i]:first[i + 1]`` of ``grams``; ``cls`` is a hash of the whole set."""

    grams: np.ndarray
    first: np.ndarray
    cls: np.ndarray


def sets_of(column: pa.Array, n: int) -> Sets:
    """Sets of ``n``-word shingles, A-Z in lower case; a text with fewer words has its whole sequence, one without has none."""
    data, offsets = as_bytes(column)
    data = UPPER[data]
    found = words(data, offsets, NOT_BLANK)
    count = np.diff(found.first)
    many = np.maximum(0, count - n + 1)
    text = np.repeat(np.arange(len(count)), many)
    at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + found.first[:-1][text]
    every = grams(found.hash, n)[at] if len(at) else np.empty(0, np.uint64)
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            text = np.concatenate([text, short])
            every = np.concatenate([every, mix(grams(found.hash, m)[found.first[:-1][short]] + np.uint64(m))])
    by = np.lexsort((every, text))
    every, text = every[by], text[by]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]) | (text[1:] != text[:-1])
    every, text = every[new], text[new]
    first = np.searchsorted(text, np.arange(len(count) + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(every + _A))])
    cls = mix((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(np.uint64) * _B)
    return Sets(every, first, cls)
