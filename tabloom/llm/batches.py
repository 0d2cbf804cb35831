"""Arrow batches in tasks: bounded slices of text, words and word hashes as numpy arrays.

A slice holds about ``SLICE_BYTES`` of text, or one longer text, so a task's memory does not depend on its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 21
ROWS_PER_BATCH = 512
UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32  # A-Z to a-z, every other byte stays
#: Bytes of words: all but blank and \t\n\v\f\r; or digits, letters and every byte of a non-ASCII character.
NOT_BLANK = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])

_ODD = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, by :func:`span_hash`, hash any span of ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_ODD, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start])


class Words(NamedTuple):
    start: np.ndarray  # byte positions in the slice
    end: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """The maximal runs of word bytes of each text; hashes are of the bytes in ``data``."""
    inside = is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(start, end, np.searchsorted(start, offsets), span_hash(rolling(data), start, end))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (of the whole slice: the caller drops those that leave a text)."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(_ODD) + hashes[i : i + m] + np.uint64(i + 1))
    return out


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets); NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[raw[0] : raw[-1]] if data is not None else np.empty(0, np.uint8)
    return data, raw - raw[0]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about SLICE_BYTES of text each."""
    i, column = 0, batch.column(text)
    total = np.cumsum([0, *(len(x) if x is not None else 0 for x in _lengths(column))])
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(total, total[i] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _lengths(column: pa.Array):
    _, offsets = as_bytes(column)
    return (range(int(n)) for n in np.diff(offsets))


def small_batches(df: DataFrame) -> DataFrame:
    """Texts can be long: few rows in an Arrow batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return df


def free(columns: list[str], name: str) -> str:
    """``name``, or a longer one, that none of ``columns`` has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def append(df: DataFrame, fn: Callable[[pa.RecordBatch], list], fields: list[T.StructField], text: str = "text", keep: list[str] | None = None, needs: list[str] = ()) -> DataFrame:
    """``df`` (its columns in ``keep``, by default all) with the columns that ``fn`` makes from slices of the rows.

    A column of ``df`` whose name is among the new ones gives way to it.  ``needs`` names further columns that ``fn`` reads.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = df.select(*(f"`{c}`" for c in dict.fromkeys([*kept, *needs, text])))
    schema = T.StructType([source.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                new = fn(part)
                old = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip([*old, *new], arrow, strict=True)], schema=arrow)

    return small_batches(source).mapInArrow(run, schema)
