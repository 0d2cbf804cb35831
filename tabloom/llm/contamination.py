"""Benchmark decontamination by Wu-Manber search over words.

The symbols are words, a block is two of them.  A shift table says for every block how far the next window can begin; where
it says 0, the block's hash bucket names the windows that end with it, and those are compared word by word and byte by byte.
Texts are cut into stretches that are searched side by side, as the search may begin at any word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.llm.batches import ALNUM, UPPER, Words, append, as_bytes, mix, words

WINDOW = 10
BLOCK_BYTES = 2 << 20  # benchmark text of which the windows are broadcast at once; more of it takes more passes
STRETCH = 256
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Table(NamedTuple):
    """Search table for windows of one length."""

    length: int
    block: int
    drop: np.uint64  # a block's slot is its hash without so many low bits
    shift: np.ndarray
    bucket: np.ndarray  # bucket[slot]:bucket[slot + 1] in members: the windows that end with a block of this slot
    members: np.ndarray
    hashes: np.ndarray
    windows: list[bytes]
    items: list[list[str]]

    def slot(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Slot of the block that ends with word ``last``."""
        x = hashes[last] * _FIRST
        return mix(x + hashes[last - 1] * _SECOND if self.block == 2 else x) >> self.drop


def joined(data: np.ndarray, found: Words, i: int, n: int) -> bytes:
    return b" ".join(data[found.start[k] : found.end[k]].tobytes() for k in range(i, i + n))


def tables(items: list[tuple[str, str]], length: int = WINDOW) -> list[Table]:
    """Tables for the windows of ``items`` (id, text): ``length`` words, or all words of a shorter text; one table for each length."""
    data, offsets = as_bytes(pa.array([t for _, t in items], pa.string()))
    data = UPPER[data]
    found = words(data, offsets, ALNUM)
    by_length: dict[int, dict[bytes, tuple[int, set[str]]]] = {}
    for k, (item, _) in enumerate(items):
        a, b = found.first[k], found.first[k + 1]
        n = min(length, int(b - a))
        for i in range(a, b - n + 1) if n else ():
            by_length.setdefault(n, {}).setdefault(joined(data, found, i, n), (i, set()))[1].add(item)
    out = []
    for n, windows in sorted(by_length.items()):
        block = min(2, n)
        hashes = np.array([found.hash[i : i + n] for i, _ in windows.values()])
        bits = max(8, int(np.ceil(np.log2(8 * hashes.size))))
        table = Table(n, block, np.uint64(64 - bits), np.full(1 << bits, n - block + 1, np.int64), np.empty(0), np.empty(0), hashes, list(windows), [sorted(x) for _, x in windows.values()])
        flat, first = hashes.ravel(), np.arange(len(hashes)) * n
        for j in range(block - 1, n):
            np.minimum.at(table.shift, table.slot(flat, first + j), n - 1 - j)
        ends = table.slot(flat, first + n - 1).astype(np.int64)
        members = np.argsort(ends, kind="stable")
        out.append(table._replace(bucket=np.searchsorted(ends[members], np.arange((1 << bits) + 1)), members=members))
    return out


def search(table: Table, data: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence; windows don't cross texts."""
    n = table.length
    begin, end = found.first[:-1] + n - 1, found.first[1:]  # of the last words of windows
    many = np.maximum(0, -(-(end - begin) // STRETCH))
    text = np.repeat(np.arange(len(begin)), many)
    part = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[text] + part * STRETCH
    stop = np.minimum(at + STRETCH, end[text])
    hits = []
    while len(at):
        shift = table.shift[table.slot(found.hash, at)]
        hits.append(at[shift == 0])
        at = at + np.maximum(shift, 1)
        going = at < stop
        at, stop = at[going], stop[going]
    last = np.concatenate(hits) if hits else np.empty(0, np.int64)
    slot = table.slot(found.hash, last).astype(np.int64) if len(last) else last
    low, count = table.bucket[slot] if len(last) else last, None
    count = table.bucket[slot + 1] - low if len(last) else last
    start = np.repeat(last - n + 1, count)
    window = table.members[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] if len(start) else start
    for k in range(n):
        same = found.hash[start + k] == table.hashes[window, k]
        start, window = start[same], window[same]
    sure = np.array([joined(data, found, i, n) == table.windows[w] for i, w in zip(start, window, strict=True)], bool)
    return start[sure], window[sure]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", length: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``) with ``n_words``, ``spans`` (hit words, as disjoint intervals of word numbers) and ``items`` (ids with an occurring window, sorted as strings).

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case.  NULL and empty texts have no words, on both
    sides; an empty benchmark hits nothing; repeated items count once; a NULL item id can't be named and is skipped.  The
    benchmark is searched in blocks of bounded size, one pass each, so it may be of any size.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    blocks = int((bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES) + 1
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in fields}]
    out = docs
    for b in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else bench
        held = spark.sparkContext.broadcast(tables([(r.i, r.t) for r in block.collect()], length))
        out = append(out, _search_block(held, text, first=b == 0), fields, text, [*kept, *([text] if b + 1 < blocks and text not in kept else [])], needs=[] if b == 0 else [f.name for f in fields])
    return out


def _search_block(held, text: str, first: bool):
    def run(part: pa.RecordBatch) -> list:
        data, offsets = as_bytes(part.column(text))
        data = UPPER[data]
        found = words(data, offsets, ALNUM)
        hit = np.zeros(len(found.start) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(len(part))]
        if not first:
            for i, (spans, known) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)):
                items[i].update(known)
                for s in spans:
                    hit[found.first[i] + s["start"]] += 1
                    hit[found.first[i] + s["end"]] -= 1
        for table in held.value:
            start, window = search(table, data, found)
            np.add.at(hit, start, 1)
            np.add.at(hit, start + table.length, -1)
            for i, w in set(zip((np.searchsorted(found.first, start, "right") - 1).tolist(), window.tolist(), strict=True)):
                items[i].update(table.items[w])
        covered = np.cumsum(hit[:-1]) > 0
        spans: list[list] = [[] for _ in range(len(part))]
        for i in np.flatnonzero([bool(x) for x in items]):
            own = np.concatenate([[False], covered[found.first[i] : found.first[i + 1]], [False]])
            edges = np.flatnonzero(own[1:] != own[:-1])
            spans[i] = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
        return [pa.array(np.diff(found.first)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

    return run
