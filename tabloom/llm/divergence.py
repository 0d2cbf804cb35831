"""How the sources of a language differ in their words, by bitmaps of count levels.

All terms of a (language, source) group that occur equally often there share a smoothed share p, so a group is kept as one bitset of
terms for each count.  For two sources AND and popcount of their bitsets give how many terms each pair of counts has, which is multiplied
by the difference of the two shares.  The terms that a group doesn't have are the complement of its bitsets, one more level.  Terms go to
chunks by hash, a chunk's bitsets are made in words of 64 terms, and sources are compared in tiles, so a task holds a bounded part of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.llm.batches import UPPER, as_bytes, slices, small_batches, words
from tabloom.session import discard, materialize, small_side

LEAST_DOCS = 30
TOP = 50
SMOOTHING = 5
UNIT = 1_000_000_000
CHUNK_TERMS = 512
TILE_SOURCES = 64
FLUSH = 1_000_000  # (group, term) counts that a task holds
#: Bytes of terms: letters, and every byte of a character beyond ASCII.
TERM = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs``, added up over what a task holds at a time."""

    def flush() -> pa.RecordBatch:
        group, term, n, docs = (np.concatenate([h[k] for h in held]) for k in range(4))
        by = np.lexsort((term, group))
        at = np.flatnonzero(np.concatenate([[True], (group[by][1:] != group[by][:-1]) | (term[by][1:] != term[by][:-1])])) if len(by) else np.empty(0, np.int64)
        one = by[at]
        text = pa.concat_arrays([h[4] for h in held]).take(pa.array(one)).cast(pa.string())
        add = lambda x: pa.array(np.add.reduceat(x[by], at) if len(at) else x[by])
        lang, source = (pa.array([names[g][k] for g in group[one]], pa.string()) for k in (0, 1))
        return pa.RecordBatch.from_pydict({"lang": lang, "source": source, "term": text, "n": add(n), "docs": add(docs)})

    held, size, groups, names = [], 0, {}, []
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = as_bytes(part.column("text"))
            data = UPPER[data]
            found = words(data, offsets, TERM)
            own = []
            for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True):
                if g not in groups:
                    groups[g] = len(names)
                    names.append(g)
                own.append(groups[g])
            row = np.repeat(np.arange(len(part)), np.diff(found.first))
            by = np.lexsort((found.hash, row))  # once for each row that has a term
            h, r = found.hash[by], row[by]
            at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(by) else np.empty(0, np.int64)
            n = np.diff(np.append(at, len(by)))
            group = np.array(own, np.int64)[r[at]]
            by2 = np.lexsort((h[at], group))
            g2, h2 = group[by2], h[at][by2]
            at2 = np.flatnonzero(np.concatenate([[True], (h2[1:] != h2[:-1]) | (g2[1:] != g2[:-1])])) if len(by2) else np.empty(0, np.int64)
            word = by[at[by2[at2]]]
            start, width = found.start[word], (found.end - found.start)[word]
            to = np.concatenate([[0], np.cumsum(width)])
            text = pa.Array.from_buffers(pa.large_string(), len(word), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data[np.arange(to[-1]) + np.repeat(start - to[:-1], width)])])
            held.append((g2[at2], h2[at2], np.add.reduceat(n[by2], at2) if len(at2) else n, np.diff(np.append(at2, len(by2))), text))
            size += len(word)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def share(n: Column, total: Column, terms: Column, unit: int = UNIT, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(unit (n + smoothing) / (total + smoothing terms)), exactly; NULL without terms."""
    above = F.lit(unit).cast("decimal(19,0)") * (n + smoothing).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", above, F.nullif(total + smoothing * terms, F.lit(0)).cast("decimal(19,0)"))


def levels(term: np.ndarray, n: np.ndarray, p: np.ndarray, blocks: int, p0: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each block, bitset, p) of a group: a row for every count that a block of 64 terms has, and one for the terms that it hasn't."""
    block, bit = term >> 6, np.uint64(1) << (term & 63).astype(np.uint64)
    by = np.lexsort((n, block))
    block, bit, n, p = block[by], bit[by], n[by], p[by]
    at = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (n[1:] != n[:-1])])) if len(by) else np.empty(0, np.int64)
    bits = np.bitwise_or.reduceat(bit, at) if len(at) else bit
    here = np.zeros(blocks, np.uint64)
    np.bitwise_or.at(here, block[at], bits)
    block, bits, p = np.concatenate([block[at], np.arange(blocks)]), np.concatenate([bits, valid & ~here]), np.concatenate([p[at], np.full(blocks, p0, np.int64)])
    by = np.argsort(block, kind="stable")
    return np.searchsorted(block[by], np.arange(blocks + 1)), bits[by], p[by]


def distance(a: tuple, b: tuple) -> int:
    """The sum over all terms of |p - q|: the terms of every cell of two levels, times their difference."""
    many, width = np.diff(a[0]), np.diff(b[0])
    size = many * width
    block = np.repeat(np.arange(len(size)), size)
    cell = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
    i, j = a[0][block] + cell // width[block], b[0][block] + cell % width[block]
    return int((np.bitwise_count(a[1][i] & b[1][j]).astype(np.int64) * np.abs(a[2][i] - b[2][j])).sum())


def _compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """``lang, a, b, value`` of a chunk of terms for the sources of two tiles, ``a`` before ``b``."""
    lang, _, low, high = (k.as_py() for k in key)
    empty = table.filter(pa.compute.is_null(table["term"]))
    table = table.filter(pa.compute.is_valid(table["term"]))
    text = table["term"].combine_chunks().dictionary_encode()
    term, n, p = text.indices.to_numpy(), table["n"].to_numpy(), table["p"].to_numpy()
    total = np.bincount(term, n, len(text.dictionary))  # terms about as frequent share a word, so that it has few levels
    place = np.empty(len(total), np.int64)
    place[np.argsort(total, kind="stable")] = np.arange(len(total))
    term, blocks = place[term], (len(total) + 63) // 64
    valid = np.full(blocks, np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(total) % 64:
        valid[-1] = (np.uint64(1) << np.uint64(len(total) % 64)) - np.uint64(1)
    source = table["source"].to_numpy(zero_copy_only=False)
    of = {}
    for name, tile, p0 in zip(empty["source"].to_pylist(), empty["tile"].to_pylist(), empty["p"].to_pylist(), strict=True):
        own = source == name
        of.setdefault(tile, []).append((name, levels(term[own], n[own], p[own], blocks, p0 or 0, valid)))
    pairs = combinations(sorted(of.get(low, []), key=lambda x: x[0]), 2) if low == high else product(of.get(low, []), of.get(high, []))
    rows = [(*sorted((a, b)), distance(x, y)) for (a, x), (b, y) in pairs]
    return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "a": pa.array([r[0] for r in rows], pa.string()), "b": pa.array([r[1] for r in rows], pa.string()), "value": pa.array([r[2] for r in rows], pa.int64())})


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for all pairs of sources of a language, each once."""
    sizes = groups.groupBy("lang").agg(F.max("terms").alias("t"), F.count(F.lit(1)).alias("s"))
    sizes = small_side(sizes.select("lang", F.expr(f"1 + t div {CHUNK_TERMS}").alias("chunks"), F.expr(f"1 + s div {TILE_SOURCES}").alias("tiles")))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).alias("tile")
    rows = counts.select("lang", "source", "term", "n", "p").join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"), tile, "tiles", "source", "term", "n", "p")
    empty = groups.join(sizes, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), tile, "tiles", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.col("p0").alias("p")
    )
    both = rows.unionByName(empty).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = both.select("lang", "chunk", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "source", "term", "n", "p")
    parts = dealt.groupBy("lang", "chunk", "low", "high").applyInArrow(_compare, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int | None = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from the others, and the terms that set it apart.

    Terms are runs of letters and characters beyond ASCII, A-Z in lower case; a language keeps those that ``least_docs`` of its documents
    have.  A group or a language gives a kept term with n occurrences ``p = 1 + floor(UNIT (n + 5) / (N + 5 V))``.  Part ``pair`` has every other
    source with the sum of |p - q| over the kept terms (0 without any); part ``term`` has the ``top`` terms that the group has and uses more
    than its language.  Ranks follow the value, descending, then the item in the order of UTF-8 bytes.  NULL in any of the three columns is
    the empty string; texts without terms make an occurring group nevertheless; repeated rows count each; long texts are read whole; an
    empty table has no rows.  Other columns are not looked at.
    """
    clean = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    own = docs.select(clean(text, "text"), clean(lang, "lang"), clean(source, "source"))
    sent = small_batches(own).mapInArrow(_counts, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    every = Window.partitionBy("lang", "term")
    found = sent.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = found.withColumns({"_docs": F.sum("docs").over(every), "all": F.sum("n").over(every)}).where(F.col("_docs") >= least_docs)
    kept = materialize(found.select("lang", "source", "term", "n", "all"))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = kept.groupBy("lang", "term").agg(F.max("all").alias("all")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(known, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = materialize(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))))
    about = small_side(groups)
    shares = materialize(kept.join(about, ["lang", "source"]).select(
        "lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q")
    ))

    one = materialize(_pairs(shares, groups))
    pairs = one.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(one.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(place)).withColumn("part", F.lit("pair"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(place)).withColumn("part", F.lit("term"))
    terms = terms if top is None else terms.where(F.col("rank") <= top)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    out = materialize(pairs.select(*cols).union(terms.select(*cols)))
    discard(kept, groups, shares, one)
    return out
