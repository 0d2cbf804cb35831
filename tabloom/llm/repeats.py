"""Repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Two equal strings of L bytes choose the same anchor inside them, the least hash among their k-grams.  So the starts of a text fall into
runs with one anchor each, and only runs with anchors that occur elsewhere, too, can hold repeats: a filter of these anchors, broadcast in
shards, drops the others.  Runs meet by the bucket of their anchor's hash, as hashes first, and equal runs are collapsed.  The different ones
meet again with their texts; a suffix array of a block of them gives the transform, on which intervals grow backwards breadth-first and set the common-prefix boundaries by
increasing value until L.  Suffixes with no boundary between them share L bytes: all but the first are repeats.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.llm.batches import free, append, as_bytes, rolling, slices, small_batches, span_hash
from tabloom.llm.scoring import Filter, bucket_of, build_part, buckets_for, gathered, shards, split, summed
from tabloom.session import materialize

LEAST = 100  # bytes of a repeated string
GRAM = 20
BLOCK_BYTES = 1 << 20  # of runs whose suffixes are sorted together
HELD = 1_000_000  # runs that a task gathers before it deals them out
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Runs(NamedTuple):
    """Neighbouring starts with the same anchor: starts ``begin`` to ``begin + n - 1``, byte positions in the slice."""

    begin: np.ndarray
    n: np.ndarray
    anchor: np.ndarray  # hash of the anchor's bytes
    text: np.ndarray  # number of the text
    at: np.ndarray  # where the anchor begins


def runs_of(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM, sums: np.ndarray | None = None) -> Runs:
    """The runs of all texts; a text shorter than ``least`` has none."""
    window = least - gram + 1
    many = np.maximum(0, np.diff(offsets) - least + 1)
    text = np.repeat(np.arange(len(many)), many)
    none = np.empty(0, np.int64)
    if not len(text):
        return Runs(none, none, none.astype(np.uint64), none, none)
    start = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + offsets[text]
    sums = rolling(data) if sums is None else sums
    at = np.arange(len(data) - gram + 1)
    hashes = span_hash(sums, at, at + gram)
    place = np.uint64(max(1, int(len(data)).bit_length()))
    low = (hashes >> place << place) | at.astype(np.uint64)  # least hash first, then leftmost
    width = 1
    while 2 * width <= window:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    chosen = (low[start] & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
    return Runs(start[first], np.diff(np.append(first, len(start))), hashes[chosen[first]], text[first], chosen[first])


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, inverse) of ``symbols`` by their first ``depth`` symbols or more, by doubling."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    width = 7
    for k in range(width):  # seven symbols of nine bits
        key[: n - k] |= symbols[k:].astype(np.uint64) << np.uint64(9 * (width - 1 - k))
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if width >= depth or new[-1] == n - 1:
            inverse = np.empty(n, np.int64)
            inverse[order] = np.arange(n)
            return order, inverse
        behind = np.zeros(n, np.int64)
        behind[: n - width] = rank[width:] + 1
        key = rank.astype(np.uint64) * np.uint64(n + 1) + behind.astype(np.uint64)
        width *= 2


def boundaries(symbols: np.ndarray, order: np.ndarray, inverse: np.ndarray, least: int) -> np.ndarray:
    """``bounded[j]``: the suffixes at j - 1 and j of the suffix array share fewer than ``least`` symbols.

    Breadth-first backward extension: an interval of suffixes that begin with w gives, for every symbol c before them, the interval of
    cw by the last-to-first mapping.  An interval whose right end has no value yet sets it and lives on; the common prefixes come out
    in ascending order.  No string goes on behind a separator (symbol 0), as none that matters begins with one.
    """
    n = len(symbols)
    head = symbols[order]
    before = inverse[order - 1]  # the suffix array's row of the suffix one symbol longer; of the whole text, that of its last symbol
    bounded = np.zeros(n + 1, bool)
    begin = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    low, high = begin, np.append(begin[1:], n)
    bounded[0] = True
    bounded[high] = True
    for _ in range(1, least):
        width = high - low
        if not len(width):
            break
        row = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())
        owner = np.repeat(np.arange(len(width)), width)
        row = before[row]
        keep = head[row] != 0
        row, owner = row[keep], owner[keep]
        by = np.argsort(row)
        row, owner = row[by], owner[by]
        c = head[row]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (c[1:] != c[:-1])])) if len(row) else np.empty(0, np.int64)
        low, high = row[first], row[np.append(first[1:], len(row)) - 1] + 1 if len(row) else row
        fresh = ~bounded[high]
        low, high = low[fresh], high[fresh]
        bounded[high] = True
    return bounded[:n]


def repeated_starts(texts: list[bytes], n: np.ndarray, rank: np.ndarray, least: int) -> list[np.ndarray]:
    """Per run, which of its ``n`` starts repeat an earlier one; runs are ordered by ``rank``, and starts within a run as they are."""
    symbols = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0) for t in texts])
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    order, inverse = suffix_order(symbols, least + 1)
    group = np.cumsum(boundaries(symbols, order, inverse, least))
    run = np.repeat(np.arange(len(texts)), n)
    within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    cls = group[inverse[first[run] + within]]
    by = np.lexsort((within, rank[run], cls))
    repeat = np.zeros(len(run), bool)
    repeat[by[1:]] = cls[by[1:]] == cls[by[:-1]]
    return np.split(repeat, np.cumsum(n)[:-1])


def repeated_by_hash(texts: list[bytes], n: np.ndarray, rank: np.ndarray, least: int) -> list[np.ndarray]:
    """As :func:`repeated_starts`, for the runs of one anchor that are too many for a block: by 64-bit hashes of the strings at their starts."""
    data, offsets = as_bytes(pa.array(texts, pa.binary()))
    run = np.repeat(np.arange(len(texts)), n)
    within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[run] + within
    hashes = span_hash(rolling(data), start, start + least)
    by = np.lexsort((within, rank[run], hashes))
    repeat = np.zeros(len(start), bool)
    repeat[by[1:]] = hashes[by[1:]] == hashes[by[:-1]]
    return np.split(repeat, np.cumsum(n)[:-1])


#: ``left`` and ``right`` are hashes of the bytes beside the anchor, half of what a repeat has besides it; 0 where the run has fewer.
META = np.dtype([("anchor", "u8"), ("run", "u8"), ("left", "u8"), ("right", "u8"), ("k", "i8"), ("rid", "i8"), ("start", "i8"), ("n", "i4")])


def _found(part: pa.RecordBatch, held: Filter, least: int, gram: int):
    """The bytes, and as META the runs of a slice whose anchors the shard knows to occur twice, with where they begin in the bytes."""
    data, offsets = as_bytes(part.column("text"))
    sums = rolling(data)
    runs = runs_of(data, offsets, least, gram, sums)
    begin, n, anchor, text, at = (x[held.levels(1, runs.anchor) > 0] for x in runs)
    meta = np.empty(len(begin), META)
    meta["anchor"], meta["run"], meta["n"] = anchor, span_hash(sums, begin, begin + n - 1 + least), n
    half, stop = (least - gram) // 2, begin + n - 1 + least
    meta["left"] = np.where(at - half >= begin, span_hash(sums, np.maximum(at - half, 0), at), 0)
    meta["right"] = np.where(at + gram + half <= stop, span_hash(sums, at + gram, np.minimum(at + gram + half, len(data))), 0)
    meta["k"], meta["rid"], meta["start"] = part.column("k").to_numpy()[text], part.column("rid").to_numpy()[text], begin - offsets[text]
    return data, meta, begin


def _collect(held, least: int, gram: int, buckets: int):
    """``bucket, meta``: all runs with anchors that occur twice, without their texts."""

    def flush(parts):
        meta = np.concatenate(parts)
        meta = meta[np.argsort(meta["anchor"], kind="stable")]
        for b, own in split(meta["anchor"], buckets):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "meta": pa.array([meta[own].tobytes()], pa.binary())})

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                parts.append(_found(part, held.value, least, gram)[1])
                size += len(parts[-1])
                if size > HELD:
                    yield from flush(parts)
                    parts, size = [], 0
        if size:
            yield from flush(parts)

    return run


def _together(one: np.ndarray, side: str) -> np.ndarray:
    """Which runs have a neighbour with the same anchor and the same bytes on that side of it."""
    by = np.lexsort((one[side], one["anchor"]))
    anchor, beside = one["anchor"][by], one[side][by]
    same = (anchor[1:] == anchor[:-1]) & (beside[1:] == beside[:-1]) & (beside[1:] != 0)
    out = np.zeros(len(one), bool)
    out[by[1:][same]] = True
    out[by[:-1][same]] = True
    return out


def _equal_runs(least: int):
    """One bucket: of equal runs all but the first are repeats as a whole (rows without ``run``).

    Runs that differ are left to compare if they share an anchor and half of what a repeat has besides it, as two strings of
    ``least`` bytes have on one side of their anchor.  Within one run, equal strings would have an anchor each.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        meta = np.concatenate([np.frombuffer(x.as_py(), META) for x in table["meta"]])
        meta = meta[np.lexsort((meta["start"], meta["rid"], meta["k"], meta["run"], meta["anchor"]))]
        again = np.zeros(len(meta), bool)
        again[1:] = (meta["anchor"][1:] == meta["anchor"][:-1]) & (meta["run"][1:] == meta["run"][:-1])
        one, gone = meta[~again], meta[again]
        one = one[_together(one, "left") | _together(one, "right")]
        both = np.concatenate([gone, one])
        none = np.arange(len(both)) < len(gone)
        return pa.table({
            "bucket": pa.array(np.full(len(both), key[0].as_py()), pa.int32()), "k": pa.array(both["k"]), "rid": pa.array(both["rid"]), "start": pa.array(both["start"]), "end": pa.array(both["start"] + both["n"] - 1 + least),
            "run": pa.array(both["run"].view(np.int64), mask=none), "anchor": pa.array(both["anchor"].view(np.int64), mask=none),
        })

    return run


def _texts(anchors, held, least: int, gram: int, buckets: int):
    """``bucket, run, text``: the texts of the runs that the shard knows, once in a slice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, meta, begin = _found(part, anchors.value, least, gram)
                _, one = np.unique(meta["run"], return_index=True)
                one = one[held.value.levels(1, meta["run"][one]) > 0]
                end = begin[one] + meta["n"][one] - 1 + least
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket_of(meta["anchor"][one], buckets), pa.int32()), "run": pa.array(meta["run"][one].view(np.int64)), "text": pa.array([data[a:b].tobytes() for a, b in zip(begin[one], end, strict=True)], pa.binary())})

    return run


def _blocks(anchor: np.ndarray, size: np.ndarray):
    """Cuts runs, sorted by anchor, where an anchor ends, into blocks that are full at most, or hold one anchor that needs more."""
    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    for a, b in zip(edge, [*edge[1:], len(anchor)], strict=True):
        if total[b] - total[at] > BLOCK_BYTES and a > at:
            yield at, a
            at = a
    yield at, len(anchor)


def _different_runs(least: int):
    """One bucket: the transform decides which starts of runs that share an anchor repeat earlier ones."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        get = lambda c: left[c].combine_chunks().to_numpy(zero_copy_only=False)
        anchor, own, k, rid, start, end = (get(c) for c in ("anchor", "run", "k", "rid", "start", "end"))
        by = np.argsort(anchor, kind="stable")
        anchor, own, k, rid, start, end = (x[by] for x in (anchor, own, k, rid, start, end))
        known, at = np.unique(right["run"].combine_chunks().to_numpy(), return_index=True)
        texts = right["text"].combine_chunks()
        rank = np.empty(len(own), np.int64)
        rank[np.lexsort((start, rid, k))] = np.arange(len(own))
        n = end - start + 1 - least
        out = [tuple(np.empty(0, np.int64) for _ in range(4))]
        for a, b in _blocks(anchor, end - start) if len(own) else ():
            block = texts.take(pa.array(at[np.searchsorted(known, own[a:b])])).to_pylist()
            one_block = sum(map(len, block)) <= 2 * BLOCK_BYTES
            for i, flags in zip(range(a, b), (repeated_starts if one_block else repeated_by_hash)(block, n[a:b], rank[a:b], least), strict=True):
                if flags.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                    lo, hi = edges[::2], edges[1::2]
                    out.append((np.full(len(lo), k[i]), np.full(len(lo), rid[i]), start[i] + lo, start[i] + hi - 1 + least))
        return pa.table(dict(zip(("k", "rid", "start", "end"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return run


def _filter_parts(hashes: DataFrame, column: str, buckets: int) -> DataFrame:
    """A filter of the 64-bit hashes in ``column``, by bucket."""

    def part(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h = np.unique(table[column].combine_chunks().to_numpy()).view(np.uint64)
        return pa.table({"kind": pa.array([1], pa.int32()), "bucket": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([build_part(h, np.ones(len(h), np.int64), 1).tobytes()], pa.binary())})

    dealt = hashes.select(column, F.shiftrightunsigned(F.shiftrightunsigned(F.col(column), 32) * buckets, 32).cast("int").alias("bucket"))
    return materialize(dealt.groupBy("bucket").applyInArrow(part, "kind int, bucket int, filter binary"))


def repeated_spans(docs: DataFrame, key: str, text: str, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``k, rid, start, end``: byte spans to remove, by integer key and hash of the text; they may overlap."""
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("rid"), F.col(text).cast("string").alias("text")).where("text is not null")
    buckets, context = 4 * buckets_for(own, "text"), docs.sparkSession.sparkContext

    def anchors(column: pa.Array):
        return (runs_of(*as_bytes(column), least, gram).anchor,)

    def part(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, n = summed(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]]), np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["counts"]]).astype(np.int64))
        return pa.table({"kind": pa.array([1], pa.int32()), "bucket": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([build_part(h, np.minimum(n, 2), 2).tobytes()], pa.binary())})

    def passes(fn, schema, *held_shards):
        """``fn`` over all texts, once for each shard; an anchor or a run is known to one shard only."""
        out = None
        for shard in held_shards:
            some = small_batches(own).mapInArrow(fn(shard), schema)
            out = some if out is None else out.union(some)
        return out

    counted = materialize(gathered(own, "text", 1, anchors, buckets).groupBy("bucket").applyInArrow(part, "kind int, bucket int, filter binary"))
    twice = [context.broadcast(s) for s in shards(counted, 1, buckets)]
    meta = passes(lambda s: _collect(s, least, gram, buckets), "bucket int, meta binary", *twice)
    done = materialize(meta.groupBy("bucket").applyInArrow(_equal_runs(least), "bucket int, k long, rid long, start long, end long, run long, anchor long"))
    rest = done.where("run is not null")
    ask = [context.broadcast(s) for s in shards(_filter_parts(rest, "run", buckets), 1, buckets)]
    texts = passes(lambda s: _texts(s[0], s[1], least, gram, buckets), "bucket int, run long, text binary", *((a, r) for a in twice for r in ask))
    # few bytes are much work here, so partitions aren't left to their sizes
    tasks = min(buckets, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    found = rest.repartition(tasks, "bucket").groupBy("bucket").cogroup(texts.repartition(tasks, "bucket").groupBy("bucket")).applyInArrow(_different_runs(least), "k long, rid long, start long, end long")
    return done.where("run is null").select("k", "rid", "start", "end").union(found)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``) with ``n_bytes, n_removed, spans`` (removed runs, in bytes) and ``kept`` (the bytes that stay).

    A byte goes if a string of ``least`` bytes around it also starts earlier, in a row of a smaller key, or earlier in its own.  Keys are
    integers, and a NULL one comes first; rows that share a key and the text are one document, those that share the key alone are ordered
    by a hash of the text.  NULL and empty texts have no bytes.  Columns with the names of the results give way.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_bytes", "n_removed", "spans", "kept")]
    k, rid, found = (free(docs.columns, c) for c in ("k", "rid", "found"))
    spans = repeated_spans(docs, key, text, least, gram).groupBy(F.col("k").alias(k), F.col("rid").alias(rid)).agg(F.collect_list(F.struct("start", "end")).alias(found))
    named = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias(k), F.xxhash64(text).alias(rid))
    joined = named.join(spans, [k, rid], "left")
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())]

    def cut(part: pa.RecordBatch) -> list:
        data, offsets = as_bytes(part.column(text))
        rows = []
        for spans, a, b in zip(part.column(found).to_pylist(), offsets[:-1], offsets[1:], strict=True):
            gone, out, at = [], [], 0
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if gone and s[0] <= gone[-1]["end"]:
                    gone[-1]["end"] = max(gone[-1]["end"], s[1])
                else:
                    gone.append({"start": s[0], "end": s[1]})
            for s in gone:
                out.append(data[a + at : a + s["start"]].tobytes())
                at = s["end"]
            out.append(data[a + at : b].tobytes())
            rows.append((int(b - a), sum(s["end"] - s["start"] for s in gone), gone, b"".join(out)))
        n, removed, gone, left = zip(*rows)
        return [pa.array(n), pa.array(removed), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(left, pa.binary())]

    return append(joined, cut, fields, text, kept, needs=[found])
