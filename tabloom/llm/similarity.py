"""N-gram Jaccard join by vertical partitioning.

N-grams are ordered by their hashes, and the order is cut into fragments.  Sets that link differ in at most k n-grams, k from their sizes, so of
more than k fragments one is the same in both: the digests of fragments name the candidates.  How many n-grams two candidates can share is
bounded by the fine fragments that both have; how many they do share is counted in each fragment by itself and summed per pair.

Equal sets are one class from the start.  A class is first paired with the leaders of its buckets; in buckets whose members then are
in several components, pairs of different ones are bounded and counted in tasks, in tiles.  So a group of copies doesn't become all its
pairs, and sets are only sent for pairs whose bound allows a link.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.llm.batches import append, as_bytes, mix, slices, small_batches
from tabloom.llm.graph import components
from tabloom.llm.minhash import TILE, class_ids, connected, joined_by_class, may, sets_of_classes, tiles_of
from tabloom.llm.scoring import bucket_of, buckets_for, split
from tabloom.llm.shingles import Sets, sets_of
from tabloom.session import discard, materialize

N = 5
PERCENT = 80
FRAGMENTS = 8  # in which overlaps are counted
TINY = 16  # up to that size every n-gram is a fragment
RATIO = 1.3  # of the sizes of a space
ODDS = 13  # a link may be lost once in 10**ODDS
FLUSH = 2_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Space(NamedTuple):
    """Pairs whose smaller set has ``low`` to ``high`` n-grams; the larger one has up to ``top``, and they differ in up to ``differ``."""

    number: int
    low: int
    high: int
    top: int
    differ: int
    fragments: int  # 0: every n-gram is one


def spaces(largest: int, percent: int) -> list[Space]:
    """Spaces for sets of up to ``largest`` n-grams; sizes at which only equal sets link have none.

    A fragment that is empty in both sets is no candidate.  A link is lost if all common n-grams lie in the k fragments that differ, so there are
    so many fragments that this has odds of ``10**-ODDS`` for hashed n-grams.
    """
    out, low, number = [], 1, 0
    while low <= largest:
        high = max(low, math.ceil(low * RATIO) - 1)
        top = high * 100 // percent
        differ = (high + top) * (100 - percent) // (100 + percent)
        if differ:
            spread = math.ceil(differ * 10 ** (ODDS / math.ceil(low * percent / 100)))
            out.append(Space(number, low, high, top, differ, 0 if low <= TINY else max(spread, differ + 8 + math.ceil(0.15 * differ))))
        low, number = high + 1, number + 1
    return out


def digests(sets: Sets, known: list[Space]) -> tuple[np.ndarray, np.ndarray]:
    """(digest of a fragment, class) for all non-empty fragments of all sets in all their spaces."""
    size = np.diff(sets.first)
    out, of = [], []
    for s in known:
        own = np.flatnonzero((size >= s.low) & (size <= s.top))
        if not len(own):
            continue
        text = np.repeat(own, size[own])
        at = np.arange(len(text)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + sets.first[:-1][text]
        g = sets.grams[at]
        if s.fragments:
            fragment = ((g >> np.uint64(32)) * np.uint64(s.fragments)) >> np.uint64(32)  # ranges of the order
            begin = np.flatnonzero(np.concatenate([[True], (fragment[1:] != fragment[:-1]) | (text[1:] != text[:-1])]))
            content = np.add.reduceat(mix(g ^ _B), begin) + fragment[begin] * _A
        else:
            begin, content = np.arange(len(g)), g
        out.append(mix(content + np.uint64((s.number + 1) * int(_B) & 0xFFFFFFFFFFFFFFFF)))
        of.append(sets.cls[text[begin]])
    return (np.concatenate(out), np.concatenate(of)) if out else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _candidates(n: int, percent: int, buckets: int):
    """Classes by bucket, each with how many digests it has there and their last 48 bits; distinct within what a task holds at a time."""

    def flush(held):
        d, c = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((d, c, bucket_of(d, buckets)))
        d, c = d[by], c[by]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
        d, c = d[new], c[new]
        bucket = bucket_of(d, buckets)
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(d) else []
        for i, j in zip(edge, [*edge[1:], len(d)]) if len(d) else ():
            own = c[i:j]
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            many = np.diff(np.append(begin, j - i)).astype(np.uint32)
            last = np.ascontiguousarray(d[i:j]).view(np.uint8).reshape(-1, 8)[:, :6]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(bucket[i])], pa.int32()), "cls": pa.array([own[begin].tobytes()], pa.binary()), "many": pa.array([many.tobytes()], pa.binary()), "digest": pa.array([last.tobytes()], pa.binary())})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(part.column("text"), n)
                held.append(digests(sets, spaces(int(np.diff(sets.first).max(initial=0)), percent)))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The sets of two classes or more that have a digest of a bucket, once however many digests they share; named by a hash of the set."""
    last = np.concatenate([np.frombuffer(x.as_py(), np.uint8).reshape(-1, 6) for x in table["digest"]])
    d = np.zeros((len(last), 8), np.uint8)
    d[:, :6] = last
    d = d.view(np.uint64).ravel()
    c = np.concatenate([np.repeat(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint32)) for x, y in zip(table["cls"], table["many"], strict=True)])
    by = np.lexsort((c, d))
    d, c = d[by], c[by]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    d, c = d[new], c[new]
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(d)))
    name = mix(np.add.reduceat(mix(c), first) + size.astype(np.uint64)) if len(d) else np.empty(0, np.uint64)
    group = np.flatnonzero(size > 1)
    group = group[np.unique(name[group], return_index=True)[1]]
    at = np.repeat(first[group] - (np.cumsum(size[group]) - size[group]), size[group]) + np.arange(size[group].sum())
    return pa.table({"digest": pa.array(np.repeat(name[group], size[group]).view(np.int64)), "cls": pa.array(c[at].view(np.int64))})


def _fragments(cut: int):
    """``cid, fragment, part``: every set cut at the same places of the order."""

    def run(batches):
        for batch in batches:
            cid, fragment, parts = [], [], []
            for c, raw in zip(batch.column("cid").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                for b, part in split(np.frombuffer(raw, np.uint64), cut):
                    cid.append(c)
                    fragment.append(b)
                    parts.append(np.frombuffer(raw, np.int64)[part])
            yield pa.RecordBatch.from_pydict({"cid": pa.array(cid, pa.int64()), "fragment": pa.array(fragment, pa.int32()), "part": pa.array(parts, pa.list_(pa.int64()))})

    return run


def linked(pairs: DataFrame, sets: DataFrame, percent: int, fragments: int = FRAGMENTS) -> DataFrame:
    """The ``pairs`` (a, b, na, nb) that link: the overlaps of the fragments of ``sets`` (cid, grams), counted in each, are summed."""
    parts = sets.mapInArrow(_fragments(fragments), "cid long, fragment int, part array<long>")
    left = parts.select(F.col("cid").alias("a"), "fragment", F.col("part").alias("pa"))
    right = parts.select(F.col("cid").alias("b"), "fragment", F.col("part").alias("pb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("common"))
    sums = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return sums.where((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def outline(grams: np.ndarray) -> bytes:
    """A bit for each of four to eight times as many fine fragments of the order as the set has n-grams: whether it has any there."""
    bits = max(6, (4 * len(grams) - 1).bit_length())
    there = np.zeros(1 << bits, bool)
    there[(grams >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(there, bitorder="little").tobytes()


class Outlines(NamedTuple):
    """Outlines in the same fragments, and how many n-grams each set has beyond one for each of its fragments."""

    bits: np.ndarray
    spare: np.ndarray


def folded(shapes: list[bytes], n: np.ndarray, size: int) -> Outlines:
    """Outlines of sets of ``n`` n-grams in ``size`` bytes, which are no more than any of them has."""
    out = np.empty((len(shapes), size), np.uint8)
    for length in {len(x) for x in shapes}:
        at = [i for i, x in enumerate(shapes) if len(x) == length]
        raw = np.frombuffer(b"".join(shapes[i] for i in at), np.uint8).reshape(len(at), length)
        if length > size:
            wide = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(at), 8 * size, length // size)
            raw = np.packbits(wide.any(axis=2), axis=1, bitorder="little")
        out[at] = raw
    words = out.view(np.uint64)
    return Outlines(words, n - np.bitwise_count(words).sum(axis=1, dtype=np.int64))


def most_common(one: Outlines, many: Outlines) -> np.ndarray:
    """The most n-grams that a set can share with others: one for each fragment that both have, and what the lesser of their spare ones adds."""
    return np.bitwise_count(many.bits & one.bits).sum(axis=1, dtype=np.int64) + np.minimum(one.spare, many.spare)


def _allowed(percent: int):
    """Pairs ``a, b`` whose outlines ``sa, sb`` allow a link."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            most = np.empty(len(batch), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                size = min(len(x), len(y))
                most[i] = most_common(folded([x], na[i : i + 1], size), folded([y], nb[i : i + 1], size))[0]
            ok = pa.array((100 + percent) * most >= percent * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"])

    return run


def _within(percent: int):
    """``tile, cid, n, component, partners`` of the members of a bucket's tiles with whom the outlines of another component's members allow a link."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tile, n, side, comp, cid, low, high = (table[c].to_numpy() for c in ("tile", "n", "side", "component", "cid", "low", "high"))
        shape = table["sketch"].combine_chunks()
        by = np.argsort(tile, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], tile[by][1:] != tile[by][:-1]])) if len(by) else []
        rows, partners, asked = [], [], set()
        for i, j in zip(edge, [*edge[1:], len(by)]) if len(by) else ():
            own = by[i:j]
            one_side = low[own[0]] == high[own[0]]
            left, right = own[side[own] == low[own[0]]], own[side[own] == high[own[0]]]
            if not len(left) or not len(right):
                continue
            raw = {int(k): shape[int(k)].as_py() for k in own}
            length = np.array([len(raw[int(k)]) for k in right])
            least = {}  # the outlines of the right side in as many fragments as a shorter partner has
            pairs: dict[int, list[int]] = {}
            for x in left:
                ok = (comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))
                if one_side:
                    ok &= cid[right] > cid[x]
                mine = len(raw[int(x)])
                for size in {min(mine, int(k)) for k in np.unique(length[ok])}:
                    if size not in least:
                        at = np.flatnonzero(length >= size)
                        place = np.full(len(right), -1)
                        place[at] = np.arange(len(at))
                        least[size] = place, folded([raw[int(k)] for k in right[at]], n[right[at]], size)
                    place, shapes = least[size]
                    some = np.flatnonzero(ok & (np.minimum(length, mine) == size))
                    others = Outlines(shapes.bits[place[some]], shapes.spare[place[some]])
                    some = some[(100 + percent) * most_common(folded([raw[int(x)]], n[x : x + 1], size), others) >= percent * (n[right[some]] + n[x])]
                    for k in right[some].tolist():
                        pair = (cid[x], cid[k]) if cid[x] < cid[k] else (cid[k], cid[x])
                        if pair not in asked:
                            asked.add(pair)
                            pairs.setdefault(int(x), []).append(int(cid[k]))
                            pairs.setdefault(k, [])
            rows += pairs
            partners += [np.array(x, np.int64).tobytes() for x in pairs.values()]
        rows = np.array(rows, np.int64)
        return pa.table({"tile": pa.array(tile[rows]), "cid": pa.array(cid[rows]), "n": pa.array(n[rows]), "component": pa.array(comp[rows]), "partners": pa.array(partners, pa.binary())})

    return run


def _links(own: DataFrame, classes: DataFrame, n: int, percent: int, fragments: int) -> DataFrame:
    """``cid, component`` of all classes that link with another."""
    buckets = buckets_for(own, "text")
    dealt = small_batches(own.select("text").where("text is not null")).mapInArrow(_candidates(n, percent, buckets), "bucket int, cls binary, many binary, digest binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "digest long, cls long").distinct().withColumnRenamed("cls", "half")
    members = materialize(shared.join(classes.select("half", "cid"), "half").select(F.col("digest").alias("key"), "cid"))
    about = classes.select("cid", "n", "sketch")
    leader = members.groupBy("key").agg(F.min("cid").alias("a"))
    led = materialize(members.join(leader, "key").where("a <> cid"))  # all but the leaders, whose pairs are asked here
    stars = led.select("a", F.col("cid").alias("b")).distinct()
    both = stars.join(about.withColumnsRenamed({"cid": "b", "n": "nb", "sketch": "sb"}), "b").join(about.withColumnsRenamed({"cid": "a", "n": "na", "sketch": "sa"}), "a")
    both = both.where(may(percent, F.col("na"), F.col("nb"))).select("a", "b", "na", "nb", "sa", "sb")
    pairs = materialize(both.mapInArrow(_allowed(percent), "a long, b long, na long, nb long"))
    needed = materialize(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct().join(classes.select("cid", "cls"), "cid"))
    sets, held = sets_of_classes(own, needed, n)
    sets = materialize(sets.select("cid", "grams"))
    held.destroy()
    links = materialize(linked(pairs, sets, percent, fragments))
    discard(sets, needed)
    labels = components(links).withColumnRenamed("node", "cid")

    open_ = tiles_of(led, labels, about, TILE)
    # tiles of one leader hold much the same members, and meet in a bucket that asks a pair once
    bucket = F.pmod(F.xxhash64("a", "low", "high"), F.lit(members.count() // 20_000 + 1)).alias("bucket")
    dealt = open_.select(bucket, "low", "high", "side", "tile", "cid", "n", "component", "sketch").groupBy("bucket")
    found = materialize(dealt.applyInArrow(_within(percent), "tile long, cid long, n long, component long, partners binary").join(classes.select("cid", "cls"), "cid"))
    rest = connected(own, found, n, percent)
    if not rest.isEmpty():
        labels = components(links.unionByName(rest)).withColumnRenamed("node", "cid")
    discard(members, led, pairs, links, found, rest)
    return labels


def _rows(own: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """``own`` with ``n_shingles``, ``cls``, its first half, and in a task's first row of a class its outline."""
    seen: set[bytes] = set()

    def about(part: pa.RecordBatch) -> list:
        sets = sets_of(part.column("text"), n)
        ids = class_ids(sets)
        if len(seen) > 1_000_000:
            seen.clear()
        shapes = [None if c is None or c in seen or seen.add(c) else outline(sets.grams[sets.first[i] : sets.first[i + 1]]) for i, c in enumerate(ids)]
        return [pa.array(np.diff(sets.first)), pa.array(ids, pa.binary()), pa.array(sets.cls.view(np.int64)), pa.array(shapes, pa.binary())]

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("half", T.LongType()), T.StructField("sketch", T.BinaryType())]
    return append(own, about, fields, "text", keep)


def _labelled(docs: DataFrame, key: str, text: str, n: int, percent: int, fragments: int) -> DataFrame:
    """``key, rid, n_shingles, component, component_id`` for every row; ``component`` numbers what is linked, and is NULL for empty sets."""
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("rid"))
    rows = materialize(_rows(own, n, ["key", "rid"]))
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("cls").agg(F.min("key").alias("least"), F.first("half").alias("half"), F.first("n_shingles").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))  # numbers that the written table fixes
    labels = _links(own, classes, n, percent, fragments)
    joined = classes.select("cls", "cid", "least", "copies").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    joined = materialize(joined)
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    found = joined.join(ids, "component").select("cls", "copies", "component", "component_id")
    out = joined_by_class(full.drop("sketch", "half"), found).select("key", "rid", "n_shingles", "component", "component_id")
    alone = rows.where("n_shingles = 0").select("key", "rid", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("key").alias("component_id"))
    out = materialize(out.unionByName(alone))
    discard(rows, classes, joined)
    return out


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """``key, rid, n_shingles, component_id`` for every row of ``docs``: the least key that links reach, and a hash of the row's text.

    Two rows link when ``100 * common >= percent * union`` of their sets of distinct ``n``-word shingles.  A text with fewer words
    has its whole sequence as its only shingle; NULL and texts without words have empty sets and link with nothing.  Keys that are NULL
    count as greater than all others.  Repeated rows link like copies.  Long texts are read whole.  Other columns are not looked at.
    """
    found = _labelled(docs, key, text, n, percent, fragments)
    return found.select(F.col("key").alias(key), "rid", "n_shingles", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: that with the least key, of several with that key the one of the least text hash, of equal ones any.

    Rows with empty sets or NULL keys stay, and so do rows that share a key but aren't linked.  Columns may have any names.
    """
    found = _labelled(docs, key, text, n, percent, FRAGMENTS).where("n_shingles > 0 and key is not null")
    chosen = found.groupBy("component").agg(F.min(F.struct("key", "rid")).alias("one")).select(F.col("one.key").alias("k"), F.col("one.rid").alias("r")).distinct()
    named = lambda c: F.col(f"`{c}`")
    rows = docs.select(named(key).alias("key"), F.xxhash64(named(text).cast("string")).alias("rid"), has_words(named(text).cast("string")).alias("full"), F.struct(*[named(c) for c in docs.columns]).alias("row"))
    asked = F.col("full") & F.col("key").isNotNull()
    some = rows.where(asked).join(chosen, (F.col("key") == F.col("k")) & (F.col("rid") == F.col("r")))
    one = some.withColumn("turn", F.row_number().over(Window.partitionBy("key", "rid").orderBy("rid"))).where("turn = 1")
    return one.select("row.*").unionByName(rows.where(~F.coalesce(asked, F.lit(False))).select("row.*"))


def has_words(text: Column) -> Column:
    """Whether a text has a word; NULL has none."""
    return F.coalesce(F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")) > 0, F.lit(False))
