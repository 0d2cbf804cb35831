"""Collocations by stripes: every prefix of words has a counter of the words that come next.

A pass over the texts counts words; a second one makes the stripes of single words, a third those of two to four words.  Tasks add up the
stripes of what they read; stripes of the same prefix are then merged element by element.  One merged stripe gives the counts of a
phrase's extensions, their largest, and, with the counter ``OTHER`` of all that is not followed up, how often the prefix itself occurs.
A phrase that occurs often has only parts that do, so what a sieve of the frequent shorter ones doesn't know goes into ``OTHER``.  A
stripe is cut by the hashes of its next words over all buckets, so the stripe of a very common word is in no single task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.llm import sieve
from tabloom.llm.batches import UPPER, as_bytes, mix, slices, small_batches, words
from tabloom.llm.scoring import bucket_of, buckets_for
from tabloom.session import discard, materialize, small_side

LONGEST = 5
LEAST = 100
TOP = 2000
FLUSH = 2_000_000  # words that a task holds before it sends stripes
OTHER = np.uint64(0)
#: Bytes that end a piece, and bytes of words.
ENDS = np.isin(np.arange(256), [*b".,;:!?", 10, 11, 12, 13])
WORD = ~(ENDS | np.isin(np.arange(256), [9, 32]))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Tokens(NamedTuple):
    """Words of a slice: ``id`` hashes language and word; ``more[i]`` says that word i + 1 is in the same piece."""

    id: np.ndarray
    more: np.ndarray
    text: np.ndarray  # row of the slice
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def tokens(part: pa.RecordBatch) -> Tokens:
    data, offsets = as_bytes(part.column("text"))
    data = UPPER[data]
    found = words(data, offsets, WORD)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(found.first))
    lang = part.column("lang").dictionary_encode()
    salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in lang.dictionary.to_pylist()], np.uint64)
    id_ = mix(found.hash + salts[lang.indices.to_numpy()][text]) if len(text) else np.empty(0, np.uint64)
    piece = np.cumsum(ENDS[data])[found.start] if len(text) else text
    more = np.zeros(len(text), bool)
    more[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return Tokens(np.maximum(id_, np.uint64(1)), more, text, found.start, found.end, data)


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Ids of phrases from the ids of what is before their last words and these."""
    return np.maximum(mix(prefix * _A + word * _B + _B), np.uint64(1))


def _strings(t: Tokens, which: np.ndarray) -> pa.Array:
    start, size = t.start[which], (t.end - t.start)[which]
    to = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(to[-1]) + np.repeat(start - to[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(t.data[at])])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, id, word, n`` of all words, added up over what a task holds at a time."""

    def flush() -> pa.RecordBatch:
        ids, first, which = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        n = np.bincount(which, np.concatenate([h[1] for h in held]), len(ids)).astype(np.int64)
        lang, word = (pa.concat_arrays([h[k] for h in held]).take(pa.array(first)).cast(pa.string()) for k in (2, 3))
        return pa.RecordBatch.from_pydict({"lang": lang, "id": pa.array(ids.view(np.int64)), "word": word, "n": pa.array(n)})

    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            t = tokens(part)
            ids, first, n = np.unique(t.id, return_index=True, return_counts=True)
            held.append((ids, n, part.column("lang").take(pa.array(t.text[first])), _strings(t, first)))
            size += len(ids)
            if size > FLUSH // 4:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def summed(prefix: np.ndarray, following: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs added up, in the order of prefixes."""
    by = np.lexsort((following, prefix))
    prefix, following, n = prefix[by], following[by], n[by]
    at = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (following[1:] != following[:-1])])) if len(by) else np.empty(0, np.int64)
    return prefix[at], following[at], np.add.reduceat(n, at) if len(at) else n


def stripes_of(t: Tokens, known: sieve.Sieve, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words in the prefix, prefixes, next words or OTHER) of a slice.

    For single words the sieve knows the frequent words, for longer prefixes the frequent pairs; a prefix has only pairs that it knows.
    """
    n = len(t.id)
    if lengths == [1]:
        good = known.has(t.id)
        following = np.full(n, OTHER)
        next_ = t.more[:-1] & good[1:]
        following[:-1][next_] = t.id[1:][next_]
        yield 1, t.id[good], following[good]
        return
    pair = np.zeros(n, np.uint64)
    pair[:-1] = longer(t.id[:-1], t.id[1:])
    open_ = t.more & known.has(pair)  # the pair that begins at a word is frequent
    at, prefix = np.flatnonzero(open_), pair[open_]
    for m in range(2, max(lengths) + 1):
        last = at + m - 1
        goes_on = open_[last]
        following = np.full(len(at), OTHER)
        following[goes_on] = t.id[last[goes_on] + 1]
        yield m, prefix, following
        at, prefix = at[goes_on], longer(prefix[goes_on], following[goes_on])


def _stripes(known: Broadcast, lengths: list[int], buckets: int):
    def flush(held):
        for m, parts in held.items():
            prefix, following, n = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            bucket = bucket_of(mix(prefix ^ mix(following + _A)), buckets)
            by = np.argsort(bucket, kind="stable")  # prefixes stay in order within a bucket
            prefix, following, n, bucket = prefix[by], following[by], n[by], bucket[by]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(by) else []
            for i, j in zip(edge, [*edge[1:], len(by)]) if len(by) else ():
                begin = np.flatnonzero(np.concatenate([[True], prefix[i + 1 : j] != prefix[i : j - 1]]))
                size = np.diff(np.append(begin, j - i)).astype(np.uint32)
                yield pa.RecordBatch.from_pydict({
                    "m": pa.array([m], pa.int32()), "bucket": pa.array([int(bucket[i])], pa.int32()), "prefix": pa.array([prefix[i:j][begin].tobytes()], pa.binary()), "size": pa.array([size.tobytes()], pa.binary()),
                    "following": pa.array([following[i:j].tobytes()], pa.binary()), "n": pa.array([n[i:j].astype(np.uint32).tobytes()], pa.binary()),
                })

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for part in slices(batch, "text"):
                for m, prefix, following in stripes_of(tokens(part), known.value, lengths):
                    held.setdefault(m, []).append(summed(prefix, following, np.ones(len(prefix), np.int64)))
                    size += len(held[m][-1][0])
                if size > FLUSH:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return run


def _merge(least: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The merged stripes of a bucket: extensions from ``least``, and as next word NULL what each prefix has here in all."""
        many = [np.repeat(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(s.as_py(), np.uint32)) for p, s in zip(table["prefix"], table["size"], strict=True)]
        following = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["following"]])
        n = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["n"]]).astype(np.int64)
        prefix, following, n = summed(np.concatenate(many), following, n)
        begin = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        total = np.add.reduceat(n, begin)
        often = (n >= least) & (following != OTHER)
        out = pa.concat_arrays([pa.array(following[often].view(np.int64)), pa.nulls(len(begin), pa.int64())])
        return pa.table({"m": pa.array(np.full(len(out), key[0].as_py(), np.int32)), "prefix": pa.array(np.concatenate([prefix[often], prefix[begin]]).view(np.int64)), "following": out, "n": pa.array(np.concatenate([n[often], total]))})

    return run


def merged_stripes(docs: DataFrame, known: DataFrame, lengths: list[int], least: int, buckets: int) -> DataFrame:
    """``m, prefix, following, n``: the frequent extensions of all prefixes of ``lengths`` words and, with ``following`` NULL, totals of frequent prefixes."""
    held = docs.sparkSession.sparkContext.broadcast(sieve.build(known))
    sent = small_batches(docs).mapInArrow(_stripes(held, lengths, buckets), "m int, bucket int, prefix binary, size binary, following binary, n binary")
    found = sent.groupBy("m", "bucket").applyInArrow(_merge(least), "m int, prefix long, following long, n long")
    out = materialize(found.groupBy("m", "prefix", "following").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    held.destroy()
    return out


def _phrase_ids(names: list[str]):
    def run(batches):
        for batch in batches:
            ids = longer(*(batch.column(c).to_numpy().view(np.uint64) for c in ("prefix", "following")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ids.view(np.int64))], names=[*names, "id"])

    return run


def exact_div(a: Column, b: Column, c: Column, d: Column) -> Column:
    """floor(1000 a b / (c d)) of longs, exactly."""
    big = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (big(a) * big(b)).cast("decimal(34,0)"), (big(c) * big(d)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int | None = TOP, longest: int = LONGEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: phrases of 2 to ``longest`` words that occur ``least`` times or more.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at blanks and tabs.  ``a`` is how often
    a phrase occurs, ``n`` how many words its language has, ``l`` and ``r`` how often the parts of its weakest cut occur; the score is
    ``floor(1000 a n / (l r))``.  Phrases inside a longer one that occurs as often are left out.  NULL text is empty, NULL language is
    ``und``; texts without words count nothing; repeated rows count each; long texts are read whole.  Ties of the score go to the more
    frequent phrase, then to the lesser in the order of UTF-8 bytes.  Other columns are not looked at.  Words are told apart by 64-bit
    hashes, phrases by the hash of what is before the last word and that word's.
    """
    own = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    buckets = buckets_for(own, "text")
    counted = small_batches(own).mapInArrow(_words, "lang string, id long, word string, n long")
    counted = materialize(counted.groupBy("lang", "id", "word").agg(F.sum("n").alias("n")))
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    single = materialize(counted.where(F.col("n") >= least))

    one = merged_stripes(own, single.select("id"), [1], least, buckets)
    total = F.col("following").isNull()
    start = one.where(total).select("prefix", F.col("n").alias("f")).join(single.select(F.col("id").alias("prefix"), "lang"), "prefix")
    known = materialize(start.select("lang", F.array("prefix").alias("words"), "f", F.col("prefix").alias("id")))
    levels = [known]
    stripes = one
    for m in range(1, longest):
        pairs = stripes.where((F.col("m") == m) & ~total).select("prefix", "following", F.col("n").alias("f"))
        names = ["lang", "words", "f", "prefix", "following"]
        grown = pairs.join(levels[-1].select(F.col("id").alias("prefix"), "lang", "words"), "prefix").select("lang", F.array_append("words", F.col("following")).alias("words"), "f", "prefix", "following")
        levels.append(materialize(grown.mapInArrow(_phrase_ids(names), "lang string, words array<long>, f long, prefix long, following long, id long")))
        if m == 1 and longest > 2:
            stripes = merged_stripes(own, levels[-1].select("id"), list(range(2, longest)), least, buckets)
    every = levels[0].select("lang", "words", "f")
    for x in levels[1:]:
        every = every.unionByName(x.select("lang", "words", "f"))
    found = every.where(F.size("words") > 1)

    # the most that an extension by a word, to the right or to the left, occurs
    more = F.size("words")
    inside = found.where(more > 2)
    ends = inside.select("lang", F.slice("words", F.lit(1), more - 1).alias("words"), "f").unionByName(inside.select("lang", F.slice("words", F.lit(2), more - 1).alias("words"), "f"))
    most = ends.groupBy("lang", "words").agg(F.max("f").alias("most"))
    free = found.join(most, ["lang", "words"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("f"))).drop("most")

    cut = free.withColumn("k", F.explode(F.sequence(F.lit(1), more - 1)))
    cut = cut.select("lang", "words", "f", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, more - F.col("k")).alias("rest"))
    parts = cut.join(every.select("lang", F.col("words").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(every.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    parts = parts.join(small_side(sizes), "lang")
    scored = parts.withColumn("score", exact_div(F.col("f"), F.col("n"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "words", "f", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    weakest = weakest.select("lang", "words", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))

    by = [F.desc("score"), F.desc("a")]
    if top is not None:  # those that tie with the last one stay until their phrases are known
        weakest = weakest.withColumn("_r", F.rank().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("_r") <= top).drop("_r")
    weakest = materialize(weakest)
    spelled = weakest.select("lang", "words", F.posexplode("words").alias("at", "id")).join(single.select("lang", "id", "word"), ["lang", "id"])
    spelled = spelled.groupBy("lang", "words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("phrase"))
    ranked = weakest.join(spelled, ["lang", "words"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by, "phrase")).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    out = materialize(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    discard(counted, single, one, stripes if stripes is not one else None, *levels, weakest)
    return out
