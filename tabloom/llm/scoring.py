"""Language-model scores from a log-frequency Bloom filter.

An n-gram seen c times is entered once for every power of two (times the least count) up to c, so the number of membership
probes that succeed in a row gives its count on a logarithmic scale.  Counting is by hash buckets: tasks add up what they read, send sorted
arrays of hashes and counts, and each bucket becomes one part of the filter.  The filter is broadcast in shards of bounded size, one pass
over the texts each.  Exact counts of single tokens, for the base score, come from a broadcast of the commonest ones,
bounded likewise, and from a join of all others by bucket.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.llm.batches import NOT_BLANK, UPPER, append, free, as_bytes, mix, slices, small_batches, words
from tabloom.session import materialize

ORDER = 2
LEAST = 1  # count from which n-grams are entered: all that were seen
BITS = 10  # of the filter for an entry
PROBES = 4
KAPPA = 40.0  # weight of the lower order against the count of the history
BUCKET_BYTES = 16 << 20  # of text for each bucket
FLUSH = 1_500_000  # counts that a task holds
SHARD_BYTES = 192 << 20
COMMON = 1_000_000  # tokens whose exact counts are broadcast, at most
END = np.uint64(0x5851F42D4C957F2D)  # the token behind every text, which is also the history of its first token
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each followed by END, and where the tokens of each text begin."""
    data, offsets = as_bytes(column)
    data = UPPER[data]
    found = words(data, offsets, NOT_BLANK)
    return np.insert(found.hash, found.first[1:], END), found.first + np.arange(len(found.first))


def ngrams(token: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams of ``order`` that end with each token; histories don't reach behind an END."""
    out, history, open_ = token, token, np.ones(len(token), bool)
    for _ in range(order - 1):
        history = np.concatenate([[END], history[:-1]])
        history = np.where(open_, history, END)
        open_ = open_ & (history != END)
        out = mix(out * _A + history * _B)
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of ``buckets`` equal ranges of 32-bit prefixes a hash lies in; ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    return hashes[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def split(hashes: np.ndarray, buckets: int):
    """(bucket, slice) of sorted hashes."""
    if not len(hashes):
        return []
    b = bucket_of(hashes, buckets)
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    return [(int(b[i]), slice(i, j)) for i, j in zip(at, [*at[1:], len(b)], strict=True)]


def gathered(docs: DataFrame, text: str, kinds: int, hashes_of, buckets: int) -> DataFrame:
    """``kind, bucket, hashes, counts``: the hashes that ``hashes_of(column)`` finds, by kind, in slices of texts, added up within tasks."""

    def flush(held):
        for kind, parts in enumerate(held):
            if parts:
                h, n = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                for b, part in split(h, buckets):
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind + 1], pa.int32()), "bucket": pa.array([b], pa.int32()), "hashes": pa.array([h[part].tobytes()], pa.binary()), "counts": pa.array([n[part].astype(np.uint32).tobytes()], pa.binary())})
            parts.clear()

    def run(batches):
        held: list[list] = [[] for _ in range(kinds)]
        size = 0
        for batch in batches:
            for part in slices(batch, text):
                for kind, hashes in enumerate(hashes_of(part.column(text))):
                    held[kind].append(np.unique(hashes, return_counts=True))
                    size += len(held[kind][-1][0])
                if size > FLUSH:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    return small_batches(docs.select(text)).mapInArrow(run, "kind int, bucket int, hashes binary, counts binary")


def _all_orders(order: int):
    def hashes(column: pa.Array):
        token, _ = tokens(column)
        return (ngrams(token, k) for k in range(1, order + 1))

    return hashes


def buckets_for(docs: DataFrame, text: str) -> int:
    return int((docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0) // BUCKET_BYTES) + 1


def build_part(hashes: np.ndarray, counts: np.ndarray, least: int = 2) -> np.ndarray:
    """Bits, packed, of the filter for one bucket: an n-gram is entered at levels 1 to 1 + floor(log2(count / least)); ``train`` gives LEAST."""
    seen = counts >= least
    h, level = hashes[seen], np.floor(np.log2(counts[seen] / least)).astype(np.int64) + 1
    bits = np.zeros(max(64, int(level.sum()) * BITS // 8 * 8 + 8), bool)
    for i in range(1, int(level.max()) + 1 if len(level) else 1):
        for j in range(PROBES):
            bits[(_place(h[level >= i], i, j) % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _place(h: np.ndarray, level: int, j: int) -> np.ndarray:
    """The j-th place of an n-gram's entry at ``level``, before the division by the part's size."""
    x = mix(h + np.uint64(level * int(_A) & 0xFFFFFFFFFFFFFFFF))
    return x + np.uint64(j) * (mix(x ^ _B) | np.uint64(1))


def _reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One bucket of one order: its exact counts (of single tokens), totals and its part of the filter."""
    h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]])
    n = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["counts"]]).astype(np.int64)
    h, n = summed(h, n)
    one = key[0].as_py() == 1
    sizes = np.bincount(np.floor(np.log2(n)).astype(np.int64), minlength=64) if one else np.zeros(0, np.int64)
    return pa.table({
        "kind": pa.array([key[0].as_py()], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.int32()), "total": pa.array([int(n.sum())]), "types": pa.array([len(h)]), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
        "hashes": pa.array([h.tobytes() if one else None], pa.binary()), "counts": pa.array([n.tobytes() if one else None], pa.binary()), "filter": pa.array([build_part(h, n, LEAST).tobytes()], pa.binary()),
    })


class Filter(NamedTuple):
    """Some parts of the filter, end to end: ``begin[kind, bucket]`` in bytes, -1 for parts that are not here."""

    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    buckets: int

    def levels(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """How many probes in a row find each n-gram; -1 if its part is not here."""
        b = bucket_of(hashes, self.buckets)
        begin, bits = self.begin[kind, b] * 8, self.size[kind, b].astype(np.uint64) * np.uint64(8)
        out = np.where(begin >= 0, 0, -1).astype(np.int8)
        alive = np.flatnonzero(begin >= 0)
        level = 0
        while len(alive) and level < 63:  # no count has more bits
            level += 1
            for j in range(PROBES):
                place = _place(hashes[alive], level, j)
                bit = begin[alive] + (place % bits[alive]).astype(np.int64)
                alive = alive[self.data[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1]
            out[alive] = level
        return out


class Model(NamedTuple):
    """What scoring needs, but for the shards of the filter, which are read from ``counted`` when their turn comes."""

    counted: DataFrame
    buckets: int
    order: int
    total: int  # training tokens
    types: int


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Counts of all n-grams of ``docs`` up to ``order``; NULL and empty texts are just an end."""
    buckets = buckets_for(docs, text)
    schema = "kind int, bucket int, total long, types long, sizes array<long>, hashes binary, counts binary, filter binary"
    counted = materialize(gathered(docs, text, order, _all_orders(order), buckets).groupBy("kind", "bucket").applyInArrow(_reduce, schema))
    row = counted.where("kind = 1").agg(F.sum("total"), F.sum("types")).first()
    return Model(counted, buckets, order, row[0] or 0, row[1] or 0)


def shards(counted: DataFrame, kinds: int, buckets: int):
    """The parts of the filter in ``counted``, in shards of about SHARD_BYTES; each is collected only when it is asked for."""
    parts = counted.select("kind", "bucket", F.octet_length("filter").alias("n")).orderBy("bucket", "kind").collect()
    groups, used = [[]], 0
    for p in parts:
        if used + p.n > SHARD_BYTES and groups[-1]:
            groups.append([])
            used = 0
        groups[-1].append(p)
        used += p.n
    for group in groups:
        ask = F.array(*[F.lit(p.bucket * 64 + p.kind) for p in group]) if group else F.array(F.lit(-1))
        begin, size = np.full((kinds + 1, buckets), -1, np.int64), np.zeros((kinds + 1, buckets), np.int64)
        data, at = np.zeros(sum(p.n for p in group) + 1, np.uint8), 0
        # partition by partition, so that the driver holds a shard once
        for r in counted.where(F.array_contains(ask, F.col("bucket") * 64 + F.col("kind"))).select("kind", "bucket", "filter").toLocalIterator():
            n = len(r.filter)
            begin[r.kind, r.bucket], size[r.kind, r.bucket] = at, n
            data[at : at + n] = np.frombuffer(r.filter, np.uint8)
            at += n
        yield Filter(data, begin, size, buckets)


def common(model: Model, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and exact counts of the tokens at least so common that there are ``most`` of them or fewer."""
    sizes = np.zeros(64, np.int64)
    for r in model.counted.where("kind = 1").select("sizes").collect():
        sizes += np.array(r.sizes)
    above = np.cumsum(sizes[::-1])[::-1]
    least = 1 << int(np.argmax(np.append(above, 0) <= most))

    def run(batches):
        for batch in batches:
            for h, n in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                h, n = np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_pydict({"h": pa.array([h[n >= least].tobytes()], pa.binary()), "n": pa.array([n[n >= least].tobytes()], pa.binary())})

    rows = small_batches(model.counted.where("kind = 1").select("hashes", "counts")).mapInArrow(run, "h binary, n binary").collect()
    h, n = np.frombuffer(b"".join(bytes(r.h) for r in rows), np.uint64), np.frombuffer(b"".join(bytes(r.n) for r in rows), np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def estimate(level: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The middle of the counts that share a level (1, 2-3, 4-7, ... from a least count of 1); 0 for an n-gram that no probe finds."""
    return np.where(level > 0, least * 2.0 ** (level - 1.0) * 1.5 - 0.5, 0.0)


def log_probabilities(levels: list[np.ndarray], histories: list[np.ndarray], total: int, types: int) -> np.ndarray:
    """log10 of the interpolated probability of every token; ``histories[k]`` are the levels of the history of ``levels[k]``."""
    p = (estimate(levels[0]) + 1) / (total + types + 1)
    for level, history in zip(levels[1:], histories[1:], strict=True):
        h, c = estimate(history), estimate(level)
        weight = h / (h + KAPPA)
        p = weight * np.minimum(1.0, c / np.maximum(h, 1.0)) + (1 - weight) * p
    return np.log10(p)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, most: int = COMMON) -> DataFrame:
    """``docs`` (its columns in ``keep``) with ``n_tokens``, ``n_known``, ``base_score`` and ``score``.

    ``n_known`` and ``base_score`` use exact counts, ``score`` the filter alone.  NULL and empty texts are just an end.  Rows are told
    apart by a number of their own, so keys may repeat or be NULL; columns with the names of the results give way.
    """
    new = ["n_tokens", "n_known", "base_score", "score"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    out, shown, sent = docs, [*kept, *([] if text in kept else [text])], []
    lev, row, also, known_, sum_, rest_ = (free([*docs.columns, *new], c) for c in ("levels", "row", "also", "known", "base", "rest"))
    fields = [T.StructField(lev, T.BinaryType())]
    for i, shard in enumerate(shards(model.counted, model.order, model.buckets)):
        sent.append(docs.sparkSession.sparkContext.broadcast(shard))
        del shard
        out = append(out.select(*(f"`{c}`" for c in shown), *([f"`{lev}`"] if i else [])), _probe(sent[-1], model.order, text, i == 0, lev), fields, text, shown, needs=[lev] if i else [])
    known = docs.sparkSession.sparkContext.broadcast(common(model, most))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField(known_, T.LongType()), T.StructField(sum_, T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField(rest_, T.BinaryType())]
    rows = append(out, _finish(known, model.order, model.total, model.types, text, lev), fields, text, kept, needs=[lev])
    rows = materialize(rows.withColumn(row, F.monotonically_increasing_id()))
    for x in (*sent, known):
        x.destroy()  # the written rows don't need them
    rest = _rest_counts(rows.select(F.col(row).alias("_row"), F.col(rest_).alias("_rest")), model).select(F.col("_row").alias(row), F.col("_also").alias(also), F.col("_more").alias(also + "_more"))
    both = rows.drop(rest_).join(rest, row, "left")
    base = F.col(sum_) + F.coalesce(also + "_more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(model.total + model.types + 1))
    return both.select(*(f"`{c}`" for c in kept), "n_tokens", (F.col(known_) + F.coalesce(also, F.lit(0))).alias("n_known"), base.alias("base_score"), "score")


def _probe(held, order: int, text: str, first: bool, lev: str):
    def run(part: pa.RecordBatch) -> list:
        token, of = tokens(part.column(text))
        found = []
        for kind in range(1, order + 1):
            h, which = np.unique(ngrams(token, kind), return_inverse=True)
            found.append(held.value.levels(kind, h)[which])
        levels = np.stack(found, axis=1)
        if not first:
            before = np.frombuffer(as_bytes(part.column(lev))[0].tobytes(), np.int8).reshape(levels.shape)
            levels = np.maximum(levels, before)
        return [pa.array([levels[a:b].tobytes() for a, b in zip(of[:-1], of[1:], strict=True)], pa.binary())]

    return run


def _finish(known, order: int, total: int, types: int, text: str, lev: str):
    def run(part: pa.RecordBatch) -> list:
        token, of = tokens(part.column(text))
        levels = np.maximum(0, np.frombuffer(as_bytes(part.column(lev))[0].tobytes(), np.int8).reshape(len(token), order))
        end = np.flatnonzero(token == END)
        level_end = levels[end[0], 0] if len(end) else 0
        before = np.vstack([np.full((1, order), level_end), levels[:-1]])
        starts = of[:-1]
        before[starts] = level_end  # the history of a first token is an END
        columns = [levels[:, k] for k in range(order)]
        histories = [columns[0], *(before[:, k] for k in range(order - 1))]
        log_p = log_probabilities(columns, histories, total, types)
        hashes, counts = known.value
        u, which = np.unique(token, return_inverse=True)
        at = np.minimum(np.searchsorted(hashes, u), max(0, len(hashes) - 1))
        there = hashes[at] == u if len(hashes) else np.zeros(len(u), bool)
        c = np.where(there, counts[at], 0) if len(hashes) else np.zeros(len(u), np.int64)
        there, c = there[which], c[which]
        sums = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        rest = [token[a:b][~there[a:b]].tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]
        return [pa.array(np.diff(of)), pa.array(sums(there.astype(np.int64))), pa.array(sums(np.log10(c + 1.0) * there)), pa.array(sums(log_p)), pa.array(rest, pa.binary())]

    return run


def _rest_counts(rows: DataFrame, model: Model) -> DataFrame:
    """``_row, _also, _more``: number and sum of log10(count + 1) of the known tokens among those in ``_rest``."""
    buckets = model.buckets

    def deal(batches):
        for batch in batches:
            data, offsets = as_bytes(batch.column("_rest"))
            h = np.frombuffer(data.tobytes(), np.uint64)
            if not len(h):
                continue
            row = np.repeat(batch.column("_row").to_numpy(), np.diff(offsets) // 8)
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            for b, part in split(h, buckets):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "h": pa.array([h[part].tobytes()], pa.binary()), "row": pa.array([row[part].tobytes()], pa.binary())})

    def look(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        h = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in left["h"])])
        row = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x.as_py(), np.int64) for x in left["row"])])
        keys = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in right["hashes"])])
        n = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x.as_py(), np.int64) for x in right["counts"])])
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        there = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        u, which = np.unique(row[there], return_inverse=True)
        more = np.bincount(which, np.log10(n[at[there]] + 1.0), len(u)) if len(u) else np.empty(0)
        return pa.table({"_row": pa.array(u, pa.int64()), "_also": pa.array(np.bincount(which, minlength=len(u)) if len(u) else [], pa.int64()), "_more": pa.array(more, pa.float64())})

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    dealt = rows.mapInArrow(deal, "bucket int, h binary, row binary")
    counts = model.counted.where("kind = 1").select("bucket", "hashes", "counts")
    looked = dealt.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(look, "_row long, _also long, _more double")
    return looked.groupBy("_row").agg(F.sum("_also").alias("_also"), F.sum("_more").alias("_more"))
