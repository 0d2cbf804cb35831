"""Near-duplicates by MinHash with sequential Bayesian verification.

Texts with the same set of shingles are one class.  Signatures of classes are cut into bands, and classes that agree in a band are
candidates.  A candidate's signatures are compared batch by batch; after each the posterior probability, under a flat prior, that the
similarity reaches the threshold follows from the number of agreements so far, and a pair whose probability is below the chosen miss
probability goes.  Survivors are confirmed on their full sets.

Every bucket of candidates has a leader, and a class first is paired with the least leader of its buckets.  Buckets whose members are in one
component then are done.  In the others, signatures of different components are compared inside tasks, in tiles, each pair in the first band
that it shares; what leaves a task is a row for each member, with the numbers of its survivors.  Tiles then get their members' full sets, and
confirm survivors that no confirmed link connects yet.  So a group never becomes rows of all its pairs, and no pair of different components
is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.llm import sieve
from tabloom.llm.batches import append, as_bytes, mix, slices, small_batches
from tabloom.llm.graph import components
from tabloom.llm.shingles import Sets, sets_of
from tabloom.session import discard, materialize

N = 4
PERCENT = 80
ROWS, BANDS = 5, 52  # a pair at 80 % agrees in no band with odds of 1.1e-9; one at 20 % in any with 1.7e-2
BATCH = 52  # hashes that are compared at a time
MISS = 1e-9
TILE = 512  # members of a bucket that are compared with as many others
VERIFY_BYTES = 16 << 20  # of sets for each bucket of verification
SALT = 64  # pairs of a leader that are verified together
_SEEDS = np.random.default_rng(20240913).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = np.uint64(0xD1342543DE82EF95)


def least_agreements(percent: int, miss: float, hashes: int = ROWS * BANDS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, least agreements to go on): with fewer, the posterior probability of ``percent`` or more is below ``miss``.

    After m agreements among n, a flat prior makes the similarity Beta(m + 1, n - m + 1); that it is t or more has the probability of m
    or fewer successes in n + 1 trials of t.
    """
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def signatures(sets: Sets, which: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least of each hash over the sets ``which``, none of them empty: one row for each.

    Two sets with other least values share the bits of one hash in 65 536, which lets a pair through and never holds one back.
    """
    out = np.empty((len(which), len(_SEEDS)), np.uint16)
    size = np.diff(sets.first)[which]
    at = 0
    while at < len(which):  # so many sets at a time that their hashes stay in the cache
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 32768, "right")) + at)
        some, n = which[at:to], size[at:to]
        first = np.cumsum(n) - n
        g = sets.grams[np.arange(n.sum()) + np.repeat(sets.first[:-1][some] - first, n)]
        for j, seed in enumerate(_SEEDS):
            h = (g ^ seed) * _C
            h ^= h >> np.uint64(32)
            h *= seed
            out[at:to, j] = (np.minimum.reduceat(h, first) * _C) >> np.uint64(48)
        at = to
    return out


def class_ids(sets: Sets) -> list[bytes | None]:
    """128 bits of each set; NULL for the empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.grams * _C + _SEEDS[0]))])
    second = mix(total[sets.first[1:]] - total[sets.first[:-1]] + np.diff(sets.first).astype(np.uint64))
    both = np.stack([sets.cls, second], axis=1)
    return [b.tobytes() if n else None for b, n in zip(both, np.diff(sets.first), strict=True)]


def _rows(own: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """``own`` with ``n_shingles``, ``cls`` and, in a task's first row of a class, ``sig``."""
    seen: set[bytes] = set()

    def about(part: pa.RecordBatch) -> list:
        sets = sets_of(part.column("text"), n)
        ids = class_ids(sets)
        if len(seen) > 1_000_000:
            seen.clear()
        new = [i for i, c in enumerate(ids) if c is not None and not (c in seen or seen.add(c))]
        sig = [None] * len(ids)
        for i, row in zip(new, signatures(sets, np.array(new, np.int64)), strict=True):
            sig[i] = row.tobytes()
        return [pa.array(np.diff(sets.first)), pa.array(ids, pa.binary()), pa.array(sig, pa.binary())]

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("sig", T.BinaryType())]
    return append(own, about, fields, "text", keep)


def _bands(known):
    """``key, cid`` for all bands, or for those whose key the sieve ``known`` may have."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(as_bytes(batch.column("sig"))[0].tobytes(), np.uint16).reshape(len(batch), BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2])
            for k in range(ROWS):
                key = mix(key * _C + sig[:, :, k])
            key = (key & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)  # the last bits say which band it is
            key, cid = key.ravel(), np.repeat(batch.column("cid").to_numpy(), BANDS)
            if known is not None:
                some = known.value.has(key)
                key, cid = key[some], cid[some]
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "cid": pa.array(cid)})

    return run


def may(percent: int, a: Column, b: Column) -> Column:
    """Whether sets of these sizes can link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _survive(percent: int, miss: float):
    """Pairs ``a, b`` whose signatures ``sa, sb`` stay above the bound after every batch."""
    bounds = least_agreements(percent, miss)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(as_bytes(batch.column(c))[0].tobytes(), np.uint16).reshape(len(batch), -1) for c in ("sa", "sb"))
            at = np.arange(len(batch))
            for n, least in bounds:
                at = at[(x[at, :n] == y[at, :n]).sum(axis=1) >= least]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"])

    return run


def _survivors(n, sig, comp, side, low, high, band, percent, bounds):
    """Row numbers of the pairs of different components that survive and share no earlier band: inside a tile, or between two."""
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    found = [(np.empty(0, np.int64),) * 2]
    for block in range(0, len(left), 256):
        i = left[block : block + 256]
        ok = (comp[i][:, None] != comp[right][None, :]) & (100 * np.minimum(n[i][:, None], n[right][None, :]) >= percent * np.maximum(n[i][:, None], n[right][None, :]))
        if low == high:
            ok &= i[:, None] < right[None, :]
        a, b = np.nonzero(ok)
        a, b = i[a], right[b]
        same, since = np.zeros(len(a), np.int32), 0
        for upto, least in bounds:
            for k in range(0, len(a), 65536):
                same[k : k + 65536] += (sig[a[k : k + 65536], since:upto] == sig[b[k : k + 65536], since:upto]).sum(axis=1)
            keep = same >= least
            a, b, same, since = a[keep], b[keep], same[keep], upto
        for k in range(0, len(a), 65536):
            x, y = a[k : k + 65536], b[k : k + 65536]
            earlier = (sig[x, : band * ROWS] == sig[y, : band * ROWS]).reshape(len(x), band, ROWS).all(axis=2).any(axis=1)
            found.append((x[~earlier], y[~earlier]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _within(percent: int, miss: float):
    """``tile, cid, n, component, partners`` of the members that have survivors, for the tiles in a bucket; every pair is with one of its two."""
    bounds = least_agreements(percent, miss)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = np.stack([table[c].to_numpy() for c in ("high", "low", "key")])
        by = np.lexsort(keys)
        edge = np.flatnonzero(np.concatenate([[True], (keys[:, by][:, 1:] != keys[:, by][:, :-1]).any(axis=0)])) if len(by) else []
        n, side, comp, cid, name = (table[c].to_numpy() for c in ("n", "side", "component", "cid", "tile"))
        sig = np.frombuffer(as_bytes(table["sig"])[0].tobytes(), np.uint16).reshape(len(by), -1)
        rows, partners = [], []
        for i, j in zip(edge, [*edge[1:], len(by)]) if len(by) else ():
            own = by[i:j]
            high, low, band = keys[0, own[0]], keys[1, own[0]], int(keys[2, own[0]]) & 63
            a, b = _survivors(n[own], sig[own], comp[own], side[own], low, high, band, percent, bounds)
            for m in np.unique(np.concatenate([a, b])):
                rows.append(own[m])
                partners.append(cid[own[b[a == m]]].tobytes())
        rows = np.array(rows, np.int64)
        return pa.table({"tile": pa.array(name[rows]), "cid": pa.array(cid[rows]), "n": pa.array(n[rows]), "component": pa.array(comp[rows]), "partners": pa.array(partners, pa.binary())})

    return run


def _connect(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links ``a, b`` of the tiles in a bucket: survivors that are confirmed on full sets, but for those that confirmed ones connect already."""
        table = table.combine_chunks()
        tile, cid, comp = (table[c].to_numpy() for c in ("tile", "cid", "component"))
        grams, partners = table["grams"].combine_chunks(), table["partners"].combine_chunks()
        out = []
        by = np.argsort(tile, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], tile[by][1:] != tile[by][:-1]])) if len(by) else []
        for i, j in zip(edge, [*edge[1:], len(by)]) if len(by) else ():
            own = by[i:j]
            sets = {int(cid[m]): np.frombuffer(grams[int(m)].as_py(), np.uint64) for m in own}
            root = {int(cid[m]): int(comp[m]) for m in own}
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = x = up.get(y, y)
                return x

            for m in own[np.argsort(cid[own], kind="stable")]:
                a = int(cid[m])
                x = sets[a]
                others = [b for b in np.frombuffer(partners[int(m)].as_py(), np.int64).tolist() if find(root[a]) != find(root[b])]
                for part in range(0, len(others), 256):
                    some = others[part : part + 256]
                    size = np.array([len(sets[b]) for b in some])
                    y = np.concatenate([sets[b] for b in some])
                    hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
                    for k in np.flatnonzero(100 * both >= percent * (len(x) + size - both)):
                        p, q = find(root[a]), find(root[some[k]])
                        if p != q:
                            up[max(p, q)] = min(p, q)
                            out.append((a, some[k]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _sets(held, n: int):
    """``cls, grams`` of the classes that the sieve may know, once for a task."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(part.column("text"), n)
                ids = class_ids(sets)
                ok = held.value.has(sets.cls)
                if len(seen) > 1_000_000:
                    seen.clear()
                some = [i for i, c in enumerate(ids) if c is not None and ok[i] and not (c in seen or seen.add(c))]
                yield pa.RecordBatch.from_pydict({"cls": pa.array([ids[i] for i in some], pa.binary()), "grams": pa.array([sets.grams[sets.first[i] : sets.first[i + 1]].tobytes() for i in some], pa.binary())})

    return run


def _confirm(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Pairs of a bucket whose full sets link; the row with ``b`` NULL has the set of ``a``."""
        table = table.combine_chunks()
        a, salt, grams = table["a"].to_numpy(), table["salt"].to_numpy(), table["grams"].combine_chunks()
        alone = table["b"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        b = table["b"].combine_chunks().fill_null(-1).to_numpy()
        head = {(a[i], salt[i]): np.frombuffer(grams[i].as_py(), np.uint64) for i in np.flatnonzero(alone)}
        good = []
        for i in np.flatnonzero(~alone):
            x, y = head[a[i], salt[i]], np.frombuffer(grams[i].as_py(), np.uint64)
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both = int((x[at] == y).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                good.append(i)
        return pa.table({"a": pa.array(a[good]), "b": pa.array(b[good])})

    return run


def sets_of_classes(own: DataFrame, uses: DataFrame, n: int):
    """``uses`` with the full sets ``grams`` of their classes ``cls``, and the broadcast to be destroyed when they are written."""
    held = own.sparkSession.sparkContext.broadcast(sieve.build(uses.select("cls").mapInArrow(_first_halves, "id long")))
    sets = small_batches(own.select("text").where("text is not null")).mapInArrow(_sets(held, n), "cls binary, grams binary")
    return uses.join(sets.groupBy("cls").agg(F.first("grams").alias("grams")), "cls"), held


def _spread(uses: DataFrame, size: str, *by: str) -> Column:
    """The bucket of a group, of so many that each has about VERIFY_BYTES of sets."""
    weight = uses.agg(F.sum(size)).first()[0] or 0
    return F.pmod(F.xxhash64(*by), F.lit(8 * weight // VERIFY_BYTES + 1)).alias("bucket")


def confirmed(own: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of classes that link, by the full sets of their texts in ``own``."""
    leaders = pairs.groupBy("a").agg(F.expr(f"1 + count(*) div {SALT}").alias("salts"))
    dealt = pairs.join(leaders, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.col("b").alias("cid"))
    heads = leaders.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("a").alias("cid"))
    uses = materialize(dealt.unionByName(heads).join(classes.select("cid", "cls", "n"), "cid").select("cls", "a", "b", "salt", "n"))
    # spread by leader and salt: the pairs of a very common leader are in many buckets, each with its set
    joined, held = sets_of_classes(own, uses, n)
    dealt = joined.select(_spread(uses, "n", "a", "salt"), "a", "b", "salt", "grams").groupBy("bucket")
    out = materialize(dealt.applyInArrow(_confirm(percent), "a long, b long"))
    held.destroy()
    discard(uses)
    return out


def _first_halves(batches):
    """What the sieve goes by."""
    for batch in batches:
        ids = np.frombuffer(as_bytes(batch.column("cls"))[0].tobytes(), np.int64).reshape(len(batch), 2)
        yield pa.RecordBatch.from_pydict({"id": pa.array(np.ascontiguousarray(ids[:, 0]))})


def _members(classes: DataFrame) -> DataFrame:
    """``key, cid, a`` of all buckets with two classes or more, and their leaders."""
    sig = classes.select("cid", "sig")
    first = sig.mapInArrow(_bands(None), "key long, cid long").groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("last"))
    first = materialize(first.where("a <> last").select("key", "a"))
    held = classes.sparkSession.sparkContext.broadcast(sieve.build(first.select(F.col("key").alias("id"))))
    out = materialize(sig.mapInArrow(_bands(held), "key long, cid long").join(first, "key"))
    held.destroy()
    discard(first)
    return out


def _links(own: DataFrame, classes: DataFrame, n: int, percent: int, miss: float) -> DataFrame:
    """``cid, component`` of all classes that link with another."""
    members = _members(classes)
    about = classes.select("cid", "n", "sig")
    best = members.groupBy(F.col("cid").alias("b")).agg(F.min("a").alias("a")).where("a <> b")
    both = best.join(about.withColumnsRenamed({"cid": "b", "n": "nb", "sig": "sb"}), "b").join(about.withColumnsRenamed({"cid": "a", "n": "na", "sig": "sa"}), "a")
    both = both.where(may(percent, F.col("na"), F.col("nb"))).select("a", "b", "na", "nb", "sa", "sb")
    pairs = materialize(both.mapInArrow(_survive(percent, miss), "a long, b long, na long, nb long"))
    links = confirmed(own, classes, pairs, n, percent)
    labels = components(links).withColumnRenamed("node", "cid")
    open_ = tiles_of(members, labels, about, TILE).select("key", "low", "high", "side", "tile", "cid", "n", "component", "sig")
    dealt = open_.groupBy(F.pmod("tile", F.lit(members.count() // 50_000 + 1)).alias("bucket"))
    found = materialize(dealt.applyInArrow(_within(percent, miss), "tile long, cid long, n long, component long, partners binary").join(classes.select("cid", "cls"), "cid"))
    rest = connected(own, found, n, percent)
    if not rest.isEmpty():
        labels = components(links.unionByName(rest)).withColumnRenamed("node", "cid")
    discard(members, pairs, links, found, rest)
    return labels


def tiles_of(members: DataFrame, labels: DataFrame, about: DataFrame, size: int) -> DataFrame:
    """Members (key, cid, ...) of buckets with several components, with what ``about`` says of them, in ``tile`` s of a bucket's sides ``low`` and ``high``.

    A bucket has a side for every ``size`` members, and every two sides are a tile; ``side`` is the one that a member is on.
    """
    now = members.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = now.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.expr(f"1 + count(*) div {size}").alias("sides")).where("c0 <> c1").select("key", "sides")
    dealt = now.join(mixed, "key").withColumn("side", F.pmod(F.xxhash64("cid"), F.col("sides"))).join(about, "cid")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    return dealt.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")}).withColumn("tile", F.xxhash64("key", "low", "high"))


def connected(own: DataFrame, found: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b``: links that connect what any links among the partners in ``found`` (tile, cid, cls, n, component, partners) connect."""
    joined, held = sets_of_classes(own, found, n)
    dealt = joined.select(_spread(found, "n", "tile"), "tile", "cid", "component", "partners", "grams").groupBy("bucket")
    rest = materialize(dealt.applyInArrow(_connect(percent), "a long, b long"))
    held.destroy()
    return rest


def joined_by_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with what ``classes`` (cls, copies, ...) says of their class.

    Classes with a thousandth of all rows or more, which are a thousand at the most, are broadcast; so their rows stay where they are.
    """
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * 1000 >= total
    common = F.broadcast(classes.where(hot).drop("copies"))
    rest = rows.join(common, "cls", "left_anti").join(classes.where(~hot).drop("copies"), "cls")
    return rows.join(common, "cls").unionByName(rest)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """``key, rid, n_shingles, component_id, kept`` for every row of ``docs``: the least key that links reach, and a hash of the row's text.

    Two rows link when ``100 * common >= percent * union`` of their sets of distinct ``n``-word shingles.  A text with fewer words has its
    whole sequence as its only shingle; NULL and texts without words have empty sets, link with nothing and are kept.  Keys that are NULL count
    as greater than all others.  Repeated rows link like copies, and each that has the least key is kept.  Long texts are read whole.  Other
    columns are not looked at.  A link between two sets at the threshold is missed with odds of about 1e-9 in the bands and ``miss`` in
    each of the three comparisons of batches; sets closer than that are missed less often by powers of ten.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("rid"))
    rows = materialize(_rows(own, n, ["key", "rid"]))
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("key").alias("least"), F.first("n_shingles").alias("n"), F.first("sig", ignorenulls=True).alias("sig"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))  # numbers that the written table fixes
    labels = _links(own, classes, n, percent, miss)
    joined = classes.select("cls", "cid", "least", "copies").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    joined = materialize(joined)
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    found = joined.join(ids, "component").select("cls", "copies", "component_id")
    full = joined_by_class(rows.where("n_shingles > 0").drop("sig"), found).select("key", "rid", "n_shingles", "component_id")
    out = full.unionByName(rows.where("n_shingles = 0").select("key", "rid", "n_shingles", F.col("key").alias("component_id")))
    out = materialize(out.withColumn("kept", F.col("key").eqNullSafe(F.col("component_id"))).withColumnRenamed("key", key))
    discard(rows, classes, joined)
    return out
