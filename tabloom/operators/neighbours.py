"""Neighbours in space without pairs: a tree of cells that is refined where positions are dense.

Cells of a level are halved into the next as long as they hold more than ``leaf`` positions.  Two cells are compared by the tight boxes of
what they hold: if all of one lies within the radius of all of the other, its aggregates count as a whole; if none does, the pair is
dropped; otherwise the larger cells are replaced by their halves.  Only pairs of leaves are compared position by position, so a dense
place costs in proportion to its positions as long as they are dense against the radius.

Medians don't add up, and lists of all neighbours' values grow with the square of the positions: :func:`middle_within` compares blocks of rows inside tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.operators.order import null_safe_join, row_positions
from tabloom.session import discard, materialize, shuffled

LEAF = 64
DEPTH = 40
CHUNK = 20_000  # rows of a tile that are compared with as many others at a time
CELLS = 250_000  # of a table of distances


def l1(coords: Sequence[str], other: str = "_n_") -> Column:
    return reduce(lambda a, b: a + b, [F.abs(F.col(c) - F.col(f"{other}{c}")) for c in coords])


def l2(coords: Sequence[str], other: str = "_n_") -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"{other}{c}")) ** 2 for c in coords]))


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return null_safe_join(left, shuffled(right), keys, how)


METRICS = {"l1": l1, "l2": l2}
#: The length of a vector of gaps.
LENGTHS = {"l1": lambda gaps: reduce(lambda a, b: a + b, gaps), "l2": lambda gaps: F.sqrt(reduce(lambda a, b: a + b, [g**2 for g in gaps]))}


class Tree(NamedTuple):
    """``nodes``: group, ``lev``, ``cell``, ``n`` positions, ``split`` and the box ``lo``, ``hi`` of each cell; ``depth`` is the last level."""

    nodes: DataFrame
    depth: int
    by: list[str]
    coords: list[str]
    side: float

    def cell(self, level: int) -> Column:
        return F.array(*[F.floor(F.col(c) / (self.side / 2.0**level)).cast("long") for c in self.coords])

    def ancestors(self, positions: DataFrame) -> DataFrame:
        """``positions`` once for each level, with their cells there; a leaf's positions have no cells below it in ``nodes``."""
        every = F.array(*[F.struct(F.lit(i).alias("lev"), self.cell(i).alias("cell")) for i in range(self.depth + 1)])
        return positions.withColumn("_x", F.explode(every)).select(*positions.columns, "_x.lev", "_x.cell")


def tree(places: DataFrame, by: Sequence[str], coords: Sequence[str], side: float, leaf: int = LEAF) -> Tree:
    """The tree of distinct positions ``places``, whose cells at level 0 have this ``side``."""
    by, coords, levels = list(by), list(coords), []
    left = places
    for level in range(DEPTH + 1):
        t = Tree(places, level, by, coords, side)
        boxes = [F.array(*[f(c) for c in coords]).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        found = left.groupBy(*by, t.cell(level).alias("cell")).agg(F.count(F.lit(1)).alias("n"), *boxes)
        found = materialize(found.select(*by, F.lit(level).alias("lev"), "cell", "n", ((F.col("n") > leaf) & F.lit(level < DEPTH)).alias("split"), "lo", "hi"))
        levels.append(found)
        more = found.where("split").select(*by, "cell")
        if more.isEmpty():
            break
        left = _met(left.withColumn("cell", t.cell(level)), more, [*by, "cell"], "left_semi").drop("cell")
    return Tree(reduce(DataFrame.unionByName, levels), len(levels) - 1, by, coords, side)


def _side(nodes: DataFrame, by: Sequence[str], s: str) -> DataFrame:
    return nodes.select(*by, *[F.col(c).alias(f"{c}{s}") for c in ("lev", "cell", "n", "split", "lo", "hi")])


def _gaps(coords: Sequence[str], metric: str) -> tuple[Column, Column]:
    """Least and greatest distance of two boxes.  Rounding is monotone, so no distance of two positions lies beyond them."""
    box = [[F.col(f"{e}{s}")[i] for e in ("lo", "hi") for s in "ab"] for i in range(len(coords))]
    near = [F.greatest(F.lit(0.0), lob - hia, loa - hib) for loa, lob, hia, hib in box]
    far = [F.greatest(hib - loa, hia - lob) for loa, lob, hia, hib in box]
    return LENGTHS[metric](near), LENGTHS[metric](far)


def _halved(pairs: DataFrame, t: Tree) -> DataFrame:
    """Pairs with the cells ``a``, then ``b``, replaced by their halves where they are to be split."""
    up = F.transform("cell", lambda x: F.shiftright(x, 1))
    kids = t.nodes.where("lev > 0").withColumns({"_up": up, "_lev": F.col("lev") - 1})
    for s in "ab":
        own = [f"{c}{s}" for c in ("lev", "cell", "n", "split", "lo", "hi")]
        go = pairs.where(F.col(f"go{s}")).select(*[c for c in pairs.columns if c not in own], F.col(f"lev{s}").alias("_lev"), F.col(f"cell{s}").alias("_up"))
        below = kids.select(*t.by, "_lev", "_up", *[F.col(c).alias(f"{c}{s}") for c in ("lev", "cell", "n", "split", "lo", "hi")])
        pairs = pairs.where(~F.col(f"go{s}")).unionByName(_met(go, below, [*t.by, "_lev", "_up"]).drop("_lev", "_up"))
    return pairs


def _who_splits(pairs: DataFrame) -> DataFrame:
    """The larger cell is split, both if they are equally large; a leaf never is."""
    a = F.col("splita") & (~F.col("splitb") | (F.col("leva") <= F.col("levb")))
    b = F.col("splitb") & (~F.col("splita") | (F.col("levb") <= F.col("leva")))
    return pairs.withColumns({"goa": a, "gob": b})


def near_positions(left: DataFrame, right: DataFrame, by: Sequence[str], coords: Sequence[str], r: float, metric: str = "l1") -> DataFrame:
    """Pairs of positions within ``r``: grid cells of side ``r``, 3^d neighbour cells, then the exact test."""
    cell = {f"_c{i}": F.floor(F.col(c) / r) for i, c in enumerate(coords)}
    l = left
    for i in range(len(coords)):
        l = l.withColumn(f"_c{i}", F.explode(F.array(*[cell[f"_c{i}"] + d for d in (-1, 0, 1)])))
    n = right.withColumns(cell).withColumnsRenamed({c: f"_n_{c}" for c in right.columns} | {k: f"_k{k}" for k in cell})
    cond = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_n_{b}")) for b in by] + [F.col(k) == F.col(f"_k{k}") for k in cell])
    return l.join(shuffled(n), cond).withColumn("dist", METRICS[metric](coords)).filter(F.col("dist") <= r).drop(*cell, *[f"_k{k}" for k in cell])


def within(
    spots: DataFrame, by: Sequence[str], coords: Sequence[str], radii: Sequence[float], merges: Mapping[str, Callable], keys: Sequence[str] = (), metric: str = "l1", leaf: int = LEAF
) -> DataFrame:
    """``by, coords, r, keys`` with the merged columns of all spots within ``r`` of each position, for all ``radii`` in one pass.

    ``spots`` has a row for each position and ``keys``; ``merges`` names its other columns and the aggregate that adds them up.  A position's
    own rows are included.  Positions with a NULL or NaN coordinate have no neighbours and no rows; NULL groups are a group.
    """
    by, coords, keys = list(by), list(coords), list(keys)
    spots = materialize(spots.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coords])))
    places = spots.select(*by, *coords).distinct()
    add = lambda df, group, pre="": df.groupBy(*group).agg(*[m(F.col(f"{pre}{n}")).alias(n) for n, m in merges.items()])
    radius = F.explode(F.array(*[F.lit(float(r)) for r in radii]))
    t = tree(places, by, coords, float(max(radii)), leaf)
    renamed = {c: f"_n_{c}" for c in [*by, *coords, *keys, *merges]}
    if not t.depth:  # no cell is dense
        near = near_positions(places, spots, by, coords, float(max(radii)), metric).withColumn("r", radius).where("dist <= r")
        out = add(near.select(*by, *coords, "r", *[F.col(f"_n_{k}").alias(k) for k in keys], *[F.col(f"_n_{n}").alias(n) for n in merges]), [*by, *coords, "r", *keys])
        return out

    a, b = _side(t.nodes.where("lev = 0"), by, "a"), _side(t.nodes.where("lev = 0"), by, "b")
    for i in range(len(coords)):
        a = a.withColumn(f"_c{i}", F.explode(F.array(*[F.col("cella")[i] + d for d in (-1, 0, 1)])))
    b = b.withColumns({f"_c{i}": F.col("cellb")[i] for i in range(len(coords))})
    front = _met(a, b, [*by, *[f"_c{i}" for i in range(len(coords))]]).drop(*[f"_c{i}" for i in range(len(coords))]).withColumn("r", radius)
    least, most = _gaps(coords, metric)
    whole, leaves = [], []
    while True:
        front = materialize(_who_splits(front.withColumns({"_least": least, "_most": most}).where("_least <= r")))
        inside = F.col("_most") <= F.col("r")
        ends = [*by, "leva", "cella", "levb", "cellb", "r"]
        whole.append(front.where(inside).select(*ends))
        leaves.append(front.where(~inside & ~F.col("goa") & ~F.col("gob")).select(*ends))
        rest = front.where(~inside & (F.col("goa") | F.col("gob")))
        if rest.isEmpty():
            break
        front = _halved(rest, t).drop("goa", "gob", "_least", "_most")
    whole, leaves = reduce(DataFrame.unionByName, whole), reduce(DataFrame.unionByName, leaves)

    up, up_spots = t.ancestors(places), t.ancestors(spots)
    totals = add(up_spots, [*by, "lev", "cell", *keys]).withColumnsRenamed({"lev": "levb", "cell": "cellb"})
    given = add(_met(whole, totals, [*by, "levb", "cellb"]), [*by, "leva", "cella", "r", *keys])
    first = _met(up.withColumnsRenamed({"lev": "leva", "cell": "cella"}), given, [*by, "leva", "cella"]).select(*by, *coords, "r", *keys, *merges)
    right = up_spots.withColumnsRenamed(renamed | {"lev": "levb", "cell": "cellb"}).withColumnsRenamed({f"_n_{c}": c for c in by})
    pairs = _met(_met(leaves, up.withColumnsRenamed({"lev": "leva", "cell": "cella"}), [*by, "leva", "cella"]), right, [*by, "levb", "cellb"])
    second = pairs.where(METRICS[metric](coords) <= F.col("r")).select(*by, *coords, "r", *[F.col(f"_n_{k}").alias(k) for k in keys], *[F.col(f"_n_{n}").alias(n) for n in merges])
    return add(first.unionByName(second), [*by, *coords, "r", *keys])


def _compared(coords: Sequence[str], r: float, metric: str):
    """What the rows ``ours`` find among the neighbours ``theirs``, a chunk of the tile: ``n`` rows other than their own from ``lo`` to ``hi``.

    ``a`` and ``b`` are the values with the ranks ``_a`` and ``_b``, counted from 0 in this chunk; of a tile's only chunk those in the middle.
    """
    length = {"l1": lambda gaps: sum(np.abs(g) for g in gaps), "l2": lambda gaps: np.sqrt(sum(g**2 for g in gaps))}[metric]

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, chunk = (ours[c].to_numpy() for c in ("_id", "_chunk"))
        rank = {x: pc.fill_null(ours[f"_{x}"], -1).to_numpy() for x in "ab"}
        alone_at = ours["_chunks"].to_numpy() == 1
        place = [ours[c].to_numpy() for c in coords]
        order = np.lexsort((theirs["_n_id"].to_numpy(), theirs["_v"].to_numpy()))
        v, k, other = (theirs[c].to_numpy()[order] for c in ("_v", "_many", "_n_id"))
        there = [theirs[f"_n_{c}"].to_numpy()[order] for c in coords]
        k = k.astype(np.int32 if k.sum() < 2**31 else np.int64)
        by_id = np.argsort(other)
        found = {"n": np.zeros(len(ids), np.int64), "at": np.full((len(ids), 4), -1)}
        rows = np.lexsort(place[::-1])
        step = max(1, CELLS // max(1, len(v)))
        for i in range(0, len(rows) if len(v) else 0, step):
            now = rows[i : i + step]
            gaps = [np.maximum(np.maximum(x[now].min() - y, y - x[now].max()), 0) for x, y in zip(place, there, strict=True)]
            some = np.flatnonzero(length(gaps) <= r)  # rounding is monotone: the others lie beyond r
            if not len(some):
                continue
            w = (length([x[now][:, None] - y[some] for x, y in zip(place, there, strict=True)]) <= r) * k[some]
            at = by_id[np.minimum(np.searchsorted(other, ids[now], sorter=by_id), len(v) - 1)]
            to = np.minimum(np.searchsorted(some, at), len(some) - 1)
            mine = np.flatnonzero((other[at] == ids[now]) & (some[to] == at) & (w[np.arange(len(now)), to] > 0))
            w[mine, to[mine]] -= 1
            upto = np.cumsum(w, axis=1, dtype=w.dtype)
            n = upto[:, -1].astype(np.int64)
            found["n"][now] = n
            alone = alone_at[now] & (n > 0)
            ranks = np.column_stack([np.where(n > 0, 0, -1), n - 1, np.where(alone, (n - 1) // 2, rank["a"][now]), np.where(alone, n // 2, rank["b"][now])]).astype(w.dtype)
            found["at"][now] = np.where(ranks < 0, -1, some[[np.minimum(np.searchsorted(u, x, side="right"), len(some) - 1) for u, x in zip(upto, ranks, strict=True)]])
        values = {c: pa.array(np.append(v, 0)[at], pa.float64(), mask=at < 0) for c, at in zip(("lo", "hi", "a", "b"), found["at"].T, strict=True)}
        return pa.table({"_id": ids, "_chunk": chunk, "n": found["n"], **values})

    return run


def middle_within(spots: DataFrame, by: Sequence[str], coords: Sequence[str], r: float, value: str, count: str, metric: str = "l1", chunk: int = CHUNK) -> DataFrame:
    """``spots`` with ``n, lo, hi, a, b``: how many other rows lie within ``r``, their least and greatest ``value`` and the two in the middle (the same if ``n`` is odd).

    ``spots`` has a row for each position and value that stands for ``count`` rows; one of them is the row itself.  NULL groups are a group; rows with a
    NULL value, or a NULL or NaN coordinate, are left out.  A tile, the rows of a cell of side ``r``, meets the rows of the cells around it in chunks, in order of
    their value: what a task holds is bounded, no list of values leaves it, and where there are several chunks a second pass looks into the one with the middle.
    """
    by, coords = list(by), list(coords)
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coords], F.col(value).isNotNull())
    spots = materialize(spots.where(there).withColumn("_id", F.monotonically_increasing_id()))  # ids that the written table fixes
    cells = [f"_c{i}" for i in range(len(coords))]
    placed = spots.select("_id", *by, *[F.col(c).cast("double").alias(c) for c in coords], F.col(value).cast("double").alias("_v"), F.col(count).cast("long").alias("_many"), *[F.floor(F.col(c) / r).alias(i) for c, i in zip(coords, cells, strict=True)])

    def around(df: DataFrame) -> DataFrame:
        for c in cells:
            df = df.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
        return df

    parts = lambda c: F.ceil(F.col(c) / F.lit(chunk)).cast("int")
    here = materialize(placed.groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("_n")))
    near = around(here).groupBy(*by, *cells).agg(F.sum("_n").alias("_m"))
    tiles = materialize(_met(here, near, [*by, *cells]).select(*by, *cells, parts("_n").alias("_blocks"), parts("_m").alias("_chunks"), F.monotonically_increasing_id().alias("_tile")))
    ours = _met(placed, tiles, [*by, *cells]).select("_id", *coords, "_tile", "_chunks", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int").alias("_block"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"))
    theirs = _met(placed, around(tiles), [*by, *cells]).select("_id", *coords, "_v", "_many", "_tile", "_blocks", "_chunks")
    several = not tiles.where("_chunks > 1").isEmpty()
    if several:
        dealt = row_positions(theirs.where("_chunks > 1"), ["_v", "_id"], ["_tile"], name="_pos").withColumn("_chunk", F.floor((F.col("_pos") - 1) / chunk).cast("int")).drop("_pos")
        theirs = materialize(theirs.where("_chunks = 1").withColumn("_chunk", F.lit(0)).unionByName(dealt))
    else:
        theirs = theirs.withColumn("_chunk", F.lit(0))
    theirs = theirs.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks", "_chunks")
    theirs = theirs.withColumnsRenamed({c: f"_n_{c}" for c in coords} | {"_id": "_n_id", "_tile": "_n_tile"})
    keys, kinds = ["_tile", "_block", "_chunk"], "_id long, _chunk int, n long, lo double, hi double, a double, b double"
    met = lambda x: x.groupBy(*keys).cogroup(theirs.groupBy("_n_tile", *keys[1:])).applyInArrow(_compared(coords, float(r), metric), kinds)
    found = met(ours.withColumns({"_a": F.lit(None).cast("long"), "_b": F.lit(None).cast("long")}))
    if several:
        found = materialize(found)
        each = Window.partitionBy("_id")
        total, before = F.sum("n").over(each), F.coalesce(F.sum("n").over(each.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = {c: F.when((x >= before) & (x < before + F.col("n")), x - before) for c, x in (("_a", F.floor((total - 1) / 2)), ("_b", F.floor(total / 2)))}
        aim = found.select("_id", "_chunk", "n", "a", *[x.alias(c) for c, x in ranks.items()]).where("a is null and (_a is not null or _b is not null)").select("_id", "_chunk", "_a", "_b")
        second = met(ours.join(shuffled(aim), ["_id", "_chunk"])).select("_id", F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("double").alias(c) for c in ("lo", "hi")], "a", "b")
        found = found.drop("_chunk").unionByName(second).groupBy("_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), *[F.max(c).alias(c) for c in ("hi", "a", "b")])
    return spots.join(shuffled(found.drop("_chunk")), "_id").drop("_id")


def nearest_other(places: DataFrame, by: Sequence[str], coords: Sequence[str], metric: str = "l1", leaf: int = 16) -> DataFrame:
    """``by, coords, nearest``: the distance of each distinct position to the closest other one of its group.

    Cells of the same group are compared from the coarsest level down.  The greatest distance to a cell that has another position bounds what
    is nearest, and cells that begin beyond the bound are left out; so what remains around a cell are the rings next to it.
    """
    by, coords = list(by), list(coords)
    places = materialize(places.select(*by, *coords).distinct())
    spans = places.groupBy(*by).agg(*[(F.max(c) - F.min(c)).alias(c) for c in coords]).agg(*[F.max(c) for c in coords]).first()
    t = tree(places, by, coords, float(max([1e-9, *(x or 0.0 for x in spans)])), leaf)
    top = t.nodes.where("lev = 0")
    front = _met(_side(top, by, "a"), _side(top, by, "b"), by) if by else _side(top, by, "a").withColumn("_one", F.lit(1)).join(_side(top, by, "b").withColumn("_one", F.lit(1)), "_one").drop("_one")
    least, most = _gaps(coords, metric)
    other = (F.col("leva") != F.col("levb")) | (F.col("cella") != F.col("cellb"))
    done = []
    while True:
        front = materialize(front.withColumns({"_least": least, "_most": most}).where(other | (F.col("na") > 1)))
        bound = front.groupBy(*by, "leva", "cella").agg(F.min("_most").alias("_bound"))
        front = _who_splits(_met(front, bound, [*by, "leva", "cella"]).where("_least <= _bound").drop("_bound"))
        # a pair of leaves waits until its first cell's other partners are leaves, too
        front = materialize(front)
        rest = front.where(F.col("goa") | F.col("gob"))
        if rest.isEmpty():
            done.append(front.select(*by, "leva", "cella", "levb", "cellb"))
            break
        front = _halved(front, t).drop("goa", "gob", "_least", "_most")
    leaves = reduce(DataFrame.unionByName, done)
    up = t.ancestors(places)
    right = up.withColumnsRenamed({"lev": "levb", "cell": "cellb"} | {c: f"_n_{c}" for c in coords})
    pairs = _met(_met(leaves, up.withColumnsRenamed({"lev": "leva", "cell": "cella"}), [*by, "leva", "cella"]), right, [*by, "levb", "cellb"])
    dist = METRICS[metric](coords)
    out = materialize(pairs.withColumn("dist", dist).where("dist > 0").groupBy(*by, *coords).agg(F.min("dist").alias("nearest")))
    discard(places)
    return out
