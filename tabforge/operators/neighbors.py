"""Exact k-nearest-neighbour search over a tree of donor cells (used by I2, I4, I5, L9).

Donor rows are collapsed to distinct feature vectors, each with its k lowest-key rows, so a value repeated in a third of
the table is one small record. The vectors are split level by level, every cell that is too large at quantiles of its
widest feature, until all cells are bounded. Every query vector looks at the boxes of the cells and is first searched in
one or two promising cells, which bound its distances, then in a few of the nearest, and at last in all cells whose box
is not farther than its own bound. What a query costs so depends on the cells it reaches, not on those of its neighbours.

A cell meets bounded shares of the queries that reach it, inside a task: it is divided further into small parts, and a
query meets those whose box is near enough. Distances are matrix products over the known features, good to a proven
rounding error, and the few vectors inside that error of the k-th are computed again feature by feature.

A query that knows few features is as near to vectors all over the tree; where many queries know the same few, they are
searched in a tree of those features alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.plans.bounded import checked_broadcast, settled, ship

ship(__name__)
METRICS = ("mean_sq", "euclidean", "manhattan")
FAN_OUT = 8  # quantile slots of a split; one more takes the largest value, another the vectors without one
SLOTS = FAN_OUT + 2
TILE = 1 << 18  # bounds computed at once
PART = 128  # vectors of a part of a cell
NEXT = 4  # cells that are searched before all others
PAGE = 4096  # boxes of cells that a task holds
OWN_TREES = 4  # trees of few features, at most


# Distances of a block to a cell, inside a task ------------------------------------------------------
def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    return pa.chunked_array(lists).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _finish(total: np.ndarray, shared: np.ndarray, dims: int, metric: str) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "mean_sq":
            return total / shared
        whole = total * (dims / shared)
        return np.sqrt(whole) if metric == "euclidean" else whole


def _exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of vector pairs, feature by feature in order; NaN where no feature is shared."""
    total, shared = np.zeros(len(x)), np.zeros(len(x))
    for f in range(x.shape[1]):
        diff = x[:, f] - y[:, f]
        known = ~np.isnan(diff)
        total += np.where(known, np.abs(diff) if metric == "manhattan" else diff * diff, 0.0)
        shared += known
    return _finish(total, shared, x.shape[1], metric)


def _rough(x: np.ndarray, y: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """All distances before the root, infinite where no feature is shared, and a bound on each row's error."""
    dims = x.shape[1]
    kx, ky = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    shared = kx @ ky.T
    if metric == "manhattan":
        total = np.zeros((len(x), len(y)))
        for f in range(dims):
            total += np.nan_to_num(np.abs(x[:, f, None] - y[:, f]))
        size = np.nan_to_num(np.abs(x)).sum(1) + (np.nan_to_num(np.abs(y)).sum(1).max() if len(y) else 0.0)
    else:
        with np.errstate(all="ignore"):
            centre = np.nan_to_num(np.nansum(y, 0) / ky.sum(0))
        x0, y0 = np.where(kx > 0, x - centre, 0.0), np.where(ky > 0, y - centre, 0.0)
        total = (x0 * x0) @ ky.T + kx @ (y0 * y0).T - 2.0 * (x0 @ y0.T)
        size = (x0 * x0).sum(1) + ((y0 * y0).sum(1).max() if len(y) else 0.0)
        # Centring rounds each component once more.
        size += 2.0 * np.sqrt(size) * (np.nan_to_num(np.abs(x)).sum(1) + np.abs(centre).sum())
    scale = 1.0 if metric == "mean_sq" else float(dims)
    with np.errstate(divide="ignore", invalid="ignore"):
        rough = np.where(shared > 0, np.maximum(total, 0.0) * (scale / shared), np.inf)
    return rough, 16.0 * (dims + 4) * np.finfo(float).eps * scale * size


def _limit(kth: np.ndarray, metric: str) -> np.ndarray:
    """Distances before the root that are not beyond ``kth``."""
    return np.where(np.isinf(kth), np.inf, kth * kth if metric == "euclidean" else kth) * (1 + 1e-12)


def _bounds(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, holes: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Of every vector and box the least distance before the root, infinite where no feature can be shared, and a guess at the usual one."""
    known, has = ~np.isnan(x), ~np.isnan(lo)
    x0, kx, kb = np.where(known, x, 0.0), known.astype(float), has.astype(float)
    low, high = np.where(has & ~holes, lo, -np.inf), np.where(has & ~holes, hi, np.inf)
    total = np.zeros((len(x), len(lo)))
    for f in range(x.shape[1]):
        far = np.maximum(low[:, f] - x0[:, f, None], x0[:, f, None] - high[:, f])
        np.maximum(far, 0.0, out=far)
        if metric != "manhattan":
            far *= far
        if not known[:, f].all():
            far[~known[:, f]] = 0.0
        total += far
    middle, width = np.where(has, lo / 2 + hi / 2, 0.0), np.where(has, hi - lo, 0.0)
    shared = kx @ kb.T
    with np.errstate(all="ignore"):
        usual = (x0 * x0) @ kb.T + kx @ (middle * middle + width * width / 12).T - 2.0 * (x0 @ middle.T)
        scale = 1.0 if metric == "mean_sq" else float(x.shape[1])
        return np.where(shared > 0, total * (scale / shared), np.inf), np.where(shared > 0, usual / shared, np.inf)


def _box(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hole = np.isnan(y)
    lo, hi = np.where(hole, np.inf, y).min(0), np.where(hole, -np.inf, y).max(0)
    none = hole.all(0)
    return np.where(none, np.nan, lo), np.where(none, np.nan, hi), hole.any(0)


def _parts(y: np.ndarray) -> list[np.ndarray]:
    """Numbers of the vectors of each part: halves at the median of the widest feature, until they are small."""
    todo, parts = [np.arange(len(y))], []
    while todo:
        at = todo.pop()
        if len(at) <= PART:
            parts.append(at)
            continue
        v = y[at]
        missing = np.isnan(v).mean(0)
        mixed = np.abs(missing - 0.5)
        if mixed.min() <= 0.375:  # an eighth at least lacks a feature, and an eighth has it
            side = np.isnan(v[:, mixed.argmin()])
            todo += [at[side], at[~side]]
            continue
        lo, hi, _ = _box(v)
        by = np.where(np.isnan(lo), -1.0, hi - lo).argmax()
        order = at[np.argsort(v[:, by], kind="stable")]
        todo += [order[:len(order) // 2], order[len(order) // 2:]]
    return parts


def _within(x: np.ndarray, y: np.ndarray, own: np.ndarray, groups: np.ndarray, kth: np.ndarray, k: int, metric: str, apart: bool,
            parts: list[np.ndarray], boxes: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a vector that may be among the query's first k and not beyond its ``kth``."""
    limit = _limit(kth, metric)
    least, usual = _bounds(x, *boxes, metric)

    def met(s, g):
        rough, error = _rough(x[s], y[parts[g]], metric)
        if apart:
            rough[own[s, None] == groups[parts[g]]] = np.inf
        return rough, error
    if len(y) > k:  # the k-th of the nearest parts bounds all others
        few = min(len(parts), 1 + -(-k // (PART // 2)))
        order = np.lexsort((usual, least), axis=1)[:, :few]
        seen = np.full((len(x), few, max(map(len, parts))), np.inf)
        for g in np.unique(order):
            s, slot = np.nonzero(order == g)
            rough, error = met(s, g)
            seen[s, slot, :len(parts[g])] = rough + error[:, None]
        seen = seen.reshape(len(x), -1)
        if seen.shape[1] >= k:
            limit = np.minimum(limit, np.partition(seen, k - 1, axis=1)[:, k - 1])
    reach = (least * (1 - 1e-9) <= limit[:, None]) & (least < np.inf)
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in np.flatnonzero(reach.any(0)):
        s = np.flatnonzero(reach[:, g])
        rough, error = met(s, g)
        i, j = np.nonzero((rough <= (limit[s] + error)[:, None]) & (rough < np.inf))
        rows.append(s[i])
        cols.append(parts[g][j])
    return np.concatenate(rows), np.concatenate(cols)


def _nearest(key, left: pa.Table, right: pa.Table, k: int, dims: int, metric: str, apart: bool) -> pa.Table:
    """``vid, leaf, idx, dist, m``: of one cell the first k vectors of every query vector by (distance, number in the cell).

    A vector stands for ``m`` rows; those behind k rows at smaller distances are left out. With ``apart``, vectors of the
    query's own group ``g`` are none of them."""
    x, y = _matrix(left["x"], dims), _matrix(right["x"], dims)
    idx = right["idx"].to_numpy()
    order = np.argsort(idx)
    y, idx, rows = y[order], idx[order], right["m"].to_numpy()[order]
    own, groups = left["g"].to_numpy(), right["g"].to_numpy()[order]
    top = left["kth"].to_numpy(zero_copy_only=False).astype(float)
    top = np.where(np.isnan(top), np.inf, top)
    vid = left["vid"].to_numpy()
    out = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]]
    parts = _parts(y)
    boxes = tuple(map(np.array, zip(*[_box(y[p]) for p in parts]))) if len(y) else ()
    step = max(1, 4 * TILE // max(PART, k, len(parts))) if len(y) else max(1, len(x))
    for at in range(0, len(x) if len(y) else 0, step):
        part, bound = x[at:at + step], top[at:at + step]
        i, j = _within(part, y, own[at:at + step], groups, bound, k, metric, apart, parts, boxes)
        dist = _exact(part[i], y[j], metric)
        near = dist <= bound[i]
        i, j, dist = i[near], j[near], dist[near]
        order = np.lexsort((j, dist, i))
        i, j, dist = i[order], j[order], dist[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        # Rows of the query's vectors before the first one at the same distance.
        before = np.concatenate([[0], np.cumsum(rows[j])])[:-1] if len(i) else np.zeros(0, np.int64)
        tied = np.maximum.accumulate(np.where(np.append(True, (i[1:] != i[:-1]) | (dist[1:] != dist[:-1])), np.arange(len(i)), 0)) if len(i) else first
        nearer = before[tied] - np.repeat(before[first], np.diff(np.append(first, len(i))))
        keep = (rank < k) & (nearer < k)
        out.append([vid[at:at + step][i[keep]], idx[j[keep]], dist[keep], rows[j[keep]]])
    vids, idxs, dists, ms = (np.concatenate(c) for c in zip(*out))
    return pa.table({"vid": pa.array(vids, pa.int64()), "leaf": pa.array(np.full(len(vids), key[0].as_py()), pa.int64()),
                     "idx": pa.array(idxs, pa.int64()), "dist": pa.array(dists, pa.float64()),
                     "m": pa.array(ms, pa.int64())})


def _cells_of(left: pa.Table, right: pa.Table, dims: int, metric: str, least_rows: int, most: int | None) -> pa.Table:
    """``vid, leaf, least, usual``: cells for every query vector among the boxes of one page.

    ``most`` 0: the nearest and the likeliest of those that hold ``least_rows`` vectors, if any does; a number: that many of the
    nearest within ``kth``; None: all within it. Cells that ``done`` names are left out."""
    x, lo, hi = _matrix(left["x"], dims), _matrix(right["lo"], dims), _matrix(right["hi"], dims)
    holes = _matrix(right["holes"], dims) > 0
    leaf, n, vid = right["leaf"].to_numpy(), right["n"].to_numpy(), left["vid"].to_numpy()
    order = np.argsort(leaf)
    lo, hi, holes, leaf, n = lo[order], hi[order], holes[order], leaf[order], n[order]
    top = left["kth"].to_numpy(zero_copy_only=False).astype(float)
    limit = _limit(np.where(np.isnan(top), np.inf, top), metric)
    done = pa.chunked_array(left["done"]).combine_chunks()
    ends, flat = np.append(0, np.cumsum(done.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64), done.flatten().to_numpy(zero_copy_only=False)
    out = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]]
    step = max(1, TILE // max(1, len(leaf)))
    for at in range(0, len(x) if len(leaf) else 0, step):
        part = x[at:at + step]
        least, usual = _bounds(part, lo, hi, holes, metric)
        rows = np.arange(len(part))
        if most == 0:
            small = n < least_rows
            if small.any() and not small.all():
                least[:, small] = np.inf
            usual = np.where(least < np.inf, usual, np.inf)
            likely = usual.argmin(1)
            nearest = np.where(least <= least.min(1)[:, None] * (1 + 1e-12), usual, np.inf).argmin(1)
            i, j = np.concatenate([rows, rows]), np.concatenate([likely, nearest])
            some = least[i, j] < np.inf
            i, j = i[some], j[some]
        else:
            past = flat[ends[at]:ends[min(at + step, len(x))]]
            spot = np.minimum(np.searchsorted(leaf, past), len(leaf) - 1)
            who = np.repeat(rows, np.diff(ends[at:at + len(part) + 1]))
            here = leaf[spot] == past
            least[who[here], spot[here]] = np.inf
            within = (least * (1 - 1e-9) <= limit[at:at + step, None]) & (least < np.inf)
            if most and most < len(leaf):
                near = np.argpartition(least, most - 1, axis=1)[:, :most]
                chosen = np.zeros_like(within)
                chosen[rows[:, None], near] = True
                within &= chosen
            i, j = np.nonzero(within)
        out.append([vid[at:at + step][i], leaf[j], least[i, j], usual[i, j]])
    vids, leaves, leasts, usuals = (np.concatenate(c) for c in zip(*out))
    return pa.table({"vid": pa.array(vids, pa.int64()), "leaf": pa.array(leaves, pa.int64()), "least": pa.array(leasts, pa.float64()),
                     "usual": pa.array(usuals, pa.float64())})


# The tree -------------------------------------------------------------------------------------------
def _boxes(df: DataFrame, by: list[str], dims: int, *more: Column) -> DataFrame:
    """``lo, hi`` (arrays by feature; null where never known), ``holes`` (a vector lacks it) and ``n``."""
    x = [F.col("x")[i] for i in range(dims)]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.array(*map(F.min, x)).alias("lo"), F.array(*map(F.max, x)).alias("hi"),
                               F.array(*[F.max(v.isNull()) for v in x]).alias("holes"), *more)


def _slot(v: Column, cuts: Column) -> Column:
    return F.when(v.isNull(), SLOTS - 1).otherwise(F.size(F.filter(cuts, lambda c: c <= v)))


def _grow(vectors: DataFrame, dims: int, leaf_rows: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Vectors with their leaf (``node``); nodes of each level with their boxes; splits of each level."""
    levels, splits = [], []
    placed = vectors.withColumn("node", F.lit(0).cast("long")).withColumn("level", F.lit(0))
    while True:
        depth = len(levels)
        nodes = settled(_boxes(placed.where(F.col("level") == depth), ["node"], dims))
        levels.append(nodes)
        large = nodes.where(F.col("n") > leaf_rows)
        if not large.limit(1).count():
            return placed, levels, splits
        # The widest feature; where all known values are equal, one that some vectors lack.
        wide = F.array_max(F.zip_with("lo", "hi", lambda a, b: F.coalesce(b - a, F.lit(-1.0))))
        width = F.zip_with("lo", "hi", lambda a, b: F.coalesce(b - a, F.lit(-1.0)))
        mixed = F.zip_with("lo", "holes", lambda a, h: a.isNotNull() & h)
        dim = F.when(wide > 0, F.array_position(width, wide)).otherwise(F.array_position(mixed, True)) - 1
        large = checked_broadcast(large.select("node", dim.cast("int").alias("dim"), F.get("hi", dim.cast("int")).alias("top")), 1 << 17)
        at = F.get("x", F.col("dim"))
        cuts = (placed.where(F.col("level") == depth).join(large, "node").groupBy("node", "dim", "top")
                .agg(F.percentile_approx(at, [i / FAN_OUT for i in range(1, FAN_OUT)], 1000).alias("q")))
        cuts = cuts.select("node", "dim", F.array_sort(F.array_distinct(F.concat(F.coalesce("q", F.array()), F.array("top")))).alias("cuts"))
        cuts = checked_broadcast(cuts, 1 << 17)
        splits.append(cuts)
        slot = _slot(at, F.col("cuts"))
        placed = placed.join(cuts, "node", "left").select(
            *[c for c in placed.columns if c not in ("node", "level")],
            F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * SLOTS + slot + 1).alias("node"),
            F.when(F.col("dim").isNull(), F.col("level")).otherwise(depth + 1).alias("level"))


def _choose(vectors: DataFrame, leaves: DataFrame, size: tuple[int, int], dims: int, metric: str, least_rows: int, most: int | None) -> DataFrame:
    """``vid, leaf``: the cells that ``_cells_of`` names, over all pages of boxes; ``size``: blocks of query vectors and pages."""
    blocks, pages = size
    left = (vectors.withColumn("block", F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int"))
            .withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))).select("block", "page", "vid", "x", "kth", "done"))
    right = (leaves.withColumn("page", F.pmod(F.xxhash64("leaf"), F.lit(pages)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = right.select("block", "page", "leaf", "n", "lo", "hi", F.transform("holes", lambda h: h.cast("double")).alias("holes"))
    named = left.groupBy("block", "page").cogroup(right.groupBy("block", "page")).applyInArrow(
        lambda a, b: _cells_of(a, b, dims, metric, least_rows, most), "vid long, leaf long, least double, usual double")
    if most == 0:
        both = named.groupBy("vid").agg(F.min_by("leaf", F.struct("usual", "leaf")).alias("a"), F.min_by("leaf", F.struct("least", "usual", "leaf")).alias("b"))
        return settled(both.select("vid", F.explode(F.array_distinct(F.array("a", "b"))).alias("leaf")))
    if most and pages > 1:
        nearest = Window.partitionBy("vid").orderBy("least", "leaf")
        named = named.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= most)
    return settled(named.select("vid", "leaf"))


def _reach(vectors: DataFrame, leaves: DataFrame, size: tuple[int, int], dims: int, metric: str) -> DataFrame:
    """``vid, leaf``: all cells whose box is not farther from the query vector than its bound ``kth``, but those in ``done``."""
    return _choose(vectors, leaves, size, dims, metric, 0, None)


def _search(pairs: DataFrame, vectors: DataFrame, cells: DataFrame, k: int, dims: int, metric: str, apart: bool, block_rows: int) -> DataFrame:
    """``vid, leaf, idx, dist, m``: the first vectors of every cell for the query vectors that reach it, in shares of about ``block_rows``."""
    shares = settled(pairs.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("shares")))
    left = (pairs.hint("merge").join(vectors.select("vid", "x", "g", "kth"), "vid").hint("merge").join(shares, "leaf")
            .select("leaf", F.pmod(F.xxhash64("vid"), F.col("shares")).cast("int").alias("share"), "vid", "x", "g", "kth"))
    right = (cells.select("leaf", "idx", "x", "g", "m").hint("merge").join(shares, "leaf")
             .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("leaf", "share", "idx", "x", "g", "m"))
    return left.groupBy("leaf", "share").cogroup(right.groupBy("leaf", "share")).applyInArrow(
        lambda key, a, b: _nearest(key, a, b, k, dims, metric, apart), "vid long, leaf long, idx long, dist double, m long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """``found`` up to the distance of each query vector's k-th row, which is ``far`` (null if there are fewer)."""
    byrank = Window.partitionBy("vid").orderBy("dist")
    near = found.withColumn("r", F.rank().over(byrank)).where(F.col("r") <= k).withColumn("upto", F.sum("m").over(byrank))
    far = F.min(F.when(F.col("upto") >= k, F.col("dist"))).over(Window.partitionBy("vid"))
    near = near.withColumn("far", far).where(F.col("far").isNull() | (F.col("dist") <= F.col("far")))
    return settled(near.select("vid", "leaf", "idx", "dist", "m", "far"))


def _ranked(qv: DataFrame, d: DataFrame, k: int, dims: int, metric: str, leaf_rows: int, block_rows: int, apart: bool) -> DataFrame:
    """``vid, dist, dk, dv, rank``: the k nearest donor rows ``dk, dv, x, g`` of every query vector ``vid, x, g``."""
    lowest = Window.partitionBy("x", "g").orderBy("dk")  # partial group limit before the shuffle
    dv = settled(d.withColumn("r", F.row_number().over(lowest)).where(F.col("r") <= k)
                 .groupBy("x", "g").agg(F.sort_array(F.collect_list(F.struct("dk", "dv"))).alias("rows")))
    placed, levels, splits = _grow(dv, dims, leaf_rows)
    number = Window.partitionBy("leaf").orderBy(F.col("rows")[0]["dk"], "x", "g")  # a leaf is bounded
    cells = settled(placed.select(F.col("node").alias("leaf"), "x", "g", "rows").withColumn(
        "idx", F.row_number().over(number).cast("long")).withColumn("m", F.size("rows").cast("long")))
    leaves = levels[0]
    for nodes in levels[1:]:
        leaves = leaves.unionByName(nodes)
    leaves = settled(leaves.where(F.col("n") <= leaf_rows).withColumnRenamed("node", "leaf"))
    size = (max(1, -(-qv.count() // block_rows)), max(1, -(-leaves.count() // PAGE)))
    vectors = qv.select("vid", "x", "g", F.lit(None).cast("double").alias("kth"), F.array().cast("array<bigint>").alias("done"))
    # A cell where few vectors are of other groups would leave its queries without a bound.
    pairs = _choose(vectors, leaves, size, dims, metric, 4 * k if apart else k, 0)
    near = _first(_search(pairs, vectors, cells, k, dims, metric, apart, block_rows), k)
    for most in (NEXT, None) if splits else ():
        far = near.groupBy("vid").agg(F.min("far").alias("kth"))
        done = pairs.groupBy("vid").agg(F.collect_set("leaf").alias("done"))
        vectors = settled(qv.hint("merge").join(far, "vid", "left").hint("merge").join(done, "vid", "left").select(
            "vid", "x", "g", "kth", F.coalesce("done", F.array().cast("array<bigint>")).alias("done")))
        more = _choose(vectors, leaves, size, dims, metric, 0, most) if most else _reach(vectors, leaves, size, dims, metric)
        near = _first(near.drop("far").unionByName(_search(more, vectors, cells, k, dims, metric, apart, block_rows)), k)
        pairs = pairs.unionByName(more)
    best = Window.partitionBy("vid").orderBy("dist", "row.dk")
    # Vectors and row lists are many times their size in a shuffle, by which Spark would choose to broadcast them.
    return settled(near.select("vid", "leaf", "idx", "dist").hint("merge").join(cells.select("leaf", "idx", "rows"), ["leaf", "idx"])
                   .select("vid", "dist", F.explode("rows").alias("row")).withColumn("rank", F.row_number().over(best))
                   .where(F.col("rank") <= k).select("vid", "dist", "row.*", "rank"))


def _own_trees(qv: DataFrame, dims: int, least: int) -> list[list[int]]:
    """Sets of at most half the features that alone are known to ``least`` query vectors or more, the commonest first."""
    known = F.array_compact(F.array(*[F.when(F.col("x")[i].isNotNull(), F.lit(i)) for i in range(dims)]))
    sets = qv.groupBy(known.alias("known")).agg(F.count("*").alias("n")).where(
        (F.size("known") > 0) & (F.size("known") * 2 <= dims) & (F.col("n") >= least))
    return [r["known"] for r in sets.orderBy(F.desc("n"), "known").limit(OWN_TREES).collect()]


def knn(queries: DataFrame, donors: DataFrame, features: list[str], k: int, qkey: str, dkey: str,
        dval: str, metric: str = "mean_sq", leaf_rows: int = 16384, block_rows: int = 8192, apart: str | None = None) -> DataFrame:
    """Rows (qkey, dkey, dval, dist, rank) — the k nearest donors of every query row.

    Neighbours are ordered by (distance, donor key). Features that are NULL, NaN or infinite on either side are left out:
    ``mean_sq`` averages over the shared ones, the other metrics are scaled up to all features. A donor that shares
    no feature is no neighbour; a query may so have fewer than k. ``leaf_rows`` and ``block_rows`` bound the cells and
    the shares of queries and never change the result. ``apart`` names a whole-number column of both tables without NULLs:
    a donor with the query's own value is no neighbour, so all folds of a table share one tree and one search.
    """
    if metric not in METRICS:
        raise ValueError(metric)
    dims = len(features)

    def vector(f):
        v = F.col(f).cast("double")
        return F.when(F.abs(v) < float("inf"), v + F.lit(0.0))
    x = F.array(*[vector(f) for f in features])
    def group(other):
        return (F.col(apart) if apart else F.lit(other)).cast("long").alias("g")
    q = queries.select(qkey, x.alias("x"), group(0))
    d = donors.select(F.col(dkey).alias("dk"), F.col(dval).alias("dv"), x.alias("x"), group(1))
    if apart:  # equal vectors of all groups lie in one cell
        leaf_rows = max(leaf_rows, donors.select(apart).distinct().count())
    qv = settled(q.select("x", "g").distinct().withColumn("vid", F.monotonically_increasing_id()))
    # Other features add nothing to the sums of these queries, and nothing to their order.
    sets = _own_trees(qv, dims, block_rows // 128) if metric == "mean_sq" and d.limit(leaf_rows * 4 + 1).count() > leaf_rows * 4 else []
    known = F.array_compact(F.array(*[F.when(F.col("x")[i].isNotNull(), F.lit(i)) for i in range(dims)]))
    own = [F.array(*map(F.lit, s)) for s in sets]
    rest = qv
    for s in own:
        rest = rest.where(known != s)
    cand = _ranked(rest, d, k, dims, metric, leaf_rows, block_rows, apart is not None)
    for s, at in zip(own, sets):
        few = F.array(*[F.col("x")[i] for i in at]).alias("x")
        cand = cand.unionByName(_ranked(qv.where(known == s).select("vid", few, "g"), d.select("dk", "dv", few, "g"), k, len(at), metric,
                                        leaf_rows, block_rows, apart is not None))
    cand = settled(cand.hint("merge").join(qv, "vid").select("x", "g", "dist", "dk", "dv", "rank"))
    return q.join(cand.hint("merge"), ["x", "g"]).select(qkey, F.col("dk").alias(dkey), F.col("dv").alias(dval), "dist", "rank")
