"""Class-weighted random trees of many runs in one job, kept as a routing table.

All trees of all runs are grown together: the fit rows of a run go to its blocks of TREES_A_BLOCK trees, and a block is one
group of one aggregate. A block grows its trees side by side, level by level over all nodes of a level at once: ranges, thresholds and class
counts of every node come from segmented sums, so a level is a few passes over the rows that are still in an open node.

Draws are a 32-bit hash of (seed, tree, path of the node, feature). Together with counts and ranges they decide everything, so a
tree depends neither on partitioning nor on row order, and SQL can repeat it.

- ``random`` splits (extra-trees): in every node the ``subset`` features of the smallest draws among those that vary there
  get one threshold each, uniform between the node's minimum and maximum; the one of the largest class-weighted Gini gain wins,
  ties to the lower feature.
- ``best`` splits (random forest): the same features, the best cut between two values of each; every tree sees a bootstrap
  in which a row counts as often as a Poisson(1) draw of (seed, tree, row) says.

A node stays a leaf if it is pure, holds fewer than twice ``min_leaf`` rows or no split leaves ``min_leaf`` rows on
both sides. Leaves carry class-weighted shares. Trees are fitted on features in single precision.

Forests that score (``grow`` with a ``target``) see every fit row of their run, however many. The rows of a run are written once, to one
partition; every task reads that partition, grows its share of the trees a block at a time, adds up their shares for the target rows and
forgets them. So neither rows nor trees are sent once a block, and what is shuffled are the sums of a task. How many tasks a run gets
follows from the cores; the trees do not depend on it. A task holds the single-precision rows of its run, with ``best`` splits also their ranks (each in a
file of its temporary folder beyond IN_MEMORY bytes), and the arrays of one tree: it is linear in the rows of a run, with no bound.

The table of trees (``grow`` without a ``target``), which no registered query uses, is for small runs: a block holds FIT_ROWS rows of its run at most, and
beyond that about that many, drawn by hash, another draw in each block. Rows without a class, or with a null vector, are not fitted; rows with
a null vector are scored with null. ``score`` streams rows through such a table block by block and adds the shares.
"""

import math
import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import hashing
from pulsegrid.schema import N_CLASSES
from pulsegrid.session import pin, small_side, unioned_lists

#: Rows of a run in a table of trees, trees of a block, tasks of a job at most, values of the trees that are grown side by side.
FIT_ROWS, TREES_A_BLOCK, TASKS, CELLS = 65_536, 16, 20_000, 1 << 20
#: Tasks a core of forests that score, bytes of an array that stays in memory, target rows that are routed at once.
TASKS_A_CORE, IN_MEMORY, ROUTED = 4, 1 << 28, 1 << 14
#: Bits of a row's place, a rank and a node in one sort key; more rows are sorted by two keys.
PLACE_BITS = 21
#: Tasks a block of the scoring, so that few blocks share one by their hash.
APART = 4
# Multipliers of the 32-bit finaliser of MurmurHash3 and the golden-ratio step.
MIX_A, MIX_B, STEP = 2_246_822_507, 3_266_489_909, 2_654_435_769
_LOW = (1 << 32) - 1


def mix(h):
    """32-bit hash of 32-bit values held in 64 bits."""
    h = np.asarray(h, np.uint64) & np.uint64(_LOW)
    h = (h ^ (h >> np.uint64(16))) * np.uint64(MIX_A) & np.uint64(_LOW)
    h = (h ^ (h >> np.uint64(13))) * np.uint64(MIX_B) & np.uint64(_LOW)
    return h ^ (h >> np.uint64(16))


def draw(h, k):
    """Draw number k of the stream h, in [0, 2^32)."""
    return mix(np.asarray(h, np.uint64) + (np.asarray(k, np.uint64) + np.uint64(1)) * np.uint64(STEP))


def root_hash(seed: int, tree):
    return draw(mix(seed & _LOW), tree)


def _gini(left, right):
    """Class-weighted gain term of counts (..., classes): larger is better."""
    def part(w):
        total = w[..., 0] + w[..., 1] + w[..., 2] + w[..., 3] + w[..., 4]
        square = w[..., 0] ** 2 + w[..., 1] ** 2 + w[..., 2] ** 2 + w[..., 3] ** 2 + w[..., 4] ** 2
        return square / np.where(total > 0, total, 1.0)
    return part(left) + part(right)


def _chosen(hashes, varies, k):
    """Mask (node, feature) of the k varying features of the smallest draws."""
    d = varies.shape[1]
    key = (draw(hashes[:, None], 2 * np.arange(d)).astype(np.int64) << 20) + np.arange(d)
    key = np.where(varies, key, np.iinfo(np.int64).max)
    edge = np.partition(key, min(k, d) - 1, axis=1)[:, min(k, d) - 1:min(k, d)]
    return varies & (key <= edge)


def _any_split(x, y, starts, at, hashes, weight, k, min_leaf):
    """_random_split over the k smallest draws among the features that vary in a node."""
    m, d = len(starts), x.shape[1]
    low, high = np.minimum.reduceat(x, starts).astype(np.float64), np.maximum.reduceat(x, starts).astype(np.float64)
    chosen = _chosen(hashes, high > low, k)
    cut = low + draw(hashes[:, None], 2 * np.arange(d) + 1).astype(np.float64) / 2.0 ** 32 * (high - low)
    cut = np.where(cut >= high, low, cut)
    cells = at * N_CLASSES + y
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    left, both = np.zeros((m * N_CLASSES, d)), np.bincount(cells, minlength=m * N_CLASSES).reshape(m, N_CLASSES, 1)
    left[cells[first]] = np.add.reduceat(x <= cut[at], first, axis=0, dtype=np.int32)
    left = left.reshape(m, N_CLASSES, d)
    n_left, n = left.sum(1), both.sum(1)
    score = _gini((left * weight[:, None]).transpose(0, 2, 1), ((both - left) * weight[:, None]).transpose(0, 2, 1))
    score = np.where(chosen & (n_left >= min_leaf) & (n - n_left >= min_leaf), score, -np.inf)
    best = score.argmax(1)
    node = np.arange(m)
    return score[node, best] > -np.inf, best, cut[node, best]


def _first_drawn(hashes, d, k):
    """(node, k) the features of the k smallest draws, in ascending order."""
    if k >= d:
        return np.tile(np.arange(d), (len(hashes), 1))
    key = (draw(hashes[:, None], 2 * np.arange(d)).astype(np.int64) << 20) + np.arange(d)
    return np.sort(np.argpartition(key, k - 1, axis=1)[:, :k], axis=1)


def _varying_drawn(x, rows, starts, hashes, k):
    """(node, k) the features of the k smallest draws among those that vary in a node, ascending; where fewer vary, with some that do not."""
    m, d = len(starts), x.shape[1]
    varies, step = np.zeros((m, d), bool), max(1, CELLS // max(1, len(rows)))
    for s in range(0, d, step):
        v = x[rows, s:s + step]
        varies[:, s:s + step] = np.maximum.reduceat(v, starts) > np.minimum.reduceat(v, starts)
    order = np.argsort(~_chosen(hashes, varies, k), axis=1, kind="stable")[:, :k]
    return np.sort(order, axis=1)


def _drawn_split(x, rows, y, starts, at, hashes, weight, drawn, min_leaf):
    """(found, feature, threshold, some drawn feature does not vary) of every node, over its ``drawn`` features, a slice of them at a time."""
    m, d = len(starts), x.shape[1]
    flat, place, node = x.ravel(), rows * d, np.arange(m)
    top, feature, cut, odd = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m), np.zeros(m, bool)
    step = max(1, CELLS // max(1, len(rows)))
    for s in range(0, drawn.shape[1], step):
        some = drawn[:, s:s + step].T
        v = flat.take(place[None, :] + some.take(at, axis=1))
        low, high = np.minimum.reduceat(v, starts, axis=1).astype(np.float64), np.maximum.reduceat(v, starts, axis=1).astype(np.float64)
        varies = high > low
        c = low + draw(hashes, 2 * some + 1).astype(np.float64) / 2.0 ** 32 * (high - low)
        c = np.where(c >= high, low, c)
        score = np.where(varies, _cut_scores(v, c, y, at, weight, min_leaf, m), -np.inf)
        best = score.argmax(0)
        better = score[best, node] > top
        top[better], feature[better], cut[better] = score[best, node][better], some[best, node][better], c[best, node][better]
        odd |= ~varies.all(0)
    return top > -np.inf, feature, cut, odd


def _random_split(x, rows, y, starts, at, hashes, weight, k, min_leaf):
    """(found, feature, threshold) of every node; ``rows`` of ``x`` are sorted by node and class.

    Only the features of the smallest draws are read; a node where one of them does not vary looks at all features.
    """
    d = x.shape[1]
    found, feature, cut, odd = _drawn_split(x, rows, y, starts, at, hashes, weight, _first_drawn(hashes, d, k), min_leaf)
    if k < d and odd.any():
        keep, rename = odd[at], np.cumsum(odd) - 1
        part, mine = rename[at[keep]], rows[keep]
        first = np.searchsorted(part, np.arange(odd.sum()))
        if len(mine) * d <= CELLS:
            found[odd], feature[odd], cut[odd] = _any_split(x[mine], y[keep], first, part, hashes[odd], weight, k, min_leaf)
        else:
            found[odd], feature[odd], cut[odd], _ = _drawn_split(
                x, mine, y[keep], first, part, hashes[odd], weight, _varying_drawn(x, mine, first, hashes[odd], k), min_leaf)
    feature[~found] = 0
    return found, feature, cut


def _cut_scores(v, cut, y, at, weight, min_leaf, m):
    """Gain (feature, node) of sending the values up to ``cut`` left; values (feature, row) are sorted by node and class."""
    cells = at * N_CLASSES + y
    last = np.flatnonzero(np.r_[cells[1:] != cells[:-1], True])
    left = np.zeros((len(v), m * N_CLASSES))
    left[:, cells[last]] = np.diff(np.cumsum(v <= cut.take(at, axis=1), axis=1, dtype=np.int32).take(last, axis=1), axis=1, prepend=0)
    left = left.reshape(len(v), m, N_CLASSES).transpose(2, 0, 1).copy()
    both = np.bincount(cells, minlength=m * N_CLASSES).reshape(m, N_CLASSES).T[:, None]
    n_left, n = left.sum(0), both.sum(0)
    by_class = weight.reshape(-1, 1, 1)
    score = _gini(np.moveaxis(left * by_class, 0, -1), np.moveaxis((both - left) * by_class, 0, -1))
    return np.where((n_left >= min_leaf) & (n - n_left >= min_leaf), score, -np.inf)


def _bits(v):
    """Integers in [0, 2^32) in the order of single-precision values."""
    bits = (np.ascontiguousarray(v, np.float32) + np.float32(0)).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -1 - (bits & 0x7FFFFFFF), bits) + (1 << 31)


def _best_split(x, y, starts, at, hashes, weight, k, min_leaf, times):
    """As _any_split, with the best cut of every chosen feature; rows count ``times``."""
    m, d = len(starts), x.shape[1]
    chosen = _chosen(hashes, np.maximum.reduceat(x, starts) > np.minimum.reduceat(x, starts), k)
    top, feature, cut = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m)
    ends = np.r_[starts[1:], len(y)]
    ones = np.zeros((N_CLASSES, len(y)))
    ones[y, np.arange(len(y))] = times
    total, by_class = np.add.reduceat(ones, starts, axis=1), weight[:, None]
    slot = np.cumsum(chosen, axis=1)
    for s in range(1, min(k, d) + 1):
        have = (slot == s) & chosen
        f, some = have.argmax(1), have.any(1)
        v = x[np.arange(len(y)), f[at]]
        order = np.argsort((at << 32) + _bits(v))
        v, run = v[order], np.cumsum(ones.take(order, axis=1), axis=1)
        left = run - np.where(starts > 0, run.take(starts - 1, axis=1), 0.0).take(at, axis=1)
        right = total.take(at, axis=1) - left
        last = np.zeros(len(v), bool)
        last[ends - 1] = True
        ok = ~last & some[at] & (left.sum(0) >= min_leaf) & (right.sum(0) >= min_leaf)
        ok[:-1] &= v[1:] > v[:-1]
        score = np.where(ok, _gini((left * by_class).T, (right * by_class).T), -np.inf)
        best = np.maximum.reduceat(score, starts)
        place = np.flatnonzero((score == best[at]) & ok)
        node, where = np.unique(at[place], return_index=True)
        place = place[where]
        better = best[node] > top[node]
        node, place = node[better], place[better]
        top[node], feature[node] = best[node], f[node]
        a, b = v[place].astype(np.float64), v[place + 1].astype(np.float64)
        middle = (a + b) / 2
        cut[node] = np.where(middle < b, middle, a)
    return top > -np.inf, feature, cut


def _array(shape, dtype):
    """Array of zeros; beyond IN_MEMORY bytes in a file that goes with it, in the temporary folder of the task."""
    if math.prod(shape) * np.dtype(dtype).itemsize <= IN_MEMORY:
        return np.zeros(shape, dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=tuple(shape))


def _ranks(x):
    """(feature, row) number of every value among the values of its feature; as many as there are rows where it is not a number."""
    ranks = _array(x.T.shape, np.int32)
    for f, v in enumerate(x.T):
        ranks[f] = np.where(np.isnan(v), len(v), np.unique(v, return_inverse=True)[1])
    return ranks


def _drawn_best_split(ranks, x, rows, y, starts, at, hashes, weight, k, min_leaf, times):
    """_best_split over ``rows`` of ``x``, which reads only the features of the smallest draws, by their ``ranks``.

    A node where one of them does not vary looks at all features.
    """
    m, (d, n) = len(starts), ranks.shape
    drawn, ends, place = _first_drawn(hashes, d, k), np.r_[starts[1:], len(y)], np.arange(len(y))
    top, feature, cut, odd = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m), np.zeros(m, bool)
    ones = np.zeros((N_CLASSES, len(y)))
    ones[y, place] = times
    total, by_class = np.add.reduceat(ones, starts, axis=1), weight[:, None]
    all_, node_first = total.take(at, axis=1), at << 2 * PLACE_BITS
    low = (1 << PLACE_BITS) - 1
    for f in drawn.T:
        rank = ranks.ravel().take((f * n).take(at) + rows).astype(np.int64)
        if n <= low:
            key = np.sort(node_first + (rank << PLACE_BITS) + place)
            order, rank = key & low, key >> PLACE_BITS & low
        else:
            order = np.lexsort((rank, at))
            rank = rank[order]
        bad = rank[ends - 1] == n
        odd |= bad | (rank[ends - 1] == rank[starts])
        ones[:] = 0.0
        ones[y.take(order), place] = times.take(order)
        ones[:, starts[1:]] -= total[:, :-1]
        left = np.cumsum(ones, axis=1)  # of the node: the sums of the one before are taken off at its start; counts are whole numbers
        right = all_ - left
        ok = (left.sum(0) >= min_leaf) & (right.sum(0) >= min_leaf)
        ok[:-1] &= rank[1:] > rank[:-1]
        ok[ends - 1] = False
        if bad.any():
            ok &= ~bad[at]
        score = np.where(ok, _gini((left * by_class).T, (right * by_class).T), -np.inf)
        best = np.maximum.reduceat(score, starts)
        won = np.flatnonzero((score == best[at]) & ok)
        node, where = np.unique(at[won], return_index=True)
        won = won[where]
        better = best[node] > top[node]
        node, won = node[better], won[better]
        top[node], feature[node] = best[node], f[node]
        a, b = (x[rows[order[i]], f[node]].astype(np.float64) for i in (won, won + 1))
        middle = (a + b) / 2
        cut[node] = np.where(middle < b, middle, a)
    found = top > -np.inf
    if k < d and odd.any():
        keep, rename = odd[at], np.cumsum(odd) - 1
        part = rename[at[keep]]
        found[odd], feature[odd], cut[odd] = _best_split(
            x[rows[keep]], y[keep], np.searchsorted(part, np.arange(odd.sum())), part, hashes[odd], weight, k, min_leaf, times[keep])
    return found, feature, cut


def grow_trees(x, y, weight, roots, k, min_leaf, depth=None, times=None, ranks=None):
    """(feature, threshold, left, right, rows, p) of the nodes of every tree, one hash of ``roots`` a tree, over rows ``x`` of classes ``y``.

    A feature of -1 marks a leaf; nodes are in order of their level. ``times`` (trees x rows): best splits over rows that count so often, over
    their ``ranks`` (worked out here if not given).
    """
    ranks = _ranks(x) if times is not None and ranks is None else ranks
    whole = np.ones((len(roots), len(y)), bool) if times is None else times > 0
    at, rows = np.nonzero(whole)
    count = None if times is None else times[whole].astype(np.float64)
    hashes, trees = np.asarray(roots, np.uint64), np.arange(len(roots))
    parents, side = np.full(len(roots), -1), np.zeros(len(roots), np.int64)
    levels, made = [], 0
    while len(hashes):
        m = len(hashes)
        cells = np.bincount(at * N_CLASSES + y[rows], count, m * N_CLASSES).reshape(m, N_CLASSES)
        share, total = cells * weight, cells.sum(1)
        feature, threshold = np.full(m, -1), np.zeros(m)
        levels.append([trees, parents, side, feature, threshold, total.astype(np.int64), share / np.maximum(share.sum(1, keepdims=True), 1e-300)])
        own = np.arange(m)
        made += m
        wide = (total >= max(2, 2 * min_leaf)) & ((cells > 0).sum(1) > 1)
        if not wide.any() or (depth is not None and len(levels) > depth):
            break
        rename, keep = np.cumsum(wide) - 1, wide[at]
        rows, at, own, hashes, trees = rows[keep], rename[at[keep]], own[wide], hashes[wide], trees[wide]
        count = None if count is None else count[keep]
        order = np.argsort(at * N_CLASSES + y[rows], kind="stable")
        rows, at = rows[order], at[order]
        count = None if count is None else count[order]
        starts = np.searchsorted(at, np.arange(len(own)))
        found, best, cut = (_random_split(x, rows, y[rows], starts, at, hashes, weight, k, min_leaf) if count is None
                            else _drawn_best_split(ranks, x, rows, y[rows], starts, at, hashes, weight, k, min_leaf, count))
        feature[own[found]], threshold[own[found]] = best[found], cut[found]
        right = x[rows, best[at]].astype(np.float64) > cut[at]
        keep, rename = found[at], np.cumsum(found) - 1
        at, rows, count = 2 * rename[at[keep]] + right[keep], rows[keep], None if count is None else count[keep]
        parents, side, trees = np.repeat(made - m + own[found], 2), np.tile([0, 1], int(found.sum())), np.repeat(trees[found], 2)
        hashes = mix(2 * np.repeat(hashes[found], 2) + side.astype(np.uint64) + np.uint64(1))
    tree, parent, side, feature, threshold, n, p = (np.concatenate(c) for c in zip(*levels))
    order = np.argsort(tree, kind="stable")
    first = np.searchsorted(tree[order], np.arange(len(roots) + 1))
    number = np.empty(len(tree), np.int64)
    number[order] = np.arange(len(tree)) - first[tree[order]]
    kids = np.full((2, len(tree)), -1)
    child = np.flatnonzero(parent >= 0)
    kids[side[child], parent[child]] = number[child]
    return [tuple(c[order[a:b]] for c in (feature, threshold, *kids, n, p)) for a, b in zip(first, first[1:])]


def subset_size(subset, width: int) -> int:
    """Features tried in a node: a share, or ``sqrt``."""
    return max(1, int(math.sqrt(width)) if subset == "sqrt" else int(float(subset) * width))


def _poisson(h):
    """Poisson(1) numbers of 32-bit draws."""
    p = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(p, h.astype(np.float64) / 2.0 ** 32, side="right")


TREE = [T.StructField("tree", T.IntegerType()), T.StructField("feature", T.ArrayType(T.IntegerType())),
        T.StructField("threshold", T.ArrayType(T.DoubleType())), T.StructField("left", T.ArrayType(T.IntegerType())),
        T.StructField("right", T.ArrayType(T.IntegerType())), T.StructField("rows", T.ArrayType(T.LongType())),
        T.StructField("p", T.ArrayType(T.DoubleType()))]


def _forest(x, label, weight, seed, trees, subset, min_leaf, depth, ids):
    """(number, nodes) of the ``trees`` of these numbers; ``ids``: hashes of the rows where the splits are the best ones of a bootstrap."""
    k, together = subset_size(subset, x.shape[1]), max(1, CELLS // max(1, x.size))
    ranks = None if ids is None else _ranks(x)
    for some in np.split(trees, range(together, len(trees), together)):
        roots = root_hash(seed, some)
        times = None if ids is None else _poisson(mix(ids[None, :] ^ roots[:, None]))
        yield from zip(some, grow_trees(x, label, weight, roots, k, min_leaf, depth, times, ranks))


def _columns(names, values):
    return pa.table(dict(zip(names, values)))


def _matrix(column):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def grow(fit: DataFrame, keys, row_id="beat_id", seed="seed", features="features", y="y", weight=None, trees=700, subset="0.35",
         min_leaf=2, splits="random", depth=None, target=None, target_id=None, alike=None, name="p") -> DataFrame:
    """One row per run (``keys``) and tree: its nodes as parallel arrays (``feature`` -1 in leaves, ``p`` five shares a node).

    ``weight`` is a class weight: equal in all rows of a run and class. ``trees`` and ``subset`` are values, or columns equal within a run.
    With ``target`` rows: these with the mean shares ``name`` of forests that see all fit rows of their run, null where a run has no trees; ``target_id``
    are the columns that tell the target rows of a run apart (``row_id`` if not given). Runs of the same values of ``alike`` (some of the
    keys) have the same rows, which are then written once.
    """
    if splits not in ("random", "best"):
        raise ValueError(f"unknown kind of splits {splits!r}")
    keys = list(keys)
    trees, subset = (v if isinstance(v, Column) else F.lit(v) for v in (trees, subset))
    rows = fit.select(*keys, trees.cast("int").alias("_trees"), subset.cast("string").alias("_subset"), F.col(seed).cast("long").alias("_seed"), row_text(fit, row_id).alias("_id"), F.col(y).cast("int").alias("_y"),
                      (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"),
                      F.col(features).cast("array<float>").alias("_x")).where("_y is not null and _x is not null")
    if target is not None:
        ids = target_id or row_id
        ids = [ids] if isinstance(ids, str) else list(ids)
        shares = _shares(rows, target.select(*keys, *ids, F.col(features).cast("array<float>").alias("_x")).where("_x is not null"),
                         keys, ids, list(keys if alike is None else alike), min_leaf, splits, depth)
        sums = shares.groupBy(*keys, *ids).agg(F.array(*[F.sum(F.col("_p")[c]) / F.sum("_n") for c in range(N_CLASSES)]).alias(name))
        return target.join(sums, [*keys, *ids], "left")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.ceil(F.max("_trees") / TREES_A_BLOCK).alias("_blocks"))
    # little data, much work: as many tasks as blocks, whatever their bytes, and none shared while there are enough of them
    tasks = max(1, min(TASKS, sizes.agg(F.sum("_blocks")).first()[0] or 1))
    before = F.sum("_blocks").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))  # over the run grid
    sizes = sizes.select(*keys, "_n", F.coalesce(before, F.lit(0)).alias("_before"))
    dealt = rows.join(small_side(sizes), keys).withColumn("block", F.explode(F.expr(f"sequence(0, cast(ceil(_trees / {TREES_A_BLOCK}) as int) - 1)"))).where(
        (F.col("_n") <= FIT_ROWS) | (hashing.uniform("fit", F.col("_seed"), F.col("block"), F.col("_id")) < F.lit(float(FIT_ROWS)) / F.col("_n")))
    dealt = dealt.withColumn("_task", ((F.col("_before") + F.col("block")) % tasks).cast("int")).drop("_before")
    schema = T.StructType([fit.schema[k] for k in keys] + [T.StructField("block", T.IntegerType())] + TREE)

    def run(key, group):
        key = key[1:]
        x, label = _matrix(group.column("_x")), group.column("_y").to_numpy().astype(np.int64)
        ids = np.array([hash_text(i) for i in group.column("_id").to_pylist()], np.uint64) if splits == "best" else None
        w = np.ones(N_CLASSES)
        w[label] = group.column("_w").to_numpy()
        first, last, share = (group.column(c)[0].as_py() for c in ("_seed", "_trees", "_subset"))
        block = key[-1].as_py()
        mine = np.arange(block * TREES_A_BLOCK, min(last, (block + 1) * TREES_A_BLOCK))
        out = [(int(t), *n[:5], n[5].ravel()) for t, n in _forest(x, label, w, first, mine, share, min_leaf, depth, ids)]
        values = [pa.array([c[i] for c in out], t) for i, t in enumerate(
            (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64())))]
        return _columns(schema.names, [pa.array([v.as_py()] * len(out), v.type) for v in key] + values)

    return dealt.repartitionById(tasks, "_task").groupBy("_task", *keys, "block").applyInArrow(run, schema)


def _shares(rows, target, keys, ids, alike, min_leaf, splits, depth) -> DataFrame:
    """(keys, ids, _p, _n): sums of the leaves' shares over the trees of a task, and their number, for every target row."""
    spark = rows.sparkSession
    weights = [F.max(F.when(F.col("_y") == c, F.col("_w"))).alias(f"_w{c}") for c in range(N_CLASSES)]
    wide = [F.col(c).isNotNull() for c in keys]
    runs = rows.where(reduce(lambda a, b: a & b, wide, F.lit(True))).groupBy(*keys).agg(
        F.max("_trees").alias("_trees"), F.max("_subset").alias("_subset"), F.max("_seed").alias("_seed"), *weights).orderBy(*keys).collect()  # the run grid
    first, parts = {}, []
    for r in runs:  # one set of rows for all runs that are alike
        first.setdefault(tuple(r[k] for k in alike), r)
    sets = {k: i for i, k in enumerate(first)}
    cores = max(1, -(-TASKS_A_CORE * spark.sparkContext.defaultParallelism // max(1, len(runs))))
    for i, r in enumerate(runs):
        count = r["_trees"]
        many = max(1, min(cores, -(-count // TREES_A_BLOCK), max(1, TASKS // len(runs))))
        cuts = [count * j // many for j in range(many + 1)]
        parts += [(i, sets[tuple(r[k] for k in alike)], a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    settings = [(r["_subset"], r["_seed"], [1.0 if r[f"_w{c}"] is None else r[f"_w{c}"] for c in range(N_CLASSES)]) for r in runs]
    names = T.StructType([rows.schema[k] for k in keys])

    def numbered(some, name):
        return F.broadcast(spark.createDataFrame([(*(r[k] for k in keys), i) for i, r in enumerate(some)], T.StructType([*names.fields, T.StructField(name, T.IntegerType())])))

    fitted = rows.join(numbered(first.values(), "_set"), keys).select("_set", F.lit(False).alias("_asked"), "_y", F.col("_id") if splits == "best" else F.lit("").alias("_id"), "_x",
                                                                     *[F.lit(None).cast(target.schema[c].dataType).alias(f"_t_{c}") for c in ids])
    asked = target.join(numbered(first.values(), "_set"), keys).select("_set", F.lit(True).alias("_asked"), F.lit(0).alias("_y"), F.lit("").alias("_id"), "_x",
                                                                       *[F.col(c).alias(f"_t_{c}") for c in ids])
    packed = pin(fitted.unionByName(asked).repartitionById(max(1, len(first)), "_set").sortWithinPartitions("_asked"))
    counts = {(r["_set"], r["_asked"]): r["n"] for r in packed.groupBy("_set", "_asked").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a task for every pair of a part of the trees and a partition, which it reads where it lies; other pairs give nothing
    every = spark.range(0, max(1, len(parts)), 1, max(1, len(parts))).withColumnRenamed("id", "_task").hint("shuffle_replicate_nl")
    wanted = F.get(F.array(*[F.lit(p[1]) for p in parts] or [F.lit(-1)]), F.col("_task").cast("int"))
    met = packed.join(every, F.col("_set") == wanted).select("_task", "_asked", "_y", "_id", "_x", *[f"_t_{c}" for c in ids])
    out = T.StructType([T.StructField("_run", T.IntegerType()), *[T.StructField(c, target.schema[c].dataType) for c in ids],
                        T.StructField("_p", T.ArrayType(T.DoubleType())), T.StructField("_n", T.LongType())])

    def run(batches):
        fits, asks, texts, known = None, None, [], []
        n_fit = n_asked = 0
        for b in batches:
            if not b.num_rows:
                continue
            values = _matrix(b.column(4))
            if fits is None:
                which, rows_of, tree, last = parts[b.column(0)[0].as_py()]
                fits, asks = (_array((counts.get((rows_of, side), 0), values.shape[1]), np.float32) for side in (False, True))
                label = np.zeros(len(fits), np.int64)
            own = b.num_rows - b.column(1).to_pylist().count(True)  # fit rows come first
            fits[n_fit:n_fit + own], asks[n_asked:n_asked + b.num_rows - own] = values[:own], values[own:]
            label[n_fit:n_fit + own] = b.column(2).to_numpy()[:own]
            if splits == "best":
                texts += [hash_text(i) for i in b.column(3).slice(0, own).to_pylist()]
            if own < b.num_rows:
                known.append([b.column(i).slice(own) for i in range(5, b.num_columns)])
            n_fit, n_asked = n_fit + own, n_asked + b.num_rows - own
        if not n_asked or not n_fit:
            return
        share, seed, weight = settings[which]
        total = np.zeros((n_asked, N_CLASSES))
        for _, grown in _forest(fits, label, np.array(weight), seed, np.arange(tree, last), share, min_leaf, depth, np.array(texts, np.uint64) if splits == "best" else None):
            feature, threshold, left, right, _, p = grown
            links = _linked(feature, left, right)
            for lo in range(0, n_asked, ROUTED):
                total[lo:lo + ROUTED] += p.take(_arrive(asks[lo:lo + ROUTED], *links, threshold), axis=0)
        lo = 0
        for columns in known:
            some = total[lo:lo + len(columns[0])]
            lo += len(some)
            shares = pa.ListArray.from_arrays(np.arange(0, some.size + 1, N_CLASSES, dtype=np.int32), some.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), which), pa.int32()), *columns, shares, pa.array(np.full(len(some), last - tree))], out.names)

    return met.mapInArrow(run, out).join(numbered(runs, "_run"), "_run").drop("_run")


def row_text(rows: DataFrame, row_id) -> Column:
    """Text that tells rows apart for their draws: the one id column, or all of several that ``rows`` have."""
    known = [row_id] if isinstance(row_id, str) else [c for c in row_id if c in rows.columns]
    texts = [F.col(c).cast("string") for c in known]
    return texts[0] if len(texts) == 1 else F.concat_ws("|", *texts)


def hash_text(text: str) -> int:
    """32-bit hash of a row id."""
    h = 0
    for b in text.encode():
        h = (h * 31 + b + 1) & _LOW
    return h


def nodes(table: DataFrame, keys) -> DataFrame:
    """One row per node: keys, tree, node, feature, threshold, left, right, rows, p."""
    zipped = F.posexplode(F.arrays_zip("feature", "threshold", "left", "right", "rows"))
    flat = table.select(*keys, "tree", "p", zipped.alias("node", "_n"))
    return flat.select(*keys, "tree", "node", "_n.*", F.slice("p", F.col("node") * N_CLASSES + 1, N_CLASSES).alias("share")).withColumnRenamed("share", "p")


def _linked(feature, left, right):
    """(feature, kids) to route by: kids 2n and 2n + 1 are right and left of node n, a leaf is its own kid."""
    leaf, own = feature < 0, np.arange(len(feature))
    return np.where(leaf, 0, feature), np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], axis=1).ravel(), leaf


def _arrive(x, feature, kids, leaf, threshold):
    """Leaf of every row; rows that have arrived are left out every few levels."""
    values, at = x.ravel(), np.zeros(len(x), np.int64)
    moving, base = np.arange(len(x)), np.arange(len(x)) * x.shape[1]
    here = at
    while len(moving):
        for _ in range(4):
            here = kids.take(2 * here + (values.take(base + feature.take(here)) <= threshold.take(here)))
        at[moving] = here
        open_ = np.flatnonzero(~leaf.take(here))
        moving, base, here = moving[open_], base[open_], here[open_]
    return at


def _route(x, feature, threshold, left, right):
    return _arrive(np.ascontiguousarray(x), *_linked(feature, left, right), threshold)


def score(table: DataFrame, rows: DataFrame, keys, row_id, features="features", name="p") -> DataFrame:
    """``rows`` with the mean of the leaves' shares over all trees of their run; null where a run has no trees.

    ``row_id``: columns that tell rows of a run apart. Blocks of trees meet the rows of their run, trees first.
    """
    keys, row_id = list(keys), [row_id] if isinstance(row_id, str) else list(row_id)
    given = [f.name for f in TREE]
    some = rows.select(*keys, *row_id, F.col(features).cast("array<float>").alias("_x")).where("_x is not null")
    blocks = table.select(*keys, "block").distinct()
    asked = some.join(small_side(blocks), keys).withColumn("_row", F.lit(True))
    trees_ = table.withColumn("_row", F.lit(False))
    both = unioned_lists(trees_, asked).select(*keys, "block", "_row", *given, *row_id, "_x")
    out = T.StructType([f for f in both.schema if f.name in keys or f.name in row_id] + [T.StructField("_p", T.ArrayType(T.DoubleType())), T.StructField("_n", T.LongType())])
    lead = len(keys) + 1

    def run(batches):
        own, forest = None, []
        for b in batches:
            marks = [b.column(i).to_pylist() for i in range(lead)]
            ident = list(zip(*marks))
            is_row = b.column(lead).to_pylist()
            cuts = [0, *(i for i in range(1, b.num_rows) if ident[i] != ident[i - 1] or is_row[i] != is_row[i - 1]), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if ident[lo] != own:
                    own, forest = ident[lo], []
                part = b.slice(lo, hi - lo)
                if not is_row[lo]:
                    for i in range(part.num_rows):
                        arrays = [part.column(part.schema.get_field_index(c))[i].values.to_numpy(zero_copy_only=False) for c in ("feature", "threshold", "left", "right", "p")]
                        forest.append((*_linked(arrays[0], arrays[2], arrays[3]), arrays[1], arrays[4].reshape(-1, N_CLASSES)))
                    continue
                x = _matrix(part.column(part.num_columns - 1)).astype(np.float64)
                total = np.zeros((len(x), N_CLASSES))
                for *tree, p in forest:
                    total += p.take(_arrive(x, *tree), axis=0)
                columns = [part.column(part.schema.get_field_index(f.name)) for f in out.fields[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(total), pa.list_(pa.float64())), pa.array(np.full(len(x), len(forest)))], out.names)

    tasks = max(1, min(TASKS, APART * blocks.count()))
    met = both.repartition(tasks, *keys, "block").sortWithinPartitions(*keys, "block", "_row", "tree").mapInArrow(run, out)
    shares = met.groupBy(*keys, *row_id).agg(F.array(*[F.sum(F.col("_p")[c]) / F.sum("_n") for c in range(N_CLASSES)]).alias(name))
    return rows.join(shares, [*keys, *row_id], "left")
