"""Exact k-nearest-neighbour join by pivots and bounded groups.

Both sides are assigned to the nearest of a few pivots. Cell radii give, by the triangle
inequality, an upper bound on the k-th neighbour distance of a cell and a lower bound on
the distance between two cells; cell pairs that cannot hold a neighbour are never compared.
The cells of a side are packed into GROUPS groups, more if a group would hold over GROUP_ROWS
rows; a pair of groups is one task, and a row goes to a task only if its cell meets another
there. A row is thus sent at most as often as the other side has groups, which is a constant
up to GROUPS * GROUP_ROWS rows. A task keeps its left group and the k best of each of its rows,
and streams the right group past them. No side is collected, and copies of one vector are
searched once.
"""

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.hashing import hash32
from pulsegrid.session import pin

#: Left and right rows that are compared at once, pairs that are measured at once, groups of a side at least, rows of a group.
BLOCK, WIDE, HITS, GROUPS, GROUP_ROWS = 512, 2048, 1 << 17, 10, 65_536
ROWS_PER_PIVOT = 4096
MAX_PIVOTS = 128
NONE = np.iinfo(np.int64).max


def _assign(df, pivots):
    """Add the nearest pivot ``cell`` and the distance ``reach`` to it, batch by batch."""

    @F.pandas_udf("cell int, reach double")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        x = np.stack(vec.to_numpy()).astype(np.float64)
        cell, reach = np.empty(len(x), np.int32), np.empty(len(x))
        for lo in range(0, len(x), 2048):
            part = x[lo:lo + 2048]
            d = np.sqrt(((part[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
            cell[lo:lo + 2048] = d.argmin(axis=1)
            reach[lo:lo + 2048] = d.min(axis=1)
        return pd.DataFrame({"cell": cell, "reach": reach})

    return df.withColumn("_a", nearest("vec")).select("by", "id", "vec", "_a.*")


def _cells(side):
    return {
        (r["by"], r["cell"]): (r["n"], r["lo"], r["hi"])
        for r in side.groupBy("by", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi")
        ).toLocalIterator()
    }


def _cell_pairs(left, right, pivots, need):
    """Cell pairs that may hold a neighbour; at most MAX_PIVOTS squared per ``by`` value."""
    gap = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
    pairs = []
    for (by, i), (_, _, radius) in left.items():
        others = [(j, n, lo, hi) for (b, j), (n, lo, hi) in right.items() if b == by]
        bound, seen = np.inf, 0
        for top, n in sorted((radius + gap[i, j] + hi, n) for j, n, _, hi in others):
            seen += n
            if seen >= need:
                bound = top
                break
        for j, _, lo, hi in others:
            nearest = max(gap[i, j] - radius - hi, lo - radius - gap[i, j], 0.0)
            if nearest <= bound * (1 + 1e-9) + 1e-9:
                pairs.append((by, i, j))
    return pairs


def _groups(cells):
    """{(by, cell): groups of its parts}: cells in order, in parts of at most a quarter of a group's rows."""
    total = sum(n for n, _, _ in cells.values())
    size = max(BLOCK, min(GROUP_ROWS, -(-total // GROUPS)))
    groups, group, held = {}, 0, 0
    for cell, (n, _, _) in sorted(cells.items()):
        parts = -(-4 * n // size)
        rows = -(-n // parts)
        for _ in range(parts):
            if held and held + rows > size:
                group, held = group + 1, 0
            groups.setdefault(cell, []).append(group)
            held += rows
    return groups


def _dealt(side, spark, groups, tasks):
    """``side`` with the tasks of each row; ``tasks``: (by, cell, group) -> task numbers."""
    units = [(*cell, part, tasks[(*cell, group)]) for cell, own in groups.items() for part, group in enumerate(own) if (*cell, group) in tasks]
    parts = F.broadcast(spark.createDataFrame([(*cell, len(own)) for cell, own in groups.items()], "by int, cell int, _parts int"))
    units = F.broadcast(spark.createDataFrame(units, "by int, cell int, _part int, _tasks array<int>"))
    placed = side.join(parts, ["by", "cell"]).withColumn("_part", (hash32("block", F.col("id")) % F.col("_parts")).cast("int"))
    return placed.join(units, ["by", "cell", "_part"]).select(F.explode("_tasks").alias("task"), "by", "cell", "id", "vec")


class _Nearest:
    """The left rows of a task with the k nearest right rows seen so far; ties go to the smaller id."""

    def __init__(self, k):
        self.k, self.cells, self.parts = k, {}, []

    def add(self, cell, ids, x):
        at = self.cells.setdefault(cell, [])
        lo = sum(len(i) for i, _ in self.parts)
        at.append((lo, lo + len(ids)))
        self.parts.append((ids, x))

    def close(self):
        self.ids, self.x = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = []
        self.dist = np.full((len(self.ids), self.k), np.inf)
        self.near = np.full((len(self.ids), self.k), NONE)

    def meet(self, cell, ids, y):
        for lo, hi in self.cells[cell]:
            # single precision around the cell's centre decides what is measured exactly; the slack covers its error
            centre = self.x[lo:hi].mean(0)
            a, b = self.x[lo:hi] - centre, y - centre
            aa, bb = (a * a).sum(1), (b * b).sum(1)
            top = max(aa.max(), np.max(bb))
            kind = np.float32 if top < 1e30 else np.float64  # also where values are not finite
            left = np.hstack([-2.0 * a, np.ones((len(a), 1))]).astype(kind)
            right = np.ascontiguousarray(np.hstack([b, bb[:, None]]).astype(kind).T)
            slack = 4.0 * np.finfo(kind).eps * (a.shape[1] + 8) * (np.sqrt(aa) + np.sqrt(np.nanmax(bb, initial=0.0))) ** 2 + 1e-30
            for i in range(0, hi - lo, BLOCK):
                for j in range(0, len(ids), WIDE):
                    some = slice(i, i + BLOCK)
                    self._block(lo + i, left[some], aa[some], slack[some], ids[j:j + WIDE], y[j:j + WIDE], right[:, j:j + WIDE])

    def _block(self, lo, left, aa, slack, ids, y, right):
        k, hi = self.k, lo + len(left)
        rough = left @ right
        limit = self.dist[lo:hi, -1] - aa
        fresh = np.isinf(limit)
        if fresh.any() and len(ids) >= k:
            limit[fresh] = np.partition(rough[fresh, :max(k, 1024)], k - 1, axis=1)[:, k - 1] + slack[fresh]
        at, other = np.divmod(np.flatnonzero(rough <= (limit + slack).astype(rough.dtype)[:, None]), len(ids))
        if len(at) > HITS and len(left) > 1:
            half = len(left) // 2
            for part in (slice(0, half), slice(half, len(left))):
                self._block(lo + part.start, left[part], aa[part], slack[part], ids, y, right)
            return
        if not len(at):
            return
        exact = ((y[other] - self.x[lo + at]) ** 2).sum(axis=1)
        rows, counts = np.unique(at, return_counts=True)
        at = np.concatenate([at, np.repeat(rows, k)])
        dist = np.concatenate([exact, self.dist[lo + rows].ravel()])
        near = np.concatenate([ids[other], self.near[lo + rows].ravel()])
        order = np.lexsort((near, dist, at))
        first = np.cumsum(counts + k) - counts - k
        best = order[first[:, None] + np.arange(k)]
        self.dist[lo + rows], self.near[lo + rows] = dist[best], near[best]

    def found(self):
        some = self.near != NONE
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, self.k)[some.ravel()]), pa.array(self.near[some]), pa.array(self.dist[some])], ["id", "neighbour", "dist2"])


def _task_topk(k, pairs):
    """Over rows (task, right, by, cell, id, vec) sorted by the first four: the k nearest right rows of every left row of a task."""
    def run(batches):
        met = pairs.value
        own, mine, closed = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            task, right, by, cell = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            ids = batch.column(4).to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column(5).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
            change = np.flatnonzero((np.diff(task) != 0) | np.diff(right.astype(np.int8)) | (np.diff(by) != 0) | (np.diff(cell) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, batch.num_rows]):
                if task[lo] != own:
                    if closed:
                        yield mine.found()
                    own, mine, closed = task[lo], _Nearest(k), False
                key = (int(by[lo]), int(cell[lo]))
                if not right[lo]:
                    mine.add(key, ids[lo:hi], x[lo:hi])
                    continue
                if not closed:
                    mine.close()
                    closed = True
                for i in met.get(key, ()):
                    if (key[0], i) in mine.cells:
                        mine.meet((key[0], i), ids[lo:hi], x[lo:hi])
        if closed:
            yield mine.found()

    return run


def _representatives(df, keep):
    """First ``keep`` ids of every group of equal vectors and the smallest id as ``rep``.

    The row-number limit is applied in each task before the shuffle, so a vector that
    occurs in a third of all rows sends ``keep`` rows per task.
    """
    w = Window.partitionBy("by", "vec").orderBy("id")
    few = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    return few.groupBy("by", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn(
        "id", F.get("ids", F.lit(0)))


def nearest_neighbours(left: DataFrame, right: DataFrame, k: int, skip_same=False) -> DataFrame:
    """(id, neighbour, dist2, rank): the k nearest right rows of each left row, exactly.

    Both sides have ``by`` (int; neighbours share it), ``id`` (long) and ``vec``
    (array<double>). Ties go to the smaller neighbour id; ``skip_same`` leaves out the
    row itself. Equal vectors are searched once: their first ids stand for all copies,
    and each left row then takes its list from its representative. Cost is the number of
    distinct vector pairs in the cell pairs that survive pruning.
    """
    need = k + int(skip_same)
    sides = [d.select("by", "id", F.col("vec").cast("array<double>").alias("vec")) for d in (left, right)]
    goals = pin(_representatives(sides[1], need))
    seeks = pin(sides[0].groupBy("by", "vec").agg(F.min("id").alias("id")))
    near = _search(seeks.select("by", "id", "vec"), goals.select("by", "id", "vec"), need)
    copies = goals.select(F.col("id").alias("neighbour"), "ids")
    spread = near.join(copies, "neighbour").select("id", "dist2", F.explode("ids").alias("neighbour"))
    w = Window.partitionBy("id").orderBy("dist2", "neighbour")
    few = spread.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= need)
    lists = few.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_n", "neighbour", "dist2"))).alias("_l"))
    owner = seeks.select("by", "vec", F.col("id").alias("rep"))
    found = sides[0].join(owner, ["by", "vec"]).select("id", "rep").join(
        lists.withColumnRenamed("id", "rep"), "rep")
    best = F.col("_l")
    if skip_same:
        best = F.filter(best, lambda e: e["neighbour"] != F.col("id"))
    out = found.select("id", F.posexplode(F.slice(best, 1, k)).alias("_p", "_e"))
    return out.select("id", "_e.neighbour", "_e.dist2", (F.col("_p") + 1).alias("rank"))


def _search(left, right, k):
    total = right.count()
    n_pivots = int(min(MAX_PIVOTS, max(1, total // ROWS_PER_PIVOT)))
    picked = right.orderBy(hash32("pivot", F.col("id")), "id").limit(n_pivots).toLocalIterator()
    pivots = np.array([r["vec"] for r in picked], dtype=np.float64)
    if len(pivots) == 0:
        raise ValueError("the right side of a neighbour join must not be empty")
    a, b = pin(_assign(left, pivots)), pin(_assign(right, pivots))
    cells = _cells(a), _cells(b)
    pairs, groups = _cell_pairs(*cells, pivots, k), [_groups(c) for c in cells]
    wanted = sorted({(g, h) for by, i, j in pairs for g in groups[0][by, i] for h in groups[1][by, j]})
    number, tasks, met = {p: t for t, p in enumerate(wanted)}, ({}, {}), {}
    for by, i, j in pairs:
        met.setdefault((by, j), []).append(i)
        for g in groups[0][by, i]:
            for h in groups[1][by, j]:
                tasks[0].setdefault((by, i, g), set()).add(number[g, h])
                tasks[1].setdefault((by, j, h), set()).add(number[g, h])
    spark = left.sparkSession
    sides = [_dealt(side, spark, own, {u: sorted(t) for u, t in of.items()}) for side, own, of in zip((a, b), groups, tasks)]
    both = reduce(DataFrame.unionByName, [s.withColumn("right", F.lit(r)) for s, r in zip(sides, (False, True))])
    order = ["task", "right", "by", "cell"]
    dealt = both.select(*order, "id", "vec").repartitionById(max(1, len(wanted)), F.col("task")).sortWithinPartitions(*order)
    found = dealt.mapInArrow(_task_topk(k, spark.sparkContext.broadcast(met)), "id long, neighbour long, dist2 double")
    w = Window.partitionBy("id").orderBy("dist2", "neighbour")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
