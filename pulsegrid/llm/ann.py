"""Nearest neighbours by learned partitions: a balanced cut of a neighbour graph and a classifier.

The exact neighbour graph of a bounded sample of vectors is cut into balanced parts (parts grow
from k-means seeds and vertices then move to the part most of their neighbours are in, as long
as it has room). A multinomial logistic classifier learns the part of a vector; every row is
stored in the part it gives the highest probability, and a query is sent to its most probable
parts, as many as sample rows kept out of the fit needed to find RECALL of their true neighbours,
and further down until the parts hold k rows of other ids. The candidates are scored exactly,
block by block. The sample is the rows of the smallest hashes, wherever they are stored.

Rows of a part are dealt over blocks of at most BLOCK_ROWS on average, so a part that holds a
third of all rows is many tasks; a block meets the queries routed to its part and returns at
most k rows for each of them. Queries are a stated set, the index covers every row.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take
no part, neither do rows without an id. Vectors of another length than the most frequent one of
the sample are compared only with queries of their own length. Fewer than k candidates give
fewer rows, no candidates none. Ties go to the smaller id; rows that repeat an id are candidates
each, and a query leaves out all rows of its own id. Repeated query rows give one answer. Extra
columns are ignored. Scores are sums in component order in double precision.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows, rows of a block, and the share of true neighbours the routing must find in the sample.
SAMPLE_ROWS, BLOCK_ROWS, RECALL = 4_096, 8_192, 0.97
#: Neighbours in the graph, and its parts at most.
GRAPH_K, MAX_PARTS = 10, 64
#: One sample row in so many is kept out of the fit and sets the number of parts a query visits.
HELD_OUT = 4


def usable(vectors: DataFrame, vec_id="vec_id", vector="embedding") -> DataFrame:
    """(id, v double array) of the rows that take part."""
    v = f"cast(`{vector}` as array<double>)"
    return vectors.select(F.col(vec_id).cast("long").alias("id"), F.expr(v).alias("v")).where(
        "id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        "and exists(v, x -> x <> 0)")


def _unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def balanced_parts(x: np.ndarray, n_parts: int, rounds=12, seed=5):
    """Part of each sampled row, and the neighbour graph (rows of GRAPH_K neighbours)."""
    rng, n = np.random.default_rng(seed), len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    graph = np.argpartition(-sims, min(GRAPH_K, n - 1) - 1, axis=1)[:, :GRAPH_K] if n > GRAPH_K else np.argsort(-sims, axis=1)[:, :max(1, n - 1)]
    centres = x[rng.choice(n, n_parts, replace=False)]
    for _ in range(8):
        part = (x @ centres.T).argmax(1)
        for p in range(n_parts):
            if (part == p).any():
                centres[p] = x[part == p].mean(0)
        centres = _unit(centres)
    room = math.ceil(1.15 * n / n_parts)
    affinity = x @ centres.T
    for _ in range(rounds):
        votes = np.zeros((n, n_parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        wish = votes + affinity
        left, new = np.full(n_parts, room), np.full(n, -1)
        strength = np.sort(wish, axis=1)
        for i in np.argsort(-(strength[:, -1] - strength[:, -2 if n_parts > 1 else -1])):
            for p in np.argsort(-wish[i]):
                if left[p]:
                    new[i], left[p] = p, left[p] - 1
                    break
        if (new == part).all():
            break
        part = new
    return part, graph


def fit_router(x: np.ndarray, part: np.ndarray, n_parts: int, steps=300):
    """Weights of a multinomial logistic classifier, by gradient descent with momentum."""
    n, d = x.shape
    xb = np.hstack([x, np.ones((n, 1))])
    w, speed = np.zeros((d + 1, n_parts)), np.zeros((d + 1, n_parts))
    target = np.eye(n_parts)[part]
    for _ in range(steps):
        z = xb @ w * 1.0
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = xb.T @ (p - target) / n + 1e-5 * w
        speed = 0.9 * speed - 8.0 * grad
        w += speed
    return w


class Router:
    """Routes vectors of one length: part of a row, parts of a query."""

    def __init__(self, sample: np.ndarray, k: int, recall=RECALL):
        kept_out = np.arange(len(sample)) % HELD_OUT == HELD_OUT - 1
        sample, asked = (sample[~kept_out], sample[kept_out]) if len(sample) >= 128 else (sample, sample)
        x = _unit(sample)
        n = len(x)
        self.n_parts = max(1, min(MAX_PARTS, n // 64))
        part, _ = balanced_parts(x, self.n_parts) if self.n_parts > 1 else (np.zeros(n, int), None)
        self.w = fit_router(x, part, self.n_parts) if self.n_parts > 1 else np.zeros((sample.shape[1] + 1, 1))
        self.probes = self.n_parts
        # the fewest probes that find the wanted share of the nearest rows among those kept out
        if self.n_parts > 1:
            home, order = self.home(asked), self._ranked(asked)
            place = np.argsort(order, axis=1)
            scores = asked @ asked.T
            np.fill_diagonal(scores, -np.inf)
            near = np.argpartition(-scores, min(k, len(asked) - 1) - 1, axis=1)[:, :min(k, len(asked) - 1)]
            need = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
            self.probes = int(need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)]) + 1

    def _logits(self, v):
        return np.hstack([_unit(v), np.ones((len(v), 1))]) @ self.w

    def _ranked(self, v):
        return np.argsort(-self._logits(v), axis=1, kind="stable")

    def home(self, v):
        return self._logits(v).argmax(1)

    def routes(self, v, others, k):
        """(query row, part) pairs: the most probable parts, until they hold k of ``others`` (rows by query and part)."""
        order = self._ranked(v)
        before = np.cumsum(np.take_along_axis(others, order, axis=1), axis=1) - np.take_along_axis(others, order, axis=1)
        wanted = (np.arange(self.n_parts) < self.probes) | (before < k)
        i, j = np.nonzero(wanted)
        return i, order[i, j]


def _matrix(column, dims):
    return np.asarray(column.values.slice(column.offsets[0].as_py(), len(column) * dims), np.float64).reshape(-1, dims)


def fit(rows: DataFrame, k: int, n: int) -> tuple:
    """(dims, Router) on at most SAMPLE_ROWS rows of the most frequent length: those of the smallest hashes."""
    spread = F.xxhash64("id", "v")
    # about twice the rows needed, so that the choice of the smallest stays small; equal rows count once
    near = rows.where(F.pmod(spread, F.lit(1048576)) < 1048576 * 2.0 * SAMPLE_ROWS / max(n, 1)).select("id", "v").distinct()
    picked = near.orderBy(spread, "id", "v").limit(SAMPLE_ROWS).collect()
    lengths = [len(r["v"]) for r in picked]
    if not lengths:
        return 0, None
    dims = max(sorted(set(lengths)), key=lengths.count)
    return dims, Router(np.array([r["v"] for r in picked if len(r["v"]) == dims]), k)


def _best(q_ids, q, ids, x, k):
    """(query row, row, score) of the k best rows of a block for each query, ties to the smaller id."""
    out = []
    for at in range(0, len(q), 256):
        a, own = q[at:at + 256], q_ids[at:at + 256]
        rough = a @ x.T
        rough[own[:, None] == ids[None, :]] = -np.inf
        # a product by blocks rounds in another order: keep what may still tie, then sum in component order
        slack = 1e-12 * a.shape[1] * np.abs(a).sum(1) * np.abs(x).max()
        edge = np.partition(rough, len(ids) - min(k, len(ids)), axis=1)[:, len(ids) - min(k, len(ids))] - slack
        i, j = np.nonzero((rough >= edge[:, None]) & (rough > -np.inf))
        exact = np.zeros(len(i))
        for d in range(a.shape[1]):
            exact += a[i, d] * x[j, d]
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        out.append((i[keep] + at, j[keep], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(vectors: DataFrame, queries: DataFrame, k=20, vec_id="vec_id", vector="embedding", block_rows=BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` nearest to each query."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    asked = usable(queries, vec_id, vector).dropDuplicates(["id"])
    n = rows.count()
    dims, router = fit(rows, k, n)
    shared = spark.sparkContext.broadcast((dims, router))

    def parts_of(b, sizes_of=None):
        """(row, part) pairs; rows of another length have a part of their own per length."""
        d, r = shared.value
        sizes = np.asarray(b.column(1).value_lengths())
        same = np.flatnonzero(sizes == d)
        other = np.flatnonzero(sizes != d)
        pairs_i, pairs_p = [other], [-sizes[other].astype(np.int64)]
        if len(same):
            m = _matrix(b.column(1).take(pa.array(same)), d)
            if sizes_of is None:
                i, p = np.arange(len(same)), r.home(m)
            else:
                others = np.tile([sizes_of.get(part, 0) for part in range(r.n_parts)], (len(same), 1))
                for row, own in enumerate(b.column(2).take(pa.array(same)).to_pylist()):
                    for e in own or ():
                        if e["part"] >= 0:
                            others[row, e["part"]] -= e["n"]
                i, p = r.routes(m, others, k)
            pairs_i.append(same[i])
            pairs_p.append(p)
        return np.concatenate(pairs_i), np.concatenate(pairs_p)

    def dealt(sizes_of=None):
        def run(batches):
            for b in batches:
                i, p = parts_of(b, sizes_of)
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), *(c.take(pa.array(i)) for c in b.columns[:2])],
                                                 ["part", "id", "v"])
        return run

    schema = "part int, id long, v array<double>"
    base = rows.mapInArrow(dealt(), schema)
    # blocks of a part by hash; rows that all share one part fill as many blocks as they need
    sizes = base.groupBy("part").count().collect()  # parts are bounded by MAX_PARTS and the lengths
    blocks = {r["part"]: max(1, math.ceil(r["count"] / block_rows)) for r in sizes}
    # rows of a query's own id by part: at most MAX_PARTS and the lengths of an id
    own = base.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.collect_list(F.struct("part", "n")).alias("own"))
    asked = asked.join(own, "id", "left").select("id", "v", "own")
    many = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]) if blocks else F.create_map(F.lit(0), F.lit(1))
    base = base.withColumns({"q": F.lit(False), "n_blocks": many[F.col("part")]}).withColumn(
        "block", F.expr("cast(pmod(xxhash64(id), n_blocks) as int)")).drop("n_blocks")
    sent = asked.mapInArrow(dealt({r["part"]: r["count"] for r in sizes}), schema).withColumn(
        "n_blocks", F.coalesce(F.try_element_at(many, F.col("part")), F.lit(0))).where("n_blocks > 0").withColumn(
        "block", F.explode(F.expr("sequence(0, n_blocks - 1)"))).select("part", "id", "v", F.lit(True).alias("q"), "block")

    def score(batches):
        """Sorted by block: the rows of a block come before the queries sent to it."""
        key, held, x, ids = None, [], None, None
        for b in batches:
            keys = np.asarray(b.column(0)).astype(np.int64) << 32 | np.asarray(b.column(4)).astype(np.int64)
            is_q = np.asarray(b.column(3).to_numpy(zero_copy_only=False)).astype(bool)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(is_q.astype(int)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                if hi == lo:
                    continue
                if keys[lo] != key:
                    key, held, x = keys[lo], [], None
                part = b.slice(int(lo), int(hi - lo))
                d = len(part.column(2)[0])
                if not is_q[lo]:
                    held.append((np.asarray(part.column(1)), _matrix(part.column(2), d)))
                    continue
                if not held:
                    continue
                if x is None:
                    ids, x = np.concatenate([h[0] for h in held]), np.vstack([h[1] for h in held])
                q_ids = np.asarray(part.column(1))
                i, j, s = _best(q_ids, _matrix(part.column(2), d), ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(s)], ["query_id", "vec_id", "score"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(blocks.values()))
    met = base.select("part", "id", "v", "q", "block").unionByName(sent).repartition(tasks, "part", "block").sortWithinPartitions("part", "block", "q")
    found = met.mapInArrow(score, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
