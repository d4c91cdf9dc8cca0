"""Embedding near-duplicates by spherical-cap filters: a similarity join of all vectors by cosine.

A filter is a direction of one of some random product codes: the rotated space is cut into blocks of components, every block has its own
random codewords, and one codeword a block makes a direction. A vector falls into the caps of all directions
whose product with it reaches a threshold. They are list-decoded: codewords are taken block by block, and a partial choice is
dropped once even the best codewords of the blocks left cannot lift it to the threshold. Threshold and codewords follow
from the number of vectors and their length by the geometry of caps, such that a pair at exactly the wanted cosine shares a
filter with probability RECALL (closer pairs with more); codes are added until that share is met on made pairs. Vectors meet where they share a filter.

Before that join, close vectors are joined to balls, so that a group of near copies is a few rows: equal vectors
become one node, and nodes of the same nearest direction are put, block by block of at most BLOCK_ROWS rows, into balls around a
first vector within half the link angle: all rows of a ball are linked. A ball carries its centre in 16-bit integers,
the largest angle from that code to a member, and the filters of all members. By the triangle inequality two balls that share a
filter are linked entirely, not at all, or undecided; undecided ones are compared row by row in double precision.
A pair counts only in the smallest filter it shares, tasks return counts a ball and the local components of the links, never the links.
Filters of very many balls are cut into blocks that meet pairwise.

Every link is verified (cosine >= the limit); those missed are few by RECALL. Work is quadratic only inside a filter.

Defined results: one row per row of the table. Vectors that are null, empty, zero or hold null or non-finite components, and rows
without an id, link with nothing: no links, a component of their own, kept. Vectors of different lengths are not compared. Rows
that repeat an id or a vector are vectors each; a component's id is the smallest id in it. No rows give no rows.
Extra columns are ignored.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.components import components
from pulsegrid.session import pin, small_side

#: Share of the pairs at exactly the limit that must meet in a filter; rows of a block; slack of angles in radians.
RECALL, BLOCK_ROWS, SLACK = 0.98, 2_048, 1e-6
#: Work of one entry of a filter, in comparisons of two balls there; directions of a code that hold a vector; made pairs that the codes are tried on.
ENTRY_COST, HITS, TRIALS = 2_000, 0.4, 1_024
_FINITE = "v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(v, c -> c <> 0)"


def _unit(x):
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _angles(a, b):
    """Angles between rows of unit vectors, exact to rounding also where they are small."""
    return 2 * np.arcsin(np.minimum(np.sqrt(((a - b) ** 2).sum(1)) / 2, 1))


def cap_shares(dims: int, cosine: float):
    """Thresholds, the share of directions beyond each, and the share of these that also hold a vector at ``cosine``."""
    phi, psi = (np.arange(1, 1200) - 0.5) * math.pi / 1199, (np.arange(1, 400) - 0.5) * math.pi / 399
    mass = np.sin(phi) ** (dims - 2)
    other = np.sin(psi) ** (dims - 3)
    other /= other.sum()
    limits = np.cos(phi[:600][::4])
    alone = np.array([mass[np.cos(phi) >= t].sum() for t in limits]) / mass.sum()
    limits, alone = limits[alone > 1e-15], alone[alone > 1e-15]
    both = []
    second = cosine * np.cos(phi)[:, None] + math.sqrt(1 - cosine ** 2) * np.sin(phi)[:, None] * np.cos(psi)
    for t in limits:
        inside = np.cos(phi) >= t
        both.append((mass[inside] * ((second[inside] >= t) @ other)).sum() / mass[inside].sum())
    return limits, alone, np.array(both)


class ProductCode:
    """Filters for ``n`` vectors of ``dims`` components that link at ``cosine``: several random product codes.

    Directions of one code that hold a vector are alike, so every code is made to hold about HITS of them, and codes
    are added until RECALL of the made pairs meet.
    """

    def __init__(self, dims: int, n: int, cosine: float, seed=11):
        self.dims, self.width = dims, max(8, dims)
        limits, alone, both = cap_shares(self.width, cosine)
        hits = math.log(1 / (1 - RECALL)) / np.maximum(both, 1e-12)
        best = int(np.argmin(hits * (1 + n * alone / ENTRY_COST)))
        self.limit, wanted = limits[best], max(1.0, HITS / alone[best])
        if alone[best] > 0.2:  # so few vectors that one cap holds them all
            self.limit, wanted = -2.0, 1.0
        blocks = 1 if wanted <= 32 else max(2, math.ceil(math.log(wanted) / math.log(128)))
        self.cuts = np.array_split(np.arange(self.width), min(blocks, self.width))
        self.words = max(1, math.ceil(wanted ** (1 / len(self.cuts))))
        self.size = self.words ** len(self.cuts)
        rng = np.random.default_rng([seed, dims])
        a = _unit(rng.normal(size=(TRIALS, dims)))
        b = rng.normal(size=a.shape)
        b -= (b * a).sum(1, keepdims=True) * a
        b = cosine * a + math.sqrt(1 - cosine ** 2) * b / np.maximum(np.sqrt((b * b).sum(1, keepdims=True)), 1e-300)
        b = _unit(b)
        self.codes, apart = [], np.arange(TRIALS)
        while len(apart) > (1 - RECALL) * TRIALS:
            rotation = np.linalg.qr(rng.normal(size=(self.width, self.width)))[0][:dims]
            self.codes.append((rotation, [_unit(rng.normal(size=(self.words, len(c)))) / math.sqrt(len(self.cuts)) for c in self.cuts]))
            (i, f, _), (j, g, _) = (self._reached(x[apart], self.codes[-1]) for x in (a, b))
            met = np.intersect1d(i * self.size + f, j * self.size + g) // self.size
            apart = np.delete(apart, met)

    def _reached(self, x, code):
        """(row, direction) of all directions of one code that reach the threshold, and the nearest one of every row."""
        y = x @ code[0]
        scores = [y[:, c] @ w.T for c, w in zip(self.cuts, code[1])]
        peaks = [s.max(1) for s in scores]
        rows, picks = np.arange(len(x)), np.zeros(len(x), np.int64)
        sums, rest = np.zeros(len(x)), sum(peaks)
        nearest = np.zeros(len(x), np.int64)
        for s, peak in zip(scores, peaks):
            nearest = nearest * self.words + s.argmax(1)
            rest = rest - peak
            at, pick = np.nonzero((sums + rest[rows])[:, None] + s[rows] >= self.limit)
            sums, picks, rows = sums[at] + s[rows[at], pick], picks[at] * self.words + pick, rows[at]
        return rows, picks, nearest

    def decode(self, x):
        """(row, filter) of all directions reached, by row; the nearest direction of the first code, which counts as reached."""
        found = [self._reached(x, c) for c in self.codes]
        total = self.size * len(self.codes)
        keys = [r * total + k * self.size + f for k, (r, f, _) in enumerate(found)]
        keys = np.unique(np.concatenate([*keys, np.arange(len(x)) * total + found[0][2]]))
        return keys // total, keys % total, found[0][2]


def _key(ident: int, digest: bytes) -> bytes:
    """Bytes that sort by id, then digest."""
    return (ident + (1 << 63)).to_bytes(8, "big") + digest


def _matrix(cells, kind):
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1).astype(np.float64)


def _groups(batches, keys):
    """Record batches of equal leading ``keys`` columns from a sorted stream."""
    held = None
    for b in batches:
        b = b if held is None else pa.concat_batches([held, b])
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for c in range(keys):
            v = np.asarray(b.column(c))
            change |= v[1:] != v[:-1]
        cuts = np.r_[0, np.flatnonzero(change) + 1, b.num_rows]
        for lo, hi in zip(cuts[:-2], cuts[1:-1]):
            yield b.slice(int(lo), int(hi - lo))
        held = b.slice(int(cuts[-2]))
    if held is not None:
        yield held


def _blocked(rows: DataFrame, key: str, by: str, pairs=False) -> DataFrame:
    """``block`` of every row: keys of over BLOCK_ROWS rows are dealt by hash. With ``pairs``, the row is in every pair of blocks that holds its own."""
    hot = rows.groupBy(key).count().where(F.col("count") > BLOCK_ROWS).select(key, F.expr(f"cast(ceil(count / {BLOCK_ROWS}) as int)").alias("_n"))
    rows = rows.join(small_side(hot), key, "left").withColumn("_b", F.expr(f"if(_n is null, 0, cast(pmod(xxhash64({by}), _n) as int))"))
    if not pairs:
        return rows.withColumnRenamed("_b", "block").drop("_n")
    other = F.explode(F.expr("if(_n is null, array(0), sequence(0, _n - 1))"))
    rows = rows.withColumn("_o", other).withColumns({"block": F.least("_b", "_o"), "to": F.greatest("_b", "_o")})
    # own block of the row: 0 where it is the first of the pair
    return rows.withColumn("side", F.expr("cast(_b <> block as int)")).drop("_n", "_b", "_o")


def _nodes(rows: DataFrame) -> DataFrame:
    """(id, digest, v): vectors as bytes with their digest."""
    kind = "float" if rows.schema["v"].dataType.elementType == T.FloatType() else "double"
    dtype = np.float32 if kind == "float" else np.float64

    def run(batches):
        for b in batches:
            flat = np.asarray(b.column(1).flatten()).astype(dtype, copy=False)
            ends = np.cumsum(np.asarray(b.column(1).value_lengths()))
            cells = [c.tobytes() for c in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.md5(c).digest() for c in cells], pa.binary()), pa.array(cells, pa.binary())],
                                             ["id", "digest", "v"])

    return rows.mapInArrow(run, "id long, digest binary, v binary"), dtype


def _balls(nodes: DataFrame, n: int, cosine: float, dtype) -> DataFrame:
    """One row a node: key, n, v and its ball; the first node of a ball also carries code, radius, rows and filters of the ball."""
    half = math.acos(cosine) / 2 - SLACK

    def decode(batches):
        codes = {}
        for b in batches:
            lengths = np.asarray(pc.binary_length(b.column(2))) // np.dtype(dtype).itemsize
            for dims in np.unique(lengths):
                part = b.take(pa.array(np.flatnonzero(lengths == dims)))
                code = codes[dims] if dims in codes else codes.setdefault(dims, ProductCode(int(dims), n, cosine))
                x = _unit(_matrix(part.column(2).to_pylist(), dtype))
                for lo in range(0, len(x), 512):
                    rows, filters, nearest = code.decode(x[lo:lo + 512])
                    offsets = np.searchsorted(rows, np.arange(len(nearest) + 1)).astype(np.int32)
                    base = int(dims) << 40
                    cut = part.slice(lo, 512)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nearest + base), pa.array([_key(i, d) for i, d in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist())], pa.binary()),
                         cut.column(3), cut.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(filters + base))],
                        ["home", "key", "n", "v", "filters"])

    def gather(batches):
        for g in _groups(batches, 2):
            for at in range(0, g.num_rows, 2 * BLOCK_ROWS):
                yield _balls_of(g.slice(at, 2 * BLOCK_ROWS), half, dtype)

    decoded = nodes.select("id", "digest", "v", "n").mapInArrow(decode, "home long, key binary, n long, v binary, filters array<long>")
    dealt = _blocked(pin(decoded), "home", "key").select("home", "block", "key", "n", "v", "filters")
    return dealt.repartition("home", "block").sortWithinPartitions("home", "block", "key").mapInArrow(
        gather, "key binary, n long, v binary, ball binary, code binary, radius double, rows long, filters array<long>")


def _balls_of(g, half, dtype):
    """Balls of some nodes, sorted by key: each node not yet in one starts a ball of all that are near enough."""
    x = _unit(_matrix(g.column(4).to_pylist(), dtype))
    ball = np.full(len(x), -1)
    if len(x) > 1:
        near = x @ x.T >= math.cos(half)
    for i in range(len(x)):
        if ball[i] < 0:
            ball[i] = i
            if len(x) > 1:
                ball[near[i] & (ball < 0)] = i
    keys, counts = g.column(2).to_pylist(), np.asarray(g.column(3))
    ends, values = np.asarray(g.column(5).offsets), np.asarray(g.column(5).values)
    codes, radii, rows, filters = ([None] * len(x) for _ in range(4))
    for i in np.unique(ball):
        of = np.flatnonzero(ball == i)
        centre = _unit(x[of].sum(0, keepdims=True)) if len(of) > 1 else x[of]
        q = np.rint(centre / np.abs(centre).max() * 32767).astype(np.int16)
        codes[i], rows[i] = q.tobytes(), int(counts[of].sum())
        radii[i] = float(_angles(x[of], _unit(q.astype(np.float64))).max()) + SLACK
        filters[i] = np.unique(np.concatenate([values[ends[j]:ends[j + 1]] for j in of]))
    return pa.RecordBatch.from_arrays(
        [g.column(2), g.column(3), g.column(4), pa.array([keys[i] for i in ball], pa.binary()), pa.array(codes, pa.binary()), pa.array(radii, pa.float64()),
         pa.array(rows, pa.int64()), pa.array(filters, pa.list_(pa.int64()))], ["key", "n", "v", "ball", "code", "radius", "rows", "filters"])


def _unshared(i, j, lists):
    """Whether the lists of rows i and j have no value in common."""
    lengths = np.array([len(v) for v in lists])
    row = np.repeat(np.arange(len(lists)), lengths)
    _, column, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    keep = often[column] > 1
    column, row = np.unique(column[keep], return_inverse=True)[1], row[keep]
    if not len(row):
        return np.ones(len(i), bool)
    held = np.zeros((len(lists), column.max() + 1), bool)
    held[row, column] = True
    held = np.packbits(held, axis=1)
    step = max(1, (16 << 20) // held.shape[1])
    return np.concatenate([~(held[i[a:a + step]] & held[j[a:a + step]]).any(1) for a in range(0, len(i), step)])


def _local_roots(n, i, j):
    """Smallest row linked to each row by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _meet(balls: DataFrame, cosine: float) -> DataFrame:
    """(kind, a, b, n): counts of rows linked to ball a (kind 0), links of balls a and b that join all (1), undecided pairs (2)."""
    theta = math.acos(cosine)

    def run(batches):
        for g in _groups(batches, 3):
            if g.num_rows < 2:
                continue
            same = g.column(1)[0].as_py() == g.column(2)[0].as_py()
            x = _unit(_matrix(g.column(5).to_pylist(), np.int16))
            radius, side = np.asarray(g.column(6)), np.asarray(g.column(3))
            reach = math.cos(min(math.pi, theta + 2 * radius.max() + SLACK))
            left, right = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            cos = x[left] @ x[right].T
            i, j = np.nonzero(cos >= reach)
            if same:
                i, j = i[i < j], j[i < j]
            angle = np.arccos(np.minimum(cos[i, j], 1))
            i, j = left[i], right[j]
            both = radius[i] + radius[j]
            near = angle <= theta + both
            i, j, angle, both = i[near], j[near], angle[near], both[near]
            if not len(i):
                continue
            ends, values = np.asarray(g.column(8).offsets), np.asarray(g.column(8).values)
            used, at = np.unique(np.r_[i, j], return_inverse=True)
            mine = _unshared(at[:len(i)], at[len(i):], [values[ends[u]:ends[u + 1]] for u in used])
            sure = (angle + both <= theta)[mine]
            i, j = i[mine], j[mine]
            rows, keys = np.asarray(g.column(7)), g.column(4).to_pylist()
            open_i, open_j, i, j = i[~sure], j[~sure], i[sure], j[sure]
            n = np.bincount(i, rows[j], len(x)) + np.bincount(j, rows[i], len(x))
            root = _local_roots(len(x), i, j)
            some, joined = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(x)))
            yield _found([(0, keys[u], None, int(n[u])) for u in some] + [(1, keys[u], keys[root[u]], 0) for u in joined]
                         + [(2, keys[u], keys[v], 0) for u, v in zip(open_i, open_j)])

    each = balls.select(F.explode("filters").alias("f"), "ball", "code", "radius", "rows", "filters").withColumn("filters", F.expr("filter(filters, x -> x < f)"))
    dealt = _blocked(each, "f", "ball", pairs=True).select("f", "block", "to", "side", "ball", "code", "radius", "rows", "filters")
    return dealt.repartition("f", "block", "to").sortWithinPartitions("f", "block", "to").mapInArrow(run, "kind int, a binary, b binary, n long")


def _found(rows):
    kind, a, b, n = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())],
                                      ["kind", "a", "b", "n"])


def _compare(undecided: DataFrame, members: DataFrame, cosine: float, dtype) -> DataFrame:
    """(kind, a, b, n) of undecided pairs of balls by their rows: counts a node (kind 0) and linked balls (1).

    The rows of the ball with more nodes stay, in blocks; those of all its partners pass by.
    """
    wide = members.groupBy("ball").agg(F.count(F.lit(1)).alias("nodes"))
    sized = undecided.join(wide.withColumnsRenamed({"ball": "a", "nodes": "na"}), "a").join(wide.withColumnsRenamed({"ball": "b", "nodes": "nb"}), "b")
    pairs = pin(sized.selectExpr("if(na >= nb, a, b) as ball", "if(na >= nb, b, a) as other"))
    stay = _blocked(members.join(pairs.select("ball").distinct(), "ball", "left_semi"), "ball", "key")
    blocks = stay.groupBy("ball").agg(F.max("block").alias("last"))
    pass_by = (pairs.join(blocks, "ball").join(members.withColumnRenamed("ball", "other"), "other")
               .withColumn("block", F.explode(F.expr("sequence(0, last)"))))
    met = stay.select("ball", "block", F.lit(False).alias("by"), F.lit(None).cast("binary").alias("other"), "key", "n", "v").unionByName(
        pass_by.select("ball", "block", F.lit(True).alias("by"), "other", "key", "n", "v"))

    def run(batches):
        own, held, x = None, None, None
        for b in batches:
            for g in _groups([b], 3):
                ident = (g.column(0)[0].as_py(), g.column(1)[0].as_py())
                if ident != own:
                    own, held, x = ident, [], None
                if not g.column(2)[0].as_py():
                    held.append(g)
                    continue
                if x is None:
                    stay = pa.concat_batches(held)
                    x, keys, n = _unit(_matrix(stay.column(6).to_pylist(), dtype)), stay.column(4).to_pylist(), np.asarray(stay.column(5))
                cells = g.column(6).to_pylist()
                if len(cells[0]) != len(held[0].column(6)[0].as_py()):
                    continue
                for at in range(0, len(cells), BLOCK_ROWS):
                    y, m = _unit(_matrix(cells[at:at + BLOCK_ROWS], dtype)), np.asarray(g.column(5))[at:at + BLOCK_ROWS]
                    linked = x @ y.T >= cosine
                    to_x, to_y = linked @ m, n @ linked
                    others, theirs = g.column(3).to_pylist()[at:at + BLOCK_ROWS], g.column(4).to_pylist()[at:at + BLOCK_ROWS]
                    yield _found([(0, keys[u], None, int(to_x[u])) for u in np.flatnonzero(to_x)]
                                 + [(0, theirs[u], None, int(to_y[u])) for u in np.flatnonzero(to_y)]
                                 + [(1, own[0], o, 0) for o in {others[u] for u in np.flatnonzero(to_y)}])

    return met.repartition("ball", "block").sortWithinPartitions("ball", "block", "by").mapInArrow(run, "kind int, a binary, b binary, n long")


def linked(vectors: DataFrame, cosine=0.9, vec_id="vec_id", vector="embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    v = F.col(vector)
    if vectors.schema[vector].dataType.elementType != T.FloatType():
        v = v.cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    takes_part = F.expr(f"id is not null and {_FINITE}")
    cells, dtype = _nodes(rows.where(takes_part))
    nodes = pin(cells.groupBy("digest", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    placed = pin(_balls(nodes, nodes.count(), float(cosine), dtype))
    found = pin(_meet(placed.where("code is not null"), cosine))
    members = placed.select("ball", "key", "n", "v")
    compared = pin(_compare(found.where("kind = 2").select("a", "b"), members, cosine, dtype))
    roots = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
                       .union(compared.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))))
    by_ball = placed.where("code is not null").select("ball", "rows").join(
        found.where("kind = 0").groupBy(F.col("a").alias("ball")).agg(F.sum("n").alias("joined")), "ball", "left").join(
        roots.withColumnRenamed("u", "ball"), "ball", "left").select(
        "ball", (F.col("rows") - 1 + F.coalesce("joined", F.lit(0))).alias("inside"), F.coalesce("root", "ball").alias("root"))
    by_node = compared.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("compared"))
    state = placed.select("key", "ball").join(by_ball, "ball").join(by_node, "key", "left").select(
        F.expr("substring(key, 9, 16)").alias("digest"), (F.col("inside") + F.coalesce("compared", F.lit(0))).alias("n_links"),
        F.expr("cast(cast(conv(hex(substring(root, 1, 8)), 16, 10) as decimal(20, 0)) - 9223372036854775808 as bigint)").alias("component_id"))
    alone = rows.where(~F.coalesce(takes_part, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return (cells.select("id", "digest").join(state, "digest").select("id", "n_links", "component_id").unionByName(alone)
            .select(F.col("id").alias("vec_id"), "n_links", "component_id", F.expr("id <=> component_id").alias("kept")))
