"""SimHash near-duplicates with vantage-point trees over 64-bit fingerprints.

Equal fingerprints are first collapsed to one row. A vantage-point tree over a bounded sample
splits the rest into shards by Hamming distance: inside a node's radius or outside. Every
fingerprint is at home in one shard and also visits each shard whose region lies within the
search radius of it by the triangle bounds. A shard builds a finer tree of the same kind over
its residents; residents and visitors descend it, pruned by the same bounds, and are compared
bit by bit in the leaves they reach. So all pairs within the radius are found, exactly.

A shard does not emit pairs but a forest: each resident points at the smallest member of its
linked set in the shard, each visitor at one member of every set it touches. Memory is one
shard's residents plus one batch of visitors.

Defined results: null and empty texts and texts of blanks have fingerprint zero and link like
any other; texts of one or two words use the whole sequence as their shingle. A null id gets
the component of its fingerprint and never names one unless all its ids are null (then null).
Repeated rows share a component. Extra columns are ignored. No rows give no rows.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.components import components
from pulsegrid.session import pin

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Residents of a shard, sampled fingerprints for the upper tree, fingerprints in a leaf.
SHARD_ROWS, SAMPLE_ROWS, LEAF = 50_000, 1 << 15, 48
_CHUNK = 1 << 17


def _hashes(text: str, size: int, seed: int):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return [digest(g, seed) for g in grams]


def _majority(hashes: list, lengths: list):
    """Fingerprints of consecutive runs of hashes: a bit is set where over half of the run has it."""
    h = np.array(hashes, np.uint64)
    n = np.array(lengths, np.int64)
    sums = np.zeros((len(n), 64), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[at:at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(owner[at:at + _CHUNK], prepend=-1))
        sums[owner[at:at + _CHUNK][first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text", shingle=SHINGLE, seed=SEED) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer."""
    def run(batches):
        for b in batches:
            ids, fps, hashes, lengths = b.column(0), [], [], []
            for t in b.column(1):
                h = _hashes(t.as_py(), shingle, seed)
                hashes += h
                lengths.append(len(h))
                if len(hashes) > 1 << 20:
                    fps.append(_majority(hashes, lengths))
                    hashes, lengths = [], []
            if lengths:
                fps.append(_majority(hashes, lengths))
            if fps:
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(fps).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def with_fingerprints(docs: DataFrame, text="text", shingle=SHINGLE, seed=SEED) -> DataFrame:
    """``docs`` with the fingerprint of its text as 16 hex digits in ``_fp``."""
    at, names = docs.columns.index(text), [*docs.columns, "_fp"]

    def run(batches):
        for b in batches:
            fps = [_majority(h, [len(h)])[0] for h in (_hashes(t.as_py(), shingle, seed) for t in b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f"{int(v):016x}" for v in fps], pa.string())], names)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _fp string")


def _distance(a, b):
    return np.bitwise_count(a ^ b).astype(np.int16)


class VPTree:
    """Binary vantage-point tree in arrays: node i has children 2i+1 (near) and 2i+2 (far)."""

    def __init__(self, points, leaf_rows, max_depth=40, radius=RADIUS):
        self.vantage, self.limit, self.leaf, self.radius = [], [], [], radius
        self.near, self.far, self.members = [], [], []
        rng = np.random.default_rng(7)
        stack = [(np.arange(len(points)), 0, None, None)]
        while stack:
            rows, depth, parent, side = stack.pop()
            node = len(self.vantage)
            if parent is not None:
                (self.near if side == 0 else self.far)[parent] = node
            split = self._split(points, rows, rng) if len(rows) > leaf_rows and depth < max_depth else None
            self.near.append(-1)
            self.far.append(-1)
            if split is None:
                self.vantage.append(0)
                self.limit.append(0)
                self.leaf.append(len(self.members))
                self.members.append(rows)
                continue
            v, mu, inside = split
            self.vantage.append(int(v))
            self.limit.append(int(mu))
            self.leaf.append(-1)
            stack += [(rows[~inside], depth + 1, node, 1), (rows[inside], depth + 1, node, 0)]
        self.vantage = np.array(self.vantage, np.uint64)
        self.limit, self.leaf = np.array(self.limit, np.int16), np.array(self.leaf)
        self.near, self.far = np.array(self.near), np.array(self.far)

    def _split(self, points, rows, rng):
        """The vantage point of a few whose distances spread most, and their median."""
        best = None
        some = points[rows[rng.integers(0, len(rows), 256)]] if len(rows) > 256 else points[rows]
        for v in points[rows[rng.integers(0, len(rows), 6)]]:
            spread = _distance(some, v).std()
            if best is None or spread > best[0]:
                best = (spread, v)
        v = best[1]
        d = _distance(points[rows], v)
        mu = int(np.median(d))
        inside = d <= mu
        if inside.all():
            inside, mu = d < mu, mu - 1
        return None if inside.all() or not inside.any() else (v, mu, inside)

    def leaves(self, queries, radius=None):
        """(query, leaf) index pairs for all leaves whose region may hold a point within the radius."""
        r = self.radius if radius is None else radius
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        out_q, out_leaf = [], []
        while len(q):
            done = self.leaf[node] >= 0
            out_q.append(q[done])
            out_leaf.append(self.leaf[node[done]])
            q, node = q[~done], node[~done]
            d, mu = _distance(queries[q], self.vantage[node]), self.limit[node]
            go_near, go_far = d <= mu + r, d > mu - r
            q, node = np.concatenate([q[go_near], q[go_far]]), np.concatenate([self.near[node[go_near]], self.far[node[go_far]]])
        return np.concatenate(out_q), np.concatenate(out_leaf)


class _Shard:
    """Residents of one shard: a local tree and the linked sets found so far."""

    def __init__(self, residents):
        self.fp = np.sort(residents)
        self.tree = VPTree(self.fp, LEAF)
        self.label = np.arange(len(self.fp))
        self.order = np.concatenate(self.tree.members)
        self.sizes = np.array([len(m) for m in self.tree.members])
        self.starts = np.cumsum(self.sizes) - self.sizes
        for at in range(0, len(self.fp), 1024):
            for q, j in self._matches(self.fp[at:at + 1024]):
                self._link(q + at, j)

    def _matches(self, queries):
        q, leaf = self.tree.leaves(queries)
        n = self.sizes[leaf]
        cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), 4 << 20)[1:]) if n.sum() > 4 << 20 else []
        for part in np.split(np.arange(len(q)), cuts):
            k = n[part]
            rep = np.repeat(q[part], k)
            place = np.repeat(self.starts[leaf[part]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            j = self.order[place]
            hit = np.bitwise_count(queries[rep] ^ self.fp[j]) <= RADIUS
            yield rep[hit], j[hit]

    def _link(self, a, b):
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                jumped = self.label[self.label]
                if (jumped == self.label).all():
                    break
                self.label = jumped

    def forest(self):
        own = np.flatnonzero(self.label != np.arange(len(self.fp)))
        return self.fp[own], self.fp[self.label[own]]

    def visit(self, visitors):
        us, vs = [], []
        for at in range(0, len(visitors), 1024):
            for q, j in self._matches(visitors[at:at + 1024]):
                pairs = np.unique(np.stack([q + at, self.label[j]]), axis=1)
                us.append(visitors[pairs[0]])
                vs.append(self.fp[pairs[1]])
        none = np.zeros(0, np.uint64)
        return np.concatenate(us or [none]), np.concatenate(vs or [none])


def _search(batches):
    """Rows sorted by (shard, visit): residents of a shard come first, then its visitors."""
    def edges(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    at, residents, shard = None, [], None

    def settled():
        s = _Shard(np.concatenate(residents))
        return s, edges(*s.forest())

    for b in batches:
        ids, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        visit = b.column(2).to_numpy(zero_copy_only=False)
        bounds = np.flatnonzero(np.diff(ids.astype(np.int64) * 2 + visit)) + 1
        for rows in np.split(np.arange(len(ids)), bounds):
            if not len(rows):
                continue
            if ids[rows[0]] != at:
                if residents and shard is None:
                    yield settled()[1]
                at, residents, shard = ids[rows[0]], [], None
            if not visit[rows[0]]:
                residents.append(fps[rows])
            elif residents:
                if shard is None:
                    shard, found = settled()
                    yield found
                yield edges(*shard.visit(fps[rows]))
    if residents and shard is None:
        yield settled()[1]


def links(distinct_fps: DataFrame, shard_rows=SHARD_ROWS) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints linked within RADIUS; no fp twice in the input."""
    spark = distinct_fps.sparkSession
    n = distinct_fps.count()
    sample = [r[0] for r in distinct_fps.where(
        F.expr(f"pmod(xxhash64(fp), 1048576) < {1048576 * SAMPLE_ROWS / max(n, 1)}")).limit(2 * SAMPLE_ROWS).collect()] if n > shard_rows else []
    points = np.array(sorted(sample), np.int64).view(np.uint64)
    tree = VPTree(points, max(2, len(points) * shard_rows // max(n, 1)))

    def deal(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 1 << 15):
                part = fp[at:at + (1 << 15)]
                q, home = tree.leaves(part, 0)
                home_of = np.empty(len(part), np.int64)
                home_of[q] = home
                q, leaf = tree.leaves(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf.astype(np.int32)), pa.array(part[q].view(np.int64)), pa.array(home_of[q] != leaf)],
                    ["shard", "fp", "visit"])

    dealt = distinct_fps.select("fp").mapInArrow(deal, "shard int, fp long, visit boolean")
    parts = max(len(tree.members), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, "shard").sortWithinPartitions("shard", "visit").mapInArrow(
        _search, "u long, v long")


def with_components(docs: DataFrame, doc_id="doc_id", text="text", shard_rows=SHARD_ROWS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest linked doc_id) and root, the fingerprint that names its component."""
    fps = pin(fingerprints(docs, doc_id, text))
    distinct = pin(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, shard_rows))
    rooted = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = pin(rooted.join(lowest, "root").select("fp", "component_id", "root"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", shard_rows=SHARD_ROWS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id (smallest linked doc_id)."""
    return with_components(docs, doc_id, text, shard_rows).drop("root")
