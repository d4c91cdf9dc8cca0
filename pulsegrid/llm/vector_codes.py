"""Product-quantised vector codes from integer k-means over Hilbert-sorted flat blocks.

A vector's integers are floor(1024 x), cut into PARTS equal consecutive parts. The parts of every position are
sorted along a Hilbert curve by a range partitioning and cut into flat blocks of at most BLOCK_ROWS neighbours.
A block is one row: its integers, the minimum and maximum of every component (its box) and their sums. Blocks
are written once to the checkpoint folder; every round reads them with the four codebooks broadcast (ENTRIES
rows of the vector's length, whatever the table).

For a block, the squared distances of an entry to the nearest and to the farthest point of the box bound those
to all its rows. Entries whose nearest point is farther than the farthest point of another entry cannot win;
the others are the block's shortlist, in index order. A shortlist of one entry settles the block by its
sums alone; else its rows meet the shortlist in an integer kernel: a matrix product in doubles where every
term stays below 2^53, differences in 64 bits beyond. A round sums counts and components by (position, entry),
first in the task, then in one aggregate of at most PARTS * ENTRIES groups, and replaces entries by floor(sum / count).

Defined results: rows whose vector is null or holds a null or non-finite component are dropped. Vectors shorter than
the longest kept one, or of a length not divisible by PARTS, count as filled up with zeros. Integers beyond
2^24 in size are taken as 2^24 of their sign, so that all distances and sums are exact. Codebooks start from the rows of
the smallest ids (null ids last, rows of equal ids by their components); fewer than ENTRIES rows give fewer entries.
Repeated rows are rows each. No kept rows give no rows. Extra columns are ignored.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import pin

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block; integers are saturated at this size.
BLOCK_ROWS, LARGEST = 128, 1 << 24


def integers(values) -> np.ndarray:
    """floor(1024 x) of doubles, saturated."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(np.asarray(values, np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of small non-negative integers below 2^bits (columns * bits <= 63)."""
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(d):
            upper = (x[:, i] & q) != 0
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(upper, q - 1, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[:, d - 1] & q) != 0, q - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


@dataclass(frozen=True)
class Shape:
    """Length of a part, and the range of all integers for the cells of the curve."""

    width: int
    low: int
    high: int

    def keys(self, x):
        used = x[:, :63]
        bits = max(1, min(16, 63 // used.shape[1]))
        return hilbert_keys(((used - self.low) << bits) // (self.high - self.low + 1), bits)

    @property
    def dtype(self):
        return np.int16 if max(-self.low, self.high) < 1 << 15 else np.int32


def box_bounds(low: np.ndarray, high: np.ndarray, entries: np.ndarray):
    """Squared distances (boxes x entries) of entries to the nearest and the farthest point of each box."""
    below, above = low[:, None, :] - entries[None], entries[None] - high[:, None, :]
    near, far = np.maximum(np.maximum(below, above), 0), np.maximum(-below, -above)
    return (near * near).sum(2), (far * far).sum(2)


def assign(x: np.ndarray, entries: np.ndarray):
    """(index of the nearest entry, squared distance) of every row, ties to the lower index."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(most) ** 2 * x.shape[1] < 1 << 53:
        a, e = x.astype(np.float64), entries.astype(np.float64)
        d = (e * e).sum(1) - 2 * (a @ e.T)
        best = d.argmin(1)
        return best, (d[np.arange(len(x)), best] + (a * a).sum(1)).astype(np.int64)
    best, least = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for i, e in enumerate(entries):
        d = ((x - e) ** 2).sum(1)
        best, least = np.where(d < least, i, best), np.minimum(d, least)
    return best, least


def _flat(column, width, dtype):
    """Integers of a binary column as rows of ``width``."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _blocks(rows: DataFrame, shape: Shape) -> DataFrame:
    """(part, low, high, sums, x, ids, labels, digests): blocks of Hilbert neighbours of one position."""
    label = rows.schema["label"].dataType
    kept = [T.StructField("id", T.LongType()), T.StructField("label", label)]
    types = T.StructType([T.StructField(c, t) for c, t in (("part", T.IntegerType()), ("key", T.LongType()), ("salt", T.IntegerType()),
                                                           ("x", T.BinaryType()), ("digest", T.BinaryType()))] + kept)

    def split(batches):
        nth = 0
        for b in batches:
            lengths = np.asarray(b.column(2).value_lengths()).astype(np.int64)
            at = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            whole = np.zeros((len(lengths), PARTS * shape.width), np.int64)
            whole[at, place] = integers(b.column(2).flatten())
            digests = pa.array([hashlib.md5(r.tobytes()).digest() for r in whole], pa.binary())
            salt = pa.array(((nth + np.arange(len(whole))) % 1024).astype(np.int32))
            nth += len(whole)
            for p in range(PARTS):
                x = np.ascontiguousarray(whole[:, p * shape.width:(p + 1) * shape.width])
                parts = pa.array([r.tobytes() for r in x.astype(shape.dtype)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(shape.keys(x)), salt, parts, digests,
                                                  b.column(0), b.column(1)], ["part", "key", "salt", "x", "digest", "id", "label"])

    def gather(batches):
        for b in batches:
            part = np.asarray(b.column(0))
            x = _flat(b.column(1), shape.width, shape.dtype).astype(np.int64)
            ends = np.flatnonzero(np.r_[np.diff(part) != 0, True]) + 1
            starts = np.concatenate([np.arange(lo, hi, BLOCK_ROWS) for lo, hi in zip(np.r_[0, ends[:-1]], ends)]).astype(np.int64)
            stops = np.minimum(starts + BLOCK_ROWS, ends[np.searchsorted(ends, starts, "right")])
            offsets = pa.array(np.r_[starts, len(part)].astype(np.int32))
            boxes = [[f(x[a:o], axis=0).astype(np.int64).tobytes() for a, o in zip(starts, stops)] for f in (np.min, np.max, np.sum)]
            flat = [x[a:o].astype(shape.dtype).tobytes() for a, o in zip(starts, stops)]
            lists = [pa.ListArray.from_arrays(offsets, b.column(c)) for c in (3, 4, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), *(pa.array(c, pa.binary()) for c in (*boxes, flat)), *lists],
                                             ["part", "low", "high", "sums", "x", "ids", "labels", "digests"])

    out = T.StructType([T.StructField("part", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("low", "high", "sums", "x")]
                       + [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)),
                          T.StructField("digests", T.ArrayType(T.BinaryType()))])
    # equal parts share a key; the salt lets the range partitioning cut them as well
    ordered = rows.mapInArrow(split, types).repartitionByRange("part", "key", "salt").sortWithinPartitions("part", "key", "salt")
    return ordered.select("part", "x", "digest", "id", "label").mapInArrow(gather, out)


def _shortlists(b, books, width):
    """Per block of an Arrow batch (row, position, its shortlist)."""
    part = np.asarray(b.column(0))
    low, high = (_flat(b.column(c), width, np.int64) for c in (1, 2))
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        for at in np.array_split(rows, -(-len(rows) // 64)):
            near, far = box_bounds(low[at], high[at], books[p])
            open_ = near <= far.min(1, keepdims=True)
            for i, mask in zip(at, open_):
                yield int(i), int(p), np.flatnonzero(mask)


def _round(blocks: DataFrame, books, shape: Shape):
    """Codebooks after one assignment of all blocks."""
    width, dtype, n = shape.width, shape.dtype, len(books[0])
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        counts, sums = np.zeros((PARTS, n), np.int64), np.zeros((PARTS, n, width), np.int64)
        for b in batches:
            for i, p, short in _shortlists(b, books, width):
                data = b.column(4)[i].as_buffer()
                size = len(data) // (width * np.dtype(dtype).itemsize)
                if len(short) == 1:
                    counts[p, short[0]] += size
                    sums[p, short[0]] += np.frombuffer(b.column(3)[i].as_buffer(), np.int64)
                    continue
                x = np.frombuffer(data, dtype).reshape(size, width).astype(np.int64)
                best = short[assign(x, books[p][short])[0]]
                order = np.argsort(best, kind="stable")
                won, first = np.unique(best[order], return_index=True)
                sums[p, won] += np.add.reduceat(x[order], first)
                counts[p] += np.bincount(best, minlength=n)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]),
                                          pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    partial = blocks.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums"))
    books = [b.copy() for b in books]
    for r in total.collect():  # PARTS * ENTRIES rows at most
        books[r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return books


def _coded(blocks: DataFrame, books, shape: Shape, label) -> DataFrame:
    """(id, label, digest, part, entry, error) of every row and position."""
    width, dtype = shape.width, shape.dtype
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        for b in batches:
            for i, p, short in _shortlists(b, books, width):
                x = np.frombuffer(b.column(4)[i].as_buffer(), dtype).reshape(-1, width).astype(np.int64)
                best, error = assign(x, books[p][short])
                ids, labels, digests = (b.column(c)[i].values for c in (5, 6, 7))
                yield pa.RecordBatch.from_arrays([ids, labels, digests, pa.array(np.full(len(x), p, np.int32)), pa.array(short[best].astype(np.int32)),
                                                  pa.array(error)], ["id", "label", "digest", "part", "entry", "error"])

    types = (("id", T.LongType()), ("label", label), ("digest", T.BinaryType()), ("part", T.IntegerType()), ("entry", T.IntegerType()), ("error", T.LongType()))
    return blocks.mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in types]))


def codebooks_digest(books) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def train(vectors: DataFrame, vec_id="vec_id", vector="embedding", label="label"):
    """(blocks, codebooks, shape) after all rounds; blocks are written to the checkpoint folder. None without kept rows."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v")).where(
        "v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    longest, low, high, n = rows.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v")), F.count(F.lit(1))).first()
    if not n:
        return None
    width = max(1, -(-longest // PARTS))
    low, high = integers([min(low or 0.0, 0.0), max(high or 0.0, 0.0)]).tolist()
    shape = Shape(width, low, high)
    first = np.zeros((min(n, ENTRIES), PARTS * width), np.int64)
    for row, r in zip(first, rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(ENTRIES).collect()):
        row[:len(r["v"])] = integers(r["v"])
    books = [np.ascontiguousarray(b) for b in np.split(first, PARTS, axis=1)]
    blocks = pin(_blocks(rows, shape))
    for _ in range(ROUNDS):
        books = _round(blocks, books, shape)
    return blocks, books, shape


def encode(vectors: DataFrame, vec_id="vec_id", vector="embedding", label="label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    kind = vectors.schema[label].dataType
    trained = train(vectors, vec_id, vector, label)
    if trained is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    blocks, books, shape = trained
    each = _coded(blocks, books, shape, kind)
    # the four codes of a row meet on its id, label and digest; rows equal in all of these have equal codes
    of = lambda c, p: F.max(F.when(F.col("part") == p, F.col(c)))
    met = each.groupBy("id", "label", "digest").agg(
        F.concat(*[F.lpad(F.lower(F.hex(of("entry", p))), 2, "0") for p in range(PARTS)]).alias("code"),
        sum(of("error", p) for p in range(PARTS)).alias("error"), (F.count(F.lit(1)) / PARTS).cast("long").alias("copies"))
    met = pin(met)
    total = met.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error") * F.col("copies")).alias("label_error"))
    return (met.join(total, F.col("label").eqNullSafe(F.col("_label"))).withColumn("_", F.explode(F.expr("sequence(1L, copies)")))
            .select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")))
