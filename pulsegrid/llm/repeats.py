"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the corpus.
The start positions are suffixes whose first ``length`` bytes are to be sorted; this is done
without ever writing a row per position:

1. Anchors. In every window of ``length`` bytes the smallest hashed 32-gram (leftmost on ties) is
   its anchor. Equal windows have equal anchors at equal offsets, and only about one position in
   37 is an anchor. The 32-gram hash is the initial bucket of all windows of the anchor.
2. Anchors whose bucket has one member in the corpus hold no repeat; they end here.
3. Texts that occur again as a whole are taken out except for their first document: every window
   of a later copy starts earlier, so a copy of at least ``length`` bytes goes entirely.
4. The other anchors fetch the bytes their windows span, and buckets are refined: windows of a
   bucket are sorted by the 8-byte identifiers at further offsets, the ones at the ends first, and
   the new bucket numbers are what the next round sorts on; windows alone in a bucket drop out.
   After the last offset a bucket holds equal windows. Identifiers are the bytes themselves, so
   the result is exact. All members of a bucket but the first are repeats.

A bucket of more than HOT_ROWS anchors never meets in one task: there, equal spans are first
collapsed by an aggregate, and the windows of the rest are grouped by 128-bit digest.

Order: doc_id (null first), then start. Rows that share a doc_id with different texts are
ordered by the hash of their text; rows equal in both are one document and share the result.
Defined results: a null or empty text has 0 bytes, nothing removed and the digest of the empty
string; texts shorter than ``length`` lose nothing. Extra columns are ignored. No rows give no
rows. Long texts are cut into pieces of PIECE windows that overlap by ``length``.
"""

import gc
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import ensure_checkpoint_dir, pin

GRAM, PIECE, HOT_ROWS, CHUNK_ROWS = 32, 1 << 22, 20_000, 30_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64((1 << 24) - 1)


def _words(buf) -> np.ndarray:
    """The 8-byte word at every offset of a buffer, unaligned."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def anchors(text: bytes, length: int):
    """(hash, position, lo, hi) of each anchor: it is the anchor of the windows that start
    ``lo`` down to ``hi`` bytes before it."""
    n = len(text)
    if n < length:
        return
    width = length - GRAM + 1
    for at in range(0, n - length + 1, PIECE):
        word = _words(text[at:at + PIECE + length - 1])
        grams = len(word) + 8 - GRAM
        h = word[:grams] * _MIX[0]
        for i in range(1, GRAM // 8):
            h += word[8 * i:8 * i + grams] * _MIX[i]
        h ^= h >> np.uint64(32)
        h *= _MIX[3]
        h ^= h >> np.uint64(29)
        low = (h & ~_LOW) | np.arange(grams, dtype=np.uint64)
        k = 1
        while 2 * k <= width:
            low, k = np.minimum(low[:-k], low[k:]), 2 * k
        if k < width:
            low = np.minimum(low[:-(width - k)], low[width - k:])
        pos = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(pos, prepend=-1))
        last = np.append(first[1:], len(pos)) - 1
        p = pos[first]
        yield h[p].view(np.int64), p + at, p - first, p - last


def refine(bucket, row, start, data, length):
    """(row, start) of the windows that equal an earlier one; windows come in document order.

    ``bucket``: initial bucket of each window; ``start``: where its bytes begin in ``data``.
    """
    word = _words(data)
    offsets = sorted({*range(0, length - 7, 8), length - 8}, key=lambda o: -abs(o - (length - 8) / 2))
    alive = np.arange(len(bucket))
    for turn, off in enumerate([None, *offsets]):
        b = bucket[alive]
        if off is None:
            order = np.argsort(b, kind="stable")
            new = np.diff(b[order], prepend=-1) != 0
        else:
            key = word[start[alive] + off]
            order = np.lexsort((key, b))
            new = (np.diff(b[order], prepend=-1) != 0) | np.append(True, key[order][1:] != key[order][:-1])
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        # stable sorts keep document order inside a bucket
        alive, bucket_of = alive[order][many], number[many]
        bucket[alive] = bucket_of
        if not len(alive):
            return np.zeros(0, np.int64)
    order = np.lexsort((alive, bucket[alive]))
    alive = alive[order]
    return np.sort(alive[np.append(False, bucket[alive][1:] == bucket[alive][:-1])])


def _ranges(row, begin, length):
    """Runs of consecutive window starts of a row as (row, from, to); sorted input."""
    cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(begin, prepend=-2) != 1))
    if not len(cut):
        return row[:0], begin[:0], begin[:0]
    return row[cut], begin[cut], begin[np.append(cut[1:], len(begin)) - 1] + length


def _refined(t: pa.Table, length: int):
    """Repeat ranges of whole buckets; rows are sorted by (h, d, x, pos)."""
    h, pos, lo, hi = (np.asarray(t.column(c)).astype(np.int64) for c in ("h", "pos", "lo", "hi"))
    spans = t.column("span").to_pylist()
    seen, fresh, again = {}, [], []
    for i, key in enumerate(zip(h.tolist(), lo.tolist(), spans)):
        (again if seen.setdefault(key, i) != i else fresh).append(i)
    fresh, again = np.array(fresh, np.int64), np.array(again, np.int64)
    number = np.cumsum(np.diff(h[fresh], prepend=h[fresh][0] - 1) != 0) - 1
    fresh = fresh[np.bincount(number)[number] > 1]
    parts = [(again, pos[again] - lo[again], pos[again] - hi[again] + length)]
    if len(fresh):
        number = np.cumsum(np.diff(h[fresh], prepend=h[fresh][0] - 1) != 0) - 1
        count = lo[fresh] - hi[fresh] + 1
        size = np.array([len(spans[i]) for i in fresh])
        data = b"".join([spans[i] for i in fresh])
        row = np.repeat(np.arange(len(fresh)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(size) - size, count) + step
        dup = refine(number[row] * 256 + (lo[fresh][row] - step), row, start, data, length)
        r = fresh[row[dup]]
        parts.append(_ranges(r, pos[r] - lo[r] + step[dup], length))
    rows, begin, end = (np.concatenate(c) for c in zip(*parts))
    return pa.RecordBatch.from_arrays(
        [t.column("d").combine_chunks().take(pa.array(rows)), t.column("x").combine_chunks().take(pa.array(rows)), pa.array(begin), pa.array(end)], ["d", "x", "s", "e"])


def _by_bucket(batches, length):
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < CHUNK_ROWS:
            continue
        t = pa.Table.from_batches(held)
        h = np.asarray(t.column("h"))
        cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
        if cut:
            yield _refined(t.slice(0, cut), length)
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        yield _refined(pa.Table.from_batches(held), length)


def _hot_ranges(spans: DataFrame, length: int):
    """(ranges, path of a table they read) in oversized buckets: equal spans collapse in an aggregate, then single windows do."""
    me = F.struct("d", "x", "pos")
    keyed = spans.withColumn("k", F.md5("span"))
    first = keyed.groupBy("h", "lo", "k").agg(F.min(me).alias("f"))
    both, path = _written(keyed.join(first, ["h", "lo", "k"]).withColumn("is_first", me == F.col("f")).drop("f", "k"))
    copies = both.where("not is_first").selectExpr("d", "x", "pos - lo as s", f"pos - hi + {length} as e")

    def windows(batches):
        for b in batches:
            out = [(d, x, p - lo + i, hashlib.md5(span[i:i + length]).digest())
                   for d, x, p, lo, hi, span in zip(*(b.column(c).to_pylist() for c in ("d", "x", "pos", "lo", "hi", "span")))
                   for i in range(lo - hi + 1)]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["d", "x", "s", "w"])

    each = both.where("is_first").mapInArrow(windows, "d long, x long, s long, w binary")
    start = F.struct("d", "x", "s")
    low = each.groupBy("w").agg(F.min(start).alias("f"))
    later = each.join(low, "w").where(start != F.col("f")).selectExpr("d", "x", "s", f"s + {length} as e")
    return copies.union(later), path


def _written(df: DataFrame):
    """``df`` as a Parquet table in the shared checkpoint folder, and its path."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def _drop(spark, path):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _release(spark):
    """Lets Spark's cleaner drop the shuffle files of finished steps, whose frames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame, length=100, doc_id="doc_id", text="text", hot_rows=HOT_ROWS, keep_text=False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` bytes if asked for).

    ``length`` is at least GRAM + 8 and at most 255. Texts are shuffled twice, by document, to
    meet their anchors and then their ranges; all else is narrow.
    """
    spark = docs.sparkSession
    body = f"coalesce(`{text}`, '')"
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.expr(f"coalesce(cast(`{doc_id}` as bigint), {-2 ** 63 + 1}L - 1L)").alias("d"),
                        F.expr(f"cast({body} as binary)").alias("t"))
    narrow = pin(keyed.select("d", F.xxhash64("t").alias("x"), F.expr("unhex(md5(t))").alias("m"), F.octet_length("t").alias("n")))
    unique = narrow.groupBy("d").count().where("count > 1").limit(1).count() == 0
    # the text's hash is part of the key, and rows are told apart, only where an id is used again
    keyed = keyed.withColumn("x", F.lit(0).cast("long") if unique else F.xxhash64("t"))
    if unique:
        narrow = narrow.withColumn("x", F.lit(0).cast("long"))
    whole = narrow.where(f"n >= {length}").distinct()
    first = whole.groupBy("m").agg(F.min(F.struct("d", "x")).alias("f"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = pin(whole.join(first, "m").where(F.struct("d", "x") != F.col("f")).select("d", "x"))

    def find(batches):
        for b in batches:
            out = [[], [], [], [], [], []]
            for d, x, t in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)):
                for h, p, lo, hi in anchors(t.as_py(), length):
                    for c, v in zip(out, (h, np.full(len(p), d), np.full(len(p), x), p, lo, hi)):
                        c.append(v)
            if out[0]:
                h, d, x, p, lo, hi = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(d), pa.array(x), pa.array(p.astype(np.int32)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16))],
                    ["h", "d", "x", "pos", "lo", "hi"])

    marks, path = _written(keyed.select("d", "x", "t").mapInArrow(find, "h long, d long, x long, pos int, lo short, hi short"))
    shared = marks.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    held = marks.join(shared, "h").groupBy("d", "x").agg(
        (F.collect_list if unique else F.collect_set)(F.struct("h", "pos", "lo", "hi", F.expr(f"c > {hot_rows}").alias("hot"))).alias("a"))
    held, held_path = _written(held)
    _drop(spark, path)
    del marks, shared
    _release(spark)
    # only now: before the grouping, the optimiser would pull this join below the one on the buckets
    held = held.join(later, ["d", "x"], "left_anti")
    any_hot = held.where("exists(a, v -> v.hot)").limit(1).count() > 0

    def fetch(batches):
        for b in batches:
            a = b.column("a")
            v, n = a.flatten(), np.asarray(a.value_lengths())
            pos, lo, hi = (np.asarray(v.field(c)).astype(np.int64) for c in ("pos", "lo", "hi"))
            owner = np.repeat(np.arange(b.num_rows), n)
            texts = [t.as_py() for t in b.column("t")]
            spans = [texts[i][s:e] for i, s, e in zip(owner.tolist(), (pos - lo).tolist(), (pos - hi + length).tolist())]
            for at in range(0, len(spans), 50_000):
                cut = slice(at, at + 50_000)
                who = pa.array(owner[cut])
                yield pa.RecordBatch.from_arrays(
                    [v.field("h")[cut], b.column("d").take(who), b.column("x").take(who), v.field("pos")[cut], v.field("lo")[cut],
                     v.field("hi")[cut], v.field("hot")[cut], pa.array(spans[cut], pa.binary())],
                    ["h", "d", "x", "pos", "lo", "hi", "hot", "span"])

    spans = keyed.select("d", "x", "t").where(f"octet_length(t) >= {length}").dropDuplicates(["d", "x"]) if not unique else \
        keyed.select("d", "x", "t")
    spans = spans.join(held, ["d", "x"]).select("d", "x", "t", "a").mapInArrow(
        fetch, "h long, d long, x long, pos int, lo short, hi short, hot boolean, span binary")
    written = [held_path]
    if any_hot:
        spans, path = _written(spans)
        written.append(path)
    cold = spans.where("not hot").drop("hot").repartition("h").sortWithinPartitions("h", "d", "x", "pos").mapInArrow(
        lambda batches: _by_bucket(batches, length), "d long, x long, s long, e long")
    found = cold
    if any_hot:
        hot, path = _hot_ranges(spans.where("hot").drop("hot"), length)
        found = cold.union(hot)
        written.append(path)
    verdict = pin(found.groupBy("d", "x").agg(F.collect_list(F.struct("s", "e")).alias("r"), F.lit(False).alias("all")).union(
        later.select("d", "x", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"), F.lit(True))))
    for path in written:
        _drop(spark, path)
    del spans, cold, found, held
    _release(spark)

    def cut(batches):
        for b in batches:
            rows = []
            for t, r, gone in zip(b.column("t"), b.column("r"), b.column("all").to_pylist()):
                t = t.as_py()
                n = len(t)
                if gone:
                    rows.append((n, n, 1, b""))
                    continue
                kept, at, spans_n, upto = [], 0, 0, -1
                for s, e in sorted((v["s"], v["e"]) for v in r.as_py() or ()):
                    if s > upto:
                        spans_n += 1
                    if s > at:
                        kept.append(t[at:s])
                    at = upto = max(at, e)
                rest = b"".join(kept) + t[at:] if spans_n else t
                rows.append((n, n - len(rest), spans_n, rest))
            cols = [b.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)),
                    pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())]
            if keep_text:
                cols.append(pa.array([r[3] for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    return keyed.join(verdict, ["d", "x"], "left").select("doc_id", "t", "r", "all").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
