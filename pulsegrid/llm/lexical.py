"""Ranked lexical search, reversed: the items' terms are indexed, the documents stream through the index.

The items are the small side. Their inverted index (term -> items that hold it) is broadcast; every task
streams its documents through it, turns the counts of the indexed terms of one document into scores of all
items that share a term with it, and keeps a heap of the k best documents per item. The heaps of all tasks,
at most k rows an item and task, are merged by one ranked window per item. Two passes read the documents:
one for the corpus statistics (documents, terms, document frequencies of indexed terms), one for the scores.

Terms are the maximal runs of ASCII letters, ASCII digits and characters from U+0080 on, only A-Z lowered. With N documents that
hold a term, L terms in all, n terms of a document, df documents with a term and tf its occurrences in one:
w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 10 + 90 n N div L, and an item's score of a document is the sum
of w * (1000000000 tf div (1000 tf + 8 m)) over the item's distinct terms, in 64-bit integers.

Bounds: the items are dealt into blocks until the index of none exceeds BLOCK_BYTES; every block is a pass
of its own. An item of more than WIDE_TERMS distinct terms, or of an index beyond the bound, is not broadcast: its terms meet
those of the documents in a shuffled join on the term, with the same result.

Defined results: null and empty texts have no term; items without a term, and documents that share no term
of positive weight, give no row. Rows that repeat an item id are one item with the terms of all of them, a null id too.
Rows that repeat a document id are documents each; equal scores go to the smaller id, null ids last.
No documents or no items give no rows. Extra columns are ignored.
"""

import heapq
import math
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import pin

#: Bytes of the terms and postings of a broadcast block, distinct terms of a broadcast item, bytes cut into terms at once.
BLOCK_BYTES, WIDE_TERMS, PIECE = 16 << 20, 100_000, 4 << 20
#: Bytes of a term that are not part of terms become blanks, A-Z small letters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _pieces(data: bytes):
    """Lists of the terms of one text, a few megabytes of text at a time."""
    data, at = data.translate(_FOLD), 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield (data if at == 0 and end >= len(data) else data[at:end]).split()
        at = end


def _texts(column):
    """Bytes of every text of an Arrow column, null as empty."""
    return (v or b"" for v in column.cast(pa.binary()).to_pylist())


def _counted(batches):
    """(keys..., n, term, tf) for every distinct term of each row; the text is the last column."""
    for b in batches:
        rows, terms, tfs, ns = [], [], [], []
        for i, data in enumerate(_texts(b.column(b.num_columns - 1))):
            counts, n = {}, 0
            for tokens in _pieces(data):
                n += len(tokens)
                for t in tokens:
                    counts[t] = counts.get(t, 0) + 1
            rows += [i] * len(counts)
            terms += counts.keys()
            tfs += counts.values()
            ns += [n] * len(counts)
        at = pa.array(rows, pa.int64())
        keys = [c.take(at) for c in b.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(ns, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.int64())],
                                         [*b.schema.names[:-1], "n", "term", "tf"])


def term_rows(rows: DataFrame, text: str) -> DataFrame:
    """The other columns of ``rows`` with n, term and tf of every distinct term of ``text``."""
    keys = [c for c in rows.columns if c != text]
    fields = [rows.schema[c] for c in keys] + [T.StructField(c, t) for c, t in (("n", T.LongType()), ("term", T.BinaryType()), ("tf", T.LongType()))]
    return rows.select(*keys, text).mapInArrow(_counted, T.StructType(fields))


def weights(df, n_docs: int):
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _blocks(sizes: DataFrame) -> int:
    """The fewest blocks, doubling, whose largest index stays within the bound; no item is larger than it."""
    blocks = 1
    while True:
        largest = sizes.groupBy(F.expr(f"pmod(xxhash64(item), {blocks})")).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0]
        if (largest or 0) <= BLOCK_BYTES:
            return blocks
        blocks *= 2


class _Index:
    """Terms of some items: number of a term, and the items of every term."""

    def __init__(self, rows):
        self.items = list(dict.fromkeys(r[0] for r in rows))
        of_item = {item: i for i, item in enumerate(self.items)}
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(bytes(r[1]) for r in rows))}
        term = np.array([self.terms[bytes(r[1])] for r in rows], np.int64)
        item = np.array([of_item[r[0]] for r in rows], np.int64)
        order = np.argsort(term, kind="stable")
        self.postings = item[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.weight = None

    def counts(self, data):
        """(terms of the text, indexed terms in it, their occurrences)."""
        n, found = 0, []
        for tokens in _pieces(data):
            n += len(tokens)
            found.append(np.fromiter(map(self.terms.get, tokens, repeat(-1)), np.int64, len(tokens)))
        if not n:
            return 0, np.empty(0, np.int64), np.empty(0, np.int64)
        found = found[0] if len(found) == 1 else np.concatenate(found)
        terms, tf = np.unique(found[found >= 0], return_counts=True)
        return n, terms, tf.astype(np.int64)


def _statistics(texts: DataFrame, shared) -> tuple:
    """(documents with a term, terms in all, documents of every indexed term)."""

    def run(batches):
        index = shared.value
        df, docs, total = np.zeros(len(index.terms), np.int64), 0, 0
        for b in batches:
            for data in _texts(b.column(0)):
                n, terms, _ = index.counts(data)
                df[terms] += 1
                docs += n > 0
                total += n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[docs, total, df[at]])], ["term", "n"])

    df = np.zeros(len(shared.value.terms), np.int64)
    docs = total = 0
    # one row a term of the block at most
    for term, n in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        if term == -2:
            docs = n
        elif term == -1:
            total = n
        else:
            df[term] = n
    return docs, total, df


def _heaps(documents: DataFrame, index, n_docs, n_terms, k) -> DataFrame:
    """(item number, doc_id, score): at most k rows an item and task. Scores stay below 2^53 for items of WIDE_TERMS terms."""
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        sizes, heaps = np.diff(index.start), [[] for _ in index.items]
        floor = np.ones(len(index.items))
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                n, terms, tf = index.counts(data)
                if not len(terms):
                    continue
                m = 10 + 90 * n * n_docs // n_terms
                part = index.weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                width = sizes[terms]
                ends = np.cumsum(width)
                at = np.arange(ends[-1]) + np.repeat(index.start[terms] - (ends - width), width)
                scores = np.bincount(index.postings[at], np.repeat(part, width).astype(np.float64), len(floor))
                order = -(1 << 64) if doc is None else -doc
                for i in np.flatnonzero(scores >= floor).tolist():
                    entry, heap = (int(scores[i]), order), heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        floor[i] = heap[0][0]
        rows = [(i, None if o == -(1 << 64) else -o, s) for i, heap in enumerate(heaps) for s, o in heap]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return documents.mapInArrow(run, "item long, doc_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _wide(documents: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of items too wide to broadcast. Rows equal in id and text are told apart by their number."""
    rows = term_rows(documents.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"), "text"), "text")
    per_doc = term_rows(documents.select("text"), "text").agg(F.sum("tf").alias("total"))
    n_docs = documents.select("text").mapInArrow(_has_term, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"))
    n_terms, n_docs = per_doc.first()[0], n_docs.first()[0]
    if not n_terms:
        return None
    met = rows.join(wide.select("term").distinct(), "term")
    met = met.groupBy("doc_id", "h", "n", "term", "tf").agg(F.count(F.lit(1)).alias("copies"))
    weight = met.groupBy("term").agg(F.sum("copies").alias("df")).select(
        "term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w"))
    part = F.expr(f"w * ((1000000000 * tf) div (1000 * tf + 8 * (10 + (90 * n * {n_docs}) div {n_terms})))")
    scored = (met.join(weight, "term").join(wide, "term").groupBy("item", "doc_id", "h")
              .agg(F.sum(part).alias("score"), F.max("copies").alias("copies")).where("score > 0"))
    each = scored.withColumn("_", F.explode(F.expr(f"sequence(1, least(copies, {k}))")))
    return _top(each.select("item", "doc_id", "score"), k)


def _has_term(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(any(_pieces(data)) for data in _texts(b.column(0)))], pa.int64())], ["n"])


def search(documents: DataFrame, items: DataFrame, k=10, doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))
    kind = asked.schema["item"].dataType
    terms = pin(term_rows(asked, "text").select("item", "term").distinct())
    sizes = pin(terms.groupBy("item").agg(F.count(F.lit(1)).alias("width"), F.sum(F.octet_length("term") + F.lit(64)).alias("bytes")))
    too_wide = (F.col("width") > WIDE_TERMS) | (F.col("bytes") > BLOCK_BYTES)
    wide = sizes.where(too_wide).select(F.col("item").alias("_wide"))
    found = []
    if wide.limit(1).count():
        hit = F.col("item").eqNullSafe(F.col("_wide"))
        rest = _wide(docs, terms.join(wide, hit, "left_semi"), k)
        found += [] if rest is None else [rest.select("item", "rank", "doc_id", "score")]
        terms = terms.join(wide, hit, "left_anti")
    blocks = _blocks(sizes.where(~too_wide))
    for block in range(blocks):
        rows = terms.where(F.expr(f"pmod(xxhash64(item), {blocks}) = {block}")).collect()  # within BLOCK_BYTES
        if not rows:
            continue
        index = _Index(rows)
        n_docs, n_terms, df = _statistics(docs.select("text"), spark.sparkContext.broadcast(index))
        if not n_docs:
            break
        index.weight = weights(df, n_docs)
        names = spark.createDataFrame(list(enumerate(index.items)), T.StructType([T.StructField("_i", T.LongType()), T.StructField("_item", kind)]))
        top = _top(_heaps(docs, index, n_docs, n_terms, k), k)
        found.append(top.join(F.broadcast(names), F.col("item") == F.col("_i")).select(F.col("_item").alias("item"), "rank", "doc_id", "score"))
    if not found:
        shape = T.StructType([T.StructField("item", kind)])
        found = [spark.createDataFrame([], shape).selectExpr("item", "cast(0 as int) as rank", "0L as doc_id", "0L as score")]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("item", "item_id")
