"""Temperature mixing of sources, realised as budgeted block permutations.

Token shares of the sources are raised to an exponent and normalised; the exponent is bisected
until the mix meets a target entropy or a repetition limit. A source's quota is its weight times
the budget. It is realised by whole epochs over the source plus one partial epoch: documents lie
in blocks by a hash, blocks and the documents inside them are permuted anew for every epoch, and
the partial epoch takes the longest prefix of that order whose tokens fit the rest of the quota.

Only totals per (source, block) are shuffled. Where a prefix ends is found in three steps: the
slice of the permutation (at most 2 ** SLICE_BITS for a source), the block in the slice, and the
document in the block, so no window grows with a source. One row per source then decides for
every document by comparing draws, so texts never move.

Defined results: a null source is a source of its own. Null and empty texts count no tokens;
they come along with whole epochs, and with a partial epoch where they precede its end. A source
without tokens gets weight 0 and no rows. Repeated rows count as often as they occur; rows equal
in id, tokens and checksum are taken or left together at the end of a prefix. An empty table
gives an empty mix. Extra columns are kept; columns of the mix replace columns of the same name.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import pin, small_side

#: Exponents are multiples of 1 / GRID; each pass of the bisection looks at WAYS of them at once.
GRID, WAYS = 1 << 20, 32
#: Documents of a block, on average.
BLOCK_ROWS = 512
#: Bits of a draw, and of it those that number the slices of a permutation.
DRAW_BITS, SLICE_BITS = 60, 12
WORDS = r"[^ \\t-\\r]+"
MIX = ["_s", "tokens", "epoch", "block", "block_rank", "draw"]


def _draw(*parts) -> str:
    """SQL of a 60-bit hash of the parts: 15 hex digits of md5, the same in every engine."""
    text = ", ".join(parts)
    return f"cast(conv(substring(md5(concat_ws('|', {text})), 1, 15), 16, 10) as bigint)"


def token_ledger(docs: DataFrame, source="source", text="text", doc_id="doc_id", seed=0) -> DataFrame:
    """Adds ``_s`` (source as a key that is never null), ``tokens`` and the hash ``_u`` of the row."""
    body = f"coalesce(`{text}`, '')"
    return docs.withColumns({
        "_s": F.expr(f"if(`{source}` is null, 'null', concat('=', `{source}`))"),
        "tokens": F.expr(f"regexp_count({body}, '{WORDS}') + 0L"),
        "_u": F.expr(_draw(f"'{seed}'", f"coalesce(cast(`{doc_id}` as string), 'null')", f"cast(crc32({body}) as string)")),
    })


def source_shares(led: DataFrame) -> DataFrame:
    """Documents, tokens and token share of each source."""
    per = led.groupBy("_s").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("source_tokens"))
    total = per.agg(F.sum("source_tokens").alias("total"))
    return per.join(F.broadcast(total), F.lit(True)).withColumn("share", F.expr("source_tokens / greatest(total, 1)"))


def exponent(shares: DataFrame, target_entropy=None, max_repeat=None, budget_factor=1.0) -> int:
    """The exponent in units of 1 / GRID.

    ``target_entropy`` (a part of the entropy of equal weights): the largest exponent, at most
    1, that still has it. ``max_repeat``: the smallest exponent at which no source is repeated
    more often. With both, the repetition limit wins.
    """
    live = shares.where("source_tokens > 0")

    def meets(low, step):
        """Which of low + step * (1 .. WAYS) qualify; a sum over sources for each of them."""
        grid = live.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(WAYS)))).withColumn(
            "a", F.expr(f"({low}L + {step}L * k) / {GRID}D"))
        agg = grid.groupBy("k").agg(
            F.expr("sum(power(share, a))").alias("z"), F.expr("sum(power(share, a) * ln(share) * a)").alias("m"),
            F.expr("max(power(share, a) / share)").alias("r"), F.count(F.lit(1)).alias("n"))
        return {r["k"]: (r["m"], r["z"], r["r"], r["n"]) for r in agg.collect()}

    def search(good):
        """Largest multiple for which ``good`` holds; it holds up to some exponent and not after."""
        low, step = 0, GRID
        while step > 1:
            step //= WAYS
            got = meets(low, step)
            low += step * max([k for k, v in got.items() if good(*v)], default=0)
        return low

    from math import log

    k = 0
    if target_entropy is not None:
        k = search(lambda m, z, r, n: log(z) - m / z >= target_entropy * log(n) if n > 1 else True)
    if max_repeat is not None:
        fits = search(lambda m, z, r, n: budget_factor * r / z > max_repeat)
        first = meets(fits, 0)[1] if shares.limit(1).count() and live.limit(1).count() else None
        if first is not None and budget_factor * first[2] / first[1] > max_repeat:
            fits += 1
        k = max(k, fits)
    return min(k, GRID)


def source_quotas(shares: DataFrame, k: int, budget_factor=1.0, block_rows=BLOCK_ROWS) -> DataFrame:
    """Weight, quota, whole epochs, rest of the quota and number of blocks of each source."""
    powered = shares.where("source_tokens > 0").withColumn("p", F.expr(f"power(share, {k}L / {GRID}D)"))
    z = powered.agg(F.sum("p").alias("z"))
    return powered.join(F.broadcast(z), F.lit(True)).withColumn("weight", F.expr("p / z")).withColumn(
        "quota", F.expr(f"cast(round(weight * total * {float(budget_factor)}D) as bigint)")).selectExpr(
        "_s", "docs", "source_tokens", "share", "weight", "quota", "quota div source_tokens as epochs",
        "quota % source_tokens as rest", f"(docs + {block_rows - 1}) div {block_rows} as n_blocks")


def _crossing(rows: DataFrame, keys, order) -> DataFrame:
    """The row of each key whose running sum of ``t`` first exceeds ``rest``; ``left`` is what remains before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("left", F.col("rest") + F.col("t") - F.sum("t").over(w)).where("left >= 0 and left < t")


def mix(docs: DataFrame, target_entropy=None, max_repeat=None, budget_factor=1.0, source="source",
        text="text", doc_id="doc_id", seed=0, block_rows=BLOCK_ROWS) -> DataFrame:
    """The documents as often as the mix takes them, with epoch and place in the permutation.

    ``epoch`` counts from 0; ``block_rank`` is the place of the block in the permutation of that
    epoch and ``draw`` orders the documents inside it. ``budget_factor`` times all tokens is the
    budget.
    """
    led = token_ledger(docs.drop(*[c for c in MIX if c in docs.columns and c not in (source, text, doc_id)]),
                       source, text, doc_id, seed)
    narrow = pin(led.select("_s", "tokens", "_u"))
    shares = pin(source_shares(narrow))  # a row a source, read by every step of the search
    quotas = pin(source_quotas(shares, exponent(shares, target_entropy, max_repeat, budget_factor), budget_factor, block_rows))
    sources = small_side(quotas.selectExpr("_s", "n_blocks as _blocks", "epochs as _epochs", "rest as _rest"))
    row = _draw(f"'{seed}'", "'row'", "cast(_epochs as string)", "cast(_u as string)")

    def blocked(rows):
        return rows.join(sources, "_s").withColumn("block", F.expr("_u % _blocks")).withColumn(
            "_bd", F.expr(_draw(f"'{seed}'", "cast(_epochs as string)", "_s", "cast(block as string)")))

    # one row per block of block_rows documents; the permutation of the partial epoch is cut into slices
    blocks = pin(blocked(narrow).groupBy("_s", "block", "_bd", F.col("_rest").alias("rest")).agg(F.sum("tokens").alias("t"))
                 .withColumn("slice", F.expr(f"shiftright(_bd, {DRAW_BITS - SLICE_BITS})")))
    slices = _crossing(blocks.groupBy("_s", "slice", "rest").agg(F.sum("t").alias("t")), ["_s"], ["slice"])
    inside = blocks.drop("rest").join(slices.selectExpr("_s", "slice", "left as rest"), ["_s", "slice"])
    edges = pin(_crossing(inside, ["_s"], ["_bd", "block"]).selectExpr("_s", "_bd as edge_bd", "block as edge", "left"))
    last = narrow.join(small_side(edges.join(quotas.selectExpr("_s", "n_blocks as _blocks", "epochs as _epochs"), "_s")), "_s").where("_u % _blocks = edge")
    # rows equal in all that orders them share a running sum, so the cut never falls between them
    last = last.withColumn("d", F.expr(row)).groupBy("_s", "left", "d", "_u").agg(F.sum("tokens").alias("t"))
    within = Window.partitionBy("_s").orderBy("d", "_u").rowsBetween(Window.unboundedPreceding, 0)
    cut = last.withColumn("upto", F.sum("t").over(within)).where("upto <= left").groupBy("_s").agg(F.max(F.struct("d", "_u")).alias("cut"))
    ends = small_side(pin(edges.join(cut, "_s", "left").selectExpr("_s", "edge_bd as _edge_bd", "edge as _edge", "cut as _cut")))
    dealt = blocked(led).join(ends, "_s", "left").withColumn("_d", F.expr(row))
    extra = ("if(named_struct('d', _bd, 'b', block) < named_struct('d', _edge_bd, 'b', _edge) "
             "or (block = _edge and coalesce(named_struct('d', _d, '_u', _u) <= _cut, false)), 1, 0)")
    out = dealt.withColumn("_n", F.expr(f"cast(_epochs + {extra} as int)")).where("_n > 0")
    out = out.withColumn("epoch", F.explode(F.expr("sequence(0, _n - 1)")))
    return out.withColumns({
        "block_rank": F.expr(_draw(f"'{seed}'", "cast(epoch as string)", "_s", "cast(block as string)")),
        "draw": F.expr(_draw(f"'{seed}'", "'row'", "cast(epoch as string)", "cast(_u as string)")),
    }).drop("_s", "_u", "_d", "_n", "_bd", "_edge_bd", "_edge", "_cut", "_blocks", "_epochs", "_rest")
