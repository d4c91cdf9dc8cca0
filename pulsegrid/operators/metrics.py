"""Confusion counts, metric rows, class counts, change accounting, recall diagnostics."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.schema import CLASS_NAMES, N_CLASSES

EPS = 1e-12


def cell(i, j):
    return f"c{i}{j}"


# The wide expressions below are SQL text: one parse instead of hundreds of Column calls.

def _total(names):
    return "(" + " + ".join(names) + ")"


ROW = [_total(cell(i, j) for j in range(N_CLASSES)) for i in range(N_CLASSES)]
COL = [_total(cell(i, j) for i in range(N_CLASSES)) for j in range(N_CLASSES)]
GRID = [(i, j) for i in range(N_CLASSES) for j in range(N_CLASSES)]


def confusion_counts(df: DataFrame, keys, y="y", pred="pred") -> DataFrame:
    """One row per key with 25 cell columns; zero cells are kept.

    Rows are first counted per (key, y, pred), which combines map-side, so a single hot
    key shuffles at most 25 rows per task.
    """
    small = df.groupBy(*keys, F.col(y).alias("_y"), F.col(pred).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return widen_counts(small, keys, "_y", "_p", "_n")


def widen_counts(counts: DataFrame, keys, y="y", pred="pred", n="n") -> DataFrame:
    cells = [
        F.expr(f"cast(coalesce(sum({n}) filter (where {y} = {i} and {pred} = {j}), 0) as bigint) as {cell(i, j)}")
        for i, j in GRID
    ]
    return counts.groupBy(*keys).agg(*cells)


def confusion_long(wide: DataFrame, keys) -> DataFrame:
    """25 rows (y, pred, n) per key."""
    cells = ", ".join(f"named_struct('y', {i}, 'pred', {j}, 'n', {cell(i, j)})" for i, j in GRID)
    return wide.select(*keys, F.expr(f"inline(array({cells}))"))


def metric_row(wide: DataFrame, keys, prefix="") -> DataFrame:
    """Accuracy, Se/Pr/F1 per class and the three macro means; absent classes count as ~0."""
    keys = list(keys)
    hits, n = _total(cell(c, c) for c in range(N_CLASSES)), _total(ROW)
    base = wide.selectExpr(
        *keys, f"{hits} / {n} as _acc",
        *[f"{cell(c, c)} / ({ROW[c]} + {EPS}D) as _se{c}" for c in range(N_CLASSES)],
        *[f"{cell(c, c)} / ({COL[c]} + {EPS}D) as _pr{c}" for c in range(N_CLASSES)],
        *[f"{ROW[c]} as {prefix}support_{x}" for c, x in enumerate(CLASS_NAMES)],
        *[f"{COL[c]} as {prefix}predicted_{x}" for c, x in enumerate(CLASS_NAMES)],
    ).selectExpr("*", *[
        f"2 * _se{c} * _pr{c} / (_se{c} + _pr{c} + {EPS}D) as _f{c}" for c in range(N_CLASSES)])
    named = [f"_acc as {prefix}accuracy"]
    for k, name in ((5, "macro_f1_5"), (4, "macro_f1_4"), (3, "macro_f1_3_nsv")):
        named.append(f"{_total(f'_f{c}' for c in range(k))} / {k} as {prefix}{name}")
    for m, src in (("Se", "_se"), ("Pr", "_pr"), ("F1", "_f")):
        named += [f"{src}{c} as {prefix}{m}_{x}" for c, x in enumerate(CLASS_NAMES)]
    named += [f"{prefix}{k}_{x}" for k in ("support", "predicted") for x in CLASS_NAMES]
    return base.selectExpr(*keys, *named)


def absent_share(prefix="") -> Column:
    """Share of rows predicted as one of classes 0-3 that has no true row at all."""
    wrong = _total(f"if({prefix}support_{c} = 0, {prefix}predicted_{c}, 0)" for c in CLASS_NAMES[:4])
    n = _total(f"{prefix}support_{c}" for c in CLASS_NAMES)
    return F.expr(f"{wrong} / greatest({n}, 1)")


def class_counts(df: DataFrame, keys, y="y") -> DataFrame:
    """count_N..count_Q per key, zero classes kept."""
    small = df.groupBy(*keys, F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    return small.groupBy(*keys).agg(*[
        F.expr(f"cast(coalesce(sum(_n) filter (where _y = {c}), 0) as bigint) as count_{x}")
        for c, x in enumerate(CLASS_NAMES)
    ])


def counts_map(prefix="count_") -> Column:
    return F.expr("map(" + ", ".join(f"'{c}', cast({prefix}{c} as int)" for c in CLASS_NAMES) + ")")


def counts_json(df: DataFrame, keys, y="y", name="counts") -> DataFrame:
    wide = class_counts(df, keys, y)
    body = ", ".join(f"'{c}', count_{c}" for c in CLASS_NAMES)
    return wide.select(*keys, F.expr(f"to_json(named_struct({body})) as {name}"))


def prior_ratio(prefix="count_") -> Column:
    """max(n0,1) / max(nc,1) for every class."""
    items = ", ".join(f"cast(greatest({prefix}N, 1) as double) / greatest({prefix}{c}, 1)" for c in CLASS_NAMES)
    return F.expr(f"array({items})")


def name_of(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CLASS_NAMES]), code + 1)


def change_counts(df: DataFrame, keys, before, after) -> DataFrame:
    """Number changed and `src->dst` counts as JSON, largest count first, then by name."""
    pairs = (
        df.groupBy(*keys, F.col(before).alias("_a"), F.col(after).alias("_b"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_pair", F.concat(name_of(F.col("_a")), F.lit("->"), name_of(F.col("_b"))))
    )
    moved = F.when(F.col("_a") != F.col("_b"), F.struct((-F.col("_n")).alias("k"), F.col("_pair").alias("p")))
    out = pairs.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_a") != F.col("_b"), F.col("_n"))), F.lit(0)).cast("long").alias("changed"),
        F.sort_array(F.collect_list(moved)).alias("_moves"),
    )
    items = F.transform("_moves", lambda m: F.concat(F.lit('"'), m["p"], F.lit('": '), (-m["k"]).cast("string")))
    return out.select(
        *keys, "changed", F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}")).alias("changed_pairs")
    )


def recall_diagnostics(conf: DataFrame, run_keys, group_keys, raw_stage, new_stage) -> DataFrame:
    """Mean recall before/after per group, class with the largest gain and hardest class.

    ``conf`` is (run_keys, stage, y, pred, n); only runs that have both stages count.
    """
    per = widen_counts(conf.where(F.col("stage").isin(raw_stage, new_stage)), [*run_keys, "stage"])
    rec = F.expr("array(" + ", ".join(
        f"{cell(c, c)} / greatest(cast({ROW[c]} as double), {EPS}D)" for c in range(N_CLASSES)) + ")")
    per = per.select(*run_keys, "stage", rec.alias("_se"))
    both = per.where(F.col("stage") == raw_stage).drop("stage").withColumnRenamed("_se", "_raw").join(
        per.where(F.col("stage") == new_stage).drop("stage").withColumnRenamed("_se", "_new"), run_keys
    )
    means = both.groupBy(*group_keys).agg(*[
        F.expr(f"avg({e}) as {stem}_Se_{n}_mean") for c, n in enumerate(CLASS_NAMES)
        for stem, e in (("raw", f"_raw[{c}]"), ("adapted", f"_new[{c}]"), ("delta", f"_new[{c}] - _raw[{c}]"))
    ])

    def extreme(stem, pick):
        values = F.array(*[F.col(f"{stem}_Se_{n}_mean") for n in CLASS_NAMES])
        at = F.array_position(values, pick(values)).cast("int")
        return F.element_at(F.array(*[F.lit(n) for n in CLASS_NAMES]), at), pick(values)

    gain_class, gain = extreme("delta", F.array_max)
    hard_class, hard = extreme("adapted", F.array_min)
    return means.select(
        "*", gain_class.alias("largest_recall_gain_class"), gain.alias("largest_recall_gain"),
        hard_class.alias("hardest_recall_class"), hard.alias("hardest_recall"),
    )


def confusion_shares(conf: DataFrame, keys) -> DataFrame:
    """Cell sums with row total and row share (0 for an empty row)."""
    small = conf.groupBy(*keys, "y", "pred").agg(F.sum("n").cast("long").alias("n"))
    w = Window.partitionBy(*keys, "y")
    total = F.sum("n").over(w)
    return small.select(
        *keys, "y", "pred", "n", total.alias("row_total"),
        F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)).alias("row_share"),
    )


def minority_to_normal(shares: DataFrame, keys) -> DataFrame:
    """Rate of S and F rows predicted as N."""
    return (
        shares.where(F.col("y").isin(1, 3) & (F.col("pred") == 0))
        .groupBy(*keys, "y")
        .agg((F.sum("n") / F.max("row_total")).alias("error_rate"))
    )
