"""Dependence-aware statistics over (dataset, method) gains."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.hashing import hash32
from pulsegrid.operators.quantiles import grouped_quantiles
from pulsegrid.session import pin

N_BOOT = 10_000
BOOT_SEED = 20260928


def group_gains(detail: DataFrame, value="delta_macro_f1_4") -> DataFrame:
    return detail.groupBy("dataset", "method").agg(F.avg(value).alias("gain"))


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    if x >= 1.0:
        return 1.0
    a, b = df / 2.0, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)))


def paired_t(gains: DataFrame, with_p=True) -> DataFrame:
    """One-sample t of the gains against zero, with Cohen dz (sample sd)."""
    s = gains.agg(F.count("gain").alias("n"), F.avg("gain").alias("mean"),
                  F.stddev_samp("gain").alias("_sd"))
    out = s.select(
        "n", "mean", (F.col("mean") / (F.col("_sd") / F.sqrt("n"))).alias("t"),
        (F.col("mean") / F.col("_sd")).alias("cohen_dz"),
    )
    if with_p:
        out = out.withColumn("p", t_p_value("t", (F.col("n") - 1).cast("double")))
    return out


Z975 = 1.959963984540054


def variance_components(gains: DataFrame, with_p=True) -> DataFrame:
    """Dataset fixed effects and method random intercept by restricted maximum likelihood.

    One mean in every cell has a closed form over marginal sums; any other layout (missing cells, several gains in one) goes through
    the likelihood of the variance ratio over cell sums. Rows without a gain do not count.
    """
    cells = pin(gains.where("gain is not null").groupBy("dataset", "method").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gain").alias("s"), F.sum(F.col("gain") * F.col("gain")).alias("ss")))
    layout = cells.agg(F.count(F.lit(1)).alias("cells"), F.max("n").alias("n"), F.count_distinct("dataset").alias("d"), F.count_distinct("method").alias("m")).first()
    if layout["cells"] == layout["d"] * layout["m"] and layout["n"] == 1:
        return _balanced_components(gains.where("gain is not null"), with_p)
    return _component_table(cells.groupBy().applyInPandas(_reml, _COMPONENTS), with_p)


_COMPONENTS = ("n_obs long, n_datasets long, n_methods long, mean_gain double, se_mean_gain double, reference_dataset_gain double, "
               "se_intercept double, method_var double, residual_var double")


def reml_terms(ratio, count, total, square, n):
    """(-2 log likelihood, coefficients, covariance / residual variance, residual variance) at a ratio of method to residual variance.

    ``count`` and ``total``: methods x datasets; ``square``: sum of squared gains of ``n`` rows.
    """
    weight = ratio / (1 + ratio * count.sum(1))
    sums = total.sum(1)
    inner = np.diag(count.sum(0)) - (count * weight[:, None]).T @ count
    cross = total.sum(0) - (count * weight[:, None]).T @ sums
    inverse = np.linalg.inv(inner)
    beta = inverse @ cross
    left = square - (weight * sums ** 2).sum() - cross @ beta
    free = n - count.shape[1]
    residual = max(left, 0.0) / free
    value = free * np.log(max(residual, 1e-300)) + np.log1p(ratio * count.sum(1)).sum() + np.linalg.slogdet(inner)[1]
    return value, beta, inverse, residual


def _reml(cells: pd.DataFrame) -> pd.DataFrame:
    """One row of estimates from cell sums: the ratio is bracketed on a logarithmic grid, then the bracket is cut in three until it is tight."""
    cells = cells.sort_values(["dataset", "method"])
    count = cells.pivot(index="method", columns="dataset", values="n").fillna(0).to_numpy(float)
    total = cells.pivot(index="method", columns="dataset", values="s").fillna(0).to_numpy(float)
    square, n = float(cells["ss"].sum()), int(cells["n"].sum())
    if n <= count.shape[1] or len(count) < 2:
        raise ValueError("variance components need two methods and more gains than datasets")

    def value(ratio):
        return reml_terms(ratio, count, total, square, n)[0]

    grid = np.concatenate([[0.0], np.logspace(-8, 8, 129)])
    at = int(np.argmin([value(r) for r in grid]))
    low, high = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
    for _ in range(200):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if value(a) <= value(b) else (a, high)
    ratio = (low + high) / 2
    ratio = 0.0 if value(0.0) <= value(ratio) else ratio
    _, beta, inverse, residual = reml_terms(ratio, count, total, square, n)
    even = np.full(len(beta), 1 / len(beta))
    return pd.DataFrame([{
        "n_obs": n, "n_datasets": count.shape[1], "n_methods": count.shape[0], "mean_gain": float(even @ beta),
        "se_mean_gain": math.sqrt(residual * float(even @ inverse @ even)), "reference_dataset_gain": float(beta[0]),
        "se_intercept": math.sqrt(residual * float(inverse[0, 0])), "method_var": ratio * residual, "residual_var": residual}])


def _component_table(estimates: DataFrame, with_p) -> DataFrame:
    """Estimates with the shares and intervals that follow from them."""
    tot = F.col("method_var") + F.col("residual_var")
    icc = F.when(tot != 0, F.col("method_var") / tot).otherwise(F.lit(float("nan")))
    cluster = F.col("n_obs") / F.col("n_methods")
    out = estimates.select(
        "*", tot.alias("total_var"), icc.alias("icc_method"), cluster.alias("mean_cluster_size"), (1 + (cluster - 1) * icc).alias("design_effect"))
    out = out.select(
        "*", (F.col("n_obs") / F.col("design_effect")).alias("effective_n"),
        (F.col("mean_gain") - F.lit(Z975) * F.col("se_mean_gain")).alias("mean_gain_ci_low"),
        (F.col("mean_gain") + F.lit(Z975) * F.col("se_mean_gain")).alias("mean_gain_ci_high"),
    )
    if with_p:
        out = out.withColumn("p_mean_gain", normal_p_value(F.col("mean_gain") / F.col("se_mean_gain")))
        out = out.withColumn("p_intercept", normal_p_value(F.col("reference_dataset_gain") / F.col("se_intercept")))
    return out


def _balanced_components(gains: DataFrame, with_p) -> DataFrame:
    """Closed form for one gain in every cell."""
    by_d = gains.groupBy("dataset").agg(F.avg("gain").alias("_md"), F.count("gain").alias("_nd"))
    by_m = gains.groupBy("method").agg(F.avg("gain").alias("_mm"))
    d = by_d.agg(
        F.count(F.lit(1)).alias("D"), F.avg("_md").alias("mean_gain"),
        F.sum(F.col("_md") * F.col("_md") * F.col("_nd")).alias("_sd2"),
        F.min_by("_md", "dataset").alias("reference_dataset_gain"),
    )
    m = by_m.agg(
        F.count(F.lit(1)).alias("M"), F.var_pop("_mm").alias("_vm"),
    )
    cells = gains.join(by_d.select("dataset", "_md"), "dataset").join(by_m.select("method", "_mm"), "method")
    grand = gains.agg(F.avg("gain").alias("_g"), F.count("gain").alias("n_obs"))
    # d, m, grand and the residual sum are single rows.
    resid = cells.crossJoin(F.broadcast(grand.select("_g"))).agg(
        F.sum(F.pow(F.col("gain") - F.col("_md") - F.col("_mm") + F.col("_g"), 2.0)).alias("_ssr"))
    one = d.crossJoin(m).crossJoin(grand).crossJoin(resid)
    D, M = F.col("D"), F.col("M")
    ssm = D * M * F.col("_vm")
    msm, msr = ssm / (M - 1), F.col("_ssr") / ((D - 1) * (M - 1))
    inner = msm >= msr
    one = one.withColumn("method_var", F.when(inner, (msm - msr) / D).otherwise(F.lit(0.0))).withColumn(
        "residual_var", F.when(inner, msr).otherwise((ssm + F.col("_ssr")) / (D * (M - 1))))
    tot = F.col("method_var") + F.col("residual_var")
    return _component_table(one.select(
        "n_obs", D.cast("long").alias("n_datasets"), M.alias("n_methods"), "mean_gain",
        F.sqrt((F.col("method_var") + F.col("residual_var") / D) / M).alias("se_mean_gain"),
        "reference_dataset_gain", F.sqrt(tot / M).alias("se_intercept"), "method_var", "residual_var"), with_p)


def cluster_bootstrap(gains: DataFrame, cluster: str, n_boot=N_BOOT, seed=BOOT_SEED) -> DataFrame:
    """Resample whole clusters with replacement; size-weighted mean, 95 % interval, share > 0.

    Each cluster enters as (sum, count), so a replicate is a ratio of two sums.
    """
    spark = gains.sparkSession
    stats = gains.groupBy(cluster).agg(F.sum("gain").alias("_s"), F.count("gain").alias("_c"))
    packed = stats.agg(F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("k"), "_s", "_c"))).alias("_a"))
    packed = packed.withColumn("_k", F.size("_a").cast("long"))
    # One row holding (sum, count) of every cluster; clusters are datasets or methods.
    reps = spark.range(n_boot).withColumnRenamed("id", "rep").crossJoin(F.broadcast(packed))

    def add(acc, j):
        c = F.get("_a", (hash32(seed, F.col("rep"), j) % F.col("_k")).cast("int"))
        return F.struct((acc["s"] + c["_s"]).alias("s"), (acc["c"] + c["_c"]).alias("c"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c"))
    means = reps.select(
        "rep", "_k",
        F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1), start, add, lambda a: a["s"] / a["c"]).alias("m"))
    tagged = means.withColumn("cluster", F.lit(cluster))
    q = grouped_quantiles(tagged, ["cluster"], "m", [0.025, 0.975], max_rows=10 ** 7)
    s = tagged.groupBy("cluster").agg(
        F.max("_k").alias("n_clusters"), F.avg("m").alias("boot_mean"),
        F.avg((F.col("m") > 0).cast("double")).alias("frac_positive"))
    return s.join(q, "cluster").select(
        "cluster", "n_clusters", "boot_mean", F.get("q", F.lit(0)).alias("ci_low"),
        F.get("q", F.lit(1)).alias("ci_high"), "frac_positive")


def hierarchical_table(gains: DataFrame, label: str, n_boot=N_BOOT) -> DataFrame:
    """Both bootstraps with the t test and the variance components alongside."""
    boot = cluster_bootstrap(gains, "dataset", n_boot).unionByName(
        cluster_bootstrap(gains, "method", n_boot))
    t = paired_t(gains).select(
        F.col("p").alias("naive_t_p"), F.col("cohen_dz").alias("naive_cohen_dz"), F.col("n").alias("n_means"))
    vc = variance_components(gains).select(
        "icc_method", "design_effect", "effective_n", F.col("mean_gain").alias("mixed_mean_gain"),
        F.col("se_mean_gain").alias("mixed_se"), F.col("p_mean_gain").alias("mixed_p"),
        F.col("mean_gain_ci_low").alias("mixed_ci_low"), F.col("mean_gain_ci_high").alias("mixed_ci_high"))
    return boot.withColumn("protocol", F.lit(label)).crossJoin(F.broadcast(t)).crossJoin(F.broadcast(vc))
