"""Class prototypes, prototype evidence, and train-part normalisation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.schema import F_, N, N_CLASSES, S, V

EPS = 1e-8


def class_means(fit: DataFrame, keys=(), leads=("b0", "b1"), y="y") -> DataFrame:
    """(keys, lead, cls, proto): mean vector per class; an empty class takes the overall mean.

    Partial sums per (class, position) leave each task as classes x positions rows, so the
    shuffle does not grow with the data.
    """
    keys = list(keys)
    long = fit.select(
        *keys, F.col(y).cast("int").alias("cls"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("lead"), F.col(b).cast("array<double>").alias("v"))
                            for i, b in enumerate(leads)])).alias("_l"),
    ).select(*keys, "cls", "_l.lead", F.posexplode("_l.v").alias("pos", "x"))
    sums = long.groupBy(*keys, "cls", "lead", "pos").agg(
        F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    per_pos = sums.groupBy(*keys, "lead", "pos").agg(
        F.map_from_entries(F.collect_list(F.struct("cls", F.col("s") / F.col("n")))).alias("_m"),
        (F.sum("s") / F.sum("n")).alias("_all"),
    )
    vectors = per_pos.groupBy(*keys, "lead").agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "_m", "_all")),
            lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0),
        ).alias("_e")
    )
    return vectors.select(
        *keys, "lead", F.explode(F.sequence(F.lit(0), F.lit(N_CLASSES - 1))).alias("cls"), "_e"
    ).select(
        *keys, "lead", "cls",
        F.transform("_e", lambda e: F.coalesce(F.element_at(e["_m"], F.col("cls")), e["_all"])).alias("proto"),
    )


def packed_prototypes(protos: DataFrame, keys=()) -> DataFrame:
    """One row per key: five class vectors per lead (``p0``, ``p1``) and their squared norms."""
    def lead(i):
        rows = F.sort_array(F.collect_list(F.when(F.col("lead") == i, F.struct("cls", "proto"))))
        return F.transform(rows, lambda r: r["proto"])
    packed = protos.groupBy(*keys).agg(lead(0).alias("p0"), lead(1).alias("p1"))
    return packed.select("*", *[F.transform(f"p{i}", lambda p: A.dot(p, p)).alias(f"q{i}") for i in (0, 1)])


def _lead(b: Column, protos: Column, squares: Column) -> Column:
    """Struct of cosines ``c`` and mean squared distances ``d`` to the five class vectors."""

    def of(k):
        return F.struct(
            F.zip_with(k["dots"], squares, lambda d, s: d / ((F.sqrt(k["sq"]) + F.lit(EPS)) * (F.sqrt(s) + F.lit(EPS)))).alias("c"),
            F.zip_with(k["dots"], squares, lambda d, s: F.greatest(k["sq"] + s - 2.0 * d, F.lit(0.0)) / k["n"]).alias("d"))

    return A.let(F.struct(
        A.dot(b, b).alias("sq"), F.transform(protos, lambda p: A.dot(b, p)).alias("dots"), F.size(b).alias("n")), of)


def prototype_features(beats: DataFrame, packed: DataFrame, keys=(), name="proto_x") -> DataFrame:
    """Add 32 values: cosines, log1p distances and 12 margins over both leads.

    ``packed`` has one row per key (run keys, or a single row without keys) of fixed size,
    so it is broadcast and the beats are neither shuffled nor multiplied.
    """
    side = F.broadcast(packed)
    out = beats.join(side, list(keys)) if keys else beats.crossJoin(side)
    for i in (0, 1):
        out = out.withColumn(f"_m{i}", _lead(F.col(f"b{i}").cast("array<double>"), F.col(f"p{i}"), F.col(f"q{i}")))
    margins = []
    for i in (0, 1):
        c = F.col(f"_m{i}.c")
        margins += [c[S] - c[N], c[F_] - c[N], c[F_] - c[V]]
    for i in (0, 1):
        d = F.col(f"_m{i}.d")
        margins += [d[N] - d[S], d[N] - d[F_], d[V] - d[F_]]
    full = F.concat(
        F.col("_m0.c"), F.col("_m1.c"),
        F.transform("_m0.d", lambda v: F.log1p(v)), F.transform("_m1.d", lambda v: F.log1p(v)), F.array(*margins))
    return out.withColumn(name, full).drop("p0", "p1", "q0", "q1", "_m0", "_m1")


def evidence_features(assigned: DataFrame, keys=(), base="x", name="x_ev") -> DataFrame:
    """Prototypes from rows with role ``fit`` only, applied to the rows of every role."""
    packed = packed_prototypes(class_means(assigned.where(F.col("role") == "fit"), keys), keys)
    rows = prototype_features(assigned, packed, keys)
    full = F.concat(F.col(base), F.col("proto_x")) if base else F.col("proto_x")
    return rows.withColumn(name, full).drop("proto_x")


def feature_set(df: DataFrame, kind: str, evidence="x_ev", name="features") -> DataFrame:
    """Evidence vector alone, with the lead summary, or after the raw two-lead window."""
    b0, b1 = (F.col(b).cast("array<double>") for b in ("b0", "b1"))
    choices = {
        "clinical_proto": lambda: F.col(evidence),
        "clinical_proto_lead": lambda: F.concat(F.col(evidence), A.lead_summary(b0, b1)),
        "raw_clinical_proto": lambda: F.concat(A.flat_leads(b0, b1), F.col(evidence)),
    }
    if kind not in choices:
        raise ValueError(f"unknown feature set {kind!r}")
    return df.withColumn(name, choices[kind]())


def _standard(x, m, sd):
    return F.transform(x, lambda v: (v - m) / sd)


def normalise_from_fit(assigned: DataFrame, leads=("b0", "b1"), keys=(), eps=1e-6) -> DataFrame:
    """(x - mean) / (std + eps) per lead, mean and std over rows and time of the fit part."""
    aggs = []
    for b in leads:
        v = F.col(b).cast("array<double>")
        aggs += [F.sum(A.total(v)).alias(f"_s_{b}"), F.sum(A.dot(v, v)).alias(f"_q_{b}"),
                 F.sum(F.size(b)).alias(f"_n_{b}")]
    stats = assigned.where(F.col("role") == "fit").groupBy(*keys).agg(*aggs)
    for b in leads:
        m = F.col(f"_s_{b}") / F.col(f"_n_{b}")
        stats = stats.withColumn(f"_m_{b}", m).withColumn(
            f"_sd_{b}", F.sqrt(F.greatest(F.col(f"_q_{b}") / F.col(f"_n_{b}") - m * m, F.lit(0.0))) + F.lit(eps))
    stats = stats.select(*keys, *[c for b in leads for c in (f"_m_{b}", f"_sd_{b}")])
    side = F.broadcast(stats)
    out = assigned.join(side, list(keys)) if keys else assigned.crossJoin(side)
    for b in leads:
        m, sd = F.col(f"_m_{b}"), F.col(f"_sd_{b}")
        out = out.withColumn(b, _standard(F.col(b).cast("array<double>"), m, sd))
    return out.select(*assigned.columns)
