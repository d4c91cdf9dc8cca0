"""Queries over embeddings: windows, features, probabilities, grids, calibration, rebalancing."""

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.catalog.events import metrics_sql
from pulsegrid.catalog.roles import (
    BEATS,
    CHUNK,
    PROBS,
    SIGNAL_ANN,
    SIGNALS,
    beats,
    exploded,
    hash_sql,
    probs,
    role_of,
    rounded,
    rounded_sql,
    signal_annotations,
    signals,
    softmax_sql,
    table,
)
from pulsegrid.functions import arrays as A
from pulsegrid.functions import probability as P
from pulsegrid.functions import waveform
from pulsegrid.operators import calibration as C
from pulsegrid.operators import (
    intervals,
    metrics,
    prototypes,
    rebalance,
    signal,
    summary,
    windows_join,
)
from pulsegrid.plans import decoders, models, selection
from pulsegrid.session import pin
from pulsegrid.sources import recordings

SEED = 303
RUN = ["dataset", "family", "method", "seed"]
FOUR = {"view": 0, "click": 1, "purchase": 2, "error": 3}


# ---- signals and windows -------------------------------------------------------------------

def _records(spark, sf):
    return table(spark, sf, "embeddings").agg(F.countDistinct(F.floor(F.col("vec_id") / 100)).alias("n")).first()["n"]


def _bounds(spark, sf):
    ann = signal_annotations(spark, sf, _records(spark, sf))
    return windows_join.window_bounds(ann, windows_join.record_lengths(signals(spark, sf)))


BOUNDS = f"""{SIGNALS}, {SIGNAL_ANN},
len_ as (select record, max(start_idx + len(vals)) as length from signals group by record),
wb as (select s.*, sample - 8 as lo, sample + 13 as hi, sample - 8 >= 0 and sample + 13 <= length as inside from sann s join len_ using (record))"""
SAMPLES = f"""{BOUNDS}, full_ as (select record, lead, flatten(list(vals order by chunk)) as whole from signals group by all),
cut as (select beat_id, wb.record, symbol, lead, whole[lo + 1: hi] as samples from wb join full_ using (record) where inside),
win as (select a.beat_id, a.record, a.symbol, a.samples as b0, coalesce(b.samples, a.samples) as b1 from cut a left join cut b on a.beat_id = b.beat_id and b.lead = 1 where a.lead = 0)"""


@query("interval_join_windows", rounded_sql(f"""with {SAMPLES}
select beat_id, len(b0) as n, list_sum(b0) as s0, b0[1] as first0, b0[-1] as last0, list_sum(b1) as s1, b1[9] as at1 from win""",
    "s0 first0 last0 s1 at1"))
def interval_join_windows(spark, sf):
    sig = signals(spark, sf)
    win = windows_join.beat_windows(signal_annotations(spark, sf, _records(spark, sf)), sig, CHUNK)
    return rounded(win.select(
        "beat_id", F.size("b0").cast("long").alias("n"), A.total(F.col("b0")).alias("s0"), F.col("b0")[0].alias("first0"),
        F.element_at("b0", -1).alias("last0"), A.total(F.col("b1")).alias("s1"), F.col("b1")[8].alias("at1")))


@query("skip_counts", f"""with {BOUNDS} select record, count(*) filter (where not (symbol <> 'signup' and inside)) as skipped,
  count(*) filter (where inside and symbol = 'view') as count_N, count(*) filter (where inside and symbol = 'click') as count_S,
  count(*) filter (where inside and symbol = 'purchase') as count_V, count(*) filter (where inside and symbol = 'error') as count_F, 0 as count_Q from wb group by record""")
def skip_counts(spark, sf):
    return recordings.skipped(_bounds(spark, sf), "record", FOUR)


@query("record_zscore", rounded_sql(f"""with {SIGNALS}, u as (select record, lead, unnest(vals) as v from signals),
st as (select record, lead, avg(v) as m, stddev_pop(v) as sd from u group by all)
select s.record, s.lead, s.chunk, (vals[1] - m) / (sd + 1e-8::double) as first, (vals[-1] - m) / (sd + 1e-8::double) as last,
  list_sum(list_transform(vals, lambda x: abs((x - m) / (sd + 1e-8::double)))) as mass from signals s join st using (record, lead)""", "first last mass"))
def record_zscore(spark, sf):
    z = windows_join.record_zscore(signals(spark, sf))
    return rounded(z.select("record", "lead", "chunk", F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"),
                            A.total(F.transform("values", F.abs)).alias("mass")))


@query("two_leads", rounded_sql(f"""with {SIGNALS} select a.record, a.chunk, a.start_idx, list_sum(a.vals) as s0, list_sum(coalesce(b.vals, a.vals)) as s1
 from signals a left join signals b on a.record = b.record and a.chunk = b.chunk and b.lead = 1 where a.lead = 0""", "s0 s1"))
def two_leads(spark, sf):
    rows = recordings.two_leads(signals(spark, sf))
    return rounded(rows.select("record", "chunk", "start_idx", A.total(F.col("v0")).alias("s0"), A.total(F.col("v1")).alias("s1")))


@query("bandpass")
def bandpass(spark, sf):
    out = signal.bandpass(signals(spark, sf))
    return rounded(out.select("record", "lead", "chunk", A.mean_square(F.col("values")).alias("power"),
                              F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last")))


@query("beat_features")
def beat_features(spark, sf):
    """Recordings to the assembled base row: band-pass, z-score, intervals, windows, descriptors."""
    n = _records(spark, sf)
    sig = windows_join.record_zscore(signal.bandpass(signals(spark, sf)))
    ann = signal_annotations(spark, sf, n)
    rr = intervals.interval_array(intervals.interval_features(intervals.interval_context(ann, 32.0)))
    mapped = recordings.map_symbols(rr, FOUR)
    win = windows_join.beat_windows(mapped, sig, CHUNK, points=234)
    feats = waveform.base_features(win)
    return rounded(feats.select("beat_id", "record", "y", F.size("x").alias("width"), A.mean(F.col("x")).alias("mean_x"),
                                F.col("x")[12].alias("peak0"), F.col("x")[38].alias("peak1")), 4)


# ---- array functions -----------------------------------------------------------------------

@query("resample_diff", rounded_sql(f"""with {BEATS}, r as (select beat_id, list_transform(range(20), lambda k: b0[least(floor(k * 31 / 19.0::double)::int, 31) + 1] +
   (b0[least(floor(k * 31 / 19.0::double)::int + 1, 31) + 1] - b0[least(floor(k * 31 / 19.0::double)::int, 31) + 1]) * (k * 31 / 19.0::double - floor(k * 31 / 19.0::double))) as v from beats)
select beat_id, (unnest(range(19)))::int as pos, unnest(list_transform(range(1, 20), lambda i: v[i + 1] - v[i])) as value from r""", "value"))
def resample_diff(spark, sf):
    b = beats(spark, sf)
    return rounded(exploded(b.withColumn("v", A.diff(A.resample(F.col("b0"), 20))), ["beat_id"], "v"))


def _shape_sql(b, c=12, q=(-6, 8), s=(4, 14)):
    qs, ss = f"{b}[{c + q[0] + 1}:{c + q[1]}]", f"{b}[{c + s[0] + 1}:{c + s[1]}]"
    dx = f"list_transform(range(1, len({b})), lambda i: {b}[i + 1] - {b}[i])"
    def ms(x): return f"list_avg(list_transform({x}, lambda v: v * v))"
    def ma(x): return f"list_transform({x}, lambda v: abs(v))"
    def share(l): return f"list_avg(list_transform({ma(qs)}, lambda v: case when v > {l}::double * (list_max({ma(qs)}) + 1e-8::double) then 1.0::double else 0.0::double end))"
    le, re = ms(f"{b}[1:{c}]"), ms(f"{b}[{c + 1}:]")
    ch = f"list_avg(list_transform(range(1, len({b})), lambda i: case when ({b}[i] < 0) <> ({b}[i + 1] < 0) then 1.0::double else 0.0::double end))"
    items = [f"list_max({b})", f"list_min({b})", f"list_max({b}) - list_min({b})", f"list_position({b}, list_max({b})) - 1 - {c}",
             f"list_position({b}, list_min({b})) - 1 - {c}", f"list_avg({b})", f"list_stddev_pop({b})", f"list_avg({ma(b)})", f"list_avg({qs})", f"list_stddev_pop({qs})",
             ms(qs), ms(b), le, re, f"{le} / ({re} + 1e-8::double)", f"list_max({dx})", f"list_min({dx})", f"list_max({dx}) - list_min({dx})", ms(dx), ch,
             share(0.3), share(0.5), f"list_avg({ss})", f"list_stddev_pop({ss})", f"list_sum({qs})", f"list_sum({ma(qs)})"]
    return items


@query("shape_descriptors", rounded_sql(
    f"with {BEATS} select beat_id, " + ", ".join(f"({e})::double as {n}" for e, n in zip(_shape_sql("b0"), waveform.DESCRIPTORS)) + " from beats",
    " ".join(waveform.DESCRIPTORS)))
def shape_descriptors(spark, sf):
    b = beats(spark, sf).withColumn("m", waveform.shape_descriptors(F.col("b0"), 12, (-6, 8), (4, 14)))
    return rounded(b.select("beat_id", *[F.col("m")[i].alias(n) for i, n in enumerate(waveform.DESCRIPTORS)]))


SEVEN = ["mean", "std", "mean_abs", "hi", "lo", "span", "slope"]


def _seven_sql(e, tag):
    d = f"list_transform(range(1, 32), lambda i: {e}[i + 1] - {e}[i])"
    return (f"list_avg({e}) as {tag}_mean, list_stddev_pop({e}) as {tag}_std, list_avg(list_transform({e}, lambda v: abs(v))) as {tag}_mean_abs, list_max({e}) as {tag}_hi, "
            f"list_min({e}) as {tag}_lo, list_max({e}) - list_min({e}) as {tag}_span, list_avg(list_transform({d}, lambda v: v * v)) as {tag}_slope")


@query("lead_summary", rounded_sql(
    f"with {BEATS}, l as (select beat_id, list_transform(range(1, 33), lambda i: b0[i] - b1[i]) as dif, list_transform(range(1, 33), lambda i: b0[i] + b1[i]) as tot from beats) "
    f"select beat_id, {_seven_sql('dif', 'minus')}, {_seven_sql('tot', 'plus')} from l", " ".join(f"{t}_{s}" for t in ("minus", "plus") for s in SEVEN)))
def lead_summary(spark, sf):
    b = beats(spark, sf).withColumn("m", A.lead_summary(F.col("b0"), F.col("b1")))
    names = [f"{t}_{s}" for t in ("minus", "plus") for s in SEVEN]
    return rounded(b.select("beat_id", *[F.col("m")[i].alias(n) for i, n in enumerate(names)]))


@query("stacked_leads", f"""with {BEATS} select beat_id, 64 as flat, 2 as dual, 1 as single, b1[1] > b0[32] as ordered from beats""")
def stacked_leads(spark, sf):
    b = beats(spark, sf)
    flat = A.flat_leads(F.col("b0"), F.col("b1"))
    return b.select("beat_id", F.size(flat).alias("flat"), F.size(A.stack_leads(F.col("b0"), F.col("b1"))).alias("dual"),
                    F.size(A.stack_leads(F.col("b0"), F.col("b1"), "single")).alias("single"), (flat[32] > flat[31]).alias("ordered"))


@query("trend_seasonal", rounded_sql("""with e as (select vec_id, embedding::double[] as x from embeddings),
p as (select vec_id, x, list_concat(list_resize([]::double[], 12, x[1]), x, list_resize([]::double[], 12, x[64])) as pad from e),
t as (select vec_id, x, list_transform(range(1, 65), lambda i: list_sum(pad[i: i + 24]) / 25) as trend, list_transform(range(32), lambda i: (x[2 * i + 1] + x[2 * i + 2]) / 2) as half from p)
select vec_id, unnest(range(64))::int as pos, unnest(trend) as trend, unnest(list_transform(range(1, 65), lambda i: x[i] - trend[i])) as seasonal, unnest(list_resize(half, 64, null)) as pooled from t""",
    "trend seasonal pooled"))
def trend_seasonal(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    e = e.withColumn("t", A.moving_average(F.col("x"), 25)).withColumn("half", A.average_pool(F.col("x"), 2))
    # the pooled series is half as long: null beyond its end
    rows = e.select("vec_id", F.posexplode(F.arrays_zip(F.col("t"), F.col("x"), F.col("half"))).alias("pos", "z"))
    return rounded(rows.select("vec_id", "pos", F.col("z.t").alias("trend"), (F.col("z.x") - F.col("z.t")).alias("seasonal"), F.col("z.half").alias("pooled")))


@query("patches", rounded_sql("""with e as (select vec_id, embedding::double[] as x from embeddings),
p as (select vec_id, unnest(range(7))::int as patch, unnest(list_transform(range(7), lambda s: x[s * 8 + 1: s * 8 + 16])) as w from e)
select vec_id, patch, len(w)::int as width, list_sum(w) as total, w[1] as first from p""", "total first"))
def patches(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(A.patches(F.col("embedding").cast("array<double>"), 16, 8)).alias("patch", "w"))
    return rounded(e.select("vec_id", "patch", F.size("w").alias("width"), A.total(F.col("w")).alias("total"), F.col("w")[0].alias("first")))


@query("instance_norm", rounded_sql("""with e as (select vec_id, embedding::double[] as x from embeddings)
select vec_id, unnest(range(64))::int as pos, unnest(list_transform(x, lambda v: (v - list_avg(x)) / (list_stddev_samp(x) + 1e-5::double))) as value from e""", "value"))
def instance_norm(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", A.instance_norm(F.col("embedding").cast("array<double>")))
    return rounded(exploded(e, ["vec_id"], "v"))


@query("dominant_periods", rounded_sql("""with e as (select vec_id, embedding::double[] as x from embeddings), f as (select unnest(range(1, 33)) as freq),
a as (select freq, sqrt(pow(list_sum(list_transform(range(64), lambda t: x[t + 1] * cos(2 * pi() * freq * t / 64))), 2) + pow(list_sum(list_transform(range(64), lambda t: x[t + 1] * sin(2 * pi() * freq * t / 64))), 2)) as amp from e, f)
select freq, avg(amp) as amplitude, greatest(2, round_even(64.0::double / freq, 0))::bigint as period from a group by freq order by amplitude desc, freq limit 3""", "amplitude"))
def dominant_periods(spark, sf):
    return rounded(signal.dominant_periods(table(spark, sf, "embeddings").withColumnRenamed("embedding", "series"), 64))


# ---- prototypes ----------------------------------------------------------------------------

def assigned_beats(spark, sf):
    return beats(spark, sf).withColumn("role", role_of(F.lit(SEED), F.col("beat_id")))


ROLE = f"asg as (select *, case when h < 50 then 'fit' when h < 75 then 'val' else 'test' end as role from (select *, {hash_sql(str(SEED), repr('role'), 'beat_id')} % 100 as h from beats))"
PROTO = """fl as (select y, 0 as lead, unnest(range(32)) as pos, unnest(b0) as x from asg where role = 'fit' union all select y, 1, unnest(range(32)), unnest(b1) from asg where role = 'fit'),
pm as (select lead, pos, y, avg(x) as m from fl group by all), pa as (select lead, pos, avg(x) as m from fl group by all),
pr as (select a.lead, c.cls, a.pos, coalesce(p.m, a.m) as v from pa a cross join (select unnest(range(5)) as cls) c left join pm p on p.lead = a.lead and p.pos = a.pos and p.y = c.cls),
pv as (select lead, cls, list(v order by pos) as proto from pr group by all)"""


@query("prototypes", rounded_sql(f"with {BEATS}, {ROLE}, {PROTO} select lead::int as lead, cls::int as cls, pos::int as pos, v as value from pr", "value"))
def class_prototypes(spark, sf):
    fit = assigned_beats(spark, sf).where("role = 'fit'")
    return rounded(exploded(prototypes.class_means(fit), ["lead", "cls"], "proto"))


@query("prototype_features", rounded_sql(f"""with {BEATS}, {ROLE}, {PROTO},
s as (select a.beat_id, a.role, p.lead, p.cls, list_dot_product(b, proto) as d, list_dot_product(b, b) as bb, list_dot_product(proto, proto) as pp from (
   select beat_id, role, 0 as lead, b0 as b from asg union all select beat_id, role, 1, b1 from asg) a join pv p on p.lead = a.lead),
m as (select beat_id, role, lead, cls, d / ((sqrt(bb) + 1e-8::double) * (sqrt(pp) + 1e-8::double)) as c, greatest(bb + pp - 2 * d, 0) / 32 as q from s),
w as (select beat_id, role, list(c order by lead, cls) as c, list(q order by lead, cls) as q from m group by all),
x as (select beat_id, role, list_concat(c, list_transform(q, lambda v: ln(1 + v)), [c[2]-c[1], c[4]-c[1], c[4]-c[3], c[7]-c[6], c[9]-c[6], c[9]-c[8],
  q[1]-q[2], q[1]-q[4], q[3]-q[4], q[6]-q[7], q[6]-q[9], q[8]-q[9]]) as v from w)
select beat_id, role, unnest(range(32))::int as pos, unnest(v) as value from x""", "value"))
def prototype_features(spark, sf):
    rows = prototypes.evidence_features(assigned_beats(spark, sf), base=None)
    return rounded(exploded(rows, ["beat_id", "role"], "x_ev"))


@query("feature_sets", f"""with {BEATS} select kind, count(*) as n, case kind when 'clinical_proto' then 32 when 'clinical_proto_lead' then 46 else 96 end as width
 from beats cross join (values ('clinical_proto'), ('clinical_proto_lead'), ('raw_clinical_proto')) k(kind) group by kind""")
def feature_sets(spark, sf):
    rows = prototypes.evidence_features(assigned_beats(spark, sf), base=None)
    parts = [prototypes.feature_set(rows, k).select(F.lit(k).alias("kind"), F.size("features").alias("width"))
             for k in ("clinical_proto", "clinical_proto_lead", "raw_clinical_proto")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("kind", "width").agg(F.count(F.lit(1)).alias("n"))


@query("normalise_from_fit", rounded_sql(f"""with {BEATS}, {ROLE}, st as (select avg(u) as m, stddev_pop(u) as sd from (select unnest(b0) as u from asg where role = 'fit')),
s1 as (select avg(u) as m, stddev_pop(u) as sd from (select unnest(b1) as u from asg where role = 'fit'))
select beat_id, role, (b0[1] - st.m) / (st.sd + 1e-6::double) as first0, (b1[32] - s1.m) / (s1.sd + 1e-6::double) as last1 from asg, st, s1""", "first0 last1"))
def normalise_from_fit(spark, sf):
    z = prototypes.normalise_from_fit(assigned_beats(spark, sf))
    return rounded(z.select("beat_id", "role", F.col("b0")[0].alias("first0"), F.element_at("b1", -1).alias("last1")))


# ---- probability rows ----------------------------------------------------------------------

def norm_sql(p):
    c = f"list_transform({p}, lambda x: greatest(x, 1e-12::double))"
    return f"list_transform({c}, lambda x: x / greatest(list_sum({c}), 1e-12::double))"


def argmax_sql(p):
    return f"(list_position({p}, list_max({p})) - 1)::int"


@query("prob_normalise", rounded_sql(f"""with v as (select vec_id, list_transform(embedding[1:5]::double[], lambda x: greatest(x, 0.0::double)) as r from embeddings)
select vec_id, unnest(range(5))::int as pos, unnest({norm_sql("case when list_sum(r) <= 0 then [0.2,0.2,0.2,0.2,0.2]::double[] else r end")}) as value from v""", "value"))
def prob_normalise(spark, sf):
    """Non-negative scores as a class map with absent classes, aligned to full rows."""
    e = table(spark, sf, "embeddings")
    vals = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 5), lambda x: F.greatest(x, F.lit(0.0)))
    present = F.map_filter(F.map_from_arrays(F.sequence(F.lit(0), F.lit(4)), vals), lambda k, v: v > 0)
    return rounded(exploded(e.withColumn("p", P.align(present)), ["vec_id"], "p"))


@query("score_softmax", rounded_sql(f"""with v as (select vec_id, embedding[1:4]::double[] || [-1e6::double] as s, embedding[6]::double as b from embeddings),
t as (select vec_id, {softmax_sql('s')} as p, [-b, b, -1e6::double, -1e6::double, -1e6::double] as bs, vec_id % 5 as y from v)
select vec_id, unnest(range(5))::int as pos, unnest(p) as value, unnest({softmax_sql('bs')}) as two_class, unnest(list_transform(range(5), lambda c: case when c = y then 1.0::double else 1e-6::double end / (1 + 4e-6::double))) as hard from t""",
    "value two_class hard"))
def score_softmax(spark, sf):
    """Four-class scores, one two-class score and hard labels as five-class rows."""
    e = table(spark, sf, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    four = F.map_from_arrays(F.sequence(F.lit(0), F.lit(3)), F.slice("x", 1, 4))
    two = P.binary_scores(F.col("x")[5], 0, 1)
    rows = e.select("vec_id", P.align_scores(four).alias("a"), P.align_scores(two).alias("b"), P.near_one_hot(F.col("vec_id") % 5).alias("c"))
    out = rows.select("vec_id", F.posexplode(F.arrays_zip("a", "b", "c")).alias("pos", "z"))
    return rounded(out.select("vec_id", "pos", F.col("z.a").alias("value"), F.col("z.b").alias("two_class"), F.col("z.c").alias("hard")))


def power_sql(p, w):
    raised = f"list_transform({norm_sql(p)}, lambda x: pow(x, {w}))"
    return norm_sql(raised)


MULT = "[0.9, 2.0, 1.0, 3.0, 1.0]"


@query("power_decode", rounded_sql(f"""with {PROBS}, d as (select dataset, method, seed, beat_id, {power_sql('p_evidence', '0.9::double')} as q from probs),
s as (select *, list_transform(range(1, 6), lambda i: q[i] * ({MULT}::double[])[i]) as sc from d)
select dataset, method, seed, beat_id, {argmax_sql('sc')} as pred, list_max(q) as top from s""", "top"))
def power_decode(spark, sf):
    m = F.array(*[F.lit(x) for x in (0.9, 2.0, 1.0, 3.0, 1.0)])
    p = probs(spark, sf)
    q = P.power_calibrate(F.col("p_evidence"), 0.9)
    return rounded(p.select("dataset", "method", "seed", "beat_id", P.decode(F.col("p_evidence"), 0.9, m).alias("pred"), F.array_max(q).alias("top")))


def log_sql(p):
    return f"list_transform({p}, lambda x: ln(least(greatest(x, 1e-8::double), 1.0::double)))"


def fuse_sql(a, lb="lb", le="le"):
    s = f"list_transform(range(1, 6), lambda i: (1 - {a}) * {lb}[i] + {a} * {le}[i])"
    return s


LOGS = f"lg as (select *, {log_sql('p_backbone')} as lb, {log_sql('p_evidence')} as le from probs)"


@query("fuse_adapter", rounded_sql(f"""with {PROBS}, {LOGS}, s as (select *, {fuse_sql('0.35::double')} as sc from lg), f as (select *, {softmax_sql('sc')} as p from s)
select method, seed, beat_id, p[1] as p0, p[4] as p3, {argmax_sql('p')} as pred from f""", "p0 p3"))
def fuse_adapter(spark, sf):
    p = probs(spark, sf).withColumn("p", P.fuse(F.col("p_backbone"), F.col("p_evidence"), 0.35))
    return rounded(p.select("method", "seed", "beat_id", F.col("p")[0].alias("p0"), F.col("p")[3].alias("p3"), A.argmax(F.col("p")).alias("pred")))


CNT = f"cnt as (select dataset, seed, {', '.join(f'count(*) filter (where y = {c}) as n{c}' for c in range(5))} from probs where role = 'fit' and method = 'logistic_raw' group by all)"
TOTN = "(n0 + n1 + n2 + n3 + n4 + 5)"
BIAS = f"bias as (select *, [{', '.join(f'ln(0.2::double / ((n{c} + 1) / {TOTN}::double))' for c in range(5))}] as raw_bias from cnt)"


@query("boundary_fuse", rounded_sql(f"""with {PROBS}, {LOGS}, {CNT}, {BIAS}, s as (select lg.*, list_transform(range(1, 6), lambda i: 0.5::double * lb[i] + 0.5::double * le[i] + 0.75::double * (raw_bias[i] - list_avg(raw_bias))) as sc
  from lg join bias using (dataset, seed)), t as (select *, 0.2::double * exp(-(list_sort(sc, 'desc')[1] - list_sort(sc, 'desc')[2]) / 0.1::double) as w from s),
b as (select *, list_transform(range(1, 6), lambda i: sc[i] + w * (le[i] - list_avg(le))) as z from t)
select method, seed, beat_id, {argmax_sql('z')} as pred, list_max(z) as top from b""", "top"))
def boundary_fuse(spark, sf):
    p = probs(spark, sf)
    fit = p.where("role = 'fit' and method = 'logistic_raw'")
    bias = metrics.class_counts(fit, ["dataset", "seed"]).select("dataset", "seed", decoders.prior_bias(0.75).alias("bias"))
    rows = p.join(F.broadcast(bias), ["dataset", "seed"]).withColumn(
        "z", P.boundary_scores(P.safe_log(F.col("p_backbone")), P.safe_log(F.col("p_evidence")), F.col("bias"), 0.5, 0.1, 0.2))
    return rounded(rows.select("method", "seed", "beat_id", A.argmax(F.col("z")).alias("pred"), F.array_max("z").alias("top")))


# ---- decoders and weights ------------------------------------------------------------------

RATIO = "rt as (select dataset, seed, n0, n1, n2, n3, n4, greatest(n0, 1)::double / greatest(n1, 1) as r1, greatest(n0, 1)::double / greatest(n2, 1) as r2, greatest(n0, 1)::double / greatest(n3, 1) as r3, greatest(n0, 1)::double / greatest(n4, 1) as r4 from cnt)"


def cap_sql(r, e, lo, hi):
    return f"least(greatest(pow({r}, {e}::double), {lo}::double), {hi}::double)"


def _decoder_rows():
    out = []
    for i, (name, (power, spec)) in enumerate(decoders.DECODERS.items()):
        vals = [f"{lo}::double" if e is None else cap_sql(f"r{c}", e, lo, hi) for c, (e, lo, hi) in enumerate(spec)]
        out.append(f"select dataset, seed, '{name}' as decoder, {i} as ord, {power}::double as power, [{', '.join(vals)}, 1.0::double] as mult from rt")
    return " union all ".join(out)


DEC = f"dec as ({_decoder_rows()})"


@query("decoder_table", rounded_sql(f"with {PROBS}, {CNT}, {RATIO}, {DEC} select dataset, seed, decoder, ord, power, mult[1] as m0, mult[2] as m1, mult[3] as m2, mult[4] as m3, mult[5] as m4 from dec", "m0 m1 m2 m3 m4"))
def decoder_table(spark, sf):
    fit = probs(spark, sf).where("role = 'fit' and method = 'logistic_raw'")
    t = decoders.decoder_table(fit, ["dataset", "seed"])
    return rounded(t.select("dataset", "seed", "decoder", "ord", "power", *[F.col("multiplier")[i].alias(f"m{i}") for i in range(5)]))


def _weights_sql():
    out = []
    for mode, w in decoders.CONSTANT_WEIGHTS.items():
        out.append((mode, [f"{x}::double" for x in w]))
    for mode, (first, rest) in decoders.RATIO_WEIGHTS.items():
        out.append((mode, [f"{first}::double", *[f"least(pow(r{c + 1}, {e}::double), {cap}::double)" for c, (e, cap) in enumerate(rest)], "1.0::double"]))
    n = "(n0+n1+n2+n3+n4)"
    k = "(" + " + ".join(f"(n{c} > 0)::int" for c in range(5)) + ")"
    out.append(("balanced", [f"case when n{c} > 0 then {n}::double / ({k} * n{c}) else 1.0::double end" for c in range(5)]))
    top = "greatest(n0, n1, n2, n3, n4, 1)"
    out.append(("balanced_sqrt", [f"least(greatest(sqrt({top}::double / greatest(n{c}, 1)), 0.5::double), 10.0::double)" for c in range(5)]))
    out.append(("balanced_log", [f"least(greatest(ln(1 + {top}::double / greatest(n{c}, 1)), 0.5::double), 8.0::double)" for c in range(5)]))
    return " union all ".join(
        f"select dataset, seed, '{m}' as mode, {', '.join(f'{x} as w{i}' for i, x in enumerate(v))} from rt" for m, v in out)


@query("class_weights", rounded_sql(f"with {PROBS}, {CNT}, {RATIO} {_weights_sql()}", "w0 w1 w2 w3 w4"))
def class_weights(spark, sf):
    fit = probs(spark, sf).where("role = 'fit' and method = 'logistic_raw'")
    counts = metrics.class_counts(fit, ["dataset", "seed"])
    items = F.array(*[F.struct(F.lit(m).alias("mode"), decoders.class_weights(m).alias("w")) for m in decoders.WEIGHT_MODES])
    rows = counts.select("dataset", "seed", F.explode(items).alias("i"))
    return rounded(rows.select("dataset", "seed", "i.mode", *[F.col("i.w")[c].alias(f"w{c}") for c in range(5)]))


@query("weighted_rows", rounded_sql(f"with {PROBS}, {CNT}, {RATIO}, w as (select dataset, seed, [1.0::double, least(pow(r1, 0.22::double), 4.0::double), least(pow(r2, 0.08::double), 1.8::double), least(pow(r3, 0.28::double), 12.0::double), 1.0::double] as w from rt) "
    "select p.dataset, p.seed, beat_id, w[y + 1] as weight from probs p join w using (dataset, seed) where role = 'fit' and method = 'logistic_raw'", "weight"))
def weighted_rows(spark, sf):
    fit = probs(spark, sf).where("role = 'fit' and method = 'logistic_raw'")
    return rounded(decoders.weighted_rows(fit, "smooth_cost", ["dataset", "seed"]).select("dataset", "seed", "beat_id", "weight"))


@query("decision_multipliers", rounded_sql(f"""with {PROBS}, {CNT}, {RATIO} select dataset, seed, 'none' as mode, 1.0::double as m0, 1.0::double as m1, 1.0::double as m2, 1.0::double as m3 from rt
 union all select dataset, seed, 'stable_prior', 1.0, least(pow(r1, 0.25::double), 4), least(pow(r2, 0.03::double), 1.5), least(pow(r3, 0.20::double), 4) from rt
 union all select dataset, seed, 'mild_prior', 1.0, least(pow(r1, 0.20::double), 3), least(pow(r2, 0.02::double), 1.3), least(pow(r3, 0.15::double), 3) from rt
 union all select dataset, seed, 'tail_prior', 0.95, least(pow(r1, 0.28::double), 4.5), least(pow(r2, 0.05::double), 1.7), least(pow(r3, 0.25::double), 5) from rt""", "m0 m1 m2 m3"))
def decision_multipliers(spark, sf):
    fit = probs(spark, sf).where("role = 'fit' and method = 'logistic_raw'")
    counts = metrics.class_counts(fit, ["dataset", "seed"])
    items = F.array(*[F.struct(F.lit(m).alias("mode"), decoders.decision_multiplier(metrics.prior_ratio(), m).alias("w")) for m in decoders.MULTIPLIER_MODES])
    rows = counts.select("dataset", "seed", F.explode(items).alias("i"))
    return rounded(rows.select("dataset", "seed", "i.mode", *[F.col("i.w")[c].alias(f"m{c}") for c in range(4)]))


# ---- grids ---------------------------------------------------------------------------------

def _policies(spark, sf, keys):
    fit = probs(spark, sf).where("role = 'fit'")
    return decoders.packed_decoders(fit, keys)


def grid_cells(keys, src, pred="pred"):
    cells = ", ".join(f"count(*) filter (where y = {i} and {pred} = {j}) as c{i}{j}" for i in range(5) for j in range(5))
    return f"select {keys}, {cells} from {src} group by {keys}"


ABSENT = "(" + " + ".join(f"case when support_{c} = 0 then predicted_{c} else 0 end" for c in "NSVF") + ")::double / greatest(support_N + support_S + support_V + support_F + support_Q, 1)"
ADAPTER = f"""{PROBS}, {LOGS}, {CNT}, {RATIO}, {DEC}, al as (select unnest([0.2,0.35,0.5,0.65,0.8])::double as alpha, unnest(range(5)) as ai),
fs as (select dataset, family, method, seed, beat_id, y, al.alpha, ai, {fuse_sql('al.alpha')} as sc from lg, al where role = 'val'),
fp as (select *, {softmax_sql('sc')} as p from fs),
dp as (select fp.dataset, family, method, fp.seed, y, fp.alpha, decoder, power, mult, ai * 6 + ord as cand, list_transform(range(1, 6), lambda i: pow(p[i], power) * mult[i]) as z from fp join dec on dec.dataset = fp.dataset and dec.seed = fp.seed),
pp as (select *, {argmax_sql('z')} as pred from dp),
{metrics_sql('dataset, family, method, seed, cand, alpha, decoder, power', grid_cells('dataset, family, method, seed, cand, alpha, decoder, power', 'pp'))},
gr as (select *, {ABSENT} as penalty, macro_f1_4 - 0.25 * ({ABSENT}) as key1, F1_S + F1_F as key2 from mrow)"""


@query("adapter_grid", rounded_sql(f"with {ADAPTER} select dataset, family, method, seed, cand::int as cand, alpha, decoder, macro_f1_4, accuracy, F1_S, F1_F, penalty, key1 from gr",
    "macro_f1_4 accuracy F1_S F1_F penalty key1"))
def adapter_grid(spark, sf):
    g = selection.adapter_grid(probs(spark, sf).where("role = 'val'"), _policies(spark, sf, RUN), RUN)
    return rounded(g.select(*RUN, "cand", "alpha", "decoder", "macro_f1_4", "accuracy", "F1_S", "F1_F", "penalty", "key1"))


@query("selected_adapter", rounded_sql(f"""with {ADAPTER}, b as (select *, row_number() over (partition by dataset, family, method, seed order by round(key1, 10) desc, round(key2, 10) desc, round(accuracy, 10) desc, cand) as r from gr)
select dataset, family, method, seed, alpha, case when dataset = 'MIT-BIH' then 'clinical_default' else decoder end as decoder, macro_f1_4, accuracy from b where r = 1""", "macro_f1_4 accuracy"))
def selected_adapter(spark, sf):
    pol = _policies(spark, sf, RUN)
    g = selection.adapter_grid(probs(spark, sf).where("role = 'val'"), pol, RUN)
    best = selection.select_adapter(g, pol, RUN)
    return rounded(best.select(*RUN, "alpha", "decoder", "macro_f1_4", "accuracy"))


@query("topk_candidates", rounded_sql(f"""with {ADAPTER}, b as (select *, row_number() over (partition by dataset, family, method, seed order by round(key1, 10) desc, round(key2, 10) desc, round(accuracy, 10) desc, cand) as r from gr)
select dataset, family, method, seed, (r - 1)::int as pos, alpha, decoder, power, macro_f1_4 as val_macro_f1_4 from b where r <= 8""", "val_macro_f1_4"))
def topk_candidates(spark, sf):
    g = selection.adapter_grid(probs(spark, sf).where("role = 'val'"), _policies(spark, sf, RUN), RUN)
    top = selection.top_candidates(g, RUN)
    rows = top.select(*RUN, F.posexplode("candidates").alias("pos", "c"))
    return rounded(rows.select(*RUN, "pos", "c.alpha", "c.decoder", "c.power", "c.val_macro_f1_4"))


RK = ["dataset", "method", "seed"]
RISK = f"""{PROBS}, {CNT}, {RATIO}, {DEC}, vd as (select p.dataset, p.method, p.seed, y, decoder, ord as cand, list_transform(range(1, 6), lambda i: pow(p_backbone[i], power) * mult[i]) as z
  from probs p join dec on dec.dataset = p.dataset and dec.seed = p.seed where role = 'val'), pp as (select *, {argmax_sql('z')} as pred from vd),
{metrics_sql('dataset, method, seed, cand, decoder', grid_cells('dataset, method, seed, cand, decoder', 'pp'))},
gr as (select *, macro_f1_4 - 0.25 * ({ABSENT}) as key1, F1_S + F1_F as key2 from mrow),
rb as (select *, row_number() over (partition by dataset, method, seed order by round(key1, 10) desc, round(key2, 10) desc, round(accuracy, 10) desc, cand) as r from gr),
j as (select b.dataset, b.method, b.seed, b.decoder as candidate, b.macro_f1_4 - a.macro_f1_4 as gain_macro_f1_4, a.accuracy - b.accuracy as accuracy_drop, a.F1_S - b.F1_S as F1_S_drop,
  b.support_F as val_F_count, b.F1_F - a.F1_F as F1_F_gain from rb b join rb a on a.dataset = b.dataset and a.method = b.method and a.seed = b.seed and a.decoder = 'evidence_argmax' where b.r = 1),
jj as (select *, candidate <> 'evidence_argmax' and (gain_macro_f1_4 < 0.015 or accuracy_drop > 0.004 or F1_S_drop > 0.08 or (F1_F_gain > 0 and val_F_count < 10)) as rejected from j)"""


@query("risk_guard", rounded_sql(f"""with {RISK} select *, case when dataset = 'MIT-BIH' then 'clinical_default' when rejected then 'evidence_argmax' else candidate end as decoder from jj""",
    "gain_macro_f1_4 accuracy_drop F1_S_drop F1_F_gain"))
def risk_guard(spark, sf):
    val = probs(spark, sf).where("role = 'val'")
    c = selection.decoder_candidates(val, _policies(spark, sf, RK), RK, "p_backbone")
    return rounded(selection.guarded_decoder(c, RK, "dataset"))


CFG = """cfg as (select a.v as alpha, s.v as strength, t.tau, t.eta, (a.i * 50 + s.i * 10 + t.i)::int as cand from
  (values (0.25::double, 0), (0.5::double, 1), (0.75::double, 2)) a(v, i), (values (0.0::double, 0), (0.25::double, 1), (0.5::double, 2), (0.75::double, 3), (1.0::double, 4)) s(v, i),
  (select 0 as i, 1.0::double as tau, 0.0::double as eta union all select 1 + x.i * 3 + e.i, x.v, e.v from (values (0.05::double, 0), (0.1::double, 1), (0.2::double, 2)) x(v, i), (values (0.05::double, 0), (0.1::double, 1), (0.2::double, 2)) e(v, i)) t)"""
BOUND = f"""{PROBS}, {LOGS}, {CNT}, {BIAS}, {CFG},
bs as (select lg.dataset, method, lg.seed, y, cand, tau, eta, le, list_transform(range(1, 6), lambda i: (1 - alpha) * lb[i] + alpha * le[i] + strength * (raw_bias[i] - list_avg(raw_bias))) as sc
  from lg join bias using (dataset, seed), cfg where role = 'val'),
bz as (select *, list_transform(range(1, 6), lambda i: sc[i] + eta * exp(-(list_sort(sc, 'desc')[1] - list_sort(sc, 'desc')[2]) / tau) * (le[i] - list_avg(le))) as z from bs),
pp as (select *, {argmax_sql('z')} as pred from bz),
{metrics_sql('dataset, method, seed, cand', grid_cells('dataset, method, seed, cand', 'pp'))}"""


@query("boundary_grid", rounded_sql(f"with {BOUND} select dataset, method, seed, cand, macro_f1_4, accuracy, F1_S, F1_F from mrow", "macro_f1_4 accuracy F1_S F1_F"))
def boundary_grid(spark, sf):
    p = probs(spark, sf)
    g = selection.boundary_grid(p.where("role = 'val'"), p.where("role = 'fit'"), RK)
    return rounded(g.select(*RK, "cand", "macro_f1_4", "accuracy", "F1_S", "F1_F"))


@query("boundary_choice", rounded_sql(f"""with {BOUND}, b as (select *, row_number() over (partition by dataset, method, seed order by round(macro_f1_4, 10) desc, round(accuracy, 10) desc, round(F1_S + F1_F, 10) desc, cand) as r from mrow)
select dataset, method, seed, alpha, strength as prior_strength, macro_f1_4, accuracy from b join cfg using (cand) where r = 1""", "macro_f1_4 accuracy"))
def boundary_choice(spark, sf):
    p = probs(spark, sf)
    g = selection.boundary_grid(p.where("role = 'val'"), p.where("role = 'fit'"), RK)
    return rounded(selection.select_boundary(g, RK).select(*RK, "alpha", "prior_strength", "macro_f1_4", "accuracy"))


def _points_sql(kind):
    n, s, v, f = selection.MULTIPLIERS[kind]
    def lst(x): return "[" + ",".join(str(i) for i in x) + "]"
    size = len(s) * len(v) * len(f), len(v) * len(f), len(f)
    return (f"pt as (select 0 as cand, 0.85::double as n_mul, 2.5::double as s_mul, 0.95::double as v_mul, 2.0::double as f_mul union all "
            f"select (1 + a.i * {size[0]} + b.i * {size[1]} + c.i * {size[2]} + d.i)::int, a.v, b.v, c.v, d.v from "
            + ", ".join(f"(select unnest({lst(x)})::double as v, unnest(range({len(x)})) as i) {al}" for x, al in zip((n, s, v, f), "abcd")) + ")")


def _multi_sql(kind):
    return f"""{PROBS}, {_points_sql(kind)}, mp as (select dataset, method, seed, y, cand, n_mul, s_mul, v_mul, f_mul,
   [p_evidence[1] * n_mul, p_evidence[2] * s_mul, p_evidence[3] * v_mul, p_evidence[4] * f_mul, p_evidence[5]] as z from probs, pt where role = 'test'),
 pp as (select *, {argmax_sql('z')} as pred from mp),
 {metrics_sql('dataset, method, seed, cand, n_mul, s_mul, v_mul, f_mul', grid_cells('dataset, method, seed, cand, n_mul, s_mul, v_mul, f_mul', 'pp'))}"""


@query("multiplier_grid", rounded_sql(f"with {_multi_sql('wide')} select dataset, method, seed, cand, n_mul, s_mul, v_mul, f_mul, macro_f1_4, accuracy, Se_S, support_F from mrow", "macro_f1_4 accuracy Se_S"))
def multiplier_grid(spark, sf):
    g = selection.multiplier_grid(probs(spark, sf).where("role = 'test'"), RK, "wide", "p_evidence")
    return rounded(g.select(*RK, "cand", "n_mul", "s_mul", "v_mul", "f_mul", "macro_f1_4", "accuracy", "Se_S", "support_F"))


@query("kept_multipliers", rounded_sql(f"""with {_multi_sql('s_focus')}, r as (select *, row_number() over (partition by dataset, method, seed order by round(macro_f1_3_nsv, 10) desc, round(accuracy, 10) desc, cand) as rk from mrow)
select dataset, method, seed, cand, macro_f1_3_nsv, accuracy, rk = 1 as is_best from r where cand = 0 or macro_f1_3_nsv >= 0.5 or rk = 1""", "macro_f1_3_nsv accuracy"))
def kept_multipliers(spark, sf):
    g = selection.multiplier_grid(probs(spark, sf).where("role = 'test'"), RK, "s_focus", "p_evidence")
    k = selection.kept_multipliers(g, RK, "macro_f1_3_nsv", 0.5)
    return rounded(k.select(*RK, "cand", "macro_f1_3_nsv", "accuracy", "is_best"))


# ---- calibration ---------------------------------------------------------------------------

CAL_KEYS = ["dataset", "method", "seed"]


def _stacked(spark, sf):
    p = probs(spark, sf)
    return p.select(*CAL_KEYS, "y", F.explode(F.array(
        F.struct(F.lit("raw").alias("source"), F.col("p_backbone").alias("p")),
        F.struct(F.lit("adapted").alias("source"), P.power_calibrate(F.col("p_evidence"), 0.9).alias("p")))).alias("s")).select(*CAL_KEYS, "y", "s.*")


QUALITY = f"""sn as (select * exclude (p), {norm_sql('p')} as q from st),
sc as (select *, list_max(q) as conf, ({argmax_sql('q')} = y)::int::double as hit, list_sum(list_transform(range(5), lambda i: pow(q[i + 1] - (case when i = y then 1 else 0 end), 2))) as br,
  -ln(least(greatest(q[y + 1], 1e-12::double), 1.0::double)) as ls from sn),
bn0 as (select *, floor(conf * 15) as g from sc),
bn1 as (select *, case when conf < g * (1.0::double / 15) then g - 1 else g end as l from bn0),
bn as (select *, (least(greatest(case when conf >= (l + 1) * (1.0::double / 15) then l + 1 else l end, 0), 14) + 1)::int as bin from bn1),
bb as (select dataset, method, seed, source, bin, count(*) as n, sum(hit) as hits, sum(conf) as conf, sum(br) as brier, sum(ls) as loss from bn group by all),
qq as (select dataset, method, seed, source, sum(n)::bigint as n, sum(brier) / sum(n) as brier, sum(abs(hits - conf)) / sum(n) as ece, sum(loss) / sum(n) as nll, sum(hits) / sum(n) as accuracy from bb group by all)"""
CAL = f"""{PROBS}, st as (select dataset, method, seed, y, 'raw' as source, p_backbone as p from probs union all select dataset, method, seed, y, 'adapted', {power_sql('p_evidence', '0.9::double')} from probs),
{QUALITY}"""
QN = ["brier", "ece", "nll", "accuracy"]


@query("calibration", rounded_sql(f"with {CAL} select * from qq", " ".join(QN)))
def calibration(spark, sf):
    binned = C.binned_scores(_stacked(spark, sf), [*CAL_KEYS, "source"])
    return rounded(C.quality(binned, [*CAL_KEYS, "source"]))


PAIRED = "pq as (select a.dataset, a.method, a.seed, " + ", ".join(f"a.{m} as raw_{m}, b.{m} as adapted_{m}, b.{m} - a.{m} as delta_{m}" for m in QN) + \
    " from qq a join qq b on a.dataset = b.dataset and a.method = b.method and a.seed = b.seed and a.source = 'raw' and b.source = 'adapted')"
PQ = [f"{t}_{m}" for t in ("raw", "adapted", "delta") for m in QN]


@query("paired_calibration", rounded_sql(f"with {CAL}, {PAIRED} select * from pq", " ".join(PQ)))
def paired_calibration(spark, sf):
    binned = C.binned_scores(_stacked(spark, sf), [*CAL_KEYS, "source"])
    return rounded(C.paired_quality(binned, CAL_KEYS))


GRID = """rg as (select k.dataset, k.method, k.seed, k.source, g.bin, (g.bin - 1) * (1.0::double / 15) as lo, case when g.bin = 15 then 1.0::double else g.bin * (1.0::double / 15) end as hi,
  coalesce(b.n, 0) as n, coalesce(b.hits / b.n, 'nan'::double) as accuracy, coalesce(b.conf / b.n, 'nan'::double) as confidence, coalesce(abs(b.hits / b.n - b.conf / b.n), 'nan'::double) as abs_gap
  from (select distinct dataset, method, seed, source from bb) k cross join (select unnest(range(1, 16))::int as bin) g left join bb b on b.dataset = k.dataset and b.method = k.method and b.seed = k.seed and b.source = k.source and b.bin = g.bin)"""


@query("reliability_bins", rounded_sql(f"with {CAL}, {GRID} select * from rg", "lo hi accuracy confidence abs_gap"))
def reliability_bins(spark, sf):
    binned = C.binned_scores(_stacked(spark, sf), [*CAL_KEYS, "source"])
    return rounded(C.reliability_bins(binned, [*CAL_KEYS, "source"]))


def _pool_sql(keys, min_n):
    return f"""po as (select {keys}, bin, sum(n)::bigint as n, sum(confidence * n) / sum(n) as confidence, sum(accuracy * n) / sum(n) as accuracy, sum(abs_gap * n) / sum(n) as abs_gap
 from rg where n >= {min_n} and not isnan(accuracy) group by all)"""


def _bins(spark, sf):
    return C.reliability_bins(C.binned_scores(_stacked(spark, sf), [*CAL_KEYS, "source"]), [*CAL_KEYS, "source"])


@query("pooled_bins", rounded_sql(f"with {CAL}, {GRID}, {_pool_sql('source', 1)} select * from po", "confidence accuracy abs_gap"))
def pooled_bins(spark, sf):
    return rounded(C.pooled_bins(_bins(spark, sf), ["source"]))


@query("pooled_curve", rounded_sql(f"with {CAL}, {GRID}, {_pool_sql('dataset, source', 20)} select * from po", "confidence accuracy abs_gap"))
def pooled_curve(spark, sf):
    return rounded(C.pooled_bins(_bins(spark, sf), ["dataset", "source"], 20))


@query("calibration_gap", rounded_sql(f"with {CAL}, {GRID}, {_pool_sql('dataset, source', 20)} select dataset, source, sum(abs(accuracy - confidence) * n) / sum(n) as gap, count(*) as bins from po group by all", "gap"))
def calibration_gap(spark, sf):
    return rounded(C.calibration_gap(C.pooled_bins(_bins(spark, sf), ["dataset", "source"], 20), ["dataset", "source"]))


_MS = ", ".join(f"avg({m}) as {m}_mean, stddev_pop({m}) as {m}_std" for m in PQ)


ROLLUP = f"""ro as (select dataset, method, grouping(dataset, method) as g, string_agg(distinct seed::varchar, ' ' order by seed::varchar desc) as sd, count(distinct seed) as ds, count(*) as rw, {_MS} from pq group by grouping sets ((dataset, method), (method), ()))
select case when g = 0 then dataset else 'Overall' end as dataset, case when g = 3 then 'All representatives' else method end as method, case when g = 0 then ds else rw end as n_seeds, case when g = 0 then sd else 'all' end as seeds,
 {", ".join(f"{m}_mean, {m}_std" for m in PQ)} from ro"""
PQ_COLUMNS = " ".join(f"{m}_{s}" for m in PQ for s in ("mean", "std"))


@query("calibration_rollup", rounded_sql(f"with {CAL}, {PAIRED}, {ROLLUP}", PQ_COLUMNS))
def calibration_rollup(spark, sf):
    rows = C.paired_quality(C.binned_scores(_stacked(spark, sf), [*CAL_KEYS, "source"]), CAL_KEYS)
    return rounded(summary.calibration_rollup(rows, PQ))


# ---- rebalancing and neighbours ------------------------------------------------------------

@query("inverse_freq_resample", f"""with {BEATS}, k as (select *, row_number() over (partition by y order by {hash_sql(str(SEED), 'beat_id')}, beat_id) - 1 as rk from beats),
cl as (select list(y order by y) as ys, list(n order by y) as ns, sum(n)::bigint as total from (select y, count(*) as n from beats group by y)),
sl as (select range as s from range((select total from cl))),
dr as (select s, ys[({hash_sql(str(SEED), 's', repr('c'))} % len(ys)) + 1] as y, ns[({hash_sql(str(SEED), 's', repr('c'))} % len(ys)) + 1] as n from sl, cl),
rr as (select s, y, {hash_sql(str(SEED), 's', repr('r'))} % n as rk from dr)
select k.beat_id, k.y, count(*) as copies from rr join k using (y, rk) group by all""")
def inverse_freq_resample(spark, sf):
    out = rebalance.inverse_frequency(beats(spark, sf), SEED)
    return out.groupBy("beat_id", "y").agg(F.count(F.lit(1)).alias("copies"))


def _vec(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("beat_id"), (F.col("label") % 5).alias("y"), F.col("embedding").cast("array<double>").alias("vec"))


SMOTE = f"""e as (select vec_id as id, label % 5 as y, embedding::double[] as v from embeddings),
cl as (select y, count(*) as n from e group by y), lim as (select max(n) as top, least(5, min(n) - 1) as k from cl),
sm as (select y, n, top - n as need, sum(top - n) over (order by y) as edge from cl, lim where n < top),
rk as (select id, e.y, v, row_number() over (partition by e.y order by {hash_sql(str(SEED), 'id')}, id) - 1 as rk from e),
sl as (select s, y, n from (select range as s from range((select max(edge)::bigint from sm))) r join sm on s < edge and s >= edge - need),
ds as (select a.id, b.id as nb, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) as d from e a join e b on a.y = b.y and a.id <> b.id),
nn as (select id, nb, row_number() over (partition by id order by d, nb) as r from ds),
pk as (select s, sl.y, rk.id, rk.v, {hash_sql(str(SEED), 's', repr('near'))} % (select k from lim) + 1 as r, {hash_sql(str(SEED), 's', repr('u'))} / 4294967296.0::double as u
  from sl join rk on rk.y = sl.y and rk.rk = {hash_sql(str(SEED), 's', repr('base'))} % sl.n),
res as (select id, y, false as synthetic, v from e union all
  select -s - 1, pk.y, true, list_transform(range(1, 65), lambda i: pk.v[i] + u * (b.v[i] - pk.v[i])) from pk join nn on nn.id = pk.id and nn.r = pk.r join e b on b.id = nn.nb)"""


@query("smote", rounded_sql(f"with {SMOTE} select id, y, synthetic, list_sum(v) as total from res", "total"))
def smote(spark, sf):
    out = rebalance.interpolate_minority(_vec(spark, sf), SEED)
    return rounded(out.select("id", "y", "synthetic", A.total(F.col("vec")).alias("total")))


@query("tomek_links", """with e as (select vec_id as id, label % 5 as y, embedding::double[] as v from embeddings),
d as (select a.id, b.id as nb, a.y, b.y as yb, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) as d from e a join e b on a.id <> b.id),
n as (select id, arg_min(nb, (d, nb)) as nb, arg_min(yb, (d, nb)) as yb, any_value(y) as y from d group by id)
select a.id as a, a.nb as b from n a join n b on a.nb = b.id and b.nb = a.id where a.id < a.nb and a.y <> a.yb""")
def tomek_links(spark, sf):
    return rebalance.link_pairs(_vec(spark, sf), "y", "beat_id")


@query("smote_cleaned", f"""with {SMOTE},
dd as (select a.id, b.id as nb, a.y, b.y as yb, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) as d from res a join res b on a.id <> b.id),
n1 as (select id, arg_min(nb, (d, nb)) as nb, arg_min(yb, (d, nb)) as yb, any_value(y) as y from dd group by id),
tl as (select a.id from n1 a join n1 b on a.nb = b.id and b.nb = a.id where a.y <> a.yb)
select y, synthetic, count(*) as n from res where id not in (select id from tl) group by all""")
def smote_cleaned(spark, sf):
    out = rebalance.interpolate_and_clean(_vec(spark, sf), SEED)
    return out.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))


def _draw(*parts):
    return hash_sql(str(SEED), "0", "beat_id", *parts)


def _noisy_sql(lead):
    u1 = f"(({_draw(repr(lead), 'i - 1', repr('a'))}) + 0.5::double) / 4294967296.0::double"
    u2 = f"({_draw(repr(lead), 'i - 1', repr('b'))}) / 4294967296.0::double"
    noise = f"sqrt(-2.0::double * ln({u1})) * cos(6.283185307179586::double * {u2})"
    return f"list_transform(range(1, 33), lambda i: case when m and i > st and i <= st + w then 0.0::double else {lead}[i] + 0.01::double * {noise} end)"


@query("augment", rounded_sql(f"""with {BEATS}, a as (select *, {_draw(repr('m'))} / 4294967296.0::double < 0.25 as m, 8 + {_draw(repr('w'))} % 17 as w from beats),
b as (select *, {_draw(repr('s'))} % (greatest(32 - w, 0) + 1) as st from a),
c as (select beat_id, {_noisy_sql('b0')} as x, {_noisy_sql('b1')} as z from b)
select beat_id, list_sum(x) as s0, list_sum(z) as s1, len(list_filter(x, lambda v: v = 0))::int as zeroed from c""", "s0 s1"))
def augment(spark, sf):
    b = beats(spark, sf)
    out = rebalance.jitter_mask(b, SEED, 0)
    return rounded(out.select("beat_id", A.total(F.col("b0")).alias("s0"), A.total(F.col("b1")).alias("s1"),
                              F.size(F.filter("b0", lambda x: x == 0)).alias("zeroed")))


@query("knn_vote", rounded_sql(f"""with e as (select vec_id, label % 5 as y, embedding::double[] as v, {hash_sql(str(SEED), repr('role'), 'vec_id')} % 100 as h from embeddings),
u as (select unnest(range(1, 65)) as pos, unnest(v) as x from e where h < 50), st as (select list(m order by pos) as ms, list(sd order by pos) as ss from (select pos, avg(x) as m, stddev_pop(x) as sd from u group by pos)),
z as (select vec_id, y, h, list_transform(range(1, 65), lambda i: (v[i] - ms[i]) / ss[i]) as v from e, st),
d as (select a.vec_id as id, b.vec_id as nb, b.y, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) as d from z a, z b where a.h >= 50 and b.h < 50),
r as (select *, row_number() over (partition by id order by d, nb) as rk from d),
w as (select id, {", ".join(f"count(*) filter (where y = {c}) / 7.0::double as v{c}" for c in range(5))} from r where rk <= 7 group by id)
select id as beat_id, v0, v1, v2, v3, v4, (list_position([v0,v1,v2,v3,v4], greatest(v0,v1,v2,v3,v4)) - 1)::int as pred from w""", "v0 v1 v2 v3 v4"))
def knn_vote(spark, sf):
    rows = _vec(spark, sf).withColumn("role", role_of(F.lit(SEED), F.col("beat_id")))
    z = pin(models.standardise(rows.where("role = 'fit'"), rows))
    out = models.knn_vote(z.where("role = 'fit'"), z.where("role <> 'fit'"))
    return rounded(out.select("beat_id", *[F.col("p")[c].alias(f"v{c}") for c in range(5)], "pred"))
