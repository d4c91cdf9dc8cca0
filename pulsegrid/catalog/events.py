"""Queries over events, labels, documents, nations and orders."""

from pyspark.sql import functions as F

from pulsegrid.catalog import SQL, query
from pulsegrid.catalog.roles import (
    DATASETS,
    EVENT_CLASS,
    SCORED,
    annotations,
    hash_sql,
    rounded,
    rounded_sql,
    scored_events,
    table,
)
from pulsegrid.operators import intervals, metrics, ordered, ranking, reshape, splits, summary
from pulsegrid.operators.quantiles import grouped_quantiles
from pulsegrid.plans import derived
from pulsegrid.schema import CLASS_NAMES
from pulsegrid.sources import recordings, tables

SEED = 303
FOUR = {k: v for k, v in EVENT_CLASS.items() if k != "signup"}
CASE_Y = "case {} when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'error' then 3 end"

INTERVALS = """ann as (select event_id, user_id as record, epoch_us(ts) as sample, event_type as symbol from events),
d as (select *, (sample - lag(sample) over w) / 1e6::double as d from ann window w as (partition by record order by sample, event_id)),
c as (select *, lead(d) over w as nx,
    quantile_cont(d, 0.5) over (partition by record order by sample, event_id rows between 4 preceding and 5 following) as loc0,
    coalesce(quantile_cont(d, 0.5) over (partition by record), 1.0) as glo from d window w as (partition by record order by sample, event_id)),
f as (select *, coalesce(d, glo) as pre, coalesce(nx, glo) as post, coalesce(loc0, glo) as loc from c)"""


@query("interval_features", rounded_sql(
    "with " + INTERVALS + f"""
select event_id, {CASE_Y.format('symbol')} as y, pre, post, pre/(post+1e-8::double) as pre_over_post, post/(pre+1e-8::double) as post_over_pre,
  abs(post-pre) as abs_diff, pre/(loc+1e-8::double) as pre_over_local, post/(loc+1e-8::double) as post_over_local,
  pre/(glo+1e-8::double) as pre_over_global, post/(glo+1e-8::double) as post_over_global,
  (pre-loc)/(loc+1e-8::double) as pre_dev_local, (post-loc)/(loc+1e-8::double) as post_dev_local, loc/(glo+1e-8::double) as local_over_global
from f where symbol <> 'signup'""", " ".join(intervals.FEATURES), 8))
def interval_features(spark, sf):
    ann = annotations(spark, sf)
    feats = intervals.interval_features(intervals.interval_context(ann, 1e6))
    kept = recordings.map_symbols(feats, FOUR)  # after the intervals: every annotation counts there
    return rounded(kept.select(F.col("ann_idx").alias("event_id"), "y", *intervals.FEATURES), 8)


@query("record_medians", rounded_sql(
    "with " + INTERVALS + " select record, count(d) as n, quantile_cont(d, 0.25) as q1, quantile_cont(d, 0.5) as q2, quantile_cont(d, 0.75) as q3 from d where d is not null group by record", "q1 q2 q3", 8))
def record_medians(spark, sf):
    ann = annotations(spark, sf)
    ctx = intervals.interval_context(ann, 1e6)
    first = ranking.first_by_priority(ann.select("record", "ann_idx", "sample"), ["record"], "sample")
    later = ctx.join(first.select("ann_idx"), "ann_idx", "left_anti")
    q = grouped_quantiles(later, ["record"], "pre", [0.25, 0.5, 0.75])
    return rounded(q.select("record", "n", *[F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)]), 8)


@query("event_positions", """select event_id, user_id as record,
  row_number() over (partition by user_id order by ts, event_id) - 1 as idx from events""")
def event_positions(spark, sf):
    ann = annotations(spark, sf)
    return ordered.row_index(ann, ["record"], "sample", "ann_idx").select(
        F.col("ann_idx").alias("event_id"), "record", "idx")


def cells_sql(keys, src="scored", pred="pred"):
    cells = ", ".join(f"count(*) filter (where y = {i} and {pred} = {j}) as c{i}{j}" for i in range(5) for j in range(5))
    return f"select {keys}, {cells} from {src} group by {keys}"


def metrics_sql(keys, cells):
    row = {c: "(" + " + ".join(f"c{c}{j}" for j in range(5)) + ")" for c in range(5)}
    col = {c: "(" + " + ".join(f"c{i}{c}" for i in range(5)) + ")" for c in range(5)}
    n = "(" + " + ".join(row[c] for c in range(5)) + ")"
    se = ", ".join(f"c{c}{c} / ({row[c]} + 1e-12::double) as Se_{CLASS_NAMES[c]}" for c in range(5))
    pr = ", ".join(f"c{c}{c} / ({col[c]} + 1e-12::double) as Pr_{CLASS_NAMES[c]}" for c in range(5))
    sup = ", ".join(f"{row[c]} as support_{CLASS_NAMES[c]}, {col[c]} as predicted_{CLASS_NAMES[c]}" for c in range(5))
    f1 = ", ".join(f"2 * Se_{x} * Pr_{x} / (Se_{x} + Pr_{x} + 1e-12::double) as F1_{x}" for x in CLASS_NAMES)
    return f"""m_ as (select {keys}, (c00 + c11 + c22 + c33 + c44) / {n} as accuracy, {se}, {pr}, {sup} from ({cells})),
  mf_ as (select *, {f1} from m_),
  mrow as (select *, (F1_N+F1_S+F1_V+F1_F+F1_Q)/5 as macro_f1_5, (F1_N+F1_S+F1_V+F1_F)/4 as macro_f1_4, (F1_N+F1_S+F1_V)/3 as macro_f1_3_nsv from mf_)"""


METRIC_NAMES = "accuracy macro_f1_5 macro_f1_4 macro_f1_3_nsv " + " ".join(
    f"{m}_{c}" for m in ("Se", "Pr", "F1") for c in CLASS_NAMES)


@query("confusion_metrics", rounded_sql(
    f"with {SCORED}, {metrics_sql('record', cells_sql('record'))} select * from mrow", METRIC_NAMES))
def confusion_metrics(spark, sf):
    """Flagship: one metric row per record from the confusion of its events."""
    cells = metrics.confusion_counts(scored_events(spark, sf), ["record"])
    return rounded(metrics.metric_row(cells, ["record"]))


@query("confusion_matrix", f"""with {SCORED}, g as (select dataset, y, pred from (select distinct dataset from scored), (select unnest(range(5))::int as y), (select unnest(range(5))::int as pred))
select g.dataset, g.y, g.pred, count(s.record) as n from g left join scored s on s.dataset = g.dataset and s.y = g.y and s.pred = g.pred group by all""")
def confusion_matrix(spark, sf):
    wide = metrics.confusion_counts(scored_events(spark, sf), ["dataset"])
    return metrics.confusion_long(wide, ["dataset"])


@query("paired_deltas", rounded_sql(f"""with {SCORED}, {metrics_sql('dataset, stage', cells_sql('dataset, stage', "(select dataset, y, unnest(['raw','new']) as stage, unnest([raw_pred, pred]) as pred from scored)"))}
select a.dataset, a.accuracy, a.macro_f1_4, b.accuracy as raw_accuracy, b.macro_f1_4 as raw_macro_f1_4, a.accuracy - b.accuracy as delta_accuracy,
  a.macro_f1_4 - b.macro_f1_4 as delta_macro_f1_4 from mrow a join mrow b on a.dataset = b.dataset and a.stage = 'new' and b.stage = 'raw'""",
    "accuracy macro_f1_4 raw_accuracy raw_macro_f1_4 delta_accuracy delta_macro_f1_4"))
def paired_deltas(spark, sf):
    ev = scored_events(spark, sf)
    names = ["accuracy", "macro_f1_4"]
    new = metrics.metric_row(metrics.confusion_counts(ev, ["dataset"]), ["dataset"]).select("dataset", *names)
    raw = metrics.metric_row(metrics.confusion_counts(ev, ["dataset"], pred="raw_pred"), ["dataset"], "raw_")
    both = new.join(raw.select("dataset", *[f"raw_{n}" for n in names]), "dataset")
    return rounded(reshape.paired_deltas(both, names))


@query("class_counts_json", f"""with {SCORED} select record, concat('{{"N":', count(*) filter (where y=0), ',"S":', count(*) filter (where y=1), ',"V":', count(*) filter (where y=2),
  ',"F":', count(*) filter (where y=3), ',"Q":', count(*) filter (where y=4), '}}') as counts from scored group by record""")
def class_counts_json(spark, sf):
    return metrics.counts_json(scored_events(spark, sf), ["record"])


@query("prediction_changes", f"""with {SCORED}, p as (select dataset, raw_pred, pred, count(*) as n from scored where raw_pred <> pred group by all),
q as (select dataset, n, list_extract(['N','S','V','F','Q'], raw_pred + 1) || '->' || list_extract(['N','S','V','F','Q'], pred + 1) as pair from p)
select dataset, sum(n)::bigint as changed, '{{' || string_agg('"' || pair || '": ' || n, ', ' order by n desc, pair) || '}}' as changed_pairs from q group by dataset""")
def prediction_changes(spark, sf):
    return metrics.change_counts(scored_events(spark, sf), ["dataset"], "raw_pred", "pred")


KEYED = """keyed as (select concat_ws('|', dataset, 'net' || (record % 2), k % 3, stage) as key, y, pred, count(*) as n from
  (select dataset, record, k, y, unnest(['raw','new']) as stage, unnest([raw_pred, pred]) as pred from scored) group by all)"""


def keyed_confusions(spark, sf):
    ev = scored_events(spark, sf)
    staged = ev.select("dataset", F.concat(F.lit("net"), F.col("record") % 2).alias("backbone"),
                       (F.col("k") % 3).alias("seed"), "y", F.explode(F.array(
                           F.struct(F.lit("raw").alias("stage"), F.col("raw_pred").alias("pred")),
                           F.struct(F.lit("new").alias("stage"), F.col("pred").alias("pred")))).alias("s"))
    key = reshape.composite_key("dataset", "backbone", "seed", "s.stage").alias("key")
    return staged.groupBy(key, "y", "s.pred").agg(F.count(F.lit(1)).alias("n"))


@query("key_split", f"""with {SCORED}, {KEYED} select key, y, pred, n, split_part(key,'|',1) as dataset, split_part(key,'|',2) as backbone,
  split_part(key,'|',3) as seed, split_part(key,'|',4) as stage from keyed""")
def key_split(spark, sf):
    return reshape.split_key(keyed_confusions(spark, sf), "key", ["dataset", "backbone", "seed", "stage"])


_REC = ", ".join(
    f"sum(n) filter (where y = {c} and pred = {c}) / greatest(coalesce(sum(n) filter (where y = {c}), 0)::double, 1e-12::double) as r{c}" for c in range(5))


@query("recall_diagnostics", rounded_sql(f"""with {SCORED}, {KEYED},
k4 as (select split_part(key,'|',1) as dataset, split_part(key,'|',2) as backbone, split_part(key,'|',3) as seed, split_part(key,'|',4) as stage, y, pred, n from keyed),
r0 as (select dataset, backbone, seed, stage, {_REC} from k4 group by all),
r as (select dataset, backbone, seed, stage, {", ".join(f"coalesce(r{c}, 0) as r{c}" for c in range(5))} from r0),
m as (select a.dataset, a.backbone, {", ".join(f"avg(a.r{c}) as raw_Se_{n}_mean, avg(b.r{c}) as adapted_Se_{n}_mean, avg(b.r{c} - a.r{c}) as delta_Se_{n}_mean" for c, n in enumerate(CLASS_NAMES))}
  from r a join r b on a.dataset=b.dataset and a.backbone=b.backbone and a.seed=b.seed and a.stage='raw' and b.stage='new' group by all),
l as (select *, [{", ".join(f"delta_Se_{n}_mean" for n in CLASS_NAMES)}] as dl, [{", ".join(f"adapted_Se_{n}_mean" for n in CLASS_NAMES)}] as al from m)
select * exclude (dl, al), list_extract(['N','S','V','F','Q'], list_position(dl, list_max(dl))) as largest_recall_gain_class, list_max(dl) as largest_recall_gain,
  list_extract(['N','S','V','F','Q'], list_position(al, list_min(al))) as hardest_recall_class, list_min(al) as hardest_recall from l""",
    " ".join(f"{p}_Se_{n}_mean" for p in ("raw", "adapted", "delta") for n in CLASS_NAMES) + " largest_recall_gain hardest_recall"))
def recall_diagnostics(spark, sf):
    conf = reshape.split_key(keyed_confusions(spark, sf), "key", ["dataset", "backbone", "seed", "stage"])
    return rounded(metrics.recall_diagnostics(
        conf, ["dataset", "backbone", "seed"], ["dataset", "backbone"], "raw", "new"))


SHARES = """sh as (select dataset, stage, y, pred, n, sum(n) over (partition by dataset, stage, y)::bigint as row_total from
  (select dataset, stage, y, pred, count(*) as n from (select dataset, y, unnest(['raw','new']) as stage, unnest([raw_pred, pred]) as pred from scored) group by all))"""


def _shares(spark, sf):
    ev = scored_events(spark, sf)
    staged = ev.select("dataset", "y", F.explode(F.array(
        F.struct(F.lit("raw").alias("stage"), F.col("raw_pred").alias("pred")),
        F.struct(F.lit("new").alias("stage"), F.col("pred").alias("pred")))).alias("s"))
    conf = staged.groupBy("dataset", "s.stage", "y", "s.pred").agg(F.count(F.lit(1)).alias("n"))
    return metrics.confusion_shares(conf, ["dataset", "stage"])


@query("row_share_confusion", rounded_sql(f"with {SCORED}, {SHARES} select *, n / row_total as row_share from sh", "row_share"))
def row_share_confusion(spark, sf):
    return rounded(_shares(spark, sf))


@query("minority_error", rounded_sql(
    f"with {SCORED}, {SHARES} select dataset, stage, y, n / row_total as error_rate from sh where y in (1, 3) and pred = 0", "error_rate"))
def minority_error(spark, sf):
    return rounded(metrics.minority_to_normal(_shares(spark, sf), ["dataset", "stage"]))


@query("absent_penalty", rounded_sql(f"""with {SCORED}, s as (select record, {", ".join(f"count(*) filter (where y={c}) as s{c}, count(*) filter (where pred={c}) as p{c}" for c in range(5))}, count(*) as n from scored where y <> 3 group by record)
select record, ({" + ".join(f"case when s{c} = 0 then p{c} else 0 end" for c in range(4))}) / greatest(n, 1) as penalty from s""", "penalty"))
def absent_penalty(spark, sf):
    ev = scored_events(spark, sf).where("y <> 3")
    rows = metrics.metric_row(metrics.confusion_counts(ev, ["record"]), ["record"])
    return rounded(rows.select("record", metrics.absent_share().alias("penalty")))


@query("symbol_filter", """select event_type as symbol, case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'error' then 3 end as y,
  count(*) as n from events where event_type <> 'signup' group by all""")
def symbol_filter(spark, sf):
    return recordings.map_symbols(annotations(spark, sf), FOUR).groupBy("symbol", "y").agg(F.count(F.lit(1)).alias("n"))


@query("record_list_filter", """select concat_ws('_', 'db', user_id) as pid, count(*) as n, case when user_id in (101,106,108,109,112,114,115,116,118,119,122,124,201,203,205,207,208,209,215,220,223,230) then 'train' else 'test' end as role
 from events where user_id in (101,106,108,109,112,114,115,116,118,119,122,124,201,203,205,207,208,209,215,220,223,230,100,103,105,111,113,117,121,123,200,202,210,212,213,214,219,221,222,228,231,232,233,234) group by user_id""")
def record_list_filter(spark, sf):
    ev = annotations(spark, sf).withColumn("record", F.col("record").cast("string"))
    lists = recordings.record_lists(spark)
    listed = splits.fixed_lists(recordings.in_list(ev, lists), lists)
    return listed.groupBy(recordings.qualified(F.lit("db"), "record").alias("pid"), "role").agg(F.count(F.lit(1)).alias("n"))


@query("file_audit", """select n_name as record, e.ext from nation cross join (values ('hea'),('dat'),('atr')) e(ext)
 where not ((e.ext = 'hea') or (e.ext = 'dat' and n_nationkey % 2 = 0) or (e.ext = 'atr' and n_regionkey < 3))""")
def file_audit(spark, sf):
    nation = table(spark, sf, "nation")
    records = nation.select(F.col("n_name").alias("record"))
    exts = F.array_compact(F.array(
        F.lit("hea"), F.when(F.col("n_nationkey") % 2 == 0, "dat"), F.when(F.col("n_regionkey") < 3, "atr")))
    listing = nation.select(F.col("n_name").alias("record"), F.explode(exts).alias("ext"))
    return recordings.missing_files(records, listing)


@query("lead_priority", """with l as (select n_regionkey as record, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as pos, n_nationkey as k from nation),
names as (select record, pos, list_extract(['m l ii','II','ecg1','V5','I','V1','ECG2','v2','III','aVR','X'], ((k * 7 + record) % 11)::int + 1) as name from l),
u as (select record, pos, upper(replace(name, ' ', '')) as name from names),
a as (select record, arg_min(pos, list_position(['MLII','II','ECG1','V5','I'], name)) filter (where list_contains(['MLII','II','ECG1','V5','I'], name)) as a,
  arg_min(pos, list_position(['V1','ECG2','V2','III','I'], name)) filter (where list_contains(['V1','ECG2','V2','III','I'], name)) as b, count(*) as n from u group by record),
c as (select record, n, coalesce(a, 0) as lead0, coalesce(b, case when n > 1 then 1 else 0 end) as s from a)
select record, lead0::int as lead0, (case when s = lead0 and n > 1 then case when lead0 <> 1 then 1 else 0 end else s end)::int as lead1 from c""")
def lead_priority(spark, sf):
    nation = table(spark, sf, "nation")
    pos = ordered.row_index(
        nation.select(F.col("n_regionkey").alias("record"), F.col("n_nationkey").alias("k")), ["record"], "k", "k", "pos")
    names = ["m l ii", "II", "ecg1", "V5", "I", "V1", "ECG2", "v2", "III", "aVR", "X"]
    leads = pos.select("record", "pos", F.get(
        F.array(*[F.lit(n) for n in names]), ((F.col("k") * 7 + F.col("record")) % 11).cast("int")).alias("name"))
    return recordings.choose_leads(leads)


# ---- splits -------------------------------------------------------------------------------

COUNTS = ", ".join(f"count(*) filter (where y = {c}) as n{c}" for c in range(5))
REC = f"rc as (select record, {COUNTS} from scored group by record), tot as (select count(*) as r, {', '.join(f'sum(n{c}) as t{c}' for c in range(5))} from rc)"


def candidate_sql(n, quota):
    """Records of every candidate as one list in order of their draws (``cl``), and the class counts of its first ``quota`` (``cs``)."""
    h = hash_sql(f"'{SEED}'", "cand", "record")
    return f"""cl as materialized (select cand, list_sort(list(struct_pack(h := {h}, record := record, {", ".join(f"n{c} := n{c}" for c in range(5))}))) as l
    from (select rc.*, unnest(range({n})) as cand from rc) group by cand),
  q as materialized (select {quota} as quota from tot),
  cs as materialized (select cand, {", ".join(f"list_sum(list_transform(t, lambda x: x.n{c})) as v{c}" for c in range(5))}
    from (select cand, l[1:quota] as t from cl, q))"""


def chosen_sql(cand, first, rest):
    """Rows of one candidate: its first ``quota`` records on one side."""
    return f"""select x.record as record, case when i <= (select quota from q) then '{first}' else '{rest}' end as role
  from (select unnest(l) as x, generate_subscripts(l, 1) as i from cl where cand = ({cand}))"""


@query("record_counts", f"with {SCORED} select record, {', '.join(f'count(*) filter (where y = {c}) as count_{n}' for c, n in enumerate(CLASS_NAMES))} from scored group by record")
def record_counts(spark, sf):
    return splits.record_counts(scored_events(spark, sf))


@query("record_split", f"""with {SCORED}, {REC}, {candidate_sql(2000, "greatest(1, round_even(r * 0.67::double, 0))::bigint")},
  ok as (select min(cand) as cand from cs, tot where {" and ".join(f"(t{c} < 20 or (v{c} > 0 and v{c} < t{c}))" for c in range(4))})
{chosen_sql("select cand from ok", "train", "test")}""")
def record_split(spark, sf):
    return splits.train_test_records(scored_events(spark, sf), SEED)


@query("constrained_record_split", f"""with {SCORED}, {REC}, {candidate_sql(3000, "least(greatest(1, round_even(r * 0.15::double, 0)), r - 1)::bigint")},
  adm as (select cand, v1 + v3 as m, v3 from cs, tot where {" and ".join(f"(t{c} < 30 or (v{c} * 2 <= t{c} and v{c} > 0))" for c in range(5))}),
  pick as (select coalesce(min(cand) filter (where v3 >= 10), arg_max(cand, m * 10000 - cand)) as cand from adm)
{chosen_sql("select cand from pick", "val", "fit")}""")
def constrained_record_split(spark, sf):
    return splits.fit_val_records(scored_events(spark, sf), SEED)


def _strat_sql(quota):
    h = hash_sql(f"'{SEED}'", "beat_id")
    return f"""with {SCORED}, s as (select *, row_number() over (partition by y order by {h}, beat_id) as rk, count(*) over (partition by y) as n from scored)
select beat_id, y, case when rk <= {quota} then 'val' else 'fit' end as role from s"""


@query("stratified_split", _strat_sql("(case when n <= 2 then 0 else least(greatest(1, round_even(n * 0.15::double, 0)), n - 1) end)"))
def stratified_split(spark, sf):
    return splits.stratified_split(scored_events(spark, sf), SEED).select("beat_id", "y", "role")


@query("stratified_split_all", _strat_sql("(case when n = 1 then 1 else least(greatest(1, round_even(n * 0.15::double, 0)), n - 1) end)"))
def stratified_split_all(spark, sf):
    return splits.stratified_split_all(scored_events(spark, sf), SEED).select("beat_id", "y", "role")


@query("split_protocols", f"""select 'record' as protocol, s.beat_id, s.y, r.role from (with {SCORED} select record, beat_id, y from scored) s
 join (select * from ({SQL["constrained_record_split"]})) r using (record)
 union all select 'beat', beat_id, y, role from ({SQL["stratified_split"]})""")
def split_protocols(spark, sf):
    """Fit and validation rows under both split protocols."""
    ev = scored_events(spark, sf)
    both = [splits.fit_val_split(ev, SEED, p).select(F.lit(p).alias("protocol"), "beat_id", "y", "role") for p in ("record", "beat")]
    return both[0].unionByName(both[1])


@query("majority_cap", f"""with {SCORED}, s as (select *, row_number() over (partition by y order by {hash_sql(f"'{SEED}'", "beat_id")}, beat_id) as rk from scored)
select beat_id, y from s where y <> 0 or rk <= 1000""")
def majority_cap(spark, sf):
    return splits.majority_cap(scored_events(spark, sf), SEED, 1000).select("beat_id", "y")


@query("training_pool", f"with {SCORED} select y, dataset, count(*) as n from scored group by all")
def training_pool(spark, sf):
    ev = scored_events(spark, sf)
    pool = splits.training_pool(*[ev.where(F.col("dataset") == d) for d in DATASETS])
    return pool.groupBy("y", "dataset").agg(F.count(F.lit(1)).alias("n"))


def _assigned(spark, sf):
    """Role by record, except that a share of the rows of some records leaks into validation."""
    ev = scored_events(spark, sf)
    m = F.col("record") % 10
    role = F.when(m < 6, "fit").when(m < 8, "val").otherwise("test")
    leak = (F.col("dataset") == "SVDB") & (F.col("k") > 80) & (role == "fit")
    return ev.withColumn("seed", F.lit(SEED)).withColumn("role", F.when(leak, "val").otherwise(role))


ASSIGNED = """asg as (select *, 303 as seed, case when dataset = 'SVDB' and k > 80 and record % 10 < 6 then 'val' when record % 10 < 6 then 'fit' when record % 10 < 8 then 'val' else 'test' end as role from scored)"""


def _cj(r):
    parts = [f"'{',' if c else '{'}\"{n}\":', count(*) filter (where role = '{r}' and y = {c})"
             for c, n in enumerate(CLASS_NAMES)]
    return "concat(" + ", ".join(parts) + ", '}')"


@query("split_audit", f"""with {SCORED}, {ASSIGNED}, rr as (select dataset, record, bool_or(role='fit') as f, bool_or(role='val') as v, bool_or(role='test') as t from asg group by all),
o as (select dataset, count(*) filter (where f) as fit_records, count(*) filter (where v) as val_records, count(*) filter (where t) as test_records,
  count(*) filter (where f and v) as fit_val_record_overlap, count(*) filter (where f and t) as fit_test_record_overlap, count(*) filter (where v and t) as val_test_record_overlap from rr group by dataset),
s as (select dataset, seed, count(*) filter (where role='fit') as fit_size, count(*) filter (where role='val') as val_size, count(*) filter (where role='test') as test_size,
  {_cj('fit')} as fit_counts, {_cj('val')} as val_counts from asg group by all)
select s.*, o.* exclude (dataset), case when fit_val_record_overlap + fit_test_record_overlap + val_test_record_overlap = 0 then 'No record leakage across fitting, validation and test'
 else concat_ws('; ', case when fit_val_record_overlap > 0 then 'fitting and validation records overlap' end, case when fit_test_record_overlap > 0 then 'fitting and test records overlap' end,
  case when val_test_record_overlap > 0 then 'validation and test records overlap' end) end as audit_interpretation from s join o on s.dataset = o.dataset""")
def split_audit(spark, sf):
    return splits.split_audit(_assigned(spark, sf))


@query("split_records", f"with {SCORED}, {ASSIGNED} select distinct dataset, seed, role, record from asg")
def split_records(spark, sf):
    return splits.split_records(_assigned(spark, sf))


@query("max_overlap", f"""with {SCORED}, {ASSIGNED}, rr as (select dataset, record, bool_or(role='fit') as f, bool_or(role='val') as v, bool_or(role='test') as t from asg group by all),
o as (select dataset, count(*) filter (where f and v) as a, count(*) filter (where f and t) as b, count(*) filter (where v and t) as c from rr group by dataset)
select max(greatest(a, b, c)) as max_overlap from o""")
def max_overlap(spark, sf):
    audit = splits.split_audit(_assigned(spark, sf))
    return splits.max_overlap(audit, ["fit_val_record_overlap", "fit_test_record_overlap", "val_test_record_overlap"])


@query("shared_records", f"with {SCORED}, {ASSIGNED} select record from asg where role = 'fit' intersect select record from asg where role = 'val'")
def shared_records(spark, sf):
    a = _assigned(spark, sf)
    return splits.shared_records(a.where("role = 'fit'"), a.where("role = 'val'"))


# ---- reshape ------------------------------------------------------------------------------

@query("json_counts_long", """with c as (select user_id as record, event_type as t, count(*) as n from events group by all),
u as (select distinct record from c), g as (select record, s.t, s.class from u, (values ('view','N'),('click','S'),('purchase','V'),('error','F'),('signup','Q')) s(t, class))
select g.record, 'Train' as split, g.class, coalesce(c.n, 0)::int as count from g left join c on c.record = g.record and c.t = g.t""")
def json_counts_long(spark, sf):
    docs = metrics.counts_json(scored_events(spark, sf), ["record"], name="train_counts")
    return reshape.counts_long(docs, ["record"], {"Train": "train_counts"})


@query("safe_json", """select case when coalesce(props, '') = '' then -1 else cast(json_extract(props, '$.k') as int) end as k, count(*) as n from
  (select case when value < 5 then '' when value > 200 then null else props end as props from events) group by all""")
def safe_json(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("value") < 5, "").when(F.col("value") > 200, F.lit(None)).otherwise(F.col("props"))
    k = reshape.parse_json(text, "k int")["k"]
    return e.select(F.coalesce(k, F.lit(-1)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


_MIXED = """case when value < 5 then '' when value > 200 then null when event_type = 'error' then substr(props, 1, length(props) - 1) else
  substr(props, 1, length(props) - 1) || ', "' || event_type || '": "' || user_id || '", "x' || (user_id % 4) || '": '
  || case event_id % 5 when 0 then 'true' when 1 then 'null' when 2 then '"n/a"' when 3 then '[1, 2]' else '2.5' end || '}' end"""


@query("json_any_fields", rounded_sql(f"""with d as (select {_MIXED} as doc from events), o as (select doc from d where doc <> '' and json_valid(doc)),
k as (select doc, unnest(json_keys(doc)) as field from o), v as (select field, json_type(doc, '$."' || field || '"') as t, json_extract_string(doc, '$."' || field || '"') as s from k)
select field, case when t = 'NULL' then 'null' when t = 'VARCHAR' then 'text' when t = 'BOOLEAN' then 'boolean' when t = 'ARRAY' then 'array' when t = 'OBJECT' then 'object' else 'number' end as kind,
  count(*) as n, sum(case when t in ('BOOLEAN', 'ARRAY', 'OBJECT') then null else try_cast(s as double) end) as total, min(case when t = 'VARCHAR' then s end) as first_text from v group by all""", "total"))
def json_any_fields(spark, sf):
    """Fields of objects whose keys and value types no schema fixes."""
    docs = table(spark, sf, "events").select(F.expr(_MIXED).alias("doc"))
    return rounded(reshape.json_fields(docs, [], "doc").groupBy("field", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("number").alias("total"), F.min("text").alias("first_text")))


@query("wide_long_wide", rounded_sql(f"""with {SCORED}, {metrics_sql('dataset', cells_sql('dataset'))}
select dataset, 'S' as class, Pr_S as Pr, Se_S as Se, 'F1_S' as full_name from mrow union all select dataset, 'F', Pr_F, Se_F, 'F1_F' from mrow""", "Pr Se"))
def wide_long_wide(spark, sf):
    rows = metrics.metric_row(metrics.confusion_counts(scored_events(spark, sf), ["dataset"]), ["dataset"])
    long = reshape.to_long(rows, ["dataset"], ["Se_S", "Pr_S", "Se_F", "Pr_F"])
    parts = reshape.split_name(long, "name", ["metric", "class"])
    wide = reshape.to_wide(parts, ["dataset", "class"], "metric", "value", ["Pr", "Se"])
    return rounded(wide.withColumn("full_name", F.concat_ws("_", F.lit("F1"), "class")))


@query("relabel", """select case event_type when 'view' then 'Viewed' when 'click' then 'Clicked' else event_type end as label, count(*) as n,
  coalesce(list_position(['purchase','view','click'], event_type), 0)::bigint as ord from events group by event_type""")
def relabel(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(reshape.recode("event_type", {"view": "Viewed", "click": "Clicked"}).alias("label"), "n",
                    reshape.order_in("event_type", ["purchase", "view", "click"]).alias("ord"))


@query("drop_empty", """select event_type, count(*) as n from (select *, case when value < 5 then 'nan'::double when value > 300 then null else value end as v from events)
 where v is not null and not isnan(v) and v - 20 > 0 group by event_type""")
def drop_empty(spark, sf):
    e = table(spark, sf, "events")
    v = F.when(F.col("value") < 5, F.lit(float("nan"))).when(F.col("value") > 300, F.lit(None)).otherwise(F.col("value"))
    kept = reshape.drop_empty(e.withColumn("v", v).withColumn("gap", F.col("v") - 20), ["v"], ["gap"])
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


COUNT_DOC = f"""cd as (select dataset, k % 3 as seed, split, {", ".join(f"count(*) filter (where y = {c}) as c{c}" for c in range(5))} from
  (select *, case when record % 4 = 0 then 'Test' else 'Train' end as split from scored) group by all),
cl as (select dataset, seed, split, unnest(['N','S','V','F','Q']) as class, unnest([c0,c1,c2,c3,c4]) as count from cd),
cm as (select dataset, split, class, avg(count) as count from cl group by all),
cp as (select *, count / sum(count) over (partition by dataset, split) as prop from cm)"""


def _count_docs(spark, sf):
    ev = scored_events(spark, sf).withColumn("seed", F.col("k") % 3)
    split = F.when(F.col("record") % 4 == 0, "Test").otherwise("Train")
    wide = metrics.class_counts(ev.withColumn("split", split), ["dataset", "seed", "split"])
    texts = wide.select("dataset", "seed", "split", F.to_json(metrics.counts_map()).alias("j"))
    return reshape.to_wide(texts, ["dataset", "seed"], "split", "j", ["Train", "Test"])


@query("dataset_counts", rounded_sql(f"with {SCORED}, {COUNT_DOC} select * from cp", "count prop"))
def dataset_counts(spark, sf):
    return rounded(derived.dataset_counts(_count_docs(spark, sf), {"Train": "Train", "Test": "Test"}))


@query("minority_burden", rounded_sql(f"""with {SCORED}, {COUNT_DOC} select dataset, case when class = 'N' then 'N' else 'Minority' end as "group", sum(count) as count, sum(prop) as prop
 from cp where split = 'Test' group by all""", "count prop"))
def minority_burden(spark, sf):
    counts = derived.dataset_counts(_count_docs(spark, sf), {"Train": "Train", "Test": "Test"})
    return rounded(derived.minority_burden(counts))


@query("confusion_documents", f"""with {SCORED}, g as (select dataset, y, pred from (select distinct dataset from scored), (select unnest(range(5))::int as y), (select unnest(range(5))::int as pred))
select g.dataset || '|raw' as key, g.y, g.pred, count(s.record) as n from g left join scored s on s.dataset = g.dataset and s.y = g.y and s.raw_pred = g.pred group by all""")
def confusion_documents(spark, sf):
    ev = scored_events(spark, sf).withColumn("stage", F.lit("raw"))
    conf = ev.groupBy("dataset", "stage", "y", F.col("raw_pred").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return tables.read_confusions(tables.confusion_documents(conf, ["dataset", "stage"]))


@query("label_quality", """select d.lang as dataset, count(*) as n, count(*) filter (where l.quality = 1 and d.n_chars > 400) as hits, count(*) filter (where l.quality = 1) as support
 from documents d join labels l on d.doc_id = l.doc_id group by d.lang""")
def label_quality(spark, sf):
    """Labels joined to documents by id; size decides the predicted class."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rows = d.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("lang").alias("dataset"), F.col("quality").alias("y"), (F.col("n_chars") > 400).cast("int").alias("pred"))
    wide = metrics.confusion_counts(rows, ["dataset"])
    one = F.col("c10") + F.col("c11")
    return wide.select("dataset", (F.col("c00") + F.col("c01") + one).alias("n"), F.col("c11").alias("hits"), one.alias("support"))


# ---- run bookkeeping on orders and nations -------------------------------------------------

@query("resume_grid", """select n.n_name as dataset, s.seed, m.method from nation n cross join (values (303),(1303),(2303)) s(seed) cross join (values ('1-URGENT'),('2-HIGH')) m(method)
where not exists (select 1 from orders o join customer c on o.o_custkey = c.c_custkey where c.c_nationkey = n.n_nationkey and o.o_orderpriority = m.method and (o.o_orderkey % 3) * 1000 + 303 = s.seed and o.o_orderstatus = 'P' and o.o_totalprice > 250000)""")
def resume_grid(spark, sf):
    nation = table(spark, sf, "nation")
    grid = nation.select(F.col("n_name").alias("dataset"), F.explode(F.array(*[F.lit(s) for s in (303, 1303, 2303)])).alias("seed")).select(
        "dataset", "seed", F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("method"))
    o = table(spark, sf, "orders").where("o_orderstatus = 'P' and o_totalprice > 250000")
    c = table(spark, sf, "customer")
    done = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("dataset"), ((F.col("o_orderkey") % 3) * 1000 + 303).cast("int").alias("seed"),
        F.col("o_orderpriority").alias("method"))
    return summary.pending_runs(grid, done, ["dataset", "seed", "method"])


@query("complete_scenarios", """select o_custkey as scenario, 3 - count(distinct o_orderkey % 5) filter (where o_orderkey % 5 < 3) as missing,
  count(distinct o_orderkey % 5) filter (where o_orderkey % 5 < 3) = 3 as complete from orders group by o_custkey""")
def complete_scenarios(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("scenario"), (F.col("o_orderkey") % 5).alias("seed"))
    return summary.complete_groups(o, ["scenario"], [0, 1, 2])


@query("manifest_upsert", """select coalesce(b.o_custkey, a.c_custkey) as key, case when b.o_custkey is not null then 'orders' else a.c_mktsegment end as source, coalesce(b.v, a.c_acctbal) as v
 from customer a full join (select o_custkey, max(o_totalprice) as v from orders group by 1) b on a.c_custkey = b.o_custkey""")
def manifest_upsert(spark, sf):
    cur = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("source"), F.col("c_acctbal").alias("v"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(
        F.max("o_totalprice").alias("v")).withColumn("source", F.lit("orders"))
    return tables.upsert(cur, new, ["key"])


@query("aligned_append", """select s_suppkey as key, s_name as name, s_acctbal as balance, null::varchar as segment from supplier
 union all select c_custkey, c_name, null, c_mktsegment from customer""")
def aligned_append(spark, sf):
    cols = ["key", "name", "balance", "segment"]
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                                            F.col("s_acctbal").alias("balance"), "s_nationkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                            F.col("c_mktsegment").alias("segment"), "c_nationkey")
    types = {"segment": "string"}
    return tables.align(s, cols, types).unionByName(tables.align(c, cols, types))


@query("priority_read", """select o_custkey as key, arg_max(o_totalprice, (p, o_orderkey)) as v from (
  select o_custkey, o_totalprice, o_orderkey, case o_orderstatus when 'F' then 3 when 'O' then 2 else 1 end as p from orders) group by 1""")
def priority_read(spark, sf):
    o = table(spark, sf, "orders")

    def source(status):
        part = o.where(F.col("o_orderstatus") == status)
        return part.groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("o_totalprice", "o_orderkey").alias("v"))

    return tables.read_first([source("F"), source("O"), source("P")], ["key"])


@query("dedupe_last", """select o_custkey, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as o_totalprice
 from orders group by 1, 2""")
def dedupe_last(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice",
                                          F.struct("o_orderdate", "o_orderkey").alias("at"))
    return ranking.keep_last(o, ["o_custkey", "o_orderpriority"], "at").drop("at")


@query("set_difference", "select distinct c_custkey as key from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def set_difference(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    o = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("key"))
    return c.join(o, "key", "left_anti").distinct()


@query("legacy_lookup", rounded_sql("""with t as (select 'main' as tb, o_orderpriority as key, o_orderkey as ord, o_totalprice / 1e5::double as a, o_totalprice / 2e5::double as m from orders where o_orderstatus = 'F'
 union all select 'ext', o_orderpriority || '_all', o_orderkey, o_totalprice / 3e5::double, o_totalprice / 4e5::double from orders where o_orderstatus = 'O' and o_orderpriority < '4'),
f as (select tb, key, arg_min(a, ord) as a, arg_min(m, ord) as m from t group by 1, 2),
s as (select distinct o_orderpriority as backbone, o_orderstatus as dataset from orders)
select s.backbone, s.dataset, f.a as legacy_raw_accuracy_mean, f.m as legacy_raw_macro_f1_4_mean, case when f.tb is null then '' when s.dataset = 'F' then 'same protocol' else 'other protocol' end as legacy_raw_protocol
from s left join f on f.tb = case when s.dataset = 'F' then 'main' else 'ext' end and f.key = case when s.dataset = 'F' then s.backbone else s.backbone || '_all' end""",
    "legacy_raw_accuracy_mean legacy_raw_macro_f1_4_mean"))
def legacy_lookup(spark, sf):
    o = table(spark, sf, "orders")

    def lookup(part, key, a, m):
        return part.select(key.alias("lookup_key"), F.col("o_orderkey").alias("ord"),
                           (F.col("o_totalprice") / a).alias("accuracy_mean"), (F.col("o_totalprice") / m).alias("macro_f1_4_mean"))

    pr = F.col("o_orderpriority")
    lookups = {"main": lookup(o.where("o_orderstatus = 'F'"), pr, 1e5, 2e5),
               "ext": lookup(o.where("o_orderstatus = 'O' and o_orderpriority < '4'"), F.concat(pr, F.lit("_all")), 3e5, 4e5)}
    rows = o.select(pr.alias("backbone"), F.col("o_orderstatus").alias("dataset")).distinct()
    main = F.col("dataset") == "F"
    rules = [(main, "main", F.col("backbone"), "same protocol"),
             (~main, "ext", F.concat("backbone", F.lit("_all")), "other protocol")]
    return rounded(summary.legacy_lookup(rows, lookups, rules))


@query("run_metadata", f"""with {SCORED} select dataset, string_agg(distinct (k % 3)::varchar, ' ' order by (k % 3)::varchar) as seeds, {", ".join(f"count(*) filter (where y = {c}) as {n}" for c, n in enumerate(CLASS_NAMES))}
 from scored group by dataset""")
def run_metadata(spark, sf):
    ev = scored_events(spark, sf).withColumn("seed", F.col("k") % 3)
    doc = tables.run_metadata(ev, metrics.class_counts(ev, ["dataset"]))
    return doc.select("dataset", F.array_join(F.col("seeds").cast("array<string>"), " ").alias("seeds"),
                      *[F.element_at("class_counts", c).alias(c) for c in CLASS_NAMES])
