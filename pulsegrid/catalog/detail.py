"""Queries over the run table derived from lineitem: summaries, outliers, statistics, analysis tables."""

from pyspark.sql import functions as F

from pulsegrid.catalog import SQL, query
from pulsegrid.catalog.roles import DELTAS, DETAIL, DETAIL_METRICS, hash_sql, rounded, rounded_sql, run_detail, table
from pulsegrid.operators import contracts, ranking, reshape, statistics, summary
from pulsegrid.plans import derived
from pulsegrid.session import pin

KEYS = ["dataset", "family", "method"]
METRICS = [*DETAIL_METRICS, *[f"delta_{m}" for m in DELTAS]]
_MS = ", ".join(f"avg({m}) as {m}_mean, stddev_pop({m}) as {m}_std" for m in METRICS)
_COLS = " ".join(f"{m}_{s}" for m in METRICS for s in ("mean", "std"))
_KEYSQL = "dataset, family, method"
SUMMARY = f"""sm as (select {_KEYSQL}, count(distinct seed) as n_seeds, string_agg(distinct seed::varchar, ' ' order by seed::varchar) as seeds, {_MS} from detail group by all)"""


def _summary(spark, sf):
    return summary.group_summary(run_detail(spark, sf), KEYS, METRICS)


@query("run_summary", rounded_sql(f"with {DETAIL}, {SUMMARY} select * from sm", _COLS))
def run_summary(spark, sf):
    return rounded(_summary(spark, sf))


@query("nan_summary", rounded_sql(f"""with {DETAIL}, d as (select dataset, method, seed, case when seed <= 2 then null when family = 'F' then null else macro_f1_4 end as v, l.label from detail, (select 'x' as label) l)
select case when method = 'm3' then null else method end as method, count(distinct seed) as n_seeds, string_agg(distinct seed::varchar, ' ' order by seed::varchar) as seeds, string_agg(distinct dataset, ' ' order by dataset) as dataset_values,
 avg(v) as v_mean, stddev_pop(v) as v_std from d group by 1""", "v_mean v_std"))
def nan_summary(spark, sf):
    """NaN is skipped by the mean and a null key stays a group."""
    d = run_detail(spark, sf).select(
        "dataset", F.when(F.col("method") != "m3", F.col("method")).alias("method"), "seed",
        F.when(F.col("seed") <= 2, F.lit(float("nan"))).when(F.col("family") == "F", F.lit(None)).otherwise(F.col("macro_f1_4")).alias("v"))
    return rounded(summary.group_summary(d, ["method"], ["v"], texts=["dataset"]))


COST = "cst as (select dataset, method, list_extract(['no_cost','balanced','moderate_tail','default_cost','strong_tail'], (seed % 5)::int + 1) as class_cost_profile, macro_f1_4, delta_macro_f1_4, accuracy, F1_S, F1_F from detail)"


def _costs(spark, sf):
    names = F.array(*[F.lit(p) for p in ("no_cost", "balanced", "moderate_tail", "default_cost", "strong_tail")])
    return run_detail(spark, sf).withColumn("class_cost_profile", F.get(names, F.col("seed") % 5))


@query("cost_rollup", rounded_sql(f"""with {DETAIL}, {COST} select case when grouping(dataset) = 0 then dataset else 'Overall' end as dataset, case when grouping(dataset) = 0 then method else 'All representatives' end as method, class_cost_profile, count(*) as n_runs,
 avg(macro_f1_4) as macro_f1_4_mean, stddev_pop(macro_f1_4) as macro_f1_4_std, avg(delta_macro_f1_4) as delta_macro_f1_4_mean, avg(accuracy) as accuracy_mean, avg(F1_S) as F1_S_mean, avg(F1_F) as F1_F_mean
 from cst group by grouping sets ((cst.dataset, cst.method, class_cost_profile), (class_cost_profile))""", "macro_f1_4_mean macro_f1_4_std delta_macro_f1_4_mean accuracy_mean F1_S_mean F1_F_mean"))
def cost_rollup(spark, sf):
    return rounded(summary.cost_rollup(_costs(spark, sf)))


@query("cost_profile_order", rounded_sql(f"""with {DETAIL}, {COST} select class_cost_profile, list_position(['no_cost','balanced','moderate_tail','default_cost','strong_tail'], class_cost_profile)::bigint as ord,
 case class_cost_profile when 'no_cost' then 'No cost' when 'balanced' then 'Balanced' when 'moderate_tail' then 'Moderate tail' when 'default_cost' then 'Default' else 'Strong tail' end as profile_label, avg(macro_f1_4) as macro_f1_4_mean from cst group by all""", "macro_f1_4_mean"))
def cost_profile_order(spark, sf):
    order = ["no_cost", "balanced", "moderate_tail", "default_cost", "strong_tail"]
    labels = {"no_cost": "No cost", "balanced": "Balanced", "moderate_tail": "Moderate tail", "default_cost": "Default", "strong_tail": "Strong tail"}
    top = summary.cost_rollup(_costs(spark, sf)).where(F.col("dataset") == summary.ALL_DATASETS)
    rows = top.select("class_cost_profile", reshape.order_in("class_cost_profile", order).alias("ord"),
                      reshape.recode("class_cost_profile", labels).alias("profile_label"), "macro_f1_4_mean")
    return rounded(rows.orderBy("ord"))


@query("best_per_group", rounded_sql(f"""with {DETAIL}, c as (select dataset, case when seed % 2 = 0 then 's_focus_x' else 'strict' end as scenario, family || method as config, seed, macro_f1_4, F1_S, accuracy from detail where not (method = 'm1' and seed = 1)),
g as (select scenario, dataset, config, count(distinct seed) as n_seeds, avg(macro_f1_4) as macro_f1_4_mean, avg(F1_S) as macro_f1_3_nsv_mean, avg(accuracy) as accuracy_mean from c group by all),
m as (select *, max(n_seeds) over (partition by scenario, dataset) as mx, max((n_seeds = 4)::int) over (partition by scenario, dataset) as has4 from g),
k as (select *, case when scenario like '%s_focus%' then macro_f1_3_nsv_mean else macro_f1_4_mean end as sc from m where case when has4 = 1 then n_seeds = 4 else n_seeds = mx end),
r as (select *, row_number() over (partition by scenario, dataset order by sc desc, accuracy_mean desc, config) as r from k)
select scenario, dataset, config, n_seeds, macro_f1_4_mean, macro_f1_3_nsv_mean, accuracy_mean, case when scenario like '%s_focus%' then 'macro_f1_3_nsv_mean' else 'macro_f1_4_mean' end as selection_metric from r where r = 1""",
    "macro_f1_4_mean macro_f1_3_nsv_mean accuracy_mean"))
def best_per_group(spark, sf):
    d = run_detail(spark, sf).where("not (method = 'm1' and seed = 1)").select(
        "dataset", F.when(F.col("seed") % 2 == 0, "s_focus_x").otherwise("strict").alias("scenario"),
        F.concat("family", "method").alias("config"), "seed", "macro_f1_4", F.col("F1_S").alias("macro_f1_3_nsv"), "accuracy")
    g = d.groupBy("scenario", "dataset", "config").agg(
        F.countDistinct("seed").alias("n_seeds"), *summary.mean_std(["macro_f1_4", "macro_f1_3_nsv", "accuracy"], std=False))
    return rounded(summary.best_summary(g, ["scenario", "dataset"], 4))


@query("ranked_report", rounded_sql(f"with {DETAIL}, {SUMMARY} select row_number() over (partition by dataset order by macro_f1_4_mean desc, delta_macro_f1_4_mean desc, accuracy_mean desc)::int as rank, {_KEYSQL}, macro_f1_4_mean, round(macro_f1_4_mean * 100, 2) as macro_pct from sm", "macro_f1_4_mean"))
def ranked_report(spark, sf):
    rows = ranking.ranked(_summary(spark, sf), ["dataset"], [F.desc("macro_f1_4_mean"), F.desc("delta_macro_f1_4_mean"), F.desc("accuracy_mean")])
    return rounded(rows.select("rank", *KEYS, "macro_f1_4_mean", reshape.percent("macro_f1_4_mean").alias("macro_pct")))


@query("topk_per_dataset", rounded_sql(f"with {DETAIL}, {SUMMARY}, r as (select *, row_number() over (partition by dataset order by macro_f1_4_mean desc, family, method)::int as rank from sm) select dataset, family, method, rank, macro_f1_4_mean from r where rank <= 5", "macro_f1_4_mean"))
def topk_per_dataset(spark, sf):
    rows = ranking.top_k(_summary(spark, sf), ["dataset"], [F.desc("macro_f1_4_mean"), "family", "method"], 5)
    return rounded(rows.select(*KEYS, "rank", "macro_f1_4_mean"))


FLAGS = f"""qt as (select {_KEYSQL}, quantile_cont(macro_f1_4, 0.25) as q1, quantile_cont(macro_f1_4, 0.5) as median, quantile_cont(macro_f1_4, 0.75) as q3, count(distinct seed) as n_seeds_before, count(*) as n from detail group by all),
fl0 as (select d.*, q1, median, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower, q3 + 1.5 * (q3 - q1) as upper, n_seeds_before, qt.n as n from detail d join qt using (dataset, family, method)),
fl1 as (select *, macro_f1_4 < lower or macro_f1_4 > upper as isout from fl0),
fl as (select *, not isout as kept, (count(*) filter (where not isout) over (partition by {_KEYSQL}))::bigint as n_seeds_after from fl1)"""


def _flags(spark, sf):
    return summary.outlier_flags(pin(run_detail(spark, sf)), KEYS)


@query("iqr_outliers", rounded_sql(f"with {DETAIL}, {FLAGS} select {_KEYSQL}, seed, macro_f1_4, q1, q3, iqr, lower, upper, median, n_seeds_before, n_seeds_after, 'macro_f1_4_iqr_outlier' as reason from fl where not kept",
    "macro_f1_4 q1 q3 iqr lower upper median"))
def iqr_outliers(spark, sf):
    return rounded(_flags(spark, sf).where("not kept").select(
        *KEYS, "seed", "macro_f1_4", "q1", "q3", "iqr", "lower", "upper", "median", "n_seeds_before", "n_seeds_after", "reason"))


OM = ["macro_f1_4", "accuracy", "F1_S", "F1_F"]
OSUM = f"""os as (select {_KEYSQL}, max(n_seeds_before) as n_seeds_before, count(distinct seed) filter (where kept) as n_seeds_after, coalesce(string_agg(distinct seed::varchar, ' ' order by seed::varchar) filter (where not kept), '') as removed_seeds,
 string_agg(distinct seed::varchar, ' ' order by seed::varchar) filter (where kept) as seeds_after, {", ".join(f"avg({m}) filter (where kept) as {m}_mean, stddev_pop({m}) filter (where kept) as {m}_std" for m in OM)} from fl group by all)"""
_OC = " ".join(f"{m}_{s}" for m in OM for s in ("mean", "std"))


@query("outlier_summary", rounded_sql(f"with {DETAIL}, {FLAGS}, {OSUM} select * from os", _OC))
def outlier_summary(spark, sf):
    return rounded(summary.outlier_summary(_flags(spark, sf), KEYS, OM))


@query("robustness_join", rounded_sql(f"""with {DETAIL}, {SUMMARY}, {FLAGS}, {OSUM} select {_KEYSQL}, {", ".join(f"a.{m}_mean as full_{m}, b.{m}_mean as no_outlier_{m}, (b.{m}_mean - a.{m}_mean) * 100 as change_{m}" for m in OM)},
 n_seeds_before, n_seeds_after, removed_seeds, n_seeds_before - n_seeds_after as removed_count from sm a left join (select * from os where dataset <> 'R') b using (dataset, family, method)""", " ".join(f"{p}_{m}" for m in OM for p in ("full", "no_outlier", "change"))))
def robustness_join(spark, sf):
    d = pin(run_detail(spark, sf))
    filtered = summary.outlier_summary(summary.outlier_flags(d, KEYS), KEYS, OM).where("dataset <> 'R'")
    return rounded(summary.robustness_join(summary.group_summary(d, KEYS, OM), filtered, KEYS, OM))


@query("removed_groups", f"with {DETAIL}, {FLAGS}, {OSUM} select dataset, n_seeds_before - n_seeds_after as removed_count, count(*) as groups from os group by all")
def removed_groups(spark, sf):
    d = pin(run_detail(spark, sf))
    filtered = summary.outlier_summary(summary.outlier_flags(d, KEYS), KEYS, OM)
    return derived.removed_groups(summary.robustness_join(summary.group_summary(d, KEYS, OM), filtered, KEYS, OM))


@query("compare_summaries", rounded_sql(f"with {DETAIL}, {SUMMARY}, {FLAGS}, {OSUM} select a.dataset, avg(a.macro_f1_4_mean) * 100 as before, avg(b.macro_f1_4_mean) * 100 as after, (avg(b.macro_f1_4_mean) - avg(a.macro_f1_4_mean)) * 100 as change from sm a join os b using (dataset, family, method) group by rollup (a.dataset)", "before after change"))
def compare_summaries(spark, sf):
    d = pin(run_detail(spark, sf))
    after = summary.outlier_summary(summary.outlier_flags(d, KEYS), KEYS, OM)
    return rounded(summary.compare_summaries(summary.group_summary(d, KEYS, OM), after, KEYS, "macro_f1_4_mean", "dataset"))


@query("contracts", f"""with {DETAIL}, {FLAGS}, g as (select {_KEYSQL}, count(distinct seed) as s, count(*) as n, count(distinct seed) filter (where kept) as k from fl group by all)
select 'rows' as check, 420 as expected, sum(n)::bigint as actual, sum(n) = 420 as ok from g union all select 'groups', 60, count(*), count(*) = 60 from g
 union all select 'groups_with_wrong_seed_count', 0, count(*) filter (where s <> 7), count(*) filter (where s <> 7) = 0 from g
 union all select 'kept_plus_removed', (select count(*) from detail), (select count(*) from fl), (select count(*) from detail) = (select count(*) from fl)
 union all select 'min_retained_seeds', 3, min(k), min(k) >= 3 from g union all select 'keys_on_both_sides', 0, 0, true""")
def all_contracts(spark, sf):
    d = pin(run_detail(spark, sf))
    flags = pin(summary.outlier_flags(d, KEYS))
    return contracts.detail_contracts(d, KEYS, 420, 60, 7).unionByName(contracts.outlier_contracts(d, flags, KEYS))


GAINS = "gn as (select dataset, method, avg(delta_macro_f1_4) as gain from detail group by all)"


def _gains(spark, sf):
    return statistics.group_gains(run_detail(spark, sf))


@query("group_gain", rounded_sql(f"with {DETAIL}, {GAINS} select * from gn", "gain"))
def group_gain(spark, sf):
    return rounded(_gains(spark, sf))


@query("paired_t", rounded_sql(f"with {DETAIL}, {GAINS} select count(gain) as n, avg(gain) as mean, avg(gain) / (stddev_samp(gain) / sqrt(count(gain))) as t, avg(gain) / stddev_samp(gain) as cohen_dz from gn", "mean t cohen_dz"))
def paired_t(spark, sf):
    return rounded(statistics.paired_t(_gains(spark, sf), with_p=False))


@query("variance_components", rounded_sql(f"""with {DETAIL}, {GAINS}, md as (select dataset, avg(gain) as md from gn group by 1), mm as (select method, avg(gain) as mm from gn group by 1), g as (select avg(gain) as g, count(*) as n from gn),
s as (select (select count(*) from md)::double as d, (select count(*) from mm)::double as m, (select var_pop(mm) from mm) as vm, (select sum(pow(gain - md - mm + (select g from g), 2)) from gn join md using (dataset) join mm using (method)) as ssr),
v as (select d, m, d * m * vm as ssm, d * m * vm / (m - 1) as msm, ssr, ssr / ((d - 1) * (m - 1)) as msr from s),
c as (select d, m, case when msm >= msr then (msm - msr) / d else 0 end as method_var, case when msm >= msr then msr else (ssm + ssr) / (d * (m - 1)) end as residual_var from v),
e as (select *, method_var + residual_var as total_var, method_var / (method_var + residual_var) as icc_method, sqrt((method_var + residual_var / d) / m) as se_mean_gain, (select g from g) as mean_gain, (select n from g) as n_obs from c)
select n_obs, d::bigint as n_datasets, m::bigint as n_methods, mean_gain, se_mean_gain, (select arg_min(md, dataset) from md) as reference_dataset_gain, sqrt(total_var / m) as se_intercept, method_var * 1e4 as method_var, residual_var * 1e4 as residual_var, total_var * 1e4 as total_var, icc_method,
 n_obs / m as mean_cluster_size, 1 + (n_obs / m - 1) * icc_method as design_effect, n_obs / (1 + (n_obs / m - 1) * icc_method) as effective_n, mean_gain - 1.959963984540054::double * se_mean_gain as mean_gain_ci_low, mean_gain + 1.959963984540054::double * se_mean_gain as mean_gain_ci_high from e""",
    "mean_gain se_mean_gain reference_dataset_gain se_intercept method_var residual_var total_var icc_method mean_cluster_size design_effect effective_n mean_gain_ci_low mean_gain_ci_high"))
def variance_components(spark, sf):
    vc = statistics.variance_components(pin(_gains(spark, sf)), with_p=False)
    for c in ("method_var", "residual_var", "total_var"):
        vc = vc.withColumn(c, F.col(c) * 1e4)
    return rounded(vc)


def _boot_sql(col):
    seed = f"'{statistics.BOOT_SEED}'"
    return f"""(with cl as (select {col} as k, sum(gain) as s, count(*) as c from gn group by 1), ar as (select list(s order by k) as ss, list(c order by k) as cc, count(*) as kk from cl),
 dr as (select rep, ss[({hash_sql(seed, 'rep', 'j')} % kk) + 1] as s, cc[({hash_sql(seed, 'rep', 'j')} % kk) + 1] as c, kk from ar, (select range as rep from range(10000)) r, (select range as j from range(64)) jj where j < kk),
 mn as (select rep, sum(s) / sum(c) as m, max(kk) as kk from dr group by rep)
 select '{col}' as cluster, max(kk) as n_clusters, avg(m) as boot_mean, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high, avg((m > 0)::int) as frac_positive from mn)"""


@query("cluster_bootstrap", rounded_sql(f"with {DETAIL}, {GAINS} {_boot_sql('dataset')} union all {_boot_sql('method')}".replace(f"{GAINS} (with", f"{GAINS} select * from (with", 1), "boot_mean ci_low ci_high frac_positive"))
def cluster_bootstrap(spark, sf):
    g = pin(_gains(spark, sf))
    return rounded(statistics.cluster_bootstrap(g, "dataset").unionByName(statistics.cluster_bootstrap(g, "method")))


@query("hierarchical_table")
def hierarchical_table(spark, sf):
    return rounded(statistics.hierarchical_table(pin(_gains(spark, sf)), "record-level validation"))


@query("hierarchical_rows", f"""select b.*, 'record-level validation' as protocol, t.cohen_dz as naive_cohen_dz, t.n as n_means, v.icc_method, v.design_effect, v.effective_n,
 v.mean_gain as mixed_mean_gain, v.se_mean_gain as mixed_se, v.mean_gain_ci_low as mixed_ci_low, v.mean_gain_ci_high as mixed_ci_high
 from ({SQL["cluster_bootstrap"]}) b cross join ({SQL["paired_t"]}) t cross join ({SQL["variance_components"]}) v""")
def hierarchical_rows(spark, sf):
    """The same table without the p-values, which SQL has no function for."""
    return rounded(statistics.hierarchical_table(pin(_gains(spark, sf)), "record-level validation").drop("naive_t_p", "mixed_p"))


# ---- analysis tables -----------------------------------------------------------------------

FAM = {"F": "Machine learning", "O": "Deep/time-series"}
GAIN = """ga as (select dataset, case family when 'F' then 'Machine learning' else 'Deep/time-series' end as family_label, regexp_replace(method || '_raw', '_raw|raw_', '', 'g') as method_short,
 raw_macro_f1_4_mean * 100 as raw_mf1, macro_f1_4_mean * 100 as adapted_mf1, delta_macro_f1_4_mean * 100 as delta_mf1, delta_accuracy_mean * 100 as delta_acc, delta_F1_S_mean * 100 as delta_s, delta_F1_F_mean * 100 as delta_f from sm)"""


def _gain_table(spark, sf):
    s = _summary(spark, sf).withColumn("method", F.concat("method", F.lit("_raw")))
    return derived.gain_table(s, FAM)


@query("gain_table", rounded_sql(f"with {DETAIL}, {SUMMARY}, {GAIN} select * from ga", "raw_mf1 adapted_mf1 delta_mf1 delta_acc delta_s delta_f", 7))
def gain_table(spark, sf):
    return rounded(_gain_table(spark, sf), 7)


@query("gain_long", rounded_sql(f"with {DETAIL}, {SUMMARY}, {GAIN} select dataset, family_label, method_short, 'Raw' as stage, raw_mf1 as mf1 from ga union all select dataset, family_label, method_short, 'Adapted', adapted_mf1 from ga", "mf1", 7))
def gain_long(spark, sf):
    return rounded(derived.gain_long(_gain_table(spark, sf)), 7)


@query("best_labels", rounded_sql(f"with {DETAIL}, {SUMMARY}, {GAIN}, r as (select *, row_number() over (partition by dataset order by adapted_mf1 desc, family_label, method_short) as r from ga) select dataset, method_short, adapted_mf1, printf('%s %.1f%%', method_short, adapted_mf1) as label from r where r = 1", "adapted_mf1"))
def best_labels(spark, sf):
    return rounded(derived.best_labels(_gain_table(spark, sf)))


CP = [("F1", "S"), ("F1", "V"), ("F1", "F")]


@query("class_pattern", rounded_sql(f"with {DETAIL}, {SUMMARY} " + " union all ".join(
    f"select dataset, '{c}' as class, '{m}' as metric, avg(raw_{m}_{c}_mean) * 100 as raw, avg({m}_{c}_mean) * 100 as adapted, avg({m}_{c}_mean) * 100 - avg(raw_{m}_{c}_mean) * 100 as delta from sm group by dataset" for m, c in CP), "raw adapted delta"))
def class_pattern(spark, sf):
    return rounded(derived.class_pattern(_summary(spark, sf), ["F1"], ["S", "V", "F"]))


@query("pattern_columns", rounded_sql(f"with {DETAIL}, {SUMMARY} select dataset, avg(raw_F1_S_mean) as raw_F1_S_mean, avg(raw_F1_V_mean) as raw_F1_V_mean, avg(raw_F1_F_mean) as raw_F1_F_mean from sm group by dataset", "raw_F1_S_mean raw_F1_V_mean raw_F1_F_mean"))
def pattern_columns(spark, sf):
    s = _summary(spark, sf)
    cols = reshape.matching_columns(s, "^raw_(F1|Se|Pr)_[NSVFQ]_mean$")
    return rounded(s.groupBy("dataset").agg(*[F.avg(c).alias(c) for c in cols]))


@query("stage_tradeoff", rounded_sql(f"with {DETAIL} select dataset, family as stage, 'S' as class, avg(Pr_S) * 100 as Pr, avg(Se_S) * 100 as Se from detail group by all union all select dataset, family, 'F', avg(Pr_F) * 100, avg(Se_F) * 100 from detail group by all", "Pr Se"))
def stage_tradeoff(spark, sf):
    return rounded(derived.stage_tradeoff(run_detail(spark, sf).withColumnRenamed("family", "stage")))


@query("stage_class_f1", rounded_sql(f"with {DETAIL} " + " union all ".join(f"select dataset, family as stage, '{c}' as class, avg(F1_{c}) * 100 as F1 from detail group by all" for c in "SFV"), "F1"))
def stage_class_f1(spark, sf):
    return rounded(derived.stage_class_f1(run_detail(spark, sf).withColumnRenamed("family", "stage")))


@query("runtime_long", rounded_sql(f"with {DETAIL} " + " union all ".join(f"select {_KEYSQL}, seed, '{n}' as phase, {c} as seconds from detail" for c, n in derived.PHASES.items()), "seconds"))
def runtime_long(spark, sf):
    return rounded(derived.runtime_long(run_detail(spark, sf)))


@query("seed_sd", rounded_sql(f"with {DETAIL}, {SUMMARY} select dataset, family, median(macro_f1_4_std) * 100 as median_std from sm group by all", "median_std"))
def seed_sd(spark, sf):
    return rounded(derived.seed_sd(_summary(spark, sf)))


@query("final_vs_baselines", rounded_sql(f"""with {DETAIL}, {SUMMARY}, x as (select dataset || method as model, accuracy_mean, macro_f1_4_mean from sm where family = 'O' order by macro_f1_4_mean desc, model limit 1)
select * from x union all select family || dataset || method, accuracy_mean, macro_f1_4_mean from sm""", "accuracy_mean macro_f1_4_mean"))
def final_vs_baselines(spark, sf):
    s = _summary(spark, sf)
    ext = s.where("family = 'O'").withColumn("model", F.concat("dataset", "method"))
    return rounded(derived.final_vs_baselines(ext, s.withColumn("model", F.concat("family", "dataset", "method"))))


CONF = "cf as (select l_returnflag as dataset, l_linestatus as family, 'm' || (l_suppkey % 10) as method, unnest(['raw','adapted']) as stage, (l_partkey % 5)::int as y, unnest([(l_orderkey % 5)::int, case when l_discount > 0.05 then (l_partkey % 5)::int else (l_orderkey % 5)::int end]) as pred from lineitem)"


@query("strongest_baseline_confusions", rounded_sql(f"""with {DETAIL}, {SUMMARY}, {CONF}, b as (select dataset, arg_max(family, raw_macro_f1_4_mean) as family, arg_max(method, raw_macro_f1_4_mean) as method from sm group by 1),
c as (select dataset, stage, y, pred, count(*) as n from cf join b using (dataset, family, method) group by all)
select dataset, stage, y, pred, n, (sum(n) over (partition by dataset, stage, y))::bigint as row_total, n / sum(n) over (partition by dataset, stage, y) as row_share from c""", "row_share"))
def strongest_baseline_confusions(spark, sf):
    li = table(spark, sf, "lineitem")
    y, raw = (F.col("l_partkey") % 5).cast("int"), (F.col("l_orderkey") % 5).cast("int")
    staged = li.select(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("family"), F.concat(F.lit("m"), F.col("l_suppkey") % 10).alias("method"),
        y.alias("y"), F.explode(F.array(
            F.struct(F.lit("raw").alias("stage"), raw.alias("pred")),
            F.struct(F.lit("adapted").alias("stage"), F.when(F.col("l_discount") > 0.05, y).otherwise(raw).alias("pred")))).alias("s"))
    conf = staged.groupBy(*KEYS, "s.stage", "y", "s.pred").agg(F.count(F.lit(1)).alias("n"))
    return rounded(derived.strongest_baseline_confusions(_summary(spark, sf), conf))


@query("run_subset", f"with {DETAIL} select {_KEYSQL}, seed, n_rows from detail where dataset in ('A','N') and family = 'F' and lower(method) in ('m1','m7') and seed in (1,3,5) and method like '%m%'")
def run_subset(spark, sf):
    d = run_detail(spark, sf).withColumn("config", F.col("method"))
    return reshape.subset(d, ["A", "N"], ["F"], ["M1", "m7"], [1, 3, 5], "m").select(*KEYS, "seed", "n_rows")


@query("alias_columns", rounded_sql(f"with {DETAIL}, {SUMMARY} select {_KEYSQL}, accuracy_mean as adapted_accuracy_mean, delta_accuracy_mean as Delta_Acc_mean, 'same run' as raw_baseline_source from sm", "adapted_accuracy_mean Delta_Acc_mean"))
def alias_columns(spark, sf):
    out = reshape.alias_columns(_summary(spark, sf), {
        "adapted_accuracy_mean": "accuracy_mean", "Delta_Acc_mean": "delta_accuracy_mean", "absent": "no_such_column"}, raw_baseline_source="same run")
    return rounded(out.select(*KEYS, "adapted_accuracy_mean", "Delta_Acc_mean", "raw_baseline_source"))


@query("composite_keys", f"with {DETAIL} select concat_ws('|', dataset, family, method, seed) as key, n_rows from detail")
def composite_keys(spark, sf):
    return run_detail(spark, sf).select(reshape.composite_key(*KEYS, "seed").alias("key"), "n_rows")


# ---- decoder behaviour from JSON columns ----------------------------------------------------

DEC = """dj as (select dataset, family, method, seed, list_extract(['evidence_argmax','clinical_default','stable_prior','mild_prior','s_recovery','f_recovery','other'], (seed - 1)::int % 7 + 1) as selected_decoder,
 list_extract([0.2, 0.35, 0.5], (seed % 3)::int + 1)::double as selected_alpha, macro_f1_4, accuracy, n_rows from detail),
dl as (select *, case selected_decoder when 'evidence_argmax' then 'Evidence' when 'clinical_default' then 'Clinical' when 'stable_prior' then 'Stable prior' when 'mild_prior' then 'Mild prior' when 's_recovery' then 'S recovery' when 'f_recovery' then 'F recovery' else selected_decoder end as decoder_label from dj)"""


def _json_detail(spark, sf):
    d = run_detail(spark, sf)
    names = ["evidence_argmax", "clinical_default", "stable_prior", "mild_prior", "s_recovery", "f_recovery", "other"]
    return d.select(
        *KEYS, "seed", F.get(F.array(*[F.lit(n) for n in names]), (F.col("seed") - 1) % 7).alias("selected_decoder"),
        F.get(F.array(F.lit(0.2), F.lit(0.35), F.lit(0.5)), F.col("seed") % 3).alias("selected_alpha"),
        F.to_json(F.array("macro_f1_4", "accuracy", F.lit(1.0), F.col("seed").cast("double"), F.lit(1.0))).alias("selected_multiplier"),
        F.to_json(F.create_map(F.lit("N"), F.col("n_rows"), F.lit("S"), F.col("seed").cast("long"))).alias("train_counts"),
        F.when(F.col("seed") == 7, "").otherwise(F.to_json(F.array(
            F.struct(F.lit(None).cast("double").alias("alpha"), F.lit("clinical_default").alias("decoder"), F.col("macro_f1_4").alias("val_macro_f1_4")),
            F.struct(F.lit(0.5).alias("alpha"), F.lit("mystery").alias("decoder"), F.col("accuracy").alias("val_macro_f1_4"))))).alias("validation_table"))


@query("decoder_multipliers", rounded_sql(f"with {DETAIL}, {DEC} " + " union all ".join(
    f"select dataset, decoder_label, '{c}' as class, avg({e}) as multiplier from dl group by all" for c, e in (("N", "macro_f1_4"), ("S", "accuracy"), ("V", "1.0::double"), ("F", "seed::double"))), "multiplier"))
def decoder_multipliers(spark, sf):
    return rounded(derived.decoder_behaviour(_json_detail(spark, sf))["multipliers"])


@query("decoder_priors", rounded_sql(f"with {DETAIL}, {DEC} select dataset, 'N' as class, avg(n_rows / (n_rows + seed)) as prior from dl group by all union all select dataset, 'S', avg(seed / (n_rows + seed)) from dl group by all", "prior"))
def decoder_priors(spark, sf):
    return rounded(derived.decoder_behaviour(_json_detail(spark, sf))["priors"])


@query("candidate_rows", rounded_sql(f"with {DETAIL}, {DEC} select dataset, 'Clinical' as decoder_label, avg(macro_f1_4) * 100 as val_macro_f1_4_mean, stddev_samp(macro_f1_4) * 100 as val_macro_f1_4_sd from dl where seed <> 7 group by all union all select dataset, 'mystery', avg(accuracy) * 100, stddev_samp(accuracy) * 100 from dl where seed <> 7 group by all", "val_macro_f1_4_mean val_macro_f1_4_sd"))
def candidate_rows(spark, sf):
    return rounded(derived.decoder_behaviour(_json_detail(spark, sf))["candidates"])


@query("decoder_choice", f"with {DETAIL}, {DEC} select dataset, decoder_label, count(*) as n from dl group by all")
def decoder_choice(spark, sf):
    return derived.decoder_behaviour(_json_detail(spark, sf))["decoder_choice"]


@query("alpha_choice", f"with {DETAIL}, {DEC} select dataset, selected_alpha, count(*) as n from dl group by all")
def alpha_choice(spark, sf):
    return derived.decoder_behaviour(_json_detail(spark, sf))["alpha_choice"]
