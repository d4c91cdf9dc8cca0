"""Composed jobs: model fits, run scoring, sweeps and audits over the embeddings."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.catalog.events import cells_sql, metrics_sql
from pulsegrid.catalog.roles import DATASETS, ROLE_SEEDS, beats, probs, role_of, rounded, rounded_sql, softmax_sql
from pulsegrid.catalog.vectors import (
    ADAPTER,
    PAIRED,
    PROBS,
    PQ_COLUMNS,
    QUALITY,
    ROLLUP,
    RUN,
    argmax_sql,
    fuse_sql,
)
from pulsegrid.functions import arrays as A
from pulsegrid.operators import summary
from pulsegrid.plans import decoders, models, runs, selection
from pulsegrid.schema import SEEDS
from pulsegrid.session import concurrently, pin, spread

#: Rows of a task of a model job.
ROWS_A_TASK = 32_768

CHOSEN = """chs as (select *, row_number() over (partition by dataset, family, method, seed order by round(key1, 10) desc, round(key2, 10) desc, round(accuracy, 10) desc, cand) as r from gr),
pol as (select c.dataset, c.family, c.method, c.seed, c.alpha, d.decoder, d.power, d.mult from chs c join dec d on d.dataset = c.dataset and d.seed = c.seed and d.decoder = case when c.dataset = 'MIT-BIH' then 'clinical_default' else c.decoder end where c.r = 1)"""
TESTED = f"""tf as (select lg.*, pol.alpha, pol.decoder, pol.power, pol.mult, {fuse_sql('pol.alpha')} as sc from lg join pol using (dataset, family, method, seed) where role = 'test'),
tp as (select *, {softmax_sql('sc')} as p from tf),
tz as (select *, list_transform(range(1, 6), lambda i: pow(p[i], power) * mult[i]) as z from tp),
ts as (select *, {argmax_sql('z')} as pred, {argmax_sql('p_backbone')} as raw_pred from tz)"""


def _staged(name):
    col = {"raw": "raw_pred", "adapted": "pred"}[name]
    text = metrics_sql("dataset, family, method, seed", cells_sql("dataset, family, method, seed", "ts", col))
    for old in ("m_ as", "mf_ as", "mrow as"):
        text = text.replace(old, f"{name}_{old}")
    return text.replace("from m_)", f"from {name}_m_)").replace("from mf_)", f"from {name}_mf_)")


def _counts_json(role):
    cells = ", ',".join(f"\"{c}\":', count(*) filter (where role = '{role}' and y = {i})" for i, c in enumerate("NSVFQ"))
    return "concat('{" + cells + ", '}')"


@query("score_runs", rounded_sql(f"""with {ADAPTER}, {CHOSEN}, {TESTED}, {_staged('raw')}, {_staged('adapted')}
select a.dataset, a.family, a.method, a.seed, pol.alpha as selected_alpha, pol.decoder as selected_decoder, a.macro_f1_4, a.accuracy, a.F1_S, r.macro_f1_4 as raw_macro_f1_4, a.macro_f1_4 - r.macro_f1_4 as delta_macro_f1_4, (cnt.n0 + cnt.n1 + cnt.n2 + cnt.n3 + cnt.n4)::bigint as train_size, pc.val_size, pc.test_size, pc.val_counts, pc.test_counts
 from adapted_mrow a join raw_mrow r using (dataset, family, method, seed) join pol using (dataset, family, method, seed) join cnt on cnt.dataset = a.dataset and cnt.seed = a.seed
 join (select dataset, family, method, seed, count(*) filter (where role = 'val') as val_size, count(*) filter (where role = 'test') as test_size,
  {_counts_json('val')} as val_counts, {_counts_json('test')} as test_counts from probs group by all) pc using (dataset, family, method, seed)""",
    "macro_f1_4 accuracy F1_S raw_macro_f1_4 delta_macro_f1_4"))
def score_runs(spark, sf):
    """Adapter choice on validation rows, decoding of the test rows and one detail row per run."""
    p = probs(spark, sf)
    fit = p.where("role = 'fit' and method = 'logistic_raw'").select("dataset", "seed", "y")
    out = runs.score_runs(p, fit)
    return rounded(out.select(*RUN, "selected_alpha", "selected_decoder", "macro_f1_4", "accuracy", "F1_S",
                              "raw_macro_f1_4", "delta_macro_f1_4", "train_size", "val_size", "test_size", "val_counts", "test_counts"))


def _base(df):
    return df.withColumn("x", A.lead_summary(F.col("b0"), F.col("b1")))


def _seeded(spark, sf, seeds=ROLE_SEEDS):
    """Beats with a role for each seed, and the base features."""
    rows = _base(beats(spark, sf)).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return rows.withColumn("role", role_of(F.col("seed"), F.col("beat_id")))


@query("evidence_model")
def evidence_model(spark, sf):
    """Prototype evidence from fit rows, class-weighted extra-trees of every seed, probability rows for the others."""
    ev = runs.evidence_probabilities(_seeded(spark, sf), keys=["seed"])
    return rounded(ev.select("dataset", "seed", "role", "beat_id", "y", *[F.col("p_evidence")[c].alias(f"p{c}") for c in range(5)]))


@query("baseline_models")
def baseline_models(spark, sf):
    """Probability rows of all raw baselines, fitted on the fit rows of every seed."""
    rows = _seeded(spark, sf).withColumn("features", F.concat("b0", "b1")).select("seed", "role", "beat_id", "y", "features")
    rows = pin(spread(rows, "seed", "beat_id", rows=ROWS_A_TASK))
    fit, rest = rows.where("role = 'fit'"), rows.where("role <> 'fit'")

    def one(name):
        p = models.fit_predict(name, fit, rest, ["seed"])
        return pin(p.select(F.lit(name).alias("model"), "seed", "beat_id", "y", A.argmax(F.col("p")).alias("pred"), A.total(F.col("p")).alias("total")))

    # boosting has a task a run: the other models fill the cores beside it
    return rounded(reduce(DataFrame.unionByName, concurrently(spark, one, sorted(models.BASELINES, key=lambda n: n != "boosting"), 2)))


@query("baseline_scores", rounded_sql(f"""with {PROBS}, rp as (select *, {argmax_sql('p_backbone')} as pred from probs where role = 'test'),
{metrics_sql('dataset, method, seed', cells_sql('dataset, method, seed', 'rp', 'pred'))}
select dataset, method as model, seed, macro_f1_4, accuracy, F1_S, F1_V, F1_F from mrow""", "macro_f1_4 accuracy F1_S F1_V F1_F"))
def baseline_scores(spark, sf):
    """Metric rows of the raw baselines per dataset, model and seed, from their stored probabilities."""
    rows = probs(spark, sf).where("role = 'test'").select(
        "dataset", F.col("method").alias("model"), "seed", "y", A.argmax(F.col("p_backbone")).alias("pred"))
    return rounded(runs.prediction_metrics(rows).select("dataset", "model", "seed", "macro_f1_4", "accuracy", "F1_S", "F1_V", "F1_F"))


@query("baseline_evaluation")
def baseline_evaluation(spark, sf):
    """Raw baselines fitted on one dataset and scored on the two others, two seeds."""
    rows = beats(spark, sf).withColumn("features", F.concat("b0", "b1")).select("dataset", "beat_id", "y", "features")
    rows = pin(spread(rows, "beat_id", rows=ROWS_A_TASK))
    train, tests = rows.where("dataset = 'MIT-BIH'"), rows.where("dataset <> 'MIT-BIH'")
    out = runs.baseline_evaluation(train, tests, models.BASELINES, ROLE_SEEDS)
    return rounded(out.select("dataset", "model", "seed", "macro_f1_4", "accuracy", "F1_S", "F1_V", "F1_F"))


@query("full_run")
def full_run(spark, sf):
    """All datasets, methods and both protocols of one seed: splits, prototypes, forests, backbones, adapter, detail rows."""
    rows = pin(_base(beats(spark, sf)))
    out = None
    for protocol in ("record", "beat"):
        detail = runs.full_run(rows, DATASETS, models.BASELINES, SEEDS[:1], protocol=protocol)
        out = detail if out is None else out.unionByName(detail)
    return rounded(out.select("dataset", "method", "seed", "protocol", "selected_decoder", "accuracy", "macro_f1_4", "raw_macro_f1_4", "delta_macro_f1_4"))


@query("sensitivity_sweep")
def sensitivity_sweep(spark, sf):
    """Adapter scores of all methods and seeds under every class-cost profile."""
    out = pin(runs.cost_sweep(_seeded(spark, sf), probs(spark, sf)))
    return rounded(summary.cost_rollup(out))


@query("config_sweep")
def config_sweep(spark, sf):
    """Named configurations of all seeds, argmax and decoded."""
    out = runs.config_sweep(_seeded(spark, sf), runs.SWEEP)
    return rounded(out.select("dataset", "seed", "config_name", "stage", "macro_f1_4", "accuracy", "changed_samples"))


@query("external_validation")
def external_validation(spark, sf):
    """Strict, record-augmented and S-focused scenarios, all settings and seeds."""
    rows = pin(_base(beats(spark, sf)))
    of = {d: rows.where(F.col("dataset") == d) for d in DATASETS}
    base = of["MIT-BIH"].where("record % 2 = 0")
    tests = {"MIT_DS2": of["MIT-BIH"].where("record % 2 = 1"), "INCART_all": of["INCART"], "SVDB_all": of["SVDB"]}
    augmented = {"record_augmented": ("INCART", of["INCART"]), "record_augmented_s_focus": ("SVDB", of["SVDB"])}
    out = runs.external_validation(runs.external_rows(base, tests, augmented), SEEDS[:3])
    return rounded(out.select("scenario", "train_data", "test_data", "trees", "subset", "seed", "cand", "mode", "selection_metric",
                              "macro_f1_4", "macro_f1_3_nsv", "accuracy", "is_best"))


@query("calibration_audit", rounded_sql(f"""with {ADAPTER}, {CHOSEN}, {TESTED},
st as (select dataset, method, seed, y, 'raw' as source, p_backbone as p from ts union all select dataset, method, seed, y, 'adapted', z from ts),
{QUALITY}, {PAIRED}, {ROLLUP}""", PQ_COLUMNS))
def calibration_audit(spark, sf):
    """Adapter scores of the test rows, paired quality and its roll-up."""
    p = probs(spark, sf)
    fit = p.where("role = 'fit'")
    pol = pin(decoders.packed_decoders(fit, RUN))
    chosen = pin(selection.select_adapter(selection.adapter_grid(p.where("role = 'val'"), pol, RUN), pol, RUN))
    scored = selection.apply_adapter(p.where("role = 'test'"), chosen, RUN)
    rows, _ = runs.calibration_audit(scored)
    names = [c for c in rows.columns if c.split("_")[0] in ("raw", "adapted", "delta")]
    return rounded(summary.calibration_rollup(rows, names))
