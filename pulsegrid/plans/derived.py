"""Analysis tables derived from run details, confusions and selection tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.metrics import confusion_shares
from pulsegrid.operators.ranking import best_row
from pulsegrid.operators.reshape import (
    candidate_rows,
    clean_method,
    counts_long,
    multipliers_long,
    recode,
    split_name,
    to_long,
    to_wide,
)
from pulsegrid.schema import CLASS_NAMES

# Labels of the decoders and model families.
DECODER_LABELS = {
    "evidence_argmax": "Evidence", "clinical_default": "Clinical", "stable_prior": "Stable prior",
    "mild_prior": "Mild prior", "s_recovery": "S recovery", "f_recovery": "F recovery",
}
FAMILY_LABELS = {"raw_machine_learning": "Machine learning", "deep": "Deep/time-series"}
PHASES = {"backbone_train_time": "Backbone training", "evidence_train_time": "Evidence training",
          "predict_time": "Prediction"}


def share_of_group(count, *keys):
    return F.col(count) / F.sum(count).over(Window.partitionBy(*keys))


def dataset_counts(detail: DataFrame, splits: dict) -> DataFrame:
    """Mean class count per (dataset, split, class) and its share of the split.

    Distinct (dataset, seed) rows first, then two-level grouping.
    """
    base = detail.select("dataset", "seed", *splits.values()).distinct()
    long = counts_long(base, ["dataset", "seed"], splits)
    means = long.groupBy("dataset", "split", "class").agg(F.avg("count").alias("count"))
    return means.withColumn("prop", share_of_group("count", "dataset", "split"))


def minority_burden(counts: DataFrame, split="Test") -> DataFrame:
    group = F.when(F.col("class") == "N", "N").otherwise("Minority")
    return counts.where(F.col("split") == split).groupBy("dataset", group.alias("group")).agg(
        F.sum("count").alias("count"), F.sum("prop").alias("prop"))


def gain_table(summary: DataFrame, families=None) -> DataFrame:
    """Percentages and gains per method, with cleaned names and family labels."""
    return summary.select(
        "dataset", recode("family", families or FAMILY_LABELS).alias("family_label"),
        clean_method("method").alias("method_short"),
        (F.col("raw_macro_f1_4_mean") * 100).alias("raw_mf1"),
        (F.col("macro_f1_4_mean") * 100).alias("adapted_mf1"),
        (F.col("delta_macro_f1_4_mean") * 100).alias("delta_mf1"),
        (F.col("delta_accuracy_mean") * 100).alias("delta_acc"),
        (F.col("delta_F1_S_mean") * 100).alias("delta_s"),
        (F.col("delta_F1_F_mean") * 100).alias("delta_f"),
    )


def gain_long(gains: DataFrame) -> DataFrame:
    rows = to_long(gains, ["dataset", "family_label", "method_short"], ["raw_mf1", "adapted_mf1"], "stage", "mf1")
    return rows.withColumn("stage", recode("stage", {"raw_mf1": "Raw", "adapted_mf1": "Adapted"}))


def best_labels(gains: DataFrame) -> DataFrame:
    """Best method per dataset with a printable label (first name on ties)."""
    w = Window.partitionBy("dataset").orderBy(F.desc("adapted_mf1"), "family_label", "method_short")
    best = gains.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.select(
        "dataset", "method_short", "adapted_mf1",
        F.format_string("%s %.1f%%", "method_short", "adapted_mf1").alias("label"))


def class_pattern(summary: DataFrame, metrics=("F1", "Se", "Pr"), classes=CLASS_NAMES[:4]) -> DataFrame:
    """Mean raw and adapted class scores per dataset in percent, one row per metric and class."""
    pairs = [(m, c) for m in metrics for c in classes if f"{m}_{c}_mean" in summary.columns]
    means = summary.groupBy("dataset").agg(*[
        F.avg(f"{p}{m}_{c}_mean").alias(f"{p}{m}_{c}") for m, c in pairs for p in ("raw_", "")])
    items = F.array(*[
        F.struct(F.lit(c).alias("class"), F.lit(m).alias("metric"),
                 (F.col(f"raw_{m}_{c}") * 100).alias("raw"), (F.col(f"{m}_{c}") * 100).alias("adapted"))
        for m, c in pairs])
    return means.select("dataset", F.explode(items).alias("i")).select(
        "dataset", "i.*").withColumn("delta", F.col("adapted") - F.col("raw"))


def decoder_behaviour(detail: DataFrame) -> dict:
    """Multipliers, train priors, candidate scores and choice counts from run details."""
    keys = ["dataset", "family", "method", "seed"]
    rows = detail.withColumn("decoder_label", recode("selected_decoder", DECODER_LABELS)).withColumn(
        "multiplier", F.from_json("selected_multiplier", "array<double>"))
    mult = multipliers_long(rows, [*keys, "decoder_label"])
    train = counts_long(rows, keys, {"Train": "train_counts"}).withColumn("prior", share_of_group("count", *keys))
    cands = candidate_rows(rows, keys).withColumn("decoder_label", recode("decoder", DECODER_LABELS))
    scores = cands.groupBy("dataset", "decoder_label").agg(
        (F.avg("val_macro_f1_4") * 100).alias("val_macro_f1_4_mean"),
        (F.stddev_samp("val_macro_f1_4") * 100).alias("val_macro_f1_4_sd"))
    return {
        "multipliers": mult.where(F.col("class").isin(CLASS_NAMES[:4])).groupBy(
            "dataset", "decoder_label", "class").agg(F.avg("multiplier").alias("multiplier")),
        "priors": train.groupBy("dataset", "class").agg(F.avg("prior").alias("prior")),
        "candidates": scores.where(F.col("val_macro_f1_4_mean").isNotNull() & ~F.isnan("val_macro_f1_4_mean")),
        "decoder_choice": rows.groupBy("dataset", "decoder_label").agg(F.count(F.lit(1)).alias("n")),
        "alpha_choice": rows.groupBy("dataset", "selected_alpha").agg(F.count(F.lit(1)).alias("n")),
    }


def stage_tradeoff(stages: DataFrame, key="stage") -> DataFrame:
    """Mean Se and Pr of S and F per (dataset, stage, class), in percent, metrics side by side."""
    long = split_name(to_long(stages, ["dataset", key], ["Se_S", "Pr_S", "Se_F", "Pr_F"]), "name", ["metric", "class"])
    means = long.groupBy("dataset", key, "class", "metric").agg((F.avg("value") * 100).alias("value"))
    return to_wide(means, ["dataset", key, "class"], "metric", "value", ["Pr", "Se"])


def stage_class_f1(stages: DataFrame, key="stage") -> DataFrame:
    means = stages.groupBy("dataset", key).agg(*[(F.avg(f"F1_{c}") * 100).alias(f"F1_{c}") for c in "SFV"])
    long = to_long(means, ["dataset", key], ["F1_S", "F1_F", "F1_V"], "class", "F1")
    return long.withColumn("class", F.regexp_replace("class", "^F1_", ""))


def strongest_baseline_confusions(summary: DataFrame, conf: DataFrame) -> DataFrame:
    """Raw and adapted confusion shares of the method with the best raw score per dataset."""
    best = best_row(summary.withColumn("_t", F.lit(0)), ["dataset"], ["raw_macro_f1_4_mean"], "_t", ["family", "method"])
    met = conf.join(F.broadcast(best), ["dataset", "family", "method"])  # one row per dataset
    return confusion_shares(met, ["dataset", "stage"])


def runtime_long(detail: DataFrame) -> DataFrame:
    long = to_long(detail, ["dataset", "family", "method", "seed"], list(PHASES), "phase", "seconds")
    return long.withColumn("phase", recode("phase", PHASES))


def seed_sd(summary: DataFrame) -> DataFrame:
    return summary.groupBy("dataset", "family").agg((F.median("macro_f1_4_std") * 100).alias("median_std"))


def removed_groups(robust: DataFrame) -> DataFrame:
    return robust.groupBy("dataset", "removed_count").agg(F.count(F.lit(1)).alias("groups"))


def final_vs_baselines(external: DataFrame, summary: DataFrame, metric="macro_f1_4_mean") -> DataFrame:
    """Best external final row put together with the summary rows, ranked."""
    cols = ["model", "accuracy_mean", metric]
    top = external.orderBy(F.desc(metric), "model").limit(1).select(*cols)
    both = top.unionByName(summary.select(*cols))
    return both.orderBy(F.desc(metric), "model")
