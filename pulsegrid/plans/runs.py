"""Composed jobs: scenarios, evidence store, scored run table, sweeps and audits.

Evidence forests and raw baselines of a run grid are fitted together, keyed by the run columns, and so is
everything after the probabilities (adapter search, scoring, summaries).
"""

import hashlib
import json
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions import probability as P
from pulsegrid.operators import calibration as C
from pulsegrid.operators import splits
from pulsegrid.operators.metrics import class_counts, confusion_counts, confusion_long, counts_map, metric_row, prior_ratio
from pulsegrid.operators.prototypes import evidence_features, feature_set
from pulsegrid.operators.reshape import paired_deltas
from pulsegrid.plans import decoders, forests, models, selection
from pulsegrid.schema import CLASS_NAMES, METRICS
from pulsegrid.session import concurrently, pin, small_side
from pulsegrid.sources import tables


def scenario(beats: DataFrame, dataset: str, seed: int, lists=None, cap=50_000) -> DataFrame:
    """Rows of one dataset with ``part`` train/test; listed records, or a seeded record split."""
    rows = beats.where(F.col("dataset") == dataset)
    if lists is not None:
        return rows.join(small_side(lists.withColumnRenamed("role", "part")), "record")
    parts = splits.train_test_records(rows, seed).withColumnRenamed("role", "part")
    tagged = rows.join(parts, "record")
    train = splits.majority_cap(tagged.where("part = 'train'"), seed, cap)
    return train.unionByName(tagged.where("part = 'test'"))


def assigned_roles(view: DataFrame, seed: int, protocol="record") -> DataFrame:
    """``role`` fit/val/test for the rows of a scenario."""
    train = splits.fit_val_split(view.where("part = 'train'"), seed, protocol)
    test = view.where("part = 'test'").withColumn("role", F.lit("test"))
    return train.select(*test.columns).unionByName(test).drop("part")


EVIDENCE_RUN = ("dataset", "seed")


def evidence_rows(assigned: DataFrame, kind="clinical_proto", base="x", keys=()) -> DataFrame:
    """Rows with the evidence vector as ``features``; prototypes come from the fit rows (of each run of ``keys``)."""
    return feature_set(evidence_features(assigned, keys, base=base), kind)


def forest_probabilities(rows: DataFrame, keys=EVIDENCE_RUN, alike=None, **encoder) -> DataFrame:
    """A class-weighted forest on all fit rows of every run of ``keys``, scores for its val and test rows; all runs in one job.

    The keys include ``seed``. ``weights`` of the encoder is a mode, or a column that names it. ``alike``: the keys that tell the rows of runs apart.
    """
    settings = {**models.ENCODER, **encoder}
    keys = list(keys)
    kept = list(dict.fromkeys([*keys, "dataset", "role", "beat_id", "y"]))
    scored = models.fit_evidence(rows.where("role = 'fit'"), keys, target=rows.where("role <> 'fit'").select(*kept, "features"),
                                 target_id=["dataset", "beat_id"] if "dataset" not in keys else "beat_id", alike=alike, name="p_evidence", **settings)
    return pin(scored.select(*kept, "p_evidence"))


def evidence_probabilities(assigned: DataFrame, kind="clinical_proto", base="x", keys=EVIDENCE_RUN, **encoder) -> DataFrame:
    return forest_probabilities(pin(evidence_rows(assigned, kind, base, keys)), keys, **encoder)


EVIDENCE_KEY = ("dataset", "seed", "profile", "protocol_id", "settings")


def stored_evidence(assigned, dataset, seed, path, profile="legacy_cost", force=False, protocol="record", **kw) -> DataFrame:
    """Evidence probabilities, built once and shared by all methods.

    Kept by dataset, seed, cost profile, split protocol and a digest of every other setting
    (feature kind, base column, encoder), so that no run meets evidence of other rows.
    """
    settings = hashlib.md5(json.dumps(kw, sort_keys=True, default=str).encode()).hexdigest()

    def build():
        start = time.time()
        out = evidence_probabilities(assigned.withColumn("seed", F.lit(seed)), weights=profile, **kw)
        return tables.tagged(out, protocol).drop("run_tag").withColumns({
            "profile": F.lit(profile), "settings": F.lit(settings), "build_time": F.lit(time.time() - start)})

    key = dict(zip(EVIDENCE_KEY, (dataset, seed, profile, protocol, settings)))
    where = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in key.items()])
    return tables.load_or_build(assigned.sparkSession, path, build, EVIDENCE_KEY, where, force)


def stored_probabilities(build, spark, path, dataset, method, seed, protocol="record", force=False) -> DataFrame:
    """Val and test probabilities of one run with labels, kept by (dataset, method, seed, protocol)."""
    key = {"dataset": dataset, "method": method, "seed": seed, "protocol_id": protocol}
    where = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in key.items()])
    return tables.load_or_build(
        spark, path, lambda: build().withColumns({c: F.lit(v) for c, v in key.items()}), tuple(key), where, force)


BEAT_KEY = ["dataset", "seed", "role", "beat_id"]


def keep_bucketed(probs: DataFrame, table: str, buckets=64, path=None):
    """Write probabilities as a table bucketed and sorted by BEAT_KEY, one file a bucket.

    Tables with the same number of buckets join on BEAT_KEY without a shuffle, however often they are fused; Spark sorts each bucket again,
    in its task, unless it is told to trust the order of files.
    Choose the number so that a bucket of the largest table fits a task. ``path`` makes the table external.
    """
    writer = probs.repartition(buckets, *BEAT_KEY).write.bucketBy(buckets, *BEAT_KEY).sortBy(*BEAT_KEY).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def paired_probabilities(backbone: DataFrame, evidence: DataFrame) -> DataFrame:
    """Full join of backbone and evidence by BEAT_KEY; ``_e`` is null where the evidence is missing."""
    return backbone.select(*BEAT_KEY, "p_backbone").join(evidence.withColumn("_e", F.lit(True)), BEAT_KEY, "full")


def met_probabilities(backbone: DataFrame, evidence: DataFrame) -> DataFrame:
    """Backbone and evidence of the same rows by (dataset, seed, role, beat_id); an unmatched row is an error."""
    met = pin(paired_probabilities(backbone, evidence))
    lost = met.where("_e is null or p_backbone is null").count()
    if lost:
        raise ValueError(f"{lost} rows have only one of backbone and evidence probabilities")
    return met.drop("_e")


RUN = ["dataset", "family", "method", "seed"]


def score_runs(probs: DataFrame, fit: DataFrame, keys=RUN, fit_keys=("dataset", "seed")) -> DataFrame:
    """One detail row per run from backbone and evidence probabilities of val and test rows.

    ``probs``: keys, role, y, p_backbone, p_evidence. ``fit``: fit_keys, y. Selection reads
    validation rows only; the chosen policy is applied to the test rows.
    """
    keys, fit_keys = list(keys), list(fit_keys)
    runs = probs.select(*keys).distinct()
    counts = pin(runs.join(class_counts(fit, fit_keys), fit_keys).select(
        *keys, *[f"count_{c}" for c in CLASS_NAMES]))
    policies = counts.select("*", prior_ratio().alias("_r")).select(
        *keys, decoders.decoder_structs("_r").alias("decoders"))
    grid = pin(selection.adapter_grid(probs.where("role = 'val'"), policies, keys))
    chosen = pin(selection.select_adapter(grid, policies, keys))
    test = selection.apply_adapter(probs.where("role = 'test'"), chosen, keys)
    test = test.withColumn("raw_pred", A.argmax(F.col("p_backbone")))
    both = test.select(*keys, "y", F.explode(F.array(
        F.struct(F.lit("raw").alias("stage"), F.col("raw_pred").alias("pred")),
        F.struct(F.lit("adapted").alias("stage"), F.col("pred").alias("pred")))).alias("s")).select(*keys, "y", "s.*")
    cells = confusion_counts(both, [*keys, "stage"])
    rows = metric_row(cells, [*keys, "stage"])
    new = rows.where("stage = 'adapted'").select(*keys, *METRICS, *[f"support_{c}" for c in CLASS_NAMES])
    raw = rows.where("stage = 'raw'").select(*keys, *[F.col(m).alias(f"raw_{m}") for m in METRICS])
    detail = paired_deltas(new.join(raw, keys), METRICS)
    policy = chosen.select(
        *keys, F.col("alpha").alias("selected_alpha"), F.col("decoder").alias("selected_decoder"),
        F.col("power").alias("selected_power"), F.to_json("multiplier").alias("selected_multiplier"))
    total = sum((F.col(f"count_{c}") for c in CLASS_NAMES[1:]), F.col("count_N"))
    top = selection.top_candidates(grid, keys).select(*keys, F.to_json("candidates").alias("validation_table"))
    texts = counts.select(*keys, total.alias("train_size"), F.to_json(counts_map()).alias("train_counts"))
    out = detail
    for side in (policy, top, texts, *[_part_counts(probs, part, keys) for part in ("val", "test")]):
        out = out.join(side, keys)
    return out


def _part_counts(probs, part, keys):
    """``{part}_size`` and ``{part}_counts`` of each run."""
    total = sum((F.col(f"count_{c}") for c in CLASS_NAMES[1:]), F.col("count_N"))
    return class_counts(probs.where(F.col("role") == part), keys).select(
        *keys, total.alias(f"{part}_size"), F.to_json(counts_map()).alias(f"{part}_counts"))


def run_confusions(tested: DataFrame, keys=RUN) -> DataFrame:
    """Long confusion rows per run and stage from columns ``raw_pred`` and ``pred``."""
    both = tested.select(*keys, "y", F.explode(F.array(
        F.struct(F.lit("raw").alias("stage"), F.col("raw_pred").alias("pred")),
        F.struct(F.lit("adapted").alias("stage"), F.col("pred").alias("pred")))).alias("s")).select(*keys, "y", "s.*")
    return confusion_long(confusion_counts(both, [*keys, "stage"]), [*keys, "stage"])


def full_run(beats, datasets, methods, seeds, protocol="record", lists=None, store=None, done=None,
             size=1.0, encoder=None, base="x") -> DataFrame:
    """Detail rows of datasets x methods x seeds that are not in ``done`` yet; none if all are."""
    encoder = encoder or {}
    spark = beats.sparkSession
    todo = spark.createDataFrame(
        [(d, m, s) for d in datasets for m in methods for s in seeds], "dataset string, method string, seed int")
    if done is not None:
        todo = todo.join(done.select("dataset", "method", "seed").distinct(), ["dataset", "method", "seed"], "left_anti")
    left = {}
    for r in todo.collect():  # the run grid itself: datasets x methods x seeds
        left.setdefault((r["dataset"], r["seed"]), []).append(r["method"])

    if not left:
        none = spark.createDataFrame([], "dataset string, seed int, role string, beat_id long, y int, family string, method string, "
                                         "p_backbone array<double>, p_evidence array<double>")
        return score_runs(none, none.select("dataset", "seed", "y")).withColumn("protocol", F.lit(protocol))

    def split(item):
        dataset, seed = item
        return pin(assigned_roles(scenario(beats, dataset, seed, (lists or {}).get(dataset)), seed, protocol).withColumn("seed", F.lit(seed)))

    cells = sorted(left)
    parts = dict(zip(cells, concurrently(spark, split, cells)))
    columns = next(iter(parts.values())).columns
    roles = reduce(lambda a, b: a.unionByName(b), [p.select(*columns) for p in parts.values()])
    if store:
        profile = {"profile": encoder["weights"]} if "weights" in encoder else {}
        rest = {k: v for k, v in encoder.items() if k != "weights"}
        stored = [stored_evidence(parts[c].drop("seed"), *c, store, protocol=protocol, base=base, **profile, **rest) for c in cells]
        evidence = reduce(lambda a, b: a.unionByName(b), [e.select("dataset", "seed", "role", "beat_id", "y", "p_evidence") for e in stored])
    else:
        evidence = evidence_probabilities(roles, base=base, **encoder)
    raw = pin(roles.withColumn("features", F.concat(F.col("b0").cast("array<double>"), F.col("b1").cast("array<double>"))).select(
        "dataset", "seed", "role", "beat_id", "y", "features"))
    todo = F.create_map(*[F.lit(v) for (d, s), names in left.items() for v in (f"{d}|{s}", ",".join(names))])
    mine = F.split(todo[F.concat_ws("|", "dataset", F.col("seed").cast("string"))], ",")

    def backbone(name):
        rows = raw.where(F.array_contains(mine, name))
        out = models.fit_predict(name, rows.where("role = 'fit'"), rows.where("role <> 'fit'"), EVIDENCE_RUN, size=size, out="p_backbone")
        wanted = rows.select(*EVIDENCE_RUN).distinct()
        met = met_probabilities(out, evidence.join(F.broadcast(wanted), list(EVIDENCE_RUN), "left_semi"))
        return met.withColumn("family", F.lit("raw_machine_learning")).withColumn("method", F.lit(name))

    probs = concurrently(spark, backbone, sorted({m for names in left.values() for m in names}), 2)
    union = reduce(lambda a, b: a.unionByName(b), probs)
    return score_runs(union, roles.where("role = 'fit'").select("dataset", "seed", "y")).withColumn("protocol", F.lit(protocol))


def cost_sweep(assigned, backbone, profiles=decoders.COST_PROFILES, base="x", **encoder) -> DataFrame:
    """Adapter scores of every run under every class-cost profile of the evidence forest.

    ``assigned``: rows of all seeds with their roles; ``backbone``: method, seed, beat_id, p_backbone. One forest a (seed, profile),
    shared by all methods and grown in one job.
    """
    rows = pin(evidence_rows(assigned, base=base, keys=["seed"]))
    profiled = rows.withColumn("class_cost_profile", F.explode(F.array(*[F.lit(p) for p in profiles])))
    ev = forest_probabilities(profiled, ["seed", "class_cost_profile"], ["seed"], **{**encoder, "weights": "class_cost_profile"})
    probs = ev.join(backbone.select("method", "seed", "beat_id", "p_backbone"), ["seed", "beat_id"])
    fit = assigned.where("role = 'fit'").select("dataset", "seed", "y")
    keys = ["dataset", "method", "seed", "class_cost_profile"]
    out = score_runs(pin(probs), fit, keys)
    return out.select(*keys, "macro_f1_4", "delta_macro_f1_4", "accuracy", "F1_S", "F1_V", "F1_F")


def calibration_audit(probs: DataFrame, keys=("dataset", "method", "seed")):
    """(paired quality rows, reliability bins) from rows with p_backbone and p_adapted."""
    keys = list(keys)
    stacked = probs.select(*keys, "y", F.explode(F.array(
        F.struct(F.lit("raw").alias("source"), F.col("p_backbone").alias("p")),
        F.struct(F.lit("adapted").alias("source"), F.col("p_adapted").alias("p")))).alias("s")).select(*keys, "y", "s.*")
    binned = pin(C.binned_scores(stacked, [*keys, "source"]))
    return C.paired_quality(binned, keys), C.reliability_bins(binned, [*keys, "source"])


# The named configuration sweep.
SWEEP = [
    (f"{stem}_{kind}", kind, weights, decoder, power)
    for kind in ("clinical_proto", "clinical_proto_lead")
    for stem, weights, decoder, power in (
        ("legacy_stable", "legacy_cost", "stable_prior", 0.90),
        ("smooth_stable", "smooth_cost", "stable_prior", 0.90),
        ("tail_tail", "tail_cost", "tail_prior", 0.90),
        ("legacy_mild", "legacy_cost", "mild_prior", 1.00),
    )
]


def config_sweep(assigned: DataFrame, configs=SWEEP, base="x", **encoder) -> DataFrame:
    """Argmax and decoded test metrics of every named configuration and seed, train prior only.

    One forest a (seed, feature set, weight mode), all grown in one job; ``assigned`` holds the rows of all seeds.
    """
    spark = assigned.sparkSession
    kinds, fits = sorted({c[1] for c in configs}), sorted({(kind, weights) for _, kind, weights, _, _ in configs})
    columns = ["dataset", "seed", "role", "beat_id", "y", "features"]
    rows = pin(reduce(DataFrame.unionByName, [evidence_rows(assigned, kind, base, ["seed"]).select(*columns, F.lit(kind).alias("kind")) for kind in kinds]))
    fitted = rows.join(F.broadcast(spark.createDataFrame(fits, "kind string, weights string")), "kind")
    ev = forest_probabilities(fitted, ["seed", "kind", "weights"], ["seed", "kind"], **{**encoder, "weights": "weights"}).where("role = 'test'")
    counts = class_counts(assigned.where("role = 'fit'"), ["dataset", "seed"])
    named = []
    for name, kind, weights, mode, power in configs:
        mult = counts.select("dataset", "seed", decoders.decision_multiplier(prior_ratio(), mode).alias("m"))
        mine = ev.where((F.col("kind") == kind) & (F.col("weights") == weights)).join(F.broadcast(mult), ["dataset", "seed"])
        named.append(mine.select("dataset", "seed", F.lit(name).alias("config_name"), "y", A.argmax(F.col("p_evidence")).alias("argmax"),
                                 P.decode(F.col("p_evidence"), power, F.col("m")).alias("decoded")))
    rows = reduce(lambda a, b: a.unionByName(b), named)
    keys = ["dataset", "seed", "config_name"]
    staged = rows.select(*keys, "y", F.explode(F.array(
        F.struct(F.lit("argmax").alias("stage"), F.col("argmax").alias("pred")),
        F.struct(F.lit("decoded").alias("stage"), F.col("decoded").alias("pred")))).alias("s")).select(*keys, "y", "s.*")
    table = metric_row(confusion_counts(staged, [*keys, "stage"]), [*keys, "stage"])
    changed = rows.groupBy(*keys).agg(F.sum((F.col("argmax") != F.col("decoded")).cast("long")).alias("changed_samples"))
    return table.join(changed, keys)


# External scenarios as (scenario, trees, subset, class weights, kept from, metric, multiplier grid), and the cap of class 0.
EXTERNAL = [
    ("strict_external", 700, "0.35", [1.0, 3.0, 1.5, 12.0, 1.0], 0.50, "macro_f1_4", "wide"),
    ("record_augmented", 500, "0.35", [1.0, 3.0, 1.5, 12.0, 1.0], 0.50, "macro_f1_4", "wide"),
    ("record_augmented", 500, "0.45", [1.0, 4.0, 1.5, 16.0, 1.0], 0.50, "macro_f1_4", "wide"),
    ("record_augmented_s_focus", 500, "0.35", [1.0, 4.0, 1.5, 2.0, 1.0], 0.70, "macro_f1_3_nsv", "s_focus"),
    ("record_augmented_s_focus", 500, "0.45", [1.0, 5.0, 1.5, 1.0, 1.0], 0.70, "macro_f1_3_nsv", "s_focus"),
]
EXTERNAL_CAP = {"record_augmented": 50_000, "record_augmented_s_focus": 25_000}
EXTERNAL_SPLIT_SEED = 42


def external_rows(train: DataFrame, tests: dict, augmented: dict, base="x") -> DataFrame:
    """Evidence rows of all external scenarios: scenario, train_data, test_data (null for fit rows), role fit/test.

    ``train``: the rows every scenario is fitted on. ``tests``: name -> rows of the strict scenario. ``augmented``: scenario ->
    (name, rows of a dataset): its train records join the fit rows, class 0 capped, and its other records are the test.
    """
    def part(rows, scenario, train_data, test_data, role):
        return rows.withColumns({"scenario": F.lit(scenario), "train_data": F.lit(train_data), "role": F.lit(role),
                                 "test_data": F.lit(test_data).cast("string")})

    parts = [part(train, "strict_external", "base", None, "fit")]
    parts += [part(rows, "strict_external", "base", name, "test") for name, rows in tests.items()]
    for scenario, (name, rows) in augmented.items():
        roles = splits.train_test_records(rows, EXTERNAL_SPLIT_SEED).withColumnRenamed("role", "part")
        tagged = pin(rows.join(roles, "record"))
        pool = splits.training_pool(train, tagged.where("part = 'train'").select(*train.columns))
        fit = splits.majority_cap(pool, EXTERNAL_SPLIT_SEED, EXTERNAL_CAP[scenario])
        parts += [part(fit, scenario, f"base+{name}_train", None, "fit"),
                  part(tagged.where("part = 'test'").select(*train.columns), scenario, f"base+{name}_train", f"{name}_heldout", "test")]
    return evidence_rows(reduce(lambda a, b: a.unionByName(b), parts), base=base, keys=["scenario", "train_data"])


def external_validation(rows: DataFrame, seeds, specs=EXTERNAL, features="features", **encoder) -> DataFrame:
    """Forests of every (scenario, setting, seed) in one job, multiplier grids on their tests: default, kept and best rows.

    ``rows``: see ``external_rows``. A scenario's tests share its forests.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(s, int(encoder.get("trees", trees)), subset, w, float(seed), metric, kind, keep) for s, trees, subset, w, keep, metric, kind in specs for seed in seeds],
        "scenario string, trees int, subset string, weights array<double>, seed double, metric string, grid string, threshold double").withColumn(
        "seed", F.col("seed").cast("int"))
    data = pin(rows.select("scenario", "train_data", "test_data", "role", "dataset", "beat_id", "y", features)).join(F.broadcast(table), "scenario")
    model = ["scenario", "train_data", "trees", "subset", "seed"]
    fit = data.where("role = 'fit'").withColumn("weight", F.get("weights", F.col("y")))
    settings = ["metric", "grid", "threshold"]
    asked = data.where("role = 'test'").select(*model, "test_data", "dataset", "beat_id", "y", *settings, features)
    scored = pin(forests.grow(fit, model, features=features, weight="weight", trees=F.col("trees"), subset=F.col("subset"), min_leaf=encoder.get("min_leaf", 2),
                              depth=encoder.get("depth"), target=asked, target_id=["test_data", "dataset", "beat_id"], alike=["scenario", "train_data"]).drop(features))
    out, keys = [], [*model, "test_data"]
    for kind, metric, threshold in sorted({(s[6], s[5], s[4]) for s in specs}):
        mine = scored.where((F.col("grid") == kind) & (F.col("metric") == metric) & (F.col("threshold") == threshold))
        out.append(selection.kept_multipliers(selection.multiplier_grid(mine, keys, kind), keys, metric, threshold).withColumn("selection_metric", F.lit(metric)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def prediction_metrics(predicted: DataFrame, keys=("dataset", "model", "seed")) -> DataFrame:
    """Metric row per key from columns ``y`` and ``pred``."""
    return metric_row(confusion_counts(predicted, list(keys)), list(keys))


def baseline_evaluation(train: DataFrame, targets: DataFrame, names, seeds, done=None, size=1.0, features="features") -> DataFrame:
    """Raw baselines fitted on ``train`` and scored on every dataset of ``targets``.

    One metric row per (dataset, model, seed); keys that ``done`` holds are not computed again,
    and a model whose keys are all done is not fitted. ``summary.group_summary`` rolls them up.
    """
    keys = ["dataset", "model", "seed"]
    spark = train.sparkSession
    grid = spark.createDataFrame([(n, s) for n in names for s in seeds], "model string, seed int")
    wanted = targets.select("dataset").distinct().crossJoin(F.broadcast(grid))  # names x seeds, the run grid
    if done is not None:
        wanted = wanted.join(done.select(*keys).distinct(), keys, "left_anti")
    wanted = pin(wanted)
    left = {}
    for r in wanted.select("model", "seed").distinct().collect():
        left.setdefault(r["model"], []).append(r["seed"])

    def one(name):
        mine = wanted.where(F.col("model") == name).select("dataset", "seed")
        fit = train.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in sorted(left[name])])))
        asked = targets.join(small_side(mine), "dataset")
        p = models.fit_predict(name, fit, asked.select("seed", "dataset", "beat_id", "y", features), ["seed"], ["dataset", "beat_id"], size=size, features=features)
        return pin(p.select("dataset", F.lit(name).alias("model"), "seed", "y", A.argmax(F.col("p")).alias("pred")))

    parts = concurrently(spark, one, sorted(left), 2)
    none = spark.createDataFrame([], "dataset string, model string, seed int, y int, pred int")
    return prediction_metrics(reduce(lambda a, b: a.unionByName(b), parts) if parts else none, keys)
