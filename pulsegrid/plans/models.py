"""Class-weighted forests, raw baselines and probability rows, for all runs of a grid at once.

Linear models (``linear``), forests (``forests``) and boosting (``boosting``) fit every run of the key columns in jobs whose number
does not depend on the runs. Only the perceptron is a Spark ML fit a run, a few at a time.
"""

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions import probability as P
from pulsegrid.operators.neighbours import nearest_neighbours
from pulsegrid.plans import boosting, forests, linear
from pulsegrid.plans.decoders import weighted_rows
from pulsegrid.schema import N_CLASSES
from pulsegrid.session import concurrently, pin, spread

# Main and older evidence encoder settings.
ENCODER = {"trees": 700, "subset": "0.35", "min_leaf": 2, "weights": "legacy_cost"}
OLDER_ENCODER = {"trees": 500, "subset": "0.35", "min_leaf": 2, "weights": "balanced"}
# Raw baselines on the two-lead vector.
LINEAR = {"logistic": "softmax", "linear_svm": "squared_hinge"}
FORESTS = {"random_forest": {"trees": 400, "splits": "best"}, "extra_trees": {"trees": 500, "splits": "random"}}
PERCEPTRON = {"layers": [256, 128], "iterations": 120}

BASELINES = [*LINEAR, *FORESTS, "boosting", "perceptron"]


def padded(values: Column) -> Column:
    """Model output, ordered by class index, as a full probability row."""
    present = F.map_from_arrays(F.sequence(F.lit(0), F.size(values) - 1), values)
    return P.align(present)


def fit_evidence(fit: DataFrame, keys, features="features", weights="legacy_cost", **settings) -> DataFrame:
    """Class-weighted extra-trees of every run (settings of ``forests.grow``); ``weights``: a mode, or a column that names the mode of a run."""
    if weights in fit.columns:
        modes = [r[0] for r in fit.select(weights).distinct().collect()]  # the few weight modes
        rows = reduce(DataFrame.unionByName, [weighted_rows(fit.where(F.col(weights) == m), m, keys) for m in sorted(modes)])
    else:
        rows = weighted_rows(fit, weights, keys)
    return forests.grow(rows, keys, features=features, weight="weight", **settings)


def _perceptron(fit, target, seed, size, features, y, out, row_id):
    """One Spark ML fit; the caller's columns come back with the probability row.

    The fit rows are dealt over tasks by their number alone, so that the fit takes every core and depends on no file layout; few rows stay as they are.
    """
    known = [c for c in row_id if c in fit.columns]
    order = [*known, features, y]
    dealt = spread(fit, *(known or order))
    fit = fit if dealt is fit else dealt.sortWithinPartitions(*order)
    width = len(fit.select(features).first()[0])
    steps = max(1, round(PERCEPTRON["iterations"] * size))
    stages = [StandardScaler(inputCol="_vec", outputCol="_scaled", withMean=True, withStd=True),
              MultilayerPerceptronClassifier(layers=[width, *PERCEPTRON["layers"], N_CLASSES], maxIter=steps, seed=seed, featuresCol="_scaled",
                                             labelCol="_label", probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")]
    vec = array_to_vector(F.col(features).cast("array<double>")).alias("_vec")
    model = Pipeline(stages=stages).fit(fit.select(vec, F.col(y).cast("double").alias("_label")))
    return model.transform(target.select("*", vec)).select(*target.columns, padded(vector_to_array("_prob")).alias(out))


def fit_predict(name: str, fit: DataFrame, target: DataFrame, keys, row_id="beat_id", seed="seed", features="features", y="y",
                size=1.0, out="p") -> DataFrame:
    """``target`` with the probability row of a raw baseline fitted on the ``fit`` rows of the same run.

    ``keys`` name a run and include the ``seed`` column; ``row_id`` tells its target rows apart. ``size`` scales trees and rounds (tests).
    """
    keys = list(keys)
    if name not in BASELINES:
        raise ValueError(f"unknown baseline {name!r}")
    if name in LINEAR:
        return linear.predict(linear.fit(fit, keys, LINEAR[name], features, y), target, keys, LINEAR[name], features, out)
    if name in FORESTS:
        settings = {**FORESTS[name], "trees": max(1, round(FORESTS[name]["trees"] * size))}
        return forests.grow(fit, keys, row_id, seed, features, y, subset="sqrt", min_leaf=1, target=target, name=out, **settings)
    if name == "boosting":
        return boosting.fit_predict(fit, target, keys, row_id, seed, features, y, out, size)
    runs = [tuple(r) for r in fit.select(*keys).distinct().collect()]  # the run grid
    at = keys.index(seed)

    def one(run):
        mine = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, run)])
        return pin(_perceptron(fit.where(mine), target.where(mine), run[at], size, features, y, out, [row_id] if isinstance(row_id, str) else row_id))

    return reduce(DataFrame.unionByName, concurrently(fit.sparkSession, one, runs))


def standardise(fit: DataFrame, rows: DataFrame, vec="vec") -> DataFrame:
    """Per-position z-score of ``rows`` with mean and population std of ``fit``."""
    long = fit.select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "v"))
    stats = long.groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    packed = stats.agg(F.sort_array(F.collect_list(F.struct("pos", "m", "sd"))).alias("_st"))
    out = rows.crossJoin(F.broadcast(packed))  # one row, as long as the vector
    z = F.zip_with(
        F.col(vec).cast("array<double>"), "_st",
        lambda v, s: (v - s["m"]) / F.when(s["sd"] > 0, s["sd"]).otherwise(F.lit(1.0)))
    return out.withColumn(vec, z).drop("_st")


def knn_vote(fit: DataFrame, target: DataFrame, k=7, row_id="beat_id", y="y", vec="vec") -> DataFrame:
    """Vote shares of the k nearest fit rows as a five-class probability row."""
    def side(df):
        return df.select(F.lit(0).alias("by"), F.col(row_id).alias("id"), F.col(vec).alias("vec"))
    near = nearest_neighbours(side(target), side(fit), k)
    labelled = near.join(fit.select(F.col(row_id).alias("neighbour"), F.col(y).alias("_y")), "neighbour")
    votes = labelled.groupBy("id").agg(*[
        (F.sum((F.col("_y") == c).cast("double")) / F.count(F.lit(1))).alias(f"v{c}") for c in range(N_CLASSES)])
    p = F.array(*[F.col(f"v{c}") for c in range(N_CLASSES)])
    return votes.select(F.col("id").alias(row_id), p.alias("p"), A.argmax(p).alias("pred"))
