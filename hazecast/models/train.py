"""Regressors, evaluation, comparison and the model registry (Spark ML).

Model settings follow the reference's hyper-parameters:
random forest 300 trees, depth 10, 4 rows per leaf, 70% of features, seed 42;
gradient boosting 400 rounds, step 0.04, depth 5, subsample 0.8, 4 rows per leaf;
a second boosted configuration 300 rounds, step 0.05, depth 6;
Huber regression epsilon 1.35, alpha 0.01 on standard-scaled inputs.
Every model gets train-fitted median imputation first.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rounding import round_half_even
from ..operators.aggregates import regression_metrics
from ..session import cut_lineage
from .prep import impute_stage, scale_stage

# Hyper-parameters of the reference models.
RF_PARAMS = dict(numTrees=300, maxDepth=10, minInstancesPerNode=4, featureSubsetStrategy="0.7", seed=42)
GBT_PARAMS = dict(maxIter=400, stepSize=0.04, maxDepth=5, subsamplingRate=0.8, minInstancesPerNode=4, seed=42)
BOOSTED_VARIANT_PARAMS = dict(maxIter=300, stepSize=0.05, maxDepth=6, seed=42)
HUBER_EPSILON, HUBER_ALPHA, HUBER_MAX_ITER = 1.35, 0.01, 1000
#: rows of a training partition at least and at most; partitions between the two
TRAIN_ROWS_PER_PARTITION, TRAIN_ROWS_MOST, TRAIN_PARTITIONS = 16_384, 200_000, 64
MODEL_NAMES = ["Random Forest", "Gradient Boosting", "Boosted Variant", "Huber Regression"]
TREE_MODELS = {"Random Forest", "Gradient Boosting", "Boosted Variant"}


@dataclass
class Trained:
    name: str
    model: PipelineModel
    predictions: DataFrame


def _assembler(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


def train_partitions(n: int) -> int:
    """Partitions of ``n`` training rows, by ``n`` alone, so that the fits do not depend on the cluster.

    Every task of the forest sums up statistics of all open nodes and every boosting round runs a job
    per level, so partitions cost time of their own: up to ``TRAIN_PARTITIONS`` they are as small as
    pays, beyond that they grow to ``TRAIN_ROWS_MOST`` rows, and then their number does."""
    return max(1, -(-n // TRAIN_ROWS_MOST), min(-(-n // TRAIN_ROWS_PER_PARTITION), TRAIN_PARTITIONS))


def train_models(train: DataFrame, test: DataFrame, feature_cols: Sequence[str], label: str = "aqi",
                 names: Sequence[str] = MODEL_NAMES, id_cols: Sequence[str] = ("city", "timestamp")) -> list[Trained]:
    """Fit the named models.  Each is a pipeline that takes raw features: imputation, for the
    Huber model scaling, assembly and the regressor, so that it can be saved and served as it is."""
    cols = list(feature_cols)
    keep = [*id_cols, *cols, label]
    labelled = lambda d: d.select(*keep).withColumn("label", F.col(label).cast("double"))
    tr, te = cut_lineage(labelled(train)), cut_lineage(labelled(test))
    n = tr.count()
    impute = impute_stage(tr, cols)
    parts = train_partitions(n)
    tr = cut_lineage(tr.repartition(parts))
    # a boosted tree is far less work than a forest: half the tasks for thousands of short jobs
    few = tr.coalesce(-(-parts // 2))

    def fit(name: str) -> Trained:
        stages, prefix = [impute], "in_"
        if name == "Huber Regression":
            stages, prefix = [impute, scale_stage(impute.transform(tr), cols)], "scaled_"
            est = LinearRegression(loss="huber", epsilon=HUBER_EPSILON, regParam=HUBER_ALPHA / max(n, 1),
                                   elasticNetParam=0.0, standardization=False, maxIter=HUBER_MAX_ITER)
        elif name == "Random Forest":
            est = RandomForestRegressor(**RF_PARAMS)
        elif name == "Gradient Boosting":
            est = GBTRegressor(**GBT_PARAMS)
        else:
            est = GBTRegressor(**BOOSTED_VARIANT_PARAMS)
        rows = tr if name == "Random Forest" else few
        pm = Pipeline(stages=[*stages, _assembler([f"{prefix}{c}" for c in cols]), est]).fit(rows)
        return Trained(name, pm, pm.transform(te).select(*id_cols, "label", "prediction"))

    # The fits are independent, and each waits for one small job after the other: side by side
    # they share the cluster.
    with ThreadPoolExecutor(len(names)) as pool:
        return list(pool.map(inheritable_thread_target(train.sparkSession)(fit), names))


def evaluate_models(predictions: DataFrame, y: str = "label", yhat: str = "prediction",
                    model_col: str = "model") -> DataFrame:
    """Long-format predictions -> RMSE/MAE/R^2 per model (one aggregate)."""
    m = regression_metrics(predictions, [model_col], y, yhat)
    return m.select(model_col, "rmse", "mae", "r2")


def results_of(trained: list[Trained]) -> DataFrame:
    from functools import reduce
    long = reduce(lambda a, b: a.unionByName(b),
                  [t.predictions.withColumn("model", F.lit(t.name)) for t in trained])
    return evaluate_models(long)


def compare_models(results: DataFrame, metric: str = "rmse") -> DataFrame:
    """Flag the best (smallest metric) model; results have one row per model."""
    from pyspark.sql import Window
    best = F.min_by(F.col("model"), F.col(metric)).over(Window.partitionBy())  # one row per model: bounded
    return results.withColumn("is_best", F.col("model") == best)


def best_model(results: DataFrame, metric: str = "rmse", only: Sequence[str] | None = None) -> DataFrame:
    from ..operators.ordering import best_by_min
    where = F.col("model").isin(list(only)) if only else None
    return best_by_min(results, metric, ["model", "rmse", "mae", "r2"], where)


def write_metadata(path: str, results: DataFrame, feature_cols: Sequence[str], n_train: int,
                   trained_at: str | None = None) -> str | None:
    """Registry metadata as JSON: best model, metrics rounded to 4 digits, row count, UTC stamp.

    ``results`` has one row per model (bounded by the number of models).
    Returns the best model's name.
    """
    rounded = results.select("model", *[round_half_even(F.col(c), 4).alias(c) for c in ("rmse", "mae", "r2")])
    stamp = trained_at or _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    st = F.struct("rmse", "mae", "r2", "model")
    meta = rounded.agg(F.min_by(st, F.col("rmse")).alias("b"),
                       F.collect_list(F.struct("model", "rmse", "mae", "r2")).alias("all_results")).select(
        F.col("b.model").alias("best_model"), F.col("b.rmse").alias("rmse"), F.col("b.mae").alias("mae"),
        F.col("b.r2").alias("r2"), F.array(*[F.lit(c) for c in feature_cols]).alias("feature_cols"),
        F.lit(int(n_train)).alias("training_rows"), F.lit(stamp).alias("trained_at"), "all_results")
    meta.coalesce(1).write.mode("overwrite").json(path)
    row = meta.select("best_model").first()
    return row["best_model"] if row else None


def save_registry(spark: SparkSession, path: str, trained: list[Trained], results: DataFrame,
                  feature_cols: Sequence[str], n_train: int) -> str | None:
    """Best model via the Spark ML writer plus the metadata JSON."""
    best = write_metadata(f"{path}/model_metadata", results, feature_cols, n_train)
    by_name = {t.name: t for t in trained}
    if best in by_name:
        by_name[best].model.write().overwrite().save(f"{path}/best_model")
    return best


REGISTRY_SCHEMA = T.StructType([
    T.StructField("best_model", T.StringType()), T.StructField("rmse", T.DoubleType()),
    T.StructField("mae", T.DoubleType()), T.StructField("r2", T.DoubleType()),
    T.StructField("feature_cols", T.ArrayType(T.StringType())), T.StructField("training_rows", T.IntegerType()),
    T.StructField("trained_at", T.StringType()),
    T.StructField("all_results", T.ArrayType(T.StructType([
        T.StructField("model", T.StringType()), T.StructField("rmse", T.DoubleType()),
        T.StructField("mae", T.DoubleType()), T.StructField("r2", T.DoubleType())]))),
])


def load_best_model(path: str) -> PipelineModel:
    """The best model that ``save_registry`` saved, with its imputation and scaling."""
    return PipelineModel.load(f"{path}/best_model")
