"""Model queries: splits (M6, M7), fitted transforms (M5, M8), evaluation and
comparison (A9, M14, M15, T6), training (M10-M13) and the retrain job (X6, M16, K6, K7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import oracle as O
from ..catalog import register
from ..models.prep import chronological_split, median_impute, robust_scale, tail_validation_split
from ..plans.preprocess import FEATURE_COLS, PARITY, preprocess
from ..session import scratch_path
from .composite import silver

W = O.with_ctes
GOLD = O.base_ctes(O.silver_cte(), *O.preprocess_ctes())


def gold(spark, sf):
    from ..session import cut_lineage
    return cut_lineage(preprocess(silver(spark, sf), **PARITY))


_SPLIT = """split AS (
  SELECT g.*, ROW_NUMBER() OVER (PARTITION BY city ORDER BY timestamp) AS rn,
         FLOOR(CAST(COUNT(*) OVER (PARTITION BY city) AS DOUBLE) * CAST('0.8' AS DOUBLE)) AS cut
  FROM gold g)"""


@register("chronological_split", W(*GOLD, _SPLIT, body="""
SELECT city, timestamp, aqi, CASE WHEN rn <= cut THEN 'train' ELSE 'test' END AS part FROM split"""), "M6")
def q_split(spark, sf):
    tr, te = chronological_split(gold(spark, sf).select("city", "timestamp", "aqi"), 0.8)
    return tr.withColumn("part", F.lit("train")).unionByName(te.withColumn("part", F.lit("test")))


@register("tail_validation_split", W(*GOLD, _SPLIT, body="""
SELECT city, timestamp, aqi, CASE WHEN rn2 <= n2 - FLOOR(CAST(n2 AS DOUBLE) * CAST('0.2' AS DOUBLE)) THEN 'fit' ELSE 'validation' END AS part
FROM (SELECT city, timestamp, aqi, ROW_NUMBER() OVER (PARTITION BY city ORDER BY timestamp) AS rn2,
             COUNT(*) OVER (PARTITION BY city) AS n2 FROM split WHERE rn <= cut) t"""), "M7")
def q_tail(spark, sf):
    tr, _ = chronological_split(gold(spark, sf).select("city", "timestamp", "aqi"), 0.8)
    fit, val = tail_validation_split(tr, 0.2)
    return fit.withColumn("part", F.lit("fit")).unionByName(val.withColumn("part", F.lit("validation")))


_IMPUTE_COLS = list(FEATURE_COLS)


def _fitted_sql(cols, probs, names, body_fn):
    ctes = [f"train AS (SELECT * FROM split WHERE rn <= cut)",
            "test AS (SELECT * FROM split WHERE rn > cut)"]
    for c in cols:
        ctes.append(O.quantile_cte(f"q_{c}", "(SELECT 'all' AS city, * EXCLUDE (city) FROM train)", ["city"], c,
                                   probs, names))
    return W(*GOLD, _SPLIT, *ctes, body=body_fn(cols))


def _median_body(cols):
    sel = ", ".join(f"COALESCE(t.{c}, (SELECT q50 FROM q_{c})) AS {c}" for c in cols)
    return f"SELECT t.city, t.timestamp, {sel} FROM test t"


@register("median_impute", _fitted_sql(_IMPUTE_COLS, [0.5], ["q50"], _median_body), "M8 A10")
def q_median_impute(spark, sf):
    tr, te = chronological_split(gold(spark, sf), 0.8)
    return median_impute(tr, te, _IMPUTE_COLS).select("city", "timestamp", *_IMPUTE_COLS)


_SCALE_COLS = [c for c in FEATURE_COLS]


def _robust_body(cols):
    def one(c):
        q = f"q_{c}"
        iqr = f"((SELECT q75 FROM {q}) - (SELECT q25 FROM {q}))"
        return (f"(CAST(t.{c} AS DOUBLE) - (SELECT q50 FROM {q})) / "
                f"(CASE WHEN {iqr} = 0 THEN CAST('1.0' AS DOUBLE) ELSE {iqr} END) AS {c}")
    return f"SELECT t.city, t.timestamp, t.aqi, {', '.join(one(c) for c in cols)} FROM split t"


@register("robust_scale", _fitted_sql(_SCALE_COLS, [0.25, 0.5, 0.75], ["q25", "q50", "q75"], _robust_body),
          "M5 A11")
def q_robust(spark, sf):
    g = gold(spark, sf)
    tr, _ = chronological_split(g, 0.8)
    return robust_scale(tr, g, _SCALE_COLS).select("city", "timestamp", "aqi", *_SCALE_COLS)


_BASELINES = {"lag_72h": "aqi_lag_72h", "lag_96h": "aqi_lag_96h"}


def _baseline_predictions(spark, sf):
    _, te = chronological_split(gold(spark, sf), 0.8)
    parts = [te.select(F.lit(m).alias("model"), F.col("aqi").alias("label"), F.col(c).alias("prediction"))
             for m, c in _BASELINES.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _metrics_sql():
    long = " UNION ALL ".join(f"SELECT '{m}' AS model, aqi AS y, {c} AS p FROM split WHERE rn > cut"
                              for m, c in _BASELINES.items())
    dec = "DECIMAL(38,12)"
    return f"""metrics AS (
  SELECT model, SQRT(sse / n) AS rmse, sae / n AS mae,
         CAST('1.0' AS DOUBLE) - sse / NULLIF(syy - sy * sy / n, CAST('0.0' AS DOUBLE)) AS r2 FROM (
    SELECT model, COUNT(*) AS n, CAST(SUM(CAST((y - p) * (y - p) AS {dec})) AS DOUBLE) AS sse,
           CAST(SUM(CAST(ABS(y - p) AS {dec})) AS DOUBLE) AS sae, CAST(SUM(CAST(y AS {dec})) AS DOUBLE) AS sy,
           CAST(SUM(CAST(y * y AS {dec})) AS DOUBLE) AS syy
    FROM ({long}) l WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY model) s)"""


@register("evaluate_models", W(*GOLD, _SPLIT, _metrics_sql(), body="SELECT model, rmse, mae, r2 FROM metrics"),
          "A9 M14")
def q_evaluate(spark, sf):
    from ..models.train import evaluate_models
    return evaluate_models(_baseline_predictions(spark, sf))


@register("compare_models", W(*GOLD, _SPLIT, _metrics_sql(), body="""
SELECT model, rmse, r2, model = (SELECT arg_min(model, rmse) FROM metrics) AS is_best FROM metrics"""), "M15")
def q_compare(spark, sf):
    from ..models.train import compare_models, evaluate_models
    return compare_models(evaluate_models(_baseline_predictions(spark, sf))).select("model", "rmse", "r2", "is_best")


@register("best_model", W(*GOLD, _SPLIT, _metrics_sql(), body=f"""
SELECT model, {O.rhe('rmse', 4)} AS rmse, {O.rhe('mae', 4)} AS mae, {O.rhe('r2', 4)} AS r2
FROM metrics ORDER BY rmse LIMIT 1"""), "T6 P29")
def q_best(spark, sf):
    from ..functions.sanitise import round_metrics
    from ..models.train import best_model, evaluate_models
    return round_metrics(best_model(evaluate_models(_baseline_predictions(spark, sf))), ["rmse", "mae", "r2"])


_TRAINED: dict = {}


def _files(spark, sf):
    """Paths, sizes and times of the readings that the fits come from."""
    from ..sinks.versions import file_system
    fs, Path = file_system(spark, sf)
    found = fs.globStatus(Path(f"{sf.rstrip('/')}/events.parquet/*")) or fs.globStatus(Path(f"{sf.rstrip('/')}/events.parquet"))
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found))


def trained_models(spark, sf):
    """Fit the four regressors once per application and state of the input files (reused by later queries)."""
    from ..models.train import train_models
    key = (spark.sparkContext.applicationId, _files(spark, sf))
    if key not in _TRAINED:
        from ..session import cut_lineage
        g = cut_lineage(preprocess(silver(spark, sf)))  # the training defaults: no leak of the target
        tr, te = chronological_split(g, 0.8)
        tr, te = cut_lineage(tr), cut_lineage(te)
        _TRAINED[key] = (tr, te, train_models(tr, te, FEATURE_COLS))
    return _TRAINED[key]


@register("train_models", None, "M10 M11 M12 M13 M14")
def q_train(spark, sf):
    from ..models.train import results_of
    _, _, trained = trained_models(spark, sf)
    return results_of(trained)


@register("retrain_job", None, "X6 M16 A15 T5 P30 P28 K6 K7 S10 S11")
def q_retrain(spark, sf, n_rows=None):
    """Daily batch job: features -> split -> models -> importance -> registry; returns the importance table.

    All test rows are explained; ``n_rows`` takes the first ones by time."""
    from ..models.importance import contributions
    from ..models.train import TREE_MODELS, best_model, results_of, save_registry
    from ..operators.aggregates import importance_share, mean_abs_contribution
    from ..functions.labels import feature_display_name
    from ..sinks.files import save_importance
    from ..sources.payloads import read_importance, read_registry
    tr, te, trained = trained_models(spark, sf)
    res = results_of(trained).persist()
    path = scratch_path(spark, "registry")
    save_registry(spark, path, trained, res, FEATURE_COLS, tr.count())
    best_tree = best_model(res, only=sorted(TREE_MODELS)).first()["model"]
    model = {t.name: t for t in trained}[best_tree].model.stages[-1]
    te_imp = median_impute(tr, te, FEATURE_COLS)
    contrib = contributions(te_imp if n_rows is None else te_imp.orderBy("timestamp").limit(n_rows), model, FEATURE_COLS, ["timestamp"])
    imp = mean_abs_contribution(contrib, FEATURE_COLS)
    save_importance(imp, f"{path}/importance")
    back = read_importance(spark, f"{path}/importance")
    meta = read_registry(spark, f"{path}/model_metadata").select("best_model").first()
    top = back.orderBy(F.col("shap_value").desc(), "feature").limit(10)
    return importance_share(top).withColumn("display_name", feature_display_name(F.col("feature"))) \
        .withColumn("best_model", F.lit(meta["best_model"] if meta else None))
