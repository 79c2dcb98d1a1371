"""Alpha models on pyspark.ml, model comparison and the Bayesian update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from marketlab.functions.columns import clip, correlation, has, lit, logistic, number
from marketlab.operators.validate import classifier_metrics
from marketlab.session import materialise

SEED = 7


def features_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric features, missing as zero."""
    return df.withColumns({f"f_{c}": number(c, 0.0) for c in cols})


def _inputs(cols: Sequence[str], scaled: bool) -> list:
    stages = [VectorAssembler(inputCols=[f"f_{c}" for c in cols], outputCol="raw_vec" if scaled else "vec")]
    if scaled:
        stages.append(StandardScaler(inputCol="raw_vec", outputCol="vec", withMean=True, withStd=True))
    return stages


def logistic_model(cols: Sequence[str], c: float = 1.0, n_rows: int = 1000) -> Pipeline:
    return Pipeline(stages=[*_inputs(cols, True), LogisticRegression(featuresCol="vec", labelCol="label", regParam=1.0 / (c * max(1, n_rows)), elasticNetParam=0.0, standardization=False, maxIter=200)])


def boosted_model(cols: Sequence[str], trees: int = 250, rate: float = 0.05, depth: int = 3) -> Pipeline:
    return Pipeline(stages=[*_inputs(cols, False), GBTClassifier(featuresCol="vec", labelCol="label", maxIter=trees, stepSize=rate, maxDepth=depth, seed=SEED)])


# ------------------------------------------------------------ Bayesian update


def bayes_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Class means and deviations of every feature, one row."""
    y = F.col("label")
    aggs = [clip(F.avg(y.cast("double")), 1e-3, 1 - 1e-3).alias("base")]
    for c in cols:
        x = number(c, 0.0)
        for k in (0, 1):
            aggs += [F.coalesce(F.avg(F.when(y == k, x)), lit(0)).alias(f"m{k}_{c}"), F.greatest(F.coalesce(F.stddev_pop(F.when(y == k, x)), lit(1)), lit(1e-4)).alias(f"s{k}_{c}")]
    return train.agg(*aggs)


def bayes_predict(df: DataFrame, fit: DataFrame, cols: Sequence[str], prior: str = "mid") -> DataFrame:
    """Posterior probability with the market price as prior of each row."""
    row = fit.agg(F.first(F.struct(*fit.columns)).alias("v")).scalar()
    d = df.withColumn("_m", row)
    at = lambda n: F.col("_m").getField(n)
    p = clip(F.coalesce(number(prior), at("base")), 1e-3, 1 - 1e-3) if has(df, prior) else at("base")
    score = F.log(p / (1.0 - p))
    for c in cols:
        x = number(c, 0.0)
        z = lambda k: (x - at(f"m{k}_{c}")) / at(f"s{k}_{c}")
        score = score + (-F.log(at(f"s1_{c}")) - 0.5 * z(1) * z(1)) - (-F.log(at(f"s0_{c}")) - 0.5 * z(0) * z(0))
    return d.withColumn("p", clip(logistic(clip(score, -50.0, 50.0)), 1e-6, 1 - 1e-6)).drop("_m")


def bayes_importance(fit: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Effect size of each feature."""
    size = lambda c: F.abs(F.col(f"m1_{c}") - F.col(f"m0_{c}")) / F.greatest(F.sqrt(0.5 * (F.col(f"s0_{c}") * F.col(f"s0_{c}") + F.col(f"s1_{c}") * F.col(f"s1_{c}"))), lit(1e-6))
    return fit.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), size(c).alias("importance")) for c in cols])))


# ------------------------------------------------------------------- registry


class Fitted:
    """A fitted classifier: probability column and importances."""

    def __init__(self, name: str, cols: Sequence[str], model: PipelineModel | None = None, bayes: DataFrame | None = None) -> None:
        self.name, self.cols, self.model, self.bayes = name, list(cols), model, bayes

    def predict(self, df: DataFrame) -> DataFrame:
        if self.bayes is not None:
            return bayes_predict(df, self.bayes, self.cols)
        out = self.model.transform(features_of(df, self.cols))
        p = vector_to_array("probability")[1]
        keep = [c for c in df.columns]
        return out.withColumn("p", p).select(*keep, "p")

    def importance(self) -> list[tuple[str, float]]:
        """One value per feature, largest first."""
        if self.bayes is not None:
            vals = [(r["feature"], r["importance"]) for r in bayes_importance(self.bayes, self.cols).collect()]
        else:
            last = self.model.stages[-1]
            raw = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
            vals = list(zip(self.cols, [abs(float(v)) for v in raw]))
        return sorted(vals, key=lambda t: -t[1])


ALIASES = {"logreg": "logistic", "logistic_regression": "logistic", "gb": "gradient_boosting", "gboost": "gradient_boosting", "gradientboosting": "gradient_boosting", "bayes": "bayesian", "bayesian_update": "bayesian"}


def fit_model(name: str, train: DataFrame, cols: Sequence[str], trees: int = 250) -> Fitted:
    """Fit a classifier by registry name on rows with a ``label``."""
    key = ALIASES.get(name.lower().strip(), name.lower().strip())
    if key == "bayesian":
        return Fitted(key, cols, bayes=materialise(bayes_fit(train, cols)))
    data = features_of(train, cols)
    if key == "logistic":
        return Fitted(key, cols, logistic_model(cols, n_rows=train.count()).fit(data))
    if key == "gradient_boosting":
        return Fitted(key, cols, boosted_model(cols, trees).fit(data))
    raise ValueError(f"Unsupported model name: {name}")


def signals_from(p: Column) -> dict[str, Column]:
    """Signal and confidence of a probability."""
    q = clip(p, 1e-6, 1 - 1e-6)
    s = 2.0 * (q - 0.5)
    return {"proba": q, "model_signal": s, "model_confidence": clip(F.abs(s), 0.05, 1.0)}


def blend(df: DataFrame, weight: float, ensemble: bool) -> DataFrame:
    """Mix the heuristic with the model signal (ensembles only) and squash."""
    s = 2.0 * (clip("p", 1e-6, 1 - 1e-6) - 0.5)
    w = min(max(weight, 0.0), 1.0)
    mixed = w * F.col("signal") + (1.0 - w) * s if ensemble else s
    out = df.withColumns({"model_proba": F.col("p"), "model_pred_up_move_proba": F.col("p"), "signal": F.tanh(mixed)})
    conf = F.col("confidence") if has(df, "confidence") else lit(0)
    return out.withColumn("confidence", clip(F.greatest(conf, F.abs("signal")), 0.05, 1.0)).drop("p")


def expanding_folds(df: DataFrame, n_splits: int = 4, min_train: int = 4) -> DataFrame:
    """Rows of each expanding fold, marked train or test.

    Fold i trains on the first min_train + i * step instants and tests on the
    next step.
    """
    from marketlab.operators.validate import time_index

    t = time_index(df)
    step = F.greatest(F.lit(1), F.floor(F.col("n_ts") / (n_splits + 1))).cast("long")
    t = t.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn("_e", min_train + F.col("fold") * step)
    ok = (F.col("n_ts") >= min_train + 2) & (F.col("_e") + step <= F.col("n_ts"))
    role = F.when(F.col("idx") < F.col("_e"), "train").when(F.col("idx") < F.col("_e") + step, "test")
    return df.join(t.where(ok).withColumn("role", role).where(F.col("role").isNotNull()).select("ts", "fold", "role"), "ts")


def compare_models(df: DataFrame, cols: Sequence[str], names: Sequence[str] = ("logistic", "gradient_boosting", "bayesian"), n_splits: int = 4, trees: int = 250) -> DataFrame:
    """Mean AUC, log loss and Brier score per model over expanding folds.

    Fits run on the cluster one after another; only metric rows are united.
    """
    f = materialise(expanding_folds(df.where(F.col("label").isNotNull()), n_splits))
    both = f.where(F.col("role") == "train").groupBy("fold").agg(F.countDistinct("label").alias("k")).where(F.col("k") == 2)
    folds = sorted(r["fold"] for r in both.collect())
    rows = None
    for n in names:
        for i in folds:
            m = fit_model(n, f.where((F.col("fold") == i) & (F.col("role") == "train")), cols, trees)
            got = classifier_metrics(m.predict(f.where((F.col("fold") == i) & (F.col("role") == "test"))))
            row = got.select(F.lit(n).alias("model"), F.lit(i).alias("fold"), "auc", "log_loss", "brier")
            rows = row if rows is None else rows.unionByName(row)
    if rows is None:
        spark = df.sparkSession
        return spark.createDataFrame([(n, 0.5, 0.693, 0.25, 0.0) for n in names], "model string, auc double, log_loss double, brier double, folds double")
    return rows.groupBy("model").agg(F.avg("auc").alias("auc"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"), F.count(F.lit(1)).cast("double").alias("folds"))


def rank_models(metrics: DataFrame, top: int = 2) -> DataFrame:
    """Best models by log loss, then Brier, then AUC."""
    return metrics.orderBy("log_loss", "brier", F.col("auc").desc(), "model").limit(top)


# ----------------------------------------------------------------- regression


def future_mid_ensemble(train: DataFrame, frames: dict[str, DataFrame], cols: Sequence[str], target: str, trees: int = 120) -> tuple[dict[str, DataFrame], list[tuple[str, str, float]]]:
    """Average of a ridge and a boosted regressor for the next mid."""
    d = features_of(train.where(F.col(target).isNotNull()), cols).withColumn("label", clip(target, 1e-6, 1 - 1e-6))
    n = d.count()
    ridge = Pipeline(stages=[*_inputs(cols, True), LinearRegression(featuresCol="vec", labelCol="label", elasticNetParam=0.0, regParam=1.0 / max(1, n), standardization=False, predictionCol="p_ridge")]).fit(d)
    gb = Pipeline(stages=[*_inputs(cols, False), GBTRegressor(featuresCol="vec", labelCol="label", maxIter=trees, stepSize=0.05, maxDepth=2, seed=SEED, predictionCol="p_gb")]).fit(d)
    out = {}
    for k, df in frames.items():
        x = ridge.transform(features_of(df, cols)).drop("raw_vec", "vec")
        x = gb.transform(x)
        p = 0.5 * (clip("p_ridge", 1e-6, 1 - 1e-6) + clip("p_gb", 1e-6, 1 - 1e-6))
        out[k] = x.withColumn("model_pred_future_mid", p).select(*[c for c in df.columns if c != "model_pred_future_mid"], "model_pred_future_mid")
    imp = [("future_mid_ridge", c, abs(float(v))) for c, v in zip(cols, ridge.stages[-1].coefficients.toArray())]
    imp += [("future_mid_gb", c, abs(float(v))) for c, v in zip(cols, gb.stages[-1].featureImportances.toArray())]
    return out, imp


def return_importance(trades: DataFrame, cols: Sequence[str], top: int = 10, trees: int = 200, min_leaf: int = 10) -> DataFrame:
    """Forest importance of trade returns; plain correlation for small samples."""
    spark = trades.sparkSession
    use = [c for c in cols if has(trades, c)]
    n = trades.count()
    if n < 30:
        row = trades.agg(*[F.coalesce(correlation(number(c, 0.0), number("trade_return", 0.0)), lit(0)).alias(c) for c in use])
        return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.col(c)).alias("importance")) for c in use]))).orderBy(F.col("importance").desc(), "feature").limit(top)
    d = features_of(trades, use).withColumn("label", number("trade_return", 0.0))
    m = Pipeline(stages=[*_inputs(use, False), RandomForestRegressor(featuresCol="vec", labelCol="label", numTrees=trees, minInstancesPerNode=min_leaf, seed=SEED)]).fit(d)
    vals = [(c, float(v)) for c, v in zip(use, m.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(vals, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(top)


def wallet_clusters(stats: DataFrame, k: int = 4, cols: Sequence[str] = ("total_notional", "avg_trade_notional", "trades", "markets", "buy_ratio")) -> DataFrame:
    """Standardised k-means clusters of wallets."""
    d = features_of(stats, cols)
    model = Pipeline(stages=[*_inputs(cols, True), KMeans(featuresCol="vec", predictionCol="cluster", k=k, seed=SEED)]).fit(d)
    return model.transform(d).select(*stats.columns, "cluster")
