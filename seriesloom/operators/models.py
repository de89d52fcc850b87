"""Forecasters fitted by ``pyspark.ml``: trees and linear models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.scale import inverse_target, minmax_fit, scale_target
from seriesloom.session import cut_lineage
from seriesloom.sources.files import small_table

# Boosting rounds, learning rate and sampling shares of the point model, and the
# ridge weight of the window and stacking models.
TREES = {"rounds": 1000, "rate": 0.05, "share": 0.8}
RIDGE = 0.001


def fit_point(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    split: str = "split",
    rounds: int = TREES["rounds"],
    depth: int = 5,
    rate: float = TREES["rate"],
    share: float = TREES["share"],
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees on the absolute error, stopped by the validation split."""
    rows = df.where(F.col(split) != "test").select(
        *features, F.col(target).alias("_y"), (F.col(split) == "validation").alias("_validation")
    )
    rows = cut_lineage(rows.dropna())
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    trees = GBTRegressor(
        featuresCol="_x",
        labelCol="_y",
        predictionCol="y_pred",
        lossType="absolute",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=share,
        featureSubsetStrategy=str(share),
        validationIndicatorCol="_validation",
        validationTol=1e-4,
        seed=seed,
    )
    return PipelineModel([assembler, trees.fit(assembler.transform(rows))])


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(ids, y_pred) for the rows whose features are all known."""
    return model.transform(df.dropna(subset=list(features))).select(*ids, "y_pred")


def feature_importance(model: PipelineModel, features: Sequence[str], n: int, spark) -> DataFrame:
    """The ``n`` most important features of a fitted tree model; ties keep column order."""
    weights = model.stages[-1].featureImportances.toArray()
    ranked = sorted(enumerate(features), key=lambda item: (-weights[item[0]], item[0]))[:n]
    rows = [(r + 1, name, float(weights[i])) for r, (i, name) in enumerate(ranked)]
    return small_table(spark, rows, "rank int, feature string, importance double")


def fit_stack(
    df: DataFrame, keys: Sequence[str], y: str, models: Sequence[str], ts: str = "ts", split: str = "split"
) -> DataFrame:
    """Stack base forecasts: a linear meta-learner fitted on the validation rows.

    Works on the scale of the training target, in and out. Returns ``df`` with ``stack``.
    """
    bounds = minmax_fit(df, keys, [y], F.col(split) == "train")
    names = {f"_s_{c}": c for c in (*models, y)}
    shrunk = scale_target(
        df.withColumns({s: F.col(c) for s, c in names.items()}), bounds, keys, list(names), y, ts
    )
    base = [f"_s_{m}" for m in models]
    assembler = VectorAssembler(inputCols=base, outputCol="_x", handleInvalid="skip")
    learner = LinearRegression(
        featuresCol="_x", labelCol=f"_s_{y}", predictionCol="stack", regParam=RIDGE
    )
    known = cut_lineage(shrunk.where(F.col(split) == "validation").select(*base, f"_s_{y}").dropna())
    fitted = learner.fit(assembler.transform(known))
    scored = fitted.transform(assembler.transform(shrunk))
    return inverse_target(scored, bounds, keys, ["stack"], y, ts).select(*df.columns, "stack")


def fit_window(
    windows: DataFrame, seq: str, features: Sequence[str], target: str, steps: Sequence[int] = (1,)
) -> Mapping[int, PipelineModel]:
    """A ridge regression from a window of past rows to each wanted step ahead.

    ``target`` is a number (one step) or an array (step h is its h-th value).
    """
    many = isinstance(windows.schema[target].dataType, T.ArrayType)
    rows = windows.select(flat_window(seq, features).alias("_x"), F.col(target).alias("_t"))
    rows = rows.withColumn("_x", array_to_vector("_x"))
    out = {}
    for h in steps:
        label = F.get("_t", F.lit(h - 1)) if many else F.col("_t")
        learner = LinearRegression(
            featuresCol="_x", labelCol="_y", predictionCol="y_pred", regParam=RIDGE
        )
        out[h] = PipelineModel([learner.fit(rows.withColumn("_y", label))])
    return out


def flat_window(seq: str, features: Sequence[str]):
    """The values of a window, feature after feature, as one array."""

    def one(feature: str):
        return F.transform(seq, lambda row: row[feature].cast("double"))

    return F.concat(*[one(f) for f in features])


def score_window(
    model: PipelineModel, windows: DataFrame, seq: str, features: Sequence[str], ids: Sequence[str]
) -> DataFrame:
    rows = windows.withColumn("_x", array_to_vector(flat_window(seq, features)))
    return model.transform(rows).select(*ids, "y_pred")
