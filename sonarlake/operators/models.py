"""Model fitting on survey tables with MLlib: signature classifier, ablation, learned evidence fusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.operators import curves
from sonarlake.operators import evaluation as ev
from sonarlake.plans.durable import durable
from sonarlake.plans.ordered import dense_index
from sonarlake.plans.totals import with_totals


def _pipeline(features: Sequence[str], label: str, family: str, weight: str | None, max_iter: int) -> Pipeline:
    lr = LogisticRegression(featuresCol="_x", labelCol=label, family=family, maxIter=max_iter, regParam=1e-4)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_f"),
                            StandardScaler(inputCol="_f", outputCol="_x", withMean=True, withStd=True), lr])


def fit_signature(train: DataFrame, features: Sequence[str], label: str = "y_true", max_iter: int = 50) -> PipelineModel:
    """Standardise, then multinomial logistic regression over all classes."""
    return _pipeline(features, label, "multinomial", None, max_iter).fit(train)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``probs`` (array) and ``y_pred``."""
    out = model.transform(df).withColumn("probs", vector_to_array("probability"))
    return out.withColumn("y_pred", F.col("prediction").cast("bigint")).drop("_f", "_x", "rawPrediction", "probability", "prediction")


def signature_ablation(train: DataFrame, test: DataFrame, subsets: Mapping[str, Sequence[str]], label: str = "y_true") -> DataFrame:
    """Top-1 and top-3 accuracy of the classifier on each named feature subset."""
    out = None
    for name, features in subsets.items():
        scored = score(fit_signature(train, features, label), test)
        one = with_totals(ev.topk_accuracy(scored, 1, label).select(F.lit(name).alias("subset"), F.col("accuracy").alias("top1")),
                          ev.topk_accuracy(scored, 3, label).select(F.col("accuracy").alias("top3")))
        out = one if out is None else out.unionByName(one)
    return out


def balanced_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Weight n / (classes * count of the row's class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    t = n.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_m"))
    return df.join(with_totals(n, t).select(label, (F.col("_n") / (F.col("_m") * F.col("_c"))).alias("weight")), label)


def fit_fusion(df: DataFrame, features: Sequence[str], group: str, label: str = "y", folds: int = 5, max_iter: int = 50) -> tuple[PipelineModel, DataFrame]:
    """Class-balanced logistic fusion with grouped out-of-fold scores.

    Groups are numbered and dealt to folds, so no group is scored by a model that saw it. Returns the model on all rows
    and the rows with their out-of-fold ``conf``.
    """
    numbered = dense_index(df.select(group).distinct(), [], [group], "_g").select(group, (F.col("_g") % folds).alias("_fold"))
    weighted = durable(balanced_weights(df.join(numbered, group), label), "fusion")
    model = _pipeline(features, label, "binomial", "weight", max_iter)
    oof = None
    for k in range(folds):
        part = model.fit(weighted.filter(F.col("_fold") != k)).transform(weighted.filter(F.col("_fold") == k))
        part = part.withColumn("conf", F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, "conf") if "conf" not in df.columns else \
            part.drop("conf").withColumn("conf", F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns)
        oof = part if oof is None else oof.unionByName(part)
    return model.fit(weighted), oof


def fusion_threshold(oof: DataFrame, gt: DataFrame, thresholds: Sequence[float] = tuple(round(0.30 + 0.02 * i, 2) for i in range(33))) -> DataFrame:
    """Threshold with the best region F1 of the out-of-fold scores; the highest wins ties."""
    only_score = oof.withColumns({"detection_type": F.lit("unknown"), "anomaly_score": F.lit(0.0)})
    labels, dets = ev.region_hits(gt, only_score)
    return ev.best_threshold(ev.sweep(labels, dets, thresholds), prefer_high=True)


def summary_auc(scored: DataFrame, label: str = "y_true") -> DataFrame:
    return curves.ovr_summary(curves.ovr_auc(scored, label))
