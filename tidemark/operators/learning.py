"""Classifiers, calibration and feature signals on MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import names

SEED = 42


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight so that both classes weigh the same: what oversampling the rare class aims at, without made-up rows."""
    counts = rows.agg(F.count(F.lit(1)).alias("n_"), F.greatest(F.sum(label), F.lit(1)).alias("p_"))
    joined = rows.crossJoin(F.broadcast(counts))  # one row
    weight = F.when(F.col(label) == 1, F.col("n_") / (2.0 * F.col("p_"))).otherwise(F.col("n_") / (2.0 * F.greatest(F.col("n_") - F.col("p_"), F.lit(1))))
    return joined.withColumn("weight", weight).drop("n_", "p_")


def estimator(kind: str, label: str):
    """logistic, forest or boosted."""
    common = {"featuresCol": "scaled", "labelCol": label, "weightCol": "weight"}
    kinds = {
        "logistic": lambda: LogisticRegression(regParam=0.01, **common),
        "forest": lambda: RandomForestClassifier(numTrees=50, maxDepth=6, seed=SEED, **common),
        "boosted": lambda: GBTClassifier(maxIter=20, maxDepth=4, seed=SEED, **common),
    }
    if kind not in kinds:
        raise ValueError(f"no classifier {kind!r}; one of {sorted(kinds)}")
    return kinds[kind]()


def pipeline(columns: list[str], label: str, kind: str) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="assembled", handleInvalid="keep"), StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True), estimator(kind, label)])


def fit_classifier(rows: DataFrame, columns: list[str], label: str, kind: str = "boosted") -> PipelineModel:
    """Scaler and classifier on class-balanced weights; nulls count as 0."""
    return pipeline(columns, label, kind).fit(balanced(rows.fillna(0, columns), label))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with probability (of class 1)."""
    columns = model.stages[0].getInputCols()
    out = model.transform(rows.fillna(0, columns).withColumn("weight", F.lit(1.0)))
    return out.withColumn("probability_", vector_to_array("probability")[1]).drop("assembled", "scaled", "rawPrediction", "probability", "prediction", "weight").withColumnRenamed("probability_", "probability")


def cross_validated(rows: DataFrame, columns: list[str], label: str, kind: str = "logistic", folds: int = 5, regs: tuple[float, ...] = (0.001, 0.01, 0.1)) -> tuple[PipelineModel, list[float]]:
    """The best model over a small grid by area under the precision-recall curve, and the grid's means."""
    p = pipeline(columns, label, kind)
    last = p.getStages()[-1]
    grid = ParamGridBuilder().addGrid(last.regParam, list(regs)).build() if kind == "logistic" else ParamGridBuilder().addGrid(last.maxDepth, [3, 5]).build()
    judge = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR")
    found = CrossValidator(estimator=p, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=SEED).fit(balanced(rows.fillna(0, columns), label))
    return found.bestModel, list(found.avgMetrics)


def isotonic(scores: DataFrame, p: str = "probability", y: str = "outcome", least: int = 20) -> DataFrame:
    """scores with calibrated: isotonic regression of outcomes on probabilities; the probability itself with fewer than `least` rows."""
    if scores.limit(least).count() < least:
        return scores.withColumn("calibrated", F.col(p))
    model = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="calibrated").fit(scores.withColumn(y, F.col(y).cast("double")))
    return model.transform(scores)


def feature_signals(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """By feature: L1 logistic weight, linear SVM weight, forest importance and AUC of the feature alone."""
    data = balanced(rows.fillna(0, columns), label)
    spark = rows.sparkSession
    head = Pipeline(stages=pipeline(columns, label, "logistic").getStages()[:2]).fit(data)
    scaled = head.transform(data)
    common = {"featuresCol": "scaled", "labelCol": label, "weightCol": "weight"}
    l1 = LogisticRegression(elasticNetParam=1.0, regParam=0.01, **common).fit(scaled).coefficients
    svm = LinearSVC(regParam=0.01, maxIter=20, **common).fit(scaled).coefficients
    forest = RandomForestClassifier(numTrees=20, maxDepth=5, seed=SEED, **common).fit(scaled).featureImportances
    judge = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="one_", metricName="areaUnderROC")
    auc = [float(judge.evaluate(data.withColumn("one_", F.col(c).cast("double")))) for c in columns]
    values = [(c, float(l1[i]), float(svm[i]), float(forest[i]), auc[i]) for i, c in enumerate(columns)]
    return spark.createDataFrame(values, "feature string, l1_weight double, svm_weight double, importance double, auc double")


class ModelRegistry:
    """Versions of a model under one folder of any file system: v0001, v0002, ... and their metrics."""

    def __init__(self, folder: str, spark: SparkSession | None = None):
        self.folder, self.spark = folder.rstrip("/"), spark or SparkSession.getActiveSession()

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version:04d}"

    def versions(self) -> list[int]:
        return [int(n[1:]) for n in names(self.spark, self.folder) if n[:1] == "v" and n[1:].isdigit()]

    def save(self, model: PipelineModel, metrics: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        model.write().save(f"{self._path(version)}/model")
        metrics.coalesce(1).write.json(f"{self._path(version)}/metrics")
        return version

    def load(self, version: int | None = None) -> PipelineModel:
        known = self.versions()
        if not known:
            raise ValueError("the registry is empty")
        return PipelineModel.load(f"{self._path(version or known[-1])}/model")

    def best(self, metric: str) -> int:
        """The version whose metrics have the greatest value of a metric, the latest of equals."""
        scored = [(self.spark.read.json(f"{self._path(v)}/metrics").agg(F.max(metric)).first()[0], v) for v in self.versions()]
        return max(scored)[1]
