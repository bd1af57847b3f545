"""Fraud classifier (M1-M3): feature table and a boosted-tree model in
Spark ML. Training is distributed (tree statistics are aggregated across
partitions); nothing is collected to the driver but the model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as SC

FEATURES = ["amount", "is_emulator", "is_high_risk"]
LABEL = "is_fraud"


def fraud_features(hist: DataFrame, label: Column | None = None,
                   categories: tuple[str, ...] = (SC.HIGH_RISK_CATEGORY,),
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """M1: amount, is_emulator (P7), is_high_risk (P8), is_fraud (P9 or the
    given label column)."""
    lab = label if label is not None else SC.fraud_label("account_id")
    return hist.select(
        *keep,
        F.col("amount"),
        SC.is_emulator("device_id").alias("is_emulator"),
        SC.is_high_risk("merchant_category", categories).alias("is_high_risk"),
        lab.cast("int").alias(LABEL))


def split(feats: DataFrame, key: str, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows to train on, held-out rows) by a stable multiplicative hash of the
    integer ``key``: all rows of a key are on one side, in every run and engine."""
    prime = F.lit(2_147_483_647).cast("long")
    fold = F.pmod(F.pmod(F.col(key).cast("long"), prime) * F.lit(48_271), prime) % folds
    return feats.filter(fold != 0), feats.filter(fold == 0)


def train_classifier(features: DataFrame, max_iter: int = 20, max_depth: int = 5,
                     seed: int = 42) -> PipelineModel:
    """M2: VectorAssembler + GBTClassifier on the feature table."""
    asm = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="features", labelCol=LABEL, maxIter=max_iter,
                        maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[asm, gbt]).fit(features.withColumn(LABEL, F.col(LABEL).cast("double")))


def predict(model: PipelineModel, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """M3: fraud probability and predicted label per row."""
    out = model.transform(df)
    return out.select(*keep, *FEATURES,
                      vector_to_array("probability")[1].alias("fraud_probability"),
                      F.col("prediction").cast("int").alias("prediction"))


def evaluate(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M3: area under ROC / PR of the model on ``df`` as a one-row table."""
    scored = model.transform(df.withColumn(LABEL, F.col(LABEL).cast("double")))
    spark = df.sparkSession
    roc = BinaryClassificationEvaluator(labelCol=LABEL, metricName="areaUnderROC").evaluate(scored)
    pr = BinaryClassificationEvaluator(labelCol=LABEL, metricName="areaUnderPR").evaluate(scored)
    return spark.createDataFrame([(float(roc), float(pr))], "area_under_roc double, area_under_pr double")
