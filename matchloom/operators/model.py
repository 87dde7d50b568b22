"""The pair classifier: boosted trees, cross-validated by entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import group_fold, hash_fraction


@dataclass(frozen=True)
class Boosting:
    depth: int = 5
    rounds: int = 60
    rate: float = 0.1
    least_rows: int = 5
    row_share: float = 0.85
    column_share: str = "0.85"
    bins: int = 256
    seed: int = 42


def train(rows: DataFrame, features: list[str], settings: Boosting = Boosting()) -> PipelineModel:
    """A model over ``features`` and ``label``; a tenth of the entities tells when to stop."""
    assembler = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep")
    held = hash_fraction(F.col("s1_id"), settings.seed + 7) < 0.1
    trees = GBTClassifier(
        featuresCol="x", labelCol="label", maxDepth=settings.depth, maxIter=settings.rounds, stepSize=settings.rate, minInstancesPerNode=settings.least_rows,
        subsamplingRate=settings.row_share, featureSubsetStrategy=settings.column_share, maxBins=settings.bins, seed=settings.seed, validationIndicatorCol="held",
    )
    ready = assembler.transform(rows.withColumn("held", held).withColumn("label", F.col("label").cast("double")))
    return PipelineModel([assembler, trees.fit(ready)])


def predict(model: PipelineModel, rows: DataFrame, name: str = "prob") -> DataFrame:
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.select(*rows.columns, name)


def predict_mean(models: list[PipelineModel], rows: DataFrame, name: str = "prob") -> DataFrame:
    """The mean of the fold models' probabilities."""
    out = rows
    for i, model in enumerate(models):
        out = predict(model, out, f"k_prob_{i}")
    total = sum((F.col(f"k_prob_{i}") for i in range(len(models))), F.lit(0.0))
    return out.withColumn(name, total / len(models)).select(*rows.columns, name)


def cross_validate(rows: DataFrame, features: list[str], folds: int = 5, settings: Boosting = Boosting()) -> tuple[list[PipelineModel], DataFrame]:
    """Fold models, and ``s1_id, pool_id, label, prob`` from the model that didn't see the entity."""
    rows = rows.withColumn("fold", group_fold(F.col("s1_id"), folds, settings.seed))
    models, scored = [], None
    for i in range(folds):
        models.append(train(rows.where(F.col("fold") != i), features, settings))
        own = predict(models[-1], rows.where(F.col("fold") == i)).select("s1_id", "pool_id", "label", "prob")
        scored = own if scored is None else scored.unionByName(own)
    return models, scored


def importances(models: list[PipelineModel], features: list[str]) -> dict[str, float]:
    """Mean importance over the models, largest first; a feature that none uses has 0."""
    sums = dict.fromkeys(features, 0.0)
    for model in models:
        for i, x in zip(*(lambda v: (v.indices.tolist(), v.values.tolist()))(model.stages[-1].featureImportances)):
            sums[features[i]] += x / len(models)
    return dict(sorted(sums.items(), key=lambda kv: (-kv[1], kv[0])))


def save(models: list[PipelineModel], path: str) -> None:
    for i, model in enumerate(models):
        model.write().overwrite().save(f"{path}/fold={i}")


def load(path: str, folds: int) -> list[PipelineModel]:
    return [PipelineModel.load(f"{path}/fold={i}") for i in range(folds)]
