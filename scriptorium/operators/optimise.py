"""Parameter prediction from image features by random forests, with snapping and a fixed fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import snap
from scriptorium.operators.response import upper_median


@dataclass
class ParameterModel:
    """One fitted pipeline for each parameter, with hold-out accuracies and mean feature importances."""

    pipelines: dict[str, PipelineModel]
    grid: dict[str, list[float]]
    features: list[str]
    accuracy: dict[str, float]
    importance: list[tuple[str, float]]

    def predict(self, images: DataFrame, snapped: bool = True) -> DataFrame:
        """`images` with a column for each parameter; the grid's upper median where a feature is missing."""
        out = images.withColumns({f: F.col(f).cast("double") for f in self.features})
        known = F.lit(True)
        for f in self.features:
            known = known & F.col(f).isNotNull()
        out = out.withColumn("__known", known).fillna(0.0, self.features)
        for p, model in self.pipelines.items():
            out = model.transform(out).drop("__raw", "__scaled", "__label", "__prediction", "__votes", "__share")
            value = F.col("__value").cast("double")
            out = out.withColumn(p, F.when(F.col("__known"), snap(value, self.grid[p]) if snapped else value).otherwise(upper_median(self.grid[p]))).drop("__value")
        return out.drop("__known")


def train_parameter_model(
    rows: DataFrame, features: list[str], grid: dict[str, list[float]], trees: int = 100, depth: int = 8, seed: int = 42
) -> ParameterModel | None:
    """Fits a forest for each parameter of `grid` on `rows` (features and best parameters). None for fewer than four rows; with fewer than six,
    training rows are also the test rows, and else a seeded fifth is held out."""
    rows = rows.withColumns({f: F.col(f).cast("double") for f in features}).na.drop(subset=[*features, *grid])
    n = rows.limit(6).count()
    if n < 4:
        return None
    train, test = (rows, rows) if n < 6 else rows.randomSplit([0.8, 0.2], seed)
    if test.isEmpty():
        test = train
    pipelines, accuracy, total = {}, {}, dict.fromkeys(features, 0.0)
    for p in grid:
        index = StringIndexer(inputCol="__target", outputCol="__label", handleInvalid="keep", stringOrderType="alphabetAsc")
        labels = index.fit(rows.withColumn("__target", F.col(p).cast("string"))).labels
        forest = RandomForestClassifier(
            labelCol="__label", featuresCol="__scaled", predictionCol="__prediction", rawPredictionCol="__votes", probabilityCol="__share",
            numTrees=trees, maxDepth=depth, minInstancesPerNode=1, seed=seed,
        )
        steps = [
            VectorAssembler(inputCols=features, outputCol="__raw"),
            StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True),
        ]
        data = index.fit(rows.withColumn("__target", F.col(p).cast("string"))).transform(train.withColumn("__target", F.col(p).cast("string")))
        model = Pipeline(stages=[*steps, forest, IndexToString(inputCol="__prediction", outputCol="__value", labels=[*labels, ""])]).fit(data)
        judged = index.fit(rows.withColumn("__target", F.col(p).cast("string"))).transform(test.withColumn("__target", F.col(p).cast("string")))
        evaluator = MulticlassClassificationEvaluator(labelCol="__label", predictionCol="__prediction", metricName="accuracy")
        accuracy[p] = evaluator.evaluate(model.transform(judged))
        pipelines[p] = model
        for f, v in zip(features, model.stages[2].featureImportances.toArray(), strict=True):
            total[f] += float(v) / len(grid)
    return ParameterModel(pipelines, grid, features, accuracy, sorted(total.items(), key=lambda x: -x[1])[:10])


def fixed_parameters(images: DataFrame, best: dict[str, float] | None, grid: dict[str, list[float]]) -> DataFrame:
    """`images` with the same parameters for all: those of `best`, and the grid's upper medians for the others."""
    return images.withColumns({p: F.lit(float((best or {}).get(p, upper_median(v)))) for p, v in grid.items()})
