"""Classical detectors by the engine's own learners, with class weights, checkpoints and seeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.operators.evaluate import confusion

SEEDS = [42, 123, 456, 789, 1024]


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """df with features, a vector of columns without nulls."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def weighted(df: DataFrame, y: str) -> DataFrame:
    """df with weight N / (2 N_c) of its class."""
    counts = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    total = sum(counts.values())
    return df.withColumn("weight", F.when(F.col(y) == 1, total / (2 * counts.get(1, total))).otherwise(total / (2 * counts.get(0, total))))


def logistic_regression(train: DataFrame, y: str, seed: int = 42):
    """Weighted logistic loss with a small L2 penalty, to convergence."""
    return LogisticRegression(featuresCol="features", labelCol=y, weightCol="weight", regParam=1e-4, maxIter=50).fit(train)


def random_forest(train: DataFrame, y: str, trees: int = 64, seed: int = 42, most_rows: int = 500_000):
    """Depth 16, 20 rows a leaf, root of the features per split, at most ``most_rows`` draws a tree."""
    share = min(1.0, most_rows / max(train.count(), 1))
    return RandomForestClassifier(featuresCol="features", labelCol=y, weightCol="weight", numTrees=trees, maxDepth=16, minInstancesPerNode=20, featureSubsetStrategy="sqrt", subsamplingRate=share, seed=seed, maxMemoryInMB=128).fit(train)


def boosted_trees(train: DataFrame, y: str, rounds: int = 100, seed: int = 42):
    """Depth 6, step 0.1, 128 bins, four fifths of the rows a round."""
    return GBTClassifier(featuresCol="features", labelCol=y, weightCol="weight", maxIter=rounds, maxDepth=6, stepSize=0.1, maxBins=128, subsamplingRate=0.8, seed=seed).fit(train)


def perceptron(train: DataFrame, y: str, features: int, seed: int = 42, iterations: int = 100):
    """Hidden layers of 64 and 32. This learner takes no weights, so rows of the rarer class are repeated until the
    classes are of like size."""
    counts = {r[y]: r["n"] for r in train.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    most = max(counts.values())
    times = F.when(F.col(y) == 1, max(1, round(most / counts.get(1, most)))).otherwise(max(1, round(most / counts.get(0, most))))
    even = train.withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=y, layers=[features, 64, 32, 2], maxIter=iterations, blockSize=128, seed=seed).fit(even)


def predicted(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the malicious probability of every row."""
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score"))


def checkpoints(train: Callable[[int], object], steps: list[int], validation: DataFrame, y: str, patience: int = 2, least: float = 1e-5) -> tuple[object, int, list[float]]:
    """The model of the best validation macro-F1 over growing budgets, its budget and all values; ends after
    ``patience`` budgets without a gain of ``least``, ties keep the smaller budget."""
    best, kept, at, bad, seen = float("-inf"), None, 0, 0, []
    for step in steps:
        model = train(step)
        value = confusion(predicted(model, validation, [y]), [], y, "score", F.lit(0.5)).first()["macro_f1"]
        seen.append(value)
        if value > best + least:
            best, kept, at, bad = value, model, step, 0
        else:
            bad += 1
            if bad >= patience:
                break
    return kept, at, seen


def by_seed(run: Callable[[int], DataFrame], seeds: list[int] = SEEDS) -> DataFrame:
    """The rows of a fresh run for each seed, with the seed."""
    made = None
    for seed in seeds:
        one = run(seed).withColumn("seed", F.lit(seed))
        made = one if made is None else made.unionByName(one)
    return made


def save(model, path: str) -> None:
    """Refuses to overwrite."""
    (model if hasattr(model, "write") else PipelineModel([model])).write().save(path)
