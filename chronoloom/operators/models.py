"""Decision trees over feature rows, with classes weighed evenly."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(examples: DataFrame) -> DataFrame:
    """Adds `weight`, by which both classes of y count alike. The class counts are two rows."""
    counts = {r.y: r.n for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, total / (len(counts) * n))])
    return examples.withColumn("weight", F.element_at(weight, F.col("y")))


def train_classifier(examples: DataFrame, depth: int = 6, leaf: int = 15):
    """A tree for (x array<double>, y double), or None when there is but one class."""
    if examples.select("y").distinct().limit(2).count() < 2:
        return None
    rows = balanced(examples).withColumn("features", array_to_vector("x"))
    return DecisionTreeClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxDepth=depth, minInstancesPerNode=leaf, seed=0).fit(rows)


def train_regressor(examples: DataFrame, depth: int = 6, leaf: int = 15):
    """A tree for a number, or None under `leaf` rows."""
    if examples.limit(leaf).count() < leaf:
        return None
    return DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=depth, minInstancesPerNode=leaf, seed=0).fit(examples.withColumn("features", array_to_vector("x")))


def probabilities(model, rows: DataFrame, name: str = "probability") -> DataFrame:
    """`rows` with the chance of class 1; 0.5 without a model."""
    if model is None:
        return rows.withColumn(name, F.lit(0.5))
    scored = model.transform(rows.withColumn("features", array_to_vector("x")))
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias(name))
