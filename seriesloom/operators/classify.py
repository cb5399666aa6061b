"""Binary logistic regression of a label on all other numeric columns."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from seriesloom.sources.artifacts import settle


def _complete(names: list[str]) -> Column:
    """Whether none of the columns is null or not a number."""
    return reduce(and_, [F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for n in names], F.lit(True))


def feature_columns(df: DataFrame, label: str, drop: list[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if f.name != label and f.name not in drop and isinstance(f.dataType, NumericType)
    ]


def train_classifier(
    df: DataFrame, label: str, drop: list[str] = (), max_iter: int = 100, strength: float = 1.0
) -> tuple[LogisticRegressionModel, list[str]]:
    """Fit on the distributed frame; rows with a missing feature or label teach nothing.

    ``strength`` is the weight of the summed loss against the squared weights of the raw features; 0 turns
    the penalty off.
    """
    names = feature_columns(df, label, drop)
    known = df.select(F.col(label).cast("double").alias("label"), *names).where(_complete(["label", *names]))
    known, seen = settle(known, "labelled", {"rows": F.count(F.lit(1))})
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(known)
    penalty = 1.0 / (strength * max(1, seen["rows"])) if strength else 0.0
    model = LogisticRegression(maxIter=max_iter, regParam=penalty, standardization=False)
    return model.fit(rows.select("label", "features")), names


def coefficient_table(df: DataFrame, model: LogisticRegressionModel, names: list[str]) -> DataFrame:
    """Intercept and one coefficient per feature (a few rows by definition)."""
    rows = [("(intercept)", float(model.intercept))]
    rows += [(name, float(value)) for name, value in zip(names, model.coefficients.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def slopes(df: DataFrame, label: str, model: LogisticRegressionModel, names: list[str]) -> DataFrame:
    """How steep the mean penalised loss is at the model's weights, per standard deviation of each feature, from one aggregate.

    Rows with a missing feature or label don't count, as in the fit. A feature that doesn't vary is measured in its own unit.
    """
    known = df.select(F.col(label).cast("double").alias("_label"), *names).where(_complete(["_label", *names]))
    weights = dict(zip(names, map(float, model.coefficients.toArray()), strict=True))
    score = reduce(add, [F.col(n) * w for n, w in weights.items()], F.lit(float(model.intercept)))
    gap = 1 / (1 + F.exp(-score)) - F.col("_label")
    penalty = model.getOrDefault("regParam")
    spread = {n: F.coalesce(F.nullif(F.stddev_pop(n), F.lit(0.0)), F.lit(1.0)) for n in names}
    entries = [("(intercept)", F.avg(gap)), *((n, (F.avg(gap * F.col(n)) + penalty * w) / spread[n]) for n, w in weights.items())]
    seen = known.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*[F.struct(F.lit(n).alias("feature"), s.alias("slope")) for n, s in entries]).alias("_all"))
    return seen.select("n_rows", F.inline("_all")).select("feature", "n_rows", "slope")


def predict_labels(df: DataFrame, model: LogisticRegressionModel, names: list[str]) -> DataFrame:
    """Add ``prediction`` to every row; it is null where a feature is missing."""
    rows = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df)
    made = model.transform(rows).drop("features", "rawPrediction", "probability")
    return made.withColumn("prediction", F.when(_complete(names), F.col("prediction")))
