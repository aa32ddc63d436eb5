"""Fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc, n): chance that a positive outscores a negative, ties half; exact, over distinct scores folded to counts."""
    g = df.groupBy(score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy().orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = g.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2)).agg(F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return s.select((F.col("w") / F.nullif(F.col("p") * F.col("q"), F.lit(0.0))).alias("auc"), (F.col("p") + F.col("q")).cast("long").alias("n"))


def logistic_report(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(auc, n, intercept, one coefficient for each standardised feature) of a logistic model fitted over all rows.

    Scores are rounded to four digits in front of the AUC, which bounds its ranking to ten thousand groups.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stats = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    z = df.select(label, *[((F.col(f) - F.lit(stats[f"m_{f}"] or 0.0)) / F.lit(stats[f"s_{f}"] or 1.0)).alias(f) for f in features])
    data = VectorAssembler(inputCols=list(features), outputCol="x").transform(z).select(F.col(label).alias("label"), F.col("x").alias("features"))
    model = LogisticRegression(maxIter=30, regParam=1e-4, standardization=False).fit(data)
    scored = model.transform(data).select("label", F.round(vector_to_array("probability")[1], 4).alias("p"))
    out = auc(scored, "p", "label").withColumn("intercept", F.lit(round(float(model.intercept), 6)))
    for f, c in zip(features, model.coefficients):
        out = out.withColumn(f"b_{f}", F.lit(round(float(c), 6)))
    return out.withColumn("auc", F.round("auc", 6))
