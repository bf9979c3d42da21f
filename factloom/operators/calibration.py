"""Calibration of confidences: isotonic regression, its application, and Beta priors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pool(x: list[float], y: list[float], w: list[float]) -> tuple[list[float], list[float]]:
    """Upper bounds and values of the non-decreasing step function of least squares; x rises strictly."""
    stack: list[list[float]] = []  # upper bound, sum, weight
    for a, b, c in zip(x, y, w, strict=True):
        stack.append([a, b * c, c])
        while len(stack) > 1 and stack[-2][1] / stack[-2][2] > stack[-1][1] / stack[-1][2]:
            top = stack.pop()
            stack[-1] = [top[0], stack[-1][1] + top[1], stack[-1][2] + top[2]]
    return [s[0] for s in stack], [s[1] / s[2] for s in stack]


def refit(samples: DataFrame, by: list[str], least: int = 30, grain: int = 6) -> DataFrame:
    """by, n, thresholds, values: a model of each group of at least `least` samples (raw, outcome 0 or 1).

    Equal raw confidences are averaged before the shuffle to a group, so a group holds a row for each distinct
    confidence of at most `grain` decimals, however many samples it has.
    """
    points = samples.withColumn("raw", F.round("raw", grain)).groupBy(*by, "raw").agg(F.avg("outcome").alias("y"), F.count("*").cast("double").alias("w"))
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("raw")
        n = int(pdf["w"].sum())
        if n < least:
            return pd.DataFrame(columns=[*by, "n", "thresholds", "values"])
        x, v = pool(pdf["raw"].tolist(), pdf["y"].tolist(), pdf["w"].tolist())
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n": [n], "thresholds": [x], "values": [v]})

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, thresholds array<double>, values array<double>"
    return points.groupBy(*by).applyInPandas(fit, schema)


def apply_isotonic(raw: Column, thresholds: Column, values: Column) -> Column:
    """Value at the least threshold that isn't below raw, the last beyond all; without a model raw itself."""
    at = F.size(F.filter(thresholds, lambda t: t < raw))
    found = F.try_element_at(values, F.least(at + 1, F.size(values)))
    return F.when(thresholds.isNull() | (F.size(thresholds) == 0), raw).otherwise(found)


def calibrate(facts: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    """facts with column calibrated; models has by, thresholds, values."""
    out = facts.join(models.select(*by, "thresholds", "values"), by, "left")
    return out.withColumn("calibrated", apply_isotonic(F.col("confidence"), F.col("thresholds"), F.col("values"))).drop("thresholds", "values")


def beta_prior(samples: DataFrame, by: list[str]) -> DataFrame:
    """alpha, beta and mean of a Beta distribution from outcomes, one of each given."""
    out = samples.groupBy(*by).agg((1 + F.count_if(F.col("outcome") == 1)).alias("alpha"), (1 + F.count_if(F.col("outcome") == 0)).alias("beta"))
    return out.withColumn("mean", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 9))
