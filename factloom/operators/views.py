"""Views that are kept up by what changed: partial states that can be summed, and a new version swapped in at the end.

A view's state has a row for each key and unit of time with sums: counts, totals, counts of prices. Rows that came late are
added, rows that were withdrawn are taken off, both as sums of the change alone: of the source only the change is read.
All sums are whole numbers or decimals, so any order and any cutting of the changes gives the same state to the last digit. A
state is written beside the one before under its batch's number, and counts from its success mark on; a batch that is applied
again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.analytics import bucket, clusters_of_counts, since

#: Numbers are summed as decimals with so many places.
EXACT = "decimal(38,9)"


@dataclass(frozen=True)
class View:
    """keys and sums: columns of a source row; finish: what is shown of the summed states, as of a moment, which is to be
    a whole hour, or for states by day a whole day.

    Only sums are kept, so what finish makes of them has to be a function of sums.
    """

    name: str
    keys: dict[str, Column]
    sums: dict[str, Column]
    finish: Callable[[DataFrame, str], DataFrame]


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("int")


def _total(name: str) -> Column:
    return F.coalesce(F.col(name).cast(EXACT), F.lit(0).cast(EXACT))


def _recent(at: str, days: float) -> Callable[[DataFrame, str], DataFrame]:
    """States of the last days; the unit that begins just then is among them."""
    return lambda states, as_of: states.filter(since(at, as_of, days) | (F.col(at) == F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{int(days * 24)}' HOUR")))


def fleet_overview(days: float = 7) -> View:
    """Versions (tenant, category, created_at, confidence, attributes) by hour; as_of in whole hours."""

    def finish(states: DataFrame, as_of: str) -> DataFrame:
        mean = F.when(F.col("rated") > 0, F.col("confidence").cast("double") / F.col("rated"))
        return _recent("hour", days)(states, as_of).select("tenant", "category", "hour", "n", mean.alias("avg_confidence"), "with_attributes")

    sums = {"rated": _flag(F.col("confidence") != 0), "confidence": _total("confidence"), "with_attributes": _flag(F.col("attributes") != "{}")}
    return View("fleet_overview", {"tenant": F.col("tenant"), "category": F.col("category"), "hour": bucket("hour", "created_at")}, sums, finish)


def domain_health(days: float = 7) -> View:
    """Selectors (domain, parser, ts, success) by hour."""
    finish = lambda states, as_of: _recent("hour", days)(states, as_of).select("domain", "parser", "hour", F.col("n").alias("fired"), "success")
    return View("domain_health", {"domain": F.col("domain"), "parser": F.col("parser"), "hour": bucket("hour", "ts")}, {"success": _flag(F.col("success"))}, finish)


def field_completeness(fields: list[str], days: float = 1) -> View:
    """Versions (tenant, category, created_at, fields): rows and filled fields of the last days, kept by hour."""
    names = [f"with_{f}" for f in fields]
    finish = lambda states, as_of: _recent("hour", days)(states, as_of).groupBy("tenant", "category").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    filled = {f"with_{f}": _flag(F.col(f).isNotNull() & (F.col(f).cast("string") != "")) for f in fields}
    return View("field_completeness", {"tenant": F.col("tenant"), "category": F.col("category"), "hour": bucket("hour", "created_at")}, filled, finish)


def parser_versions(days: float = 14) -> View:
    """Runs (extractor, mapper, policy, created_at) by day."""
    by = ["extractor", "mapper", "policy"]
    return View("parser_versions", {**{c: F.col(c) for c in by}, "day": bucket("day", "created_at")}, {}, lambda states, as_of: _recent("day", days)(states, as_of).select(*by, "day", "n"))


def cost_panel(days: float = 30) -> View:
    """Calls (tenant, ts, cost, prompt_tokens, completion_tokens) by day."""
    shown = lambda c: F.col(c).cast("double").alias(c)
    finish = lambda states, as_of: _recent("day", days)(states, as_of).select("tenant", "day", shown("cost"), shown("prompt_tokens"), shown("completion_tokens"), F.col("n").alias("calls"))
    return View("cost_panel", {"tenant": F.col("tenant"), "day": bucket("day", "ts")}, {c: _total(c) for c in ("cost", "prompt_tokens", "completion_tokens")}, finish)


def price_clusters(by: list[str], least: int = 10) -> View:
    """Prices (by, price): exact medians, from how often each price is there."""
    finish = lambda states, as_of: clusters_of_counts(states.withColumnRenamed("n", "c"), by, "price", least)
    return View("price_clusters", {c: F.col(c) for c in [*by, "price"]}, {}, finish)


def states_of(view: View, changes: DataFrame) -> DataFrame:
    """A view's states of changes: source rows with change, 1 for rows that came and -1 for rows that were withdrawn."""
    sums = {"n": F.lit(1), **view.sums}
    each = changes.select(*[c.alias(k) for k, c in view.keys.items()], *[(c * F.col("change")).alias(f"{k}") for k, c in sums.items()])
    return summed(view, each)


def summed(view: View, states: DataFrame) -> DataFrame:
    kinds = {k: EXACT if states.schema[k].dataType.typeName() == "decimal" else "long" for k in ("n", *view.sums)}
    out = states.groupBy(*view.keys).agg(*[F.sum(F.col(k)).cast(kind).alias(k) for k, kind in kinds.items()])
    gone = F.lit(True)
    for k in kinds:
        gone = gone & (F.col(k) == 0)
    return out.filter(~gone)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose state is complete, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [str(s.getPath().getName()) for s in fs.listStatus(path)]
    done = [int(n.removeprefix("batch=")) for n in found if n.startswith("batch=")]
    return sorted(n for n in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={n}/_SUCCESS")))


def refresh(view: View, folder: str, changes: DataFrame, batch: int) -> bool:
    """Apply the changes of a batch (numbers rise) to the view in folder; False if that has been done before.

    The states are read, summed with those of the changes and written as a whole; the two newest versions stay, so that
    who reads the one before can end. A run that dies leaves no success mark, and its folder is written anew.
    """
    spark = changes.sparkSession
    done = _versions(spark, folder)
    if done and batch <= done[-1]:
        return False
    states = states_of(view, changes)
    if done:
        states = summed(view, spark.read.parquet(f"{folder}/batch={done[-1]}").unionByName(states))
    states.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    for old in done[:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return True


def rebuild(view: View, folder: str, rows: DataFrame, batch: int) -> None:
    """Write the view's state anew from all rows, as of a batch, whatever was there; the batches up to it are done then."""
    states_of(view, rows.withColumn("change", F.lit(1))).write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def shown(view: View, spark: SparkSession, folder: str, as_of: str) -> DataFrame:
    """The view's newest complete version, as of a moment."""
    done = _versions(spark, folder)
    if not done:
        raise ValueError(f"{view.name} has not been built in {folder}")
    return view.finish(spark.read.parquet(f"{folder}/batch={done[-1]}"), as_of)
