"""Sinks and the analysis store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

C = F.col

METRIC_TABLE_HEADER = ["experiment_id", "name", "direction", "lift", "ci_95", "ci_90", "status"]


def sink_metric_table(df: DataFrame, path: str) -> None:
    """Headline metric rows as header CSV."""
    columns = [c for c in METRIC_TABLE_HEADER if c in df.columns]
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def sink_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines; infinite doubles become NULL (JSON has none)."""
    fixed = {
        f.name: F.when(~C(f.name).isin(float("inf"), float("-inf")), C(f.name))
        for f in df.schema.fields
        if f.dataType.typeName() in ("double", "float")
    }
    df.withColumns(fixed).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def save_analysis(df: DataFrame, path: str, analyzed_at: Column) -> None:
    """Append a timestamped result, laid out by experiment."""
    out = df.withColumn("analyzed_at", analyzed_at.cast("timestamp"))
    out.write.mode("append").partitionBy("experiment_id").parquet(path)


def latest_analysis(df: DataFrame, keys: Sequence[str], at: str = "analyzed_at") -> DataFrame:
    """All rows of every experiment's newest analysis, one or more metrics.

    The newest time folds map-side and comes back by a join; a window would sort
    an experiment's whole history.
    """
    newest = df.groupBy(*keys).agg(F.max(at).alias("_newest"))
    newest = newest.select(*[C(k).alias(f"_on_{k}") for k in keys], "_newest")
    match = C(at) == C("_newest")
    for k in keys:
        match = match & C(k).eqNullSafe(C(f"_on_{k}"))
    return df.join(newest, match, "left_semi")


def list_experiments(df: DataFrame, status: str | None = None) -> DataFrame:
    """id, name, status, created, updated; newest first."""
    out = df.where(C("status") == status) if status else df
    return out.select("experiment_id", "name", "status", "created", "updated").orderBy(
        C("updated").desc(), "experiment_id"
    )


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
