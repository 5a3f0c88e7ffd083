"""Running experiments watched as streams.

State is a handful of aggregates per window or arm; the statistics are the
batch columns, applied in `foreachBatch`.  Each micro-batch overwrites its own
`batch_id` folder, so a replayed batch does not count twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed_values import MSPRT_MIN_N, SRM_TREND_THRESHOLD
from ..functions.columns import num
from ..operators.moments import pair_arms
from ..operators.sequential import msprt_test
from ..operators.srm import srm_from_counts
from ..session import scratch_dir

C = F.col


def batch_writer(path: str, transform: Callable[[DataFrame], DataFrame]):
    """A foreachBatch function that writes one idempotent folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_available(stream: DataFrame, mode: str, path: str, transform=lambda df: df) -> None:
    """Process what is there and stop; offsets and state live in the shared folder."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/_state")
        .foreachBatch(batch_writer(f"{path}/data", transform))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; parquet may hold TIMESTAMP_NTZ."""
    return df.withColumn(ts, C(ts).cast("timestamp"))


def windowed_arm_counts(
    events: DataFrame, keys: Sequence[str], ts: str, window: str, delay: str, arm: str = "arm"
) -> DataFrame:
    return (
        event_time(events, ts)
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, window), *keys, arm)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stream_srm_trend(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    path: str,
    window: str = "1 day",
    delay: str = "1 hour",
    arm: str = "arm",
) -> None:
    """Closed windows only (append mode); late rows past the watermark are dropped."""
    counts = windowed_arm_counts(events, keys, ts, window, delay, arm)
    run_available(
        counts.select(*keys, C("window.start").alias("window_start"), arm, "n"), "append", path
    )


def srm_of_closed_windows(
    spark: SparkSession, path: str, keys: Sequence[str], arm: str = "arm", expected=None,
    threshold: float = SRM_TREND_THRESHOLD,
) -> DataFrame:
    """Verdicts over everything the stream has closed so far."""
    counts = spark.read.parquet(f"{path}/data").groupBy(*keys, "window_start", arm).agg(
        F.sum("n").alias("n")
    ).where(C(arm).isNotNull())
    # An arm that a window lacks counts 0 there: the number of arms is the experiment's.
    arms = counts.groupBy(*keys).agg(F.count_distinct(arm).alias("_arms"))
    counts = counts.join(arms, list(keys))
    return srm_from_counts(counts, [*keys, "window_start"], arm, expected, threshold, n_arms="_arms")


def stream_sequential_monitor(
    units: DataFrame,
    keys: Sequence[str],
    path: str,
    value: str = "value",
    arm: str = "arm",
    control: str = "control",
    alpha: float = 0.05,
    min_n: int = MSPRT_MIN_N,
) -> None:
    """Running n, mean and variance per arm, tested after every micro-batch.

    Complete mode: the state is one row per cell and arm, and a pair needs both.
    """
    v = num(value)
    state = units.where(C(arm).isNotNull()).groupBy(*keys, arm).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.sum(v).alias("total")
    )

    def test(batch: DataFrame) -> DataFrame:
        pairs = pair_arms(batch, keys, arm, control).where(C("n_control").isNotNull())
        return msprt_test(pairs, alpha, None, min_n)

    run_available(state, "complete", path, test)


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest finished batch."""
    data = spark.read.parquet(f"{path}/data")
    newest = data.agg(F.max("batch_id")).scalar()
    return data.where(C("batch_id") == newest).drop("batch_id")


def stream_sample_accumulation(
    events: DataFrame,
    keys: Sequence[str],
    unit: str,
    ts: str,
    path: str,
    planned_duration: str,
    delay: str = "1 hour",
    start_offset: str = "0 seconds",
) -> None:
    """First appearance of every unit, in update mode.

    The state is keyed by the experiment's planned window, so it is dropped once
    that window and the delay have passed.
    """
    firsts = (
        event_time(events, ts)
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, planned_duration, startTime=start_offset), *keys, unit)
        .agg(F.min(ts).alias("first_seen"))
    )
    run_available(firsts.select(*keys, unit, "first_seen"), "update", path)


def units_per_day(spark: SparkSession, path: str, keys: Sequence[str], unit: str) -> DataFrame:
    """New units per day; updates of the same unit collapse to its earliest."""
    firsts = spark.read.parquet(f"{path}/data").groupBy(*keys, unit).agg(
        F.min("first_seen").alias("first_seen")
    )
    return firsts.groupBy(*keys, F.to_date("first_seen").alias("day")).agg(
        F.count(F.lit(1)).alias("new_units")
    )


def stream_folder(spark: SparkSession, name: str) -> str:
    return scratch_dir(spark, name)
