"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Runtime settings the engine is designed around.  AQE sizes the shuffle from
# the real map output; forcing the skew-join rule lets it split a hot unit even
# when that costs one more exchange before the per-unit aggregate.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "trialspark") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # Static: capturing Python call sites triples the cost of building plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The cluster names that shared folder; only a local master without the
    setting (tests) falls back to a temporary directory of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/trialspark/{name}-{uuid.uuid4().hex}"


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for a plan; no job runs."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:
        return None


# A side is broadcast by hint only below this estimate; above it the join is
# shuffled (and salted where the key may be hot).
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= limit


SCAN_SPLIT_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on an input of few splits.

    Only when the whole input is smaller than one scan split per core; larger
    inputs already arrive in enough splits and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    if size is None or size > cores * SCAN_SPLIT_BYTES:
        return df
    return df.repartition(cores)


def small_side(df: DataFrame, name: str) -> DataFrame:
    """A reduced frame ready to be joined to a big one.

    It is stored first, so its real size is known: below the limit it carries a
    broadcast hint and the big side is not shuffled; above it the join stays a
    shuffle join.
    """
    stored = materialize(df, name)
    return stored.hint("broadcast") if fits_broadcast(stored) else stored


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row aggregate, as a scalar subquery."""
    value = one_row.select(F.struct(*one_row.columns).alias("_one")).scalar()
    return df.withColumn("_one", value).select("*", "_one.*").drop("_one")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a reduced frame to the shared folder and read it back.

    Used where one frame feeds a join with itself: it is then computed once,
    survives lost executors, and its doubles are the same bits on both sides.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
