"""Experiments derived from the star schema by plain arithmetic.

The tables hold no experiment, so arms come from modulo on the unit's key; any
SQL engine can repeat that exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.joins import first_exposure, join_dimension, join_exposure, join_units_zero_filled
from ..sources.readers import read_tables

C = F.col
EXPOSURE = "1998-01-01"
HORIZON_DAYS = 180
# Ends of the first and start of the last third of the exposure window.
FIRST_THIRD, LAST_THIRD = "1999-03-15", "2000-05-27"


def arm_of(key: str):
    return F.when(C(key) % 2 == 0, "control").otherwise("treatment")


def customer_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """One experiment per nation; unit = customer; exposed on a fixed day."""
    t = read_tables(spark, sf, ["customer", "nation", "region"])
    dims = join_dimension(t["nation"], t["region"], C("n_regionkey") == C("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name"
    )
    cust = join_dimension(t["customer"], dims, C("c_nationkey") == C("n_nationkey"))
    return cust.select(
        C("n_name").alias("experiment_id"),
        C("c_custkey").alias("unit_id"),
        arm_of("c_custkey").alias("arm"),
        F.lit(EXPOSURE).cast("timestamp").alias("first_exposure_at"),
        "c_mktsegment",
        C("r_name").alias("region"),
        "c_acctbal",
    )


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        C("o_custkey").alias("unit_id"),
        C("o_orderdate").cast("timestamp").alias("event_at"),
        C("o_totalprice").alias("amount"),
        C("o_orderkey").alias("order_id"),
        C("o_orderpriority").alias("priority"),
    )


def customer_units(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: revenue before and after exposure, orders, conversion.

    Facts are folded per unit in one aggregate and joined to every assigned
    unit; units without orders count 0.  The exposure time is one constant, so
    no event-level join is needed.
    """
    assign = customer_assignment(spark, sf)
    start = F.lit(EXPOSURE).cast("timestamp")
    end = start + F.make_dt_interval(days=F.lit(HORIZON_DAYS))
    at, amount = C("event_at"), C("amount")
    folded = (
        order_facts(spark, sf)
        .groupBy("unit_id")
        .agg(
            F.sum(F.when(at < start, amount).otherwise(0.0)).alias("pre_value"),
            F.sum(F.when(at >= start, amount).otherwise(0.0)).alias("value"),
            F.sum(
                F.when((at >= start) & (at < F.lit(FIRST_THIRD).cast("timestamp")), amount).otherwise(0.0)
            ).alias("early_value"),
            F.sum(F.when(at >= F.lit(LAST_THIRD).cast("timestamp"), amount).otherwise(0.0)).alias("late_value"),
            F.count(F.when(at >= start, 1)).alias("orders"),
            F.max(F.when((at >= start) & (at < end), 1).otherwise(0)).alias("converted"),
        )
    )
    return join_units_zero_filled(
        assign, folded, ["unit_id"],
        ["pre_value", "value", "early_value", "late_value", "orders", "converted"],
    )


def customer_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: price (numerator) over line items (denominator)."""
    t = read_tables(spark, sf, ["orders", "lineitem"])
    lines = t["lineitem"].groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("items")
    )
    per_unit = (
        t["orders"].select("o_orderkey", C("o_custkey").alias("unit_id"))
        .join(lines, C("o_orderkey") == C("l_orderkey"))
        .groupBy("unit_id")
        .agg(F.sum("price").alias("numerator"), F.sum("items").cast("double").alias("denominator"))
    )
    assign = customer_assignment(spark, sf)
    return join_units_zero_filled(assign, per_unit, ["unit_id"], ["numerator", "denominator"])


def event_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows with an arm; one experiment per event type family."""
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.lit("exp_"), C("event_type")).alias("experiment_id"),
        "event_id",
        C("ts").cast("timestamp").alias("event_at"),
        C("user_id").alias("unit_id"),
        arm_of("user_id").alias("arm"),
        "event_type",
        "value",
    )


def thinned_events(spark: SparkSession, sf: str) -> DataFrame:
    """Mid-flight loss: a third of the treatment events of the second half is missing."""
    ev = event_facts(spark, sf)
    lost = (C("arm") == "treatment") & (C("event_id") % 3 == 0) & (
        C("event_at") >= F.lit("2024-01-16").cast("timestamp")
    )
    return ev.where(~lost)


def event_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """First view of a user is its exposure."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select(
        C("user_id").alias("unit_id"), C("ts").cast("timestamp").alias("event_at"), "event_type"
    )
    firsts = first_exposure(ev, "unit_id", "event_at", C("event_type") == "view")
    return firsts.select(
        F.lit("first_view").alias("experiment_id"), "unit_id", arm_of("unit_id").alias("arm"),
        "first_exposure_at",
    )


def exposed_events(spark: SparkSession, sf: str, horizon_days: float | None = None) -> DataFrame:
    facts = spark.read.parquet(f"{sf}/events.parquet").select(
        C("user_id").alias("unit_id"), C("ts").cast("timestamp").alias("event_at"),
        "event_id", "event_type", "value",
    )
    return join_exposure(facts, event_assignment(spark, sf), horizon_days=horizon_days)
