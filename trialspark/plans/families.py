"""A family of tests per nation: is a supplier's returned share unusual?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.distributions import norm_two_sided
from ..operators.joins import join_dimension
from ..session import attach_one_row
from ..sources.readers import read_tables

C = F.col


def supplier_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    """(family, test_id, p_value); p is kept to three digits so that ties occur."""
    t = read_tables(spark, sf, ["lineitem", "supplier"])
    counts = t["lineitem"].groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(C("l_returnflag") == "R", 1)).alias("k")
    )
    cells = join_dimension(counts, t["supplier"].select("s_suppkey", "s_nationkey"), C("l_suppkey") == C("s_suppkey"), "inner")
    joined = attach_one_row(cells, cells.agg((F.sum("k") / F.sum("n")).alias("p0")))
    z = (C("k") / C("n") - C("p0")) / F.sqrt(C("p0") * (1 - C("p0")) / C("n"))
    return joined.select(
        C("s_nationkey").alias("family"), C("l_suppkey").alias("test_id"),
        F.round(norm_two_sided(z), 3).alias("p_value"),
    )
