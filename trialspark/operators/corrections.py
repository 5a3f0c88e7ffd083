"""Multiple-comparison corrections within families of any size.

Tied p-values share their adjusted value, so families are first reduced to
distinct p with counts.  Running maxima and minima then go bucket by bucket
(buckets follow p), and only one row per bucket crosses a family-wide window:
no task sorts a whole family.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

C = F.col
BUCKETS = 256


def _bucket(p: Column) -> Column:
    """Non-decreasing in p: even slices above 1/BUCKETS, log slices below."""
    fine = F.greatest(F.floor(F.log2(F.greatest(p, F.lit(1e-300))) * 4), F.lit(-4000))
    even = F.floor(p * BUCKETS)
    return F.when(p < 1.0 / BUCKETS, fine).otherwise(even).cast("int")


def adjust_pvalues(
    df: DataFrame,
    family: Sequence[str],
    p: str = "p_value",
    method: str = "holm",
    alpha: float = 0.05,
) -> DataFrame:
    """Adds `p_adjusted` and `rejected`; rows whose p-value is NULL or NaN stay NULL and do not count."""
    out = adjust_all(df, family, p, [method])
    return out.withColumnRenamed(f"p_{method}", "p_adjusted").withColumn(
        "rejected", C("p_adjusted") <= alpha
    )


METHODS = ("holm", "bonferroni", "fdr_bh")


def adjust_all(
    df: DataFrame, family: Sequence[str], p: str = "p_value", methods: Sequence[str] = METHODS
) -> DataFrame:
    """Several corrections from one ranking: adds `p_<method>` for each.

    The test frame is stored first: adjusted values come back by a join on the
    p-value itself, which must be the same bits on both sides.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown method {sorted(unknown)}")
    fam = list(family)
    df = materialize(df, "tests")
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    earlier = (Window.unboundedPreceding, -1)
    distinct = (
        df.where(C(p).isNotNull() & ~F.isnan(p))
        .groupBy(*fam, C(p).alias("_p"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", _bucket(C("_p")))
    )
    rising = Window.partitionBy(*fam, "_b").orderBy("_p")
    falling = Window.partitionBy(*fam, "_b").orderBy(C("_p").desc())
    local = distinct.withColumn("_upto", F.sum("_c").over(rising.rowsBetween(*up_to_here)))
    family_rising = Window.partitionBy(*fam).orderBy("_b").rowsBetween(*earlier)
    family_falling = Window.partitionBy(*fam).orderBy(C("_b").desc()).rowsBetween(*earlier)
    offsets = local.groupBy(*fam, "_b").agg(F.sum("_c").alias("_bc")).withColumns(
        {
            "_before": F.coalesce(F.sum("_bc").over(family_rising), F.lit(0)),
            "_m": F.sum("_bc").over(Window.partitionBy(*fam)),
        }
    )
    ranked = _join_null_safe(local, offsets.drop("_bc"), [*fam, "_b"]).withColumn(
        "_upto", C("_upto") + C("_before")
    )
    # Step-down and step-up candidates of every distinct p.
    ranked = ranked.withColumns(
        {
            "_down": (C("_m") - (C("_upto") - C("_c"))) * C("_p"),
            "_up": C("_m") / C("_upto") * C("_p"),
        }
    )
    edges = (
        ranked.groupBy(*fam, "_b")
        .agg(F.max("_down").alias("_d"), F.min("_up").alias("_u"))
        .withColumns(
            {"_d": F.max("_d").over(family_rising), "_u": F.min("_u").over(family_falling)}
        )
    )
    picks = {
        "holm": F.greatest(F.max("_down").over(rising.rowsBetween(*up_to_here)), C("_d")),
        "fdr_bh": F.least(F.min("_up").over(falling.rowsBetween(*up_to_here)), C("_u")),
        "bonferroni": C("_m") * C("_p"),
    }
    adjusted = _join_null_safe(ranked, edges, [*fam, "_b"]).select(
        *fam, C("_p").alias(p), *[F.least(F.lit(1.0), picks[m]).alias(f"p_{m}") for m in methods]
    )
    return _join_null_safe(df, adjusted, [*fam, p], "left")


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which a NULL key is a key like any other."""
    right = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    match = F.lit(True)
    for c in on:
        match = match & C(c).eqNullSafe(C(f"_on_{c}"))
    return left.join(right, match, how).drop(*[f"_on_{c}" for c in on])
