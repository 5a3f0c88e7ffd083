"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD_PATTERN, lookup, store

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"
RANGES = 64


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """``source, source_size``: words of each source; a null source is a source."""
    return docs.groupBy("source").agg(F.sum(n_words("text")).alias("source_size"))


def with_position(sources: DataFrame) -> DataFrame:
    """Adds ``position`` (from 0) in code-point order, null last.

    Sources are dealt to ranges, numbered within them, and the ranges' counts
    (64 rows at most) are summed, so no task sorts all sources.
    """
    order = F.col("source").asc_nulls_last()
    dealt = store(
        sources.repartitionByRange(RANGES, order).withColumn("part", F.spark_partition_id()), "sources"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.join(F.broadcast(starts), "part").select(
        "source", "source_size", (F.col("start") + within).alias("position")
    )


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target`` for a ``source, source_size`` frame.

    Sources in code-point order (null last) weigh ``weights`` in turn and share
    the total.  A target stops at ``max_repeats`` times its source's size and
    the excess is shared anew by weight, until none is above.  Each round is one
    aggregate over the sources; the words left and the weight they are shared
    by are all that reaches the driver.  No rows give no rows.
    """
    whole = "decimal(38,0)"
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    known = store(
        with_position(sizes).select(
            "source", "source_size", weight.cast(whole).alias("weight"),
            (F.col("source_size").cast(whole) * max_repeats).cast(whole).alias("most"),
        ),
        "weights",
    )
    total, parts = known.agg(F.sum("source_size"), F.sum("weight")).first()
    left, share, stopped = int(total or 0), int(parts or 1), -1
    while True:
        above = F.lit(left).cast(whole) * F.col("weight") > F.col("most") * F.lit(share).cast(whole)
        n, used, free = known.agg(
            F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == stopped or not free:
            break
        left, share, stopped = int(total) - int(used or 0), int(free), n
    by_weight = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(share))
    return known.select(
        "source", "source_size", F.when(above, F.col("most").cast("double")).otherwise(by_weight).alias("target")
    )


def coin(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the document's id (its text, if it has no id)."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(seed + " "), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def plan(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """``doc`` (a struct of the input's columns), ``size``, ``source_size``, ``target``, ``copies``.

    A document is taken floor(rate) times, and once more if its coin falls below
    the rate's fraction; rate = target / source size, 0 for a source without
    words.  Null and empty texts have size 0.  Repeated rows share an id, so
    they are taken alike.  Extra columns, of any name, stay in ``doc``.
    """
    by_source = lookup(store(targets(source_sizes(docs), weights, max_repeats), "targets"))
    by_source = by_source.select(F.col("source").alias("by"), "source_size", "target")
    rows = docs.select(F.struct("*").alias("doc"), n_words("text").alias("size"))
    rows = rows.join(by_source, F.col("doc.source").eqNullSafe(F.col("by")), "left").drop("by")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    more = coin(F.col("doc.doc_id"), F.col("doc.text"), seed) < F.col("rate") - F.floor("rate")
    return rows.withColumn("rate", rate).select(
        "doc", "size", "source_size", "target", (F.floor("rate") + more.cast("long")).cast("long").alias("copies")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, same columns."""
    return plan(docs, **options).select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc.*")
