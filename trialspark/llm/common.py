"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialspark.session import materialize

# A word: a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# A table is sent to every executor only below this decoded size.
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: few rows each, so that a worker holds little."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def id_text(doc_id: str | Column = "doc_id") -> Column:
    """The id as text; a null id counts as empty text."""
    return F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))


def utf8(text: str | Column = "text") -> Column:
    """A text's UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def store(df: DataFrame, name: str) -> DataFrame:
    """Written below spark.checkpoint.dir and read back: computed once, safe from lost executors."""
    return materialize(df, f"llm-{name}")


def lookup(stored: DataFrame, arrays: Sequence[str] = ()) -> DataFrame:
    """A stored table for the lookup side of a join.

    Its cells are counted; below ``BROADCAST_BYTES`` (16 bytes a cell) it carries
    a broadcast hint, beyond it the join shuffles and Spark splits hot keys of
    the other side.
    """
    sums = [F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in arrays]
    row = stored.agg(F.count(F.lit(1)), *sums).first()
    cells = row[0] * len(stored.columns) + sum(row[1:])
    return stored.hint("broadcast") if 16 * cells <= BROADCAST_BYTES else stored
