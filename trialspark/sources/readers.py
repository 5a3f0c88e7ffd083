"""Readers: everything arrives as a lazy DataFrame."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LOADABLE = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".json": "json",
            ".jsonl": "json", ".ndjson": "json", ".orc": "orc"}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ","
) -> DataFrame:
    """Header CSV.  Give a schema at scale: inference costs one more pass."""
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Route by extension; an unknown extension is an error."""
    kind = LOADABLE.get(_suffix(path))
    if kind is None:
        raise ValueError(f"no reader for {path!r}; known: {sorted(LOADABLE)}")
    if kind == "csv":
        return scan_csv(spark, path, schema, "\t" if _suffix(path) == ".tsv" else ",")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(kind).load(path)


def scan_profile_source(spark: SparkSession, source: str, is_path: bool | None = None) -> DataFrame:
    """A dotted table name or a file; an unknown file suffix is read as CSV."""
    if is_path is None:
        is_path = "/" in source or _suffix(source) in LOADABLE
    if not is_path:
        if not _NAME.fullmatch(source):
            raise ValueError(f"not a plain dotted table name: {source!r}")
        return spark.table(source)
    if _suffix(source) in LOADABLE:
        return load_table(spark, source)
    return scan_csv(spark, source)


def scan_csv_stream(spark: SparkSession, directory: str, schema: T.StructType | str) -> DataFrame:
    """CSV files of a directory as a stream (new files are new rows)."""
    return spark.readStream.option("header", True).schema(schema).csv(directory)


def register_csv_table(
    spark: SparkSession, path: str, name: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Bind a CSV to a table name; returns the one-row count."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a plain table name: {name!r}")
    df = scan_csv(spark, path, schema)
    df.createOrReplaceTempView(name)
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def load_experiment(spark: SparkSession, table: str, arm: str) -> DataFrame:
    """A whole table; its arm column must exist."""
    df = spark.table(table)
    if arm not in df.columns:
        raise ValueError(f"arm column {arm!r} not in {table}; columns: {df.columns}")
    return df


def history(spark: SparkSession, path: str, key: str | None = None, value: str | None = None) -> DataFrame:
    """An append-only JSON-lines log; broken lines are kept in `_corrupt_record`."""
    text = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    fields = spark.read.json(path).drop("_corrupt_record").schema
    schema = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = text.select(
        F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
    ).select("r.*")
    return parsed.where(F.col(key) == value) if key else parsed


def read_tables(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
