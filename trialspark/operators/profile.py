"""Profiling, role discovery, fingerprints and content locks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..fixed_values import (
    ARM_NAME_HINTS, CONTROL_LABELS, ID_TOKENS, IDENTIFIER_NAMES, IDENTIFIER_NOUNS,
    IDENTIFIER_SUFFIXES, MAX_SEGMENT_LEVELS, MIN_MIXED_FORMATS, NULL_IDENTIFIER_RATE,
    SAMPLE_VALUES, TIME_TOKENS,
)
from ..fixed_values import DATE_FORMATS
from ..functions.columns import canonical_text, div, null_double, null_string, num
from ..functions.text import date_format_of
from ..session import attach_one_row, materialize
from .quantiles import exact_quantiles

C = F.col


def coalesce_type(dt: T.DataType) -> str:
    """Engine type folded into the eleven profile classes."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "interval"
    if isinstance(dt, T.BinaryType):
        return "binary"
    name = type(dt).__name__
    if name == "VariantType":
        return "json"
    if name == "TimeType":
        return "time"
    return "unknown"


def _text(name: str, dt: T.DataType) -> Column:
    """A printable form; nested values go through JSON."""
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(C(name))
    if isinstance(dt, T.BinaryType):
        return F.hex(C(name))
    return C(name).cast("string")


def _is_numeric(dt: T.DataType) -> bool:
    return coalesce_type(dt) in ("integer", "float")


def _long(df: DataFrame, numeric_only: bool = False) -> DataFrame:
    """(column_name, text, number) rows; strings travel as they are, once per column."""
    parts = []
    for f in df.schema.fields:
        numeric = _is_numeric(f.dataType)
        if numeric_only and not numeric:
            continue
        parts.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                (null_string() if numeric_only else _text(f.name, f.dataType)).alias("text"),
                (num(f.name) if numeric else null_double()).alias("number"),
            )
        )
    return df.select(F.inline(F.array(*parts)))


def distinct_values(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Distinct values per column, keyed by digest so long texts do not travel.

    The value itself stays beside the digest; `predicate` keeps few of them.
    """
    long = _long(df).where(C("text").isNotNull())
    keyed = long.select(
        "column_name", F.md5(C("text")).alias("digest"), C("text").alias("sample")
    )
    return (
        (keyed if predicate is None else keyed.where(predicate))
        .groupBy("column_name", "digest")
        .agg(F.min("sample").alias("sample"))
    )


LONG_TEXT = 32


def distinct_keys(df: DataFrame) -> DataFrame:
    """One row per column and distinct value; long texts stand by their digest."""
    text = C("text")
    key = F.when(F.length(text) <= LONG_TEXT, text).otherwise(F.concat(F.lit("#"), F.md5(text)))
    return _long(df).where(text.isNotNull()).select("column_name", key.alias("key")).distinct()


SURVIVORS = 200


def sample_values(df: DataFrame, n: int = SAMPLE_VALUES) -> DataFrame:
    """Up to n distinct values per column, chosen by digest order (repeatable).

    The first n digests are wanted, so digests far above them are dropped in the
    scan: with the column's sketched distinct count, about SURVIVORS * n / 10
    distinct values stay, and only those are shuffled.  Should a sketch have
    been so wrong that fewer than n stay, the share is widened and taken again.
    Values are whole.
    """
    fields = df.schema.fields
    rough = df.agg(
        *[F.approx_count_distinct(_text(f.name, f.dataType)).alias(f.name) for f in fields]
    ).first()
    keep = SURVIVORS * max(1.0, n / 10)
    head = F.conv(F.substring(C("digest"), 1, 8), 16, 10).cast("double")
    by_digest = Window.partitionBy("column_name").orderBy("digest")
    while True:
        limit, thinned = F.lit(2.0**32), []
        for f in fields:
            share = keep / max(rough[f.name], 1)
            if share < 1:
                thinned.append(f.name)
                limit = F.when(C("column_name") == f.name, F.lit(share * 2.0**32)).otherwise(limit)
        ranked = (
            distinct_values(df, head <= limit)
            .withColumn("rank", F.row_number().over(by_digest))
            .where(C("rank") <= n)
            .select("column_name", "rank", "sample")
        )
        if not thinned:
            return ranked
        found = materialize(ranked, "samples")
        counts = {r[0]: r[1] for r in found.groupBy("column_name").count().collect()}
        if all(counts.get(name, 0) >= n for name in thinned):
            return found
        keep *= 16


def profile_columns(
    df: DataFrame, n_samples: int = SAMPLE_VALUES, exact_distinct: bool = False
) -> DataFrame:
    """One row per column from one wide aggregate.

    Quartiles are exact (bracketed quantiles).  Distinct counts are sketched, or
    exact at the price of a shuffle of all distinct values; `distinct_method`
    names which, whatever the size.
    """
    rows = []
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(df.schema.fields):
        kind = coalesce_type(f.dataType)
        col, text = C(f.name), _text(f.name, f.dataType)
        value = num(f.name) if _is_numeric(f.dataType) else null_double()
        length = F.length(col) if kind == "string" else F.lit(None).cast("int")
        low = F.min(text) if kind == "unknown" else F.min(col).cast("string")
        high = F.max(text) if kind == "unknown" else F.max(col).cast("string")
        aggs.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(kind).alias("dtype"),
                F.count(col).alias("n_non_null"),
                # The sketch would keep the whole aggregate out of generated code.
                (F.lit(0).cast("long") if exact_distinct else F.approx_count_distinct(text))
                .alias("approx_distinct"),
                low.alias("min_value"), high.alias("max_value"),
                F.min(value).alias("min_number"), F.max(value).alias("max_number"),
                F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"),
                F.min(length).alias("min_length"), F.max(length).alias("max_length"),
            ).alias(f"_c{i}")
        )
        rows.append(f"_c{i}")
    base = df.agg(*aggs).select("n_rows", F.inline(F.array(*[C(r) for r in rows])))
    quart = exact_quantiles(
        _long(df, numeric_only=True), ["column_name"], "number", [0.25, 0.5, 0.75]
    ) if any(_is_numeric(f.dataType) for f in df.schema.fields) else None
    out = base
    if quart is not None:
        out = out.join(
            quart.select("column_name", *[C("q")[i].alias(q) for i, q in enumerate(("q25", "q50", "q75"))]),
            "column_name", "left",
        )
    else:
        out = out.withColumns({q: null_double() for q in ("q25", "q50", "q75")})
    if exact_distinct:
        ranked = distinct_keys(df).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
        out = out.join(ranked, "column_name", "left").withColumn(
            "n_distinct", F.coalesce(C("n_distinct"), F.lit(0))
        )
    else:
        out = out.withColumn("n_distinct", C("approx_distinct"))
    if n_samples:
        samples = (
            sample_values(df, n_samples)
            .groupBy("column_name")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "sample"))).alias("_s"))
            .select("column_name", C("_s.sample").alias("sample_values"))
        )
        out = out.join(samples, "column_name", "left")
    return out.withColumns(
        {
            "null_rate": F.coalesce(1 - div(C("n_non_null"), C("n_rows")), F.lit(0.0)),
            "distinct_method": F.lit("exact" if exact_distinct else "sketch"),
        }
    ).drop("approx_distinct")


def identifier_shaped(name: Column) -> Column:
    n = F.lower(name)
    out = n.isin(IDENTIFIER_NAMES)
    for suffix in IDENTIFIER_SUFFIXES:
        out = out | n.endswith(suffix)
    for noun in IDENTIFIER_NOUNS:
        out = out | n.endswith("_" + noun) | n.startswith(noun + "_")
    return out


def flag_null_identifiers(profile: DataFrame, threshold: float = NULL_IDENTIFIER_RATE) -> DataFrame:
    """Profile rows whose name looks like a unit id but which are mostly NULL."""
    flag = (C("null_rate") > threshold) & identifier_shaped(C("column_name"))
    reason = F.when(
        flag,
        F.concat(
            C("column_name"), F.lit(" is "),
            F.round(C("null_rate") * 100).cast("int").cast("string"),
            F.lit("% null; not analyzable as the randomization unit"),
        ),
    )
    return profile.withColumns({"flagged_for_review": flag, "flag_reason": reason})


def detect_mixed_timestamps(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String columns whose values follow two or more date formats, over all rows.

    Emits the least sample per format, most specific formats first.
    """
    names = [f.name for f in df.schema.fields if coalesce_type(f.dataType) == "string"]
    names = [n for n in names if columns is None or n in columns]
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), C(n).alias("v")) for n in names]))
    ).where(C("v").isNotNull())
    order = [name for name, _ in DATE_FORMATS] + ["other"]
    per_format = (
        long.withColumn("format", date_format_of(C("v")))
        .where(C("format") != "not_a_date")
        .groupBy("column_name", "format")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("sample"))
    )
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), C("format"))
    grouped = (
        per_format.withColumn("_r", rank)
        .groupBy("column_name")
        .agg(
            F.sort_array(F.collect_list(F.struct("_r", "format", "sample"))).alias("_f"),
            F.sum("n").alias("n_dates"),
        )
    )
    return grouped.select(
        "column_name",
        "n_dates",
        F.size("_f").alias("n_formats"),
        (F.size("_f") >= MIN_MIXED_FORMATS).alias("mixed_format_detected"),
        C("_f.format").alias("formats"),
        C("_f.sample").alias("format_samples"),
    )


def profile_report(profile: DataFrame) -> DataFrame:
    """Table-level roll-up of the column flags."""
    return profile.agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_columns"),
        F.bool_or("flagged_for_review").alias("any_flag"),
        F.sort_array(F.collect_set("flag_reason")).alias("reasons"),
    )


# --- roles ---------------------------------------------------------------------

def _has_token(name: str, tokens: Sequence[str]) -> bool:
    lowered = name.lower()
    return any(t in lowered for t in tokens)


def low_cardinality(
    df: DataFrame, names: Sequence[str], limit: int
) -> tuple[dict[str, int], dict[str, int]]:
    """Exact distinct counts of the columns with at most `limit` values, and the wider columns' counts.

    A sketch pass rules out the wide columns, so the exact pass never shuffles
    a high-cardinality column.  Only the counts come to the driver; those of
    columns ruled out by the sketch are the sketch's.
    """
    if not names:
        return {}, {}
    rough = df.agg(*[F.approx_count_distinct(C(c), 0.02).alias(c) for c in names]).first()
    near = [c for c in names if rough[c] <= 5 * limit]
    exact = df.agg(*[F.count_distinct(C(c)).alias(c) for c in near]).first().asDict() if near else {}
    counts = {c: exact.get(c, rough[c]) for c in names}
    few = {c: n for c, n in counts.items() if c in exact and n <= limit}
    return few, {c: n for c, n in counts.items() if c not in few}


def discover_roles(df: DataFrame, max_levels: int = MAX_SEGMENT_LEVELS) -> DataFrame:
    """One row naming the arm, control, metric, segment, time and unit columns.

    A column with more than `max_levels` values is no segment; `wide_columns`
    reports those with their number of values.
    """
    spark = df.sparkSession
    fields = {f.name: f.dataType for f in df.schema.fields}
    plain = [n for n, d in fields.items() if coalesce_type(d) != "unknown"]
    numeric = [n for n in fields if _is_numeric(fields[n])]
    not_id = [n for n in plain if not _has_token(n, ID_TOKENS)]
    counts, wide = low_cardinality(df, not_id, max_levels)
    lowered = {n.lower(): n for n in fields}

    arm, conf = None, "none"
    hinted = [lowered[h] for h in ARM_NAME_HINTS if h in lowered]
    if hinted:
        arm, conf = hinted[0], "high"
    else:
        few = [(counts[n], i, n) for i, n in enumerate(not_id) if n not in numeric and 2 <= counts.get(n, 0) <= 5]
        if few:
            arm, conf = min(few)[2], "medium" if len(few) == 1 else "low"

    control, control_conf, labels = None, "none", None
    if arm is not None:
        labels = df.where(C(arm).isNotNull()).select(C(arm).cast("string").alias("label")).distinct()
        hints = F.map_from_entries(
            F.collect_list(F.when(C("_hint"), F.struct(C("_low"), C("_most"))))
        )
        seen = (
            labels.groupBy(F.lower("label").alias("_low"))
            .agg(F.max("label").alias("_most"), F.count(F.lit(1)).alias("_k"))
            .withColumn("_hint", C("_low").isin(CONTROL_LABELS))
            .agg(hints.alias("hints"), F.sum("_k").alias("n"), F.min("_most").alias("a"), F.max("_most").alias("b"))
            .first()
        )
        known = [seen.hints[h] for h in CONTROL_LABELS if h in seen.hints]
        zero = [v for v in (seen.a, seen.b) if _as_float(v) == 0.0] if seen.n == 2 else []
        if known:
            control, control_conf = known[0], "high"
        elif zero:
            control, control_conf = zero[0], "medium"
        elif seen.n:
            control_conf = "low"

    metrics = [n for n in numeric if n != arm and not _has_token(n, ID_TOKENS)]
    segments = []
    for n in not_id:
        k = counts.get(n, 0)
        if n == arm or k < 2:
            continue
        if n not in numeric or (k <= 5 and coalesce_type(fields[n]) == "integer"):
            segments.append(n)
    named_time = [
        n for n in fields
        if coalesce_type(fields[n]) not in ("timestamp", "date", "unknown") and _has_token(n, TIME_TOKENS)
    ]
    parse = {}
    if named_time:
        parse = df.agg(
            *[F.bool_and(F.coalesce(C(n).cast("string").try_cast("timestamp").isNotNull(), F.lit(False)))
              .alias(n) for n in named_time]
        ).first().asDict()
    times = [
        n for n in fields
        if coalesce_type(fields[n]) == "timestamp"
        or (coalesce_type(fields[n]) == "date" and _has_token(n, TIME_TOKENS))
        or parse.get(n)
    ]
    units = [n for n in fields if _has_token(n, ID_TOKENS)]
    questions = []
    if arm is None:
        questions.append("Which column holds the arm?")
    else:
        if control is None:
            questions.append(f"Which value of {arm} is control?")
        if conf == "low":
            questions.append(f"Is {arm} really the arm column?")
    if not metrics:
        questions.append("Which columns are outcomes?")
    schema = (
        "arm_column string, control_value string, "
        "metric_columns array<string>, segment_columns array<string>, "
        "timestamp_columns array<string>, unit_columns array<string>, "
        "confidence map<string,string>, questions array<string>, n_columns int, "
        "wide_columns map<string,long>"
    )
    confidence = {
        "arm_column": conf, "control_value": control_conf,
        "metric_columns": "high" if metrics else "none",
        "segment_columns": "high" if segments else "none",
        "timestamp_columns": "high" if times else "none",
    }
    row = (arm, control, metrics, segments, times, units, confidence, questions, len(fields), wide)
    out = spark.createDataFrame([row], schema)
    if labels is None:
        return out.withColumn("treatment_values", F.array().cast("array<string>"))
    # However many labels there are, they go from the aggregate into the result, not through the driver.
    others = labels if control is None else labels.where(C("label") != control)
    listed = others.agg(F.sort_array(F.collect_list("label")).alias("treatment_values"))
    return attach_one_row(out, listed)


def _as_float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


# --- fingerprints ----------------------------------------------------------------

def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row and column counts with a hash of the schema's names and types."""
    described = ",".join(f"{f.name}:{coalesce_type(f.dataType)}" for f in df.schema.fields)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.sha2(F.lit(described), 256).alias("schema_hash"),
    )


def fingerprint_drift(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Compare a fingerprint with the recorded one (both one row)."""
    joined = attach_one_row(now, recorded.withColumnsRenamed({c: f"_{c}" for c in recorded.columns}))
    return joined.select(
        (C("n_rows") != C("_n_rows")).alias("rows_changed"),
        (C("n_columns") != C("_n_columns")).alias("columns_changed"),
        (C("schema_hash") != C("_schema_hash")).alias("schema_changed"),
    )


def content_lock(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free digest of all rows: count, sum and xor of row hashes.

    A partial aggregate per task and one merge; no global sort.  Rows hash by
    MD5 of their canonical text, so that other engines can repeat the lock.
    """
    names = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    digest = F.md5(canonical_text([_text(n, types[n]) for n in names]))

    def word(start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")

    return df.select(word(1).alias("h1"), word(9).alias("h2")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(C("h1").cast("decimal(38,0)")).alias("hash_sum"),
        F.bit_xor("h1").alias("hash_xor_1"),
        F.bit_xor("h2").alias("hash_xor_2"),
    )


def verify_lock(df: DataFrame, recorded: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    now = content_lock(df, columns)
    both = attach_one_row(now, recorded.withColumnsRenamed({c: f"_{c}" for c in recorded.columns}))
    same = F.lit(True)
    for c in now.columns:
        same = same & C(c).eqNullSafe(C(f"_{c}"))
    return both.select(same.alias("lock_holds"))
