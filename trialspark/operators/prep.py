"""Row preparation: drop, coerce, winsorize, and the audit counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..fixed_values import ARM_REVEALING_COLUMNS, HIGH_DROP_RATE
from ..functions.columns import div, join_messages, num
from ..session import attach_one_row
from .quantiles import exact_quantiles


class BlindedColumnError(ValueError):
    """A design-time query touched a column that reveals the arm."""


def drop_missing_arm(df: DataFrame, arm: str = "arm") -> DataFrame:
    return df.where(F.col(arm).isNotNull())


def coerced(df: DataFrame, name: str) -> Column:
    """The column as a double; text that is no number becomes NULL."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return num(F.col(name).try_cast("double"))
    return num(name)


def coerce_numeric(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return df.withColumns({m: coerced(df, m) for m in metrics})


def winsorize(df: DataFrame, column: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Clip to quantile bounds of the whole column, all arms pooled."""
    return winsorize_spec(df, {column: (lower, upper)})


def check_winsorize_spec(spec: Mapping[str, Sequence[float]]) -> None:
    for name, bounds in spec.items():
        if len(bounds) != 2 or not 0 <= bounds[0] < bounds[1] <= 1:
            raise ValueError(f"winsorize bounds of {name!r} must satisfy 0 <= lower < upper <= 1")


def winsorize_spec(df: DataFrame, spec: Mapping[str, Sequence[float]]) -> DataFrame:
    """Clip several metrics; unknown columns are skipped (see `prepare_audit`).

    Rows are unpivoted to (metric, value) so that one pair of scans finds the
    bounds of every metric.
    """
    check_winsorize_spec(spec)
    known = {m: b for m, b in spec.items() if m in df.columns}
    if not known:
        return df
    rows = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("_metric"), coerced(df, m).alias("_value"))
                    for m in known
                ]
            )
        )
    )
    probs = sorted({float(p) for b in known.values() for p in b})
    # One small row: metric -> quantile array.
    bounds = exact_quantiles(rows, ["_metric"], "_value", probs).agg(
        F.map_from_entries(F.collect_list(F.struct("_metric", "q"))).alias("_q")
    )
    out = attach_one_row(coerce_numeric(df, list(known)), bounds)

    def bound(name: str, p: float) -> Column:
        return F.try_element_at(F.col("_q"), F.lit(name))[probs.index(float(p))]

    clipped = {
        m: F.when(
            F.col(m).isNotNull(),
            F.least(F.greatest(F.col(m), bound(m, lo)), bound(m, hi)),
        )
        for m, (lo, hi) in known.items()
    }
    return out.withColumns(clipped).drop("_q")


def prepare(
    df: DataFrame,
    arm: str,
    metrics: Sequence[str],
    segments: Sequence[str] = (),
    winsorize_bounds: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """The cleaned rows: arm present, metrics numeric, chosen metrics clipped."""
    missing = [c for c in (arm, *metrics, *segments) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    out = coerce_numeric(drop_missing_arm(df, arm), metrics)
    return winsorize_spec(out, winsorize_bounds or {})


def prepare_audit(
    df: DataFrame,
    arm: str,
    metrics: Sequence[str],
    winsorize_bounds: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """One row: rows in, out and dropped, values coerced per metric, warnings."""
    kept = F.col(arm).isNotNull()
    text = [m for m in metrics if isinstance(df.schema[m].dataType, T.StringType)]
    aggs = [
        F.count(F.lit(1)).alias("n_rows_input"),
        F.count(F.when(kept, 1)).alias("n_rows_output"),
    ]
    for m in metrics:
        lost = kept & F.col(m).isNotNull() & coerced(df, m).isNull() if m in text else F.lit(False)
        aggs.append(F.count(F.when(lost, 1)).alias(f"n_coerced_{m}"))
    out = df.agg(*aggs).withColumn("n_rows_dropped", F.col("n_rows_input") - F.col("n_rows_output"))
    rate = div(F.col("n_rows_dropped"), F.col("n_rows_input"))
    messages = [
        F.when(
            F.col(f"n_coerced_{m}") > 0,
            F.concat(F.lit(f"{m}: "), F.col(f"n_coerced_{m}"), F.lit(" values coerced to NULL")),
        )
        for m in text
    ]
    for name in winsorize_bounds or {}:
        if name not in df.columns:
            messages.append(F.lit(f"{name}: unknown column in winsorize bounds"))
    messages.append(F.when(rate > HIGH_DROP_RATE, F.lit("high drop rate")))
    return out.withColumns({"drop_rate": rate, "warnings": join_messages(*messages)})


# --- predicates --------------------------------------------------------------

def exposed_filter(assign: DataFrame, predicate: str | None) -> DataFrame:
    return assign.where(F.expr(predicate)) if predicate else assign


def exposure_filter(joined: DataFrame, predicate: str | None = None) -> DataFrame:
    """Events at or after first exposure that also satisfy a metric predicate."""
    cond = F.col("event_at") >= F.col("first_exposure_at")
    return joined.where(cond & F.expr(predicate) if predicate else cond)


def cohort_window(
    df: DataFrame, ts: str, start_utc: str, end_utc: str, timezone: str = "UTC"
) -> DataFrame:
    """[start, end) in UTC, pushed to the scan; adds the local calendar day."""
    out = df.where(
        (F.col(ts) >= F.lit(start_utc).cast("timestamp"))
        & (F.col(ts) < F.lit(end_utc).cast("timestamp"))
    )
    return out.withColumn("cohort_day", F.to_date(F.from_utc_timestamp(F.col(ts), timezone)))


def blind_projection(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Refuse arm-revealing columns while results must not be seen.

    A column is also refused under another name, or where rows are filtered or
    computed by it: the optimized plan, in which unused columns are gone, must
    not refer to one.
    """
    chosen = list(columns) if columns is not None else df.columns
    blinded = {c.lower() for c in ARM_REVEALING_COLUMNS}
    leaked = [c for c in chosen if c.lower() in blinded]
    if leaked:
        raise BlindedColumnError(f"blinded at design time: {leaked}")
    out = df.select(*chosen)
    used = sorted(c for c in _referenced(out) if c.lower() in blinded)
    if used:
        raise BlindedColumnError(f"blinded at design time, also under other names: {used}")
    return out


def _referenced(df: DataFrame) -> set[str]:
    """Names of the columns that the optimized plan's nodes compute with."""
    todo, names = [df._jdf.queryExecution().optimizedPlan()], set()
    while todo:
        node = todo.pop()
        refs = node.references().toSeq()
        names |= {refs.apply(i).name() for i in range(refs.size())}
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return names


def peek(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
