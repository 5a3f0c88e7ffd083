"""Declared metrics compiled to one scan per fact source."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import div, num
from .hypothesis import metric_dispatch, proportion_from_counts, ratio_from_moments, welch_from_moments
from .joins import join_exposure, join_units_zero_filled
from ..session import materialize
from .moments import pair_arms
from .quantiles import exact_quantiles, with_group

C = F.col

TEST_OF_TYPE = {"proportion": "proportion", "mean": "mean", "ratio": "ratio"}
AGGREGATES = ("count", "count_distinct", "sum", "mean", "avg", "min", "max")
PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


class MetricError(ValueError):
    pass


@dataclass(frozen=True)
class Metric:
    """A per-unit value built from fact rows.

    `numerator`/`denominator` are SQL expressions over a fact row; `aggregate`
    folds a unit's rows.  A proportion is 1 when any row passes `filter`.
    `winsorize` clips unit values to quantiles of the experiment, arms pooled;
    `invert` says that less is better; `baseline_range` is where the control
    value is expected.  `source` and `denominator_source` name declared sources.
    """

    name: str
    type: str
    numerator: str
    description: str = ""
    aggregate: str = "sum"
    denominator: str | None = None
    denominator_aggregate: str = "sum"
    filter: str | None = None
    unit: str = "unit_id"
    source: str = ""
    denominator_source: str = ""
    baseline_range: tuple[float, float] | None = None
    winsorize: bool = False
    winsorize_bounds: tuple[float, float] = (0.01, 0.99)
    invert: bool = False
    tags: tuple[str, ...] = field(default=())


def _bounds(name: str, pair) -> tuple[float, float]:
    try:
        low, high = (float(v) for v in pair)
    except (TypeError, ValueError) as exc:
        raise MetricError(f"{name} must be two numbers") from exc
    return low, high


def metric_validate(spec: Mapping) -> Metric:
    """Check a definition before any plan is built from it."""
    if isinstance(spec.get("metric"), Mapping) and "name" not in spec:
        spec = spec["metric"]
    for key in ("name", "type", "numerator", "description"):
        if not spec.get(key):
            raise MetricError(f"missing field {key!r}")
    kind = spec["type"]
    if kind not in TEST_OF_TYPE and kind not in PERCENTILES and kind not in AGGREGATES:
        raise MetricError(f"unknown metric type {kind!r}")
    if kind == "ratio" and not spec.get("denominator"):
        raise MetricError("a ratio metric needs a denominator")
    if spec.get("denominator_source") and kind != "ratio":
        raise MetricError("only a ratio metric has a denominator_source")
    base = spec.get("baseline_range")
    if base is not None:
        base = _bounds("baseline_range", base)
        if base[0] > base[1]:
            raise MetricError("baseline_range must be ordered")
    for flag in ("winsorize", "invert"):
        if not isinstance(spec.get(flag, False), bool):
            raise MetricError(f"{flag} must be true or false")
    if spec.get("winsorize") and (kind == "proportion" or kind in PERCENTILES):
        raise MetricError(f"a {kind} metric cannot be winsorized")
    clip = _bounds("winsorize_bounds", spec.get("winsorize_bounds", (0.01, 0.99)))
    if not 0 <= clip[0] < clip[1] <= 1:
        raise MetricError("winsorize_bounds must satisfy 0 <= low < high <= 1")
    tags = spec.get("tags") or []
    if not isinstance(tags, (list, tuple)):
        raise MetricError("tags must be a list")
    allowed = Metric.__dataclass_fields__
    values = {k: v for k, v in spec.items() if k in allowed}
    values.update(baseline_range=base, winsorize_bounds=clip, tags=tuple(map(str, tags)))
    metric = Metric(**values)
    for agg in (metric.aggregate, metric.denominator_aggregate):
        if agg not in AGGREGATES:
            raise MetricError(f"unknown aggregate {agg!r}")
    return metric


def metric_catalog(specs: Iterable[Mapping]) -> dict[str, Metric]:
    """Named metrics in sorted order; a duplicate name is an error."""
    out: dict[str, Metric] = {}
    for spec in specs:
        m = metric_validate(spec)
        if m.name in out:
            raise MetricError(f"duplicate metric {m.name!r}")
        out[m.name] = m
    return dict(sorted(out.items()))


def load_metric_catalog(spark, path: str) -> dict[str, Metric]:
    """Metric definitions from a directory, in order of their names."""
    return metric_catalog(read_definitions(spark, path))


def read_definitions(spark, path: str) -> list[Mapping]:
    """Objects from the files of a directory, in order of the files' names.

    `.yaml` and `.yml` files hold one definition or several documents, all
    others JSON: one object or array a file, or one object a line.  Definitions
    are written by people, so they are few; they are parsed on the driver.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    specs: list[Mapping] = []
    for row in files.orderBy("file").toLocalIterator():
        specs += _parsed(row.value, row.file)
    return specs


def _parsed(text: str, file: str) -> list[Mapping]:
    try:
        if file.lower().endswith((".yaml", ".yml")):
            import yaml

            found = list(yaml.safe_load_all(text))
        else:
            try:
                found = [json.loads(text)] if text.strip() else []
            except json.JSONDecodeError:
                found = [json.loads(line) for line in text.splitlines() if line.strip()]
    except ValueError as exc:
        raise MetricError(f"{file}: {exc}") from exc
    flat = [spec for part in found if part is not None for spec in (part if isinstance(part, list) else [part])]
    if not all(isinstance(spec, Mapping) for spec in flat):
        raise MetricError(f"{file}: a definition must be an object")
    return flat


def catalog_coverage(facts: DataFrame, metrics: Mapping[str, Metric]) -> DataFrame:
    """Fact rows that pass each metric's filter: one aggregate for the whole catalog."""
    rows = [
        F.struct(
            F.lit(m.name).alias("name"), F.lit(m.type).alias("type"),
            F.count(F.when(F.expr(m.filter), 1) if m.filter else F.lit(1)).alias("n_fact_rows"),
        )
        for m in metrics.values()
    ]
    return facts.agg(F.array(*rows).alias("m")).select(F.inline("m"))


def _fold(agg: str, expression: str, predicate: str | None):
    value = F.expr(expression)
    if predicate:
        value = F.when(F.expr(predicate), value)
    if agg == "count":
        return F.count(value).cast("double")
    if agg == "count_distinct":
        return F.count_distinct(value).cast("double")
    return {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max}[agg](
        value.cast("double")
    )


def unit_metrics(
    assign: DataFrame,
    facts: DataFrame,
    metrics: Mapping[str, Metric],
    keys: Sequence[str],
    unit: str = "unit_id",
    ts: str = "event_at",
    horizon_days: float | None = None,
) -> DataFrame:
    """One row per assigned unit with a column per metric (`<m>`, `<m>__den`).

    All metrics of the fact source share one join and one aggregate.  Units
    without facts count 0 for sums and counts, NULL for means.
    """
    per_unit, zero = folded_units(assign, facts, metrics, keys, unit, ts, horizon_days)
    return join_units_zero_filled(assign, per_unit, [*keys, unit], zero)


def folded_units(
    assign: DataFrame,
    facts: DataFrame,
    metrics: Mapping[str, Metric],
    keys: Sequence[str],
    unit: str = "unit_id",
    ts: str = "event_at",
    horizon_days: float | None = None,
) -> tuple[DataFrame, list[str]]:
    """Units with exposed facts, a column per metric, and the columns a unit without facts counts 0 in."""
    exposed = join_exposure(facts, assign.select(*keys, unit, "first_exposure_at"), unit, ts, horizon_days)
    aggs, zero = [], []
    for m in metrics.values():
        if m.type in PERCENTILES:
            continue
        if m.type == "proportion":
            cond = F.expr(m.filter) if m.filter else F.expr(m.numerator).isNotNull()
            aggs.append(F.max(F.when(cond, 1.0).otherwise(0.0)).alias(m.name))
            zero.append(m.name)
            continue
        # A type that names an aggregate (count, sum, avg, ...) is its own fold;
        # "mean" and "ratio" say how units combine and fold by `aggregate`.
        agg = m.type if m.type in AGGREGATES and m.type not in TEST_OF_TYPE else m.aggregate
        aggs.append(_fold(agg, m.numerator, m.filter).alias(m.name))
        if agg in ("sum", "count", "count_distinct"):
            zero.append(m.name)
        if m.type == "ratio":
            aggs.append(_fold(m.denominator_aggregate, m.denominator, m.filter).alias(f"{m.name}__den"))
            zero.append(f"{m.name}__den")
    return exposed.groupBy(*keys, unit).agg(*aggs), zero


def percentile_metrics(
    assign: DataFrame,
    facts: DataFrame,
    metrics: Mapping[str, Metric],
    keys: Sequence[str],
    unit: str = "unit_id",
    ts: str = "event_at",
    arm: str = "arm",
) -> DataFrame:
    """p50..p99 of exposed fact rows per arm; exact, without gathering an arm."""
    exposed = join_exposure(facts, assign.select(*keys, unit, arm, "first_exposure_at"), unit, ts)
    rows, wanted = [], []
    for m in metrics.values():
        if m.type in PERCENTILES:
            value = F.expr(m.numerator).cast("double")
            value = F.when(F.expr(m.filter), value) if m.filter else value
            rows.append(F.struct(F.lit(m.name).alias("metric"), value.alias("value")))
            wanted.append((m.name, PERCENTILES[m.type]))
    probs = sorted({p for _, p in wanted})
    long = exposed.select(*keys, arm, F.inline(F.array(*rows)))
    q = exact_quantiles(long, [*keys, arm, "metric"], "value", probs)
    value = F.lit(None).cast("double")
    for name, p in wanted:
        value = F.when(C("metric") == name, C("q")[probs.index(p)]).otherwise(value)
    return q.select(*keys, arm, "metric", "n", value.alias("value"))


def clipped_units(units: DataFrame, metrics: Mapping[str, Metric], keys: Sequence[str], arm: str = "arm") -> DataFrame:
    """The unit frame with winsorized metrics clipped.

    Bounds are quantiles over all arms of an experiment, so that clipping does
    not depend on the arm; units without an arm take no part in them.  The
    bounds of all metrics come from the same passes, and none is made when no
    metric asks for it.  A ratio's two sides have bounds of their own.
    """
    wanted = {}
    for m in metrics.values():
        if m.winsorize:
            for column in [m.name, f"{m.name}__den"] if m.type == "ratio" else [m.name]:
                wanted[column] = m.winsorize_bounds
    if not wanted:
        return units
    probs = sorted({p for pair in wanted.values() for p in pair})
    long = units.where(C(arm).isNotNull()).select(
        *keys, F.inline(F.array(*[F.struct(F.lit(c).alias("_m"), num(c).alias("_x")) for c in wanted]))
    )
    bounds = exact_quantiles(long, [*keys, "_m"], "_x", probs).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_m", "q"))).alias("_q")
    )
    beside = with_group(units, bounds, keys, ["_q"])

    def at(column: str, p: float):
        return F.try_element_at("_q", F.lit(column))[probs.index(p)]

    clipped = {
        c: F.when(num(c).isNotNull(), F.least(F.greatest(num(c), at(c, lo)), at(c, hi))) for c, (lo, hi) in wanted.items()
    }
    return beside.withColumns(clipped).drop("_q")


def metric_compute(
    units: DataFrame, metrics: Mapping[str, Metric], keys: Sequence[str], arm: str = "arm"
) -> DataFrame:
    """Metric value per arm from the unit frame: mean over units, or sum over sum."""
    units = clipped_units(units, metrics, keys, arm)
    aggs = []
    for m in metrics.values():
        if m.type in PERCENTILES:
            continue
        value = F.avg(num(m.name))
        if m.type == "ratio":
            value = div(F.sum(num(m.name)), F.sum(num(f"{m.name}__den")))
        aggs.append(
            F.struct(
                F.lit(m.name).alias("metric"), F.lit(m.type).alias("metric_type"),
                F.count(num(m.name)).alias("n_units"), value.alias("value"),
            )
        )
    wide = units.where(C(arm).isNotNull()).groupBy(*keys, arm).agg(F.array(*aggs).alias("m"))
    return wide.select(*keys, arm, F.inline("m"))


RESULT_COLUMNS = ["baseline", "diff", "se", "ci_lower", "ci_upper", "p_value", "lift_pct", "error"]


def catalog_moments(
    units: DataFrame, metrics: Mapping[str, Metric], keys: Sequence[str], arm: str = "arm"
) -> DataFrame:
    """Moments of every metric from one scan of the unit frame, long by metric.

    x is the metric; y is the denominator of a ratio metric (NULL otherwise).
    """
    rows = []
    for m in metrics.values():
        if m.type in PERCENTILES:
            continue
        x = num(m.name)
        y = num(f"{m.name}__den") if m.type == "ratio" else F.lit(None).cast("double")
        if m.type == "ratio":
            both = x.isNotNull() & y.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
        rows.append(
            F.struct(
                F.lit(m.name).alias("metric"),
                F.lit(TEST_OF_TYPE.get(m.type, "mean")).alias("test"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
                F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"),
                F.covar_samp(x, y).alias("cov"),
                F.sum(x).alias("sum_x"), F.sum(y).alias("sum_y"),
            )
        )
    wide = units.where(C(arm).isNotNull()).groupBy(*keys, arm).agg(F.array(*rows).alias("m"))
    return wide.select(*keys, arm, F.inline("m"))


def metric_tests(
    units: DataFrame,
    metrics: Mapping[str, Metric],
    keys: Sequence[str],
    arm: str = "arm",
    control: str = "control",
    alpha: float = 0.05,
) -> DataFrame:
    """Dispatch every metric to the test of its type; one long result frame.

    `benefit` and its interval are the effect in the metric's good direction: of
    an inverted metric the negated one.  `baseline` is the control value,
    `baseline_in_range` whether it is where the definition expects it (NULL if
    it expects nothing).  The paired moments are stored once (a few rows per cell), so several tests
    do not scan the units several times.
    """
    cell = [*keys, "metric", "test"]
    clipped = clipped_units(units, metrics, keys, arm)
    paired = pair_arms(catalog_moments(clipped, metrics, keys, arm), cell, arm, control)
    pairs = materialize(paired, "paired-moments").withColumn(
        "baseline",
        F.when(C("test") == "ratio", div(C("sum_x_control"), C("sum_y_control"))).otherwise(C("mean_x_control")),
    )
    kinds = {TEST_OF_TYPE.get(m.type, "mean") for m in metrics.values() if m.type not in PERCENTILES}
    plain = {
        f"{old}_{side}": f"{new}_{side}"
        for old, new in (("mean_x", "mean"), ("var_x", "var"), ("sum_x", "total"))
        for side in ("control", "treatment")
    }
    tests = {"mean": welch_from_moments, "proportion": proportion_from_counts, "ratio": ratio_from_moments}
    frames = {}
    for kind in sorted(kinds):
        part = pairs.where(C("test") == kind)
        part = part if kind == "ratio" else part.withColumnsRenamed(plain)
        frames[kind] = tests[kind](part, alpha)
    out = metric_dispatch(frames, [*keys, "metric", arm, *RESULT_COLUMNS])
    inverted = C("metric").isin([m.name for m in metrics.values() if m.invert])
    in_range = F.lit(None).cast("boolean")
    for m in metrics.values():
        if m.baseline_range:
            in_range = F.when(C("metric") == m.name, C("baseline").between(*m.baseline_range)).otherwise(in_range)
    return out.withColumns({
        "benefit": F.when(inverted, -C("diff")).otherwise(C("diff")),
        "benefit_lower": F.when(inverted, -C("ci_upper")).otherwise(C("ci_lower")),
        "benefit_upper": F.when(inverted, -C("ci_lower")).otherwise(C("ci_upper")),
        "baseline_in_range": in_range,
    })
