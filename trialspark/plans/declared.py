"""Declared sources: tables with keys, fields and many-to-one relationships.

Metrics name a source and write `other.field` for a field of a related one.
The joins follow from the declaration; what would multiply rows or has no way
to the unit is refused before any plan is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.joins import join_dimension, join_units_zero_filled
from ..operators.metrics import Metric, PERCENTILES, folded_units, read_definitions

C = F.col

ROLES = ("identifier", "event_time", "assignment", "outcome", "dimension", "measure", "metadata")
# Declared types and the column types that may stand for them; the first is used to check expressions.
TYPES = {
    "string": (T.StringType,),
    "integer": (T.LongType, T.IntegerType, T.ShortType, T.ByteType),
    "float": (T.DoubleType, T.FloatType, T.DecimalType),
    "bool": (T.BooleanType,),
    "timestamp": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "date": (T.DateType,),
}


class SourceError(ValueError):
    """A declaration that contradicts itself, the tables, or a metric."""


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    role: str = "metadata"


@dataclass(frozen=True)
class Edge:
    """Each row of `source` belongs to at most one row of `to`: fields `on` hold its key."""

    source: str
    to: str
    on: tuple[str, ...]


@dataclass(frozen=True)
class Source:
    """A table, the key of its rows, and when a row happened (`field` or `other.field`)."""

    name: str
    table: str
    primary: tuple[str, ...]
    fields: Mapping[str, Field]
    edges: Mapping[str, Edge]
    time: str | None = None


def _names(value, what: str) -> tuple[str, ...]:
    parts = (value,) if isinstance(value, str) else value
    if not isinstance(parts, (list, tuple)) or not parts or not all(isinstance(p, str) and p for p in parts):
        raise SourceError(f"{what} must be a name or a list of names")
    return tuple(parts)


def _only(spec, allowed: Sequence[str], what: str) -> None:
    if not isinstance(spec, Mapping):
        raise SourceError(f"{what} must be an object")
    unknown = sorted(set(map(str, spec)) - set(allowed))
    if unknown:
        raise SourceError(f"{what}: unknown fields {unknown}")


def source_validate(spec: Mapping) -> Source:
    """One source, checked by itself."""
    _only(spec, ("name", "table", "primary", "fields", "relationships", "time", "description"), "source")
    name = spec.get("name")
    if not isinstance(name, str) or not name.isidentifier():
        raise SourceError(f"source name {name!r} is not an identifier")
    fields: dict[str, Field] = {}
    for item in spec.get("fields") or []:
        _only(item, ("name", "type", "role", "description"), f"{name}: field")
        f = Field(item.get("name") or "", item.get("type") or "", item.get("role", "metadata"))
        if not f.name or f.name in fields:
            raise SourceError(f"{name}: field {f.name!r} is empty or declared twice")
        if f.type not in TYPES or f.role not in ROLES:
            raise SourceError(f"{name}.{f.name}: unknown type {f.type!r} or role {f.role!r}")
        fields[f.name] = f
    primary = _names(spec.get("primary"), f"{name}: primary")
    for p in primary:
        if p not in fields or fields[p].role != "identifier":
            raise SourceError(f"{name}: primary {p!r} must be a field with the role identifier")
    times = [f.name for f in fields.values() if f.role == "event_time"]
    if len(times) > 1:
        raise SourceError(f"{name}: several fields with the role event_time: {times}")
    edges: dict[str, Edge] = {}
    for item in spec.get("relationships") or []:
        _only(item, ("to", "on", "type", "description"), f"{name}: relationship")
        to = item.get("to")
        if item.get("type", "many_to_one") != "many_to_one":
            raise SourceError(f"{name}: relationship to {to!r} must be many_to_one; declare it on the other side")
        if to in edges:
            raise SourceError(f"{name}: two relationships to {to!r}; declare the table twice under two names")
        edges[to] = Edge(name, to, _names(item.get("on"), f"{name}: on"))
    return Source(name, spec.get("table") or name, primary, fields, edges, spec.get("time") or (times[0] if times else None))


class SourceGraph:
    """Sources and their many-to-one edges."""

    def __init__(self, specs: Iterable[Mapping]):
        self.sources: dict[str, Source] = {}
        for spec in specs:
            s = source_validate(spec)
            if s.name in self.sources:
                raise SourceError(f"duplicate source {s.name!r}")
            self.sources[s.name] = s
        for s in self.sources.values():
            for edge in s.edges.values():
                self._check_edge(s, edge)
        for s in self.sources.values():
            self._check_cycle(s.name, ())
            hidden = sorted(set(self.reachable(s.name)) & set(s.fields))
            if hidden:
                raise SourceError(f"{s.name}: {hidden} are both fields and related sources")
            if s.time:
                owner, _, name = s.time.rpartition(".")
                if owner:
                    self.path(s.name, owner)
                if name not in self[owner or s.name].fields:
                    raise SourceError(f"{s.name}: time {s.time!r} is not a field")

    def __getitem__(self, name: str) -> Source:
        if name not in self.sources:
            raise SourceError(f"unknown source {name!r}; declared: {sorted(self.sources)}")
        return self.sources[name]

    def _check_edge(self, s: Source, edge: Edge) -> None:
        one = self[edge.to]
        if len(edge.on) != len(one.primary):
            raise SourceError(f"{s.name} -> {one.name}: {edge.on} does not cover the key {one.primary}, so rows would multiply")
        for mine, theirs in zip(edge.on, one.primary):
            if mine not in s.fields:
                raise SourceError(f"{s.name} -> {one.name}: {mine!r} is not a field of {s.name}")
            if s.fields[mine].type != one.fields[theirs].type:
                raise SourceError(f"{s.name}.{mine} and {one.name}.{theirs} differ in type")

    def _check_cycle(self, name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise SourceError(f"relationships form a cycle: {' -> '.join([*above, name])}")
        for to in self[name].edges:
            self._check_cycle(to, (*above, name))

    def _chains(self, start: str, end: str) -> list[list[Edge]]:
        if start == end:
            return [[]]
        return [[edge, *rest] for to, edge in self[start].edges.items() for rest in self._chains(to, end)]

    def path(self, start: str, end: str) -> list[Edge]:
        """The chain of many-to-one edges from a source to another.

        None at all is an error that says whether the other way round exists
        (rows would multiply); two chains are an error, as they may disagree.
        """
        self[end]
        chains = self._chains(start, end)
        if not chains:
            why = "only the other way round: rows would multiply" if self._chains(end, start) else "the two are not related"
            raise SourceError(f"no many-to-one path from {start!r} to {end!r}; {why}")
        if len(chains) > 1:
            ways = [" -> ".join([start, *(e.to for e in c)]) for c in chains]
            raise SourceError(f"ambiguous path: {ways}; declare the shared table under two names")
        return chains[0]

    def reachable(self, start: str) -> list[str]:
        """Sources related to one, itself left out, nearest first."""
        found: list[str] = []
        layer = [start]
        while layer:
            layer = [to for name in layer for to in self[name].edges]
            found += [to for to in dict.fromkeys(layer) if to not in found]
        return found


def load_source_graph(spark: SparkSession, path: str) -> SourceGraph:
    """Declarations from a directory of YAML or JSON files."""
    return SourceGraph(read_definitions(spark, path))


def _checked(graph: SourceGraph, tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """A source's table with its declared fields only; a missing or differently typed one is an error."""
    s = graph[name]
    if s.table not in tables:
        raise SourceError(f"{name}: no table {s.table!r}")
    df = tables[s.table]
    found = {f.name: f.dataType for f in df.schema.fields}
    for f in s.fields.values():
        if f.name not in found:
            raise SourceError(f"{name}: table {s.table!r} has no column {f.name!r}")
        if not isinstance(found[f.name], TYPES[f.type]):
            raise SourceError(f"{name}.{f.name}: declared {f.type}, found {found[f.name].simpleString()}")
    return df.select(*[C(f"`{f}`") for f in s.fields])


def _shape(graph: SourceGraph, base: str, related: Iterable[str]) -> T.StructType:
    """What an expression of a source may use: its fields, and a struct for each related source."""
    def row(name: str) -> list[T.StructField]:
        return [T.StructField(f.name, TYPES[f.type][0]()) for f in graph[name].fields.values()]

    return T.StructType([*row(base), *(T.StructField(r, T.StructType(row(r))) for r in related)])


def sources_used(spark: SparkSession, graph: SourceGraph, base: str, expressions: Iterable[str]) -> list[str]:
    """Related sources that expressions refer to.

    Spark's analyzer decides on an empty frame, so names inside literals do not
    count.  An expression over a source that is no relation gets the reason.
    """
    wanted = [F.expr(e) for e in expressions]
    related = graph.reachable(base)

    def columns(names: Sequence[str]) -> set[str]:
        chosen = spark.createDataFrame([], _shape(graph, base, names)).select(*wanted)
        refs = chosen._jdf.queryExecution().analyzed().references().iterator()
        found = set()
        while refs.hasNext():
            found.add(refs.next().name())
        return found

    try:
        used = columns(related)
    except AnalysisException as exc:
        others = [o for o in graph.sources if o != base and o not in related and o not in graph[base].fields]
        try:
            stranger = next((o for o in others if o in columns([*related, *others])), None)
        except AnalysisException:
            stranger = None
        if stranger:
            graph.path(base, stranger)
        raise SourceError(f"{base}: {exc}") from exc
    return [r for r in related if r in used]


def declared_frame(
    graph: SourceGraph, tables: Mapping[str, DataFrame], base: str, related: Iterable[str] = ()
) -> DataFrame:
    """The rows of a source, each with a struct per related source (NULL fields where it has none).

    Every join is a left join from the many side to a whole key, so a row comes
    out once if the keys are unique (`relationship_report` counts those that are not).
    """
    hops: dict[tuple[str, str], Edge] = {}
    for name in related:
        for edge in graph.path(base, name):
            hops[(edge.source, edge.to)] = edge
    df = _checked(graph, tables, base)
    mine = [C(f"`{f}`") for f in graph[base].fields]
    # A source reached over two chains is refused by path(), so names of sources are unique here.
    for edge in hops.values():
        one = _checked(graph, tables, edge.to)
        one = one.select(*[C(f"`{f}`").alias(f"_{edge.to}__{f}") for f in one.columns])
        left = [C(f"`{k}`" if edge.source == base else f"`_{edge.source}__{k}`") for k in edge.on]
        on = None
        for k, p in zip(left, graph[edge.to].primary):
            same = k == C(f"`_{edge.to}__{p}`")
            on = same if on is None else on & same
        df = join_dimension(df, one, on)
    structs = [
        F.struct(*[C(f"`_{e.to}__{f}`").alias(f) for f in graph[e.to].fields]).alias(e.to) for e in hops.values()
    ]
    return df.select(*mine, *structs)


def unit_reference(graph: SourceGraph, base: str, unit: str) -> str:
    """Where a source's rows hold the key of the unit.

    The last edge's own field is that key, so the unit's table is not joined.
    """
    if len(graph[unit].primary) != 1:
        raise SourceError(f"unit {unit!r} needs a key of one field")
    try:
        chain = graph.path(base, unit)
    except SourceError as exc:
        raise SourceError(f"{base!r} has no grain of {unit!r}: {exc}") from exc
    if not chain:
        return graph[unit].primary[0]
    last = chain[-1]
    return last.on[0] if last.source == base else f"{last.source}.{last.on[0]}"


def _sides(metrics: Mapping[str, Metric]) -> dict[str, dict[str, Metric]]:
    """Metrics by the source they fold; a ratio over two sources becomes two folds."""
    out: dict[str, dict[str, Metric]] = {}
    for m in metrics.values():
        if m.type in PERCENTILES:
            raise SourceError(f"{m.name}: percentiles are of rows, not of units; use percentile_metrics on the declared frame")
        if not m.source:
            raise SourceError(f"{m.name}: names no source")
        if m.denominator_source and m.denominator_source != m.source:
            top = replace(m, type="mean", denominator=None, denominator_source="")
            bottom = replace(
                top, name=f"{m.name}__den", numerator=m.denominator, aggregate=m.denominator_aggregate, filter=None,
                source=m.denominator_source,
            )
            folds = (top, bottom)
        else:
            folds = (m,)
        for fold in folds:
            out.setdefault(fold.source, {})[fold.name] = fold
    return out


def _expressions(m: Metric) -> list[str]:
    return [e for e in (m.numerator, m.filter, m.denominator) if e]


def declared_units(
    graph: SourceGraph,
    tables: Mapping[str, DataFrame],
    assign: DataFrame,
    metrics: Mapping[str, Metric],
    unit: str,
    keys: Sequence[str],
    horizon_days: float | None = None,
) -> DataFrame:
    """One row per assigned unit with a column per metric, whatever sources the metrics come from.

    `unit` is the source whose key `assign.unit_id` holds.  Each source is
    scanned, joined and folded to units once; sources meet only as units, never
    row by row, so none multiplies another.  A filter of a ratio over two
    sources belongs to the numerator.
    """
    spark = assign.sparkSession
    taken = sorted(set(metrics) & set(assign.columns))
    if taken:
        raise SourceError(f"metrics {taken} have the names of assignment columns")
    per_source = []
    for base, folds in _sides(metrics).items():
        time = graph[base].time
        if not time:
            raise SourceError(f"{base!r} has no time, so its rows are neither before nor after exposure")
        holder = unit_reference(graph, base, unit)
        used: list[str] = []
        for m in folds.values():
            try:
                used += sources_used(spark, graph, base, _expressions(m))
            except SourceError as exc:
                raise SourceError(f"metric {m.name!r}: {exc}") from exc
        used += [ref.rpartition(".")[0] for ref in (holder, time) if "." in ref]
        frame = declared_frame(graph, tables, base, dict.fromkeys(used))
        facts = frame.withColumns({"_unit_id": F.expr(holder), "_at": F.expr(time).cast("timestamp")})
        renamed = assign.withColumnRenamed("unit_id", "_unit_id")
        clash = sorted({*keys, "first_exposure_at"} & set(facts.columns))
        if clash:
            raise SourceError(f"{base}: fields {clash} clash with columns of the assignment")
        folded, zero = folded_units(renamed, facts, folds, keys, "_unit_id", "_at", horizon_days)
        per_source.append((folded.withColumnRenamed("_unit_id", "unit_id"), zero))
    out = assign
    for folded, zero in per_source:
        out = join_units_zero_filled(out, folded, [*keys, "unit_id"], zero)
    return out


REPORT = "source string, related string, n_rows long, n_null long, n_orphans long, n_repeated_keys long, n_multiplied long"


def relationship_report(graph: SourceGraph, tables: Mapping[str, DataFrame]) -> DataFrame:
    """What the tables make of each edge: one row per edge.

    Rows of the many side, those without a key, those whose key is absent on
    the one side, keys that repeat there, and rows that a join would multiply.
    Both sides are counted per key first, so a hot key is one row.
    """
    spark = next(iter(tables.values())).sparkSession
    out = None
    for s in graph.sources.values():
        for edge in s.edges.values():
            one_key = graph[edge.to].primary
            many = _checked(graph, tables, s.name).groupBy(*[C(f"`{k}`").alias(f"k{i}") for i, k in enumerate(edge.on)])
            one = _checked(graph, tables, edge.to).groupBy(*[C(f"`{k}`").alias(f"k{i}") for i, k in enumerate(one_key)])
            names = [f"k{i}" for i in range(len(one_key))]
            both = many.agg(F.count(F.lit(1)).alias("_m")).join(one.agg(F.count(F.lit(1)).alias("_o")), names, "full")
            absent = F.lit(False)
            for k in names:
                absent = absent | C(k).isNull()
            m, o = F.coalesce("_m", F.lit(0)), F.coalesce("_o", F.lit(0))

            def total(value, cond):
                return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")

            row = both.agg(
                total(m, F.lit(True)).alias("n_rows"),
                total(m, absent).alias("n_null"),
                total(m, ~absent & (o == 0)).alias("n_orphans"),
                total(F.lit(1), ~absent & (o > 1)).alias("n_repeated_keys"),
                total(m, ~absent & (o > 1)).alias("n_multiplied"),
            ).select(F.lit(s.name).alias("source"), F.lit(edge.to).alias("related"), "*")
            out = row if out is None else out.unionByName(row)
    return spark.createDataFrame([], REPORT) if out is None else out


def refuse_fan_out(report: DataFrame) -> None:
    """Raise if the tables break a many-to-one promise; the report has one row per edge."""
    broken = {f"{r.source} -> {r.related}": r.n_multiplied for r in report.where("n_repeated_keys > 0").collect()}
    if broken:
        raise SourceError(f"keys repeat on the one side, rows would multiply: {dict(sorted(broken.items()))}")
