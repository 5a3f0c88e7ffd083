"""Declared sources: validation, joins planned from edges, refusals, and metrics over several sources."""

import pytest
from pyspark.sql import Row

from trialspark.operators.metrics import MetricError, metric_catalog
from trialspark.plans import declared as dc
from trialspark.queries.declared_sources import METRICS, SOURCES
from trialspark.queries.declared_sources import _fields


def spec(name, fields, primary="id", **more):
    return {"name": name, "primary": primary, "fields": _fields(fields), **more}


USERS = spec("users", "id:integer:identifier plan:integer:identifier", relationships=[{"to": "plans", "on": "plan"}])
PLANS = spec("plans", "id:integer:identifier tier:string:dimension")
VISITS = spec("visits", "id:integer:identifier user:integer:identifier at:timestamp:event_time pages:float:measure",
              relationships=[{"to": "users", "on": "user"}])
SALES = spec("sales", "id:integer:identifier visit:integer:identifier amount:float:measure", time="visits.at",
             relationships=[{"to": "visits", "on": "visit"}])
GRAPH = [USERS, PLANS, VISITS, SALES]


def changed(base, **more):
    return {**base, **more}


def metric(name, source, numerator, **more):
    return {"name": name, "type": "mean", "source": source, "numerator": numerator, "description": "d", **more}


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "plans": spark.createDataFrame([(1, "free"), (2, "paid")], "id int, tier string"),
        "users": spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 9)], "id long, plan int"),
        "visits": spark.sql("""SELECT * FROM VALUES (1L, 10L, timestamp'2024-01-02', 3D), (2L, 10L, timestamp'2024-01-03', 4D), (3L, 11L, timestamp'2024-01-02', 5D),
            (4L, 11L, timestamp'2023-12-31', 100D), (5L, 12L, timestamp'2024-01-02', NULL), (6L, NULL, timestamp'2024-01-02', 7D) AS t(id, user, at, pages)"""),
        "sales": spark.createDataFrame([(1, 1, 5.0), (2, 1, 6.0), (3, 3, 7.0), (4, 4, 99.0), (5, 5, 1.0), (6, 77, 50.0), (7, None, 60.0)], "id long, visit long, amount double"),
    }


@pytest.fixture(scope="module")
def assign(spark):
    rows = [("e", 10, "control"), ("e", 11, "treatment"), ("e", 12, "control"), ("e", 14, "treatment")]
    return spark.createDataFrame(rows, "experiment_id string, unit_id long, arm string").selectExpr("*", "timestamp'2024-01-01' AS first_exposure_at")


@pytest.mark.parametrize("specs, why", [
    ([changed(USERS, extra=1), PLANS], "unknown fields"),
    ([PLANS, PLANS], "duplicate"),
    ([changed(PLANS, name="a b")], "identifier"),
    ([changed(PLANS, primary="tier")], "identifier"),
    ([changed(PLANS, primary=[])], "list of names"),
    ([USERS], "unknown source"),
    ([spec("p", "id:integer:identifier a:timestamp:event_time b:timestamp:event_time")], "event_time"),
    ([spec("p", "id:integer:identifier a:number")], "unknown type"),
    ([spec("p", "id:integer:identifier id:integer")], "twice"),
    ([changed(USERS, relationships=[{"to": "plans", "on": "plan", "type": "one_to_many"}]), PLANS], "other side"),
    ([changed(USERS, relationships=[{"to": "plans", "on": "plan"}] * 2), PLANS], "two relationships"),
    ([changed(USERS, relationships=[{"to": "plans", "on": "nope"}]), PLANS], "not a field"),
    ([USERS, changed(PLANS, primary=["id", "tier"], fields=_fields("id:integer:identifier tier:string:identifier"))], "does not cover the key"),
    ([USERS, changed(PLANS, fields=_fields("id:string:identifier"))], "differ in type"),
    ([changed(PLANS, relationships=[{"to": "plans", "on": "id"}])], "cycle"),
    ([spec("x", "id:integer:identifier plans:integer", relationships=[{"to": "plans", "on": "id"}]), PLANS], "both fields and related"),
    ([changed(PLANS, time="when")], "not a field"),
    ([changed(PLANS, time="users.id"), USERS], "multiply"),
])
def test_declarations_that_cannot_hold_are_refused(specs, why):
    with pytest.raises(dc.SourceError, match=why):
        dc.SourceGraph(specs)


def test_paths_follow_edges_one_way():
    g = dc.SourceGraph(GRAPH)
    assert [e.to for e in g.path("sales", "plans")] == ["visits", "users", "plans"] and g.path("users", "users") == []
    assert g.reachable("sales") == ["visits", "users", "plans"]
    with pytest.raises(dc.SourceError, match="multiply"):
        g.path("visits", "sales")
    with pytest.raises(dc.SourceError, match="not related"):
        dc.SourceGraph([*GRAPH, changed(PLANS, name="lone")]).path("sales", "lone")
    twice = changed(SALES, fields=_fields("id:integer:identifier visit:integer user:integer amount:float"), relationships=[{"to": "visits", "on": "visit"}, {"to": "users", "on": "user"}])
    with pytest.raises(dc.SourceError, match="ambiguous"):
        dc.SourceGraph([USERS, PLANS, VISITS, twice]).path("sales", "plans")


def test_only_the_sources_an_expression_needs(spark):
    g = dc.SourceGraph(GRAPH)
    assert dc.sources_used(spark, g, "sales", ["amount", "'users.plan' = 'x'"]) == []
    assert dc.sources_used(spark, g, "sales", ["amount * visits.pages", "plans.tier = 'paid'"]) == ["visits", "plans"]
    with pytest.raises(dc.SourceError, match="multiply"):
        dc.sources_used(spark, g, "visits", ["sales.amount"])
    with pytest.raises(dc.SourceError, match="visits"):
        dc.sources_used(spark, g, "visits", ["nothing"])
    assert dc.unit_reference(g, "sales", "users") == "visits.user" and dc.unit_reference(g, "visits", "users") == "user"
    with pytest.raises(dc.SourceError, match="grain"):
        dc.unit_reference(g, "plans", "users")


def test_every_row_comes_out_once(spark, tables):
    rows = {r.id: r for r in dc.declared_frame(dc.SourceGraph(GRAPH), tables, "sales", ["plans", "visits"]).collect()}
    assert len(rows) == 7 and rows[1].plans.tier == "free" and rows[3].visits.pages == 5.0
    assert rows[5].plans.tier is None and rows[6].visits.id is None and rows[7].visits.id is None


def test_units_over_two_sources(spark, tables, assign):
    """Sales and visits meet as units: two sales of one visit don't count its pages twice."""
    catalog = metric_catalog([
        metric("amount", "sales", "amount"), metric("paid", "sales", "amount", filter="plans.tier = 'paid'"),
        metric("pages", "visits", "pages"),
        {**metric("per_visit", "sales", "amount"), "type": "ratio", "denominator": "1", "denominator_source": "visits"},
        {**metric("per_page", "visits", "pages"), "type": "ratio", "denominator": "1"},
        metric("mean_pages", "visits", "pages", aggregate="avg"),
    ])
    got = {r.unit_id: r for r in dc.declared_units(dc.SourceGraph(GRAPH), tables, assign, catalog, "users", ["experiment_id"]).collect()}
    def values(u):
        r = got[u]
        return (r.amount, r.paid, r.pages, r.per_visit, r.per_visit__den, r.mean_pages)

    assert values(10) == (11.0, 0.0, 7.0, 11.0, 2.0, 3.5)
    assert values(11) == (7.0, 7.0, 5.0, 7.0, 1.0, 5.0)
    assert values(12) == (1.0, 0.0, 0.0, 1.0, 1.0, None)
    assert values(14) == (0.0, 0.0, 0.0, 0.0, 0.0, None) and len(got) == 4


@pytest.mark.parametrize("m, why", [
    (metric("m", "plans", "id"), "no time"),
    (metric("m", "visits", "sales.amount"), "'m'.*multiply"),
    (metric("m", "visits", "pagez"), "'m'"),
    (metric("m", "", "pages"), "names no source"),
    ({**metric("m", "visits", "pages"), "type": "p50"}, "percentiles"),
    (metric("arm", "visits", "pages"), "names of assignment columns"),
])
def test_metrics_that_clash_are_refused(spark, tables, assign, m, why):
    with pytest.raises(dc.SourceError, match=why):
        dc.declared_units(dc.SourceGraph(GRAPH), tables, assign, metric_catalog([m]), "users", ["experiment_id"])


def test_a_fact_without_the_unit_grain(spark, tables, assign):
    dated = changed(PLANS, fields=_fields("id:integer:identifier tier:string since:timestamp:event_time"))
    with pytest.raises(dc.SourceError, match="grain"):
        dc.declared_units(dc.SourceGraph([USERS, dated, VISITS, SALES]), tables, assign, metric_catalog([metric("m", "plans", "id")]), "users", ["experiment_id"])
    with pytest.raises(MetricError):
        metric_catalog([metric("m", "plans", "id", denominator_source="visits")])


def test_tables_must_match_the_declaration(spark, tables):
    g = dc.SourceGraph(GRAPH)
    for bad, why in (({}, "no table"), ({"plans": tables["plans"].drop("tier")}, "no column"), ({"plans": tables["plans"].selectExpr("id", "1 AS tier")}, "declared string")):
        with pytest.raises(dc.SourceError, match=why):
            dc.declared_frame(g, bad, "plans")


def test_report_counts_what_breaks_an_edge(spark, tables):
    g = dc.SourceGraph(GRAPH)
    report = {(r.source, r.related): r for r in dc.relationship_report(g, tables).collect()}
    assert report[("users", "plans")] == Row("users", "plans", 4, 1, 1, 0, 0)
    assert tuple(report[("sales", "visits")]) == ("sales", "visits", 7, 1, 1, 0, 0)
    dc.refuse_fan_out(dc.relationship_report(g, tables))
    doubled = {**tables, "plans": tables["plans"].union(tables["plans"].where("id = 1"))}
    r = dc.relationship_report(g, doubled)
    assert [tuple(x) for x in r.where("n_repeated_keys > 0").collect()] == [("users", "plans", 4, 1, 1, 1, 1)]
    with pytest.raises(dc.SourceError, match="users -> plans"):
        dc.refuse_fan_out(r)
    empty = {k: v.where("false") for k, v in tables.items()}
    assert {tuple(x)[2:] for x in dc.relationship_report(g, empty).collect()} == {(0, 0, 0, 0, 0)}
    assert dc.relationship_report(dc.SourceGraph([PLANS]), tables).count() == 0


def test_no_table_is_joined_without_need(spark, sf):
    from trialspark.plans.experiments import customer_assignment
    from trialspark.queries.declared_sources import _tables

    m = metric_catalog([m for m in METRICS if m["name"] == "urgent_items"])
    units = dc.declared_units(dc.SourceGraph(SOURCES), _tables(spark, sf), customer_assignment(spark, sf), m, "customer", ["experiment_id"])
    plan = units._jdf.queryExecution().executedPlan().toString()
    read = "".join(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "l_orderkey" in read and "o_orderpriority" in read
    assert not any(c in read for c in ("p_brand", "s_suppkey", "l_extendedprice"))
