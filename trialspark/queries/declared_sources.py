"""Metrics over declared sources: the joins come from the declaration."""

from __future__ import annotations

import json

from ..functions.columns import rnd
from ..operators import metrics as mx
from ..plans import declared as dc
from ..plans.experiments import customer_assignment
from ..session import scratch_dir
from ..sources.readers import read_tables
from . import sql as S
from .registry import query
from .tests_of_effect import K


def _fields(spec: str) -> list[dict]:
    """`name:type[:role]`, blank-separated."""
    return [dict(zip(("name", "type", "role"), f.split(":"))) for f in spec.split()]


SOURCES = [
    {"name": "lineitem", "primary": ["l_orderkey", "l_linenumber"], "time": "orders.o_orderdate",
     "fields": _fields("l_orderkey:integer:identifier l_linenumber:integer:identifier l_partkey:integer:identifier l_suppkey:integer:identifier "
                       "l_quantity:float:measure l_extendedprice:float:measure l_discount:float:measure l_returnflag:string:dimension"),
     "relationships": [{"to": "orders", "on": "l_orderkey"}, {"to": "part", "on": "l_partkey"}, {"to": "supplier", "on": "l_suppkey"}]},
    {"name": "orders", "primary": "o_orderkey",
     "fields": _fields("o_orderkey:integer:identifier o_custkey:integer:identifier o_totalprice:float:measure o_orderdate:timestamp:event_time o_orderpriority:string:dimension"),
     "relationships": [{"to": "customer", "on": "o_custkey", "type": "many_to_one"}]},
    {"name": "customer", "primary": "c_custkey", "fields": _fields("c_custkey:integer:identifier c_nationkey:integer:identifier c_mktsegment:string:dimension"),
     "relationships": [{"to": "nation", "on": "c_nationkey"}]},
    {"name": "part", "primary": "p_partkey", "fields": _fields("p_partkey:integer:identifier p_brand:string:dimension p_retailprice:float:measure")},
    {"name": "supplier", "primary": "s_suppkey", "fields": _fields("s_suppkey:integer:identifier s_nationkey:integer:identifier"),
     "relationships": [{"to": "supplier_nation", "on": "s_nationkey"}]},
    {"name": "nation", "primary": "n_nationkey", "fields": _fields("n_nationkey:integer:identifier n_name:string:dimension n_regionkey:integer:identifier"),
     "relationships": [{"to": "region", "on": "n_regionkey"}]},
    {"name": "supplier_nation", "table": "nation", "primary": "n_nationkey", "fields": _fields("n_nationkey:integer:identifier n_name:string:dimension")},
    {"name": "region", "primary": "r_regionkey", "fields": _fields("r_regionkey:integer:identifier r_name:string:dimension")},
]
METRICS = [
    {"name": "net_sales", "type": "mean", "source": "lineitem", "numerator": "l_extendedprice * (1 - l_discount)", "description": "price after discount"},
    {"name": "urgent_items", "type": "mean", "source": "lineitem", "numerator": "l_linenumber", "aggregate": "count",
     "filter": "orders.o_orderpriority = '1-URGENT'", "description": "lines of urgent orders"},
    {"name": "import_sales", "type": "mean", "source": "lineitem", "numerator": "l_extendedprice",
     "filter": "supplier_nation.n_name <> nation.n_name AND part.p_brand <> 'Brand#1'", "description": "bought abroad"},
    {"name": "big_order", "type": "proportion", "source": "orders", "numerator": "o_orderkey", "filter": "o_totalprice > 300000", "description": "any big order"},
    {"name": "items_per_order", "type": "ratio", "source": "lineitem", "numerator": "l_quantity", "denominator": "1", "denominator_source": "orders",
     "description": "quantity over orders"},
]
VALUES = {"net_sales": 5, "urgent_items": 6, "import_sales": 5, "big_order": 6, "items_per_order": 4, "items_per_order__den": 6}
UNITS_SQL = """ca AS (SELECT n_name AS experiment_id, c_custkey AS unit_id, CASE WHEN c_custkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
li AS (SELECT o_custkey, sum(l_extendedprice * (1 - l_discount)) AS net_sales, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent_items,
  sum(l_extendedprice) FILTER (s_nationkey <> c_nationkey AND p_brand <> 'Brand#1') AS import_sales, sum(l_quantity) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey
  WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey),
od AS (SELECT o_custkey, count(*) AS n_orders, max(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS big FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey),
du AS (SELECT experiment_id, unit_id, arm, coalesce(net_sales, 0)*1.0::DOUBLE AS net_sales, coalesce(urgent_items, 0)*1.0::DOUBLE AS urgent_items, coalesce(import_sales, 0)*1.0::DOUBLE AS import_sales,
  coalesce(big, 0)*1.0::DOUBLE AS big_order, coalesce(quantity, 0)*1.0::DOUBLE AS items_per_order, coalesce(n_orders, 0)*1.0::DOUBLE AS items_per_order__den
  FROM ca LEFT JOIN li ON unit_id = li.o_custkey LEFT JOIN od ON unit_id = od.o_custkey)"""


def _tables(spark, sf):
    return read_tables(spark, sf, sorted({s.get("table", s["name"]) for s in SOURCES}))


def _units(spark, sf):
    """The declaration is read back from a directory, as users keep it."""
    folder = scratch_dir(spark, "declared-sources")
    lines = spark.createDataFrame([(json.dumps(s),) for s in SOURCES], "value string")
    lines.repartition(len(SOURCES)).write.text(folder)
    graph = dc.load_source_graph(spark, folder)
    assign = customer_assignment(spark, sf).select("experiment_id", "unit_id", "arm", "first_exposure_at")
    return dc.declared_units(graph, _tables(spark, sf), assign, mx.metric_catalog(METRICS), "customer", K)


@query("declared_units", f"WITH {UNITS_SQL} SELECT experiment_id, unit_id, arm, {', '.join(f'{S.rnd(m, d)} AS {m}' for m, d in VALUES.items())} FROM du")
def q_units(spark, sf):
    """Five metrics of two fact sources per customer; fields of seven tables, joined as declared."""
    return _units(spark, sf).select("experiment_id", "unit_id", "arm", *[rnd(m, d).alias(m) for m, d in VALUES.items()])


WELCHED = ("net_sales", "urgent_items", "import_sales")


def _test_sql(m):
    return f"{S.moments(f'm_{m}', 'du', 'experiment_id', m)}, {S.pairs(f'p_{m}', f'm_{m}', 'experiment_id')}, {S.welch(f'w_{m}', f'p_{m}')}"


@query("declared_metric_tests", f"""WITH {UNITS_SQL}, {', '.join(map(_test_sql, WELCHED))},
{S.moments('mp', 'du', 'experiment_id', 'big_order')}, {S.pairs('pp', 'mp', 'experiment_id')},
pa AS (SELECT *, total_treatment/n_treatment - total_control/n_control AS diff, (total_control+total_treatment)/(n_control+n_treatment) AS pool FROM pp),
pb AS (SELECT *, CASE WHEN pool IN (0, 1) THEN 0 ELSE diff/sqrt(pool*(1-pool)*(1.0/n_control+1.0/n_treatment)) END AS zz FROM pa),
rm AS (SELECT experiment_id, arm, count(*) AS n, avg(items_per_order) AS mean_x, avg(items_per_order__den) AS mean_y, var_samp(items_per_order) AS var_x, var_samp(items_per_order__den) AS var_y,
  covar_samp(items_per_order, items_per_order__den) AS cov, sum(items_per_order) AS sum_x, sum(items_per_order__den) AS sum_y FROM du GROUP BY experiment_id, arm),
{S.pairs('rp', 'rm', 'experiment_id', 'n mean_x mean_y var_x var_y cov sum_x sum_y')},
ra AS (SELECT *, sum_x_treatment/sum_y_treatment - sum_x_control/sum_y_control AS diff, sqrt(
 (var_x_control - 2*(sum_x_control/sum_y_control)*cov_control + power(sum_x_control/sum_y_control,2)*var_y_control)/(mean_y_control*mean_y_control*n_control) +
 (var_x_treatment - 2*(sum_x_treatment/sum_y_treatment)*cov_treatment + power(sum_x_treatment/sum_y_treatment,2)*var_y_treatment)/(mean_y_treatment*mean_y_treatment*n_treatment)) AS se FROM rp)
{' UNION ALL '.join(f"SELECT experiment_id, '{m}' AS metric, {S.rnd('diff', 3)} AS diff, {S.rnd('p_value')} AS p_value FROM w_{m}" for m in WELCHED)}
UNION ALL SELECT experiment_id, 'big_order', {S.rnd('diff', 3)}, {S.rnd(f"CASE WHEN zz = 0 THEN 1 ELSE {S.normal_two_sided('zz')} END")} FROM pb
UNION ALL SELECT experiment_id, 'items_per_order', {S.rnd('diff', 3)}, {S.rnd(S.normal_two_sided('diff/se'))} FROM ra""")
def q_tests(spark, sf):
    t = mx.metric_tests(_units(spark, sf), mx.metric_catalog(METRICS), K)
    return t.select("experiment_id", "metric", rnd("diff", 3).alias("diff"), rnd("p_value").alias("p_value"))


def _edge_sql(source, many, key, related, one, primary):
    rows = f"(SELECT count(*) FROM {many} m WHERE m.{key} IN (SELECT {primary} FROM {one} GROUP BY 1 HAVING count(*) > 1))"
    return f"""SELECT '{source}' AS source, '{related}' AS related, (SELECT count(*) FROM {many}) AS n_rows, (SELECT count(*) FROM {many} WHERE {key} IS NULL) AS n_null,
 (SELECT count(*) FROM {many} m ANTI JOIN {one} o ON m.{key} = o.{primary} WHERE m.{key} IS NOT NULL) AS n_orphans,
 (SELECT count(*) FROM (SELECT {primary} FROM {one} GROUP BY 1 HAVING count(*) > 1)) AS n_repeated_keys, {rows} AS n_multiplied"""


EDGES = [
    ("lineitem", "lineitem", "l_orderkey", "orders", "orders", "o_orderkey"), ("lineitem", "lineitem", "l_partkey", "part", "part", "p_partkey"),
    ("lineitem", "lineitem", "l_suppkey", "supplier", "supplier", "s_suppkey"), ("orders", "orders", "o_custkey", "customer", "customer", "c_custkey"),
    ("customer", "customer", "c_nationkey", "nation", "nation", "n_nationkey"), ("supplier", "supplier", "s_nationkey", "supplier_nation", "nation", "n_nationkey"),
    ("nation", "nation", "n_regionkey", "region", "region", "r_regionkey"),
]


@query("relationship_report", " UNION ALL ".join(_edge_sql(*e) for e in EDGES))
def q_report(spark, sf):
    return dc.relationship_report(dc.SourceGraph(SOURCES), _tables(spark, sf))
