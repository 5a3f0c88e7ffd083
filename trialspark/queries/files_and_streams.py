"""Sources, sinks, the analysis store and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators.srm import srm_trend_from_windows
from ..plans.verdict import report_metric_table
from ..session import scratch_dir
from ..sources import readers, sinks
from ..streaming import monitors as st
from . import sql as S
from .decisions import K, TS_DAY, _effects, conversation_log
from .ratio_and_bayes import POOLED, _mix
from .registry import query

C = F.col
CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
BY_SEGMENT = f"SELECT c_mktsegment, count(*) AS n, {S.rnd('sum(c_acctbal)', 2)} AS balance FROM customer GROUP BY c_mktsegment"


def _by_segment(df):
    return df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("c_acctbal"), 2).alias("balance"))


def _customer_file(spark, sf, kind, suffix, **options):
    path = f"{scratch_dir(spark, kind)}.{suffix}"
    spark.read.parquet(f"{sf}/customer.parquet").write.format(kind).options(**options).save(path)
    return path


@query("load_table", BY_SEGMENT)
def q_load_table(spark, sf):
    path = _customer_file(spark, sf, "json", "jsonl")
    return _by_segment(readers.load_table(spark, path, CUSTOMER))


@query("scan_csv", BY_SEGMENT)
def q_scan_csv(spark, sf):
    return _by_segment(readers.scan_csv(spark, _customer_file(spark, sf, "csv", "csv", header=True), CUSTOMER))


@query("scan_csv_inferred", BY_SEGMENT)
def q_scan_csv_inferred(spark, sf):
    return _by_segment(readers.load_table(spark, _customer_file(spark, sf, "csv", "tsv", header=True, sep="\t")))


@query("scan_profile_source", f"SELECT source, c_mktsegment, n, balance FROM (SELECT unnest(['orc', 'parquet', 'view']) AS source), ({BY_SEGMENT})")
def q_scan_profile(spark, sf):
    spark.read.parquet(f"{sf}/customer.parquet").createOrReplaceTempView("profiled_customer")
    parts = {
        "parquet": readers.scan_profile_source(spark, f"{sf}/customer.parquet"),
        "orc": readers.scan_profile_source(spark, _customer_file(spark, sf, "orc", "orc")),
        "view": readers.scan_profile_source(spark, "profiled_customer"),
    }
    out = None
    for name, df in parts.items():
        part = _by_segment(df).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("register_csv_table", "SELECT count(*) AS n_rows FROM customer")
def q_register(spark, sf):
    return readers.register_csv_table(spark, _customer_file(spark, sf, "csv", "csv", header=True), "registered_customer", CUSTOMER)


@query("load_experiment", f"WITH {S.CUST_ASSIGN} SELECT arm, count(*) AS n FROM cust_assign GROUP BY arm")
def q_load_experiment(spark, sf):
    from ..plans.experiments import customer_assignment
    customer_assignment(spark, sf).createOrReplaceTempView("customer_experiment")
    return readers.load_experiment(spark, "customer_experiment", "arm").groupBy("arm").agg(F.count(F.lit(1)).alias("n"))


@query("scan_csv_stream", BY_SEGMENT)
def q_csv_stream(spark, sf):
    path = _customer_file(spark, sf, "csv", "csv", header=True)
    out = scratch_dir(spark, "csv-stream")
    st.run_available(readers.scan_csv_stream(spark, path, CUSTOMER), "append", out)
    return _by_segment(spark.read.parquet(f"{out}/data"))


@query("history", """SELECT conv_id AS experiment_id, count(*) FILTER (WHERE NOT (conv_id % 5 = 0 AND turn = 1)) AS n_entries FROM conversations GROUP BY conv_id""")
def q_history(spark, sf):
    c = conversation_log(spark, sf).select("experiment_id", "seq", "status", "text")
    line = F.to_json(F.struct("*"))
    broken = (C("experiment_id") % 5 == 0) & (C("seq") == 1)
    path = scratch_dir(spark, "log")
    c.select(F.when(broken, F.expr("left(to_json(struct(*)), 12)")).otherwise(line).alias("value")).write.text(path)
    h = readers.history(spark, path)
    return h.where("_corrupt_record IS NULL").groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n_entries"))


@query("history_corrupt", "SELECT count(*) AS n_corrupt FROM conversations WHERE conv_id % 5 = 0 AND turn = 1")
def q_history_corrupt(spark, sf):
    c = conversation_log(spark, sf).select("experiment_id", "seq", "status", "text")
    broken = (C("experiment_id") % 5 == 0) & (C("seq") == 1)
    path = scratch_dir(spark, "log")
    c.select(F.when(broken, F.expr("left(to_json(struct(*)), 12)")).otherwise(F.to_json(F.struct("*"))).alias("value")).write.text(path)
    return readers.history(spark, path).agg(F.count("_corrupt_record").alias("n_corrupt"))


EFFECT = f"WITH {S.CUST_UNITS}, {S.moments('m', 'units', 'experiment_id', 'value')}, {S.pairs('p', 'm', 'experiment_id')}"


@query("sink_metric_table", f"{EFFECT} SELECT experiment_id, 'value' AS name, 'guardrail' AS role_check, format('{{:+.4g}}', mean_treatment - mean_control) AS lift_head FROM p")
def q_sink_csv(spark, sf):
    eff = _effects(spark, sf).where("metric = 'value'")
    rows = report_metric_table(eff.select(
        "experiment_id", F.lit("guardrail").alias("role"), C("metric").alias("name"), F.lit("higher_is_better").alias("direction"), "diff", "lift_pct",
        C("ci_lower").alias("ci_lower_95"), C("ci_upper").alias("ci_upper_95"), "ci_lower_90", "ci_upper_90", F.lit(None).cast("string").alias("verdict")), K)
    path = scratch_dir(spark, "metric-table")
    sinks.sink_metric_table(rows, path)
    back = readers.scan_csv(spark, path, "experiment_id string, name string, direction string, lift string, ci_95 string, ci_90 string, status string")
    return back.select("experiment_id", "name", F.lit("guardrail").alias("role_check"), F.split("lift", " ")[0].alias("lift_head"))


@query("sink_json", f"{EFFECT} SELECT experiment_id, {S.rnd('mean_control', 3)} AS mean_control, NULL::DOUBLE AS infinite FROM p")
def q_sink_json(spark, sf):
    eff = _effects(spark, sf).where("metric = 'value'").select("experiment_id", "mean_control", F.lit(float("inf")).alias("infinite"))
    path = scratch_dir(spark, "json")
    sinks.sink_json(eff, path)
    back = spark.read.schema("experiment_id string, mean_control double, infinite double").json(path)
    return back.select("experiment_id", rnd("mean_control", 3).alias("mean_control"), "infinite")


def _store(spark, sf):
    """Two analyses of every experiment; the later one covers only some of them."""
    path = scratch_dir(spark, "analyses")
    m = _effects(spark, sf).where("metric = 'value'").select("experiment_id", "mean_control")
    sinks.save_analysis(m.withColumn("round", F.lit(1)), path, F.lit("2024-01-01 00:00:00"))
    sinks.save_analysis(m.where("experiment_id < 'NATION_2'").withColumn("round", F.lit(2)), path, F.lit("2024-01-08 00:00:00"))
    return sinks.read_analyses(spark, path)


@query("save_analysis", f"{EFFECT} SELECT round, count(*) AS n FROM (SELECT 1 AS round FROM p UNION ALL SELECT 2 FROM p WHERE experiment_id < 'NATION_2') GROUP BY round")
def q_save(spark, sf):
    return _store(spark, sf).groupBy("round").agg(F.count(F.lit(1)).alias("n"))


@query("latest_analysis", f"""{EFFECT} SELECT experiment_id, CASE WHEN experiment_id < 'NATION_2' THEN 2 ELSE 1 END AS round, {S.rnd('mean_control', 3)} AS mean_control FROM p""")
def q_latest(spark, sf):
    latest = sinks.latest_analysis(_store(spark, sf), ["experiment_id"])
    return latest.select("experiment_id", "round", rnd("mean_control", 3).alias("mean_control"))


@query("list_experiments", """WITH e AS (SELECT o_custkey AS experiment_id, min(o_orderdate) AS created, max(o_orderdate) AS updated, bool_or(o_orderstatus = 'O') AS open FROM orders GROUP BY 1)
SELECT experiment_id, c_name AS name, 'open' AS status, strftime(created, '%Y-%m-%d') AS created, strftime(updated, '%Y-%m-%d') AS updated FROM e JOIN customer ON c_custkey = experiment_id WHERE open""")
def q_list(spark, sf):
    t = readers.read_tables(spark, sf, ["orders", "customer"])
    e = t["orders"].groupBy(C("o_custkey").alias("experiment_id")).agg(
        F.min("o_orderdate").alias("created"), F.max("o_orderdate").alias("updated"),
        F.when(F.bool_or(C("o_orderstatus") == "O"), "open").otherwise("closed").alias("status"))
    e = e.join(t["customer"].select(C("c_custkey").alias("experiment_id"), C("c_name").alias("name")), "experiment_id")
    out = sinks.list_experiments(e, "open")
    return out.select("experiment_id", "name", "status", F.date_format("created", "yyyy-MM-dd").alias("created"), F.date_format("updated", "yyyy-MM-dd").alias("updated"))


# --- streams ---------------------------------------------------------------------------

def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
            .select(F.lit("all").alias("experiment_id"), C("ts").cast("timestamp").alias("event_at"), C("user_id").alias("unit_id"),
                    F.when(C("user_id") % 2 == 0, "control").otherwise("treatment").alias("arm"), "value"))


ALL_EV = """ae AS (SELECT 'all' AS experiment_id, ts AS event_at, user_id AS unit_id, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, value FROM events)"""
CLOSED = f"""{ALL_EV}, hi AS (SELECT max(event_at) AS top FROM ae),
wc AS (SELECT experiment_id, date_trunc('day', event_at) AS ws, arm, count(*) AS n FROM ae, hi WHERE date_trunc('day', event_at) + INTERVAL 1 DAY <= top - INTERVAL 1 HOUR GROUP BY ALL),
wx AS (SELECT experiment_id, ws, CAST(sum(n) AS BIGINT) AS n_total, sum(power(n - t/2.0, 2)/(t/2.0)) AS chi2 FROM (SELECT *, sum(n) OVER (PARTITION BY experiment_id, ws) AS t FROM wc) GROUP BY ALL),
wv AS (SELECT *, {S.chi_one('chi2')} AS p FROM wx)"""


@query("stream_srm_trend", f"WITH {CLOSED} SELECT experiment_id, strftime(ws, '%Y-%m-%d') AS window_start, n_total, {S.rnd('p')} AS p_value, {S.srm_label('p', 0.0005)} AS verdict FROM wv")
def q_stream_srm(spark, sf):
    path = st.stream_folder(spark, "srm")
    st.stream_srm_trend(_event_stream(spark, sf), K, "event_at", path)
    w = st.srm_of_closed_windows(spark, path, K)
    return w.select("experiment_id", F.date_format("window_start", TS_DAY).alias("window_start"), "n_total", rnd("p_value").alias("p_value"), "verdict")


@query("stream_srm_summary", f"WITH {CLOSED} SELECT experiment_id, count(*) AS n_windows, count(*) FILTER (WHERE p <= 0.0005) > 0 AS blocked FROM wv GROUP BY experiment_id")
def q_stream_srm_summary(spark, sf):
    path = st.stream_folder(spark, "srm")
    st.stream_srm_trend(_event_stream(spark, sf), K, "event_at", path)
    t = srm_trend_from_windows(st.srm_of_closed_windows(spark, path, K), K)
    return t.select("experiment_id", "n_windows", (C("verdict") == "BLOCK").alias("blocked"))


@query("stream_sequential_monitor", f"""WITH {ALL_EV}, {S.moments('m', 'ae', 'experiment_id', 'value')}, {S.pairs('p', 'm', 'experiment_id')},
d AS (SELECT *, mean_treatment - mean_control AS diff FROM p), {_mix(POOLED, 'd', 's')}
SELECT experiment_id, arm, n_control, n_treatment, {S.rnd('diff', 5)} AS diff, {S.rnd('radius', 4)} AS radius,
  CASE WHEN diff - radius > 0 OR diff + radius < 0 THEN 'STOP_REJECT' ELSE 'CONTINUE' END AS decision FROM s""")
def q_stream_seq(spark, sf):
    path = st.stream_folder(spark, "sequential")
    st.stream_sequential_monitor(_event_stream(spark, sf), K, path)
    s = st.latest_batch(spark, path)
    return s.select("experiment_id", "arm", "n_control", "n_treatment", rnd("diff", 5).alias("diff"), rnd("radius", 4).alias("radius"), "decision")


@query("stream_sample_accumulation", f"""WITH {ALL_EV}, f AS (SELECT experiment_id, unit_id, min(event_at) AS t FROM ae GROUP BY ALL)
SELECT experiment_id, strftime(t, '%Y-%m-%d') AS day, count(*) AS new_units FROM f GROUP BY ALL""")
def q_stream_acc(spark, sf):
    path = st.stream_folder(spark, "accrual")
    st.stream_sample_accumulation(_event_stream(spark, sf), K, "unit_id", "event_at", path, "60 days")
    u = st.units_per_day(spark, path, K, "unit_id")
    return u.select("experiment_id", F.date_format("day", TS_DAY).alias("day"), "new_units")
