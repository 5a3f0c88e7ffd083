"""SQL building blocks of the checks.

They avoid the engine's own formulas: tails of distributions are Simpson sums
over a generated range, quantiles are solved by Newton steps on those sums.
"""

from __future__ import annotations

from statistics import NormalDist

N = 2000


def z(p: float) -> float:
    return NormalDist().inv_cdf(p)


def rnd(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def simpson(f: str, n: int = N, var: str = "i", mark: str = "{u}") -> str:
    """Integral over u in [0, 1) of f(u); f may use any column and the mark."""
    w = f"(CASE WHEN {var} = 0 THEN 1 WHEN {var} % 2 = 1 THEN 4 ELSE 2 END)"
    body = f.replace(mark, f"(CAST({var} AS DOUBLE)/{n})")
    return f"(list_sum(list_transform(range(0, {n}), lambda {var}: {w} * ({body}))) / (3.0 * {n}))"


def normal_tail(x: str, n: int = N, var: str = "i") -> str:
    """P(Z > x) for x >= 0."""
    t = f"(({x}) + {{u}}/(1-{{u}}))"
    return simpson(f"exp(-0.5*{t}*{t}) / 2.5066282746310002 / ((1-{{u}})*(1-{{u}}))", n, var)


def t_power(df: str, crit: str, shift: str) -> str:
    """Power of the two-sided t test: two normal tails averaged over the scale s.

    Simpson over s in (0, 3), with a short inner sum for each tail; tails of
    negative arguments are reflected.
    """
    s = "(3*<s> + 1e-9)"
    near = f"({crit}*{s} - {shift})"
    tail = normal_tail(f"abs({near})", 240, "k")
    reflected = f"(CASE WHEN {near} >= 0 THEN {tail} ELSE 1 - {tail} END)"
    far = normal_tail(f"({crit}*{s} + {shift})", 240, "k")
    weight = f"exp(({df} - 1)*ln({s}) - {df}*({s}*{s} - 1)/2)"
    top = simpson(f"{weight}*({reflected} + {far})", 600, "j", "<s>")
    bottom = simpson(weight, 600, "j", "<s>")
    return f"({top}/{bottom})"


def normal_two_sided(x: str) -> str:
    return f"(2*{normal_tail(f'abs({x})')})"


def normal_cdf(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN 1 - {normal_tail(f'abs({x})')} ELSE {normal_tail(f'abs({x})')} END)"


def t_density(t: str, df: str) -> str:
    return (
        f"exp(lgamma((({df})+1)/2) - lgamma(({df})/2) - 0.5*ln(({df})*pi()) "
        f"- ((({df})+1)/2)*ln(1 + ({t})*({t})/({df})))"
    )


def t_tail(x: str, df: str) -> str:
    """P(T > x) for x >= 0."""
    t = f"(({x}) + {{u}}/(1-{{u}}))"
    return simpson(f"{t_density(t, df)} / ((1-{{u}})*(1-{{u}}))")


def t_start(p: float, df: str) -> str:
    q = z(p)
    g1, g2 = (q**3 + q) / 4, (5 * q**5 + 16 * q**3 + 3 * q) / 96
    g3 = (3 * q**7 + 19 * q**5 + 17 * q**3 - 15 * q) / 384
    return f"({q!r} + {g1!r}/({df}) + {g2!r}/(({df})*({df})) + {g3!r}/(({df})*({df})*({df})))"


def t_crit_ctes(src: str, out: str, p: float, df: str = "df", name: str = "crit", steps: int = 3) -> str:
    """CTEs that add the t quantile of `df` as column `name`."""
    parts = [f"{out}_0 AS (SELECT *, {t_start(p, df)} AS _t FROM {src})"]
    for k in range(1, steps + 1):
        parts.append(
            f"{out}_{k} AS (SELECT * EXCLUDE (_t), _t + ({t_tail('_t', df)} - {1 - p!r})/{t_density('_t', df)} AS _t "
            f"FROM {out}_{k-1})"
        )
    parts.append(f"{out} AS (SELECT * EXCLUDE (_t), _t AS {name} FROM {out}_{steps})")
    return ",\n".join(parts)


def magnitude(x: str) -> str:
    return (
        f"CASE WHEN abs({x}) < 0.2 THEN 'Negligible' WHEN abs({x}) < 0.5 THEN 'Small' "
        f"WHEN abs({x}) < 0.8 THEN 'Medium' WHEN {x} IS NOT NULL THEN 'Large' END"
    )


CUST_ASSIGN = """cust_assign AS (
  SELECT n_name AS experiment_id, c_custkey AS unit_id,
         CASE WHEN c_custkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm,
         TIMESTAMP '1998-01-01' AS first_exposure_at, c_mktsegment, r_name AS region, c_acctbal
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

CUST_UNITS = CUST_ASSIGN + """,
order_fold AS (
  SELECT o_custkey,
    sum(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS pre_value,
    sum(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS value,
    sum(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-03-15') AS early_value,
    sum(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-05-27') AS late_value,
    count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS orders,
    count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01'
                       AND o_orderdate < TIMESTAMP '1998-01-01' + INTERVAL 180 DAY) AS soon
  FROM orders GROUP BY o_custkey),
units AS (
  SELECT a.*, coalesce(pre_value, 0.0) AS pre_value, coalesce(value, 0.0) AS value,
         coalesce(early_value, 0.0) AS early_value, coalesce(late_value, 0.0) AS late_value,
         coalesce(orders, 0) AS orders, CASE WHEN coalesce(soon, 0) > 0 THEN 1 ELSE 0 END AS converted
  FROM cust_assign a LEFT JOIN order_fold f ON a.unit_id = f.o_custkey)"""

CUST_RATIO = CUST_ASSIGN + """,
ratio_units AS (
  SELECT a.*, coalesce(p.numerator, 0.0) AS numerator, coalesce(p.denominator, 0.0) AS denominator
  FROM cust_assign a LEFT JOIN (
    SELECT o_custkey, sum(l_extendedprice) AS numerator, CAST(count(*) AS DOUBLE) AS denominator
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey) p ON a.unit_id = p.o_custkey)"""

EVENTS = """ev AS (
  SELECT 'exp_' || event_type AS experiment_id, event_id, ts AS event_at, user_id AS unit_id,
         CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, event_type, value
  FROM events),
thin AS (
  SELECT * FROM ev WHERE NOT (arm = 'treatment' AND event_id % 3 = 0 AND event_at >= TIMESTAMP '2024-01-16'))"""

EXPOSED = """first_view AS (
  SELECT user_id AS unit_id, min(ts) AS first_exposure_at FROM events WHERE event_type = 'view' GROUP BY user_id),
event_assign AS (
  SELECT 'first_view' AS experiment_id, unit_id,
         CASE WHEN unit_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, first_exposure_at FROM first_view),
exposed AS (
  SELECT e.user_id AS unit_id, e.ts AS event_at, e.event_id, e.event_type, e.value,
         a.experiment_id, a.arm, a.first_exposure_at
  FROM events e JOIN event_assign a ON e.user_id = a.unit_id AND e.ts >= a.first_exposure_at)"""


def moments(out: str, src: str, keys: str, value: str) -> str:
    return (
        f"{out} AS (SELECT {keys}, arm, count({value}) AS n, avg({value}) AS mean, "
        f"var_samp({value}) AS var, sum({value}) AS total FROM {src} GROUP BY {keys}, arm)"
    )


def pairs(out: str, src: str, keys: str, stats: str = "n mean var total") -> str:
    cols = ", ".join(
        f"c.{s} AS {s}_control, t.{s} AS {s}_treatment" for s in stats.split()
    )
    on = " AND ".join(f"c.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    first = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    return (
        f"{out} AS (SELECT {first}, t.arm, {cols} FROM {src} t LEFT JOIN {src} c "
        f"ON {on} AND c.arm = 'control' WHERE t.arm <> 'control')"
    )


def welch(out: str, src: str, alpha: float = 0.05) -> str:
    """CTEs from a pairs relation to test columns."""
    p = f"""{out}_a AS (SELECT *, mean_treatment - mean_control AS diff,
  sqrt(var_control/n_control + var_treatment/n_treatment) AS se,
  power(var_control/n_control + var_treatment/n_treatment, 2) /
   (power(var_control/n_control, 2)/(n_control-1) + power(var_treatment/n_treatment, 2)/(n_treatment-1)) AS df
  FROM {src}),
{t_crit_ctes(f'{out}_a', f'{out}_c', 1 - alpha / 2)},
{out} AS (SELECT *, diff/se AS t_stat, 2*{t_tail('abs(diff/se)', 'df')} AS p_value,
  diff - crit*se AS ci_lower, diff + crit*se AS ci_upper,
  diff/sqrt(((n_control-1)*var_control + (n_treatment-1)*var_treatment)/(n_control+n_treatment-2)) AS cohens_d,
  diff/abs(mean_control)*100 AS lift_pct
  FROM {out}_c)"""
    return p


def chi_one(x: str) -> str:
    """Chi-square tail with one degree of freedom."""
    return normal_two_sided(f"sqrt({x})")


def srm_label(p: str, threshold: float) -> str:
    return f"CASE WHEN {p} > 0.05 THEN 'PASS' WHEN {p} > {threshold} THEN 'WARNING' ELSE 'BLOCK' END"
