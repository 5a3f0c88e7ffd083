"""Distribution functions as Spark columns.

Everything here stays in the JVM: rational approximations for the normal, and
Gauss-Legendre quadrature folded over a constant node table for Student's t.
They run on reduced frames (one row per experiment x metric x segment x arm),
never on raw rows.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, functions as F

from .columns import div, let

# Published coefficients of the double-precision normal CDF
# (Hart's rational form as given by West, 2005).
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165,
           33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207,
           86.7807322029461, 296.564248779674, 637.333633378831,
           793.826512519948, 440.413735824752)

# Published coefficients of the normal quantile (Acklam); one
# Halley step with the CDF above brings it to double precision.
PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00)


def z_value(p: float) -> float:
    """Normal quantile of a literal probability (plan-time constant)."""
    return NormalDist().inv_cdf(p)


def _horner(x: Column, coefficients) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def _norm_tail(z: Column) -> Column:
    a = F.abs(z)
    gauss = F.exp(-a * a / 2)
    near = gauss * _horner(a, CDF_NUM) / _horner(a, CDF_DEN)
    frac = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = a + F.lit(k) / frac
    far = gauss / frac / F.lit(math.sqrt(2 * math.pi))
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def norm_sf(z: Column) -> Column:
    """P(Z > z)."""
    return let({"z": z}, lambda r: _norm_tail(r["z"]))


def norm_cdf(z: Column) -> Column:
    return norm_sf(-z)


def norm_two_sided(z: Column) -> Column:
    return F.lit(2.0) * norm_sf(F.abs(z))


def norm_ppf(p: Column) -> Column:
    """Normal quantile of a probability column in (0, 1)."""

    def start(r: Column) -> Column:
        p = r["p"]
        low = F.least(p, F.lit(1.0) - p)
        q = F.sqrt(F.lit(-2.0) * F.log(low))
        tail = _horner(q, PPF_C) / _horner(q, PPF_D + (1.0,))
        d = p - F.lit(0.5)
        centre = d * _horner(d * d, PPF_A) / _horner(d * d, PPF_B + (1.0,))
        return F.when(low < 0.02425, F.when(p < 0.5, tail).otherwise(-tail)).otherwise(centre)

    def halley(r: Column) -> Column:
        x = r["x"]
        u = (norm_cdf(x) - r["p"]) * F.lit(math.sqrt(2 * math.pi)) * F.exp(x * x / 2)
        return x - u / (F.lit(1.0) + x * u / 2)

    inside = F.when((p > 0) & (p < 1), p)
    return let({"x": let({"p": inside}, start), "p": inside}, halley)


def chi2_sf(x: Column, df: Column) -> Column:
    """P(chi-square > x) for a whole number of degrees of freedom.

    Finite sums: Poisson terms for even df, normal tail plus odd powers else.
    """

    def body(r: Column) -> Column:
        x, df = r["x"], r["k"]
        half, root = x / 2, F.sqrt(x)

        def total(steps: Column, first: Column, term: Column, ratio) -> Column:
            return F.aggregate(
                F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
                F.struct(first.alias("s"), term.alias("t")),
                lambda acc, j: F.struct(
                    (acc["s"] + acc["t"] * ratio(j)).alias("s"), (acc["t"] * ratio(j)).alias("t")
                ),
                lambda acc: acc["s"],
            )

        even = total((df / 2).cast("int") - 1, F.lit(1.0), F.lit(1.0), lambda j: half / j)
        odd = total(
            ((df - 1) / 2).cast("int"), F.lit(0.0), div(F.lit(1.0), root), lambda j: x / (2 * j - 1)
        )
        density = F.exp(-half) / F.lit(math.sqrt(2 * math.pi))
        return (
            F.when((df < 1) | x.isNull(), F.lit(None).cast("double"))
            .when(x <= 0, F.lit(1.0))
            .when(df == 1, F.lit(2.0) * norm_sf(root))
            .when(df == 2, F.exp(-half))
            .when(df % 2 == 0, F.exp(-half) * even)
            .otherwise(F.lit(2.0) * norm_sf(root) + 2 * density * odd)
        )

    return let({"x": x, "k": df.cast("int")}, body)


@lru_cache(maxsize=None)
def _unit_nodes(panels: int, order: int) -> tuple[tuple[float, float], ...]:
    x, w = np.polynomial.legendre.leggauss(order)
    out = []
    for k in range(panels):
        out += [((k + (xi + 1) / 2) / panels, wi / 2 / panels) for xi, wi in zip(x, w)]
    return tuple((float(a), float(b)) for a, b in out)


def node_table(panels: int = 5, order: int = 20) -> Column:
    """Gauss-Legendre nodes x and weights w on [0, 1] as one folded literal."""
    pairs = ",".join(f"named_struct('x',{a!r}D,'w',{b!r}D)" for a, b in _unit_nodes(panels, order))
    return F.expr(f"array({pairs})")


def quadrature(fn, panels: int = 5, order: int = 20) -> Column:
    """Integral of fn over [0, 1]."""
    return F.aggregate(node_table(panels, order), F.lit(0.0), lambda acc, nd: acc + nd["w"] * fn(nd["x"]))


def gamma_half_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): ten exact steps up, then the asymptotic series."""
    shifted = a + 10
    inv = F.lit(1.0) / shifted
    inv2 = inv * inv
    series = inv * (
        F.lit(-1 / 8) + inv2 * (F.lit(1 / 192) + inv2 * (F.lit(-1 / 640) + inv2 * F.lit(17 / 14336)))
    )
    steps = F.lit(1.0)
    for k in range(10):
        steps = steps * (a + k) / (a + (k + 0.5))
    return F.sqrt(shifted) * F.exp(series) * steps


def _t_scale(df: Column) -> Column:
    """Gamma((df+1)/2) / (sqrt(pi) Gamma(df/2)); computed once per row."""
    return let({"a": df / 2}, lambda r: gamma_half_ratio(r["a"])) / F.lit(math.sqrt(math.pi))


def _t_tail(t: Column, df: Column, scale: Column, panels: int = 5, order: int = 20) -> Column:
    start = F.atan(F.abs(t) / F.sqrt(df))
    stop = F.least(F.lit(math.pi / 2), start + F.lit(14.0) / F.sqrt(df))

    def body(r: Column) -> Column:
        def integrand(s: Column) -> Column:
            def at(v: Column) -> Column:
                log_cos = F.when(v["sine"] < 0.7, F.log1p(-v["sine"] * v["sine"]) / 2).otherwise(
                    F.log(F.sin(F.lit(math.pi / 2) - r["stop"] + v["gap"]))
                )
                return F.exp((r["df"] - 1) * log_cos) * 3 * v["rest"] * v["rest"]

            rest = F.lit(1.0) - s
            gap = r["width"] * rest * rest * rest
            return let({"rest": rest, "gap": gap, "sine": F.sin(r["stop"] - gap)}, at)

        return r["scale"] * r["width"] * quadrature(integrand, panels, order)

    tail = let({"stop": stop, "width": stop - start, "df": df, "scale": scale}, body)
    return F.when(t >= 0, tail).otherwise(F.lit(1.0) - tail)


def t_sf(t: Column, df: Column) -> Column:
    """P(T > t) for Student's t with real df >= 1.

    With t = sqrt(df) tan(theta) the tail is an integral of cos^(df-1); it is
    cut 14 standard deviations out and stretched towards the end point.
    """
    return let(
        {"t": t, "df": df, "c": _t_scale(df)}, lambda r: _t_tail(r["t"], r["df"], r["c"])
    )


def t_two_sided(t: Column, df: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(2.0) * t_sf(F.abs(t), df))


def t_quantile(p: float, df: Column) -> Column:
    """Upper quantile (p > 1/2): Cornish-Fisher start, then Newton on the tail."""
    z = z_value(p)
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384

    def solve(r: Column) -> Column:
        df, scale = r["df"], r["c"]
        start = F.lit(z) + (F.lit(g1) + (F.lit(g2) + F.lit(g3) / df) / df) / df

        def newton(x: Column, _: Column) -> Column:
            density = scale / F.sqrt(df) * F.exp(-(df + 1) / 2 * F.log1p(x * x / df))
            return x + (_t_tail(x, df, scale) - F.lit(1.0 - p)) / density

        rounds = F.when(df < 5, F.lit(14)).when(df < 30, F.lit(5)).otherwise(F.lit(3))
        return F.aggregate(F.sequence(F.lit(1), rounds), start, newton)

    return F.when(df.isNotNull(), let({"df": df, "c": _t_scale(df)}, solve))


# --- posteriors: Beta and Student t, for integrals over one arm ------------------

def stirling_rest(x: Column) -> Column:
    """What Stirling's formula leaves out of ln Gamma(x): ten exact steps up, then the series."""

    def body(r: Column) -> Column:
        x = r["x"]
        steps = F.lit(0.0)
        for k in range(10):
            steps = steps + ((x + (k + 0.5)) * F.log1p(F.lit(1.0) / (x + k)) - 1)
        inv = F.lit(1.0) / (x + 10)
        inv2 = inv * inv
        return steps + inv * (F.lit(1 / 12) + inv2 * (F.lit(-1 / 360) + inv2 * F.lit(1 / 1260)))

    return let({"x": x}, body)


def beta_arm(a: Column, b: Column) -> Column:
    """A Beta(a, b) variable as a struct, in logits around its peak.

    The log odds have a log-concave density at any a, b > 0, without the poles
    that Beta densities have at 0 and 1.
    """
    total = a + b
    rest = stirling_rest(total) - stirling_rest(a) - stirling_rest(b)
    sd = F.sqrt(total / (a * b))
    return F.struct(
        a.alias("a"), b.alias("b"), (a / total).alias("mean"), sd.alias("sd"),
        (F.exp(rest) / (sd * F.lit(math.sqrt(2 * math.pi)))).alias("peak"), F.log(a / b).alias("centre"),
        # Beyond these distances from the peak the density is below 1e-15 of it.
        (9 * sd + F.lit(36.0) / a).alias("reach_down"), (9 * sd + F.lit(36.0) / b).alias("reach_up"),
    )


def _beta_density(arm: Column, d: Column) -> Column:
    """Density of the log odds ``d`` away from the peak."""
    return arm["peak"] * F.exp(arm["a"] * d - (arm["a"] + arm["b"]) * F.log1p(arm["mean"] * F.expm1(d)))


def _beta_value(arm: Column, d: Column) -> Column:
    """The probability at ``d``."""
    return arm["mean"] * F.exp(d) / (F.lit(1.0) + arm["mean"] * F.expm1(d))


def _beta_cdf(arm: Column, d: Column) -> Column:
    """P(log odds < peak + d): the tail beyond d, where the density falls at least at its slope in d."""

    def body(r: Column) -> Column:
        arm, d = r["arm"], r["d"]
        down = d < 0
        slope = F.abs(arm["a"] - (arm["a"] + arm["b"]) * _beta_value(arm, d))
        width = F.least(
            F.when(down, arm["reach_down"]).otherwise(arm["reach_up"]), F.lit(36.0) / F.greatest(slope, F.lit(1e-300))
        )

        def tail(q: Column) -> Column:
            def at(u: Column) -> Column:
                gap = q["width"] * u * u * u
                return _beta_density(q["arm"], q["d"] + F.when(q["d"] < 0, -gap).otherwise(gap)) * 3 * u * u

            return q["width"] * quadrature(at, 2, 20)

        part = let({"arm": arm, "d": d, "width": width}, tail)
        return let({"part": part, "down": down}, lambda p: F.when(p["down"], p["part"]).otherwise(F.lit(1.0) - p["part"]))

    # The logit of 0 and 1 is infinite.
    inside = let({"arm": arm, "d": F.greatest(F.least(d, F.lit(600.0)), F.lit(-600.0))}, body)
    return F.when(d > 600, F.lit(1.0)).when(d < -600, F.lit(0.0)).otherwise(inside)


def _over_beta(arm: Column, fn, panels: int = 4, order: int = 20) -> Column:
    """E[fn(d)] over the log odds of ``arm``, both sides of the peak."""

    def body(r: Column) -> Column:
        arm = r["arm"]

        def at(u: Column) -> Column:
            def inner(v: Column) -> Column:
                # Nodes crowd at the peak; the two sides reach to different ends.
                reach = F.when(v["s"] < 0, -arm["reach_down"]).otherwise(arm["reach_up"])
                d = reach * v["s"] * v["s"]
                jacobian = 4 * F.abs(reach * v["s"])
                return jacobian * let({"d": d}, lambda w: _beta_density(arm, w["d"]) * fn(arm, w["d"]))

            return let({"s": 2 * u - 1}, inner)

        return quadrature(at, panels, order)

    return let({"arm": arm}, body)


def beta_compare(one: Column, other: Column) -> Column:
    """Struct of P(one > other) and E[(one - other)+]; best with the narrower arm first."""

    def body(r: Column) -> Column:
        wide = r["other"]

        def pieces(narrow: Column, d: Column):
            there = narrow["centre"] + d - wide["centre"]

            def values(v: Column) -> Column:
                cdf, x = v["cdf"], v["x"]
                # E[(x - W)+] from the same integral: P(W' < x) of Beta(a + 1, b) is P(W < x) less a density.
                lower = cdf - _beta_density(wide, F.least(F.greatest(v["e"], F.lit(-600.0)), F.lit(600.0))) / wide["a"]
                return F.struct(cdf.alias("p"), (x * cdf - wide["mean"] * lower).alias("g"))

            return let({"cdf": _beta_cdf(wide, there), "x": _beta_value(narrow, d), "e": there}, values)

        return F.struct(
            _over_beta(r["one"], lambda n, d: pieces(n, d)["p"]).alias("p"),
            _over_beta(r["one"], lambda n, d: pieces(n, d)["g"]).alias("gain"),
        )

    return let({"one": one, "other": other}, body)


def beta_ratio_cdf(top: Column, bottom: Column, ratio: Column) -> Column:
    """P(top / bottom < ratio), integrated over the narrower arm."""
    under = bottom["sd"] <= top["sd"]
    arms = F.when(under, F.struct(bottom.alias("n"), top.alias("w"))).otherwise(F.struct(top.alias("n"), bottom.alias("w")))

    def body(r: Column) -> Column:
        def at(narrow: Column, d: Column) -> Column:
            value = _beta_value(narrow, d)
            x = F.when(r["under"], value * r["ratio"]).otherwise(value / r["ratio"])

            def below(v: Column) -> Column:
                x = v["x"]
                place = F.when(x >= 1, F.lit(1e9)).when(x <= 0, F.lit(-1e9)).otherwise(F.log(x) - F.log1p(-x) - r["w"]["centre"])
                return let({"p": place}, lambda q: let({"c": _beta_cdf(r["w"], q["p"])}, lambda c: c["c"]))

            return let({"c": let({"x": x}, below)}, lambda c: F.when(r["under"], c["c"]).otherwise(F.lit(1.0) - c["c"]))

        return _over_beta(r["n"], at)

    return let({"arms": arms, "ratio": ratio, "under": under}, lambda r: let(
        {"n": r["arms"]["n"], "w": r["arms"]["w"], "ratio": r["ratio"], "under": r["under"]}, body
    ))


def t_arm(centre: Column, scale: Column, df: Column) -> Column:
    """A Student t variable with location and scale as a struct."""
    return F.struct(
        centre.alias("mean"), scale.alias("sd"), df.alias("df"), _t_scale(df).alias("norm"),
        F.least(F.lit(math.pi / 2), F.lit(14.0) / F.sqrt(df)).alias("reach"),
    )


def _over_t(arm: Column, fn, panels: int, order: int) -> Column:
    """E[fn(x)] over ``arm``; with x = mean + sd sqrt(df) tan(angle) the density is a power of the cosine."""

    def body(r: Column) -> Column:
        arm = r["arm"]

        def at(u: Column) -> Column:
            def inner(v: Column) -> Column:
                x = arm["mean"] + arm["sd"] * F.sqrt(arm["df"]) * F.tan(v["angle"])
                weight = F.exp((arm["df"] - 1) * F.log(F.greatest(F.cos(v["angle"]), F.lit(1e-300))))
                return weight * let({"x": x}, lambda w: fn(w["x"]))

            return let({"angle": (2 * u - 1) * arm["reach"]}, inner)

        return arm["norm"] * 2 * arm["reach"] * quadrature(at, panels, order)

    return let({"arm": arm}, body)


def _t_cdf(arm: Column, x: Column) -> Column:
    z = (x - arm["mean"]) / arm["sd"]
    tail = let({"t": F.abs(z), "df": arm["df"], "c": arm["norm"]}, lambda r: _t_tail(r["t"], r["df"], r["c"], 2, 20))
    return let({"tail": tail, "z": z}, lambda r: F.when(r["z"] > 0, F.lit(1.0) - r["tail"]).otherwise(r["tail"]))


def t_compare(one: Column, other: Column) -> Column:
    """Struct of P(one > other) and E[(one - other)+]; df of both above 1."""

    def body(r: Column) -> Column:
        wide = r["other"]

        def gain(x: Column) -> Column:
            def values(v: Column) -> Column:
                z, df = v["z"], wide["df"]
                density = wide["norm"] / F.sqrt(df) * F.exp(-(df + 1) / 2 * F.log1p(z * z / df))
                return wide["sd"] * (z * v["cdf"] + density * (df + z * z) / (df - 1))

            return let({"z": (x - wide["mean"]) / wide["sd"], "cdf": _t_cdf(wide, x)}, values)

        return F.struct(
            _over_t(r["one"], lambda x: _t_cdf(wide, x), 4, 20).alias("p"), _over_t(r["one"], gain, 4, 20).alias("gain")
        )

    return let({"one": one, "other": other}, body)


def t_lift_cdf(treatment: Column, control: Column, lift: Column) -> Column:
    """P((treatment - control) / |control| < lift), integrated over control.

    Nodes crowd where control is zero, as a large lift needs a control near it.
    """

    def body(r: Column) -> Column:
        arm = r["c"]
        zero = F.atan(-arm["mean"] / (arm["sd"] * F.sqrt(arm["df"])))
        zero = F.greatest(F.least(zero, arm["reach"]), -arm["reach"])

        def sides(q: Column) -> Column:
            def at(u: Column) -> Column:
                def node(v: Column) -> Column:
                    width = F.when(v["s"] < 0, -(q["zero"] + arm["reach"])).otherwise(arm["reach"] - q["zero"])

                    def value(w: Column) -> Column:
                        weight = F.exp((arm["df"] - 1) * F.log(F.greatest(F.cos(w["angle"]), F.lit(1e-300))))
                        x = arm["mean"] + arm["sd"] * F.sqrt(arm["df"]) * F.tan(w["angle"])
                        return weight * let({"x": x}, lambda k: _t_cdf(r["t"], k["x"] + r["r"] * F.abs(k["x"])))

                    return 4 * F.abs(width * v["s"]) * let({"angle": q["zero"] + width * v["s"] * v["s"]}, value)

                return let({"s": 2 * u - 1}, node)

            return arm["norm"] * quadrature(at, 8, 20)

        return let({"zero": zero}, sides)

    return let({"t": treatment, "c": control, "r": lift}, body)


def solve_cdf(cdf, p: float, start: Column, step: Column, rounds: int = 12) -> Column:
    """x with cdf(x) = p: secant steps on the normal scale, where the curve is nearly straight."""
    target = z_value(p)

    def height(x: Column) -> Column:
        inside = F.least(F.greatest(cdf(x), F.lit(1e-14)), F.lit(1 - 1e-14))
        return let({"p": inside}, lambda r: norm_ppf(r["p"])) - F.lit(target)

    def secant(r: Column) -> Column:
        def one(state: Column, _: Column) -> Column:
            def moved(n: Column) -> Column:
                slope = F.try_divide(n["h"] - n["s"]["h0"], n["s"]["x1"] - n["s"]["x0"])
                move = F.when(n["s"]["h0"].isNull(), r["step"] / 8).otherwise(F.coalesce(F.try_divide(-n["h"], slope), F.lit(0.0)))
                move = F.greatest(F.least(move, 4 * r["step"]), -4 * r["step"])
                return F.struct(n["s"]["x1"].alias("x0"), n["h"].alias("h0"), (n["s"]["x1"] + move).alias("x1"))

            step = let({"s": state, "h": height(state["x1"])}, moved)
            return F.when(F.abs(state["h0"]) < 1e-11, state).otherwise(step)

        nothing = F.lit(None).cast("double")
        first = F.struct(r["start"].alias("x0"), nothing.alias("h0"), r["start"].alias("x1"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, one, lambda s: s["x1"])

    return let({"start": start, "step": step}, secant)
