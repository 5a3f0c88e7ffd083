"""Bayesian tests: conjugate posteriors and integrals over them, as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import LOSS_THRESHOLD
from ..functions import distributions as D
from ..functions.columns import div
from .quantiles import exact_quantiles

C = F.col
SIDES = ("control", "treatment")
NEAR_ZERO = 1e-12


def bayes_decision(
    loss_treatment_rel: Column,
    loss_control_rel: Column,
    prob: Column,
    ship: float = LOSS_THRESHOLD,
    abort: float = LOSS_THRESHOLD,
) -> Column:
    return (
        F.when((loss_treatment_rel < ship) & (prob >= 0.5), "SHIP")
        .when((loss_control_rel < abort) & (prob < 0.5), "ABORT")
        .otherwise("CONTINUE")
    )


# --- over a table of draws: one row per (cell, draw) with columns c and t -----

def probability_to_beat(draws: DataFrame, keys: Sequence[str], c: str = "c", t: str = "t") -> DataFrame:
    return draws.groupBy(*keys).agg(
        F.avg(F.when(C(t) > C(c), 1.0).otherwise(0.0)).alias("prob_treatment_better")
    )


def expected_loss(draws: DataFrame, keys: Sequence[str], c: str = "c", t: str = "t") -> DataFrame:
    """Expected regret of either choice, absolute and relative to |mean c|."""
    return draws_summary(draws, keys, c, t).drop("prob_treatment_better")


def draws_summary(draws: DataFrame, keys: Sequence[str], c: str = "c", t: str = "t") -> DataFrame:
    """Win probability and losses of every cell from one pass over its draws."""
    zero = F.lit(0.0)
    out = draws.groupBy(*keys).agg(
        F.avg(F.when(C(t) > C(c), 1.0).otherwise(0.0)).alias("prob_treatment_better"),
        F.avg(F.greatest(C(c) - C(t), zero)).alias("loss_ship_treatment"),
        F.avg(F.greatest(C(t) - C(c), zero)).alias("loss_ship_control"),
        F.avg(c).alias("_m"),
    )
    scale = F.when(C("_m") == 0, 1.0).otherwise(F.abs("_m"))
    return out.withColumns(
        {
            "loss_ship_treatment_rel": div(C("loss_ship_treatment"), scale),
            "loss_ship_control_rel": div(C("loss_ship_control"), scale),
        }
    ).drop("_m")


def credible_interval(
    draws: DataFrame, keys: Sequence[str], c: str = "c", t: str = "t", mass: float = 0.95
) -> DataFrame:
    """Interval of the relative lift (t - c)/|c|; draws with c near 0 are left out."""
    lift = F.when(F.abs(C(c)) >= NEAR_ZERO, div(C(t) - C(c), F.abs(C(c))))
    tail = round((1 - mass) / 2, 12)
    q = exact_quantiles(draws.withColumn("_lift", lift), keys, "_lift", [tail, 1 - tail])
    return q.select(*keys, C("q")[0].alias("lift_ci_lower"), C("q")[1].alias("lift_ci_upper"))


# --- conjugate posteriors -----------------------------------------------------

def beta_binomial_posterior(
    pairs: DataFrame, prior_alpha: float = 1.0, prior_beta: float = 1.0
) -> DataFrame:
    """Beta posterior of each arm's rate from `total_*` successes of `n_*`."""
    step = pairs
    for side in SIDES:
        s, n = C(f"total_{side}"), C(f"n_{side}")
        step = step.withColumns(
            {f"post_alpha_{side}": s + prior_alpha, f"post_beta_{side}": n - s + prior_beta}
        )
        a, b = C(f"post_alpha_{side}"), C(f"post_beta_{side}")
        step = step.withColumn(f"posterior_mean_{side}", div(a, a + b))
    mc, mt = C("posterior_mean_control"), C("posterior_mean_treatment")
    return step.withColumn("relative_lift", div(mt - mc, F.abs(mc)))


def normal_posterior(pairs: DataFrame, prior_mean: float = 0.0, prior_sd: float = 1e6) -> DataFrame:
    """Normal-inverse-gamma posterior of each arm's mean from n, mean and variance."""
    prec = F.lit(1.0 / prior_sd**2)
    step = pairs
    for side in SIDES:
        n, m = C(f"n_{side}").cast("double"), C(f"mean_{side}")
        ss = (n - 1) * C(f"var_{side}")
        step = step.withColumns(
            {
                f"post_mu_{side}": (prec * prior_mean + n * m) / (prec + n),
                f"post_shape_{side}": 0.5 + n / 2,
                f"post_scale_{side}": 0.5
                + 0.5 * ss
                + 0.5 * (prec * n / (prec + n)) * (m - prior_mean) * (m - prior_mean),
                f"post_precision_{side}": prec + n,
            }
        )
    return step


def _decided(df: DataFrame, compare) -> DataFrame:
    """Win probability, losses and decision from a comparison of the arms `_c` and `_t`.

    The narrower arm carries the integral.  Both losses follow from one of them:
    their difference is the difference of the means.
    """
    mc, mt = C("_c.mean"), C("_t.mean")
    narrow_t = C("_t.sd") <= C("_c.sd")
    ordered = F.when(narrow_t, F.struct(C("_t").alias("a"), C("_c").alias("b"))).otherwise(
        F.struct(C("_c").alias("a"), C("_t").alias("b"))
    )
    out = df.withColumn("_o", ordered).withColumn("_w", compare(C("_o.a"), C("_o.b")))
    gain = C("_w.gain")
    scale = F.when(mc == 0, 1.0).otherwise(F.abs(mc))
    zero = F.lit(0.0)
    out = out.withColumns({
        "prob_treatment_better": F.when(narrow_t, C("_w.p")).otherwise(1 - C("_w.p")),
        "expected_loss_ship_control": F.greatest(F.when(narrow_t, gain).otherwise(gain + mt - mc), zero),
        "expected_loss_ship_treatment": F.greatest(F.when(narrow_t, gain + mc - mt).otherwise(gain), zero),
        "posterior_mean_control": mc, "posterior_mean_treatment": mt, "relative_lift": div(mt - mc, F.abs(mc)),
    }).withColumns({
        "expected_loss_ship_treatment_rel": div(C("expected_loss_ship_treatment"), scale),
        "expected_loss_ship_control_rel": div(C("expected_loss_ship_control"), scale),
    })
    return out.withColumn(
        "decision",
        bayes_decision(
            C("expected_loss_ship_treatment_rel"), C("expected_loss_ship_control_rel"), C("prob_treatment_better")
        ),
    ).drop("_o", "_w", "_c", "_t")


TAIL = 0.025


def beta_binomial_test(pairs: DataFrame, prior_alpha: float = 1.0, prior_beta: float = 1.0) -> DataFrame:
    """Posterior P(T > C), 95% interval of the relative lift, expected losses and decision per cell.

    Everything is an integral over Beta posteriors, as columns: no draws, no
    seed.  Cells with a missing count give NULL statistics.
    """
    post = beta_binomial_posterior(pairs, prior_alpha, prior_beta)
    arms = {
        f"_{side[0]}": D.beta_arm(C(f"post_alpha_{side}").cast("double"), C(f"post_beta_{side}").cast("double")) for side in SIDES
    }
    known = C("post_alpha_control").isNotNull() & C("post_alpha_treatment").isNotNull()
    step = post.withColumns({name: F.when(known, arm) for name, arm in arms.items()})
    # ln(t / c) is nearly normal; sd of ln p is (1 - p) sd of the log odds.
    spread = F.sqrt(sum(((1 - C(f"_{x}.mean")) * C(f"_{x}.sd")) ** 2 for x in "ct"))
    centre = F.log(C("_t.mean") / C("_c.mean"))
    z = D.z_value(1 - TAIL)

    def bound(p: float, side: int) -> Column:
        root = D.solve_cdf(
            lambda x: D.beta_ratio_cdf(C("_t"), C("_c"), F.exp(x)), p, centre + F.lit(side * z) * spread, spread
        )
        return F.when(known, F.expm1(root))

    step = step.withColumns({"lift_ci_lower": bound(TAIL, -1), "lift_ci_upper": bound(1 - TAIL, 1)})
    return _decided(step, D.beta_compare)


def normal_normal_test(pairs: DataFrame, prior_mean: float = 0.0, prior_sd: float = 1e6) -> DataFrame:
    """The same for means, whose posteriors are Student t; arms need two observations each."""
    post = normal_posterior(pairs, prior_mean, prior_sd)
    step = post.where((C("n_control") >= 2) & (C("n_treatment") >= 2))
    step = step.withColumns({
        f"_{side[0]}": D.t_arm(
            C(f"post_mu_{side}"),
            F.sqrt(C(f"post_scale_{side}") / (C(f"post_shape_{side}") * C(f"post_precision_{side}"))),
            2 * C(f"post_shape_{side}"),
        )
        for side in SIDES
    })
    mc, mt = C("_c.mean"), C("_t.mean")
    size = F.greatest(F.abs(mc), F.lit(NEAR_ZERO))
    spread = F.sqrt(C("_t.sd") ** 2 + (mt / size * C("_c.sd")) ** 2) / size
    z = D.z_value(1 - TAIL)
    centre = (mt - mc) / size

    def lift(y: Column) -> Column:
        # With a control mean near zero the lift's tails are very long.
        return centre + spread * F.sinh(y)

    bounds = {
        name: lift(D.solve_cdf(
            lambda y: D.t_lift_cdf(C("_t"), C("_c"), lift(y)), p, F.lit(side * math.asinh(z)), F.lit(0.5)
        ))
        for name, p, side in (("lift_ci_lower", TAIL, -1), ("lift_ci_upper", 1 - TAIL, 1))
    }
    return _decided(step.withColumns(bounds), D.t_compare)
