"""Exact quantiles by selection: brackets around the wanted ranks, narrowed until few rows are left.

`percentile` keeps every distinct value of a group in one hash map.  Here a
mergeable sketch proposes a bracket for each wanted rank, a counted pass tells
exactly how many rows lie before it, on its ends and inside, and a bracket with
too many rows inside is cut again at splitters of those rows.  Sketches only
propose; the counts decide.  No task sees more than `GATHER_ROWS` values of a
group and rank, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import num
from ..session import attach_one_row, materialize, small_side

SKETCH_ERROR = 1e-4
# Rows of a group that are gathered for one rank; cuts cannot leave fewer than a handful.
GATHER_ROWS = 1 << 16
LEAST_GATHER = 16
# Pieces into which a bracket with more rows is cut.
PIECES = 256
SPLIT_ACCURACY = 10000
BRACKET = (
    "struct<lo: double, hi: double, below: bigint, at_lo: bigint, inside: bigint, at_hi: bigint, "
    "margin: int, wide: boolean, settled: boolean>"
)


def _bracket(**fields: Column | None) -> Column:
    names = [part.split(":")[0].strip() for part in BRACKET[len("struct<") : -1].split(",")]
    given = {k: F.lit(None) if v is None else v for k, v in fields.items()}
    return F.struct(*[given[n].alias(n) for n in names]).cast(BRACKET)


def _whole(n: Column, margin: Column, settled: Column) -> Column:
    """The bracket without ends: everything is inside."""
    zero = F.lit(0)
    return _bracket(
        lo=None, hi=None, below=zero, at_lo=zero, inside=n, at_hi=zero, margin=margin, wide=~settled, settled=settled
    )


def _inside(v: Column, b: Column) -> Column:
    return (b["lo"].isNull() | (v > b["lo"])) & (b["hi"].isNull() | (v < b["hi"]))


def _ranks(n: Column, p: float) -> tuple[Column, Column]:
    pos = (n - 1) * F.lit(p)
    return F.floor(pos), F.ceil(pos)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probs: Sequence[float],
    eps: float = SKETCH_ERROR,
    gather: int | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key: columns keys, `n`, `q` (array by probs).

    Jobs run when this is called: one pass for counts and sketches, one that
    counts around the brackets of groups with more than `gather` rows, and one
    more for each cut of a bracket that still holds more (a cut leaves about a
    hundredth of it).  A bracket that turns out not to hold its rank, which the
    sketch's error rules out, is opened and cut anew.  Groups without values
    give no row; NULL keys are a group.
    """
    probs = [float(p) for p in probs]
    keys = list(keys)
    gather = max(LEAST_GATHER, GATHER_ROWS if gather is None else gather)
    rows = df.select(*keys, num(value).alias("_v")).where(F.col("_v").isNotNull())
    v, n = F.col("_v"), F.col("_n")

    bounds = [x for p in probs for x in (max(0.0, p - 2 * eps), min(1.0, p + 2 * eps))]
    sketch = F.percentile_approx("_v", bounds, int(accuracy or round(1 / eps)))
    first = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_s")).where(n > 0)
    few = n <= gather
    proposed = [
        F.when(few, _whole(n, F.lit(1), F.lit(True))).otherwise(
            _bracket(
                lo=F.col("_s")[2 * i], hi=F.col("_s")[2 * i + 1], below=None, at_lo=None, inside=None, at_hi=None,
                margin=F.lit(1), wide=n * F.lit(4 * eps) > gather, settled=F.lit(False),
            )
        )
        for i in range(len(probs))
    ]
    found = materialize(first.select(*keys, "_n", F.array(*proposed).alias("_b")), "brackets")
    open_ = ~F.forall("_b", lambda b: b["settled"])
    done = [found.where(~open_)]
    todo = found.where(open_)
    while not todo.isEmpty():
        todo = materialize(_counted(rows, todo, keys, probs, gather), "brackets")
        done.append(todo.where(~open_))
        todo = todo.where(open_)
    state = materialize(reduce(DataFrame.unionByName, done), "brackets")
    return _picked(rows, state, keys, probs)


def with_group(
    rows: DataFrame, side: DataFrame, keys: Sequence[str], columns: Sequence[str], how: str = "inner", reduced: bool = True
) -> DataFrame:
    """Each row with columns of its group; NULL is a group like any other."""
    if not keys:
        return attach_one_row(rows, side.select(*columns))
    named = side.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    joined = rows.join(small_side(named, "brackets") if reduced else named, same, how)
    return joined.drop(*[f"_k{i}" for i in range(len(keys))])


def _counted(rows: DataFrame, todo: DataFrame, keys: Sequence[str], probs: Sequence[float], gather: int) -> DataFrame:
    """One pass: exact counts around every open bracket, and what becomes of it."""
    v, n = F.col("_v"), F.col("_n")
    aggs = []
    for i in range(len(probs)):
        b = F.col("_b")[i]
        inside = _inside(v, b)
        aggs += [
            F.count_if(v < b["lo"]).alias(f"_below{i}"), F.count_if(v == b["lo"]).alias(f"_at_lo{i}"),
            F.count_if(inside).alias(f"_inside{i}"),
            # Equal ends: the rows on them count once.
            F.count_if((v == b["hi"]) & (b["lo"].isNull() | (b["lo"] < b["hi"]))).alias(f"_at_hi{i}"),
            # Splitters only of brackets known to hold too many rows.
            F.percentile_approx(
                F.when(inside & b["wide"], v), [j / PIECES for j in range(PIECES + 1)], SPLIT_ACCURACY
            ).alias(f"_cuts{i}"),
        ]
    counts = with_group(rows, todo, keys, ["_n", "_b"]).groupBy(*keys).agg(
        F.any_value("_n").alias("_n"), F.any_value("_b").alias("_b"), *aggs
    )
    after = []
    for i, p in enumerate(probs):
        old = F.col("_b")[i]
        below, at_lo, inside, at_hi, cuts = (F.col(f"_{x}{i}") for x in ("below", "at_lo", "inside", "at_hi", "cuts"))
        low, high = _ranks(n, p)
        holds = (below <= low) & (high < below + at_lo + inside + at_hi)
        on_ends = (high < below + at_lo) | (low >= below + at_lo + inside)
        settled = holds & (on_ends | (inside <= gather))
        kept = _bracket(
            lo=old["lo"], hi=old["hi"], below=below, at_lo=at_lo, inside=inside, at_hi=at_hi,
            margin=old["margin"], wide=~settled, settled=settled,
        )
        # Pieces that hold the two ranks, and `margin` more on either side.
        first = F.floor(F.try_divide((low - below - at_lo) * F.lit(PIECES), inside)) - old["margin"]
        last = F.ceil(F.try_divide((high + 1 - below - at_lo) * F.lit(PIECES), inside)) + old["margin"]
        share = (last - first) / F.lit(float(PIECES))
        # Array places count from 1; an end outside the bracket is the bracket's own.
        cut = _bracket(
            lo=F.when(first < 0, old["lo"]).otherwise(F.try_element_at(cuts, (first + 1).cast("int"))),
            hi=F.when(last > PIECES, old["hi"]).otherwise(F.try_element_at(cuts, (last + 1).cast("int"))),
            below=None, at_lo=None, inside=None, at_hi=None,
            margin=old["margin"], wide=inside * share > gather, settled=F.lit(False),
        )
        after.append(
            F.when(old["settled"], old)
            .when(~holds, _whole(n, old["margin"] * 4, F.lit(False)))
            .when(settled | cuts.isNull(), kept)
            .otherwise(cut)
        )
    return counts.select(*keys, "_n", F.array(*after).alias("_b"))


def _picked(rows: DataFrame, state: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The values at the ranks: ends of brackets, or the few rows inside them."""
    v, n = F.col("_v"), F.col("_n")
    wanted = []
    for i, p in enumerate(probs):
        b = F.col("_b")[i]
        low, high = _ranks(n, p)
        first = b["below"] + b["at_lo"]
        wanted.append(F.when(_inside(v, b) & (high >= first) & (low < first + b["inside"]), F.lit(i)))
    near = with_group(rows, state, keys, ["_n", "_b"]).select(
        *keys, "_n", "_b", "_v", F.explode(F.array_compact(F.array(*wanted))).alias("_i")
    )
    counted = near.groupBy(*keys, "_i", "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.any_value("_n").alias("_n"), F.any_value("_b").alias("_b")
    )
    order = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.element_at("_b", F.col("_i") + 1)
    ranked = counted.withColumn("_to", own["below"] + own["at_lo"] + F.sum("_c").over(order))
    picks = []
    for i, p in enumerate(probs):
        for name, rank in zip("az", _ranks(n, p)):
            here = (F.col("_i") == i) & (F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to"))
            picks.append(F.max(F.when(here, v)).alias(f"_{name}{i}"))
    inner = ranked.groupBy(*keys).agg(*picks)
    names = [f"_{x}{i}" for i in range(len(probs)) for x in "az"]
    whole = with_group(state, inner, keys, names, "left", reduced=False)
    parts = []
    for i, p in enumerate(probs):
        b = F.col("_b")[i]
        first = b["below"] + b["at_lo"]
        a, z = (
            F.when(rank < first, b["lo"]).when(rank >= first + b["inside"], b["hi"]).otherwise(F.col(f"_{x}{i}"))
            for x, rank in zip("az", _ranks(n, p))
        )
        pos = (n - 1) * F.lit(p)
        # Equal neighbours are the value itself, also where it is infinite.
        parts.append(F.when(a == z, a).otherwise(a + (z - a) * (pos - F.floor(pos))))
    return whole.select(*keys, n.alias("n"), F.array(*parts).alias("q"))


def attach_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str
) -> DataFrame:
    """Every row with its group's quantile array."""
    q = exact_quantiles(df, keys, value, probs)
    return with_group(df, q.withColumnRenamed("q", name), keys, [name], "left")
