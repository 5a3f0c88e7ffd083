"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def null_double() -> Column:
    return F.lit(None).cast("double")


def null_string() -> Column:
    return F.lit(None).cast("string")


def num(value: str | Column) -> Column:
    """Double with NaN turned into NULL, so NaN never compares as 'largest'."""
    col = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(col), col)


def div(a: Column, b: Column) -> Column:
    """NULL instead of an ANSI error when the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rnd(value: str | Column, digits: int = 6) -> Column:
    """Round for comparison; adding 0.0 folds the negative zero."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def magnitude(abs_effect: Column) -> Column:
    """Conventional small / medium / large bands for standardized effects."""
    return (
        F.when(abs_effect < 0.2, "Negligible")
        .when(abs_effect < 0.5, "Small")
        .when(abs_effect < 0.8, "Medium")
        .when(abs_effect.isNotNull(), "Large")
    )


def lift_percent(diff: Column, base: Column, at_zero: Column | None = None) -> Column:
    """100 * diff / |base|; a zero base gives +inf unless told otherwise."""
    zero = F.lit(float("inf")) if at_zero is None else at_zero
    return F.when(base == 0, zero).otherwise(F.lit(100.0) * div(diff, F.abs(base)))


def join_messages(*parts: Column) -> Column:
    """Array of the non-null messages, in order."""
    return F.array_compact(F.array(*parts))


def let(bindings: dict[str, Column], body) -> Column:
    """Evaluate named columns once and use them many times in one expression.

    Keeps deep formulas small: without it every mention repeats the whole input
    expression, and generated code outgrows a method.
    """
    row = F.struct(*[v.alias(k) for k, v in bindings.items()])
    return F.element_at(F.transform(F.array(row), body), 1)


def canonical_text(texts: Sequence[Column]) -> Column:
    """One text for a row of texts; different rows never share it.

    Each text follows its length, and a missing one is a dash.
    """
    return F.concat(
        *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    )
