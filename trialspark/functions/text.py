"""Text columns: redaction and date-format classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (
    DATE_FORMATS, OTHER_DATE_DIGIT, OTHER_DATE_SEPARATOR, REDACTION_LITERALS, REDACTIONS,
)
from ..session import spread
from .columns import let


def _java(pattern: str, ignore_case: bool) -> str:
    """Same character classes as the pattern's source dialect: Unicode-aware."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


# Letters outside ASCII whose other case is an ASCII letter.
FOLDING_LETTERS = ("\u017f", "\u0131", "\u0130", "\u212a")


def _may_match(text: Column, low: Column, name: str, ignore_case: bool) -> Column:
    """A necessary condition of a pattern: all of one group of literals occur.

    Most texts fail it, and a substring search costs far less than a pattern.
    `low` is the original text in lower case; the keywords of case-insensitive
    patterns cannot come out of an earlier placeholder at a word boundary.
    """
    subject = low if ignore_case else text
    out = F.lit(False)
    for group in REDACTION_LITERALS[name]:
        every = F.lit(True)
        for literal in group:
            every = every & F.contains(subject, F.lit(literal))
        out = out | every
    if ignore_case:
        for letter in FOLDING_LETTERS:
            out = out | F.contains(text, F.lit(letter))
    return out


def redact_text(text: Column) -> Column:
    """Replace secrets and personal data by stable placeholders, in fixed order."""

    def all_stages(base: Column) -> Column:
        def stage(name: str, pattern: str, new: str, fold: bool):
            def apply(r: Column) -> Column:
                replaced = F.regexp_replace(r["t"], F.lit(_java(pattern, fold)), F.lit(new))
                hit = _may_match(r["t"], base["low"], name, fold)
                return F.when(hit, replaced).otherwise(r["t"])

            return apply

        out = base["t"]
        for entry in REDACTIONS:
            out = let({"t": out}, stage(*entry))
        return out

    return let({"t": text, "low": F.lower(text)}, all_stages)


def redact(df: DataFrame, column: str) -> DataFrame:
    """The column redacted in place."""
    return spread(df).withColumn(column, redact_text(F.col(column)))


def redact_with_counts(df: DataFrame, column: str, out: str = "redacted") -> DataFrame:
    """Redacted text plus the number of hits of every pattern, as a struct `hits`.

    Each stage counts on the text that the previous stages left.
    """
    def all_stages(base: Column) -> Column:
        def stage(name: str, pattern: str, new: str, fold: bool):
            def apply(r: Column) -> Column:
                t, rx = r["s"]["t"], F.lit(_java(pattern, fold))
                hit = _may_match(t, base["low"], name, fold)
                count = F.when(hit, F.regexp_count(t, rx)).otherwise(0)
                return F.struct(
                    F.when(hit, F.regexp_replace(t, rx, F.lit(new))).otherwise(t).alias("t"),
                    F.array_append(r["s"]["n"], count).alias("n"),
                )

            return apply

        state = F.struct(base["t"].alias("t"), F.array().cast("array<int>").alias("n"))
        for entry in REDACTIONS:
            state = let({"s": state}, stage(*entry))
        return state

    state = let({"t": F.col(column), "low": F.lower(F.col(column))}, all_stages)
    step = spread(df).withColumn("_s", state)
    hits = F.struct(*[F.col("_s.n")[i].alias(n) for i, (n, *_) in enumerate(REDACTIONS)])
    return step.withColumns({out: F.col("_s.t"), "hits": hits}).drop("_s")


def date_format_of(value: Column) -> Column:
    """The date-format class of a string, most specific first."""
    v = F.trim(value)
    out = None
    for name, pattern in DATE_FORMATS:
        cond = v.rlike(pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    dateish = v.rlike(OTHER_DATE_DIGIT) & v.rlike(OTHER_DATE_SEPARATOR)
    return out.when(dateish, "other").otherwise("not_a_date")
