"""Event logs, lifecycles and configuration versions as tables.

A log entry stores its position (`seq`, dense per experiment), so the previous
entry is an equi-join on (experiment, position).  One experiment may own most
of the log and still spreads over all tasks.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import canonical_text
from ..fixed_values import (
    ADMIN_HEADS, ADMIN_LEAVES, BACKWARD_TRANSITIONS, FORWARD_TRANSITIONS, GENESIS,
    LIFECYCLE_STATES, MATERIAL_HEADS, STATUS_RANK,
)

C = F.col


def canonical(columns: Sequence[str]) -> Column:
    """The text an entry's hash covers: a lone column as it stands, several with their lengths."""
    if len(columns) == 1:
        return F.coalesce(C(columns[0]).cast("string"), F.lit(""))
    return canonical_text([C(c).cast("string") for c in columns])


def with_previous(df: DataFrame, key: str, seq: str, carry: dict[str, Column]) -> DataFrame:
    """Each entry with values of the entry one position before it (NULL for the first)."""
    previous = df.select(
        C(key).alias("_pk"),
        (C(seq) + 1).alias("_ps"),
        *[v.alias(n) for n, v in carry.items()],
        F.lit(True).alias("has_previous"),
    )
    return df.join(
        previous, (C(key) == C("_pk")) & (C(seq) == C("_ps")), "left"
    ).drop("_pk", "_ps")


def chain_links(
    df: DataFrame, key: str, seq: str, prev_hash: str, payload: Sequence[str]
) -> DataFrame:
    """Per entry: does its stored hash equal the hash of the entry before it?"""
    linked = with_previous(df, key, seq, {"_expected": F.sha2(canonical(payload), 256)})
    expected = F.coalesce(C("_expected"), F.lit(GENESIS))
    return linked.withColumn("link_ok", C(prev_hash).eqNullSafe(expected)).drop("_expected")


def chain_check(
    df: DataFrame, key: str, seq: str, prev_hash: str, payload: Sequence[str]
) -> DataFrame:
    """First break of every log; NULL when the chain holds."""
    return (
        chain_links(df, key, seq, prev_hash, payload)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n_entries"),
            F.count(F.when(~C("link_ok"), 1)).alias("n_breaks"),
            F.min(F.when(~C("link_ok"), C(seq))).alias("first_break"),
        )
        .withColumn("chain_ok", C("n_breaks") == 0)
    )


def catalog_index(
    df: DataFrame, key: str, status: str, kind: str, at: str, order: Sequence[str]
) -> DataFrame:
    """Per experiment: number of renders, worst status, latest type and time.

    `status` may be NULL for experiments without a completed render.
    """
    rank = F.lit(None).cast("int")
    label = F.lit("UNVERIFIABLE")
    for name, r in STATUS_RANK.items():
        rank = F.when(C(status) == name, r).otherwise(rank)
        label = F.when(C("_worst") == r, name).otherwise(label)
    done = C(status).isNotNull()
    latest = F.when(done, F.struct(*[C(c) for c in order]))
    return (
        df.groupBy(key)
        .agg(
            F.count(F.when(done, 1)).alias("n_renders"),
            F.max(rank).alias("_worst"),
            F.max_by(F.struct(C(kind).alias("kind"), C(at).alias("at")), latest).alias("_l"),
        )
        .select(
            key, "n_renders", label.alias("worst_status"),
            C("_l.kind").alias("latest_type"), C("_l.at").alias("latest_at"),
        )
    )


def _pairs(table: dict[str, list[str]]) -> list[str]:
    return [f"{a}>{b}" for a, targets in table.items() for b in targets]


def transition_class(before: Column, after: Column) -> Column:
    """same, forward, backward, illegal or unknown_state."""
    step = F.concat(before, F.lit(">"), after)
    known = before.isin(LIFECYCLE_STATES) & after.isin(LIFECYCLE_STATES)
    return (
        F.when(before.isNull(), "first")
        .when(before == after, "same")
        .when(~known, "unknown_state")
        .when(step.isin(_pairs(BACKWARD_TRANSITIONS)), "backward")
        .when(step.isin(_pairs(FORWARD_TRANSITIONS)), "forward")
        .otherwise("illegal")
    )


def lifecycle_check(
    df: DataFrame, key: str, seq: str, status: str, reason: str
) -> DataFrame:
    """Every status change judged; a backward one needs a reason."""
    linked = with_previous(df, key, seq, {"previous_status": C(status)})
    out = linked.withColumn("transition", transition_class(C("previous_status"), C(status)))
    needs = C("transition") == "backward"
    has_reason = F.coalesce(F.length(F.trim(C(reason))) > 0, F.lit(False))
    return out.withColumns(
        {
            "allowed": C("transition").isin("first", "same", "forward") | (needs & has_reason),
            "problem": F.when(C("transition") == "illegal", "illegal_transition")
            .when(C("transition") == "unknown_state", "unknown_state")
            .when(needs & ~has_reason, "missing_reason"),
        }
    ).drop("has_previous")


def log_diff(
    a: DataFrame, b: DataFrame, keys: Sequence[str], seq: str, message: str
) -> DataFrame:
    """Two logs compared position by position; equal entries are not listed."""
    left = a.select(*keys, seq, C(message).alias("message_a"), F.lit(True).alias("_a"))
    right = b.select(*keys, seq, C(message).alias("message_b"), F.lit(True).alias("_b"))
    kind = (
        F.when(C("_a").isNull(), "only_in_b")
        .when(C("_b").isNull(), "only_in_a")
        .when(~C("message_a").eqNullSafe(C("message_b")), "changed")
    )
    return (
        left.join(right, [*keys, seq], "full")
        .withColumn("kind", kind)
        .where(C("kind").isNotNull())
        .drop("_a", "_b")
    )


# --- configuration versions -----------------------------------------------------

def classify_path(path: Column) -> Column:
    """material if a change of this path can alter the decision, else administrative."""
    bare = F.regexp_replace(path, r"^experiment\.", "")
    head = F.regexp_extract(bare, r"^([^.\[]*)", 1)
    leaf = F.regexp_extract(
        F.regexp_replace(bare, r"(\[[^\]]*\])+$", ""), r"([^.]*)$", 1
    )
    return (
        F.when(head.isin(ADMIN_HEADS), "administrative")
        .when(leaf.isin(ADMIN_LEAVES), "administrative")
        .when(head.isin(MATERIAL_HEADS), "material")
        .otherwise("administrative")
    )


def config_diff(
    before: DataFrame, after: DataFrame, keys: Sequence[str], path: str = "path", value: str = "value"
) -> DataFrame:
    """added, removed and changed paths between two flattened versions."""
    left = before.select(*keys, path, C(value).alias("before"), F.lit(True).alias("_b"))
    right = after.select(*keys, path, C(value).alias("after"), F.lit(True).alias("_a"))
    op = (
        F.when(C("_b").isNull(), "added")
        .when(C("_a").isNull(), "removed")
        .when(~C("before").eqNullSafe(C("after")), "changed")
    )
    return (
        left.join(right, [*keys, path], "full")
        .withColumn("op", op)
        .where(C("op").isNotNull())
        .drop("_a", "_b")
        .withColumn("change_class", classify_path(C(path)))
    )


def flatten_config(df: DataFrame, keys: Sequence[str], config: str) -> DataFrame:
    """A MAP<STRING,STRING> or JSON configuration as (path, value) rows.

    JSON nests to any depth: `a.b` is a member, `a[0]` an item; an empty object
    or list is a row of its own, and text that is not JSON gives no rows.
    """
    if dict(df.dtypes)[config].startswith("map"):
        return df.select(*keys, F.explode(config).alias("path", "value"))
    flat = F.udf(_leaves, "array<struct<path:string,value:string>>", useArrow=True)
    return df.select(*keys, F.inline(flat(C(config))))


def _leaves(text: str | None) -> list[dict] | None:
    """Leaves of one configuration in order; numbers as they are written."""
    if text is None:
        return None
    try:
        todo = [("", json.loads(text, parse_float=str, parse_int=str, parse_constant=str))]
    except ValueError:
        return None
    out = []
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict) and x:
            todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(x.items())]
        elif isinstance(x, list) and x:
            todo += [(f"{path}[{i}]", x[i]) for i in reversed(range(len(x)))]
        else:
            value = x if x is None or isinstance(x, str) else json.dumps(x)
            out.append({"path": path, "value": value})
    return out


def amendments(
    df: DataFrame, keys: Sequence[str], ts: str, change_class: str = "change_class", material_only: bool = False
) -> DataFrame:
    """Amendments in insertion order, optionally only the material ones."""
    out = df.where(C(change_class) == "material") if material_only else df
    return out.orderBy(*keys, ts)


def experiment_state(df: DataFrame, key: str, artifact: str) -> DataFrame:
    """In-flight state of every experiment from the artifacts it has.

    Artifact names: report, analysis, sealed_brief, brief, hypothesis.
    """

    def has(name: str) -> Column:
        return F.coalesce(F.bool_or(C(artifact) == name), F.lit(False)).alias(f"_{name}")

    names = ["report", "analysis", "sealed_brief", "brief", "hypothesis"]
    flags = df.groupBy(key).agg(*[has(n) for n in names])
    state = (
        F.when(C("_report"), "complete")
        .when(C("_sealed_brief") & C("_analysis"), "analysis_in_progress")
        .when(C("_sealed_brief"), "brief_sealed")
        .when(C("_brief"), "brief_drafted")
        .when(C("_hypothesis"), "hypothesis_drafted")
        .otherwise("intent_only")
    )
    return flags.select(key, state.alias("state"))
