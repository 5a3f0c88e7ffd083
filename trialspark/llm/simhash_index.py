"""Near-duplicates by SimHash fingerprints in a multi-index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import lookup, store, utf8
from .components import components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
BITS = 64
SEGMENT_BITS = 32
CHUNK = 1 << 15


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        shingles = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = SHINGLE_WORDS - 1
        shingles = [line[s:e] for s, e in zip(starts[: len(words) - last].tolist(), ends[last:].tolist())]
    n = len(shingles)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([fingerprint(x) for x in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for every row; null and empty texts have fingerprint 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _ball(fp: Column) -> list[Column]:
    """Every point of the radius-1 ball in each of the two segments; the other segment completes the key."""
    points = [fp]
    for segment in range(BITS // SEGMENT_BITS):
        for bit in range(SEGMENT_BITS):
            flip = 1 << (segment * SEGMENT_BITS + bit)
            points.append(fp.bitwiseXOR(F.lit(flip - (1 << BITS) if flip >> (BITS - 1) else flip)))
    return points


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between different fingerprints that keep every class whole.

    Each fingerprint is posted under the points of a radius-1 ball in each of
    its segments.  Two fingerprints at most two bits apart share an entry: with
    both bits in one segment, one flip each meets half-way in that segment's
    index; with one bit in each, the flip of either in its own segment is the
    same full key, so both indexes are one table.  An entry holds 65
    fingerprints at most, whatever the data, so no hot bucket arises.  Entries
    are matched in order, and the full distance of each match is verified.
    """
    posted = distinct.select("fp", F.explode(F.array(*_ball(F.col("fp")))).alias("point"))
    before = F.lag("fp").over(Window.partitionBy("point").orderBy("fp"))
    matched = posted.select(F.col("fp").alias("a"), before.alias("b")).where("b is not null")
    # Neighbours in an entry may be two flips from its point: at most two bits apart.
    return matched.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id, root`` for every row of ``docs``.

    Exact copies collapse to one fingerprint before any search, so a group of
    copies costs one entry.  ``component_id`` is the smallest doc_id of the
    class; rows without an id never name a class, and a class of such rows only
    has a null one.  ``root`` is a fingerprint that tells apart classes of one
    component_id, as rows of one id may lie in several.  Repeated rows give repeated rows; an empty table gives none.
    """
    rows = store(fingerprints(docs), "fingerprints")
    groups = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "groups")
    roots = components(links(groups))
    linked = roots.join(groups, roots.node == groups.fp).select("fp", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = linked.join(least, "root").select("fp", "root", "least_id")
    named = groups.join(linked, "fp", "left").select(
        "fp", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root")
    )
    return rows.join(store(named, "classes"), "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: one with the smallest doc_id.

    Rows of one id but other texts count each in its own class, so an id that
    stands in several rows is told apart by fingerprint.  Of a class without ids
    one row stays.
    """
    return keep_first(docs, store(classes(docs), "known"), _with_prints)


def keep_first(docs: DataFrame, known: DataFrame, with_prints: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``keep_one`` for stored classes ``known`` whose ``fp`` is what ``with_prints`` adds to rows as ``_fp``."""
    first = known.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("first"))
    kept = store(first.select(F.col("first.doc_id").alias("_kept"), F.col("first.fp").alias("_fp")), "kept")
    again = known.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    again = lookup(store(again.select(F.col("doc_id").alias("_kept")), "again"))
    once = lookup(store(kept.join(again, "_kept", "left_anti").select("_kept"), "once"))
    parts = [docs.join(once, F.col("doc_id") == F.col("_kept"), "left_semi")]
    several = store(kept.join(again, "_kept", "left_semi"), "several")
    if not several.isEmpty():
        ids = lookup(store(several.select("_kept").distinct(), "several-ids"))
        rows = with_prints(docs.join(ids, F.col("doc_id") == F.col("_kept"), "left_semi"))
        rows = rows.withColumn("_kept", F.col("_doc.doc_id").cast("long")).join(lookup(several), ["_kept", "_fp"], "left_semi")
        parts.append(rows.dropDuplicates(["_kept", "_fp"]).select("_doc.*"))
    # Rows of classes in which no row has an id: one per class stands for them.
    nameless = known.where("component_id is null").groupBy("root").agg(F.min("fp").alias("_fp")).select("_fp")
    if not nameless.isEmpty():
        alone = with_prints(docs.where("doc_id is null").dropDuplicates(["text"])).join(nameless, "_fp", "left_semi")
        parts.append(alone.dropDuplicates(["_fp"]).select("_doc.*"))
    return reduce(DataFrame.unionByName, parts)


def _with_prints(docs: DataFrame) -> DataFrame:
    """``_doc, _fp``: every row and its fingerprint."""
    marked = docs.select(F.struct("*").alias("_doc"), utf8().alias("text"))
    return marked.mapInArrow(_marked, marked.select("_doc").schema.add("_fp", "long"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([fingerprint(x) for x in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), prints], ["_doc", "_fp"])
