"""Benchmark passages in documents: Wu-Manber search for many word windows at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import store, utf8

WINDOW_WORDS = 10
# Words of a block: shifts and buckets are looked up by this many words.
BLOCK_WORDS = 2
# Bytes of a text that are split into words at once.
CHUNK = 1 << 20
# Windows in one search table.  A task holds one table of this size; more
# windows are searched table by table, each over all documents.
TABLE_WINDOWS = 1 << 16
# A lookup side is sent to all executors below this many bytes.
BROADCAST_BYTES = 32 << 20

# Everything but 0-9, a-z and bytes of non-ASCII characters parts words; A-Z become a-z.
_FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, chunk by chunk."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + CHUNK, n)
        # A chunk ends where a word does.
        while end < n and _FOLDED[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_FOLDED).split()
        at = end


def words(text: bytes) -> list[bytes]:
    return [w for piece in pieces(text) for w in piece]


Pattern = tuple[bytes, ...]


class Table:
    """Shifts and buckets for windows of one length."""

    def __init__(self, patterns: dict[Pattern, int]):
        self.length = len(next(iter(patterns)))
        self.block = min(BLOCK_WORDS, self.length)
        self.skip = self.length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, number in patterns.items():
            for end in range(self.block, self.length + 1):
                block = self._key(pattern[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.skip), self.length - end)
            self.buckets.setdefault(block, {}).setdefault(pattern[0], []).append((pattern, number))

    @staticmethod
    def _key(block: Pattern):
        return block if len(block) > 1 else block[0]

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """``start, number`` of every occurrence.

        The block that ends at a position tells how far no window can end; where
        it may, only windows with the same last block and first word are compared.
        """
        shift, skip, length = self.shift.get, self.skip, self.length
        at, n = length - 1, len(text)
        while at < n:
            block = (text[at - 1], text[at]) if self.block == 2 else text[at]
            step = shift(block, skip)
            if step:
                at += step
                continue
            first = at - length + 1
            for pattern, number in self.buckets[block].get(text[first], ()):
                if tuple(text[first : at + 1]) == pattern:
                    yield first, number
            at += 1


def tables(patterns: list[tuple[bytes, int]]) -> list[Table]:
    """A table for each length of window; short items have windows of their own length."""
    known: dict[bytes, bytes] = {}
    by_length: dict[int, dict[Pattern, int]] = {}
    for text, number in patterns:
        parts = tuple(known.setdefault(w, w) for w in text.split(b" "))
        by_length.setdefault(len(parts), {})[parts] = number
    return [Table(p) for _, p in sorted(by_length.items())]


def search(text: bytes, found: list[Table]) -> tuple[int, list[tuple[int, int]], list[int]]:
    """Number of words, covered [start, end) ranges of words, and numbers of the windows that occur."""
    carried = max((t.length for t in found), default=1) - 1
    held: list[bytes] = []
    base, total, numbers = 0, 0, set()
    spans: list[tuple[int, int]] = []
    for piece in pieces(text):
        total += len(piece)
        # The last words stay, so that a window may lie across two chunks.
        held += piece
        for t in found:
            for first, number in t.find(held):
                numbers.add(number)
                spans.append((base + first, base + first + t.length))
        spans = union(spans)
        gone = max(0, len(held) - carried)
        base, held = base + gone, held[gone:]
    return total, spans, sorted(numbers)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "doc_id long, digest binary, n_words long, spans array<struct<start: long, end: long>>, numbers array<long>"


def _search(patterns: list[tuple[bytes, int]], all_rows: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tables(patterns)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                total, spans, numbers = search(text, found)
                if all_rows or numbers:
                    marks = [{"start": a, "end": b} for a, b in spans]
                    rows.append((doc_id, hashlib.sha256(text).digest(), total, marks, numbers))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.binary(), pa.int64(), SPANS, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "digest", "n_words", "spans", "numbers"]
            )

    return run


def item_windows(text: bytes, size: int = WINDOW_WORDS) -> list[bytes]:
    """The distinct windows of an item: ``size`` consecutive words, or all if it has fewer."""
    own = words(text)
    return list({b" ".join(own[i : i + size]): None for i in range(max(1, len(own) - size + 1))}) if own else []


def _windows(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                own = item_windows(text, size)
                for at in range(0, len(own), 8192):
                    part = own[at : at + 8192]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], ["item_id", "window"]
                    )

    return run


def windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """``window, number`` of every distinct window, and ``number, item_id`` of the items that have it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), utf8().alias("text"))
    own = store(items.mapInArrow(_windows(size), "item_id string, window binary").distinct(), "item-windows")
    distinct = store(own.select("window").distinct().withColumn("number", F.monotonically_increasing_id()), "windows")
    return distinct, store(own.join(distinct, "window").select("number", "item_id"), "owners")


def lookup_side(stored: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table with ``row_bytes`` a row: broadcast while small, else joined by shuffle."""
    return F.broadcast(stored) if stored.count() * row_bytes <= BROADCAST_BYTES else stored


def occurrences(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``doc_id, n_words, spans, numbers`` for every row: what of ``distinct`` occurs where.

    The windows are dealt by hash to tables of ``TABLE_WINDOWS``; each goes to
    the tasks of one pass over the documents.  With more than one table, the
    finds of the others are few rows keyed by the text's digest, merged and
    joined to the rows of the first pass.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    parts = max(1, math.ceil(distinct.count() / TABLE_WINDOWS))
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts)))

    def one_pass(part: int) -> DataFrame:
        patterns = [(bytes(r.window), r.number) for r in dealt.where(F.col("part") == part).collect()]
        return rows.mapInArrow(_search(patterns, part == 0), FOUND)

    first = one_pass(0)
    if parts == 1:
        return first.drop("digest")
    rest = [store(one_pass(p).drop("doc_id", "n_words").dropDuplicates(["digest"]), "finds") for p in range(1, parts)]
    rest = reduce(DataFrame.unionByName, rest).groupBy("digest").agg(
        F.flatten(F.collect_list("spans")).alias("more"), F.flatten(F.collect_list("numbers")).alias("others")
    )
    joined = first.join(lookup_side(store(rest, "more"), 4096), "digest", "left")
    none = [F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"), F.expr("cast(array() as array<bigint>)")]
    return joined.select(
        "doc_id", "n_words", F.concat("spans", F.coalesce("more", none[0])).alias("spans"),
        F.array_sort(F.concat("numbers", F.coalesce("others", none[1]))).alias("numbers"),
    ).mapInArrow(_merged, "doc_id long, n_words long, spans array<struct<start: long, end: long>>, numbers array<long>")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [union([(s["start"], s["end"]) for s in x]) for x in batch.column("spans").to_pylist()]
        spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], SPANS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), spans, batch.column("numbers")],
            ["doc_id", "n_words", "spans", "numbers"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` for every document row.

    ``spans`` are the ranges of words inside any occurrence of a benchmark
    window, ``n_hit`` the words they cover, ``items`` the sorted ids of the items
    whose windows occur.  Documents with the same windows look their items up
    once.  Null and empty texts have no words, and no item without words occurs
    anywhere; items of fewer than ``size`` words are one window; a null item id
    counts as empty text; repeated items count once; repeated documents are
    searched each; an empty table on either side hits nothing.  Other columns
    play no part.
    """
    distinct, owners = windows(benchmark, size)
    found = store(occurrences(docs, distinct), "occurrences")
    sets = found.where(F.size("numbers") > 0).select("numbers").distinct()
    sets = store(sets.withColumn("set", F.monotonically_increasing_id()), "sets")
    listed = sets.select("set", F.explode("numbers").alias("number")).join(lookup_side(owners, 96), "number")
    listed = listed.select("set", "item_id").distinct().groupBy("set").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    named = store(sets.join(listed, "set").select("numbers", "items"), "named")
    size_of = named.agg(F.sum(F.size("numbers") + F.size("items"))).first()[0] or 0
    named = F.broadcast(named) if 32 * size_of <= BROADCAST_BYTES else named
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.join(named, "numbers", "left").select(
        "doc_id", "n_words", covered.alias("n_hit"), "spans",
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )
