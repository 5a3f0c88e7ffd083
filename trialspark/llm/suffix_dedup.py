"""Exact removal of long repeated strings, of bytes or of words, by sorted suffixes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import store, utf8
from .induced_sort import repeats

LENGTH = 400
# Every string of LENGTH bytes is filed under the ANCHOR bytes in it that have
# the least hash: copies of a string are filed alike.
ANCHOR = 200
# Passages: every word is one code of CODE bytes (of its hash), so that a string
# of codes is a string of words, whatever white space parts them.
PASSAGE_WORDS = 51
ANCHOR_WORDS = 25
CODE = 6
CHUNK = 1 << 20
SEED = 42
# Larger groups are split by the position of the anchor before they are sorted.
GROUP_REGIONS = 4096
# Marks for the texts that a join needs: so many bits a text, in all at most so
# many buckets of bitmap_construct_agg's 32,768 (8 MB), however many texts.
MARK_BITS = 16
MARK_BUCKET = 32768
MARK_BUCKETS = 2048

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(BASE))])),
        np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(pow(BASE, -1, 2**64)))])),
    )


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def anchor_regions(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """``start, place, end`` of runs of string starts [start, end) filed under the anchor at ``place``.

    Of equal hashes in a string the leftmost counts, so the choice depends on
    the string alone.  Long texts go chunk by chunk.
    """
    # Sized by the texts that come, as a worker keeps them through the stages that follow.
    powers, inverse = _powers(1 << max(16, (min(len(data), CHUNK + length) - 1).bit_length()))
    window = length - anchor + 1
    for base in range(0, len(data) - length + 1, CHUNK):
        b = np.frombuffer(data, np.uint8)[base : base + CHUNK + length - 1]
        n = len(b)
        sums = np.zeros(n + 1, U64)
        np.cumsum((b.astype(U64) + U64(1)) * powers[:n], out=sums[1:])
        h = (sums[anchor:] - sums[:-anchor]) * inverse[: n - anchor + 1]
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(32)
        mask = U64((1 << 21) - 1)
        h = (h & ~mask) | np.arange(len(h), dtype=U64)
        starts = n - length + 1
        rows = np.append(h, np.full(-len(h) % window, ~U64(0))).reshape(-1, window)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:starts], ahead[window - 1 : window - 1 + starts])
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate([[0], change])
        place = (least[first] & mask).astype(np.int64)
        yield first + base, place + base, np.append(change, starts) + base


REGIONS = "key long, n long, anchor long, region long, start long, left int, count int"


def _regions(length: int, anchor: int, words: bool):
    names = [c.split()[0] for c in REGIONS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for key, size, data in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "data"))):
                data = coded(data, known) if words else data
                if len(data) < length:
                    continue
                for start, place, end in anchor_regions(data, length, anchor):
                    s, p, e = start.tolist(), place.tolist(), end.tolist()
                    n = len(s)
                    digest = xxhash.xxh64_intdigest
                    anchors = np.fromiter(map(digest, [data[x : x + anchor] for x in p], repeat(SEED)), U64, n)
                    whole = np.fromiter(map(digest, [data[x : y + length - 1] for x, y in zip(s, e)], repeat(SEED)), U64, n)
                    for out, x in zip(parts, (
                        np.full(n, key, np.int64), np.full(n, size, np.int64), anchors.view(np.int64),
                        whole.view(np.int64), start, (place - start).astype(np.int32), (end - start).astype(np.int32),
                    )):
                        out.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], names)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns), ``data`` (UTF-8 bytes), ``key``, ``n``."""
    rows = docs.select(F.struct("*").alias("doc"), utf8().alias("data"))
    return rows.withColumn("key", F.xxhash64("data")).withColumn("n", F.length("data").cast("long"))


def coded(text: bytes, known: dict[bytes, bytes]) -> bytes:
    """A text's words (split at ASCII white space) as codes of equal size."""
    out = []
    for word in text.split():
        code = known.get(word)
        if code is None:
            if len(known) > 1 << 17:
                known.clear()
            code = known[word] = xxhash.xxh64_digest(word, SEED)[:CODE]
        out.append(code)
    return b"".join(out)


def marked(texts: DataFrame, keys: DataFrame, on: str = "key") -> tuple[DataFrame, DataFrame]:
    """The rows of ``texts`` that may have their ``on`` in ``keys``, and all other rows; none of those has it.

    Every row with a key is marked, and few others, so a join has to shuffle
    little more than the rows that it needs.  Only the marks are broadcast, and
    their size is bounded: more keys mark more texts without need.
    """
    bits = min(MARK_BUCKETS, keys.count() * MARK_BITS // MARK_BUCKET + 1) * MARK_BUCKET
    slot = F.pmod(F.xxhash64(on), F.lit(bits))
    bucket, bit = F.floor(slot / F.lit(MARK_BUCKET)).cast("int"), F.pmod(slot, F.lit(MARK_BUCKET))
    marks = keys.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_marks"))
    rows = texts.withColumns({"_bucket": bucket, "_bit": bit.cast("int")})
    rows = rows.join(F.broadcast(store(marks, "marks")), "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(_marks, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, F.col("_bit") % 8) == 1, F.lit(False))
    return rows.where(is_set).select(*texts.columns), rows.where(~is_set).select(*texts.columns)


SUFFIXES = "anchor long, region long, left binary, right binary"


def _suffixes(length: int, anchor: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for data, wanted in zip(batch.column("data").to_pylist(), batch.column("wanted").to_pylist()):
                data = coded(data, known) if words else data
                for w in wanted:
                    place = w["start"] + w["left"]
                    out[0].append(w["anchor"])
                    out[1].append(w["region"])
                    out[2].append(data[w["start"] : place])
                    out[3].append(data[place + anchor : w["start"] + w["count"] - 1 + length])
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds)], ["anchor", "region", "left", "right"]
            )

    return run


RANGES = "anchor long, region long, ranges array<struct<first int, last int>>"
RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("group", "right", "left", "span", "anchor", "region", "base")]
            for group, right, left, span, anchor, region, base in zip(*columns):
                yield group, right, left, span, (anchor, region, base)

    held: list = []

    def flush():
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()),
                pa.array([x[2] for x in held], RANGE),
            ],
            ["anchor", "region", "ranges"],
        )

    for (anchor, region, base), found in repeats(records()):
        held.append((anchor, region, [{"first": a + base, "last": b + base} for a, b in found]))
        if len(held) >= 4096:
            yield flush()
            held.clear()
    yield flush()


def split_groups(rows: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows in groups of ``most`` regions at most, and ranges settled on the way.

    ``rows``: group, span, base, anchor, region, left, right.  A larger group is
    halved by how far left of the anchor a string starts.  All strings of a half
    hold more bytes in common, which join the anchor: regions that differ there
    part.  Equal rows settle each other; one of them stays as partner for the
    rest.  At span 0 all rows of a group are equal, so this ends, and no group
    is ever gathered: each round is a count and a join.
    """
    small, settled = [], []
    while True:
        sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
        large = store(sizes.where(F.col("size") > most), "large")
        if large.isEmpty():
            small.append(rows)
            break
        small.append(store(rows.join(large, "group", "left_anti"), "small"))
        rows = rows.join(large.select("group"), "group")
        alike = ["group", "left", "right"]
        kinds = store(
            rows.groupBy(*alike).agg(
                F.count(F.lit(1)).alias("copies"), F.min(F.struct("anchor", "region", "span", "base")).alias("one")
            ),
            "kinds",
        )
        twice = rows.join(kinds.where("copies > 1").select(*alike), alike, "left_semi")
        settled.append(store(twice.select("anchor", "region", _all_of()), "settled"))
        rows = kinds.select(*alike, "one.*").where("span > 0")
        half = F.expr("span div 2").cast("int")
        near = rows.where(F.length("right") >= F.col("span") - half).select(
            F.xxhash64("group", F.lit("near"), F.expr("substring(right, 1, span - span div 2)")).alias("group"),
            half.alias("span"), "base", "anchor", "region",
            F.expr("substring(left, greatest(length(left) - cast(span div 2 as int), 0) + 1)").alias("left"),
            F.expr("substring(right, cast(span - span div 2 as int) + 1)").alias("right"),
        )
        far = rows.where(F.length("left") > half).select(
            F.xxhash64(
                "group", F.lit("far"), F.expr("substring(left, length(left) - cast(span div 2 as int))")
            ).alias("group"),
            (F.col("span") - half - 1).alias("span"), (F.col("base") + half + 1).cast("int").alias("base"),
            "anchor", "region",
            F.expr("substring(left, 1, length(left) - cast(span div 2 as int) - 1)").alias("left"),
            F.expr("substring(right, 1, cast(span - span div 2 - 1 as int))").alias("right"),
        )
        parts = near.unionByName(far)
        lonely = parts.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("group")
        rows = store(parts.join(lonely, "group", "left_semi"), "parts")
    out = small[0]
    for x in small[1:]:
        out = out.unionByName(x)
    return out, settled


def _all_of():
    first = F.col("base") + F.col("span") - F.length("right")
    last = F.col("base") + F.length("left")
    return F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))).alias("ranges")


def repeated_spans(
    texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most: int | None = None, words: bool = False
) -> DataFrame:
    """``key, n, spans``: for each text with repeated strings of ``length`` bytes, the bytes they cover.

    ``texts`` has ``key, n`` (hash and size of the text) and ``data``; ``spans``
    are [start, end) ranges.  Copies of a text are counted and collapse.
    ``anchor`` bytes file the strings; it is a matter of cost, not of results.
    With ``words``, strings and ranges are of the texts' ``coded`` words.
    """
    texts = texts.select("key", "n", "data")
    regions = store(texts.mapInArrow(_regions(length, anchor, words), REGIONS), "regions")
    # An anchor that occurs once holds no repeated string.
    again = regions.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    again = store(again, "again")  # a table of its own, so that the join can split hot anchors
    columns = ["key", "n", "anchor", "region", "start", "left", "count"]
    places = store(
        marked(regions, again, "anchor")[0].join(again, "anchor", "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")), "places"
    )
    one = F.min(F.struct("key", "n", "start", "left", "count")).alias("one")
    kinds = store(places.groupBy("anchor", "region").agg(F.sum("copies").alias("copies"), one), "kinds")
    # Equal regions settle each other whole.
    equal = kinds.where("copies > 1").select(
        "anchor", "region",
        F.array(F.struct(
            (F.col("one.left") - F.col("one.count") + 1).cast("int").alias("first"),
            F.col("one.left").cast("int").alias("last"),
        )).alias("ranges"),
    )
    # Different regions with one anchor: their suffixes are sorted.
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    mixed = store(mixed, "mixed")
    wanted = kinds.join(mixed, "anchor", "left_semi").select("one.*", "anchor", "region").groupBy("key", "n").agg(
        F.collect_list(F.struct("start", "left", "count", "anchor", "region")).alias("wanted")
    )
    wanted = store(wanted, "wanted")
    found = marked(texts, wanted.select("key"))[0].join(wanted, ["key", "n"]).select("data", "wanted")
    found = found.mapInArrow(_suffixes(length, anchor, words), SUFFIXES).groupBy("anchor", "region").agg(
        F.first("left").alias("left"), F.first("right").alias("right")
    )
    found = store(found, "suffixes").select(
        F.col("anchor").alias("group"), F.lit(length - anchor).alias("span"), F.lit(0).alias("base"),
        "anchor", "region", "left", "right",
    )
    small, settled = split_groups(found, GROUP_REGIONS if most is None else most)
    shards = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = store(small.repartition(shards, "group").mapInArrow(_sorted, RANGES), "ranges")
    for more in [*settled, equal]:
        ranges = ranges.unionByName(more)
    ranges = store(ranges.select("anchor", "region", F.explode("ranges").alias("r")).distinct(), "found")
    place = F.col("start") + F.col("left")
    span = F.struct((place - F.col("r.last")).alias("start"), (place - F.col("r.first") + length).alias("end"))
    spans = places.join(ranges, ["anchor", "region"]).select("key", "n", span.alias("span"))
    spans = spans.groupBy("key", "n").agg(F.collect_set("span").alias("spans"))
    return spans.mapInArrow(_merge, "key long, n long, spans array<struct<start long, end long>>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in merged(x)] for x in batch.column("spans").to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("n"), pa.array(spans, kind)], ["key", "n", "spans"]
        )


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, runs, kept = [], [], []
        for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
            gone = [(x["start"], x["end"]) for x in spans or []]
            edges = [0, *(x for s in gone for x in s), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            removed.append(sum(b - a for a, b in gone))
            runs.append(len(gone))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"), batch.column("n"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                pa.array(kept, pa.binary()),
            ],
            ["doc", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def cut(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc`` (the input's columns), ``n_bytes, n_removed, n_spans, kept`` for every row.

    Removed is each byte covered by a string of ``length`` bytes that also
    starts anywhere else, in this text or another; strings are judged on the
    input.  Null and empty texts, and texts shorter than ``length``, lose
    nothing.  Repeated rows are copies of each other.  An empty table gives no
    rows; columns of any name stay in ``doc``.
    """
    spans = store(repeated_spans(_texts(docs), length, anchor), "spans")
    some, rest = marked(_texts(docs), spans.select("key"))
    rows = some.join(spans, ["key", "n"], "left").select("doc", "n", "data", "spans")
    kind = rows.select("doc").schema
    for name, of in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")):
        kind = kind.add(name, of)
    none = F.lit(0).cast("long")
    whole = rest.select("doc", F.col("n").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("data").alias("kept"))
    return rows.mapInArrow(_cut, kind).unionByName(whole)


def passages(docs: DataFrame, words: int = PASSAGE_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """``key, n, passages``: for each text, the [start, end) ranges of words inside repeated passages.

    A passage is a run of ``words`` words that also starts anywhere else, in this
    text or another, whatever white space parts its words.  Words are compared
    by ``CODE`` bytes of their hashes: runs that differ in one word are taken for
    equal once in 2^48 cases.
    """
    spans = repeated_spans(_texts(docs), words * CODE, anchor * CODE, words=True)
    whole = F.transform("spans", lambda s: F.struct(
        F.ceil(s["start"] / F.lit(CODE)).alias("start"), F.floor(s["end"] / F.lit(CODE)).alias("end")
    ))
    # Codes do not match half-way between words but by chance; such a range is shorter.
    kept = spans.select("key", "n", F.filter(whole, lambda s: s["end"] - s["start"] >= words).alias("passages"))
    return kept.where(F.size("passages") > 0)


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_words(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """A text without the words in ``ranges``, and without the white space after each of them."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    edges = [0, *(starts[w] for r in ranges for w in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for data, ranges in zip(batch.column("data").to_pylist(), batch.column("passages").to_pylist()):
            ranges = [(r["start"], r["end"]) for r in ranges or []]
            texts.append((without_words(data, ranges) if ranges else data).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], ["doc", "kept"])


def cut_passages(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """The documents without their repeated passages of ``words`` words and more, same columns.

    Every occurrence goes, as in ``cut``; cuts lie between words, so no character
    is split.  ``n_chars`` follows the text; null texts stay null; texts of
    fewer words stay as they are.  Repeated rows are copies of each other and
    lose what is long enough in them.  An empty table gives no rows.
    """
    known = store(passages(docs, words), "passages")
    some, rest = marked(_texts(docs), known.select("key"))
    rows = some.join(known, ["key", "n"], "left").select("doc", "data", "passages")
    rows = rows.mapInArrow(_cut_words, rows.select("doc").schema.add("kept", "string"))
    rows = rows.unionByName(rest.select("doc", F.col("doc.text").alias("kept")))
    text = F.when(F.col("doc.text").isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.length(text)}
    return rows.select(*[
        (new[c].cast(docs.schema[c].dataType) if c in new else F.col("doc").getField(c)).alias(c) for c in docs.columns
    ])
