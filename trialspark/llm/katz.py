"""Scoring with a Katz backoff bigram model learned from the corpus.

Documents are packed into blocks of about a million tokens, each with its sorted
vocabulary of word hashes.  A block asks for its distinct n-grams once, not for
every token: it sends them, with its own training counts, to the bucket that
owns them; the bucket sums the counts of all blocks and answers each block.
Every n-gram of the corpus thus crosses the network once per block that has it.
Words are 64-bit hashes until their buckets have numbered them.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import id_text, store, utf8

HELD_OUT, FOLDS = 2, 7
# Counts up to this one are discounted.
DISCOUNTED = 5
BLOCK_TOKENS = 1 << 20
BUCKET_TOKENS = 1 << 21
CACHED_WORDS = 1 << 17
END = np.uint64(xxhash.xxh64_intdigest(b"end", 1))


def pack(x: np.ndarray) -> bytes:
    """An array's bytes, all first bytes before all second ones and so on: high zero bytes cost nothing."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Hashes(dict):
    """Hashes of words, kept for the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


BLOCKS = "block long, n_tokens long, doc_ids array<long>, held array<boolean>, lengths array<int>, vocab binary, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, part, made = _Hashes(), TaskContext.get().partitionId(), 0
    ids, held, texts, size = [], [], [], 0

    def block():
        words = np.concatenate(texts)
        vocab, tokens = np.unique(words, return_inverse=True)
        row = [
            (part << 32) + made, len(words), ids, held, [len(t) for t in texts], pack(vocab),
            pack(tokens.astype(np.uint32)),
        ]
        kinds = [
            pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(),
            pa.binary(),
        ]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "held_out", "data")]
        for doc_id, out, data in zip(*columns):
            words = data.lower().split()  # of bytes: A-Z and ASCII white space only
            hashes = np.empty(len(words) + 1, np.uint64)
            hashes[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            hashes[-1] = END
            ids.append(doc_id)
            held.append(out)
            texts.append(hashes)
            size += len(hashes)
            if size >= BLOCK_TOKENS:
                yield block()
                ids, held, texts, size, made = [], [], [], 0, made + 1
    if texts:
        yield block()


@dataclass
class Block:
    """A block's arrays: token places in the vocabulary, document starts, and which tokens train."""

    vocab: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray
    train: np.ndarray

    @staticmethod
    def of(row: dict) -> Block:
        lengths = np.array(row["lengths"], np.int64)
        return Block(
            unpack(row["vocab"], np.uint64), unpack(row["tokens"], np.uint32), lengths,
            np.repeat(~np.array(row["held"], bool), lengths),
        )

    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (history, word) places as history << 32 | word in order, and each token's place among them.

        A text begins after an end.
        """
        history = np.empty(len(self.tokens), np.uint64)
        history[1:] = self.tokens[:-1]
        history[self.starts()] = np.searchsorted(self.vocab, END)
        return np.unique(history << np.uint64(32) | self.tokens, return_inverse=True)


def bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's keys begin and the last ends; a bucket is a range of sorted hashes."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, edges), len(keys))


ASKED_1 = "bucket int, block long, keys binary, counts binary"


def _ask_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block.of(row)
                counts = np.bincount(b.tokens[b.train], minlength=len(b.vocab)).astype(np.uint32)
                at = bounds(b.vocab, bits)
                some = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some.astype(np.int32)), pa.array([row["block"]] * len(some), pa.int64()),
                        pa.array([pack(b.vocab[at[i] : at[i + 1]]) for i in some], pa.binary()),
                        pa.array([pack(counts[at[i] : at[i + 1]]) for i in some], pa.binary()),
                    ],
                    ["bucket", "block", "keys", "counts"],
                )

    return run


ANSWERS = "ngram int, bucket int, block long, counts binary, histories binary, total long, types long, seen array<long>"


def _answers(order: int, bucket: int, rows: list[tuple], counts: np.ndarray) -> pa.Table:
    """One row per block that asked; the first also carries the bucket's sums."""
    n, kept = len(rows), counts[counts > 0]
    seen = [int((kept == c).sum()) for c in range(1, DISCOUNTED + 2)]
    first = lambda x, other: [x] + [other] * (n - 1)
    names = [c.split()[0] for c in ANSWERS.split(", ")]
    return pa.table(
        [
            pa.array([order] * n, pa.int32()), pa.array([bucket] * n, pa.int32()),
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
            pa.array([r[2] for r in rows], pa.binary()), pa.array(first(int(kept.sum()), 0), pa.int64()),
            pa.array(first(len(kept), 0), pa.int64()), pa.array(first(seen, [0] * len(seen)), pa.list_(pa.int64())),
        ],
        names=names,
    )


def _sum_words(asked: pa.Table) -> pa.Table:
    keys = [unpack(x, np.uint64) for x in asked.column("keys").to_pylist()]
    counts = [unpack(x, np.uint32) for x in asked.column("counts").to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    bucket = asked.column("bucket")[0].as_py()
    rows = []
    for block, k, end in zip(asked.column("block").to_pylist(), keys, ends):
        at = place[end - len(k) : end]  # ascending, as the block's keys are
        rows.append((block, pack(total[at]), pack(np.diff(at, prepend=0))))
    return _answers(1, bucket, rows, total)


@dataclass
class Discounts:
    """Good-Turing discounts of an order, and what all words share at order 1."""

    total: int
    types: int
    ratio: np.ndarray  # by count up to DISCOUNTED; later counts stay

    @staticmethod
    def of(total: int, types: int, seen: list[int]) -> Discounts:
        """Katz's ratios; absolute discounts where the counts of counts give none between 0 and 1."""
        n = [0, *seen]
        ratio = np.ones(DISCOUNTED + 1)
        k = DISCOUNTED
        usable = all(n[1 : k + 2]) and n[1] > (k + 1) * n[k + 1]
        if usable:
            most = (k + 1) * n[k + 1] / n[1]
            for c in range(1, k + 1):
                ratio[c] = ((c + 1) * n[c + 1] / (c * n[c]) - most) / (1 - most)
            usable = bool(((ratio[1:] > 0) & (ratio[1:] < 1)).all())
        if not usable:
            off = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
            ratio[1:] = [(c - off) / c for c in range(1, k + 1)]
        return Discounts(total, types, ratio)

    def reduced(self, counts: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= DISCOUNTED, self.ratio[np.minimum(counts, DISCOUNTED)], 1.0)


@dataclass
class Words:
    """Order 1: discounted shares of the seen words; all unseen words share what is left."""

    discounts: Discounts
    unseen: float
    factor: float

    @staticmethod
    def of(d: Discounts, seen: list[int]) -> Words:
        if not d.total:
            return Words(d, 1.0, 0.0)
        less = sum(n * c * (1 - d.ratio[c]) for c, n in zip(range(1, DISCOUNTED + 1), seen)) / d.total
        unseen = max(less, 1 / (d.total + d.types + 1))
        return Words(d, unseen, (1 - unseen) / (1 - less) if less < 1 else 0.0)

    def p(self, counts: np.ndarray) -> np.ndarray:
        seen = self.factor * self.discounts.reduced(counts) / max(self.discounts.total, 1)
        return np.where(counts > 0, seen, self.unseen)


ASKED_2 = "bucket int, block long, histories binary, sizes binary, words binary, counts binary, word_counts binary"


def _words_of(answers: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and numbers of a block's vocabulary, from its buckets in order.

    A word's number is its place in its bucket, then the bucket: far shorter
    than its hash, and no two words share one.
    """
    rows = sorted((r["bucket"], r["counts"], r["histories"]) for r in answers.to_pylist() if r["ngram"] == 1)
    numbers = [(np.cumsum(unpack(x, np.int64)) << bits) + bucket for bucket, _, x in rows]
    return np.concatenate([unpack(c, np.int64) for _, c, _ in rows]), np.concatenate(numbers)


def _ask_pairs(bits: int):
    names = [c.split()[0] for c in ASKED_2.split(", ")]

    def run(left: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        for row in left.to_pylist():
            b = Block.of(row)
            pairs, inverse = b.pairs()
            counts = np.bincount(inverse[b.train], minlength=len(pairs))
            word_counts, numbers = _words_of(answers, bits)
            history, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            at = bounds(b.vocab[history], bits)
            for i in np.flatnonzero(np.diff(at)).tolist():
                part = slice(at[i], at[i + 1])
                own, sizes = np.unique(history[part], return_counts=True)
                values = (
                    i, row["block"], pack(numbers[own]), pack(sizes), pack(numbers[word[part]]), pack(counts[part]),
                    pack(word_counts[word[part]]),
                )
                for x, v in zip(out, values):
                    x.append(v)
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    return run


HISTORY = np.dtype([("total", "<i8"), ("small", "<i4", DISCOUNTED), ("shares", "<f8")])


def _sum_pairs(order_1: Words):
    return lambda asked: _pair_answers(asked, order_1)


def _pair_answers(asked: pa.Table, order_1: Words) -> pa.Table:
    own, sizes, words, counts, word_counts = (
        [unpack(x, np.int64) for x in asked.column(c).to_pylist()]
        for c in ("histories", "sizes", "words", "counts", "word_counts")
    )
    lengths = [len(w) for w in words]
    histories = np.concatenate([np.repeat(o, s) for o, s in zip(own, sizes)])
    words = np.concatenate(words)
    order = np.lexsort((words, histories))
    h, w = histories[order], words[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
    group = np.cumsum(new) - 1
    place = np.empty(len(h), np.int64)
    place[order] = group
    total = np.bincount(place, np.concatenate(counts), group[-1] + 1).astype(np.int64)
    share = np.zeros(len(total))
    share[place] = order_1.p(np.concatenate(word_counts))
    # What a history's backoff weight needs: its count, its continuations' counts
    # by small count, and the order-1 shares of its continuations.
    distinct, at = np.unique(h[new], return_inverse=True)
    known = np.zeros(len(distinct), HISTORY)
    known["total"] = np.bincount(at, total, len(distinct))
    known["shares"] = np.bincount(at, np.where(total > 0, share, 0), len(distinct))
    for c in range(1, DISCOUNTED + 1):
        known["small"][:, c - 1] = np.bincount(at[total == c], minlength=len(distinct))
    ends = np.cumsum(lengths)
    rows = [
        (block, pack(total[place[end - n : end]]), pack(known[np.searchsorted(distinct, o)]))
        for block, n, end, o in zip(asked.column("block").to_pylist(), lengths, ends, own)
    ]
    return _answers(2, asked.column("bucket")[0].as_py(), rows, total)


@dataclass
class Model:
    """Bigrams over words: discounted where seen, else the history's weight times the word's share."""

    words: Words
    pairs: Discounts

    def seen(self, counts: np.ndarray, history: np.ndarray) -> np.ndarray:
        return self.scale(history) * self.pairs.reduced(counts) / np.maximum(history["total"], 1)

    def left(self, history: np.ndarray) -> np.ndarray:
        c = np.arange(1, DISCOUNTED + 1)
        return (history["small"] * (c * (1 - self.pairs.ratio[1:]))).sum(1) / np.maximum(history["total"], 1)

    def scale(self, history: np.ndarray) -> np.ndarray:
        """Below 1 only for histories whose continuations are all frequent: half a count is set aside."""
        total = history["total"]
        return np.where(self.left(history) > 0, 1.0, total / (total + 0.5))

    def weight(self, history: np.ndarray) -> np.ndarray:
        """What makes a history's probabilities sum to one; 1 for a history never seen."""
        rest = 1 - self.scale(history) * (1 - self.left(history))
        return np.where(history["total"] > 0, rest / np.maximum(1 - history["shares"], 1e-300), 1.0)

    def p(self, pair_counts: np.ndarray, history: np.ndarray, word_counts: np.ndarray) -> np.ndarray:
        return np.where(
            pair_counts > 0, self.seen(pair_counts, history), self.weight(history) * self.words.p(word_counts)
        )


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _score(model: Model, bits: int):
    names = [c.split()[0] for c in SCORES.split(", ")]
    d = model.words.discounts

    def run(left: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        found = sorted((r["bucket"], r["counts"], r["histories"]) for r in answers.to_pylist() if r["ngram"] == 2)
        for row in left.to_pylist():
            b = Block.of(row)
            pairs, inverse = b.pairs()
            word_counts, _ = _words_of(answers, bits)
            counts = np.concatenate([unpack(c, np.int64) for _, c, _ in found])
            own = np.concatenate([unpack(x, HISTORY) for _, _, x in found])
            _, at = np.unique(pairs >> np.uint64(32), return_inverse=True)
            word = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            logs = np.log10(model.p(counts, own[at], word_counts[word]))
            base = np.log10((word_counts + 1) / (d.total + d.types + 1))
            starts, n = b.starts(), len(b.lengths)
            sums = [np.add.reduceat(x, starts) for x in (word_counts[b.tokens] > 0, base[b.tokens], logs[inverse])]
            values = [
                pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.lengths),
                pa.array(sums[0].astype(np.int64)), pa.array(np.full(n, d.total, np.int64)), pa.array(sums[1]),
                pa.array(sums[2]),
            ]
            parts.append(pa.table(values, names=names))
        return pa.concat_tables(parts)

    return run


def _sums(answers: DataFrame) -> tuple[int, int, list[int]]:
    seen = [F.coalesce(F.sum(F.col("seen")[i]), F.lit(0)) for i in range(DISCOUNTED + 1)]
    total, types, *seen = answers.agg(F.sum("total"), F.sum("types"), *seen).first()
    return int(total or 0), int(types or 0), [int(x) for x in seen]


def _let_go(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of stored phases, which nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    The model learns from rows whose crc32(id as text) mod 7 is not 2 (a null id
    counts as empty text).  Null and empty texts are an end alone.  With nothing
    to learn from, every word is unseen and has probability 1.  Repeated rows
    count as often as they stand; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(id_text()) % FOLDS == HELD_OUT).alias("held_out"),
        utf8().alias("data"),
    )
    blocks = store(rows.mapInArrow(_blocks, BLOCKS), "blocks")
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(tokens / BUCKET_TOKENS))
    bits = max(1, math.ceil(math.log2(buckets)))

    asked = blocks.mapInArrow(_ask_words(bits), ASKED_1)
    one = store(asked.groupBy("bucket").applyInArrow(_sum_words, ANSWERS), "words")
    total, types, seen = _sums(one)
    words = Words.of(Discounts.of(total, types, seen), seen)
    del asked
    _let_go(spark)

    by_block = blocks.groupBy("block")
    asked = by_block.cogroup(one.groupBy("block")).applyInArrow(_ask_pairs(bits), ASKED_2)
    two = store(asked.groupBy("bucket").applyInArrow(_sum_pairs(words), ANSWERS), "pairs")
    model = Model(words, Discounts.of(*_sums(two)))
    del asked
    _let_go(spark)
    answers = one.unionByName(two)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_score(model, bits), SCORES)
