"""Language identification with string kernels: Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_text

# The model is fitted on this many documents of each language at most (about
# twice as many may be read); landmarks are blocks of the first of them.
TRAIN_PER_LANG = 250
LANDMARKS_PER_LANG = 60
RIDGE = 1e-3
# Texts are cut into blocks of this many bytes, each with its own set of n-grams.
BLOCK = 2048
BLOCKS_AT_ONCE = 64
UNKNOWN = "und"


def codes(data: np.ndarray) -> list[np.ndarray]:
    """The byte 1-, 2- and 3-grams that start at each position, as numbers that do not clash."""
    wide = data.astype(np.int32)
    two = (wide[:-1] << 8) | wide[1:]
    three = (two[:-1] << 8) | wide[2:]
    return [wide, two + (1 << 8), three + (1 << 8) + (1 << 16)]


SPACE = (1 << 8) + (1 << 16) + (1 << 24)


class Grams:
    """The n-grams of the landmarks, and the presence of each in blocks of text."""

    def __init__(self, grams: np.ndarray):
        self.n = len(grams)
        kind = np.uint16 if self.n < 1 << 16 else np.int32
        self.place = np.full(SPACE, self.n, kind)
        self.place[grams] = np.arange(self.n, dtype=kind)

    def presence(self, data: bytes) -> Iterator[np.ndarray]:
        """Normed presence rows (blocks x n-grams), some blocks at a time."""
        step = BLOCK * BLOCKS_AT_ONCE
        for at in range(0, max(len(data), 1), step):
            part = np.frombuffer(data, np.uint8)[at : at + step + 2]
            blocks = -(-min(step, len(data) - at) // BLOCK) or 1
            seen = np.zeros((blocks, self.n + 1), np.float32)
            for grams in codes(part):
                where = np.minimum(np.arange(len(grams)) // BLOCK, blocks - 1)
                seen[where, self.place[grams]] = 1
            seen = seen[:, : self.n]
            yield seen / np.sqrt(np.maximum(seen.sum(1, keepdims=True), 1))

    def mean(self, data: bytes, weights: np.ndarray) -> np.ndarray:
        """The mean over a text's blocks of presence @ weights."""
        total, n = np.zeros(weights.shape[1], np.float32), 0
        for rows in self.presence(data):
            total += (rows @ weights).sum(0)
            n += len(rows)
        return total / n


def normal(text: str) -> bytes:
    return text.lower().encode()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray
    weights: np.ndarray  # n-grams x languages


def _held_out(doc_id: Column) -> Column:
    return F.crc32(id_text(doc_id)) % 3 == 1


def _block_start(name: Column, length: Column) -> Column:
    """Where a landmark's block starts in its text, by a hash apart from the one that picks documents."""
    free = F.greatest(length - BLOCK, F.lit(0)) + 1
    return (F.pmod(F.xxhash64(F.lit("block"), name), free) + 1).cast("int")


def fit(docs: DataFrame) -> Model:
    """One-versus-rest kernel ridge regression on the landmarks' kernel rows.

    Learns from rows with text and lang that are not held out.  A document
    enters by hash of its id; what reaches the driver is one block of each
    landmark document and one kernel row of each training document, so it is
    bounded by the constants above and the number of languages.
    """
    rows = docs.where(~_held_out(F.col("doc_id"))).where("text is not null and lang is not null")
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32))
    draw = F.pmod(F.xxhash64(F.lit("languages"), id_text("doc_id")), F.lit(1 << 32)) / float(1 << 32)
    rates = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, 2 * TRAIN_PER_LANG / counts[lang]))])
    start = _block_start(id_text("doc_id"), F.length("text")).alias("start")
    picked = rows.withColumn("draw", draw).where(F.col("draw") < rates[F.col("lang")]).select("lang", "draw", "text", start)
    heads: dict[str, list] = {}
    for r in picked.select("lang", "draw", F.substring("text", F.col("start"), F.lit(BLOCK)).alias("text")).toLocalIterator():
        if has_letter(r.text):
            heads.setdefault(r.lang, []).append((r.draw, r.text))
    chosen = [x for lang in sorted(heads) for x in sorted(heads[lang])[:LANDMARKS_PER_LANG]]
    if not chosen:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32))
    blocks = [normal(text)[:BLOCK] for _, text in chosen]
    found = np.unique(np.concatenate([x for b in blocks for x in codes(np.frombuffer(b, np.uint8))]))
    grams = Grams(found)
    landmarks = np.concatenate([next(grams.presence(b)) for b in blocks])  # landmarks x n-grams

    last = {lang: sorted(x)[:TRAIN_PER_LANG][-1][0] for lang, x in heads.items()}
    limit = F.create_map(*[F.lit(x) for lang in sorted(last) for x in (lang, last[lang])])
    train = picked.where(F.col("draw") <= limit[F.col("lang")]).select("lang", "text")

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Grams(found)
        for batch in batches:
            k = [known.mean(normal(t), landmarks.T).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(k, pa.list_(pa.float32()))], ["lang", "k"])

    table = train.mapInArrow(kernels, "lang string, k array<float>").toArrow().sort_by("lang")
    k = np.array(table.column("k").to_pylist(), np.float64)
    own = np.array(table.column("lang").to_pylist())
    langs = sorted(set(own.tolist()))
    among = (landmarks @ landmarks.T).astype(np.float64)
    ones = np.where(own[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    share = np.array([1 / np.sum(own == lang) for lang in own])  # languages count alike
    system = (k * share[:, None]).T @ k + RIDGE * among + 1e-8 * np.eye(len(among))
    alpha = np.linalg.solve(system, (k * share[:, None]).T @ ones)
    # The kernel is an inner product of presence rows, so kernel rows times alpha
    # are presence rows times the landmarks' rows times alpha.
    return Model(langs, found, (landmarks.T @ alpha).astype(np.float32))


def predict(text: str | None, model: Model, grams: Grams | None) -> tuple[str, float]:
    """Language and score of a whole text; ``grams`` are the model's, None if it learned nothing."""
    if grams is None or not has_letter(text):
        return UNKNOWN, 0.0
    f = grams.mean(normal(text), model.weights)
    best = int(np.argmax(f))
    return model.langs[best], min(1.0, max(0.0, (float(f[best]) + 1) / 2))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    The whole text is scored, in blocks, by one matrix product for some blocks
    at a time.  A null text or one without letters is ``und`` with score 0; so
    are all texts if there is nothing to learn from.  A null id counts as empty
    text in the hash.  Only ``text`` is an input of a prediction.  Repeated rows
    give repeated results, an empty table gives none.
    """
    model = fit(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(model.grams) if model.langs else None
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                lang, score = predict(text, model, grams)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        F.struct("doc_id").alias("doc"), _held_out(F.col("doc_id")).alias("held_out"), "text"
    )
    kind = rows.schema["doc"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc {kind}, held_out boolean, lang_pred string, score double")
    return out.select("doc.doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents whose predicted language is not ``und``, with all their columns as they were.

    The fitted model scores every whole text, as in ``identify``.  Rejected are
    texts without letters, all texts if there is nothing to learn from, and
    texts that are scored nearest to a class ``und`` that the labels hold.
    """
    model = fit(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(model.grams) if model.langs else None
        for batch in batches:
            known = [predict(t, model, grams)[0] != UNKNOWN for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
