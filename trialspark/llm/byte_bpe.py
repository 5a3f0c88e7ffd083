"""Byte-level BPE by monoid tree reduction."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

LEAF_CHARS = 4096
LEAF_BYTES = 48
LEAF_IDS = 4096
CACHED_PIECES = 1 << 18
CACHED_PAIRS = 1 << 14


class Bpe:
    """Encodes and decodes with a rank table; halves are encoded alone and joined.

    A text is the concatenation of its pattern matches, and each match is
    encoded by itself, so both levels are joined: the matches of two halves, and
    within a long match the tokens of two halves.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    # -- tokens of one match

    def merged(self, piece: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, leftmost first, until none is in the table."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the tokens stay as they are when encoded together."""
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) >= CACHED_PAIRS:
                self.fits.clear()
            self.fits[key] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return self.fits[key]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the concatenation, from the tokens of both sides.

        A window around the boundary is encoded anew and doubled until its first
        and last token fit the tokens outside.  A sequence whose neighbours all
        fit is the encoding of its bytes, so the tokens outside are final then.
        """
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(width, len(right))
            text = b"".join(self.tokens[t] for t in chain(left[i:], right[:j]))
            middle = self.merged(text)
            if (i == 0 or self.adjacent(left[i - 1], middle[0])) and (
                j == len(right) or self.adjacent(middle[-1], right[j])
            ):
                return left[:i] + middle + right[j:]
            width *= 2

    def _tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.merged(piece)
        mid = len(piece) // 2
        return self.joined(self._tree(piece[:mid]), self._tree(piece[mid:]))

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            data = piece.encode()
            found = (self.ranks[data],) if data in self.ranks else tuple(self._tree(data))
            if len(data) <= LEAF_BYTES:
                if len(self.known) >= CACHED_PIECES:
                    self.known.clear()
                self.known[piece] = found
        return found

    # -- matches of a text

    def joined_pieces(self, text: str, left: list[str], mid: int, right: list[str], end: int) -> list[str]:
        """Matches of text[start:end] from those of both sides of ``mid``.

        A match looks two characters past its end and three past its start at
        most, so the left side's matches that stay clear of ``mid`` are final.
        From the last of them on the text is matched anew, until a match starts
        where one of the right side does; from there both go on alike.
        """
        at, keep = mid, len(left)
        while keep and not (at + 2 <= mid and at - len(left[keep - 1]) + 3 <= mid):
            keep -= 1
            at -= len(left[keep])
        fresh, i, start = [], 0, mid
        while at < end:
            while start < at:
                start += len(right[i])
                i += 1
            if at >= mid and start == at:
                break
            piece = self.pattern.match(text, at, end).group()
            fresh.append(piece)
            at += len(piece)
        else:
            i = len(right)
        return left[:keep] + fresh + right[i:]

    def pieces(self, text: str, start: int = 0, end: int | None = None) -> list[str]:
        end = len(text) if end is None else end
        if end - start <= LEAF_CHARS:
            return self.pattern.findall(text, start, end)
        mid = (start + end) // 2
        return self.joined_pieces(text, self.pieces(text, start, mid), mid, self.pieces(text, mid, end), end)

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.piece_ids, self.pieces(text))), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the tokens, concatenated up the same tree of halves."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """The coder of a rank file, once per worker; the file lies on every machine."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return Bpe(ranks, pattern)


def _id_lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int32), *found]))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids (array<int>)`` for every row; null and empty texts have no ids.

    Rows are independent: repeated rows give repeated results, an empty table
    none.  A text of any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            ids = _id_lists([bpe.encode(t or "") for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) to ``doc_id, ids``; null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            data = [None if x is None else bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(data, pa.binary())],
                ["doc_id", "ids", "decoded"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` as ``decode`` of ``encode``, in one worker a task.

    Chained maps would keep two workers a task, each with its own coder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            found = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            data = pa.array([bpe.decode(x.tolist()) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _id_lists(found), data], ["doc_id", "ids", "decoded"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def ids_digest(ids: str | Column = "ids") -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids) if isinstance(ids, str) else ids, ","), 256)


def digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row, and ``ids`` where asked for.

    Null and empty texts have no tokens and the digests of empty text; repeated
    rows give repeated results; an empty table gives none.
    """
    both = round_trip(docs, path, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *(["ids"] if with_ids else []),
    )
