"""Sorting of suffixes around shared anchors: a disk-backed queue and leftward induction.

A group holds regions of text that share one anchor.  Every string of interest
has the anchor inside it: some bytes of the region's left part, the anchor, and
some of its right part, ``span`` bytes of both together.  The suffixes that
start at the anchors are the seeds; a disk-backed priority queue brings them in
order with the common prefixes of neighbours.  From the order of the suffixes
``o`` bytes left of the anchors, that of the suffixes one byte further left is
induced by their first byte, and common prefixes are carried along as range
minima.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

# Bytes of records that a queue holds before it writes a sorted run, and records
# that are induced at once (whole groups only, so a group has to fit in memory).
QUEUE_BYTES = 64 << 20
BLOCK_RECORDS = 8192
RUN_RECORDS = 256

Record = tuple[int, bytes, bytes, int, object]  # group, right, left, span, name


class DiskQueue:
    """A priority queue of records far larger than memory: sorted runs on disk, merged when read."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.limit, self.size, self.held, self.runs = limit, 0, [], []

    def push(self, record: Record) -> None:
        self.held.append(record)
        self.size += 200 + len(record[1]) + len(record[2])
        if self.size >= self.limit:
            self._spill()

    def _spill(self) -> None:
        self.held.sort(key=_order)
        run = tempfile.TemporaryFile(prefix="suffixes-")
        for at in range(0, len(self.held), RUN_RECORDS):
            pickle.dump(self.held[at : at + RUN_RECORDS], run, protocol=5)
        self.runs.append(run)
        self.held, self.size = [], 0

    @staticmethod
    def _read(run) -> Iterator[Record]:
        run.seek(0)
        while True:
            try:
                yield from pickle.load(run)
            except EOFError:
                run.close()  # the file is nameless and goes with its handle
                return

    def drain(self) -> Iterator[Record]:
        """All records in order; the queue is empty then."""
        self.held.sort(key=_order)
        parts, self.held, runs, self.runs = [iter(self.held)], [], self.runs, []
        return heapq.merge(*parts, *(self._read(r) for r in runs), key=_order)


def _order(record: Record) -> tuple[int, bytes]:
    return record[0], record[1]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def induce(block: list[Record]) -> np.ndarray:
    """For records in seed order: whether the string ``o`` bytes left of the anchor is repeated.

    Rows are records, columns are ``o``.  A string is repeated if a neighbour in
    the order shares all of it: ``o`` bytes left, the anchor, the rest right.
    """
    n = len(block)
    spans = np.array([r[3] for r in block])
    group = np.cumsum([0] + [int(a[0] != b[0]) for a, b in zip(block, block[1:])])
    lengths = np.array([len(r[2]) for r in block])
    width = int(spans.max(initial=0))
    back = np.zeros((n, width), np.uint8)  # left parts, read from the anchor outwards
    for i, r in enumerate(block):
        back[i, : lengths[i]] = np.frombuffer(r[2][::-1], np.uint8)
    repeated = np.zeros((n, width + 1), bool)
    # Common bytes right of the anchor with the record before; -1 at the start of a group.
    carried = np.array(
        [-1] + [common_prefix(a[1], b[1]) if a[0] == b[0] else -1 for a, b in zip(block, block[1:])], np.int32
    )
    order = np.arange(n)
    for o in range(width + 1):
        full = np.flatnonzero(carried[1:] >= spans[order[1:]] - o) + 1 if len(order) > 1 else np.empty(0, int)
        full = full[carried[full] >= 0]
        repeated[order[full], o] = True
        repeated[order[full - 1], o] = True
        if o == width:
            break
        stay = np.flatnonzero(lengths[order] > o)
        if not len(stay):
            break
        key = group[order[stay]] * 256 + back[order[stay], o]
        place = stay[np.argsort(key, kind="stable")]  # old places in the new order
        same = np.diff(np.sort(key, kind="stable")) == 0
        fresh = np.full(len(place), -1, np.int32)
        if same.any():
            after = np.flatnonzero(same) + 1
            lo, hi = place[after - 1] + 1, place[after] + 1
            bounds = np.stack([lo, hi], 1).ravel()
            fresh[after] = np.minimum.reduceat(np.append(carried, -1), bounds)[::2]
        order, carried = order[place], fresh
    return repeated


def repeats(records: Iterable[Record], limit: int = QUEUE_BYTES) -> Iterator[tuple[object, list[tuple[int, int]]]]:
    """``name, [(first o, last o), ...]`` for each record with repeated strings."""
    queue = DiskQueue(limit)
    for r in records:
        queue.push(r)
    block: list[Record] = []
    for r in queue.drain():
        if len(block) >= BLOCK_RECORDS and r[0] != block[-1][0]:
            yield from _ranges(block)
            block = []
        block.append(r)
    if block:
        yield from _ranges(block)


def _ranges(block: list[Record]) -> Iterator[tuple[object, list[tuple[int, int]]]]:
    found = induce(block)
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    for i in np.flatnonzero(found.any(1)).tolist():
        starts, ends = np.flatnonzero(edges[i] > 0), np.flatnonzero(edges[i] < 0) - 1
        yield block[i][4], list(zip(starts.tolist(), ends.tolist()))
