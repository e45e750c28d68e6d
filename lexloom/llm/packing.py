"""Packing of tokenized documents into training windows.

Each document is cut: whole windows stand alone, and what remains is cut to
pieces of at most a quarter of a window. Pieces gather until they fill a group of
windows but for a small margin; the piece that would overrun is cut there and
its rest opens the next group. Karmarkar-Karp differencing then divides the
group: every partial partition is a row of window sums, the two with the widest
spread are merged largest against smallest, until one is left. If any window is
over capacity the window count rises by one and the differencing repeats.

Work is per input partition, without any shuffle, and holds one group at a
time. A null text counts as empty (its end id remains), a null doc_id is kept,
repeated rows are packed each for itself, an empty table gives no row and other
columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, tokens

CAPACITY = 1024
#: Windows of a full group, ids left free in each on average, longest piece.
WAYS = 64
MARGIN = 8
PIECE = 256

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
)
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


_SUM = itemgetter(0)


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Divide the items into so many sets of near-equal sum; returns item indexes."""
    # A row lists its sets that hold items, largest first; the others have a sum of 0.
    heap = [(-size, k, [(size, k)]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        left, right = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        right.reverse()
        both = len(left) + len(right) - ways
        if both > 0:
            apart = len(left) - both
            merged = left[:apart]
            merged += [(a + b, (t, u)) for (a, t), (b, u) in zip(left[apart:], right)]
            merged += right[both:]
        else:
            merged = left + right
        merged.sort(key=_SUM, reverse=True)
        turn += 1
        least = merged[-1][0] if len(merged) == ways else 0
        heapq.heappush(heap, (least - merged[0][0], turn, merged))
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            elif node is not None:
                items.append(node)
        out.append(sorted(items))
    return out + [[] for _ in range(ways - len(out))] if out else out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few near-equal windows as differencing manages within the capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        found = [w for w in differencing(sizes, ways) if w]
        if all(sum(sizes[k] for k in w) <= capacity for w in found):
            return found
        ways += 1


class Packer:
    """Pieces in, rows out; the ids of a group are held until it is divided."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, ways: int = WAYS, margin: int = MARGIN):
        self.sequence = first_sequence
        self.capacity, self.full = capacity, ways * (capacity - margin)
        self.piece = max(1, min(PIECE, capacity // 4))
        self.held: list[tuple] = []
        self.size = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            data = ids[4 * at : 4 * (at + self.capacity)]
            self.rows.append((doc_id, at, self.capacity, zlib.crc32(data), total, self.sequence, 0))
            self.sequence += 1
            at += self.capacity
        while at < total:
            take = min(self.piece, total - at, self.full - self.size)
            self.held.append((doc_id, at, take, zlib.crc32(ids[4 * at : 4 * (at + take)]), total))
            self.size += take
            at += take
            if self.size == self.full:
                self.flush()

    def flush(self) -> None:
        for window in windows([p[2] for p in self.held], self.capacity) if self.held else []:
            offset = 0
            for k in window:
                self.rows.append((*self.held[k], self.sequence, offset))
                offset += self.held[k][2]
            self.sequence += 1
        self.held, self.size = [], 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(_NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def pack(docs: DataFrame, vocab_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Rows of pieces, see SCHEMA; sequence ids are unique over the whole table."""
    end = struct.pack("<I", end_id)

    def run(batches):
        from pyspark import TaskContext

        encoder, packer = tokens.encoder(vocab_path), Packer(TaskContext.get().partitionId() << 40, capacity)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), tokens.GROUP):
                for key, ids in zip(keys[at:], encoder.encode(texts[at : at + tokens.GROUP])):
                    packer.add(key, ids + end)
            yield packer.take()
        packer.flush()
        yield packer.take()

    return common.small_batches(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
