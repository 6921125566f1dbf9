"""Harmonic packing.

Lengths fall into reciprocal-capacity classes: class k holds the lengths above C/(k+1) up to C/k, and each of its bins
takes exactly k pieces, whatever other classes do. So a worker fills its bins without knowing any other worker, in one
pass over its documents and without a shuffle. Documents may be cut: full sequences come off first, and a rest that
would leave a bin of its class too empty gives up a piece of the largest length of the next class instead. When a worker ends, the pieces
of its open bins are laid end to end into full sequences; what remains is dealt to sequences of powers of two.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe, common

CAPACITY = 1024
#: A piece may be shorter than the largest of its class by one part in so many.
SLACK = 64
SEPARATOR = 0
_FIELDS = (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()))


@functools.lru_cache(maxsize=4096)
def cuts(rest: int, capacity: int = CAPACITY) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of a rest below the capacity."""
    out = []
    while rest:
        k = capacity // rest
        most = capacity // k
        if most - rest > most // SLACK:  # too short for its class: a whole piece of the next one, and a smaller rest
            k += 1
            most = capacity // k
        length = min(rest, most)
        out.append((length, k))
        rest -= length
    return tuple(out)


class Worker:
    """The open bins of one task. Sequences are numbered from `first`."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.next, self.capacity = first, capacity
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            self._close([(doc, at, ids[at * 4 : (at + self.capacity) * 4], total)])
            at += self.capacity
        for length, k in cuts(total - at, self.capacity):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, at, ids[at * 4 : (at + length) * 4], total))
            at += length
            if len(bin_) == k:
                self._close(self.open.pop(k))

    def finish(self) -> None:
        """Lays the pieces of open bins end to end, cutting at the capacity; the last rest goes to powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        n = sum(len(p[2]) // 4 for p in left)
        sizes = [self.capacity] * (n // self.capacity) + [1 << b for b in reversed(range((n % self.capacity).bit_length())) if n % self.capacity >> b & 1]
        for size in sizes:
            room, pieces = size, []
            while room:
                doc, start, ids, total = left.pop(0)
                if len(ids) // 4 > room:
                    left.insert(0, (doc, start + room, ids[room * 4 :], total))
                    ids = ids[: room * 4]
                pieces.append((doc, start, ids, total))
                room -= len(ids) // 4
            self._close(pieces)

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else ((),) * len(_FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def harmonic_pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """A row for each piece of every row of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids of a document are those of its whole text and then the separator, so a null or empty text is one id.
    capacity is a power of two. Rows that repeat a doc_id are packed one by one; a null doc_id stays null; an empty table gives an empty
    result; other columns are not read. sequence_id holds the partition above bit 40: a task that is run again
    numbers its own sequences alike. Memory in a task: the open bins, at most one sequence for each class.
    """
    path = path or bpe.tokenizer_path()
    end = separator.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        worker = Worker(TaskContext.get().partitionId() << 40, capacity)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    worker.add(doc, ids + end)
                yield worker.batch()
        worker.finish()
        yield worker.batch()

    kinds = ", ".join(f"{n} long" for n, _ in _FIELDS)
    return common.id_and_text(docs).mapInArrow(pack, kinds)
