"""Harmonic packing of documents into training sequences.

Harmonic packing sorts documents into reciprocal-capacity classes: class k holds the lengths in
(C/(k+1), C/k], and a bin of class k is closed when it has k documents. A worker needs one open
bin for each class and nothing else: no sorting, no shuffle and no talk between workers.

A closed bin has a gap of less than C/(k+1). Documents may be cut, so gaps carry no padding: they
wait in a short queue, and a document longer than a sequence, or any where the queue is full, is
cut into them, the widest gap first; of a longer one full sequences follow, and its rest goes
whole to its class. Other documents are never cut. At the end of a partition what is left in open
bins fills the gaps that are left and then sequences one after another, and the last sequence is
cut at powers of two, which are not padded.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from auditloom.llm._common import doc_columns, slices, small_batches
from auditloom.llm.tokens import chunk_tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: sequence_id = partition << SEQUENCE_BITS | number within the partition
SEQUENCE_BITS = 40
#: Closed bins that wait for a document that is cut into their gaps.
MOST_GAPS = 64


class HarmonicBins:
    """The open bins of one worker, one for each reciprocal-capacity class."""

    def __init__(self, capacity: int, first_id: int = 0):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}

    def add(self, length: int, piece) -> Iterator[tuple]:
        """(piece, bin, offset) of the pieces of a bin that this piece closes, if it does."""
        k = self.capacity // length
        pieces = self.open.setdefault(k, [])
        pieces.append((length, piece))
        if len(pieces) == k:
            del self.open[k]
            yield from self._close(pieces)

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for length, piece in pieces:
            yield piece, self.next_id, offset
            offset += length
        self.next_id += 1

    def flush(self) -> Iterator[tuple]:
        """Close what is open; equal power-of-two pieces go into bins of power-of-two length."""
        for k in sorted(self.open):
            pieces = self.open.pop(k)
            sizes = {x for x, _ in pieces}
            exact = len(sizes) == 1 and (size := sizes.pop()) & (size - 1) == 0
            while pieces:
                n = 1 << (len(pieces).bit_length() - 1) if exact else len(pieces)
                yield from self._close(pieces[:n])
                pieces = pieces[n:]


class SequencePacker:
    """Harmonic bins whose gaps are filled by cut documents. A piece is (doc, start, doc_tokens, ids as bytes)."""

    def __init__(self, capacity: int, first_id: int = 0, most_gaps: int = MOST_GAPS):
        self.capacity, self.most_gaps = capacity, most_gaps
        self.bins = HarmonicBins(capacity, first_id)
        self.gaps: list[tuple[int, int, list]] = []  #: (-gap, number of the bin, its pieces), widest first

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """Rows of the sequences that this document completes."""
        n, start = len(ids) // 4, 0
        if self.gaps and (n > self.capacity or len(self.gaps) >= self.most_gaps):
            piece = (doc, 0, n, ids)
            while piece and self.gaps:
                piece, rows = self._into_gap(piece)
                yield from rows
            if not piece:
                return
            start, ids = piece[1], piece[3]
        for at in range(0, (n - start) // self.capacity * self.capacity, self.capacity):
            yield from self._rows(self._number(), [(doc, start + at, n, ids[4 * at : 4 * (at + self.capacity)])])
        rest = (n - start) % self.capacity
        if rest:
            own = ids[len(ids) - 4 * rest :]
            closed = list(self.bins.add(rest, (doc, n - rest, n, own)))
            if closed:
                yield from self._close(closed[0][1], [p for p, _, _ in closed])

    def flush(self) -> Iterator[tuple]:
        """Rows of all that is left: gaps first, then full sequences, then lengths of powers of two."""
        left = deque(piece for k in sorted(self.bins.open) for _, piece in self.bins.open[k])
        self.bins.open.clear()
        while self.gaps:
            if not left:  # the narrowest bin gives its pieces to the others
                left.extend(self.gaps.pop()[2])
                continue
            piece, rows = self._into_gap(left.popleft())
            yield from rows
            if piece:
                left.appendleft(piece)
        total = sum(len(p[3]) // 4 for p in left)
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 2, -1, -1) if total % self.capacity >> b & 1]
        for size in sizes:
            pieces = []
            while size:
                doc, start, n, ids = left.popleft()
                take = min(size, len(ids) // 4)
                pieces.append((doc, start, n, ids[: 4 * take]))
                if 4 * take < len(ids):
                    left.appendleft((doc, start + take, n, ids[4 * take :]))
                size -= take
            yield from self._rows(self._number(), pieces)

    def _number(self) -> int:
        self.bins.next_id += 1
        return self.bins.next_id - 1

    def _close(self, number: int, pieces: list) -> Iterator[tuple]:
        gap = self.capacity - sum(len(p[3]) // 4 for p in pieces)
        if gap:
            insort(self.gaps, (-gap, number, pieces), key=lambda g: g[:2])
        else:
            yield from self._rows(number, pieces)

    def _into_gap(self, piece: tuple) -> tuple[tuple | None, list]:
        """(what is left of the piece, rows of the bin that it fills) after cutting it into the widest gap."""
        gap, number, pieces = self.gaps.pop(0)
        doc, start, n, ids = piece
        take = min(-gap, len(ids) // 4)
        rows = list(self._close(number, [*pieces, (doc, start, n, ids[: 4 * take])]))
        return ((doc, start + take, n, ids[4 * take :]) if 4 * take < len(ids) else None), rows

    @staticmethod
    def _rows(number: int, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, n, ids in pieces:
            length = len(ids) // 4
            yield doc, start, length, zlib.crc32(ids), n, number, offset
            offset += length


def harmonic_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack whole documents (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns one row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. ``capacity`` is a power of two. Null and empty texts consist of ``end_id`` alone; a
    null doc_id stays null; repeated rows are packed as often as they occur; an empty table
    gives no rows; other columns are ignored. A task holds the pieces of its open bins and gaps:
    less than ``capacity`` ids for each class, and MOST_GAPS sequences.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two")
    small_batches(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_tokenizer(tokenizer_path).encode
        context = TaskContext.get()
        packer = SequencePacker(capacity, (context.partitionId() if context else 0) << SEQUENCE_BITS)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    rows += packer.add(doc, ids + end)
                yield _rows(rows)
        yield _rows(list(packer.flush()))

    return doc_columns(docs, "doc_id", "text").mapInArrow(pack, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)
