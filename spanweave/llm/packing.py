"""Sum-of-squares online packing of token sequences into windows.

Every task packs the documents of its own partition as they stream by; nothing is shuffled. An array
holds, for each fill level, the open windows at that level. A document's remainder (after whole
windows are cut off) goes to the level where the sum over levels of squared counts of partly filled
windows grows least. At the end of a partition the windows still open keep what was placed in them, from
the fullest on, and are filled up with pieces cut from the emptiest; the last one is cut into powers of
two, which need no padding. Sequence ids are unique, not dense: a partition's number times 2 ** 40, plus a
count.

Null text: empty, one end id. Repeated rows are packed each. An empty table gives an empty one.
Extra columns are ignored. A null doc_id is carried as null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import default_ranks, encoded_chunks

WINDOW = 2048
END_ID = 1
OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{c} bigint" for c in OUT)


class SumOfSquares:
    def __init__(self, window: int, first_sequence: int):
        self.window, self.next = window, first_sequence
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.out: list[tuple] = []
        self.moved = 0  # ids that finish() takes out of the window chosen for them

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def level(self, size: int) -> int:
        """The open level (0: a new window) whose use adds least to the sum of squares; of equals the fullest."""
        top, c = self.window, self.counts
        from_ = c[: top - size + 1]
        cost = 2 * (c[size : top + 1] - from_) + 2
        cost[-1] = 1 - 2 * from_[-1]  # a full window is no longer counted
        cost[from_ == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * c[size] + 1
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            self.emit([(doc, at, ids[at : at + self.window], total)])
        size = total - whole
        if not size:
            return
        piece = (doc, whole, ids[whole:].copy(), total)
        h = self.level(size)
        pieces = self.open[h].pop() if h else []
        self.counts[h] -= bool(h)
        pieces.append(piece)
        if h + size == self.window:
            self.emit(pieces)
        else:
            self.open[h + size].append(pieces)
            self.counts[h + size] += 1

    def finish(self) -> None:
        windows = [pieces for h in range(self.window, 0, -1) for pieces in self.open[h]]
        room = [self.window - h for h in range(self.window, 0, -1) for _ in self.open[h]]
        self.open, self.counts[:] = [[] for _ in self.open], 0
        full, emptiest = 0, len(windows) - 1
        while full < emptiest:
            while room[full] and full < emptiest:
                doc, start, ids, total = windows[emptiest].pop()
                take, rest = ids[: room[full]], ids[room[full] :]
                windows[full].append((doc, start, take, total))
                self.moved += len(take)
                room[full] -= len(take)
                room[emptiest] += len(take)
                if len(rest):
                    windows[emptiest].append((doc, start + len(take), rest, total))
                if not windows[emptiest]:
                    emptiest -= 1
            if not room[full]:
                self.emit(windows[full])
                full += 1
        if full == emptiest:
            self._cut(windows[full], self.window - room[full])

    def _cut(self, rest: list, left: int) -> None:
        pieces, room = [], self._size(left)
        for doc, start, ids, total in rest:
            while len(ids):
                take = ids[:room]
                pieces.append((doc, start, take, total))
                start, ids, room, left = start + len(take), ids[len(take) :], room - len(take), left - len(take)
                if not room:
                    self.emit(pieces)
                    pieces, room = [], self._size(left)

    def _size(self, left: int) -> int:
        return self.window if left >= self.window else 1 << (left.bit_length() - 1) if left else 0


def pack(docs: DataFrame, ranks: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ranks = ranks or default_ranks()

    def run(batches):
        context = TaskContext.get()
        packer = SumOfSquares(window, (context.partitionId() if context else 0) << 40)

        def flush():
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(OUT))], OUT)

        for part, ids, edges, _, _ in encoded_chunks(batches, ranks):
            wire = ids.astype("<u4")
            for doc, a, b in zip(part.column("doc_id").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                packer.add(doc, np.append(wire[a:b], np.uint32(end_id)))
            if len(packer.out) > 5000:
                yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
