"""Packing (operator 5): sum-of-squares online packing into fixed-length token windows.

Each scan partition packs its own documents as they come, so nothing is shuffled. Full windows
of a long document are sequences of their own; its remainder is an item. The packer keeps
``level[f]``, the number of open windows filled to ``f``. An item of size s goes to the fill
level f (0 opens a window) that makes the sum of squares over partially filled levels smallest:
moving a window from f to f+s changes it by -2*level[f]+1 for f > 0 and by 2*level[f+s]+1 for
f+s < length. Ties take the fullest level.

At most ``max_open`` windows stay open; beyond that, and at the end of a partition, the open
windows are settled. Documents may be cut, so settling loses nothing: the pieces of the emptiest
windows are cut to fill the fullest ones, and the one remainder is cut into windows whose lengths
are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillframe.llm.byte_tokens import byte_tokens
from quillframe.llm.common import prepare

LENGTH = 2048
END_ID = 1
MAX_OPEN = 4096

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA = pa.schema([(f.split()[0], pa.int64()) for f in FIELDS.split(", ")])


class SumOfSquares:
    """Places item sizes into windows of ``length``. A piece is (item, start, size)."""

    def __init__(self, length: int = LENGTH, max_open: int = MAX_OPEN):
        self.length, self.max_open = length, max_open
        self.level = np.zeros(length + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(length + 1)]
        self.n_open = 0

    def best_level(self, size: int) -> int:
        n = self.length
        gain = np.zeros(n - size + 1, dtype=np.int64)
        gain[1:] = 1 - 2 * self.level[1 : n - size + 1]
        gain[: n - size] += 1 + 2 * self.level[size:n]
        gain[1:][self.level[1 : n - size + 1] == 0] = np.iinfo(np.int64).max
        return n - size - int(np.argmin(gain[::-1]))

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        """Takes one piece shorter than a window; gives the windows that it closes."""
        size = piece[2]
        at = self.best_level(size)
        if at:
            window = self.open[at].pop()
            self.level[at] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if at + size == self.length:
            yield window
            return
        self.open[at + size].append(window)
        self.level[at + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self.settle()

    def settle(self) -> Iterator[list[tuple]]:
        """Closes all open windows without padding."""
        windows = [w for level in self.open[::-1] for w in level]
        self.open = [[] for _ in range(self.length + 1)]
        self.level[:] = 0
        self.n_open = 0
        lo, hi, room = 0, len(windows) - 1, 0
        filled = [sum(p[2] for p in w) for w in windows]
        while lo < hi:
            room = self.length - filled[lo]
            if room == 0:
                yield windows[lo]
                lo += 1
                continue
            item, start, size = windows[hi].pop()
            take = min(room, size)
            windows[lo].append((item, start + size - take, take))
            filled[lo] += take
            filled[hi] -= take
            if take < size:
                windows[hi].append((item, start, size - take))
            if not windows[hi]:
                hi -= 1
        if lo == hi:
            yield from powers_of_two(windows[lo], filled[lo])


def powers_of_two(window: list[tuple], filled: int) -> Iterator[list[tuple]]:
    """Cuts one window into windows whose lengths are the binary digits of its fill."""
    rest = list(window)[::-1]
    for bit in range(filled.bit_length() - 1, -1, -1):
        want, out = filled & (1 << bit), []
        while want:
            item, start, size = rest.pop()
            take = min(want, size)
            out.append((item, start, take))
            want -= take
            if take < size:
                rest.append((item, start + take, size - take))
        if out:
            yield out


def pack_partition(batches, partition: int, path=None, length=LENGTH, end_id=END_ID, max_open=MAX_OPEN):
    tokens, packer = byte_tokens(path), SumOfSquares(length, max_open)
    items: dict[int, tuple] = {}  # item: doc_id, ids, tokens not yet closed
    out: list[tuple] = []
    sequence, item = partition << 40, 0

    def close(window):
        nonlocal sequence
        offset = 0
        for key, start, size in window:
            doc_id, ids, base, total, left = items[key]
            piece = ids[start : start + size]
            out.append((doc_id, base + start, size, zlib.crc32(piece.tobytes()), total, sequence, offset))
            offset += size
            if left == size:
                del items[key]
            else:
                items[key] = (doc_id, ids, base, total, left - size)
        sequence += 1

    def flush():
        columns = zip(*out) if out else [[] for _ in SCHEMA]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SCHEMA)
        out.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(tokens.encode(text or ""), np.uint32(end_id)).astype("<u4")
            total = len(ids)
            whole = total - total % length
            for start in range(0, whole, length):
                piece = ids[start : start + length]
                out.append((doc_id, start, length, zlib.crc32(piece.tobytes()), total, sequence, 0))
                sequence += 1
            if whole < total:
                items[item] = (doc_id, ids[whole:].copy(), whole, total, total - whole)
                for window in packer.place((item, 0, total - whole)):
                    close(window)
                item += 1
        if out:
            yield flush()
    for window in packer.settle():
        close(window)
    yield flush()


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text packs as empty (its end id alone). A null doc_id stays null. Repeated rows are packed
    each. An empty table gives no rows. A very long text is encoded whole; its full windows are sequences at once. A partition keeps at most
    MAX_OPEN windows open; beyond that all open ones are settled, by cutting and not by the sum of squares (README has the shares). Other columns of ``docs`` are not read. Sequence ids carry the
    partition in their upper bits, so they are unique and not dense.
    """
    prepare(spark)

    def run(batches):
        from pyspark import TaskContext

        yield from pack_partition(batches, TaskContext.get().partitionId(), path, length, end_id)

    return docs.select("doc_id", "text").mapInArrow(run, FIELDS)
