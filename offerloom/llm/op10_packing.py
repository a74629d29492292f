"""Packing of token ids into fixed windows: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices
from .encoder import encoding

#: Pieces that are packed together, at most: it bounds a task's memory.
PACK_ROWS = 200_000


class Capacities:
    """Open windows by remaining capacity. Inner nodes count the windows below, so the tightest fit takes log2 steps."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out a window of the smallest capacity that is need or more: (capacity, window)."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece of 1 to size tokens, and how many windows there are. Ties keep their order."""
    window, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    free = Capacities(size)
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable"):
        need = int(lengths[i])
        found = free.tightest(need)
        if found is None:
            found, n = (size, n), n + 1
        capacity, window[i] = found
        offset[i] = size - capacity
        if capacity > need:
            free.put(capacity - need, int(window[i]))
    return window, offset, n


def packed(docs: DataFrame, path: str, end_id: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents of over size ids are cut into full windows first; what is left of each, and all shorter ones, are
    packed best-fit decreasing with the others of their scan task, PACK_ROWS at a time. So there is no shuffle,
    no key that could be hot, and the windows that stay partly open are a few for each task. sequence_id has the
    task in its upper bits. Null texts count as empty: one piece with end_id. Repeated rows are packed each; an
    empty table gives no pieces; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches):
        next_id = TaskContext.get().partitionId() << 40
        pieces: list[tuple] = []

        def close():
            nonlocal next_id
            ids, start, length, crc, total = zip(*pieces)
            window, offset, n = best_fit_decreasing(length, size)
            out = pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, window + next_id, offset))], names=names)
            next_id += n
            pieces.clear()
            return out

        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        with encoding(path) as enc:
            for batch in slices(batches, "text", 1 << 20):
                id_type = batch.schema.field("id").type
                for i, x in zip(batch.column("id").to_pylist(), enc.ids([t or "" for t in batch.column("text").to_pylist()])):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    for a in range(0, len(x), size):
                        pieces.append((i, a, min(size, len(x) - a), zlib.crc32(x[a : a + size].tobytes()), len(x)))
                    if len(pieces) >= PACK_ROWS:
                        yield close()
        if pieces:
            yield close()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pack, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
