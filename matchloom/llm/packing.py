"""Best-fit decreasing packing of token sequences into windows of fixed capacity.

Overlong documents are first cut into full windows. What is left of each document is placed, longest first, in the open
window with the least room that still holds it; a segment tree over the remaining capacities 0..capacity finds that
window in log2(capacity) steps. Each task packs the documents of one hash partition (AQE gives partitions of about the
advisory size, so a task has hundreds of windows and its last, half-full ones don't matter); a task with more than
``most_tokens`` packs in several goes, so memory is bounded whatever the partition holds. No document is dropped, no
token is cut off.

Cases: null or empty text: the end id alone. Repeated rows: each is packed for itself. Ties in length: by doc_id, then
input order after sorting by text. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import doc_rows, slices
from matchloom.llm.wordtok import encoder, vocabulary

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """How many open windows have each remaining capacity; tightest(size) is the least capacity >= size that has one."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1 - 1).bit_length() if capacity else 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at, count = self.leaves + room, self.count
        while at:
            count[at] += by
            at >>= 1

    def tightest(self, size: int) -> int:
        """-1 if no open window has that much room."""
        at, count = self.leaves + size, self.count
        if count[at]:
            return size
        while at > 1:  # up to the first right sibling that holds a window
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:  # and down to its leftmost one
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each size, all at most capacity; sizes are placed longest first, equal ones in order."""
    tree = CapacityTree(capacity)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    windows = 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[k]
        room = tree.tightest(size)
        if room < 0:
            window, room, windows = windows, capacity, windows + 1
        else:
            window = with_room[room].pop()
            tree.add(room, -1)
        out[k] = (window, capacity - room)
        if room - size:
            with_room[room - size].append(window)
            tree.add(room - size, 1)
    return out


def _packer(path: str, capacity: int, end_id: int, most_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held, tokens
            doc, start, length, total, blob = [], [], [], [], []
            for ids_of, flat, counts in held:
                data = memoryview(flat.astype("<u4").tobytes())
                at = 0
                for doc_id, n in zip(ids_of, counts.tolist(), strict=True):
                    for s in range(0, n, capacity):
                        size = min(capacity, n - s)
                        doc.append(doc_id)
                        start.append(s)
                        length.append(size)
                        total.append(n)
                        blob.append(data[4 * (at + s) : 4 * (at + s + size)])
                    at += n
            placed = best_fit_decreasing(length, capacity)
            ids = [sequence + w for w, _ in placed]
            for i in range(0, len(doc), 2048):
                cut = slice(i, i + 2048)
                columns = [pa.array(doc[cut], pa.int64()), pa.array(start[cut], pa.int64()), pa.array(length[cut], pa.int64()), pa.array([bytes(b) for b in blob[cut]], pa.binary()), pa.array(total[cut], pa.int64()), pa.array(ids[cut], pa.int64()), pa.array([o for _, o in placed[cut]], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequence += 1 + max((w for w, _ in placed), default=-1)
            held, tokens = [], 0

        tokenizer = encoder(path)
        for batch in slices(batches):
            flat, counts = tokenizer.encode(batch.column(1).to_pylist())
            flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id)) if len(counts) else flat
            held.append((batch.column(0).to_pylist(), flat, counts + 1))
            tokens += len(flat)
            if tokens >= most_tokens:
                yield from flush()
        if held:
            yield from flush()

    return pack


def pack_documents(docs: DataFrame, *, tokenizer_path: str | None = None, capacity: int = 4096, end_id: int = 2, most_tokens: int = 3_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    The rows of a hash partition are sorted before they are packed, so that a task that runs again packs alike.
    """
    path = tokenizer_path or vocabulary("word_bpe_49k.json")
    rows = doc_rows(docs, id_col, text_col)
    rows = rows.repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(_packer(path, capacity, end_id, most_tokens), SCHEMA)


def packed_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with their ids' crc32 instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
