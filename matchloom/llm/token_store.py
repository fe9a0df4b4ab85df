"""Token shards coded with a static range asymmetric numeral system (rANS).

A shard holds the ids of consecutive documents. Its ids are cut into segments of a bounded number of tokens; a segment
has one frequency table, counted over all its tokens and shared by its blocks. A block codes up to ``block_tokens`` ids
in ``lanes`` interleaved states (token i belongs to lane i mod lanes), so numpy codes a whole row of lanes at a time.
Blocks depend on nothing but the table: each carries its states, its length, a checksum of its bytes and one of its ids,
and within it a checkpoint (states and word position) every ``checkpoint_steps`` rows, from which decoding can start.

Layout, little-endian: "RTOK0001", then segments, then the footer (pickled by numpy's plain arrays: doc ids, ids per
document, segment offsets), its length, its crc32 and "RTOKDONE".

Shards are made by a range partitioning on doc_id, so shard k's documents all precede shard k+1's; a window over one
manifest row per shard gives each shard's first token position. Nothing that grows with the documents is collected.

Cases: null or empty text: the end id alone. Null doc_id: sorted first. Equal doc_ids: in the order of their texts.
Empty table: no shard, no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import crc, doc_rows, get, put, scratch, slices, small_batches, stored
from matchloom.llm.wordtok import encoder, vocabulary

BITS = 20  # a table's frequencies add up to 2**BITS
LOW = np.uint64(1 << 31)  # states are kept in [2**31, 2**63) and renormalised by 32-bit words
MAGIC, DONE = b"RTOK0001", b"RTOKDONE"
NO_ID = -(1 << 63)  # stands for a null doc_id in the footer


class Table:
    """Frequencies of the symbols that occur, scaled to 2**BITS with none below 1."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.places = np.zeros(int(symbols[-1]) + 1, np.int32)
        self.places[symbols] = np.arange(len(symbols), dtype=np.int32)

    @classmethod
    def counted(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.nonzero(counts)[0]
        counts = counts[symbols]
        if len(symbols) > 1 << BITS:
            raise ValueError("more distinct ids in a segment than its table has slots")
        room = (1 << BITS) - len(symbols)
        freq = 1 + counts.astype(np.int64) * room // len(ids)
        freq[np.argmax(freq)] += (1 << BITS) - int(freq.sum())
        return cls(symbols.astype(np.uint32), freq)

    def dump(self) -> bytes:
        steps = np.diff(self.symbols.astype(np.int64), prepend=0).astype("<u4")
        return zlib.compress(steps.tobytes() + self.freq.astype("<u4").tobytes(), 1)

    @classmethod
    def load(cls, data: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(data), "<u4")
        half = len(both) // 2
        return cls(np.cumsum(both[:half].astype(np.int64)).astype(np.uint32), both[half:].astype(np.int64))

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table, lanes: int, checkpoint_steps: int) -> bytes:
    n = len(ids)
    steps = -(-n // lanes)
    at = table.places[ids]
    freq, start = table.freq[at], table.start[at]
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    written, marks = 0, []
    shift32, bits, top = np.uint64(32), np.uint64(BITS), np.uint64(63 - BITS)
    for step in range(steps - 1, -1, -1):
        f, c = freq[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
        live = x[: len(f)]
        full = np.nonzero((live >> top) >= f)[0]
        words.append(live[full].astype(np.uint32))
        live[full] >>= shift32
        written += len(full)
        q = live // f
        x[: len(f)] = (q << bits) + (live - q * f) + c
        if step and step % checkpoint_steps == 0:
            marks.append((step, written, x.copy()))
    payload = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    parts = [x.astype("<u8").tobytes()]
    for step, left, state in reversed(marks):
        parts += [struct.pack("<II", step, written - left), state.astype("<u8").tobytes()]
    body = b"".join([*parts, payload])
    return struct.pack("<IIIII", n, written, crc(body), crc(ids.astype("<u4").tobytes()), len(marks)) + body


def read_block(data: memoryview, lanes: int) -> tuple[dict, int]:
    n, n_words, body_crc, ids_crc, n_marks = struct.unpack_from("<IIIII", data)
    end = 20 + 8 * lanes + n_marks * (8 + 8 * lanes) + 4 * n_words
    if len(data) < end or crc(data[20:end]) != body_crc:
        raise ValueError("a block is damaged")
    at = 20
    points = [(0, 0, np.frombuffer(data, "<u8", lanes, at))]
    at += 8 * lanes
    for _ in range(n_marks):
        step, word = struct.unpack_from("<II", data, at)
        points.append((step, word, np.frombuffer(data, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    return {"n": n, "ids_crc": ids_crc, "points": points, "words": np.frombuffer(data, "<u4", n_words, at)}, end


def decode_block(block: dict, table: Table, slots: np.ndarray, lanes: int, point: int = 0) -> np.ndarray:
    """The block's ids from the given checkpoint on; 0 is the block's begin."""
    first, word, state = block["points"][point]
    n, words = block["n"], block["words"]
    steps = -(-n // lanes)
    x = state.astype(np.uint64)
    out = np.empty(n - first * lanes, np.int32)
    mask, bits, shift32 = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    freq, start = table.freq, table.start
    for step in range(first, steps):
        live = x[: min(lanes, n - step * lanes)]
        slot = live & mask
        symbol = slots[slot.astype(np.int64)]
        live = freq[symbol] * (live >> bits) + slot - start[symbol]
        low = np.nonzero(live < LOW)[0]
        if len(low):
            live[low] = (live[low] << shift32) | words[word : word + len(low)]
            word += len(low)
        x[: len(live)] = live
        at = (step - first) * lanes
        out[at : at + len(live)] = symbol
    return table.symbols[out]


def encode_segment(ids: np.ndarray, lanes: int, block_tokens: int, checkpoint_steps: int) -> bytes:
    table = Table.counted(ids)
    dumped = table.dump()
    blocks = [encode_block(ids[i : i + block_tokens], table, lanes, checkpoint_steps) for i in range(0, len(ids), block_tokens)]
    sizes = np.array([len(b) for b in blocks], "<u8").tobytes()
    return b"".join([struct.pack("<IIII", len(ids), lanes, len(dumped), len(blocks)), sizes, dumped, *blocks])


def decode_segment(data: memoryview) -> np.ndarray:
    n, lanes, table_bytes, n_blocks = struct.unpack_from("<IIII", data)
    sizes = np.frombuffer(data, "<u8", n_blocks, 16)
    at = 16 + 8 * n_blocks
    table = Table.load(bytes(data[at : at + table_bytes]))
    at += table_bytes
    slots, parts = table.slots(), []
    for size in sizes.tolist():
        block, _ = read_block(data[at : at + size], lanes)
        ids = decode_block(block, table, slots, lanes)
        if crc(ids.astype("<u4").tobytes()) != block["ids_crc"]:
            raise ValueError("a block's ids are damaged")
        parts.append(ids)
        at += size
    ids = np.concatenate(parts)
    if len(ids) != n:
        raise ValueError("a segment's length is wrong")
    return ids


def dump_shard(segments: list[bytes], doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    offsets = np.cumsum([len(MAGIC)] + [len(s) for s in segments]).astype("<u8")
    ids = np.array([NO_ID if i is None else i for i in doc_ids], "<i8")
    body = zlib.compress(struct.pack("<II", len(ids), len(segments)) + ids.tobytes() + counts.astype("<u8").tobytes() + offsets.tobytes(), 1)
    return b"".join([MAGIC, *segments, body, struct.pack("<QI", len(body), crc(body)), DONE])


def shard_footer(data: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if bytes(data[:8]) != MAGIC or bytes(data[-8:]) != DONE:
        raise ValueError("not a whole token shard")
    size, check = struct.unpack_from("<QI", data, len(data) - 20)
    body = bytes(data[len(data) - 20 - size : len(data) - 20])
    if crc(body) != check:
        raise ValueError("the shard's footer is damaged")
    body = zlib.decompress(body)
    n, n_segments = struct.unpack_from("<II", body)
    return np.frombuffer(body, "<i8", n, 8), np.frombuffer(body, "<u8", n, 8 + 8 * n), np.frombuffer(body, "<u8", n_segments + 1, 8 + 16 * n)


def read_shard(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document, one segment in memory at a time."""
    view = memoryview(data)
    doc_ids, counts, offsets = shard_footer(view)
    rest, k = np.empty(0, np.uint32), 0
    todo = counts.tolist()
    for i in range(len(offsets) - 1):
        rest = np.concatenate([rest, decode_segment(view[int(offsets[i]) : int(offsets[i + 1])])])
        at = 0
        while k < len(todo) and at + todo[k] <= len(rest):
            yield None if doc_ids[k] == NO_ID else int(doc_ids[k]), rest[at : at + todo[k]]
            at += todo[k]
            k += 1
        rest = rest[at:]
    if k < len(todo) or len(rest):
        raise ValueError("the shard's documents and ids don't match")


def write_token_shards(docs: DataFrame, folder: str, *, tokenizer_path: str | None = None, end_id: int = 1, lanes: int = 2048, block_tokens: int = 1 << 19, segment_tokens: int = 1 << 21, checkpoint_steps: int = 128, shard_tokens: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and returns the manifest: path, part, piece, n_docs, n_tokens, start (tokens before the shard).

    A partition with over shard_tokens ids gives several shards; at most a segment's ids and a shard's bytes are held.
    """
    path = tokenizer_path or vocabulary("word_bpe_49k.json")
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokenizer, piece = TaskContext.get().partitionId(), encoder(path), 0
        segments: list[bytes] = []
        open_ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        counts: list[np.ndarray] = []
        n_open = n_all = 0

        def close_segment() -> None:
            nonlocal open_ids, n_open
            if n_open:
                segments.append(encode_segment(np.concatenate(open_ids), lanes, block_tokens, checkpoint_steps))
            open_ids, n_open = [], 0

        def close_shard() -> pa.RecordBatch:
            nonlocal segments, doc_ids, counts, n_all, piece
            close_segment()
            put(to := f"{folder}/part-{part:06d}-{piece:04d}.rtok", dump_shard(segments, doc_ids, np.concatenate(counts)))
            row = pa.RecordBatch.from_pylist([{"path": to, "part": part, "piece": piece, "n_docs": len(doc_ids), "n_tokens": n_all}])
            segments, doc_ids, counts, n_all, piece = [], [], [], 0, piece + 1
            return row

        for batch in slices(batches):
            flat, n = tokenizer.encode(batch.column(1).to_pylist())
            open_ids.append(np.insert(flat, np.cumsum(n), np.uint32(end_id)))
            doc_ids += batch.column(0).to_pylist()
            counts.append(n + 1)
            n_open += len(open_ids[-1])
            n_all += len(open_ids[-1])
            if n_open >= segment_tokens:
                close_segment()
            if n_all >= shard_tokens:
                yield close_shard()
        if doc_ids:
            yield close_shard()

    rows = doc_rows(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(spark):
        manifest = stored(spark, rows.mapInArrow(write, "path string, part long, piece long, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document, from the shards' bytes alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                size = 0
                for doc_id, ids in read_shard(get(path)):
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    size += len(ids)
                    if size >= 1 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def token_round_trip(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Writes the shards below the shared folder and reads them back."""
    return read_token_shards(write_token_shards(docs, scratch(spark, "tokens"), **options))
