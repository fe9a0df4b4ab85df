"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAV containers.

mu-law and A-law samples are expanded by lookup tables of 256 entries. ADPCM is decoded with numpy across blocks: a block
starts from its own header, so step i of every block of a batch is done at once and the loop runs over the samples of one
block only. PCM is resampled to any rate by linear interpolation within each recording, and stored beside the recording.

Cases: a null recording has null results; a null or empty text's payload is 64 zero bytes; a payload that is not whole
blocks (ADPCM) or whose container is damaged raises ValueError; very long texts: like others; equal payloads have equal containers, PCM and features; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.common import doc_rows, slices, stored

#: WAVE format tags, and the step sizes and index changes of IMA ADPCM.
ALAW, MULAW, ADPCM = 6, 7, 17
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
BLOCK = 64  # bytes of an ADPCM block: 4 of header, 60 of two samples each
PCM_RATE = 4000  # of stored PCM; telephony's 8000 samples a second would be twice its size
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, low + 0x108 << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks: uint8, (n, BLOCK). Returns int16 (n, 1 + 2 * (BLOCK - 4)): the header's sample and two for each byte."""
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            step = STEPS[index]
            size = code & 7
            change = (step * (2 * size.astype(np.int32) + 1)) >> 3
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[size], 0, len(STEPS) - 1)
            out[1 + 2 * k + half] = value
    return np.ascontiguousarray(out.T)


def samples_in(codec: int, n_bytes: int) -> int:
    return n_bytes if codec != ADPCM else n_bytes // BLOCK * (1 + 2 * (BLOCK - 4))


def wav(payload: bytes, codec: int, rate: int = 8000) -> bytes:
    """A WAVE file whose data chunk is the payload, unchanged."""
    if codec == ADPCM:
        if len(payload) % BLOCK:
            raise ValueError("ADPCM data must be whole blocks")
        per_block = 1 + 2 * (BLOCK - 4)
        form = struct.pack("<HHIIHHHH", codec, 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
    else:
        form = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0)
    fact = struct.pack("<I", samples_in(codec, len(payload)))
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<I", 4) + fact + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(body) + len(payload) + len(pad)) + body + payload + pad


def read_wav(data: bytes) -> tuple[int, int, bytes]:
    """(codec, rate, data chunk)."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", data, at + 8)
        elif kind == b"data":
            body = data[at + 8 : at + 8 + size]
            if codec is None or len(body) != size:
                break
            return codec, rate, body
        at += 8 + size + size % 2
    raise ValueError("a damaged WAVE file")


def decode(payloads: list[bytes], codec: int) -> tuple[np.ndarray, np.ndarray]:
    """The PCM of many recordings one after the other, and the samples of each."""
    both = np.frombuffer(b"".join(payloads), np.uint8)
    lengths = np.array([samples_in(codec, len(p)) for p in payloads], np.int64)
    if codec == MULAW:
        return MULAW_TABLE[both], lengths
    if codec == ALAW:
        return ALAW_TABLE[both], lengths
    if codec == ADPCM:
        if any(len(p) % BLOCK for p in payloads):
            raise ValueError("ADPCM data must be whole blocks")
        return decode_adpcm(both.reshape(-1, BLOCK)).reshape(-1), lengths
    raise ValueError(f"codec {codec} is none of {sorted(NAMES)}")


def resample(pcm: np.ndarray, lengths: np.ndarray, rate: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """The recordings at another rate, and their lengths (rounded up). Between two samples of a recording by linear interpolation
    (floor), in integers; its last sample is held."""
    count = -(-lengths * to // rate)
    starts, ends = np.cumsum(lengths) - lengths, np.cumsum(lengths) - 1
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at, part = np.divmod(step * rate, to)
    here = np.repeat(starts, count) + at
    after = np.minimum(here + 1, np.repeat(ends, count))
    wide = pcm.astype(np.int64)
    return (wide[here] + (wide[after] - wide[here]) * part // to).astype(np.int16), count


def features(pcm: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Of each recording, in integers: samples, peak, energy (sum of squares), zero crossings. Lengths are positive."""
    starts = np.cumsum(lengths) - lengths
    wide = pcm.astype(np.int64)
    energy = np.add.reduceat(wide * wide, starts)
    peak = np.maximum.reduceat(np.abs(pcm.astype(np.int32)), starts)
    below = pcm < 0
    turns = np.empty(len(pcm), np.int32)
    turns[0] = 0
    turns[1:] = below[1:] != below[:-1]
    turns[starts] = 0
    crossings = np.add.reduceat(turns, starts)
    return [f"samples={n};peak={p};energy={e};crossings={c}" for n, p, e, c in zip(lengths.tolist(), peak.tolist(), energy.tolist(), crossings.tolist(), strict=True)]


def text_payload(text: str) -> bytes:
    """UTF-8, with zero bytes up to a positive multiple of 64."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\0" * (64 - len(data) % 64 if len(data) % 64 or not data else 0)


def codec_of(payload: bytes) -> int:
    """Which codec carries a payload; by its bytes alone, so that equal payloads are stored alike."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def _decoded(media: list[bytes], to: int) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray]]:
    """By codec and rate: positions, PCM at the rate `to`, and its lengths."""
    read = [read_wav(m) for m in media]
    for codec, rate in sorted({r[:2] for r in read}):
        at = [k for k, r in enumerate(read) if r[:2] == (codec, rate)]
        yield codec, at, *resample(*decode([read[k][2] for k in at], codec), rate, to)


def _pcm_columns(media: list[bytes | None], to: int) -> tuple[list[str | None], list[bytes | None]]:
    """Codec and resampled PCM (int16, little-endian) of each recording; null: null."""
    codecs: list[str | None] = [None] * len(media)
    out: list[bytes | None] = [None] * len(media)
    have = [k for k, m in enumerate(media) if m is not None]
    for codec, at, pcm, lengths in _decoded([media[k] for k in have], to):
        data, ends = pcm.astype("<i2"), np.cumsum(lengths)
        for j, k in enumerate(at):
            codecs[have[k]] = NAMES[codec]
            out[have[k]] = data[ends[j] - lengths[j] : ends[j]].tobytes()
    return codecs, out


def store_media(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = PCM_RATE) -> DataFrame:
    """doc_id, n_bytes, media, codec, pcm: each text's payload in a WAVE file and that recording's PCM at `rate`, written to a table
    in the shared folder."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            payloads = [text_payload(t) for t in texts]
            n = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            media = [wav(p, codec_of(p)) for p in payloads]
            codecs, pcm = _pcm_columns(media, rate)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(codecs, pa.string()), pa.array(pcm, pa.binary())], ["doc_id", "n_bytes", "media", "codec", "pcm"])

    return stored(spark, doc_rows(docs, id_col, text_col).mapInArrow(put, "doc_id long, n_bytes long, media binary, codec string, pcm binary"), "media")


def resampled_pcm(media: DataFrame, *, rate: int = PCM_RATE) -> DataFrame:
    """doc_id, codec, pcm (int16, little-endian) of a table with doc_id and media; null media: null codec and pcm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codecs, pcm = _pcm_columns(batch.column(1).to_pylist(), rate)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codecs, pa.string()), pa.array(pcm, pa.binary())], ["doc_id", "codec", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, codec string, pcm binary")


def media_digest(media: DataFrame) -> DataFrame:
    """What the stored bytes hold and sound like: one row per row of store_media's table. Payload and container are read from
    media, the features from the stored PCM. Null media: null results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, codecs, sound = (batch.column(k).to_pylist() for k in (1, 3, 4))
            rows: list[tuple] = [(None,) * 6] * len(data)
            have = [k for k, (m, p) in enumerate(zip(data, sound, strict=True)) if m is not None and p]
            pcm = np.frombuffer(b"".join([sound[k] for k in have]), "<i2")
            told = features(pcm, np.array([len(sound[k]) // 2 for k in have], np.int64)) if have else []
            feature = dict(zip(have, told, strict=True))
            for k, m in enumerate(data):
                if m is not None:
                    payload = read_wav(m)[2]
                    text = f"codec={codecs[k]};{feature[k]}" if k in feature else None
                    rows[k] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), text)
            n, sha, tail, size, media_sha, told = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), pa.array(size, pa.int64()), pa.array(media_sha, pa.string()), pa.array(told, pa.string())],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.select("doc_id", "media", "n_bytes", "codec", "pcm").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
