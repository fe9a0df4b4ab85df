"""Repeated passages by relative Lempel-Ziv parsing over distributed reference blocks.

A window is ``window`` consecutive words of one document. A reference block is a part of the index of all documents' windows,
held by one task. What a document has in a block is parsed greedily: at each place the longest factor that also starts
elsewhere in the block is found among the block's sorted suffixes, it is emitted with its source, and the parse goes on
behind it. A factor of n windows is n + window - 1 words long, so every factor is long enough; and as the parse goes on with
the first window that the factor does not hold, not with the first word behind it, the windows across each boundary are
checked too. Words under a factor are repeats; every other word is a literal and stays.

Which block a window is in: each window names an anchor, the run of ``anchor`` words in it with the least hash (equal windows
name equal anchors), so that neighbours mostly go together, with 6 bytes of hash for each window besides the anchor's 8; all
14 are compared. An anchor may have any number of different windows (the edges of a passage that every third document has).
Anchors are counted first, and the windows of those with over ``hot`` runs are dealt out each for itself, by its own hash. Any
choice of such anchors gives the same result; at most 2**20 are chosen (8 MB), those with the most runs.

A task first parses its own documents: of windows that repeat among them it sends one on, so a passage that a third of all
documents share reaches the index once per task of the scan and not once per document. Blocks are as many as the windows
counted ask for. The texts themselves are shuffled once, to be joined with their own factors.

Cases: null or empty text: no words, nothing removed. Texts under one window: nothing removed. Very long texts: like any other;
a factor may be as long as the text. Repeated rows, and rows with equal doc_id: each row is a document. Null doc_id: kept.
Empty table: no rows. Other columns: ignored by removal_digest, kept as they are by without_repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import parts_for, row_key, slices, stored, unused
from matchloom.llm.words import Words, mixed

ROW = np.dtype([("a", "<i8"), ("b", "<i8")])
RUN = np.dtype([("row", ROW), ("start", "<i4"), ("n", "<i4"), ("source", ROW), ("source_start", "<i4")])
HEAD = np.dtype([("key", "<u8"), ("row", ROW), ("start", "<i4"), ("n", "<u4"), ("known", "u1")])
_PLACE = np.uint64((1 << 28) - 1)
LOOK = 64  # windows of a factor that are compared when its source is chosen; it goes on beyond them
SENT = "part int, sub int, kind int, heads binary, tails binary"


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x["a"] != y["a"]) | (x["b"] != y["b"])


class Windows:
    """Columns of windows: anchor, document, first word, hash of the words, and whether it is known to repeat."""

    NAMES = ("key", "row", "start", "code", "known")

    def __init__(self, key: np.ndarray, row: np.ndarray, start: np.ndarray, code: np.ndarray, known: np.ndarray):
        self.key, self.row, self.start, self.code, self.known = key, row, start, code, known

    def __len__(self) -> int:
        return len(self.key)

    def at(self, which: np.ndarray) -> Windows:
        return Windows(*(getattr(self, k)[which] for k in self.NAMES))

    @classmethod
    def joined(cls, parts: list[Windows]) -> Windows:
        return cls(*(np.concatenate([getattr(p, k) for p in parts]) for k in cls.NAMES))

    def follows(self) -> np.ndarray:
        """Whether each window comes right after the one before it, in one document."""
        out = np.zeros(len(self), bool)
        out[1:] = ~_apart(self.row[1:], self.row[:-1]) & (self.start[1:] == self.start[:-1] + 1)
        return out

    def pack(self) -> tuple[bytes, bytes]:
        """Windows that follow one another under one anchor share a head; 6 bytes are kept of each hash."""
        new = ~self.follows()
        new[1:] |= (self.key[1:] != self.key[:-1]) | (self.known[1:] != self.known[:-1])
        first = np.nonzero(new)[0]
        heads = np.empty(len(first), HEAD)
        heads["key"], heads["row"], heads["start"], heads["known"] = self.key[first], self.row[first], self.start[first], self.known[first]
        heads["n"] = np.diff(np.append(first, len(self)))
        return heads.tobytes(), np.ascontiguousarray(self.code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()

    @classmethod
    def unpack(cls, heads: bytes, tails: bytes) -> Windows:
        head = np.frombuffer(heads, HEAD)
        n = head["n"].astype(np.int64)
        code = np.zeros((len(tails) // 6, 8), np.uint8)
        code[:, :6] = np.frombuffer(tails, np.uint8).reshape(-1, 6)
        step = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        return cls(np.repeat(head["key"], n), np.repeat(head["row"], n), (np.repeat(head["start"], n) + step).astype(np.int32), code.view("<u8").reshape(-1), np.repeat(head["known"], n))


def anchors_of(words: Words, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of each window of a batch."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.nonzero(words.text_of[:n] == words.text_of[window - 1 :])[0]
    grams = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    first, gram = words.windows(anchor, hashes)
    grams[first] = gram
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, width = window - anchor + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return at, grams[(least[at] & _PLACE).astype(np.int64)]


def windows_of(words: Words, rows: np.ndarray, window: int, anchor: int, hot: np.ndarray) -> Windows:
    """All windows of a batch; rows: a key for each text; hot: sorted anchors whose windows go each for itself."""
    hashes = words.hashes()
    at, keys = anchors_of(words, hashes, window, anchor)
    code = words.windows(window, hashes)[1]
    if len(hot) and len(keys):
        own = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
        keys = np.where(own, mixed(keys + code), keys)
    text = words.text_of[at]
    return Windows(keys, rows[text], (at - words.first[text]).astype(np.int32), code & np.uint64((1 << 48) - 1), np.zeros(len(at), np.uint8))


def kinds(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each window, equal for equal windows; windows in the order of these numbers, equal ones as they come)."""
    order = np.argsort(mixed(w.key ^ mixed(w.code + np.uint64(1))), kind="stable")
    mix = mixed(w.key[order] ^ mixed(w.code[order] + np.uint64(1)))
    fresh = (w.key[order][1:] != w.key[order][:-1]) | (w.code[order][1:] != w.code[order][:-1])
    if (fresh & (mix[1:] == mix[:-1])).any():  # two kinds share the number that was sorted by
        order = np.lexsort((w.code, w.key))
        fresh = (w.key[order][1:] != w.key[order][:-1]) | (w.code[order][1:] != w.code[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.concatenate([np.zeros(min(1, len(order)), np.int64), np.cumsum(fresh)])
    return number, order


def factors(w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of all windows not yet known to repeat against all windows of w: RUN rows; and which windows repeat, and
    which of them are not the first of their kind."""
    kind, order = kinds(w)
    size = np.bincount(kind, minlength=1)
    repeated = size[kind] > 1 if len(kind) else np.zeros(0, bool)
    later = np.zeros(len(kind), bool)
    later[order[1:][kind[order][1:] == kind[order][:-1]]] = True
    at = np.nonzero(repeated)[0]
    if not len(at):
        return np.empty(0, RUN), repeated, later
    # runs of repeated windows that follow one another; `end`: where each one's run ends
    follows = w.follows()[at]
    follows[0] = False
    follows[1:] &= at[1:] == at[:-1] + 1
    ends = np.append(np.nonzero(~follows)[0][1:], len(at))
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    place = np.arange(len(at))
    # ranks of the next 1, 2, 4, .. LOOK windows from each place (-1: the run is shorter)
    levels = [kind[at]]
    for k in range(LOOK.bit_length() - 1):
        ahead = place + (1 << k)
        second = np.where(ahead < end, levels[-1][np.minimum(ahead, len(at) - 1)], -1)
        pair = levels[-1] * np.int64(len(kind) + 1) + second + 1
        by = np.argsort(pair, kind="stable")
        rank = np.empty(len(at), np.int64)
        rank[by] = np.concatenate([[0], np.cumsum(pair[by][1:] != pair[by][:-1])])
        levels.append(rank)

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many windows, at most 2 * LOOK - 1, are the same from i and from j."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y, step = i + n, j + n, 1 << k
            fits = (x + step <= end[i]) & (y + step <= end[j])
            same = fits & (levels[k][np.minimum(x, len(at) - 1)] == levels[k][np.minimum(y, len(at) - 1)])
            n += same * step
        return n

    by = np.argsort(levels[-1], kind="stable")
    shared = np.concatenate([[0], alike(by[:-1], by[1:]), [0]])  # with the suffix before, and after
    length, source = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    back = shared[:-1] >= shared[1:]
    length[by] = np.maximum(shared[:-1], shared[1:])
    source[by] = np.where(back, np.concatenate([by[:1], by[:-1]]), np.concatenate([by[1:], by[-1:]]))

    # the walk: all runs at once, a factor of each at a time
    asked = w.known[at] == 0
    begins = asked & ~np.concatenate([[False], asked[:-1] & follows[1:]])
    stop = np.append(np.nonzero(begins | ~asked)[0], len(at))
    here = np.nonzero(begins)[0]
    last = stop[np.searchsorted(stop, here, side="right")]
    found: list[np.ndarray] = []
    while len(here):
        n = np.minimum(length[here], last - here)
        found.append(np.stack([here, source[here], n]))
        here = here + n
        here, last = here[here < last], last[here < last]
    parts = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    mine, theirs, n = parts[:, np.argsort(parts[0], kind="stable")]
    # a factor goes on where the next one begins with what follows in its source
    goes_on = np.zeros(len(mine), bool)
    goes_on[1:] = (mine[1:] == mine[:-1] + n[:-1]) & (mine[1:] < end[mine[:-1]]) & (theirs[1:] == theirs[:-1] + n[:-1]) & (theirs[1:] < end[theirs[:-1]])
    first = np.nonzero(~goes_on)[0]
    out = np.empty(len(first), RUN)
    out["row"], out["start"] = w.row[at[mine[first]]], w.start[at[mine[first]]]
    out["source"], out["source_start"] = w.row[at[theirs[first]]], w.start[at[theirs[first]]]
    out["n"] = np.add.reduceat(n, first) if len(first) else 0
    return out, repeated, later


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "sub", "kind", "heads", "tails"])


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    rows = np.empty(batch.num_rows, ROW)
    rows["a"], rows["b"] = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
    return rows


def _scanner(n_parts: int, subs: int, window: int, anchor: int, most: int, hot: np.ndarray):
    def send(held: list[Windows]) -> Iterator[pa.RecordBatch]:
        w = Windows.joined(held)
        runs, repeated, later = factors(w)
        w.known = repeated.astype(np.uint8)
        w = w.at(np.nonzero(~later)[0])
        slot = (w.key % np.uint64(n_parts * subs)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        w, slot = w.at(order), slot[order]
        rows = []
        bounds = np.nonzero(np.append(True, slot[1:] != slot[:-1]))[0].tolist() if len(slot) else []
        for a, b in zip(bounds, [*bounds[1:], len(slot)], strict=True):
            k = int(slot[a])
            rows.append((k // subs, k % subs, 0, *w.at(slice(a, b)).pack()))
            if len(rows) >= 256:
                yield _sent(rows)
                rows = []
        # the runs found here pass through the index's tasks unchanged
        for k, i in enumerate(range(0, len(runs), 1 << 14)):
            rows.append(((k + int(runs["row"]["b"][i])) % n_parts, subs, 1, runs[i : i + (1 << 14)].tobytes(), b""))
        if rows:
            yield _sent(rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches):
            found = windows_of(Words.of(batch.column(1)), _rows_of(batch), window, anchor, hot)
            if len(found):
                held.append(found)
                n += len(found)
            if n >= most:
                yield from send(held)
                held, n = [], 0
        if held:
            yield from send(held)

    return scan


def _runs(runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(runs), 1 << 15):
        part = runs[i : i + (1 << 15)]
        columns = (part["row"]["a"], part["row"]["b"], part["start"], part["n"], part["source"]["a"], part["source"]["b"], part["source_start"])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["ka", "kb", "start", "n", "source_ka", "source_kb", "source_start"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's blocks, one after the other; the rows come sorted by block."""
    held: list[Windows] = []
    sub = -1
    for batch in batches:
        subs, kinds = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for k in range(batch.num_rows):
            if subs[k] != sub:
                if held:
                    yield from _runs(factors(Windows.joined(held))[0])
                held, sub = [], subs[k]
            heads = batch.column(3)[k].as_py()
            if kinds[k] == 1:
                yield from _runs(np.frombuffer(heads, RUN))
            else:
                held.append(Windows.unpack(heads, batch.column(4)[k].as_py()))
    if held:
        yield from _runs(factors(Windows.joined(held))[0])


def _counter(window: int, anchor: int, most: int = 1 << 18):
    """(anchor, its runs of windows, its windows): each anchor once for so many runs."""

    def told(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        names, which = np.unique(keys, return_inverse=True)
        runs, windows = np.bincount(which), np.bincount(which, n).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(runs), pa.array(windows)], ["key", "runs", "windows"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, 0):
            words = Words.of(batch.column(0))
            at, keys = anchors_of(words, words.hashes(), window, anchor)
            if len(at):
                first = np.nonzero(np.append(True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1)))[0]
                held.append((keys[first], np.diff(np.append(first, len(keys)))))
                n += len(first)
            if n >= most:
                yield told(held)
                held, n = [], 0
        if held:
            yield told(held)

    return count


def _hot(spark: SparkSession, texts: DataFrame, window: int, anchor: int, hot: int, most: int = 1 << 20) -> tuple[np.ndarray, int]:
    """(sorted anchors with over `hot` runs, at most `most` of them; the number of all windows)."""
    counted = texts.mapInArrow(_counter(window, anchor), "key long, runs long, windows long")
    counted = stored(spark, counted.groupBy("key").agg(F.sum("runs").alias("runs"), F.sum("windows").alias("windows")).groupBy((F.col("runs") > hot).alias("hot"), F.when(F.col("runs") > hot, F.col("key")).alias("key")).agg(F.sum("runs").alias("runs"), F.sum("windows").alias("windows")), "anchors")
    total = counted.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    keys = [r["key"] for r in counted.where("hot").orderBy(F.desc("runs"), "key").limit(most).select("key").collect()]  # 8 MB at most
    return np.sort(np.array(keys, np.int64).view(np.uint64)), total


def repeated_factors(docs: DataFrame, *, window: int = 35, anchor: int = 8, most_windows: int = 1 << 20, block_windows: int = 1 << 19, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ka, kb (row_key of id and text), start and n (windows), and the source's source_ka, source_kb, source_start: the factors of
    all documents."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    keys, total = _hot(spark, docs.select(text), window, anchor, hot)
    n_parts, subs = parts_for(spark, total, block_windows)
    ka, kb = row_key(id_col, text_col)
    sent = docs.select(ka, text, kb).mapInArrow(_scanner(n_parts, subs, window, anchor, most_windows, keys), SENT)
    sent = sent.repartitionById(n_parts, F.col("part")).sortWithinPartitions("sub")
    return sent.mapInArrow(_index, "ka long, kb long, start int, n int, source_ka long, source_kb long, source_start int")


def _with_spans(docs: DataFrame, window: int, id_col: str, text_col: str, **options) -> tuple[DataFrame, str]:
    """docs with a column of their spans (null: none), and that column's name."""
    a, b, name = unused(docs, "ka", "kb", "spans")
    found = repeated_factors(docs, window=window, id_col=id_col, text_col=text_col, **options)
    # a document's own factors: as many as the document is long, whatever is repeated how often
    spans = found.groupBy(F.col("ka").alias(a), F.col("kb").alias(b)).agg(F.collect_list(F.struct("start", "n")).alias(name))
    ka, kb = row_key(id_col, text_col)
    return docs.withColumns({a: ka, b: kb}).join(spans, [a, b], "left").drop(a, b), name


def _marks(n: int, spans: pa.Scalar, window: int) -> np.ndarray:
    marks = np.zeros(n + 1, np.int32)
    if spans.is_valid:
        values = spans.values
        start, runs = values.field(0).to_numpy(zero_copy_only=False), values.field(1).to_numpy(zero_copy_only=False)
        np.add.at(marks, start, 1)
        np.add.at(marks, np.minimum(start + runs + window - 1, n), -1)
    return np.cumsum(marks[:-1]) > 0


def _kept(text: str, spans: pa.Scalar, window: int) -> tuple[int, int, bytes]:
    """Number of words, of removed words, and the kept ones joined by one space."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not spans.is_valid:
        return len(words), 0, b" ".join(words)
    gone = _marks(len(words), spans, window)
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def removal_digest(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_kept(t, batch.column(2)[k], window) for k, t in enumerate(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in found])],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, spans = _with_spans(docs, window, "doc_id", "text", **options)
    return rows.select("doc_id", F.coalesce("text", F.lit("")), spans).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with repeated passages cut out of their texts; texts without any stay as they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = batch.column(0)
            texts = [_kept(t, spans[k], window)[2].decode("utf-8", "surrogatepass") if spans[k].is_valid else t for k, t in enumerate(batch.column(1).to_pylist())]
            columns = [pa.array(texts, pa.string()) if n == text_col else c for n, c in zip(batch.schema.names[2:], batch.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[2:])

    rows, name = _with_spans(docs, window, id_col, text_col, **options)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(F.col(name), F.col(f"`{text_col}`").alias(f"{name}_text"), *columns).mapInArrow(cut, docs.schema)
