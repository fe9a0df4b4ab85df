"""Exact Jaccard join of documents on word shingles, by prefixes under several global orders.

Under any fixed order of all shingles, two sets whose Jaccard similarity is at least t share a shingle among the first
n - ceil(t * n) + 1 of each. That holds for each order alone, so a pair must pass it under every one. The orders here put
rare shingles first: the first key is a count from a sketch of fixed size, the second a hash
of the order's own; and one order counts exactly, among the documents that meet. An order only has to be the same for all documents, so neither the sketch's error nor
its saturation can lose a pair; they cost candidates.

1.  A scan gives each document's class (a 128-bit sum over its set; equal sets are one class, linked without comparing) and
    the sketch, which is summed by range and has 2 x 2**23 one-byte counters however large the corpus.
2.  A second scan deals the prefixes under the first order out by shingle. Tasks see which classes share one: lists.
3.  Lists that have a class in common form clusters, found by alternating stars. A cluster's texts meet in one task, or, if
    they have more than ``block_tokens`` shingles, in one task for each block of it, together with a few hubs that all its
    blocks hold. There the other orders' prefixes (one by the sketch's second row, one by the exact counts within the block)
    leave the candidates, whose overlaps are counted from postings. A class that is linked to the block's main component is
    skipped, as the classes outside are compared with it; so thousands of near copies cost a comparison each, and no pair is
    ever made.
4.  Of a cluster in several blocks, the classes that the hubs did not join to its main component are compared with every
    block of it.

Shingles are 64-bit hashes. Classes, and the rows that texts are fetched by, have names of 128 bits; once known, a class goes by
the number of its row in the table of classes, so two classes are never taken for one. Lists are dealt out to as many tasks
and pieces as their counted entries ask for.

Nothing is capped: a pair is left out only if it fails a filter that no true pair fails, or if its two documents are in one
component already. Nothing that grows with the documents is collected.

Cases: null or empty text and text without words: no shingles, a component of its own. Fewer than ``words`` words: the whole
sequence is the one shingle. Null doc_id: joins like any other; it is never a component's id unless the component has no
other (then null). Repeated rows and equal texts: one class. Very long texts: a set of any size is compared like others.
Empty table: no rows. Other columns: ignored by jaccard_components, kept by one_of_each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import parts_for, row_key, slices, stored, unused
from matchloom.llm.words import Words, mixed

ROW_BITS, RANGES = 23, 64
SEEDS = tuple(np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344))  # one order each
CLASS = np.dtype([("c1", "<i8"), ("c2", "<i8")])
HEAD = np.dtype([("node", CLASS), ("n", "<u4"), ("count", "<u4")])


class Sets:
    """The shingle sets of a batch: sorted shingles one set after the other, sizes, and the classes' two halves."""

    def __init__(self, column: pa.Array, words: int):
        w = Words.of(column, lower=True)
        hashes = w.hashes()
        at, codes = w.windows(words, hashes)
        again = w.windows(words, hashes, 1)[1]  # another hash of the same shingles, for the classes' names
        text = w.text_of[at]
        for few in range(1, words):  # a short text is one shingle; its length keeps it apart from longer ones
            short = np.nonzero(w.counts == few)[0]
            if len(short):
                one, code = w.windows(few, hashes)
                chosen = np.searchsorted(one, w.first[short])
                text, codes = np.concatenate([text, short]), np.concatenate([codes, mixed(code[chosen] + np.uint64(few))])
                again = np.concatenate([again, mixed(w.windows(few, hashes, 1)[1][chosen] + np.uint64(few))])
        order = np.argsort(codes)
        order = order[np.argsort(text[order].astype(np.uint16 if len(column) < 1 << 16 else np.int64), kind="stable")]
        codes, text, again = codes[order], text[order], again[order]
        fresh = np.ones(len(codes), bool)
        fresh[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
        self.codes, self.text = codes[fresh], text[fresh]
        self.n = np.bincount(self.text, minlength=len(column))
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.c1, self.c2 = self._sums(mixed(self.codes ^ np.uint64(0xA5A5))), self._sums(mixed(again[fresh] + np.uint64(0x5DEECE66D)))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return mixed(sums[self.first[1:]] - sums[self.first[:-1]] + self.n.astype(np.uint64)).view(np.int64)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of n a similar set must have: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def ranks(codes: np.ndarray, order: int, sketch: np.ndarray) -> np.ndarray:
    """Sort keys of shingles under an order: the sketch's count first, then the order's hash."""
    mask = np.uint64((1 << ROW_BITS) - 1)
    level = np.minimum(*(sketch[k][(mixed(codes ^ seed) & mask).astype(np.int64)] for k, seed in enumerate(SEEDS)))
    return (level.astype(np.uint64) << np.uint64(56)) | (mixed(codes ^ SEEDS[order]) >> np.uint64(8))


def prefixes(sets: Sets, which: np.ndarray, order: int, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, shingle) of each prefix entry of the given sets."""
    chosen = np.zeros(len(sets.n), bool)
    chosen[which] = True
    at = np.nonzero(chosen[sets.text])[0]
    codes, text = sets.codes[at], sets.text[at]
    by = np.argsort(ranks(codes, order, sketch), kind="stable")
    by = by[np.argsort(text[by].astype(np.uint16 if len(sets.n) < 1 << 16 else np.int64), kind="stable")]
    codes, text = codes[by], text[by]
    n = sets.n * chosen
    place = np.arange(len(codes)) - (np.cumsum(n) - n)[text]
    keep = place < (sets.n - needed(sets.n, percent) + 1)[text]
    return text[keep], codes[keep]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ka, kb = row_key(id_col, text_col)
    return docs.select(ka, text.alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), kb)


def _classes(words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(SEEDS), 1 << ROW_BITS), np.uint8)
        for batch in slices(batches):
            s = Sets(batch.column(1), words)
            for k, seed in enumerate(SEEDS):
                places, n = np.unique((mixed(s.codes ^ seed) & np.uint64((1 << ROW_BITS) - 1)).astype(np.uint32), return_counts=True)
                counts[k, places] = np.minimum(counts[k, places].astype(np.int64) + n, 255)
            blank = pa.nulls(len(s.n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), pa.array(s.n, pa.int64()), pa.array(s.c1), pa.array(s.c2), blank, pa.nulls(len(s.n), pa.binary())], ["ka", "kb", "doc_id", "n", "c1", "c2", "range", "counts"])
        pieces = counts.reshape(len(SEEDS), RANGES, -1)
        for r in range(RANGES):
            if pieces[:, r].any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, none, none, pa.array([r], pa.int32()), pa.array([zlib.compress(pieces[:, r].tobytes(), 1)], pa.binary())], ["ka", "kb", "doc_id", "n", "c1", "c2", "range", "counts"])

    return scan


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up a task's ranges one row at a time, then takes logarithms: a byte each."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.column(0)[k].as_py()
            piece = np.frombuffer(zlib.decompress(batch.column(1)[k].as_py()), np.uint8).astype(np.uint64)
            sums[r] = sums.get(r, 0) + piece
    for r, total in sums.items():
        level = np.minimum(255, np.round(8 * np.log2(1.0 + total))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["range", "levels"])


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The whole sketch: 2 x 2**22 bytes in 64 rows, whatever the size of the corpus."""
    parts = scanned.where("range is not null").select("range", "counts").repartitionById(RANGES, F.col("range"))
    out = np.zeros((len(SEEDS), RANGES, (1 << ROW_BITS) // RANGES), np.uint8)
    for r in parts.mapInArrow(_summed, "range int, levels binary").collect():
        out[:, r["range"]] = np.frombuffer(r["levels"], np.uint8).reshape(len(SEEDS), -1)
    return out.reshape(len(SEEDS), -1)


LONG = np.uint32(1 << 31)  # set in a head's n where the shingle's list is long already


def _members(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct classes in order, and the number of each entry's class among them."""
    order = np.lexsort((node["c2"], node["c1"]))
    by = node[order]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (by["c1"][1:] != by["c1"][:-1]) | (by["c2"][1:] != by["c2"][:-1])
    member = np.empty(len(by), np.int64)
    member[order] = np.cumsum(fresh) - 1
    return by[fresh], member


def _joined(code: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a member that stands for all, member) of all members which lists (equal codes) connect: one row per member."""
    names, member = np.unique(member, return_inverse=True)
    order = np.argsort(code, kind="stable")
    member, code = member[order], code[order]
    first = np.nonzero(np.append(True, code[1:] != code[:-1]))[0] if len(code) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(code)))
    label = np.arange(len(names))
    while len(first):
        low = label.copy()
        np.minimum.at(low, member, np.repeat(np.minimum.reduceat(label[member], first), size))
        low = low[low]
        if (low == label).all():
            break
        label = low
    return names[label], names


def _dealer(n_parts: int, subs: int, words: int, percent: int, sketch, most: int, short: int):
    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        node, n, code = (np.concatenate(x) for x in zip(*held, strict=True))
        # a shingle that many classes have here already: they are joined here, and one of them goes on for all
        order = np.argsort(code, kind="stable")
        first = np.nonzero(np.append(True, code[order][1:] != code[order][:-1]))[0]
        size = np.diff(np.append(first, len(code)))
        many = np.zeros(len(code), bool)
        many[order] = np.repeat(size > short, size)
        if many.any():
            known, member = _members(node[many])
            names, nodes = (known[x] for x in _joined(code[many], member))
            for i in range(0, len(nodes), 1 << 16):
                yield _sent([((i >> 16) % n_parts, subs, names[i : i + (1 << 16)].tobytes(), nodes[i : i + (1 << 16)].tobytes())])
            ahead = order[first[size > short]]
            n[ahead] |= LONG
            many[ahead] = False
            node, n, code = node[~many], n[~many], code[~many]
        slot = (code % np.uint64(n_parts * subs)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        node, n, code, slot = node[order], n[order], code[order], slot[order]
        bounds = np.nonzero(np.append(True, slot[1:] != slot[:-1]))[0].tolist() if len(slot) else []
        rows = []
        for a, b in zip(bounds, [*bounds[1:], len(slot)], strict=True):
            k = int(slot[a])
            other = (node["c1"][a + 1 : b] != node["c1"][a : b - 1]) | (node["c2"][a + 1 : b] != node["c2"][a : b - 1])
            first = np.nonzero(np.append(True, other | (n[a + 1 : b] != n[a : b - 1])))[0]
            heads = np.empty(len(first), HEAD)
            heads["node"], heads["n"], heads["count"] = node[a:b][first], n[a:b][first], np.diff(np.append(first, b - a))
            tails = np.ascontiguousarray((code[a:b] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
            rows.append((k // subs, k % subs, heads.tobytes(), tails))
            if len(rows) >= 256:
                yield _sent(rows)
                rows = []
        if rows:
            yield _sent(rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0
        for batch in slices(batches):
            s = Sets(batch.column(1), words)
            fresh = []
            for k in np.nonzero(s.n > 1)[0].tolist():  # a set of one is similar to none but its equals
                if (c := (int(s.c1[k]), int(s.c2[k]))) not in seen:
                    seen.add(c)
                    fresh.append(k)
            text, codes = prefixes(s, np.array(fresh, np.int64), 0, sketch.value, percent)
            node = np.empty(len(text), CLASS)
            node["c1"], node["c2"] = s.c1[text], s.c2[text]
            held.append((node, s.n[text].astype(np.uint32), mixed(codes)))
            size += len(codes)
            if size >= most:
                yield from send(held)
                held, seen, size = [], set(), 0
        if size:
            yield from send(held)

    return deal


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "sub", "heads", "tails"])


def _listed(joined: bool, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 1 << 16):
        x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        columns = [pa.array(np.full(len(x), joined)), *(pa.array(np.ascontiguousarray(c)) for c in (x["c1"], x["c2"], y["c1"], y["c2"]))]
        yield pa.RecordBatch.from_arrays(columns, ["joined", "a1", "a2", "b1", "b2"])


def _lister(percent: int, short: int, subs: int):
    """Classes (a, b) that share a prefix shingle: the pairs of short lists; for long ones (joined) each class with one that
    stands for all that the long lists of a task's piece connect."""
    return lambda batches: _lists(batches, percent, short, subs)


def _lists(batches: Iterator[pa.RecordBatch], percent: int, short: int, joined_sub: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sub = -1

    def close() -> Iterator[pa.RecordBatch]:
        classes, n, code = (np.concatenate(x) for x in zip(*held, strict=True))
        classes, node = _members(classes)
        order = np.lexsort((node, code))
        node, n, code = node[order], n[order], code[order]
        first = np.nonzero(np.append(True, code[1:] != code[:-1]))[0]
        long = np.bitwise_or.reduceat(n, first) & LONG > 0
        n = n & ~LONG
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (node[1:] != node[:-1])
        node, n, code = node[fresh], n[fresh], code[fresh]
        first = np.nonzero(np.append(True, code[1:] != code[:-1]))[0]
        size = np.diff(np.append(first, len(code)))
        long |= size > short
        # short lists as pairs, of which each has a bounded number
        chosen = np.nonzero((size > 1) & ~long)[0]
        pairs = [np.empty(0, np.int64)]
        for k in np.unique(size[chosen]).tolist():
            for i, j in zip(*np.triu_indices(k, 1), strict=True):
                x, y = first[chosen[size[chosen] == k]] + i, first[chosen[size[chosen] == k]] + j
                fit = 100 * np.minimum(n[x], n[y]).astype(np.int64) >= percent * np.maximum(n[x], n[y]).astype(np.int64)
                pairs.append(np.unique(node[x[fit]] * len(classes) + node[y[fit]]))
        both = np.unique(np.concatenate(pairs))
        yield from _listed(False, classes[both // len(classes)], classes[both % len(classes)])
        in_long = np.repeat(long, size)
        names, nodes = _joined(code[in_long], node[in_long])
        yield from _listed(True, classes[names], classes[nodes])

    for batch in batches:
        subs = batch.column(1).to_pylist()
        for k in range(batch.num_rows):
            if subs[k] != sub:
                if held:
                    yield from close()
                held, sub = [], subs[k]
            heads, tails = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
            if subs[k] == joined_sub:  # joined in the scan
                yield from _listed(True, np.frombuffer(heads, CLASS), np.frombuffer(tails, CLASS))
                continue
            head = np.frombuffer(heads, HEAD)
            code = np.zeros((len(tails) // 6, 8), np.uint8)
            code[:, :6] = np.frombuffer(tails, np.uint8).reshape(-1, 6)
            held.append((np.repeat(head["node"], head["count"]), np.repeat(head["n"], head["count"]), code.view("<u8").reshape(-1)))
    if held:
        yield from close()


def _postings(token: np.ndarray, node: np.ndarray, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of each token one after the other, and where each token's begin."""
    order = np.argsort(token, kind="stable")
    return node[order], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=n_tokens))])


def _hits(postings: tuple[np.ndarray, np.ndarray], tokens: np.ndarray, k: int) -> np.ndarray:
    """How many of the tokens each of the k nodes has."""
    nodes, begin = postings
    size = begin[tokens + 1] - begin[tokens]
    at = np.repeat(begin[tokens] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return np.bincount(nodes[at], minlength=k)


def _heads(token: np.ndarray, node: np.ndarray, rank: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, node) of the nodes' prefixes under an order."""
    order = np.lexsort((token, rank, node))
    place = np.arange(len(order)) - (np.cumsum(n) - n)[node[order]]
    keep = order[place < (n - needed(n, percent) + 1)[node[order]]]
    return token[keep], node[keep]


def _similar(a: np.ndarray, b: np.ndarray, sketch: np.ndarray, percent: int) -> bool:
    """The other orders' filter, then the whole sets."""
    for hash_of in (lambda c: c, lambda c: mixed(c ^ SEEDS[1])):  # sets come in the first order; and one of its own
        x, y = (h[: len(h) - int(needed(np.int64(len(h)), percent)) + 1] for h in (np.sort(hash_of(c)) for c in (a, b)))
        if not np.isin(x, y, assume_unique=True).any():
            return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


ASKED, THERE, MAIN = 1, 0, 2


def linked(sets: list[np.ndarray], comp: np.ndarray, role: np.ndarray, sketch: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join each ASKED set with all sets of the block that it is similar to.

    comp: a label for each set; equal labels are joined already. MAIN sets are those of their cluster's main component, in
    which no two need comparing; where all sets are ASKED, the largest component found here takes that part.
    """
    must = role == ASKED
    k = len(sets)
    n = np.array([len(x) for x in sets], np.int64)
    if k == 2 or must.sum() == 1:
        x = int(np.argmax(must))
        fit = (comp != comp[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        return [(x, y) for y in np.nonzero(fit)[0].tolist() if _similar(sets[x], sets[y], sketch, percent)]
    names, token = np.unique(np.concatenate(sets), return_inverse=True)
    node = np.repeat(np.arange(k), n)
    begin = np.concatenate([[0], np.cumsum(n)])
    counts = np.bincount(token)
    by_sketch = ranks(names, 1, sketch)
    heads, shown = [], []
    for rank in (counts[token], by_sketch[token]):
        t, owner = _heads(token, node, rank, n, percent)
        heads.append(_postings(t, owner, len(names)))
        order = np.argsort(owner, kind="stable")
        shown.append((t[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=k))])))
    whole = _postings(token, node, len(names))
    comp = np.unique(comp, return_inverse=True)[1].copy()
    out: list[tuple[int, int]] = []

    def compared(x: int) -> None:
        other = (comp != comp[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        for postings, (tokens, at) in zip(heads, shown, strict=True):
            if not other.any():
                return
            other &= _hits(postings, tokens[at[x] : at[x + 1]], k) > 0
        if not other.any():
            return
        common = _hits(whole, token[begin[x] : begin[x + 1]], k)
        for y in np.nonzero(other & (100 * common >= percent * (n + n[x] - common)))[0].tolist():
            if comp[y] != comp[x]:
                comp[comp == comp[y]] = comp[x]
                out.append((x, y))

    todo = np.nonzero(must)[0]
    for x in todo[:: max(1, len(todo) // 4)].tolist():  # a few first, to see the main component
        compared(x)
    known = np.nonzero(role == MAIN)[0]
    main = int(known[0]) if len(known) else int(np.argmax(np.bincount(comp)[comp])) if must.all() else -1
    for x in todo.tolist():
        if main < 0 or comp[x] != comp[main]:
            compared(x)
    return out


def _resolver(words: int, sketch, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, comps, roles, sets = None, {}, [], [], []

        def close() -> pa.RecordBatch:
            names = list(nodes)
            found = linked(sets, np.array(comps, np.int64), np.array(roles, np.int64), sketch.value, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[a] for a, _ in found], pa.int64()), pa.array([names[b] for _, b in found], pa.int64())], ["a", "b"])

        for batch in slices(batches):  # key, text, c1, c2, node, comp, role; the rows come sorted by key
            s = Sets(batch.column(1), words)
            same = (s.c1 == batch.column(2).to_numpy()) & (s.c2 == batch.column(3).to_numpy())
            rows = zip(batch.column(0).to_pylist(), *(batch.column(k).to_pylist() for k in (4, 5, 6)), same.tolist(), strict=True)
            for i, (this, node, comp, role, fits) in enumerate(rows):
                if this != key:
                    if len(sets) > 1:
                        yield close()
                    key, nodes, comps, roles, sets = this, {}, [], [], []
                if not fits:
                    continue
                if node in nodes:
                    if role == ASKED:
                        roles[nodes[node]] = ASKED
                    continue
                nodes[node] = len(sets)
                comps.append(comp)
                roles.append(role)
                sets.append(s.codes[s.first[i] : s.first[i + 1]])
        if len(sets) > 1:
            yield close()

    return run


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) of every node in links (a, b), by alternating large and small stars."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = stored(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        near = both(edges)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a")
        edges = moved.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stored(spark, edges, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    found = edges.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node")
    return found.unionByName(found.select(F.col("comp").alias("node"), "comp").distinct())


def _met(rows: DataFrame, placed: DataFrame, words: int, sketch, percent: int) -> DataFrame:
    """Links found where the texts of placed (ka, kb, c1, c2, node, comp, role, key) meet by key. A text that a row's key fetches
    though it isn't the row's own has another class, and is passed over."""
    texts = rows.select("ka", "kb", "text").join(placed, ["ka", "kb"]).select("key", "text", "c1", "c2", "node", "comp", "role")
    texts = texts.repartition(F.col("key")).sortWithinPartitions("key")
    return texts.mapInArrow(_resolver(words, sketch, percent), "a long, b long")


def _cluster_links(spark: SparkSession, rows: DataFrame, classes: DataFrame, clusters: DataFrame, pairs: DataFrame, words: int, sketch, percent: int, block_tokens: int, hubs: int = 32) -> DataFrame:
    named = ["ka", "kb", "c1", "c2", "node"]
    members = classes.select(*named, "n").join(clusters, "node").withColumnRenamed("comp", "cluster")
    members = stored(spark, members, "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("k"), F.ceil(F.sum("n") / block_tokens).alias("blocks"))
    members = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members = stored(spark, members, "members")
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("k")) < hubs)
    blocks = F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    placed = members.select(*named, F.col("node").alias("comp"), F.lit(ASKED).alias("role"), "cluster", F.explode(blocks).alias("to"))
    placed = placed.select(*named, "comp", "role", F.xxhash64("cluster", "to").alias("key"))
    # pairs of short lists, unless both meet in a cluster's only block; the first of a pair asks
    near = members.where("blocks = 1").select("node", "cluster")
    apart = pairs.join(near.toDF("a", "ca"), "a", "left").join(near.toDF("b", "cb"), "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b")
    ends = apart.select(F.col("a").alias("node"), F.lit(ASKED).alias("role"), "a").distinct().unionByName(apart.select(F.col("b").alias("node"), F.lit(THERE).alias("role"), "a"))
    ends = ends.join(classes.select(*named), "node").select(*named, F.col("node").alias("comp"), "role", F.xxhash64("a").alias("key"))
    placed = placed.unionByName(ends)
    links = stored(spark, _met(rows, stored(spark, placed, "placed"), words, sketch, percent), "links")

    large = stored(spark, members.where("blocks > 1"), "large")
    if large.isEmpty():
        return links
    large = large.join(components(spark, links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counts = large.groupBy("cluster", "comp").agg(F.count("*").alias("k"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("k", "comp")).getField("comp").alias("main"))
    large = stored(spark, large.join(main, "cluster").withColumn("out", F.col("comp") != F.col("main")), "large")
    outer = large.where("out").groupBy("cluster").agg(F.ceil(F.sum("n") / block_tokens).alias("outers"))
    large = large.join(outer, "cluster")
    columns = [*named, "comp"]
    key = lambda u, j: F.xxhash64("cluster", u, j).alias("key")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asked = large.where("out").withColumn("u", F.pmod(F.xxhash64("node", F.lit(2)), F.col("outers"))).select(*columns, F.lit(ASKED).alias("role"), "cluster", "u", upto("blocks").alias("j"))
    there = large.select(*columns, F.when(F.col("out"), THERE).otherwise(MAIN).alias("role"), "cluster", upto("outers").alias("u"), F.col("block").alias("j"))
    placed = asked.unionByName(there).select(*columns, "role", key("u", "j"))
    return links.unionByName(stored(spark, _met(rows, stored(spark, placed, "placed"), words, sketch, percent), "links"))


def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", most_postings: int = 1 << 20, block_tokens: int = 1 << 20, short_list: int = 32, piece_postings: int = 1 << 19) -> DataFrame:
    """ka, kb (row_key), doc_id, n_shingles, component_id (least doc_id reachable by links of at least `percent`), component (a
    number that it has even where no doc_id is; null for a document without shingles) of every row of docs."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    scanned = stored(spark, rows.mapInArrow(_classes(words), "ka long, kb long, doc_id long, n long, c1 long, c2 long, range int, counts binary"), "shingle-classes")
    sketch = spark.sparkContext.broadcast(_sketch(scanned))
    of_docs = scanned.where("n is not null").select("ka", "kb", "doc_id", "n", "c1", "c2")
    classes = of_docs.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.min(F.struct("ka", "kb")).alias("row"), F.min("n").alias("n"))
    # the numbers are written with the classes, so they are the same whenever they are read
    classes = stored(spark, classes.select("c1", "c2", "least", "row.ka", "row.kb", "n", F.monotonically_increasing_id().alias("node")), "classes")

    entries = of_docs.where("n > 1").agg(F.coalesce(F.sum(F.expr(f"n - (({percent} * n + 99) div 100) + 1")), F.lit(0))).first()[0]
    n_parts, subs = parts_for(spark, entries, piece_postings)
    sent = rows.select("ka", "text").mapInArrow(_dealer(n_parts, subs, words, percent, sketch, most_postings, short_list), "part int, sub int, heads binary, tails binary")
    sent = sent.repartitionById(n_parts, F.col("part")).sortWithinPartitions("sub")
    found = sent.mapInArrow(_lister(percent, short_list, subs), "joined boolean, a1 long, a2 long, b1 long, b2 long").distinct()
    end = lambda x: classes.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col("node").alias(x))
    found = stored(spark, found.join(end("a"), ["a1", "a2"]).join(end("b"), ["b1", "b2"]).select("joined", "a", "b"), "lists")

    lists = found.where("joined").select("a", "b")
    clusters = components(spark, lists)
    links = _cluster_links(spark, rows, classes, clusters, found.where("not joined").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), words, sketch, percent, block_tokens)
    comps = components(spark, links)
    own = classes.select("c1", "c2", "least", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    own = stored(spark, own, "classes")
    low = own.groupBy("comp").agg(F.min("least").alias("component_id"))
    own = own.join(low, "comp").select("c1", "c2", "comp", "component_id")
    out = of_docs.join(own, ["c1", "c2"], "left")
    alone = F.col("n") == 0
    return out.select("ka", "kb", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(~alone, F.col("comp")).alias("component"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs of each component, with all its columns: that with the least doc_id (and row key). Documents without
    shingles are alone and stay; of rows with equal id and text one stays."""
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, **options)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "ka", "kb")).alias("first")
    a, b = unused(docs, "ka", "kb")
    alone = found.where("component is null").select(F.col("ka").alias(a), F.col("kb").alias(b))
    keep = found.where("component is not null").groupBy("component").agg(first).select(F.col("first.ka").alias(a), F.col("first.kb").alias(b))
    ka, kb = row_key(id_col, text_col)
    keyed = docs.withColumns({a: ka, b: kb})
    return keyed.join(stored(docs.sparkSession, keep.unionByName(alone).distinct(), "kept"), [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)
