"""Quality rules: counts of the text itself, and its divergence from what its language looks like.

Base rules fail a text with fewer than 50 words, or with over half of its words in 3-word runs that the text repeats. A
text that passes is compared with its language's reference by Jensen-Shannon distance (base 2, so 0 to 1), for the
histogram of character classes and for that of common words. References are sums over all documents of the language.

Guards: a language with under ``least_reference`` words, and a text with under ``least_words`` words, get no verdict and
are kept if the base rules keep them. The common-word distance asks for ``least_common_words`` words besides, as few words
say little about rates.

The references are one short row per language. They are taken to the driver only after their number is checked against
``most_languages`` (16,384 rows of under 1 KB), and raise if there are more.

Cases: null text: no words, base_failed. Null language: a language of its own, named "". Repeated rows get equal results.
Empty table: no rows. Very long texts: time and memory in proportion to the text. Other columns are ignored by
quality_columns, and passed through unread by keep_good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import slices
from matchloom.llm.words import GAP, Words

#: Common words of the languages at hand, and the characters that count as symbols.
COMMON = """
the of and to in is that it was for on are with be by a an as this from or at
le la les de des du un une et en est que qui dans pour sur au aux avec il elle ne pas par
der die das und in zu den von mit ist im für auf ein eine nicht sich des dem als auch es
el la los las de del un una y en que es por con para se no su al lo como más
""".split()
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "gap", "stop", "symbol", "other mark", "beyond ASCII")

_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[GAP] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[128:] = 7
_GAPS = bytes(np.nonzero(GAP)[0].tolist())
_SPOKEN = (_CLASS < 3) | (_CLASS == 7)


def _hashes_of(words: list[str]) -> np.ndarray:
    return Words.of(pa.array(list(words), pa.large_string())).hashes()


_COMMON_WORDS = sorted(set(COMMON))
_COMMON_HASH = np.sort(_hashes_of(_COMMON_WORDS))
N_CLASSES, N_WORDS = len(CLASSES), len(_COMMON_HASH) + 2  # and other words, and words without a letter or digit


def _per_text(words: Words, flags: np.ndarray) -> np.ndarray:
    """How many bytes of each text have the flag."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(sums[np.concatenate([[0], words.text_ends])])


def histograms(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character classes (continuation bytes aside) and common words of each text."""
    n = len(words.text_ends)
    text_of = np.repeat(np.arange(n), np.diff(np.concatenate([[0], words.text_ends])))
    lead = (words.data & 0xC0) != 0x80
    chars = np.bincount(text_of[lead] * N_CLASSES + _CLASS[words.data[lead]], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    at = np.minimum(np.searchsorted(_COMMON_HASH, hashes), len(_COMMON_HASH) - 1)
    bins = np.where(_COMMON_HASH[at] == hashes, at, N_WORDS - 2)
    spoken = np.concatenate([[0], np.cumsum(_SPOKEN[words.data])])
    bins[spoken[words.end] == spoken[words.begin]] = N_WORDS - 1
    return chars, np.bincount(words.text_of * N_WORDS + bins, minlength=n * N_WORDS).reshape(n, N_WORDS)


def _repeated(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows of keys occur twice or more. Sorted by the first two keys; where rows that share those differ in others (two
    runs with one hash), by all."""
    order = np.lexsort((keys[0], keys[1]))
    alike = [k[order][1:] == k[order][:-1] for k in keys]
    same = np.logical_and.reduce(alike)
    if (same != (alike[0] & alike[1])).any():
        order = np.lexsort(keys)
        same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    n, data = len(words.text_ends), words.data
    inside = ~GAP[data]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": words.counts, "word_chars": _per_text(words, inside & ((data & 0xC0) != 0x80)), "n_symbols": _per_text(words, symbol[data]), "n_dup_lines": np.zeros(n, np.int64)}

    raw, ends = data.tobytes(), words.text_ends.tolist()
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(_GAPS)] if 10 in data[a:b] else ()
        out["n_dup_lines"][k] = len(lines) - len(set(lines))

    # runs of three words within a text, by the words' identities: those that share a hash are compared word by word
    at, runs = words.windows(3, hashes)
    twice = at[_repeated((runs, words.text_of[at], hashes[at], hashes[at + 1], hashes[at + 2]))]
    marks = np.zeros(len(words.begin) + 1, np.int32)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + 3, -1)
    out["n_repeat_words"] = np.bincount(words.text_of[np.cumsum(marks[:-1]) > 0], minlength=n)
    return out


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Of each row of counts to its row of reference counts; 0 where either is empty."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = reference / np.maximum(reference.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)
        out = np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))
    return np.where((counts.sum(axis=1) > 0) & (reference.sum(axis=1) > 0), out, 0.0)


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))


def language_references(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", most_languages: int = 16_384) -> dict[str, np.ndarray]:
    """Per language the summed histograms (character classes, then common words) of all its documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            words = Words.of(batch.column(1))
            both = np.hstack(histograms(words, words.hashes()))
            for lang, at in _groups(batch.column(2)):
                sums[lang] = sums.get(lang, 0) + both[at].sum(axis=0)
        langs = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([sums[x].tolist() for x in langs], pa.list_(pa.int64()))], ["lang", "counts"])

    parts = _rows(docs, id_col, text_col, lang_col).mapInArrow(count, "lang string, counts array<long>")
    sums = parts.select("lang", F.posexplode("counts")).groupBy("lang", "pos").agg(F.sum("col").alias("n"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("counts")).limit(most_languages + 1).collect()
    if len(rows) > most_languages:
        raise ValueError(f"over {most_languages} languages: is {lang_col} a language?")
    return {r["lang"]: np.array([x["n"] for x in r["counts"]], np.int64) for r in rows}


def _groups(column: pa.Array) -> list[tuple[str, np.ndarray]]:
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return [(name, np.nonzero(codes == k)[0]) for k, name in enumerate(coded.dictionary.to_pylist())]


class Rules:
    """The verdicts for batches of texts. Thresholds are distances between 0 and 1."""

    def __init__(self, references: dict[str, np.ndarray], *, most_char_distance: float = 0.31, most_word_distance: float = 0.43, least_words: int = 50, least_common_words: int = 50, least_reference: int = 5000):
        self.references, self.most_char, self.most_word = references, most_char_distance, most_word_distance
        self.least_words, self.least_common, self.least_reference = least_words, least_common_words, least_reference

    def judged(self, text: pa.Array, lang: pa.Array) -> dict[str, np.ndarray]:
        words = Words.of(text)
        hashes = words.hashes()
        out = base_counts(words, words.identities())
        n = out["n_words"]
        out["base_failed"] = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
        chars, common = histograms(words, hashes)
        known = np.zeros((len(n), N_CLASSES + N_WORDS), np.int64)
        for name, at in _groups(lang):
            if name in self.references:
                known[at] = self.references[name]
        js_chars, js_words = js_distance(chars, known[:, :N_CLASSES]), js_distance(common, known[:, N_CLASSES:])
        rated = (n >= self.least_words) & (known[:, N_CLASSES:].sum(axis=1) >= self.least_reference)
        far = rated & ((js_chars > self.most_char) | (n >= self.least_common) & (js_words > self.most_word))
        out["kept"] = ~out["base_failed"] & ~far
        return out | {"js_chars": js_chars.round(6), "js_words": js_words.round(6)}


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FLAGS, _FLOATS = ("base_failed", "kept"), ("js_chars", "js_words")


def quality_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **thresholds) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, js_chars and js_words: one row per row of docs."""
    rules = Rules(language_references(docs, lang_col=lang_col, text_col=text_col, id_col=id_col), **thresholds)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = rules.judged(batch.column(1), batch.column(2))
            columns = [pa.array(found[k].astype(np.int64)) for k in _LONGS] + [pa.array(found[k]) for k in (*_FLAGS, *_FLOATS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_LONGS, *_FLAGS, *_FLOATS])

    schema = ", ".join(["doc_id long", *(f"{k} long" for k in _LONGS), *(f"{k} boolean" for k in _FLAGS), *(f"{k} double" for k in _FLOATS)])
    return _rows(docs, id_col, text_col, lang_col).mapInArrow(judge, schema)


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **thresholds) -> DataFrame:
    """The rows of docs that are kept, with all their columns; no shuffle."""
    rules = Rules(language_references(docs, lang_col=lang_col, text_col=text_col, id_col=id_col), **thresholds)
    at_text, at_lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at_text):
            text = batch.column(at_text).cast(pa.large_string()).fill_null("")
            found = rules.judged(text, batch.column(at_lang).cast(pa.string()).fill_null(""))
            yield batch.filter(pa.array(found["kept"]))

    return docs.mapInArrow(keep, docs.schema)
