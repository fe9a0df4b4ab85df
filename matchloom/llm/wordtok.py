"""Whole texts through the tokenizers library, at the price of each distinct word once.

The tokenizer of ``word_bpe_49k.json`` drops white space and never joins anything across it, so a text's ids are those
of its space-separated pieces in order. Pieces go through the library once and are kept in a bounded table; texts are
put together with numpy. tests/llm compares the ids with those of whole texts.
"""

from __future__ import annotations

import os
import re
from itertools import islice, repeat

import numpy as np

#: Pieces that normalisation and splitting leave as they are: they go to the library's model directly.
_PLAIN = re.compile(r"[a-z\xe0-\xf6\xf8-\xff]+").fullmatch

#: Letters and then marks: two pieces, whatever the marks, as none of them is the apostrophe that some splits begin with.
_MARKED = re.compile(r"([a-z\xe0-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable ones stand for themselves, the others
    follow from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


_LETTERS = byte_letters()


def _spelled(w: str) -> str:
    """As the vocabulary writes the word's bytes."""
    return w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS)



def _tables() -> tuple[bytes, bytes]:
    """For Latin-1 bytes: lower case with line ends as spaces; and the kind: letter or digit a, space, [.,] as full stop,
    anything else an exclamation mark."""
    letters = [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]
    low = bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or b in letters else 32 if b == 10 else b for b in range(256))
    own = {*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", *letters, *range(0xDF, 0xF7), *range(0xF8, 0x100)}
    kind = bytes(97 if b in own else 32 if b in (10, 32) else 46 if b in b".," else 33 for b in range(256))
    return low, kind


_LOW, _KIND = _tables()


class WordEncoder:
    """ids of many texts. most_words bounds the table; when it is full, the half that was learned last goes, as the
    words met first are the frequent ones."""

    def __init__(self, path: str, most_words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most_words = most_words
        self.index: dict[str, int] = {"": 0}
        self.offset = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _forget(self) -> None:
        keep = self.most_words // 2
        self.index = dict(islice(self.index.items(), keep))
        self.used = int(self.offset[keep])

    @staticmethod
    def pieces(text: str) -> list[str]:
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        kind = data.translate(_KIND)
        data = data.translate(_LOW)  # the library lower-cases these characters alike
        # a mark that ends a word is a token of its own, unless another mark stands before it
        if not (b"!. " in kind or b".. " in kind or kind.endswith((b"!.", b".."))):
            data = data.replace(b", ", b" , ").replace(b". ", b" . ")
        return data.decode("latin-1").split(" ")

    def _learn(self, new: list[str]) -> None:
        model = self.tokenizer.model.tokenize
        known, other, flat, counts = [], [], [], []
        for w in new:
            if w.isascii() and w.isalpha() and w.islower():
                tokens = model(w)
            elif _PLAIN(w):
                tokens = model(_spelled(w))
            elif m := _MARKED(w):
                tokens = model(_spelled(m[1])) + model(m[2])
            else:
                other.append(w)
                continue
            known.append(w)
            counts.append(len(tokens))
            flat += [t.id for t in tokens]
        for w, coded in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            ids = coded.ids
            known.append(w)
            counts.append(len(ids))
            flat += ids
        new, total = known, len(flat)
        lengths = np.array(counts, np.int64)
        n, at = len(self.index), self.used
        while n + len(new) > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while at + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at : at + total] = flat
        self.length[n : n + len(new)] = lengths
        self.offset[n : n + len(new)] = at + np.cumsum(lengths) - lengths
        self.index.update(zip(new, range(n, n + len(new)), strict=True))
        self.used += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and the number of ids of each text."""
        if len(self.index) > self.most_words:
            self._forget()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            got = self.pieces(text)
            counts[k] = len(got)
            words += got
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.nonzero(at < 0)[0]):
            unknown = [words[k] for k in new.tolist()]
            self._learn(list(dict.fromkeys(unknown)))
            at[new] = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(new))
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.offset[at] - (ends - lengths), lengths) + np.arange(total)]
        sums = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(sums)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """The place of an installed vocabulary file; looked up where it is used, as executors may keep it elsewhere."""
    import public_tokenizers

    return public_tokenizers.path(name)
