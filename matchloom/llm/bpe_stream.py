"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as an incremental state machine.

Greedy merging by rank gives each byte string one token sequence, and a sequence is that one exactly if each two of its
neighbours could stand side by side (merging their bytes gives the two back). So for each prefix of the input there is one
last token, and the prefix's tokens are a path of such last tokens.

After each byte the transducer's state is the places where a token that is still growing may have begun: for each, how far into
the vocabulary's trie the bytes since lead, and the path of tokens from the last settled point to it. What all these paths
begin with can't change any more, and is emitted at once. How long it can take until they agree is a property of the merge
list: input reaches back through merges each of which takes what the one before it begins with. ``lookahead`` is the longest
such chain (72 tokens for the vocabulary at hand) in bytes. It is computed when a vocabulary is loaded, and it bounds what
is held: a token that ends further back is settled whatever comes, so it leaves, and paths without it are dropped.

A state does not depend on the text before its settled point but for one token, so states recur; each step from a state by a
byte is worked out once and kept in a bounded table, which makes the machine a finite transducer built as it is used. Every
pre-token, short or long, goes through it. Input is split as the vocabulary's pre-tokenizer splits it (the pattern looks one
character ahead); what the machine gave for a run between white space is kept in a bounded table too.

Decoding maps ids to bytes and feeds them to an incremental UTF-8 decoder, which keeps at most three bytes and writes U+FFFD
for what is no UTF-8. Ids of special tokens give their strings.

Cases: null or empty text: no ids, empty text. Very long texts and pre-tokens: time in proportion, constant memory beyond the
text and its ids. Texts with a special token's string: one id, as in the library. Ties: of equal merges the leftmost is
first. Repeated rows: equal results. Empty table: no rows. Other columns: ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from matchloom.llm.common import doc_rows, slices
from matchloom.llm.wordtok import byte_letters, vocabulary

#: Fixed value: how byte-level pre-tokenizers split a text.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space as the library's patterns have it; Python's own \s has U+001C to U+001F besides.
_WS = "\t-\r \x85\xa0  -     　"
#: Runs that are split for themselves: a word with the space before it, or white space.
_RUNS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall


class Vocabulary:
    """Tokens as bytes, merges by pair, and how each token comes about."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letter = {c: b for b, c in byte_letters().items()}
        as_bytes = lambda token: bytes(letter[c] for c in token)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: as_bytes(t) for t, i in told["model"]["vocab"].items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        ids = {b: i for i, b in self.bytes.items() if i not in set(self.special.values())}
        self.ids = ids
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: its two parts and the rank of their merge
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = as_bytes(a), as_bytes(b)
            key = (ids[a], ids[b])
            self.rank.setdefault(key, rank)
            self.made.setdefault(ids[a + b], (*key, rank))
        self.max_token_bytes = max(map(len, ids))
        # the trie: node << 8 | byte to node; the token at each node, -1 for none; and whether more can follow
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for word, i in ids.items():
            node = 0
            for byte in word:
                key = node << 8 | byte
                step = self.child.get(key)
                if step is None:
                    self.inner[node] = True
                    step = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = step
            self.token[node] = i
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._fits: dict[int, bool] = {}
        self.lookahead = self.sufficient_lookahead() * self.max_token_bytes

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """What stands at the token's right (or left) edge while it is being merged: (token, rank that ends it)."""
        kept = self._right if right else self._left
        if token not in kept:
            out: list[tuple[int, float]] = []
            end, t = float("inf"), token
            while True:
                out.append((t, end))
                if t not in self.made:
                    break
                a, b, end = self.made[t]
                t = b if right else a
            kept[token] = out[::-1]
        return kept[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether left and right can be neighbours: no merge across their border comes before those inside them."""
        key = left << 20 | right
        known = self._fits.get(key)
        if known is None:
            known = self._tried(left, right)
            if len(self._fits) > 1 << 19:
                self._fits.clear()
            self._fits[key] = known
        return known

    def _tried(self, left: int, right: int) -> bool:
        ours, theirs = self.edge(left, True), self.edge(right, False)
        i = j = 0
        rank = self.rank
        while True:
            (a, a_ends), (b, b_ends) = ours[i], theirs[j]
            across = rank.get((a, b))
            # of equal merges the leftmost is first: one inside `left` is, one inside `right` isn't
            if across is not None and across < a_ends and across <= b_ends:
                return False
            if a_ends == b_ends == float("inf"):
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def sufficient_lookahead(self) -> int:
        """How many tokens input can reach back: the longest chain of merges, in order of rank, each of which takes on its
        right what the one before it makes, and the token itself."""
        depth: dict[int, int] = {}
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            depth[b] = max(depth.get(b, 1), 1 + depth.get(a, 1))
        return 1 + max(depth.values(), default=1)


#: A place where a token may have begun: (trie node, tokens from the settled point to the place, the token before the place).
Place = tuple[int, tuple[int, ...], int]


class Transducer:
    """Codes one pre-token after another, fed in pieces of any size; feed() gives the tokens that are settled, finish() the rest.

    most_steps bounds the table of steps; a full table is thrown away and built anew.
    """

    def __init__(self, vocabulary: Vocabulary, most_steps: int = 600_000):
        self.v, self.most_steps = vocabulary, most_steps
        self.most_held = self.most_tokens = 0  # bytes and tokens that were held back at once
        self._clear()
        self.state = 0

    def _clear(self) -> None:
        self.places: list[tuple[Place, ...]] = []
        self.number: dict[tuple[Place, ...], int] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._named(((0, (), -1),))

    def _named(self, state: tuple[Place, ...]) -> int:
        known = self.number.setdefault(state, len(self.places))
        if known == len(self.places):
            self.places.append(state)
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state, and what is settled by it."""
        v, out, whole = self.v, [], None
        child, token_at, inner, fits = v.child.get, v.token, v.inner, v._fits.get
        for node, path, before in self.places[state]:  # in the order of their begins, so the first has the shortest path
            node = child(node << 8 | byte)
            if node is None:  # no token goes on like this
                continue
            if whole is None and (token := token_at[node]) >= 0:  # a prefix has one last token
                known = True if before < 0 else fits(before << 20 | token)
                if v.fits(before, token) if known is None else known:
                    whole = (0, (*path, token), token)
            if inner[node]:
                out.append((node, path, before))
        if whole is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        settled, n = whole[1], 0
        if not out:
            n = len(settled)
        elif out[0][1]:
            for x, *others in zip(settled, *(p for _, p, _ in out)):  # noqa: B905  up to the shortest
                if any(y != x for y in others):
                    break
                n += 1
        out.append(whole)
        count = len(settled) - n
        if count > self.most_tokens or count * v.max_token_bytes > v.lookahead:
            self.most_tokens = max(count, self.most_tokens)
            held = sum(len(v.bytes[t]) for t in settled[n:])
            while held > v.lookahead:  # settled all the same: no input reaches further back
                held -= len(v.bytes[settled[n]])
                n += 1
                out = [p for p in out if p[1][:n] == settled[:n]]
            self.most_held = max(self.most_held, held)
        after = tuple([(a, p[n:], b) for a, p, b in out]) if n else tuple(out)
        if len(self.steps) >= self.most_steps:
            self._clear()
            return self._named(after), settled[:n]
        found = self.steps[state << 8 | byte] = (self._named(after), settled[:n])
        return found

    def feed(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state, known, step = self.state, self.steps.get, self._step
        for byte in piece:
            found = known(state << 8 | byte)
            if found is None:
                found = step(state, byte)
                known = self.steps.get
            state, tokens = found
            if tokens:
                out += tokens
        self.state = state
        return out

    def _end(self, state: int, byte: int) -> tuple[int, ...]:
        """What is held back in the state, and the byte: the tokens if the input ends with it. The state that it would lead to is
        not worked out."""
        v = self.v
        for node, path, before in self.places[state]:
            node = v.child.get(node << 8 | byte)
            if node is not None and (token := v.token[node]) >= 0 and (before < 0 or v.fits(before, token)):
                return (*path, token)
        raise ValueError(f"the vocabulary has no token for byte {byte}")

    def word(self, data: bytes) -> tuple[int, ...]:
        """feed(data) and finish() in one; between inputs only."""
        out = self.feed(data[:-1])
        state, self.state = self.state, 0
        return (*out, *self._end(state, data[-1]))

    def finish(self) -> tuple[int, ...]:
        rest = self.places[self.state][-1][1]
        self.state = 0
        return rest


class Coder:
    """Texts to ids and back. most_runs and most_parts bound the tables of coded runs and pre-tokens; when one is full, its later half goes."""

    def __init__(self, path: str, most_runs: int = 700_000, most_parts: int = 50_000):
        self.v = Vocabulary(path)
        self.transducer = Transducer(self.v)
        self.most_runs, self.most_parts = most_runs, most_parts
        self.runs: dict[str, tuple[tuple[int, ...], str]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True)))) if self.v.special else None

    def part(self, text: str) -> tuple[int, ...]:
        """One pre-token."""
        known = self.parts.get(text)
        if known is None:
            known = self.transducer.word(text.encode("utf-8", "surrogatepass"))
            if len(text) <= 64:
                self.parts[text] = known
        return known

    def run(self, text: str) -> tuple[tuple[int, ...], str]:
        if len(text) <= 64 and (text.isalpha() or text[0] == " " and text[1:].isalpha()):  # one pre-token
            ids = self.transducer.word(text.encode())
        else:
            ids = tuple(chain.from_iterable(map(self.part, SPLIT.findall(text))))
        return ids, str(ids)[1:-1].replace(" ", "").rstrip(",")

    def _met(self, run: str) -> tuple[tuple[int, ...], str]:
        entry = self.runs.get(run)
        if entry is None:
            if run[-1] in ".,;:" and run[-2:-1].isalpha():  # the mark is a pre-token of its own
                (ids, told), (mark, mark_told) = self._met(run[:-1]), self._met(run[-1])
                return ids + mark, f"{told},{mark_told}"
            entry = self.run(run)
            if len(run) <= 64:
                self.runs[run] = entry
        return entry

    def coded(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """Ids, and the same written in decimal, of each run of the text."""
        if self.special and any(s in text for s in self.v.special):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += self._plain(text[at : m.start()])
                i = self.v.special[m.group()]
                out.append(((i,), str(i)))
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        found = _RUNS(text)
        known = self.runs
        out = list(map(known.get, found))
        if None in out:
            for k, run in enumerate(found):
                if out[k] is None:
                    out[k] = self._met(run)
            if len(known) > self.most_runs:
                self.runs = dict(islice(known.items(), self.most_runs // 2))
            if len(self.parts) > self.most_parts:
                self.parts = dict(islice(self.parts.items(), self.most_parts // 2))
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for ids, _ in self.coded(text)))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decoded(ids))

    def decoded(self, ids: Iterable[int], step: int = 4096) -> Iterator[str]:
        """The text in pieces; unknown ids give nothing."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table, ids = self.v.bytes.get, iter(ids)
        while some := list(islice(ids, step)):
            yield machine.decode(b"".join([table(i, b"") for i in some]))
        yield machine.decode(b"", True)


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encode_documents(docs: DataFrame, *, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int). No shuffle."""
    path = tokenizer_path or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, *, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, text of a table with doc_id and ids; null ids: null text."""
    path = tokenizer_path or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in slices(batches):
            texts = [None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digest(docs: DataFrame, *, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text and decodes its ids, in one pass."""
    path = tokenizer_path or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                runs = c.coded(text)
                ids = list(chain.from_iterable([x[0] for x in runs]))
                decoded = hashlib.sha256()
                for piece in c.decoded(ids):
                    decoded.update(piece.encode("utf-8", "surrogatepass"))
                rows.append((len(ids), hashlib.sha256(",".join([x[1] for x in runs]).encode()).hexdigest(), decoded.hexdigest()))
            n, coded, back = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
