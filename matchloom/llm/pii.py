"""Personal data: pattern-based spans, and more by a skip-chain conditional random field.

The base spans are emails, IPv4 addresses, payment cards (Luhn) and phone numbers; each kind is matched from the left without
overlaps, and matches that fail their check are dropped. They always stay.

The field's nodes are the words with a digit or an @ (candidates) and up to three words before each, so prose without them has
none. A node is plain, a cue (a word that announces something personal, or links it to what follows), contrary (one that
announces something else, such as a commit) or a value. What a candidate looks like never makes it a value by itself: a
node's own potential is linear in its shape and in which list its word is in, neighbours share a chain potential over their two
labels, and candidates that are the same value - the same letters and digits however they are written - share a skip
potential, from each to the next, so the graph grows with the text and not with the square of a value's count. Loopy
sum-product passes messages over both, so a cue reaches the value behind it and every other place of that value; candidates
likelier a value than anything else become spans of kind ``id`` unless a base span covers them. Each document's messages go on
until its own have settled, or for ``MOST_ROUNDS`` rounds, so a result does not depend on the documents beside it. Weights are
fitted by likelihood, with the same messages, on sentences built here from a seed (``training_texts``; its n is the bound).

Cases: null or empty text: no spans. Very long texts, and long runs of digits, plus signs or @: linear time. Ties: a value must
be likelier than each other label. Spans are in code points, end exclusive. Repeated rows: equal results. Empty table: no rows.
Other columns: ignored by find_pii, kept by masked.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm.common import doc_rows, slices

KINDS = ("email", "ip", "card", "phone", "id")
_RANK = {k: i for i, k in enumerate(KINDS)}

# what may stand before the @, from its end backwards; and the domain after it
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a digit run either is followed by a dot or not, so an address can only begin where its run of digits begins
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost, non-overlapping: each @ takes all the characters before it that may belong to it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By start, then kind."""
    out = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m.group().split("."))):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]]))


#: Words that announce a personal value or a secret, words that announce some other number, and words between.
CUES = set("token key secret password passwd pwd account iban ssn phone tel mobile call fax email mail contact login user customer member patient pin card license passport apikey credential auth".split())
CONTRARY = set("commit sha sha1 sha256 md5 checksum hash digest revision build version release isbn issn order invoice page chapter figure table line item part model sku ticket issue bug year".split())
LINKS = set("is was are of no nr number id for the my your his her our".split())
PLAIN, CUE, AGAINST, VALUE = range(4)
FEATURES = ("bias", "covered", "has @", "digits 1-3", "digits 4-6", "digits 7+", "hex 16+", "letters and digits", "plain number", "quoted", "cue word", "contrary word", "link word", "other word")
MOST_ROUNDS = 100
_WORD = re.compile(r"[^\x20\x09-\x0D=:\"']+")
_CANDIDATE = re.compile(r"[^\x20\x09-\x0D=:\"']*[0-9@][^\x20\x09-\x0D=:\"']*")
_NAME = re.compile(r"[a-z0-9]+")


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and not (text[start].isalnum() or text[start] in "+@("):
        start += 1
    while end > start and not (text[end - 1].isalnum() or text[end - 1] in ")@"):
        end -= 1
    return start, end


class Nodes:
    """A text's nodes in order: places, features, values ("" for a word that only stands before a candidate), and edges."""

    def __init__(self, text: str, spans: list[Span]):
        self.places: list[tuple[int, int]] = []
        self.values: list[str] = []
        rows: list[tuple] = []
        k = done = 0
        for m in _CANDIDATE.finditer(text):
            start, end = _trimmed(text, *m.span())
            if start == end:
                continue
            low = max(done, m.start() - 48)
            for word in [w for w in _WORD.finditer(text, low, m.start()) if w.start() > low or low == done or text[low - 1] in "\t\n\v\f\r =:\"'"][-3:]:
                a, b = _trimmed(text, *word.span())
                if a < b:
                    parts = _NAME.findall(text[a:b].lower())[-1:]
                    which = 10 if parts and parts[0] in CUES else 11 if parts and parts[0] in CONTRARY else 12 if parts and parts[0] in LINKS else 13
                    rows.append((1, *(j == which for j in range(1, len(FEATURES)))))
                    self.places.append((a, b))
                    self.values.append("")
            word = text[start:end]
            while k < len(spans) and spans[k][2] <= start:
                k += 1
            covered = any(s[1] < end and s[2] > start for s in spans[max(0, k - 3) : k + 4])
            digits = sum(c in "0123456789" for c in word)
            letters = sum(c.isalpha() for c in word)
            hexed = len(word) >= 16 and letters > 0 and all(c in "0123456789abcdefABCDEF" for c in word)
            rows.append((1, covered, "@" in word, 0 < digits < 4, 4 <= digits < 7, digits >= 7, hexed, digits > 2 and letters > 2, digits == len(word), text[start - 1 : start] in ("'", '"'), False, False, False, False))
            self.places.append((start, end))
            number = "".join(c for c in word if c in "0123456789")
            self.values.append(number if len(number) >= 7 and letters == 0 else "".join(_NAME.findall(word.lower())) or word)
            done = end
        self.x = np.array(rows, np.float64).reshape(len(rows), len(FEATURES))
        chain, skip, last = [], [], {}
        for i, ((start, _), value) in enumerate(zip(self.places, self.values, strict=True)):
            if i:
                gap = text[self.places[i - 1][1] : start] if start - self.places[i - 1][1] <= 40 else "x"
                if not any(c.isalnum() for c in gap):
                    chain.append((i - 1, i))
            if len(value) >= 6:
                if value in last:
                    skip.append((last[value], i))
                last[value] = i
        self.chain, self.skip = np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


class _Edges:
    """Chain and skip edges, each as two directed ones, over which messages are passed."""

    def __init__(self, chain: np.ndarray, skip: np.ndarray):
        self.chain, self.skip = chain, skip
        n, m = len(chain), len(skip)
        self.source, self.target = (np.concatenate([chain[:, i], chain[:, j], skip[:, i], skip[:, j]]) for i, j in ((0, 1), (1, 0)))
        self.kind = np.repeat([0, 1, 2], [n, n, 2 * m])
        self.back = np.concatenate([np.arange(n) + n, np.arange(n), 2 * n + m + np.arange(m), 2 * n + np.arange(m)])

    def _total(self, own: np.ndarray, message: np.ndarray) -> np.ndarray:
        return own + np.stack([np.bincount(self.target, message[:, k], minlength=len(own)) for k in range(4)], axis=1)

    def passed(self, own: np.ndarray, chain: np.ndarray, skip: np.ndarray, group: np.ndarray, message: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """(log messages, log beliefs) of loopy sum-product, damped by half. A group's
        messages stay as they are once none of them moves by 1e-6."""
        if not len(self.source):
            return message, own
        message, live = message.copy(), np.arange(len(self.source))
        potential = np.stack([chain, chain.T, skip])
        for _ in range(rounds):
            total = self._total(own, message)
            sent = (total[self.source[live]] - message[self.back[live]])[:, :, None] + potential[self.kind[live]]
            top = sent.max(axis=1)
            new = np.log(np.exp(sent - top[:, None, :]).sum(axis=1)) + top
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - message[live]).max(axis=1)
            message[live] = (message[live] + new) / 2
            most = np.zeros(int(group.max()) + 1)
            np.maximum.at(most, group[self.source[live]], moved)
            live = live[most[group[self.source[live]]] >= 1e-6]
            if not len(live):
                break
        return message, self._total(own, message)

    def expected(self, total: np.ndarray, message: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the pairs of labels are expected along chain and skip edges."""
        out, at = [], 0
        for edges, potential in ((self.chain, chain), (self.skip, skip)):
            e = at + np.arange(len(edges))
            a = (total[self.source[e]] - message[self.back[e]])[:, :, None] + potential + (total[self.target[e]] - message[e])[:, None, :]
            p = np.exp(a - a.max(axis=(1, 2), keepdims=True)) if len(e) else np.zeros((0, 4, 4))
            out.append((p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0))
            at += 2 * len(edges)
        return out[0], out[1]


class Field:
    """Weights of the features for each label, and log potentials over two labels along chain (left, right) and skip edges."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    @classmethod
    def fitted(cls, texts: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 80, rate: float = 0.2, decay: float = 0.0003, rounds: int = 6) -> Field:
        """Gradient ascent on the likelihood: how often features, and pairs of labels along edges, are seen, less how often the
        field expects them by its own messages (`rounds` of them, begun from the last step's)."""
        xs, ys, chains, skips, at = [], [], [], [], 0
        for text, told in texts:
            nodes = Nodes(text, base_spans(text))
            xs.append(nodes.x)
            ys += [next((y for a, b, y in told if a < end and b > start), PLAIN) for start, end in nodes.places]
            chains.append(nodes.chain + at)
            skips.append(nodes.skip + at)
            at += len(nodes.places)
        x, y = np.vstack(xs), np.array(ys)
        edges = _Edges(np.vstack(chains), np.vstack(skips))
        n, one = len(y), np.eye(4)
        seen = [x.T @ one[y], *(one[y[i]].T @ one[y[j]] for i, j in (edges.chain.T, edges.skip.T))]
        what = [np.zeros_like(s) for s in seen]
        mean, square = [[np.zeros_like(s) for s in seen] for _ in range(2)]
        message = np.zeros((len(edges.source), 4))
        group = np.zeros(n, np.int64)
        for step in range(1, steps + 1):
            own = x @ what[0]
            message, total = edges.passed(own, what[1], what[2], group, message, rounds)
            likely = np.exp(total - total.max(axis=1, keepdims=True))
            likely /= likely.sum(axis=1, keepdims=True)
            chain, skip = edges.expected(total, message, what[1], what[2])
            slopes = [seen[0] - x.T @ likely, seen[1] - chain, seen[2] - skip]
            slopes[2] = (slopes[2] + slopes[2].T) / 2
            for k, slope in enumerate(slopes):
                g = slope / n - decay * what[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                what[k] = what[k] + rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
        return cls(*what)

    def without_edges(self) -> Field:
        return Field(self.weights, 0 * self.chain, 0 * self.skip)

    def beliefs(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The log marginal (up to a constant) of each node's labels. group: which document a node is of, from 0."""
        edges = _Edges(chain, skip)
        return edges.passed(x @ self.weights, self.chain, self.skip, group, np.zeros((len(edges.source), 4)), MOST_ROUNDS)[1]


def training_texts(n: int = 300, seed: int = 23) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n texts with (start, end, label) of what is not plain in them: contact data, ids and secrets behind their cues and again
    without any, among hashes, orders, years, amounts and codes."""
    r = random.Random(seed)
    syllables = "an re ta li on er mi so ve ku da lo pe ri ten sha".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))
    number = lambda k: "".join(r.choices("0123456789", k=k))
    hexed = lambda: "".join(r.choices("0123456789abcdef", k=r.choice((16, 24, 32, 40))))
    mixed = lambda: "".join(r.choices("ABCDEFGHJKMNPabcdefghkmnp0123456789", k=r.randint(8, 32))) + number(3)
    secret = lambda: r.choice((hexed, hexed, mixed, lambda: r.choice("ABCDX") + number(r.randint(7, 10)), lambda: number(r.randint(7, 12))))()

    def card() -> str:
        body = "4" + number(14)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    out = []
    for _ in range(n):
        parts: list[str] = []
        told: list[tuple[int, int, int]] = []

        def put(text: str, label: int = PLAIN, parts: list[str] = parts, told: list[tuple[int, int, int]] = told) -> None:
            at = sum(map(len, parts))
            if label != PLAIN:
                told.append((at, at + len(text), label))
            parts.append(text)

        def announced(words: list[str], label: int, value: str, kind: int, put=put) -> None:
            put(r.choice((str, str.capitalize, str.upper))(r.choice(words)), label)
            for link in r.choice(((), (), ("number",), ("is",), ("id", "is"), ("no",))):
                put(" ")
                put(link, label)
            put(r.choice((" ", ": ", " = ", "=", " - ")) if r.random() < 0.8 else " ")
            quote = r.choice(("", "", '"', "'"))
            put(quote)
            put(value, kind)
            put(quote + r.choice((" ", ". ", ", ", "!! ")))

        mine, others = [secret() for _ in range(2)], [secret() for _ in range(2)]
        cued: list[str] = []
        against: list[str] = []
        for _ in range(r.randint(1, 9)):
            put(" ".join(word() for _ in range(r.randint(2, 9))) + " ")
            x = r.random()
            if x < 0.28:
                cued.append(r.choice(mine))
                announced(sorted(CUES), CUE, cued[-1], VALUE)
            elif x < 0.40 and cued:
                put(r.choice((str, str.upper, str.lower))(r.choice(cued)), VALUE)
                put(r.choice((" ", ". ")))
            elif x < 0.55:
                against.append(r.choice(others))
                announced(sorted(CONTRARY), AGAINST, against[-1], PLAIN)
            elif x < 0.63 and against:
                put(r.choice(against) + " ")
            elif x < 0.71:
                put(secret() + " ")
            elif x < 0.79:
                put(r.choice((lambda: f"{word()}.{number(2)}@mail{number(1)}.example.com", card, lambda: f"+1 ({number(3)}) 555-{number(4)}"))(), VALUE)
                put(" ")
            else:
                put(r.choice((number(4), number(1), number(2), f"{number(2)}.{number(2)}", f"{number(1)},{number(3)}", f"{word()}{number(1)}", number(3) + "%", f"v{number(1)}.{number(1)}", f"{number(2)}:{number(2)}", number(6), f"{number(4)}-{number(2)}-{number(2)}", f"{word()}{number(3)}")) + " ")
        out.append(("".join(parts), told))
    return out


@lru_cache(maxsize=2)
def field(n: int = 300, seed: int = 23) -> Field:
    return Field.fitted(training_texts(n, seed))


def found_in(texts: list[str], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; the messages of all texts of a batch are passed together."""
    base = [base_spans(t) for t in texts]
    out = [(b, b) for b in base]
    seen = [(i, Nodes(t, b)) for i, (t, b) in enumerate(zip(texts, base, strict=True)) if "@" in t or _DIGIT.search(t)]
    seen = [(i, nodes) for i, nodes in seen if nodes.places]
    if not seen:
        return out
    size = [len(nodes.places) for _, nodes in seen]
    at = np.cumsum(size) - size
    chain, skip = (np.vstack([getattr(nodes, k) + a for (_, nodes), a in zip(seen, at, strict=True)]) for k in ("chain", "skip"))
    x = np.vstack([nodes.x for _, nodes in seen])
    belief = model.beliefs(x, chain, skip, np.repeat(np.arange(len(seen)), size))
    likely = (belief[:, VALUE] > np.delete(belief, VALUE, axis=1).max(axis=1)) & (x[:, 1] == 0)
    for (i, nodes), a in zip(seen, at.tolist(), strict=True):
        more = [("id", *place) for k, (place, value) in enumerate(zip(nodes.places, nodes.values, strict=True)) if value and likely[a + k]]
        if more:
            out[i] = (base[i], sorted(base[i] + more, key=lambda s: (s[1], _RANK[s[0]])))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", training: int = 300, seed: int = 23) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans. No shuffle."""
    model = field(training, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = found_in(batch.column(1).to_pylist(), model)
            counts = [pa.array([sum(s[0] == kind for s in b) for b, _ in found], pa.int64()) for kind in KINDS[:4]]
            digests = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([written(s) for _, s in found], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def without_spans(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans replaced by its first span's kind in brackets."""
    parts, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, *, text_col: str = "text", training: int = 300, seed: int = 23) -> DataFrame:
    """docs with the spans in its text masked; null texts stay null, other columns as they are."""
    model = field(training, seed)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            found = found_in([t or "" for t in texts], model)
            new = pa.array([t if t is None else without_spans(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string())
            yield batch.set_column(at, batch.schema.field(at).name, new)

    return docs.mapInArrow(run, docs.schema)
