"""Similarity of two strings or vectors. Set and vector measures are native; edit-based ones are Arrow UDFs that work on
each distinct pair of a batch once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _jaccard_of(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of white-space tokens; 0 if either has none."""
    return _jaccard_of(_words(a), _words(b))


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Of character n-grams; of tokens if either string is shorter than n."""
    short = (F.length(a) < n) | (F.length(b) < n)
    pad = lambda c: F.when(F.length(c) < n, F.lit("x" * n)).otherwise(c)  # noqa: E731  sequence() must not run backwards
    return F.when(short, token_jaccard(a, b)).otherwise(_jaccard_of(_grams(pad(a), n), _grams(pad(b), n)))


def regex_jaccard(a: Column, b: Column) -> Column:
    """Of lower-case runs of word characters."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1)))
    return _jaccard_of(found(a), found(b))


def tri_state(a: Column, b: Column) -> Column:
    """-1 if either is missing or empty, 1 if equal, else 0."""
    missing = F.coalesce(a, F.lit("")) == ""
    missing = missing | (F.coalesce(b, F.lit("")) == "")
    return F.when(missing, -1).when(a == b, 1).otherwise(0)


def both_equal(a: Column, b: Column) -> Column:
    """1 if equal and not empty, else 0."""
    return F.when((F.coalesce(a, F.lit("")) != "") & (a == b), 1).otherwise(0)


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter by longer; 0 if both are empty."""
    x, y = F.length(F.coalesce(a, F.lit(""))), F.length(F.coalesce(b, F.lit("")))
    return F.when(F.greatest(x, y) == 0, 0.0).otherwise(F.least(x, y) / F.greatest(x, y))


def any_empty(a: Column, b: Column) -> Column:
    return ((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length or is missing."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def cascade_score(retrieval: Column, jaccard: Column, sort_ratio: Column, weights: tuple[float, float, float] = (0.60, 0.20, 0.20), legacy_scale: bool = False) -> Column:
    """Weighted sum. legacy_scale maps negative retrieval scores s to (s + 1) / 2, which is not monotone; else they are 0."""
    low = (retrieval + 1) / 2 if legacy_scale else F.lit(0.0)
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(retrieval >= 0, retrieval).otherwise(low)))
    return weights[0] * scaled + weights[1] * jaccard + weights[2] * sort_ratio


# ---- edit-based measures, by published definitions ----


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, a bit of one integer per character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (len a + len b); two empty strings: 100."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common tokens and the common tokens with either rest; either side without tokens: 0."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and (not left or not right):
        return 100.0
    base, one, two = " ".join(common), " ".join(left), " ".join(right)
    with_one, with_two = f"{base} {one}".strip(), f"{base} {two}".strip()
    best = indel_ratio(with_one, with_two)
    return max(best, indel_ratio(base, with_one), indel_ratio(base, with_two)) if base else best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, windows that overhang its ends included."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    chars = set(a)
    best = 0.0
    for start in range(1 - n, len(b)):
        window = b[max(0, start) : start + n]
        edge = window[-1] if start + n <= len(b) else window[0]
        if edge in chars:
            best = max(best, indel_ratio(a, window))
            if best == 100.0:
                break
    if len(a) == len(b) and best < 100.0:
        best = max(best, *(indel_ratio(b, a[max(0, s) : s + n]) for s in range(1 - n, n)))
    return best


def _jaro(a: str, b: str, whole_swaps: bool) -> float:
    """whole_swaps: an odd misplaced character counts for nothing, as libraries have it; else it is half a swap."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    ours = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                ours.append(c)
                break
    m = len(ours)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(ours, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    swaps = swaps // 1 if whole_swaps else swaps
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def _shared_start(a: str, b: str) -> int:
    n = 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def jaro_winkler(a: str, b: str) -> float:
    """The start always counts."""
    j = _jaro(a, b, False)
    return j + _shared_start(a, b) * 0.1 * (1 - j)


def jaro_winkler_gated(a: str, b: str) -> float:
    """The start counts above 0.7 only; swaps are whole."""
    j = _jaro(a, b, True)
    return j + _shared_start(a, b) * 0.1 * (1 - j) if j > 0.7 else j


def _vectorised(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in known:
                known[pair] = float(f(*pair))
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return lambda a, b: measure(a, b)


def _lazy(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """The UDF is made when first used, as there is no session at import."""
    made: list = []

    def column(a: Column, b: Column) -> Column:
        if not made:
            made.append(_vectorised(f))
        return made[0](a, b)

    return column


ratio_column = _lazy(indel_ratio)
token_sort_column = _lazy(token_sort_ratio)
token_set_column = _lazy(token_set_ratio)
partial_column = _lazy(partial_ratio)
jaro_winkler_column = _lazy(jaro_winkler)
jaro_winkler_gated_column = _lazy(jaro_winkler_gated)
