"""Text normalisation as Column expressions over declarative rule tables. Everything here stays in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-word rules in the order in which they apply; a trailing full stop goes with the word where one may stand.
LEGAL_RULES = (
    (r"\bprivate limited\b", "pvt ltd"),
    (r"\bpvt\.?\s*ltd\.?\b", "pvt ltd"),
    (r"\blimited\b", "ltd"),
    (r"\bltd\.?\b", "ltd"),
    (r"\bcorporation\b", "corp"),
    (r"\binc\.?\b", "inc"),
    (r"\bincorporated\b", "inc"),
    (r"\bllc\.?\b", "llc"),
    (r"\bllp\.?\b", "llp"),
    (r"\bco\.?\b", "company"),
    (r"\bcompany\b", "company"),
)
ADDRESS_RULES = (
    (r"\brd\.?\b", "road"),
    (r"\bst\.?\b", "street"),
    (r"\bave\.?\b", "avenue"),
    (r"\bdr\.?\b", "drive"),
    (r"\bln\.?\b", "lane"),
    (r"\bblvd\.?\b", "boulevard"),
    (r"\bste\.?\b", "suite"),
    (r"\bapt\.?\b", "apartment"),
    (r"\bflr?\.?\b", "floor"),
    (r"\b2nd\b", "second"),
    (r"\b1st\b", "first"),
    (r"\b3rd\b", "third"),
)
#: Literal replacements of the lexical cleaner, in order; they also apply inside words.
LEXICAL_RULES = (("private limited", "pvt ltd"), ("privatelimited", "pvt ltd"), ("limited", "ltd"), ("incorporated", "inc"), ("corporation", "corp"), ("company", "co"))
#: What stands for a missing value, whatever its case.
NULL_WORDS = ("nan", "none", "null")


#: Latin letters that are no letter with a mark, and letters of scripts whose names don't say their sound.
LATIN = dict(zip("ßẞæÆœŒþÞðÐøØłŁđĐħĦıŋŊŧŦ", "ss SS ae AE oe OE th Th d D o O l L d D h H i ng NG t T".split(), strict=True))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщыэюяіїєґђјљњћџ", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch y e iu ia i i ie g dj j lj nj c dzh".split(), strict=True)) | {"ъ": "", "ь": ""}


def _letters() -> dict[str, str]:
    """What stands for a letter in ASCII. Marks go; letters of Indic scripts are as their Unicode names say, consonants without
    the vowel that the names end in; digits of any script are digits."""
    out = dict(LATIN)
    for table in (GREEK, CYRILLIC):
        out |= table | {c.upper(): x.capitalize() for c, x in table.items() if c != "ς"}
    for code in range(0x900, 0xD80):
        words = unicodedata.name(chr(code), "").split(" ")
        if (digit := unicodedata.digit(chr(code), None)) is not None:
            out[chr(code)] = str(digit)
        elif words[1:2] == ["LETTER"] and len(words) == 3 or words[1:3] == ["VOWEL", "SIGN"] and len(words) == 4:
            sound = words[-1].lower()
            vowel = "VOWEL" in words or all(c in "aeiou" for c in sound)
            out[chr(code)] = sound if vowel else sound[:-1] if sound.endswith("a") else sound
        elif "ANUSVARA" in words:
            out[chr(code)] = "m"
        elif "VISARGA" in words:
            out[chr(code)] = "h"
        elif unicodedata.category(chr(code)) in ("Mn", "Mc"):
            out[chr(code)] = ""
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000), *range(0x900, 0xD80)):
        parts = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if chr(code) not in out and parts and parts[0] != chr(code):
            out[chr(code)] = "".join(out.get(c, c) for c in parts)
    return {c: x for c, x in out.items() if x.isascii()} | {chr(c): "" for c in range(0x300, 0x370)}


_LETTERS = _letters()
#: Letters that one letter stands for, then those that go, and that letter for each of the first.
ONE_FROM = "".join(sorted((c for c, x in _LETTERS.items() if len(x) < 2), key=lambda c: (-len(_LETTERS[c]), c)))
ONE_TO = "".join(_LETTERS[c] for c in ONE_FROM)
#: (character class, letters) of those that several letters stand for.
SEVERAL = tuple((f"[{''.join(c for c in sorted(_LETTERS) if _LETTERS[c] == x)}]", x) for x in sorted({x for x in _LETTERS.values() if len(x) > 1}))

#: ASCII other than small letters, digits and the space.
OTHER = "".join(c for c in map(chr, range(128)) if c not in "abcdefghijklmnopqrstuvwxyz0123456789 ")


def _is_ascii(c: Column) -> Column:
    """As many bytes as characters: no pattern has to look at them."""
    return F.octet_length(c) == F.length(c)


def fold(c: Column) -> Column:
    """Letters as ASCII: without marks, and those of other alphabets by sound. What has no letters (ideographs, signs) stays.

    One translation does what one letter stands for; only words that still aren't ASCII see the rules with several.
    """
    text = F.translate(c, ONE_FROM, ONE_TO)

    def word(w: Column) -> Column:
        more = w
        for letters, to in SEVERAL:
            more = F.regexp_replace(more, letters, to)
        return F.when(_is_ascii(w), w).otherwise(F.regexp_replace(more, r"\p{Mn}+", ""))

    return F.when(_is_ascii(text), text).otherwise(F.array_join(F.transform(F.split(text, " "), word), " "))


def ascii_only(c: Column) -> Column:
    """What folding leaves beyond ASCII becomes a space, so that word boundaries are the same for every regex engine."""
    return F.regexp_replace(fold(c), r"[^\x00-\x7F]", " ")


def _ruled(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Fold, lower case, legal then address rules, punctuation to spaces, single spaces. Null and blank: ''."""
    text = _ruled(_ruled(F.lower(ascii_only(F.coalesce(c, F.lit("")))), LEGAL_RULES), ADDRESS_RULES)
    return squeeze(F.regexp_replace(text, r"[^\w\s]", " "))


def clean_lexical(c: Column) -> Column:
    """Fold, lower case, [a-z0-9 ] only, literal rules, a space between letters and digits, single spaces."""
    text = F.translate(F.lower(ascii_only(F.coalesce(c, F.lit("")))), OTHER, "\x01" * len(OTHER))
    text = F.regexp_replace(text, "\x01+", " ")  # a run of one character is found several times faster than one of a negated class
    for what, to in LEXICAL_RULES:
        text = F.replace(text, F.lit(what), F.lit(to))
    text = F.regexp_replace(F.regexp_replace(text, r"([a-z])([0-9])", "$1 $2"), r"([0-9])([a-z])", "$1 $2")
    return squeeze(text)


def skeleton(clean: Column) -> Column:
    """Consonants of a clean name, at most 32."""
    return F.substring(F.translate(clean, " aeiou", ""), 1, 32)


def tokens(clean: Column) -> Column:
    return F.filter(F.split(clean, " +"), lambda t: t != "")


def _first(c: Column, pattern: str) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1)
    return F.when(found != "", found)


def pin_code(raw: Column) -> Column:
    """The first run of 5 or 6 digits that stands alone; null if there is none."""
    return _first(raw, r"\b(\d{5,6})\b")


def first_number(raw: Column) -> Column:
    return _first(raw, r"(\d+)")


def house_number(clean: Column) -> Column:
    """The first token of 1 to 6 digits of a clean address; '' if there is none."""
    return F.regexp_extract(clean, "(?:^| )([0-9]{1,6})(?: |$)", 1)


def state_phrase(clean: Column) -> Column:
    """The first space-delimited run of two letters, or of 4 to 25 letters and spaces; '' if there is none."""
    return F.regexp_extract(clean, "(?:^| )([a-z]{2}|[a-z ]{4,25})(?: |$)", 1)


def without_null_words(c: Column) -> Column:
    """Trimmed; nan, none and null in any case become ''."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(text).isin(*NULL_WORDS), "").otherwise(text)


def raw_text(c: Column) -> Column:
    """Null and nan (any case) become ''; nothing is trimmed."""
    text = F.coalesce(c, F.lit(""))
    return F.when(F.lower(text) == "nan", "").otherwise(text)


def first_filled(*cs: Column) -> Column:
    """The first value that is neither missing nor blank; '' if none is."""
    return F.coalesce(*(F.when(without_null_words(c) != "", without_null_words(c)) for c in cs), F.lit(""))


def entity_string(name: Column, address: Column, country: Column) -> Column:
    """'[COUNTRY] name | address'; without the bracket if there is no country."""
    land = F.upper(F.trim(raw_text(country)))
    head = F.when(land != "", F.concat(F.lit("["), land, F.lit("] "))).otherwise("")
    return F.concat(head, clean_text(raw_text(name)), F.lit(" | "), clean_text(raw_text(address)))


def labelled_text(name: Column, address: Column, city: Column, postal: Column, country: Column) -> Column:
    """'Name: n | Address: a, city, postal, country' with empty parts left out; 'Entity: Unknown' if all are empty."""
    filled = lambda c: F.when(without_null_words(c) != "", without_null_words(c))
    place = F.concat_ws(", ", *(filled(c) for c in (address, city, postal, country)))
    text = F.concat_ws(" | ", F.concat(F.lit("Name: "), filled(name)), F.when(place != "", F.concat(F.lit("Address: "), place)))
    return F.when(text == "", "Entity: Unknown").otherwise(text)


def encoder_text(prefix: str, *fields: Column) -> Column:
    """'query: a [SEP] b [SEP] ...' of normalised fields, for encoders that tell queries from passages."""
    return F.concat(F.lit(f"{prefix}: "), F.concat_ws(" [SEP] ", *(F.coalesce(f, F.lit("")) for f in fields)))


def encoder_record(prefix: str) -> Column:
    """encoder_text of an enriched record: name, address, country, skeleton, house and pin."""
    return encoder_text(prefix, *map(F.col, ("name_n", "addr_n", "country_n", "skeleton", "house", "pin")))


def id_list(c: Column) -> Column:
    """A comma-joined list as an array: parts trimmed, empty ones dropped; null: empty."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def from_source(entity_id: Column, source: int) -> Column:
    return entity_id.startswith(f"S{source}-").cast("int")
