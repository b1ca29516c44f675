"""Text functions on Columns: normal form, tokens, joins, grams, deletions, overlap and edit distance.

All are built-in expressions but one Arrow UDF: the edit distance with transpositions, which only ever sees filtered pairs.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = range(0x300, 0x370)
TOKEN = "[a-z0-9]+|[㐀-鿿]|[^ ]+"
HAN = "[㐀-鿿]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ranges(points: list[int]) -> str:
    """A regular expression class body of the sorted code points."""
    out, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{p:x}}}" if p > start else f"\\x{{{p:x}}}")
            start = None
    return "".join(out)


HANGUL = range(0xAC00, 0xD7A4)
LEADS, VOWELS, TAILS = ("".join(map(chr, range(a, b))) for a, b in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))


@cache
def decomposition() -> tuple[str, str, dict[str, str]]:
    """(characters, their one-character compatibility forms, the longer forms of further ones), Hangul syllables aside.

    The combining marks come last in the first string and have nothing in the second, so a translation drops them.
    """
    single, longer = [], {}
    for p in [*range(0x80, 0xAC00), *range(0xE000, 0x110000)]:
        c = chr(p)
        if p in MARKS:
            continue
        form = "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) not in MARKS)
        if form == c:
            continue
        if len(form) == 1:
            single.append((c, form))
        else:
            longer[c] = form
    return "".join(c for c, _ in single) + "".join(map(chr, MARKS)), "".join(f for _, f in single), longer


def _longer(text: Column) -> Column:
    """Characters of several-character forms and Hangul syllables replaced by their parts."""
    _, _, longer = decomposition()
    forms = F.map_from_arrays(F.split(F.lit("\x01".join(longer)), "\x01"), F.split(F.lit("\x01".join(longer.values())), "\x01"))

    def parts(c: Column) -> Column:
        s = F.ascii(c) - HANGUL.start
        lead = F.substring(F.lit(LEADS), (F.floor(s / 588) + 1).cast("int"), F.lit(1))
        vowel = F.substring(F.lit(VOWELS), (F.floor(s % 588 / 28) + 1).cast("int"), F.lit(1))
        tail = F.when(s % 28 > 0, F.substring(F.lit(TAILS), (s % 28).cast("int"), F.lit(1))).otherwise("")
        hangul = F.ascii(c).between(HANGUL.start, HANGUL.stop - 1)
        return F.when(F.ascii(c) < 128, c).when(hangul, F.concat(lead, vowel, tail)).otherwise(F.coalesce(F.try_element_at(forms, c), c))

    return F.array_join(F.transform(F.split(text, ""), parts), "")


@cache
def _longer_classes() -> tuple[str, str]:
    """What has a longer form: characters of one byte, and of more. The ranges of the second are many and tested one by one."""
    _, _, longer = decomposition()
    points = sorted([*map(ord, longer), *HANGUL])
    return f"[{_ranges([p for p in points if p < 256])}]", f"[{_ranges([p for p in points if p >= 256])}]"


def _has_longer(text: Column) -> Column:
    """Whether a character has a longer form. Classes within a class take the regular expressions a microsecond a character; simple ones, and
    ranges tested at those characters only that are of more than one byte, a tenth of it."""
    short, wide = _longer_classes()
    return text.rlike(short) | (text.rlike(r"[^\x00-\xff]") & F.regexp_replace(text, r"[\x00-\xff]+", "").rlike(wide))


def fold(text: Column | str) -> Column:
    """Compatibility decomposition without combining marks. ASCII texts pass as they are; only texts that hold a character of a
    longer form are taken apart."""
    text = F.coalesce(_col(text).cast("string"), F.lit(""))
    chars, forms, _ = decomposition()
    apart = F.when(_has_longer(text), _longer(text)).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(apart, chars, forms)).otherwise(text)


def normalize_text(text: Column | str) -> Column:
    """Decomposed, unmarked, lower-cased; every run of what is no letter or digit is one space; trimmed. Null is empty.

    Separators, punctuation, hyphens and white space all end as one space, so one replacement does for all of them. Letters and
    digits are those of the JVM's Unicode version; a letter that is newer than it separates words.
    """
    return F.trim(F.regexp_replace(F.lower(fold(text)), r"[^\p{L}\p{N}]+", " "))


def collapse_whitespace(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))


def tokens_of(normalized: Column | str) -> Column:
    """Tokens of a normalised text: ASCII runs, single Han characters, and other runs up to the next space."""
    return F.regexp_extract_all(_col(normalized), F.lit(TOKEN), F.lit(0))


def tokenize(text: Column | str) -> Column:
    return tokens_of(normalize_text(text))


def is_ascii_token(token: Column | str) -> Column:
    return _col(token).rlike("^[a-z0-9]+$")


def is_han_char(char: Column | str) -> Column:
    return _col(char).rlike(f"^{HAN}$")


def has_two_units(token: Column | str) -> Column:
    """At least two UTF-16 units: two characters, or one beyond the basic plane."""
    t = _col(token)
    return (F.length(t) >= 2) | t.rlike(ASTRAL)


def ascii_of(normalized: Column | str) -> Column:
    return F.regexp_replace(_col(normalized), "[^a-z0-9]+", "")


def ascii_join(text: Column | str) -> Column:
    """All ASCII letters and digits of the normal form."""
    return ascii_of(normalize_text(text))


def ascii_tokens_join(tokens: Column | str) -> Column:
    """The ASCII tokens joined; unlike ascii_join() it leaves out ASCII letters inside of other tokens."""
    return F.array_join(F.filter(_col(tokens), is_ascii_token), "")


def compact_of(normalized: Column | str) -> Column:
    return F.replace(_col(normalized), F.lit(" "), F.lit(""))


def compact_join(text: Column | str) -> Column:
    """All tokens joined, that is the normal form without its spaces."""
    return compact_of(normalize_text(text))


def grams(term: Column | str, least: int = 2, most: int = 3) -> Column:
    """n-grams of least to most characters, by size, then by place."""
    t = _col(term)
    n = F.length(t)
    empty = F.lit([]).cast("array<string>")

    def of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(t, i, F.lit(k)))).otherwise(empty)

    sizes = [of(k) for k in range(least, most + 1)]
    return F.concat(*sizes) if sizes else empty


def bigram_overlap(left: Column | str, right: Column | str) -> Column:
    """Common bigrams over the greater number of distinct ones; by first character where a side has less than two."""
    a, b = _col(left), _col(right)
    ga, gb = F.array_distinct(grams(a, 2, 2)), F.array_distinct(grams(b, 2, 2))
    share = F.size(F.array_intersect(ga, gb)) / F.greatest(F.size(ga), F.size(gb), F.lit(1))
    same = F.when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 1.0).otherwise(0.0)
    return F.when((F.length(a) < 2) | (F.length(b) < 2), same).otherwise(share)


def _without(t: Column, i: Column) -> Column:
    return F.concat(F.substring(t, F.lit(1), i), F.substring(t, i + 2, F.length(t)))


def deletions(term: Column | str, two: Column | bool = False) -> Column:
    """Distinct non-empty strings of one deletion, or of up to two, each single deletion followed by its own in depth-first order."""
    t = _col(term)
    one = F.transform(F.sequence(F.lit(0), F.length(t) - 1), lambda i: F.struct(i.alias("i"), _without(t, i).alias("s")))
    first = F.transform(one, lambda x: x["s"])
    deeper = F.flatten(
        F.transform(
            one,
            lambda x: F.concat(
                F.array(x["s"]),
                F.when(x["i"] < F.length(x["s"]), F.transform(F.sequence(x["i"], F.length(x["s"]) - 1), lambda j: _without(x["s"], j))).otherwise(F.lit([]).cast("array<string>")),
            ),
        )
    )
    found = F.when(F.lit(two) if isinstance(two, bool) else two, deeper).otherwise(first)
    return F.when(F.length(t) > 0, F.filter(F.array_distinct(found), lambda s: s != "")).otherwise(F.lit([]).cast("array<string>"))


def osa(left: str, right: str, most: int) -> int:
    """Edit distance with transpositions of neighbours, no substring edited twice; most + 1 as soon as it must be above most."""
    if abs(len(left) - len(right)) > most:
        return most + 1
    older: list[int] = []
    old = list(range(len(right) + 1))
    for i, a in enumerate(left, 1):
        now = [i]
        for j, b in enumerate(right, 1):
            best = min(old[j] + 1, now[j - 1] + 1, old[j - 1] + (a != b))
            if i > 1 and j > 1 and a == right[j - 2] and left[i - 2] == b:
                best = min(best, older[j - 2] + 1)
            now.append(best)
        if min(now) > most:
            return most + 1
        older, old = old, now
    return min(old[-1], most + 1)


@F.pandas_udf(T.IntegerType())
def osa_distance(left: pd.Series, right: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else osa(a, b, m) for a, b, m in zip(left, right, most)], dtype="Int32")


def value_text(value: Column | str, kind: T.DataType) -> Column:
    """A value of any type as text: arrays, structs and maps joined by spaces, null empty, whole numbers without a fraction."""
    v = _col(value)
    if isinstance(kind, T.StringType):
        return F.coalesce(v, F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(v, lambda x: value_text(x, kind.elementType)), " "), F.lit(""))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.array_join(F.transform(F.map_values(v), lambda x: value_text(x, kind.valueType)), " "), F.lit(""))
    if isinstance(kind, T.StructType):
        return F.when(v.isNull(), F.lit("")).otherwise(F.concat_ws(" ", *(value_text(v[f.name], f.dataType) for f in kind.fields)))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (v == F.floor(v)) & (F.abs(v) < F.lit(1e15))
        return F.coalesce(F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string")), F.lit(""))
    return F.coalesce(v.cast("string"), F.lit(""))


def format_bytes(n: Column | str) -> Column:
    n = _col(n)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.2f", n / 1024 / 1024), F.lit(" MB")))
    )


def format_ms(ms: Column | str) -> Column:
    ms = _col(ms).cast("double")
    digits = F.when(ms >= 100, F.format_string("%.1f", ms)).when(ms >= 10, F.format_string("%.2f", ms)).otherwise(F.format_string("%.3f", ms))
    return F.concat(digits, F.lit(" ms"))


def varint_size(n: Column | str) -> Column:
    """Bytes of an unsigned number in groups of 7 bits."""
    n = _col(n).cast("bigint")
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")
