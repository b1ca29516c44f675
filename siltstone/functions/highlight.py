"""Match ranges and their rendering. Ranges are inclusive [start, end] pairs of offsets in UTF-16 units as ARRAY<STRUCT<start, end>>."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.config import HighlightOptions
from siltstone.functions import text as X

RANGES = "array<struct<start:int,end:int>>"
RANGES_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SEGMENTS = "array<struct<text:string,highlighted:boolean>>"


def escape_html(text: Column | str) -> Column:
    out = X._col(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def merge_ranges(ranges: Column | str) -> Column:
    """Sorted, with overlapping and adjacent ranges as one."""
    empty = F.lit([]).cast(RANGES)

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (r["start"] <= F.try_element_at(done, F.lit(-1))["end"] + 1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(kept, F.array(grown))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(F.coalesce(X._col(ranges), empty).cast(RANGES)), empty, add)


def _units(text: str) -> list[str]:
    """The text by UTF-16 units: a character beyond the basic plane is followed by an empty unit."""
    out: list[str] = []
    for c in text:
        out.append(c)
        if ord(c) > 0xFFFF:
            out.append("")
    return out


def highlight_parts(text: str, ranges: list[tuple[int, int]]) -> list[tuple[str, bool]]:
    """(piece, highlighted) of a text by its merged ranges, clamped to the text."""
    cells = _units(text)
    merged: list[list[int]] = []
    for a, b in sorted((max(0, a), min(len(cells) - 1, b)) for a, b in ranges):
        if b < a:
            continue
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        if a > at:
            out.append(("".join(cells[at:a]), False))
        out.append(("".join(cells[a : b + 1]), True))
        at = b + 1
    if at < len(cells) or not out:
        out.append(("".join(cells[at:]), False))
    return out


def _rows(ranges) -> list[tuple[int, int]]:
    return [] if ranges is None else [(r["start"], r["end"]) for r in ranges]


def highlight_segments(text: Column | str, ranges: Column | str) -> Column:
    """The pieces of a text and whether each is in a range, for components that render them on their own."""

    @F.pandas_udf(SEGMENTS)
    def segments(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "highlighted": h} for t, h in highlight_parts(x or "", _rows(r))] for x, r in zip(texts, found)])

    return segments(X._col(text), X._col(ranges))


def render_highlights(text: Column | str, ranges: Column | str, options: HighlightOptions = HighlightOptions()) -> Column:
    """HTML of a text with its ranges wrapped in the options' marks; everything else is escaped."""
    before, after = options.marks()
    parts = F.transform(highlight_segments(text, ranges), lambda p: F.when(p["highlighted"], F.concat(F.lit(before), escape_html(p["text"]), F.lit(after))).otherwise(escape_html(p["text"])))
    return F.when(F.coalesce(X._col(text), F.lit("")) == "", F.lit("")).otherwise(F.array_join(parts, ""))


def render_hit(fields: Column | str, matches: Column | str, fallback: str, options: HighlightOptions = HighlightOptions()) -> Column:
    """The first matched field rendered, or the fallback field escaped."""
    fields, matches = X._col(fields), X._col(matches)
    first = F.get(matches, F.lit(0))
    marked = render_highlights(F.coalesce(F.try_element_at(fields, first["field"]), F.lit("")), first["ranges"], options)
    return F.when(F.size(matches) > 0, marked).otherwise(escape_html(F.coalesce(F.try_element_at(fields, F.lit(fallback)), F.lit(""))))


def highlight_needles(query: Column | str) -> Column:
    """What to look for of a query: tokens of two units, Han bigrams of a short compact form, the joins; distinct, longest first, in that order."""
    norm = X.normalize_text(query)
    tokens = F.filter(X.tokens_of(norm), X.has_two_units)
    compact, joined = X.compact_of(norm), X.ascii_of(norm)
    short = F.length(compact).between(2, 24)
    bigrams = F.when(short, F.filter(X.grams(compact, 2, 2), lambda g: g.rlike(X.HAN))).otherwise(F.lit([]).cast("array<string>"))
    every = F.array_distinct(F.filter(F.concat(tokens, bigrams, F.array(joined, compact)), lambda x: F.length(x) >= 2))
    keyed = F.transform(every, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def match_ranges(text: str | None, needles, most: int = 12) -> list[tuple[int, int]]:
    """Places of the needles in the lower-cased text, needle by needle without overlap, up to most in all; merged."""
    if not text or needles is None or len(needles) == 0:
        return []
    hay = text.lower()
    if len(hay) != len(text):  # a character whose lower case is longer keeps its own place
        hay = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places = None
    if any(ord(c) > 0xFFFF for c in text):
        places, at = [], 0
        for c in text:
            places.append(at)
            at += 2 if ord(c) > 0xFFFF else 1
        places.append(at)
    found: list[tuple[int, int]] = []
    for needle in needles:
        at = hay.find(needle) if needle else -1
        while at >= 0 and len(found) < most:
            end = at + len(needle)
            found.append((at, end - 1) if places is None else (places[at], places[end] - 1))
            at = hay.find(needle, end)
        if len(found) >= most:
            break
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@F.pandas_udf(RANGES_TYPE)
def find_match_ranges(text: pd.Series, needles: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in match_ranges(t, n)] for t, n in zip(text, needles)])


def field_matches(fields: Column | str, names: list[str], needles: Column | str) -> Column:
    """ARRAY<STRUCT<field, ranges>> of the named fields that hold a needle, in the given order."""
    fields = X._col(fields)
    found = [F.struct(F.lit(n).alias("field"), find_match_ranges(F.try_element_at(fields, F.lit(n)), X._col(needles)).alias("ranges")) for n in names]
    return F.filter(F.array(*found), lambda m: F.size(m["ranges"]) > 0) if found else F.lit([]).cast(f"array<struct<field:string,ranges:{RANGES}>>")
