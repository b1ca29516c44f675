"""Statistics of lines and documents, from numpy passes over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from siltstone.llm import _kernels as K

CLASSES = ("lower", "upper", "digit", "space", "stop", "inner", "symbol", "high", "lead")
_class = np.full(256, 6, np.uint8)  # symbols and control bytes
for _c in range(128):
    _ch = chr(_c)
    _class[_c] = 0 if _ch.islower() else 1 if _ch.isupper() else 2 if _ch.isdigit() else 3 if _ch.isspace() else 4 if _ch in ".!?" else 5 if _ch in ",;:'\"-()" else 6
_class[128:192] = 7  # continuation bytes
_class[192:256] = 8  # first bytes of characters beyond ASCII
#: After 0xC3, capital Latin letters: so À-Þ count as upper case.
LATIN, CAPITAL = 0xC3, (0x80, 0x9E)

LINE_FEATURES = ("log_chars", "log_words", "word_length", "upper", "digit", "symbol", "inner", "ends_sentence", "letters", "repeated_words", "symbol_words", "capital_start", "repeated_line", "long_word", "stops")
DOC_FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "inner", "stops", "letters", "repeated_words", "symbol_words", "sentence_lines", "repeated_lines", "short_lines", "log_line_words", "top_word", "capital_words", "log_lines", "log_chars")


#: Bits of a class's count in a packed word, three counts to a word; a longer line is counted in pieces of fewer bytes.
FIELD, PIECE = 21, 1 << 20


def _sums(cls: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    """How many bytes of each class, and how many characters, there are from each begin up to the next one."""
    n = len(cls)
    lengths = np.diff(np.append(begin, n))
    pieces = np.maximum(-(-lengths // PIECE), 1)
    owner = np.repeat(np.arange(len(begin)), pieces)
    at = np.append(begin, n)[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    names, out = (*CLASSES, "chars"), {}
    empty = at == np.append(at[1:], n)
    cls = np.append(cls, np.uint8(len(CLASSES)))
    for k in range(0, len(names), 3):
        table = np.zeros(len(CLASSES) + 1, np.uint64)
        for j, name in enumerate(names[k : k + 3]):
            hit = [c for c in CLASSES if c != "high"] if name == "chars" else [name]
            table[[CLASSES.index(c) for c in hit]] += np.uint64(1 << (FIELD * j))
        packed = np.add.reduceat(table[cls], at)
        packed[empty] = 0
        for j, name in enumerate(names[k : k + 3]):
            own = ((packed >> np.uint64(FIELD * j)) & np.uint64((1 << FIELD) - 1)).astype(np.float64)
            out[name] = own if len(own) == len(begin) else np.bincount(owner, own, len(begin))
    return out


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, most of one key) in each of n rows; keys are compared by as many of their leading bits as the row's number leaves."""
    bits = max(1, int(n).bit_length())
    both = np.sort((rows.astype(np.uint64) << np.uint64(64 - bits)) | (keys >> np.uint64(bits)))
    edge = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    own = (both[edge] >> np.uint64(64 - bits)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, own, np.diff(np.append(edge, len(both))).astype(float))
    return np.bincount(own, minlength=n).astype(float), top


def _repeats(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True where the key comes earlier in its row."""
    order = np.lexsort((keys, rows))
    out = np.zeros(len(keys), bool)
    k, r = keys[order], rows[order]
    out[order[1:]] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    return out


def measure(data: np.ndarray, offsets: np.ndarray, want: str = "both") -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray | None]:
    """(line features, line lengths in bytes, per row the index of its first line, document features).

    A row has at least one line. Empty rows have zeros for all features. want: "lines", "documents" or "both".
    """
    n, rows = len(data), len(offsets) - 1
    cls = _class[data]
    if n > 1:
        second = (data[:-1] == LATIN) & (data[1:] >= CAPITAL[0]) & (data[1:] <= CAPITAL[1])
        cls[:-1][second] = 1
    breaks = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    # A break at the end of a row begins a line at the next row's offset: rank it before that row's own.
    own = np.searchsorted(breaks + 1, offsets[:-1], "right") + np.arange(rows)
    first = np.concatenate([own, [len(begins)]])
    line_row = np.repeat(np.arange(rows), np.diff(first))
    begin = begins
    end = np.concatenate([begins[1:], [n]])
    end = np.where(np.isin(end - 1, breaks, assume_unique=False) & (end > begin), end - 1, end)

    # With the line breaks, as documents count them; a line counts without its own.
    sums = _sums(cls, begin)
    broken = (np.append(begin[1:], n) > end).astype(float)
    total = lambda name: sums[name] - broken if name in ("space", "chars") else sums[name]
    chars = total("chars")
    starts, ends = K.word_spans(data, offsets)
    hashes = K.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    wfirst = np.searchsorted(starts, begin)
    wpast = np.searchsorted(starts, end)
    nwords = (wpast - wfirst).astype(float)
    wline = np.repeat(np.arange(len(begin)), wpast - wfirst)
    wrow = line_row[wline]
    wlen = (ends - starts).astype(float)
    after = np.zeros(len(ends), np.uint8)
    inside = ends < end[wline]  # not the first sign of the next row
    after[inside] = cls[ends[inside]]
    symbol_word = after == 6
    capital = cls[starts] == 1

    def per_line(x: np.ndarray) -> np.ndarray:
        return np.bincount(wline, x, len(begin)) if len(wline) else np.zeros(len(begin))

    def per_row(x: np.ndarray) -> np.ndarray:
        return np.bincount(wrow, x, rows) if len(wrow) else np.zeros(rows)

    line_hash = K.span_hashes(data, begin, end) if n else np.zeros(len(begin), np.uint64)
    line_again = _repeats(line_hash, line_row) & (nwords > 0)
    last = np.zeros(len(begin))
    has = end > begin
    last[has] = cls[end[has] - 1] == 4
    line = _lines(total, chars, nwords, per_line, hashes, wline, wlen, wfirst, wpast, symbol_word, capital, last, line_again) if want != "documents" else None
    if want == "lines":
        return line, (end - begin).astype(float), first, None

    per = lambda name: np.bincount(line_row, sums[name], rows)
    dchars = np.maximum(per("chars"), 1)
    words = per_row(np.ones(len(wlen)))
    dw = np.maximum(words, 1)
    distinct, top = _distinct(hashes, wrow, rows)
    real = has & (nwords > 0)
    lines = np.bincount(line_row, real, rows)
    nl = np.maximum(lines, 1)
    lrow = lambda x: np.bincount(line_row, x * real, rows) / nl
    doc = np.column_stack([np.log1p(words), per_row(wlen) / dw, per("upper") / dchars, per("digit") / dchars, per("symbol") / dchars, per("inner") / dchars, per("stop") / dchars, (per("lower") + per("upper") + per("lead")) / dchars, (words - distinct) / dw, per_row(symbol_word) / dw, lrow(last), lrow(line_again), lrow(nwords < 4), np.log1p(words / nl), top / dw, per_row(capital) / dw, np.log1p(lines), np.log1p(per("chars"))])
    return line, (end - begin).astype(float), first, doc


def _lines(total, chars, nwords, per_line, hashes, wline, wlen, wfirst, wpast, symbol_word, capital, last, line_again) -> np.ndarray:
    some, w1 = np.maximum(chars, 1), np.maximum(nwords, 1)
    letters = total("lower") + total("upper") + total("lead")
    start_capital, longest = np.zeros(len(chars)), np.zeros(len(chars))
    with_words = wpast > wfirst
    start_capital[with_words] = capital[wfirst[with_words]]
    if len(wline):
        np.maximum.at(longest, wline, wlen)
    return np.column_stack([np.log1p(chars), np.log1p(nwords), per_line(wlen) / w1, total("upper") / some, total("digit") / some, total("symbol") / some, total("inner") / some, last, letters / some, (nwords - _distinct(hashes, wline, len(chars))[0]) / w1, per_line(symbol_word) / w1, start_capital, line_again, np.log1p(longest), total("stop") / some])


def measured(column, want: str = "both") -> Iterator[tuple[int, int, tuple]]:
    """measure() of an Arrow string column, pass by pass: (first row, past the last, its result)."""
    data, offsets = K.utf8(column)
    for a, b in K.passes(offsets):
        yield a, b, measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], want)
