"""numpy kernels over the UTF-8 buffers of Arrow string columns; no Python loop over characters or words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15
BASE = 0x5851F42D4C957F2D | 1
MASK = (1 << 64) - 1

#: Bytes of text that one pass of the kernels takes; a longer text is a pass of its own.
PASS_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def seed(i: int) -> np.uint64:
    return np.uint64((GOLDEN * (i + 1)) & MASK)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PASS_BYTES + 1024)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
IS_WORD = np.zeros(256, bool)
for _c in range(256):
    IS_WORD[_c] = chr(_c).isalnum() if _c < 128 else True
#: First bytes of U+3000..U+DFFF: kana, Han and Hangul, where each character is a word.
IS_WIDE = np.zeros(256, bool)
IS_WIDE[0xE3:0xEE] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: a run of letters and digits, or one Han, kana or Hangul character."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = IS_WORD[data]
    brk = np.zeros(n + 1, bool)
    brk[offsets] = True
    wide = IS_WIDE[data]
    if wide.any():
        at = np.flatnonzero(wide)
        brk[at] = True
        brk[np.minimum(at + 3, n)] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | brk[:-1]))
    ends = np.flatnonzero(word & (~after | brk[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one prefix sum over all of them."""
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and per row the index of its first word (one more entry at the end)."""
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words per row, in order; a row of fewer words has one of them all."""
    count = np.diff(bounds)
    each = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    rows = np.repeat(np.arange(len(count)), each)
    first = np.concatenate([[0], np.cumsum(each)])
    at = np.arange(first[-1]) - first[rows] + bounds[rows]
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    end = bounds[1:][rows]
    for i in range(k):
        out = mix(out * np.uint64(BASE) + np.where(at + i < end, padded[at + i], np.uint64(0)) + seed(i))
    return out, first
