"""Media columns: PNG images in binary columns, decoded and hashed.

The decoder reads the chunks with their CRC-32 tests, inflates the image data with its Adler-32 test, undoes
the row filters with numpy, and knows all colour types, bit depths, palettes, transparency and interlacing of the format. It works in
bands of rows that are averaged into the 32 x 32 grid at once, so that a picture of any size takes the memory of one band, and of
a row if that is more. Small pictures of one kind in a batch are decoded side by side. Filters that need
the byte to the left are undone along anti-diagonals, all rows of a band at a time.

An image's hash is the sign pattern of the low-frequency coefficients of the cosine transform of its grey 32 x 32 reduction against
their median: 8 bytes, close in Hamming distance for pictures that look alike.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Of Adam7: first column and row of each pass, and its steps.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
GRID, LOW = 32, 8
#: Bytes or pixels of rows that are decoded at once, at least a row; pictures of fewer bytes than SMALL share a band.
BAND, SMALL, FEED = 1 << 21, 1 << 16, 1 << 16
GREY = np.array([0.299, 0.587, 0.114])


class Malformed(ValueError):
    """Why a byte string is no sound PNG."""


def chunks(data: bytes) -> Iterator[tuple[bytes, memoryview]]:
    if data[:8] != SIGNATURE:
        raise Malformed("not a png")
    view, at = memoryview(data), 8
    while at < len(data):
        if at + 12 > len(data):
            raise Malformed("truncated")
        (n,) = struct.unpack_from(">I", data, at)
        if at + 12 + n > len(data):
            raise Malformed("truncated")
        kind, body = data[at + 4 : at + 8], view[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise Malformed("bad checksum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n
    raise Malformed("truncated")


@dataclass
class Picture:
    """A picture's header, its palette and transparency chunks, and its compressed data."""

    width: int
    height: int
    depth: int
    colour: int
    interlaced: int
    palette: bytes | None
    clear: bytes | None
    body: list

    @property
    def kind(self) -> tuple[int, int, int, int, int]:
        return self.width, self.height, self.depth, self.colour, self.interlaced

    @property
    def step(self) -> int:
        """Bytes from a byte to its left neighbour in the filters."""
        return max(1, self.depth * CHANNELS[self.colour] // 8)

    def stride(self, width: int) -> int:
        return -(-width * self.depth * CHANNELS[self.colour] // 8)

    def passes(self) -> list[tuple[int, int, int, int, int, int]]:
        """(first column, first row, their steps, columns, rows) of each pass that has pixels."""
        own = ADAM7 if self.interlaced else ((0, 0, 1, 1),)
        sizes = [(x, y, dx, dy, -(-(self.width - x) // dx), -(-(self.height - y) // dy)) for x, y, dx, dy in own]
        return [p for p in sizes if p[4] > 0 and p[5] > 0]

    def raw_bytes(self) -> int:
        return sum(h * (1 + self.stride(w)) for *_, w, h in self.passes())

    def lut(self) -> np.ndarray | None:
        """Grey over white of each sample value, where a pixel is one sample of at most 8 bits."""
        if self.colour == 3:
            rgb = np.frombuffer(self.palette, np.uint8).reshape(-1, 3) / 255.0
            opaque = np.full(256, 255, np.uint8)
            if self.clear is not None:
                opaque[: min(len(self.clear), 256)] = np.frombuffer(self.clear[:256], np.uint8)
            alpha = opaque[: len(rgb)] / 255.0
            out = np.full(256, np.nan)
            out[: len(rgb)] = rgb @ GREY * alpha + (1 - alpha)
            return out
        if self.colour == 0 and self.depth <= 8:
            out = np.arange(256) / float((1 << self.depth) - 1)
            if self.clear is not None and len(self.clear) == 2:
                (key,) = struct.unpack(">H", self.clear)
                if key < 256:
                    out[key] = 1.0
            return out
        return None


def parse(data: bytes) -> Picture:
    found, palette, clear, body = None, None, None, []
    for kind, x in chunks(data):
        if found is None and kind != b"IHDR":
            raise Malformed("bad header")
        if kind == b"IHDR":
            if found is not None or len(x) != 13:
                raise Malformed("bad header")
            found = width, height, depth, colour, method, filters, interlaced = struct.unpack(">IIBBBBB", x)
            if not width or not height or width >> 31 or height >> 31 or depth not in DEPTHS.get(colour, ()) or method or filters or interlaced > 1:
                raise Malformed("bad header")
        elif kind == b"PLTE":
            if len(x) % 3 or not x or len(x) > 768:
                raise Malformed("bad palette")
            palette = bytes(x)
        elif kind == b"tRNS":
            clear = bytes(x)
        elif kind == b"IDAT":
            body.append(x)
        elif kind != b"IEND" and not kind[0] & 32:
            raise Malformed("unknown chunk")
    if found is None:
        raise Malformed("bad header")
    if colour == 3 and palette is None:
        raise Malformed("bad palette")
    return Picture(width, height, depth, colour, interlaced, palette, clear, body)


class Inflated:
    """The inflated image data, read piece by piece."""

    def __init__(self, body: list):
        self.inflate = zlib.decompressobj()
        self.pieces = (x[i : i + FEED] for x in body for i in range(0, len(x), FEED))

    def _next(self, most: int) -> bytes | None:
        piece = self.inflate.unconsumed_tail or next(self.pieces, None)
        if self.inflate.eof:
            return None
        try:
            return self.inflate.decompress(piece, most) if piece is not None else self.inflate.flush() or None
        except zlib.error:
            raise Malformed("bad data") from None

    def read(self, n: int) -> bytearray:
        out = bytearray()
        while len(out) < n:
            more = self._next(n - len(out))
            if more is None:
                raise Malformed("bad data")
            out += more
        if len(out) > n:
            raise Malformed("bad data")
        return out

    def close(self) -> None:
        """The data must end here, with its checksum."""
        while not self.inflate.eof:
            more = self._next(1)
            if more is None or more:
                raise Malformed("bad data")


def unfilter(raw: np.ndarray, kinds: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Bands of n pictures: raw (n, rows, stride) with the filter of each row (n, rows), and the row before each band (n, stride)."""
    n, rows, stride = raw.shape
    if kinds.max(initial=0) < 3:
        out, before = np.empty_like(raw), above
        pad = -stride % step
        for y in range(rows):
            row = raw[:, y]
            left, up = kinds[:, y] == 1, kinds[:, y] == 2
            if left.any():
                cells = np.pad(row[left], ((0, 0), (0, pad))).reshape(int(left.sum()), -1, step)
                row = row.copy()
                row[left] = np.cumsum(cells, axis=1, dtype=np.uint8).reshape(len(cells), -1)[:, :stride]
            out[:, y] = row
            out[up, y] += before[up]
            before = out[:, y]
        return out
    across = -(-stride // step)
    # A cell before each row and a row before the band; cells of one anti-diagonal depend on the two diagonals before it only.
    cells = np.zeros((n, rows + 1, across + 1, step), np.uint8)
    whole = np.zeros((n, rows + 1, across * step), np.uint8)
    whole[:, 0, :stride], whole[:, 1:, :stride] = above, raw
    cells[:, :, 1:] = whole.reshape(n, rows + 1, across, step)
    del whole
    sn, sr, sx, sb = cells.strides
    skewed = lambda base: np.lib.stride_tricks.as_strided(base, (n, rows, rows + across - 1, step), (sn, sr - sx, sx, sb))
    now, left, up, corner = skewed(cells[:, 1:, 1:]), skewed(cells[:, 1:]), skewed(cells[:, :, 1:]), skewed(cells)
    own = [np.broadcast_to((kinds == k)[:, :, None], (n, rows, step)) for k in range(5)]
    some = [bool((kinds == k).any()) for k in range(5)]
    for d in range(rows + across - 1):
        a, b = max(0, d - across + 1), min(rows, d + 1)
        l8, u8 = left[:, a:b, d], up[:, a:b, d]
        guess = np.zeros(l8.shape, np.uint8)
        if some[1]:
            guess = np.where(own[1][:, a:b], l8, guess)
        if some[2]:
            guess = np.where(own[2][:, a:b], u8, guess)
        if some[3]:
            guess = np.where(own[3][:, a:b], (l8 >> 1) + (u8 >> 1) + (l8 & u8 & 1), guess)
        if some[4]:
            c8 = corner[:, a:b, d]
            c = c8.astype(np.int16)
            from_left, from_up = u8 - c, l8 - c
            pl, pu, pc = np.abs(from_left), np.abs(from_up), np.abs(from_left + from_up)
            guess = np.where(own[4][:, a:b], np.where((pl <= pu) & (pl <= pc), l8, np.where(pu <= pc, u8, c8)), guess)
        now[:, a:b, d] += guess
    return cells[:, 1:, 1:].reshape(n, rows, -1)[:, :, :stride]


def samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """(n, rows, stride) bytes as (n, rows, width, channels) samples."""
    n, h, _ = rows.shape
    if depth == 16:
        return np.ascontiguousarray(rows).view(">u2").reshape(n, h, width, channels)
    if depth < 8:
        bits = np.unpackbits(rows, axis=2).reshape(n, h, -1, depth)
        out = bits[..., 0]
        for i in range(1, depth):
            out = (out << 1) | bits[..., i]
        return out[:, :, : width * channels].reshape(n, h, width, channels)
    return rows.reshape(n, h, width, channels)


def grey_of(values: np.ndarray, own: list[Picture], luts: np.ndarray | None) -> np.ndarray:
    """Grey over white, from 0 to 1, of samples of pictures of one kind."""
    if luts is not None:
        return luts[np.arange(len(own))[:, None, None], values[..., 0]]
    first = own[0]
    top, channels = float((1 << first.depth) - 1), CHANNELS[first.colour]
    grey = np.zeros(values.shape[:3])
    if channels < 3:
        grey += values[..., 0]
    else:
        for i in range(3):
            grey += values[..., i] * GREY[i]
    grey /= top
    if channels in (2, 4):
        alpha = values[..., -1] / top
        return grey * alpha + (1 - alpha)
    for i, p in enumerate(own):
        if p.clear is not None and len(p.clear) == 2 * channels:
            grey[i][(values[i] == np.frombuffer(p.clear, ">u2")).all(axis=-1)] = 1.0
    return grey


def row_weights(places: np.ndarray, height: int) -> np.ndarray:
    """GRID x rows: the share of each row, at its place, in each of GRID equal boxes."""
    edges = np.linspace(0, height, GRID + 1)
    low, high = np.maximum(edges[:-1, None], places), np.minimum(edges[1:, None], places + 1)
    return np.maximum(high - low, 0) * (GRID / height)


def column_boxes(grey: np.ndarray, width: int, x: int, dx: int) -> np.ndarray:
    """(n, rows, GRID): each row's sum over the boxes of columns, of samples of width 1 at x, x + dx, ..."""
    count = grey.shape[2]
    total = np.zeros((*grey.shape[:2], count + 1))
    np.cumsum(grey, axis=2, out=total[:, :, 1:])
    edges = np.linspace(0, width, GRID + 1)
    whole = np.floor(edges).astype(np.int64)
    before = np.clip(-(-(whole - x) // dx), 0, count)
    inside = ((whole - x) % dx == 0) & (whole >= x) & (before < count)
    part = np.where(inside, edges - whole, 0.0)
    at = total[:, :, before] + part * grey[:, :, np.minimum(before, count - 1)]
    return np.diff(at, axis=2) * (GRID / width)


def reduced(own: list[Picture]) -> tuple[np.ndarray, list[str | None]]:
    """(n, GRID, GRID) box averages of pictures of one kind, and what is wrong with each."""
    first, n = own[0], len(own)
    out, wrong = np.zeros((n, GRID, GRID)), [None] * n
    sources = [Inflated(p.body) for p in own]
    luts = np.stack([p.lut() for p in own]) if own[0].lut() is not None else None

    def failed(i: int, why: str) -> None:
        wrong[i] = wrong[i] or why

    for x, y, dx, dy, width, height in first.passes():
        stride = first.stride(width)
        above = np.zeros((n, stride), np.uint8)
        rows = max(1, min(height, BAND // (max(stride + 1, width) * n)))
        for at in range(0, height, rows):
            take = min(rows, height - at)
            raw = np.zeros((n, take, stride + 1), np.uint8)
            for i, source in enumerate(sources):
                if wrong[i] is None:
                    try:
                        raw[i] = np.frombuffer(source.read(take * (stride + 1)), np.uint8).reshape(take, -1)
                    except Malformed as why:
                        failed(i, str(why))
            kinds = raw[:, :, 0].copy()
            for i in np.flatnonzero((kinds > 4).any(axis=1)):
                failed(i, "bad filter")
            kinds[kinds > 4] = 0
            band = unfilter(raw[:, :, 1:], kinds, above, first.step)
            above = band[:, -1]
            grey = grey_of(samples(band, width, first.depth, CHANNELS[first.colour]), own, luts)
            if first.colour == 3:
                for i in np.flatnonzero(np.isnan(grey).any(axis=(1, 2))):
                    failed(i, "bad palette")
                    grey[i] = 0
            places = y + dy * np.arange(at, at + take)
            out += row_weights(places, first.height) @ column_boxes(grey, first.width, x, dx)
            if n == 1 and wrong[0]:
                return out, wrong
    for i, source in enumerate(sources):
        if wrong[i] is None:
            try:
                source.close()
            except Malformed as why:
                failed(i, str(why))
    return out, wrong


COSINES = np.cos(np.pi / GRID * (np.arange(GRID) + 0.5)[None, :] * np.arange(GRID)[:, None])[:LOW]


def grid_hashes(grids: np.ndarray) -> list[bytes]:
    """8 bytes for each grid: which of the LOW x LOW low-frequency coefficients are above their median, rows first; the constant one counts as 0."""
    low = COSINES @ grids @ COSINES.T
    low[:, 0, 0] = 0
    low = np.round(low, 9).reshape(len(grids), -1)  # so that a flat picture has the same hash everywhere
    return [x.tobytes() for x in np.packbits(low > np.median(low, axis=1, keepdims=True), axis=1)]


def hash_all(values: list[bytes | None]) -> list[tuple]:
    """(status, width, height, depth, colour, hash) of each byte string."""
    out: list[tuple] = [("null", *[None] * 5)] * len(values)
    groups: dict[tuple, list[tuple[int, Picture]]] = {}
    for i, data in enumerate(values):
        if data is None:
            continue
        try:
            p = parse(data)
        except Malformed as why:
            out[i] = (str(why), *[None] * 5)
            continue
        groups.setdefault(p.kind if p.raw_bytes() < SMALL else (i,), []).append((i, p))
    for group in groups.values():
        many = max(1, BAND // (group[0][1].raw_bytes() + group[0][1].width * group[0][1].height))
        for a in range(0, len(group), many):
            part = group[a : a + many]
            grids, wrong = reduced([p for _, p in part])
            for (i, p), why, found in zip(part, wrong, grid_hashes(grids)):
                out[i] = (why, *[None] * 5) if why else ("ok", p.width, p.height, p.depth, p.colour, found)
    return out


def hash_images(images: DataFrame, key: str, column: str) -> DataFrame:
    """(key, status, width, height, bit_depth, colour_type, picture_hash) for each row of images.

    status is "ok", "null", or what is wrong: "not a png" (an empty value is), "truncated", "bad checksum", "bad header",
    "bad data", "bad filter", "bad palette", "unknown chunk"; the other columns are then null. A picture of any size that the format allows is decoded, in
    the memory of a band of rows; a value itself has to fit a row of Spark. Repeated rows and null keys each
    have a row, equal pictures equal hashes; only the two named columns are read, so others may have any name. An empty table gives no rows.
    """
    schema = pa.schema([("status", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32()), ("colour_type", pa.int32()), ("picture_hash", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = hash_all(batch.column(1).to_pylist())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, schema.types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *schema.names])

    kind = images.schema[key].dataType.simpleString()
    return images.select(f"`{key}`", f"`{column}`").mapInArrow(run, f"`{key}` {kind}, status string, width int, height int, bit_depth int, colour_type int, picture_hash binary")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filtered(rows: np.ndarray, step: int, kinds: tuple[int, ...]) -> np.ndarray:
    """(n, h, stride) bytes -> (n, h, stride + 1) with each row's filter byte; row y has the filter kinds[y % len(kinds)]."""
    n, h, stride = rows.shape
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, :, step:], up[:, 1:] = rows[:, :, : max(stride - step, 0)], rows[:, :-1]
    corner = np.zeros_like(rows)
    corner[:, 1:] = left[:, :-1]
    out = np.zeros((n, h, stride + 1), np.uint8)
    for y in range(h):
        kind = kinds[y % len(kinds)]
        a, b, c = (x[:, y].astype(np.int16) for x in (left, up, corner))
        pl, pu, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        guess = (0, a, b, (a + b) >> 1, np.where((pl <= pu) & (pl <= pc), a, np.where(pu <= pc, b, c)))[kind]
        out[:, y, 0], out[:, y, 1:] = kind, (rows[:, y] - guess) & 255
    return out


def encode(values: np.ndarray, depth: int = 8, colour: int = 0, interlaced: int = 0, kinds: tuple[int, ...] = (0, 1, 2, 3, 4), palette: bytes | None = None, clear: bytes | None = None) -> list[bytes]:
    """PNGs of (n, height, width, channels) samples."""
    n, height, width, channels = values.shape
    own = Picture(width, height, depth, colour, interlaced, palette, clear, [])
    parts = []
    for x, y, dx, dy, w, h in own.passes():
        cells = values[:, y::dy, x::dx]
        if depth == 16:
            rows = np.ascontiguousarray(cells.astype(">u2")).view(np.uint8).reshape(n, h, -1)
        elif depth == 8:
            rows = cells.astype(np.uint8).reshape(n, h, -1)
        else:
            bits = (cells.reshape(n, h, -1)[..., None] >> np.arange(depth - 1, -1, -1)) & 1
            rows = np.packbits(bits.astype(np.uint8).reshape(n, h, -1), axis=2)
        parts.append(filtered(rows, own.step, kinds).reshape(n, -1))
    raw = np.concatenate(parts, axis=1)
    head = SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced))
    head += (_chunk(b"PLTE", palette) if palette else b"") + (_chunk(b"tRNS", clear) if clear else b"")
    return [head + _chunk(b"IDAT", zlib.compress(r.tobytes(), 1)) + _chunk(b"IEND", b"") for r in raw]


#: Every colour type with each of its depths, plain and interlaced: the kinds of picture that vectors are rendered as.
KINDS = [(c, d, i) for c, depths in DEPTHS.items() for d in depths for i in (0, 1)]


def rendered(squares: np.ndarray, colour: int, depth: int, interlaced: int) -> list[bytes]:
    """Pictures of (n, side, side) values from 0 to 1 in one kind; with colours, palettes and transparency that follow the values."""
    top = (1 << depth) - 1
    palette = clear = None
    if colour == 3:
        size = min(top + 1, 200)
        shade = np.round(np.linspace(0, 255, size)).astype(np.uint8)
        palette, clear, top = np.column_stack([shade, shade[::-1], shade // 2]).tobytes(), shade[::-1].tobytes(), size - 1
    elif colour in (0, 2):
        clear = struct.pack(">H", top) * CHANNELS[colour]
    planes = {0: [squares], 2: [squares, 1 - squares, squares**2], 3: [squares], 4: [squares, 1 - squares / 2], 6: [squares, 1 - squares, squares**2, 1 - squares / 2]}[colour]
    return encode(np.round(np.stack(planes, axis=-1) * top).astype(np.uint16), depth, colour, interlaced, palette=palette, clear=clear)


def render_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, image): each vector as a PNG, its values from least to greatest as 0 to 1 in rows of a square, the rest 0; the kind of picture is KINDS[key mod their number].

    A null or empty vector, or one that holds a null or no finite number, has a null image; a null key counts as 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            groups: dict[tuple, list[tuple[int, np.ndarray]]] = {}
            for i, (k, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                x = np.array(v if v else [np.nan], float)
                if np.isfinite(x).all():
                    groups.setdefault((len(x), *KINDS[(k or 0) % len(KINDS)]), []).append((i, x))
            for (n, *kind), own in groups.items():
                x = np.stack([v for _, v in own])
                side = int(np.ceil(np.sqrt(n)))
                low, spread = x.min(axis=1, keepdims=True), np.ptp(x, axis=1, keepdims=True)
                squares = np.zeros((len(own), side * side))
                squares[:, :n] = (x - low) / np.where(spread > 0, spread, 1.0)
                for (i, _), image in zip(own, rendered(squares.reshape(-1, side, side), *kind)):
                    out[i] = image
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "image"])

    return vectors.select(f"`{key}`", f"`{column}`").mapInArrow(run, f"`{key}` {vectors.schema[key].dataType.simpleString()}, image binary")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures: every row of embeddings is rendered as one, of every kind in turn, then decoded and hashed."""
    return hash_images(render_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "vec_id", "image")
