"""Pages of text as images: greedy lines by glyph widths, and a raster in Arrow batches with the columns of Spark's image source."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.nested import FONT_SIZE, LINE_SPACING, MARGIN, PAGE_HEIGHT, PAGE_WIDTH
from foliant.functions.text import clean_text

#: Pixels that a character advances: PLAIN, more for capitals and wide letters, less for narrow ones.
PLAIN, CAPITAL, WIDE, NARROW = 14, 3, 6, 7
WIDE_SET, NARROW_SET = "mwMW@%", "ijlt.,:;'!|"
#: Rows of bits of a glyph.
ROWS = 7
IMAGE = "origin string, height int, width int, nChannels int, data binary"


def advance(ch: str) -> int:
    """The pixels of one character."""
    return PLAIN + CAPITAL * ("A" <= ch <= "Z") + WIDE * (ch in WIDE_SET) - NARROW * (ch in NARROW_SET)


def text_width(c: Column) -> Column:
    """The pixels of a text; one for every code point, as ``advance`` has it."""
    left = lambda pattern: F.length(F.regexp_replace(c, pattern, ""))
    return F.length(c) * PLAIN + left("[^A-Z]") * CAPITAL + left(f"[^{WIDE_SET}]") * WIDE - left(rf"[^{NARROW_SET}]") * NARROW


#: The advances of the code points below 127, and at 127 that of all others.
_ADVANCES = np.array([*(advance(chr(i)) for i in range(127)), PLAIN])


def _measured(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text, and the pixels before each of them and after the last."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return codes, np.concatenate(([0], np.cumsum(_ADVANCES[np.minimum(codes, 127)])))


def _breaks(codes: np.ndarray, before: np.ndarray, width: int, most: int | None = None) -> list[tuple[int, int]]:
    """Start and end of the greedy lines of a clean text, of all or the first so many; a line ends where the next word no longer fits."""
    if not len(codes):
        return []
    ends = np.append(np.flatnonzero(codes == 32), len(codes))
    reach, ends = before[ends].tolist(), ends.tolist()
    lines, word, start = [], 0, 0
    while word < len(ends) and (most is None or len(lines) < most):
        word = max(bisect_right(reach, int(before[start]) + width, word), word + 1)
        lines.append((start, ends[word - 1]))
        start = ends[word - 1] + 1
    return lines


def wrapped(text: Column, width: int = PAGE_WIDTH - 2 * MARGIN) -> Column:
    """A list of (line, width): greedy lines of at most so many pixels, a wider word alone on its line, and the pixels of each; none for
    an empty text. Whole texts, in Arrow batches: time and memory in proportion to a text's length."""

    @F.arrow_udf("array<struct<line:string,width:int>>")
    def lines(texts: pa.Array) -> pa.Array:
        offsets, found, pixels = [0], [], []
        for t in texts.to_pylist():
            codes, before = _measured(t)
            for a, b in _breaks(codes, before, width):
                found.append(t[a:b])
                pixels.append(int(before[b] - before[a]))
            offsets.append(len(found))
        rows = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(pixels, pa.int32())], ["line", "width"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return lines(clean_text(text))


def wrap_pixels(text: Column, width: int = PAGE_WIDTH - 2 * MARGIN) -> Column:
    """The lines of ``wrapped`` alone."""
    return wrapped(text, width)["line"]


def room(height: int = PAGE_HEIGHT) -> int:
    """The lines that a page has room for: from the margin down, until the next would start below the lower margin."""
    return (height - 2 * MARGIN) // (FONT_SIZE + LINE_SPACING) + 1


def drawn_lines(lines: Column, height: int = PAGE_HEIGHT) -> Column:
    """The lines that a page has room for."""
    return F.slice(lines, 1, room(height))


def glyph(ch: str) -> np.ndarray:
    """The dark pixels of a character: five by seven bits of a number made of its code point, stretched over its box but for a pixel on the right.
    A stand-in for a font, of which none is given; every character has a mark of its own."""
    n = ord(ch) * 0x9E3779B97F4A7C15 % (1 << 64) >> 29 | 1
    bits = np.array([n >> i & 1 for i in range(35)], bool).reshape(7, 5)
    wide = advance(ch) - 1
    out = np.zeros((FONT_SIZE, advance(ch)), bool)
    out[:, :wide] = bits[np.arange(FONT_SIZE) * 7 // FONT_SIZE][:, np.arange(wide) * 5 // wide]
    return out


_GLYPHS: dict[str, np.ndarray] = {}


def draw(lines: list[str], width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT) -> np.ndarray:
    """A page of bytes, 255 for white; what leaves the page is cut off."""
    page = np.full((height, width), 255, np.uint8)
    for row, line in enumerate(lines):
        x, y = MARGIN, MARGIN + row * (FONT_SIZE + LINE_SPACING)
        for ch in line:
            if x >= width or y >= height:
                break
            if ch != " ":
                if len(_GLYPHS) > 10_000:
                    _GLYPHS.clear()
                mark = _GLYPHS.setdefault(ch, glyph(ch)) if ch not in _GLYPHS else _GLYPHS[ch]
                part = page[y : y + FONT_SIZE, x : x + mark.shape[1]]
                part[mark[: part.shape[0], : part.shape[1]]] = 0
            x += advance(ch)
    return page


class PageFeatures:
    """Pages of text resized to size x size without the pixels in between: the bilinear weights are whole numbers over one divisor and repeat
    along a line, so each glyph has its sums by place in that period, and a line is the sum of its glyphs' sums. As exact as the resized raster."""

    #: Glyphs that are kept from page to page.
    KEPT = 2_000

    def __init__(self, size: int, width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT):
        self.size, self.width, self.height, self.lines = size, width, height, room(height)
        self.period = width // gcd(width, size)
        widest = PLAIN + CAPITAL + WIDE
        self.reach = widest * size // width + 3 + 2 * size // width
        pixel = np.arange(self.period)[:, None, None] + np.arange(widest)[None, None, :]
        self.weights = self._near(pixel, self._first(np.arange(self.period))[:, None, None] + np.arange(self.reach)[None, :, None], width).astype(np.float32)
        self.share = 1.0 / self._near(np.arange(width)[None, :], np.arange(size)[:, None], width).sum(axis=1)
        down = self._near(np.arange(height)[None, :], np.arange(size)[:, None], height)
        top = MARGIN + np.repeat(np.arange(self.lines) * (FONT_SIZE + LINE_SPACING), ROWS) + np.tile(np.arange(ROWS) * (FONT_SIZE // ROWS), self.lines)
        cells = np.stack([down[:, y : y + FONT_SIZE // ROWS].sum(axis=1) for y in top], axis=1) / down.sum(axis=1, keepdims=True)
        self.blocks = []
        for at in range(0, size, 14):
            own = cells[at : at + 14]
            used = np.flatnonzero(own.any(axis=0))
            if len(used):
                self.blocks.append((at, used[0], np.ascontiguousarray(own[:, used[0] : used[-1] + 1])))
        self._clear()

    def _near(self, pixel: np.ndarray, out: np.ndarray, length: int) -> np.ndarray:
        """The weights of ``files.resize_weights``, times twice the longer of length and size."""
        return np.clip(2 * max(length, self.size) - np.abs((2 * pixel + 1) * self.size - (2 * out + 1) * length), 0, None)

    def _first(self, x: np.ndarray) -> np.ndarray:
        """The first output that a glyph from pixel x on touches; down to ``-reach``."""
        return ((2 * x + 1) * self.size - self.width - 2 * max(self.width, self.size)) // (2 * self.width) + 1

    def _clear(self) -> None:
        self.known, self.place, self.sums = 0, np.full(0x110000, -1, np.int32), np.zeros((64, self.period, self.reach * ROWS), np.float32)

    def _meet(self, codes: np.ndarray) -> None:
        """The sums of glyphs that aren't known."""
        for code in codes.tolist():
            if self.known == len(self.sums):
                self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
            cells = glyph(chr(code))[:: FONT_SIZE // ROWS].T.astype(np.float32)
            self.sums[self.known] = (self.weights[:, :, : len(cells)] @ cells).reshape(self.period, -1)
            self.place[code] = self.known
            self.known += 1

    def of(self, text: str) -> np.ndarray:
        """[size, size] of a clean text's first page, 1.0 for white."""
        codes, before = _measured(text)
        lines, out = _breaks(codes, before, self.width - 2 * MARGIN, self.lines), np.ones((self.size, self.size))
        if not lines:
            return out
        if self.known > self.KEPT:
            self._clear()
        longest = self.width - MARGIN
        parts = [(a, min(b, a + longest)) for a, b in lines]
        own = np.concatenate([np.arange(a, b) for a, b in parts])
        row = np.repeat(np.arange(len(parts)), [b - a for a, b in parts])
        x = MARGIN + before[own] - before[[a for a, _ in parts]][row]
        drawn = (codes[own] != 32) & (x < self.width)
        own, row, x = own[drawn], row[drawn], x[drawn]
        mark, end = codes[own], x + (before[own + 1] - before[own])
        if (new := self.place[mark] < 0).any():
            self._meet(np.unique(mark[new]))
        sums, wide = self.sums[self.place[mark], x % self.period], self.size + 2 * self.reach
        for i in np.flatnonzero(end > self.width).tolist():
            cells = glyph(chr(mark[i]))[:: FONT_SIZE // ROWS, : self.width - x[i]].T.astype(np.float32)
            sums[i] = (self.weights[x[i] % self.period, :, : len(cells)] @ cells).ravel()
        first = ((row * wide + self.reach + self._first(x)) * ROWS)[:, None] + np.arange(self.reach * ROWS)
        dark = np.bincount(first.ravel(), sums.ravel(), len(parts) * wide * ROWS + self.reach * ROWS)[: len(parts) * wide * ROWS]
        dark = dark.reshape(len(parts), wide, ROWS)[:, self.reach : self.reach + self.size].transpose(0, 2, 1).reshape(-1, self.size) * self.share
        for at, start, weights in self.blocks:
            have = dark[start : start + weights.shape[1]]
            if len(have):
                out[at : at + len(weights)] -= weights[:, : len(have)] @ have
        return out


def png(pixels: np.ndarray) -> bytes:
    """Bytes of [height, width] (grey) or [height, width, 3] (red, green, blue) as a PNG file."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = pixels.shape[:2]
    rows = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def rendered(df: DataFrame, key: str, text: str, width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT, file: bool = False) -> DataFrame:
    """Each text's first page with the columns of Spark's image source (origin is the key), or with ``file`` (origin, content) as a PNG file.

    The cut to one page is the feature; lines are wrapped in the JVM over the whole text, and only those of the page are sent to Python.
    Null and empty texts give a white page.
    """
    lines = drawn_lines(wrap_pixels(F.col(text), width - 2 * MARGIN), height)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 16):  # pages are large
                part = b.iloc[at : at + 16]
                pages = [draw(list(x), width, height) for x in part["lines"]]
                if file:
                    yield pd.DataFrame({"origin": part["origin"], "content": [png(p) for p in pages]})
                else:
                    yield pd.DataFrame({"origin": part["origin"], "height": height, "width": width, "nChannels": 1, "data": [p.tobytes() for p in pages]})

    return df.select(F.col(key).cast("string").alias("origin"), lines.alias("lines")).mapInPandas(run, "origin string, content binary" if file else IMAGE)


def page_features(df: DataFrame, key: str, text: str, size: int = 224, mean: tuple[float, ...] = (0.485, 0.456, 0.406), std: tuple[float, ...] = (0.229, 0.224, 0.225), of: Callable[[np.ndarray], tuple] | None = None, columns: str = "features array<double>") -> DataFrame:
    """(origin, features): ``image_features`` of ``rendered`` in one pass, in which neither pages nor their pixels leave a task.

    of: what is kept of a page's features where they needn't all be rows, as a tuple with a value for each of ``columns``; it gets the red, green
    and blue planes one after another, in memory that the next page takes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages, planes = PageFeatures(size), np.empty((3, size, size))
        low, wide = (np.array(v, float)[:, None, None] for v in (mean, std))
        names = [c.split()[0] for c in columns.split(", ")]
        for b in batches:
            step = 16 if of is None else max(1, len(b))  # features are large
            for at in range(0, len(b), step):
                part, found = b.iloc[at : at + step], []
                for t in part["clean"]:
                    np.divide(np.subtract(pages.of(t), low, out=planes), wide, out=planes)
                    found.append((planes.ravel().tolist(),) if of is None else of(planes.ravel()))
                yield pd.DataFrame({"origin": part["origin"].tolist(), **{n: [f[i] for f in found] for i, n in enumerate(names)}})

    return df.select(F.col(key).cast("string").alias("origin"), clean_text(F.col(text)).alias("clean")).mapInPandas(run, f"origin string, {columns}")


def heat_images(cells: DataFrame, classes: list[str], size: int = 40) -> DataFrame:
    """(model, content): a PNG of each model's heat map, rows by true and columns by predicted class, from ``heatmap_cells``. A model has
    as many cells as classes squared, so one row holds them."""
    place = lambda c: F.array_position(F.array(*map(F.lit, classes)), F.col(c)) - 1
    one = cells.groupBy("model").agg(F.collect_list(F.struct(place("true_label").cast("int").alias("y"), place("predicted_label").cast("int").alias("x"), "red", "green", "blue")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for own in b["cells"]:
                image = np.full((len(classes) * size, len(classes) * size, 3), 255, np.uint8)
                for c in own:
                    image[c["y"] * size : (c["y"] + 1) * size, c["x"] * size : (c["x"] + 1) * size] = [min(255, c[n]) for n in ("red", "green", "blue")]
                out.append(png(image))
            yield pd.DataFrame({"model": b["model"], "content": out})

    return one.mapInPandas(run, "model string, content binary")
