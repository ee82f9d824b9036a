"""Image work in numpy, for pixels that only Python holds: binary masks, boxes of regions, and painted masks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import LABEL_COLOURS
from foliant.operators import isolation
from foliant.operators.regions import LEAST_PIXELS, MAX_REGIONS

#: Part of a page that a box needs, and the side of the square that cleans a mask.
LEAST_AREA, KERNEL = 0.001, 5


def otsu(values: np.ndarray) -> float:
    """The threshold that parts values from 0 to 1 into two classes of the greatest variance between."""
    levels = np.clip((values * 255).astype(np.int64), 0, 255).ravel()
    n = np.bincount(levels, minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mean = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * below - mean * total) ** 2 / (below * (total - below))
    return float(np.nanargmax(np.where(np.isfinite(between), between, -1.0))) / 255


def _grown(mask: np.ndarray, by: int) -> np.ndarray:
    # a square grows a line at a time, then a column at a time
    h, w = mask.shape
    padded = np.zeros((h + 2 * by, w + 2 * by), bool)
    padded[by : by + h, by : by + w] = mask
    wide = padded[:, :w].copy()
    for x in range(1, 2 * by + 1):
        wide |= padded[:, x : x + w]
    out = wide[:h].copy()
    for y in range(1, 2 * by + 1):
        out |= wide[y : y + h]
    return out


def cleaned(mask: np.ndarray, kernel: int = KERNEL) -> np.ndarray:
    """Without specks and holes smaller than the kernel: opened, then closed."""
    by = kernel // 2
    shrunk = lambda m: ~_grown(~m, by)
    return shrunk(_grown(_grown(shrunk(mask), by), by))


def binary_mask(probs: np.ndarray, threshold: float = -1) -> np.ndarray:
    return cleaned(probs > (otsu(probs) if threshold < 0 else threshold))


def boxes(mask: np.ndarray, least_area: float = LEAST_AREA, most: int = MAX_REGIONS) -> list[tuple[int, int, int, int]]:
    """Boxes (left, top, right, bottom) of connected areas, the largest first, from the runs of each line."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edged = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    edged[:, 1:-1] = mask
    lines, edges = np.nonzero(edged[:, 1:] != edged[:, :-1])
    runs, before, now, last = [], [], [], -1
    for y, a, b in zip(lines[::2].tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if y != last:
            before, now, last = now if y == last + 1 else [], [], y
        i = len(parent)
        parent.append(i)
        runs.append((a, y, b - 1))
        for p, q, j in before:
            if p <= b and a <= q:  # diagonal neighbours touch
                parent[root(i)] = root(j)
        now.append((a, b, i))
    found: dict[int, list[int]] = {}
    for i, (a, y, b) in enumerate(runs):
        box = found.setdefault(root(i), [a, y, b, y])
        box[:] = min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y)
    area = lambda b: (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
    large = [tuple(b) for b in found.values() if area(b) >= least_area * mask.size]
    return sorted(large, key=lambda b: (-area(b), b))[:most]


def upscaled(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """pixels (by row and column first) at another size, each new pixel from the old one that lies at its place."""
    rows = np.arange(height) * pixels.shape[0] // height
    columns = np.arange(width) * pixels.shape[1] // width
    return pixels[rows[:, None], columns]


REGION = "page_id string, page_number int, label int, ith int, confidence double, x0 int, y0 int, x1 int, y1 int, width int, height int"


def page_regions(p) -> list[tuple]:
    """Regions of one page of label probabilities, as REGION."""
    out = []
    probs = np.frombuffer(p.probs, np.float32).reshape(int(p.height), int(p.width), -1)
    high, wide = (s if pd.isna(n) else int(n) for n, s in zip((p.page_height, p.page_width), probs.shape, strict=False))
    count = np.bincount(probs.argmax(axis=2).ravel(), minlength=probs.shape[2])
    for label in range(1, probs.shape[2]):
        if count[label] < LEAST_PIXELS:
            continue
        own = upscaled(probs[:, :, label], high, wide)
        for ith, (a, b, c, d) in enumerate(boxes(upscaled(binary_mask(probs[:, :, label]), high, wide))):
            total, area = float(own[b : d + 1, a : c + 1].sum()), (c - a) * (d - b)
            if area:
                out.append((p.page_id, p.page_number, label, ith, total / area, a, b, c, d, wide, high))
    return out


def regions_or_errors(pages: DataFrame) -> DataFrame:
    """Regions of each page of label probabilities, with error; a page that cannot be used is one row with its error.

    pages: page_id, page_number, height, width and probs (float32, by row, column, label). height and width are the network's; with
    columns page_height and page_width, boxes, confidence and fractions are those of the page at that size (nulls: as it
    is). Masks are made, and labels' pixels counted, at the network's size.
    """
    size = [F.col(c) if c in pages.columns else F.lit(None).cast("int").alias(c) for c in ("page_height", "page_width")]
    return isolation.each(pages.select("page_id", "page_number", "height", "width", "probs", *size), page_regions, REGION, ["page_id", "page_number"])


def regions_from_probs(pages: DataFrame) -> DataFrame:
    """Regions of the pages that can be used; isolation.parted(regions_or_errors(...)) tells the others too."""
    return regions_or_errors(pages).where("error is null").drop("error")


def png(pixels: np.ndarray) -> bytes:
    """An image of 8-bit red, green and blue as a PNG file."""
    h, w, _ = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + line.tobytes() for line in np.ascontiguousarray(pixels, np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def painted_mask(width: int, height: int, strokes: list[tuple[int, tuple[int, int, int, int]]]) -> np.ndarray:
    """Rectangles (label, (x, y, w, h)) in their labels' colours on black, later ones over earlier ones, cut at the edges."""
    out = np.zeros((height, width, 3), np.uint8)
    for label, (x, y, w, h) in strokes:
        out[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = LABEL_COLOURS[label]
    return out


def mixed_mask(masks: list[tuple[tuple[int, int, int], np.ndarray]]) -> np.ndarray:
    """Colours summed where grey masks of 0 to 255 are white; sums beyond 255 wrap."""
    total = sum(np.multiply.outer(mask / 255, np.array(colour, float)) for colour, mask in masks)
    return np.asarray(total).astype(np.int64).astype(np.uint8)


def png_pixels(content: bytes) -> np.ndarray:
    """The pixels of a PNG of 8-bit red, green and blue that png() made, or of one with the same kind of lines."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, size = 8, b"", None
    while at < len(content):
        (n,) = struct.unpack(">I", content[at : at + 4])
        kind, part = content[at + 4 : at + 8], content[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", content[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a part of the PNG is damaged")
        size = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else size
        data += part if kind == b"IDAT" else b""
        at += 12 + n
    if not size or size[2:4] != (8, 2) or size[6]:
        raise ValueError("not 8-bit colours without interlace")
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], 1 + 3 * size[0])
    if lines[:, 0].any():
        raise ValueError("lines are filtered")
    return lines[:, 1:].reshape(size[1], size[0], 3)


def _flat(pages: DataFrame) -> DataFrame:
    """pages whose strokes are plain numbers, five for each: as structs they would become a dictionary each in a worker, and a batch of
    pages some gigabytes."""
    numbers = F.transform("strokes", lambda s: F.array(*[s[c].cast("int") for c in ("label", "x", "y", "w", "h")]))
    return pages.select("file_name", "width", "height", F.flatten(numbers).alias("strokes"))


def _strokes(p) -> list[tuple]:
    return [(label, tuple(box)) for label, *box in np.asarray(p.strokes).reshape(-1, 5).tolist()] if p.strokes is not None else []


def mask_files(pages: DataFrame) -> DataFrame:
    """A PNG mask for each page: file_name, content and error. pages: file_name, width, height and strokes, an ordered array of
    struct(label, x, y, w, h) or null. Later strokes lie over earlier ones; a page without strokes is black."""
    work = lambda p: [(p.file_name, png(painted_mask(int(p.width), int(p.height), _strokes(p))))]
    return isolation.each(_flat(pages), work, "file_name string, content binary", ["file_name"])


def composite_mask(width: int, height: int, strokes: list[tuple[int, tuple[int, int, int, int]]]) -> np.ndarray:
    """Masks of each label in white, and their colours summed where they are: labels that overlap mix, and wrap beyond 255."""
    grey: dict[int, np.ndarray] = {}
    for label, (x, y, w, h) in strokes:
        grey.setdefault(label, np.zeros((height, width), np.uint8))[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = 255
    return mixed_mask([(LABEL_COLOURS[k], m) for k, m in grey.items()]) if grey else np.zeros((height, width, 3), np.uint8)


def composite_files(pages: DataFrame) -> DataFrame:
    """A PNG of mixed colours for each page, as mask_files() takes and gives them; a page without strokes is black."""
    work = lambda p: [(p.file_name, png(composite_mask(int(p.width), int(p.height), _strokes(p))))]
    return isolation.each(_flat(pages), work, "file_name string, content binary", ["file_name"])


def mask_colours(files: DataFrame) -> DataFrame:
    """Colours of mask files (file_name, content): file_name, width, height, red, green, blue, n pixels and the sum of their places,
    counted line by line from 0; with error, as isolation.each() gives it."""

    def work(p) -> list[tuple]:
        pixels = png_pixels(bytes(p.content))
        code = (pixels.astype(np.int64) * (65536, 256, 1)).sum(axis=2).ravel()
        found, at, n = np.unique(code, return_inverse=True, return_counts=True)
        places = np.bincount(at, np.arange(code.size)).astype(np.int64)
        high, wide, _ = pixels.shape
        return [(p.file_name, wide, high, c >> 16, c >> 8 & 255, c & 255, k, s) for c, k, s in zip(found.tolist(), n.tolist(), places.tolist(), strict=True)]

    return isolation.each(files.select("file_name", "content"), work, "file_name string, width int, height int, red int, green int, blue int, n long, places long", ["file_name"])
