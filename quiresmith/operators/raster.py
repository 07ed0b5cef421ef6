"""Pixels of scanned pages in numpy: orientation, rules, skew, contrast, noise, threshold, ink profile.

An image is a uint8 array, two-dimensional for gray or with three channels in BGR order. As a table an image is a row
(page_id, w, h, pixels), pixels being gray bytes row by row; each is worked on by itself, so nothing is shuffled.

Defined cases: an image without ink keeps its orientation and skew; a page whose pixels are null, have no area or don't
fill w * h has no ink profile and no processed image (null); repeated rows are worked on each.

Where libraries differ in detail, this is what holds here: beyond the edge an opening sees ink; skew is levelled in both
directions; rules are filled from their rims inwards with means weighted by distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.operators.profile import page_ranges

#: Fixed values of page preparation.
MIN_DPI = 320
CLAHE_LIMIT, CLAHE_TILES = 2.0, 8
DENOISE_H, DENOISE_PATCH, DENOISE_SEARCH = 12, 7, 21
SKEW_LEAST, SKEW_MOST = 0.2, 10.0
ADAPTIVE_SIZE, ADAPTIVE_OFFSET, HARD_LEVEL = 31, 15, 110
RULE_LEAST, RULE_SHARE, LINE_SHARE, INPAINT_RADIUS = 40, 8, 30, 3
PAPER = 255


def to_gray(img: np.ndarray) -> np.ndarray:
    if img.ndim == 2:
        return img
    return np.rint(img[:, :, :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """Level t that best parts pixels into <= t and > t; the lowest of equal ones, 0 for a single shade."""
    n = np.cumsum(np.bincount(gray.ravel(), minlength=256))
    s = np.cumsum(np.bincount(gray.ravel(), minlength=256) * np.arange(256))
    total, mass = int(n[-1]), int(s[-1])
    rest = n * (total - n)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.where(rest > 0, (total * s - n * mass).astype(np.float64) ** 2 / rest, -1.0)
    return int(np.argmax(spread)) if spread.max() >= 0 else 0


def ink_of(gray: np.ndarray) -> np.ndarray:
    return gray <= otsu(gray)


def long_runs(mask: np.ndarray, length: int) -> np.ndarray:
    """What an opening by a flat line of `length` keeps: a row's runs of at least that length.

    Beyond the edge counts as ink, so a run that touches an edge may be short by the half that lies outside.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1]
    beyond = length // 2
    keep = b - a >= length - np.where(a == 0, beyond, 0) - np.where(b == w, length - 1 - beyond, 0)
    step = np.zeros((h, w + 1), np.int32)
    step[row[keep], a[keep]] = 1
    step[row[keep], b[keep]] -= 1
    return np.cumsum(step, axis=1)[:, :w] > 0


def column_ink(gray: np.ndarray) -> np.ndarray:
    """Ink pixels of every column, without long horizontal runs."""
    ink = ink_of(gray)
    return (ink & ~long_runs(ink, max(RULE_LEAST, gray.shape[1] // LINE_SHARE))).sum(0)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours of a place that lies t past the second (a = -0.75)."""
    a = -0.75
    far = lambda x: ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    near = lambda x: ((a + 2) * x - (a + 3)) * x * x + 1
    return np.stack([far(t + 1), near(t), near(1 - t), far(2 - t)])


def _sample(img: np.ndarray, x: np.ndarray, y: np.ndarray, border: int | None) -> np.ndarray:
    """Cubic values of a gray image at places; beyond it `border`, or its nearest pixel where that is None."""
    h, w = img.shape
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    wx, wy = _cubic(x - x0), _cubic(y - y0)
    out = np.zeros(x.shape)
    for j in range(4):
        yy = y0 + j - 1
        for i in range(4):
            xx = x0 + i - 1
            v = img[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)].astype(np.float64)
            if border is not None:
                v = np.where((xx >= 0) & (xx < w) & (yy >= 0) & (yy < h), v, border)
            out += wx[i] * wy[j] * v
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


#: Rows of an image resampled together, which bounds memory.
STRIP = 256


def _turn(img: np.ndarray, degrees: float, size: tuple[int, int]) -> np.ndarray:
    """img turned clockwise about its centre onto a canvas (width, height)."""
    if img.ndim == 3:
        return np.stack([_turn(img[:, :, c], degrees, size) for c in range(img.shape[2])], axis=2)
    h, w = img.shape
    cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    out = np.empty((size[1], size[0]), np.uint8)
    dx = np.arange(size[0]) - size[0] / 2
    for at in range(0, size[1], STRIP):
        dy = (np.arange(at, min(at + STRIP, size[1])) - size[1] / 2)[:, None]
        out[at : at + STRIP] = _sample(img, dx * cos + dy * sin + w / 2, -dx * sin + dy * cos + h / 2, PAPER)
    return out


def rotated_size(w: int, h: int, degrees: float) -> tuple[int, int]:
    cos, sin = abs(np.cos(np.radians(degrees))), abs(np.sin(np.radians(degrees)))
    return int(h * sin + w * cos + 1e-9), int(h * cos + w * sin + 1e-9)


def rotate_bound(img: np.ndarray, degrees: float) -> np.ndarray:
    """img turned clockwise on a canvas that holds all of it; quarter turns move pixels as they are."""
    if degrees % 90 == 0:
        return np.rot90(img, -int(degrees // 90) % 4).copy()
    return _turn(img, degrees, rotated_size(img.shape[1], img.shape[0], degrees))


def correct_orientation(img: np.ndarray, detect: Callable[[np.ndarray], float]) -> np.ndarray:
    """img turned by what `detect` says; as it is where that is a whole turn or detection fails."""
    try:
        degrees = detect(img) % 360
    except Exception:  # a detector may raise anything; the page then stays as it is
        return img
    return rotate_bound(img, degrees) if degrees else img


def _spread(mask: np.ndarray) -> np.ndarray:
    """mask with its eight neighbours."""
    p = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_or.reduce([p[j : j + h, i : i + w] for j in range(3) for i in range(3)])


def remove_rulers(img: np.ndarray) -> np.ndarray:
    """img with long straight lines filled from their surroundings."""
    gray = to_gray(img)
    ink = ink_of(gray)
    h, w = ink.shape
    rulers = long_runs(ink, max(RULE_LEAST, w // RULE_SHARE)) | long_runs(ink.T, max(RULE_LEAST, h // RULE_SHARE)).T
    if not rulers.any():
        return img
    hole = _spread(rulers)
    planes = [img] if img.ndim == 2 else [img[:, :, c] for c in range(img.shape[2])]
    filled = [p.astype(np.float64) for p in planes]
    near = [(dy, dx) for dy in range(-INPAINT_RADIUS, INPAINT_RADIUS + 1) for dx in range(-INPAINT_RADIUS, INPAINT_RADIUS + 1) if 0 < dy * dy + dx * dx <= INPAINT_RADIUS**2]
    while hole.any() and not hole.all():
        y, x = np.nonzero(hole & _spread(~hole))
        weight, values = np.zeros(len(y)), [np.zeros(len(y)) for _ in filled]
        for dy, dx in near:
            yy, xx = y + dy, x + dx
            ok = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            yy, xx = np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)
            share = (ok & ~hole[yy, xx]) / (dy * dy + dx * dx)
            weight += share
            for v, p in zip(values, filled, strict=True):
                v += share * p[yy, xx]
        for v, p in zip(values, filled, strict=True):
            p[y, x] = v / weight
        hole[y, x] = False
    done = [np.clip(np.rint(p), 0, 255).astype(np.uint8) for p in filled]
    return done[0] if img.ndim == 2 else np.stack(done, axis=2)


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, in order."""
    points = np.unique(points, axis=0).tolist()
    if len(points) < 3:
        return np.array(points, np.float64)

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]), np.float64)


def skew(gray: np.ndarray) -> float:
    """Degrees, clockwise from level, of the least rectangle around the ink; from -45 to 45, 0 where there is no ink."""
    ink = ink_of(gray)
    rows = np.flatnonzero(ink.any(1))
    if not len(rows) or ink.all():
        return 0.0
    first, last = ink[rows].argmax(1), ink.shape[1] - 1 - ink[rows][:, ::-1].argmax(1)
    corners = _hull(np.concatenate([np.stack([first, rows], 1), np.stack([last, rows], 1)]))
    found = []
    for d in np.roll(corners, -1, axis=0) - corners:
        size = np.hypot(*d)
        if size:
            along, across = corners @ (d / size), corners @ (np.array([-d[1], d[0]]) / size)
            degrees = float((np.degrees(np.arctan2(d[1], d[0])) + 45) % 90 - 45)
            found.append((round(float(np.ptp(along) * np.ptp(across)), 6), abs(degrees), degrees))
    return min(found)[2] if found else 0.0  # the least skew of equal areas


def deskew(gray: np.ndarray) -> np.ndarray:
    """gray with its ink levelled; as it is where the skew is too small to matter or too large to be one."""
    degrees = skew(gray)
    if not SKEW_LEAST <= abs(degrees) <= SKEW_MOST:
        return gray
    return _turn(gray, -degrees, (gray.shape[1], gray.shape[0]))


def ensure_min_dpi(gray: np.ndarray, dpi: int, least: int = MIN_DPI) -> np.ndarray:
    if dpi >= least:
        return gray
    h, w = gray.shape
    scale = least / dpi
    nw, nh = int(w * scale), int(h * scale)
    out = np.empty((nh, nw), np.uint8)
    x = ((np.arange(nw) + 0.5) * w / nw - 0.5)[None, :]
    for at in range(0, nh, STRIP):
        y = ((np.arange(at, min(at + STRIP, nh)) + 0.5) * h / nh - 0.5)[:, None]
        out[at : at + STRIP] = _sample(gray, *np.broadcast_arrays(x, y), None)
    return out


def equalize(gray: np.ndarray, limit: float = CLAHE_LIMIT, tiles: int = CLAHE_TILES) -> np.ndarray:
    """Contrast-limited adaptive histogram equalization over tiles x tiles tiles."""
    h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if h > 1 and w > 1 else "edge")
    parts = padded.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, -1)
    area = th * tw
    counts = np.stack([np.bincount(p, minlength=256) for p in parts])
    most = max(1, int(limit * area / 256))
    over = np.maximum(counts - most, 0).sum(1)
    counts = np.minimum(counts, most) + (over // 256)[:, None]
    for k, left in enumerate((over % 256).tolist()):  # what doesn't divide goes to evenly spaced shades
        if left:
            counts[k, (np.arange(left) * max(1, 256 // left)) % 256] += 1
    maps = np.clip(np.rint(np.cumsum(counts, 1) * (255 / area)), 0, 255).reshape(tiles, tiles, 256)
    fy, fx = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    ay, ax = fy - y0, fx - x0
    ya, yb, xa, xb = (np.clip(k, 0, tiles - 1) for k in (y0, y0 + 1, x0, x0 + 1))
    out = np.empty_like(gray)
    for r in range(h):
        g = gray[r]
        top = maps[ya[r], xa, g] * (1 - ax) + maps[ya[r], xb, g] * ax
        low = maps[yb[r], xa, g] * (1 - ax) + maps[yb[r], xb, g] * ax
        out[r] = np.rint(top * (1 - ay[r]) + low * ay[r])
    return out


def _box(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over squares of size x size."""
    c = np.pad(np.cumsum(np.cumsum(a, 0), 1), ((1, 0), (1, 0)))
    return c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]


def denoise(gray: np.ndarray, h: int = DENOISE_H, patch: int = DENOISE_PATCH, search: int = DENOISE_SEARCH) -> np.ndarray:
    """Non-local means: pixels of a neighbourhood weighted by the likeness of the patches around them."""
    half, reach = patch // 2, search // 2
    wide = np.pad(gray, half + reach, mode="reflect" if min(gray.shape) > half + reach else "edge").astype(np.float32)
    height, width = gray.shape
    out = np.empty_like(gray)
    for at in range(0, height, STRIP):
        n = min(STRIP, height - at)
        rows = wide[at : at + n + 2 * (half + reach)]
        here = rows[reach : reach + n + 2 * half, reach : reach + width + 2 * half]
        total, weight = np.zeros((n, width)), np.zeros((n, width))
        for dy in range(search):
            for dx in range(search):
                there = rows[dy : dy + n + 2 * half, dx : dx + width + 2 * half]
                near = np.exp(-_box((here - there).astype(np.float64) ** 2, patch) / (patch * patch * h * h))
                total += near * there[half : half + n, half : half + width]
                weight += near
        out[at : at + n] = np.rint(total / weight)
    return out


def adaptive(gray: np.ndarray, size: int = ADAPTIVE_SIZE, offset: int = ADAPTIVE_OFFSET) -> np.ndarray:
    """Paper where a pixel is over the Gaussian mean around it less offset, ink elsewhere."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    at = np.arange(size) - size // 2
    kernel = np.exp(-(at**2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    wide = np.pad(gray, size // 2, mode="edge").astype(np.float64)
    rows = sum(k * wide[i : i + gray.shape[0]] for i, k in enumerate(kernel))
    mean = np.rint(sum(k * rows[:, i : i + gray.shape[1]] for i, k in enumerate(kernel)))
    return np.where(gray > mean - offset, PAPER, 0).astype(np.uint8)


def preprocess(img: np.ndarray, dpi: int, aggressive: bool = False) -> np.ndarray:
    """A page ready for recognition: even contrast, less noise, level, dense enough, black and white."""
    gray = ensure_min_dpi(deskew(denoise(equalize(to_gray(img)))), dpi)
    return np.where(gray > HARD_LEVEL, PAPER, 0).astype(np.uint8) if aggressive else adaptive(gray)


def _image(pixels: pa.Scalar, w: int | None, h: int | None) -> np.ndarray | None:
    if not pixels.is_valid or not w or not h or w < 1 or h < 1 or len(pixels.as_buffer()) != w * h:
        return None
    return np.frombuffer(pixels.as_buffer(), np.uint8).reshape(h, w)


Columns = list[tuple[str, str, pa.DataType]]
#: Small results of images that go on together.
TOGETHER = 64


def each(f: Callable[[np.ndarray], tuple], columns: Columns, together: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (page_id, w, h, pixels): page_id and what f gives for each image, nulls where there is none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, together):  # pages are large
                got = []
                for k in range(at, min(at + together, batch.num_rows)):
                    img = _image(batch.column(3)[k], batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                    got.append(f(img) if img is not None else (None,) * len(columns))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, together), *(pa.array(v, c[2]) for v, c in zip(zip(*got, strict=True), columns, strict=True))], ["page_id", *(c[0] for c in columns)])

    return run


def schema(kind: str, columns: Columns) -> str:
    return f"page_id {kind}, " + ", ".join(f"{name} {sql}" for name, sql, _ in columns)


def _each(images: DataFrame, f: Callable[[np.ndarray], tuple], columns: Columns, together: int = 1) -> DataFrame:
    """Rows (page_id, columns): what f gives for each image, nulls where there is none."""
    narrow = images.select("page_id", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "pixels")
    return narrow.mapInArrow(each(f, columns, together), schema(images.schema["page_id"].dataType.simpleString(), columns))


LEVEL: Columns = [("level", "long", pa.int64()), ("skew", "double", pa.float64())]
INK: Columns = [("ink", "array<double>", pa.list_(pa.float64())), ("w", "long", pa.int64()), ("h", "long", pa.int64())]
RANGES: Columns = [("starts", "array<long>", pa.list_(pa.int64())), ("ends", "array<long>", pa.list_(pa.int64()))]


def level_of(img: np.ndarray) -> tuple:
    return otsu(img), skew(img)


def profile_of(img: np.ndarray) -> tuple:
    return column_ink(img).astype(np.float64), img.shape[1], img.shape[0]


def ranges_of(img: np.ndarray) -> tuple:
    """Column ranges of an image."""
    got = page_ranges(column_ink(img).astype(np.float64), img.shape[1], img.shape[0])
    return [a for a, _ in got], [b for _, b in got]


def levels(images: DataFrame) -> DataFrame:
    """(page_id, level, skew): threshold between ink and paper, and degrees of skew."""
    return _each(images, level_of, LEVEL, TOGETHER)


def ink_profile(images: DataFrame) -> DataFrame:
    """(page_id, x, ink, w, h), one row a pixel column, for `profile`'s operators; pages without an image have none."""
    return _exploded(_each(images, profile_of, INK, TOGETHER))


def _exploded(got: DataFrame) -> DataFrame:
    return got.select("page_id", F.posexplode("ink").alias("x", "ink"), "w", "h").withColumn("x", F.col("x").cast("long"))


def prepare(images: DataFrame, dpi: int, aggressive: bool = False) -> DataFrame:
    """images as (page_id, w, h, pixels), ready for recognition."""

    def one(img: np.ndarray) -> tuple:
        out = preprocess(img, dpi, aggressive)
        return out.shape[1], out.shape[0], out.tobytes()

    return _each(images, one, [("w", "long", pa.int64()), ("h", "long", pa.int64()), ("pixels", "binary", pa.binary())])
