"""Pixel kernels in numpy, and the UDF boundary around them. Images are BGR arrays of bytes (height, width, 3)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(image, 3, 2) if channels == 1 else image[:, :, :3]


def gray(image: np.ndarray) -> np.ndarray:
    """Luma in fixed-point arithmetic, rounded to whole numbers (weights .114, .587, .299 of B, G, R in 2^-14)."""
    b, g, r = (image[:, :, i].astype(np.int32) for i in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def brightness(image: np.ndarray) -> float:
    return float(image.max(2).mean())


def brightness_gray(g: np.ndarray) -> float:
    """The other brightness: mean of the gray image; zero of an empty one."""
    return float(g.mean()) if g.size else 0.0


def contrast(g: np.ndarray) -> float:
    return float(g.astype(np.float64).std())


def sharpness(g: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian; the border is mirrored without its edge."""
    p = np.pad(g.astype(np.float64), 1, "reflect") if min(g.shape) > 1 else np.pad(g.astype(np.float64), 1, "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def canny(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges: Sobel gradients (sum of magnitudes), thinned across the gradient, kept from ``high`` or joined to those from ``low``."""
    p = np.pad(g.astype(np.int32), 1, "edge")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    m = np.abs(dx) + np.abs(dy)
    q = np.pad(m, 1)
    at = lambda y, x: q[1 + y : 1 + y + m.shape[0], 1 + x : 1 + x + m.shape[1]]
    ay = np.abs(dy).astype(np.int64) << 15
    t = np.abs(dx) * 13573  # tangent of 22.5 degrees in 2^-15
    flat = ay < t
    steep = ay > t + (np.abs(dx).astype(np.int64) << 16)
    same = (dx ^ dy) >= 0
    thin = np.where(flat, (m > at(0, -1)) & (m >= at(0, 1)), np.where(steep, (m > at(-1, 0)) & (m >= at(1, 0)), np.where(same, (m > at(-1, -1)) & (m > at(1, 1)), (m > at(-1, 1)) & (m > at(1, -1)))))
    weak = thin & (m > low)
    out = weak & (m > high)
    while True:
        grown = np.pad(out, 1)
        near = np.zeros_like(out)
        for y in (0, 1, 2):
            for x in (0, 1, 2):
                near |= grown[y : y + out.shape[0], x : x + out.shape[1]]
        near &= weak
        if (near == out).all():
            return out
        out = near


def edge_density(g: np.ndarray, low: float = 50, high: float = 150) -> float:
    e = canny(g, low, high)
    return float(np.count_nonzero(e) / e.size)


def gaussian_weights(k: int) -> np.ndarray:
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    x = np.arange(k) - (k - 1) / 2
    w = np.exp(-(x**2) / (2 * sigma**2))
    return w / w.sum()


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Linear interpolation between the pixels' centres."""
    out = image.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        m = out.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, m - 1), axis) * part
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def blur_rect(image: np.ndarray, x1: float, y1: float, x2: float, y2: float, kernel: int, method: str = "gaussian") -> np.ndarray:
    """The rectangle, in whole pixels and inside of the image, blurred in place: gaussian, pixelate or black. Nothing left: no change."""
    h, w = image.shape[:2]
    x1, y1, x2, y2 = max(0, int(x1)), max(0, int(y1)), min(w, int(x2)), min(h, int(y2))
    if x2 <= x1 or y2 <= y1:
        return image
    roi = image[y1:y2, x1:x2]
    if method == "black":
        roi[:] = 0
    elif method == "pixelate":
        f = max(1, min(x2 - x1, y2 - y1) // 10)
        small = resize(roi, max(1, (y2 - y1) // f), max(1, (x2 - x1) // f))
        ys = np.arange(y2 - y1) * small.shape[0] // (y2 - y1)
        xs = np.arange(x2 - x1) * small.shape[1] // (x2 - x1)
        roi[:] = small[ys[:, None], xs[None, :]]
    else:
        k = max(3, int(kernel))
        k += k % 2 == 0
        weights, r = gaussian_weights(k), k // 2
        out = roi.astype(np.float64)
        for axis in (0, 1):
            n = out.shape[axis]
            place = np.abs(np.arange(-r, n + r))
            if n > 1:  # mirrored without the edge, as often as it takes
                place %= 2 * n - 2
                place = np.where(place >= n, 2 * n - 2 - place, place)
            else:
                place[:] = 0
            p = np.take(out, place, axis)
            out = sum(wt * np.take(p, np.arange(i, i + n), axis) for i, wt in enumerate(weights))
        roi[:] = np.clip(np.rint(out), 0, 255).astype(np.uint8)
    return image


def polygon_mask(points: list[tuple[int, int]], height: int, width: int) -> np.ndarray:
    """Pixels of a polygon, its edges included."""
    y, x = np.mgrid[:height, :width]
    inside = np.zeros((height, width), bool)
    edge = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        edge |= (cross == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return inside | edge


def mask_zones(image: np.ndarray, polygons: list[list[tuple[int, int]]], kernel: int = 99) -> tuple[np.ndarray, int]:
    """Zones blurred one after the other; where they overlap twice."""
    h, w = image.shape[:2]
    for points in polygons:
        blurred = blur_rect(image.copy(), 0, 0, w, h, kernel)
        image = np.where(polygon_mask(points, h, w)[:, :, None], blurred, image)
    return image, len(polygons)


def draw_box(image: np.ndarray, x1: float, y1: float, x2: float, y2: float, color: tuple[int, int, int], thick: int = 2) -> np.ndarray:
    h, w = image.shape[:2]
    x1, y1, x2, y2 = (int(v) for v in (x1, y1, x2, y2))
    for a, b, c, d in ((x1, y1, x2, y1 + thick), (x1, y2 - thick, x2, y2), (x1, y1, x1 + thick, y2), (x2 - thick, y1, x2, y2)):
        image[max(0, b) : min(h, d), max(0, a) : min(w, c)] = color
    return image


#: Rows of five dots, top to bottom, of the signs that labels are written in. Fixed values.
GLYPHS = {
    "0": "01110 10001 10011 10101 11001 10001 01110", "1": "00100 01100 00100 00100 00100 00100 01110", "2": "01110 10001 00001 00010 00100 01000 11111", "3": "11111 00010 00100 00010 00001 10001 01110", "4": "00010 00110 01010 10010 11111 00010 00010",
    "5": "11111 10000 11110 00001 00001 10001 01110", "6": "00110 01000 10000 11110 10001 10001 01110", "7": "11111 00001 00010 00100 01000 01000 01000", "8": "01110 10001 10001 01110 10001 10001 01110", "9": "01110 10001 10001 01111 00001 00010 01100",
    "A": "01110 10001 10001 11111 10001 10001 10001", "B": "11110 10001 10001 11110 10001 10001 11110", "C": "01110 10001 10000 10000 10000 10001 01110", "D": "11100 10010 10001 10001 10001 10010 11100", "E": "11111 10000 10000 11110 10000 10000 11111", "F": "11111 10000 10000 11110 10000 10000 10000",
    "G": "01110 10001 10000 10111 10001 10001 01111", "H": "10001 10001 10001 11111 10001 10001 10001", "I": "01110 00100 00100 00100 00100 00100 01110", "J": "00111 00010 00010 00010 00010 10010 01100", "K": "10001 10010 10100 11000 10100 10010 10001", "L": "10000 10000 10000 10000 10000 10000 11111",
    "M": "10001 11011 10101 10101 10001 10001 10001", "N": "10001 10001 11001 10101 10011 10001 10001", "O": "01110 10001 10001 10001 10001 10001 01110", "P": "11110 10001 10001 11110 10000 10000 10000", "Q": "01110 10001 10001 10001 10101 10010 01101", "R": "11110 10001 10001 11110 10100 10010 10001",
    "S": "01111 10000 10000 01110 00001 00001 11110", "T": "11111 00100 00100 00100 00100 00100 00100", "U": "10001 10001 10001 10001 10001 10001 01110", "V": "10001 10001 10001 10001 10001 01010 00100", "W": "10001 10001 10001 10101 10101 10101 01010", "X": "10001 10001 01010 00100 01010 10001 10001",
    "Y": "10001 10001 10001 01010 00100 00100 00100", "Z": "11111 00001 00010 00100 01000 10000 11111", "-": "00000 00000 00000 11111 00000 00000 00000", ":": "00000 01100 01100 00000 01100 01100 00000", ".": "00000 00000 00000 00000 00000 01100 01100", "_": "00000 00000 00000 00000 00000 00000 11111",
}


def text_mask(text: str, scale: int = 1) -> np.ndarray:
    """Dots of a line of text, seven dots high, letters as capitals; signs without a glyph are blank."""
    signs = [np.array([[c == "1" for c in row] for row in GLYPHS[s].split()]) if s in GLYPHS else np.zeros((7, 5), bool) for s in text.upper()]
    mask = np.concatenate([np.pad(s, ((0, 0), (0, 1))) for s in signs], 1) if signs else np.zeros((7, 0), bool)
    return mask.repeat(scale, 0).repeat(scale, 1)


def draw_text(image: np.ndarray, text: str, x: int, y: int, color: tuple[int, int, int], scale: int = 1) -> np.ndarray:
    """Text with its upper left corner at a pixel, as far as the image goes."""
    mask = text_mask(text, scale)
    part = image[max(0, y) : y + mask.shape[0], max(0, x) : x + mask.shape[1]]
    own = mask[max(0, -y) :, max(0, -x) :][: part.shape[0], : part.shape[1]]
    part[own] = color
    return image


def overlay_time(image: np.ndarray, label: str) -> np.ndarray:
    """The capture time in yellow on a box that keeps 40% of the picture and is black for the rest, larger on larger images."""
    scale = max(1, round(max(0.8, image.shape[1] / 1500) * 3))
    mask = text_mask(label, scale)
    pad = 2 * scale
    box = image[: mask.shape[0] + 2 * pad, : mask.shape[1] + 2 * pad]
    box[:] = np.rint(box * 0.4).astype(np.uint8)
    return draw_text(image, label, pad, pad, (0, 255, 255), scale)


def draw_detection(image: np.ndarray, x1: float, y1: float, x2: float, y2: float, label: str, color: tuple[int, int, int]) -> np.ndarray:
    """A detection's box with its label above, or inside at the image's upper edge."""
    draw_box(image, x1, y1, x2, y2, color)
    return draw_text(image, label, int(x1), int(y1) - 9 if y1 >= 9 else int(y1) + 3, color)


def encode_png(image: np.ndarray) -> bytes:
    rgb = np.ascontiguousarray(image[:, :, ::-1])
    raw = np.concatenate([np.zeros((rgb.shape[0], 1), np.uint8), rgb.reshape(rgb.shape[0], -1)], 1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def encode_bmp(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    row = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = image[::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + h * row, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * row, 0, 0, 0, 0) + body.tobytes()


METRICS = "path string, brightness double, contrast double, sharpness double, edge_density double"


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.data is None or pd.isna(row.height):
                out.append((row.path, None, None, None, None))
                continue
            image = decode(row.data, int(row.height), int(row.width), int(row.n_channels))
            if "cx1" in batch.columns and not pd.isna(row.cx1):
                image = image[int(row.cy1) : int(row.cy2), int(row.cx1) : int(row.cx2)]
            g = gray(image)
            out.append((row.path, brightness(image), contrast(g), sharpness(g), edge_density(g)))
        yield pd.DataFrame(out, columns=["path", "brightness", "contrast", "sharpness", "edge_density"])


def measure(images: DataFrame) -> DataFrame:
    """All four metrics of each image in one pass over its pixels; unreadable images have nulls. Crops: ``cx1`` ... ``cy2``."""
    crop = [c for c in ("cx1", "cy1", "cx2", "cy2") if c in images.columns]
    return images.select("path", "height", "width", "n_channels", "data", *crop).mapInPandas(_measure, METRICS)


def _render(method: str, drawn: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                image = decode(row.data, int(row.height), int(row.width), int(row.n_channels)).copy()
                if row.zones is not None and len(row.zones):
                    image, _ = mask_zones(image, [[(int(p["x"]), int(p["y"])) for p in z] for z in row.zones])
                steps = sorted(row.plan if row.plan is not None else [], key=lambda s: s["seq"])
                for step in steps:
                    blur_rect(image, step["x1"], step["y1"], step["x2"], step["y2"], step["kernel"], method)
                review = image.copy() if drawn else None
                if row.label:
                    overlay_time(image, row.label)
                if drawn:
                    for step in steps:
                        draw_detection(review, step["x1"], step["y1"], step["x2"], step["y2"], step["tier"], (0, 255, 0))
                out.append((row.path, encode_png(image), encode_png(review) if drawn else None))
            yield pd.DataFrame(out, columns=["path", "content", "review"])

    return run


def render(images: DataFrame, plan: DataFrame, zones: DataFrame | None = None, labels: DataFrame | None = None, method: str = "gaussian", review: bool = False) -> DataFrame:
    """``path``, ``content`` (PNG) and ``review`` (boxes drawn; null unless asked for) of images with their blur plan (``path``, ``seq``, rectangle, ``kernel``, ``tier``) carried out in order.

    ``zones``: ``path``, ``points``, blurred first; ``labels``: ``path``, ``label``, the time that is written on the image.
    """
    from pyspark.sql import functions as F

    tier = F.col("tier") if "tier" in plan.columns else F.lit("")
    steps = plan.groupBy("path").agg(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2", "kernel", tier.alias("tier"))).alias("plan"))
    out = images.where("data is not null").join(steps, "path", "left")
    polygons = "array<array<struct<x:int,y:int>>>"
    out = out.join(zones.groupBy("path").agg(F.collect_list("points").alias("zones")), "path", "left") if zones is not None else out.withColumn("zones", F.lit(None).cast(polygons))
    out = out.join(labels.select("path", "label"), "path", "left") if labels is not None else out.withColumn("label", F.lit(None).cast("string"))
    return out.select("path", "height", "width", "n_channels", "data", "plan", "zones", "label").mapInPandas(_render(method, review), "path string, content binary, review binary")
