"""Boxes as Spark columns. Everything here is a built-in expression, so Catalyst sees through it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.constants import DEGENERATE_ASPECT


class Box(NamedTuple):
    """Left, top, right, bottom in pixels."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2

    def columns(self) -> list[Column]:
        return [c.alias(n) for c, n in zip(self, self._fields, strict=True)]


def box(prefix: str = "") -> Box:
    """The box of the columns ``<prefix>x1`` and so on; the prefix may be ``a.`` or ``a_``."""
    return Box(*(F.col(f"{prefix}{n}") for n in Box._fields))


def box_of(struct: Column) -> Box:
    return Box(*(struct[n] for n in Box._fields))


def overlap(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; zero where the union has no area."""
    both = overlap(a, b)
    union = a.area + b.area - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def containment(outer: Box, inner: Box) -> Column:
    """Part of the inner box inside of the outer one; null where the inner has no area."""
    return F.when(inner.area > 0, overlap(outer, inner) / inner.area)


def contains(outer: Box, inner: Box, least: float) -> Column:
    return F.coalesce(containment(outer, inner) >= least, F.lit(False))


def centre_inside(outer: Box, inner: Box) -> Column:
    return inner.cx.between(outer.x1, outer.x2) & inner.cy.between(outer.y1, outer.y2)


def in_head_region(large: Box, small: Box, size: float, part: float, head: float, skip_empty: bool = True) -> Column:
    """A small box in the upper part of a larger one: less than ``size`` of its area, ``part`` of it inside, centre above ``head``.

    ``skip_empty``: a box without area needs no overlap; otherwise it never fits.
    """
    inside = containment(large, small) >= part
    inside = F.coalesce(inside, F.lit(True)) if skip_empty else F.coalesce(inside, F.lit(False))
    return (small.area < large.area * size) & inside & (small.cy <= large.y1 + large.height * head)


def aspect_ratio(b: Box) -> Column:
    return F.when((b.width <= 0) | (b.height <= 0), F.lit(DEGENERATE_ASPECT)).otherwise(F.greatest(b.width / F.when(b.height != 0, b.height), b.height / F.when(b.width != 0, b.width)))


def padded(b: Box, width: Column, height: Column, percent: Column | float) -> Box:
    """Grown by a percentage of the box on each side, inside of the image."""
    px, py = b.width * percent / 100, b.height * percent / 100
    return Box(F.greatest(F.lit(0.0), b.x1 - px), F.greatest(F.lit(0.0), b.y1 - py), F.least(width.cast("double"), b.x2 + px), F.least(height.cast("double"), b.y2 + py))


def padded_int(b: Box, width: Column, height: Column, percent: Column | float) -> Box:
    """As ``padded``, each corner cut to whole pixels towards zero."""
    px, py = b.width * percent / 100, b.height * percent / 100
    return Box(F.greatest(F.lit(0), (b.x1 - px).cast("int")), F.greatest(F.lit(0), (b.y1 - py).cast("int")), F.least(width, (b.x2 + px).cast("int")), F.least(height, (b.y2 + py).cast("int")))


def crop(b: Box, width: Column, height: Column, pixels: int) -> Box:
    """Corners in whole pixels with a margin, inside of the image."""
    return Box(F.greatest(F.lit(0), (b.x1 - pixels).cast("int")), F.greatest(F.lit(0), (b.y1 - pixels).cast("int")), F.least(width, (b.x2 + pixels).cast("int")), F.least(height, (b.y2 + pixels).cast("int")))


def band(b: Box, top: float, bottom: float) -> Box:
    """The part of a box between two fractions of its height."""
    return Box(b.x1, b.y1 + b.height * top if top else b.y1, b.x2, b.y1 + b.height * bottom if bottom < 1 else b.y2)


def odd_kernel(k: Column, least: int = 3) -> Column:
    k = F.greatest(k, F.lit(least))
    return F.when(k % 2 == 0, k + 1).otherwise(k)


def dynamic_kernel(width: Column, height: Column, base: Column | int) -> Column:
    """Blur kernel: two fifths of the longer side, ``base`` at least, odd."""
    k = F.greatest(F.lit(base) if isinstance(base, int) else base, (F.greatest(width, height) * 0.4).cast("int"))
    return F.when(k % 2 == 0, k + 1).otherwise(k)


def to_coco(b: Box) -> list[Column]:
    return [b.x1.alias("x"), b.y1.alias("y"), b.width.alias("w"), b.height.alias("h")]


def normalised(b: Box, width: Column, height: Column, clamp: bool = False) -> list[Column]:
    """Centre and size in fractions of the image."""
    out = [b.cx / width, b.cy / height, b.width / width, b.height / height]
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) for c in out] if clamp else out


def from_normalised(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    return Box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def from_coco(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def offset(b: Box, dx: Column, dy: Column) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def yolo_line(class_id: Column, values: list[Column]) -> Column:
    """``class cx cy w h`` with six digits after the point; halves go to the even digit."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, *(F.bround(v, 6) for v in values))
