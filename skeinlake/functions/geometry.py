"""Boxes as columns: an array ``[x1, y1, x2, y2]`` or four numbers. Undefined results are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(box: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.get(box, F.lit(i)).cast("double") for i in range(4))


def is_box(box: Column) -> Column:
    """Four ordered, non-negative coordinates; null for no box at all."""
    x1, y1, x2, y2 = corners(box)
    return F.when(box.isNotNull(), F.coalesce((F.size(box) == 4) & (x1 >= 0) & (y1 >= 0) & (x1 < x2) & (y1 < y2), F.lit(False)))


def in_image(box: Column, size: Column) -> Column:
    """Whether the box ends inside an image of ``size`` [w, h]; null when the size is unknown."""
    _, _, x2, y2 = corners(box)
    return (x2 <= F.get(size, F.lit(0))) & (y2 <= F.get(size, F.lit(1)))


def area(box: Column) -> Column:
    x1, y1, x2, y2 = corners(box)
    return (x2 - x1) * (y2 - y1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty or a box is missing."""
    ax1, ay1, ax2, ay2 = corners(a)
    bx1, by1, bx2, by2 = corners(b)
    inter = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))
    both = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    whole = (F.size(a) == 4) & (F.size(b) == 4) & (both > 0)
    return F.when(whole, F.try_divide(inter, both)).otherwise(0.0)


def contains(outer: Column, inner: Column) -> Column:
    ox1, oy1, ox2, oy2 = corners(outer)
    ix1, iy1, ix2, iy2 = corners(inner)
    return (ix1 >= ox1) & (iy1 >= oy1) & (ix2 <= ox2) & (iy2 <= oy2)


def overlaps(a: Column, b: Column) -> Column:
    ax1, ay1, ax2, ay2 = corners(a)
    bx1, by1, bx2, by2 = corners(b)
    return (ax1 < bx2) & (bx1 < ax2) & (ay1 < by2) & (by1 < ay2)


def centre(box: Column) -> tuple[Column, Column]:
    x1, y1, x2, y2 = corners(box)
    return (x1 + x2) / 2, (y1 + y2) / 2


def centre_inside(inner: Column, outer: Column) -> Column:
    cx, cy = centre(inner)
    x1, y1, x2, y2 = corners(outer)
    return (cx >= x1) & (cx <= x2) & (cy >= y1) & (cy <= y2)


def centre_distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.hypot(ax - bx, ay - by)


def from_xywh(box: Column) -> Column:
    x, y, w, h = corners(box)
    return F.array(x, y, x + w, y + h)


def coerce_box(fields: dict[str, Column], style: str = "xyxy") -> Column:
    """A box from whichever full set of fields is there: x1.., left.., then x/y/width/height; the last four numbers count as a
    size only when ``style`` says so (xywh, coco)."""
    sets = [("x1", "y1", "x2", "y2"), ("left", "top", "right", "bottom"), ("x", "y", "width", "height")]
    boxes = [F.when(_all_set([fields[k] for k in s]), F.array(*[fields[k].cast("double") for k in s])) for s in sets if all(k in fields for k in s)]
    box = F.coalesce(*boxes)
    return from_xywh(box) if style.lower() in ("xywh", "coco", "xywh_abs") else box


def _all_set(cols: list[Column]) -> Column:
    out = cols[0].isNotNull()
    for c in cols[1:]:
        out = out & c.isNotNull()
    return out


# Places tried for a control box, as shares of the free room right of and below it: the corners, then the middles.
CONTROL_PLACES = ((0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0), (0.5, 1))


def control_box(box: Column, size: Column) -> Column:
    """A box of equal size that does not overlap ``box``: the first of six places of the image that is free, or null."""
    x1, y1, x2, y2 = corners(box)
    w, h = x2 - x1, y2 - y1
    room = F.get(size, F.lit(0)).cast("double") - w, F.get(size, F.lit(1)).cast("double") - h
    at = lambda share, free: F.floor(free * F.lit(float(share))).cast("double")
    spots = [(at(sx, room[0]), at(sy, room[1])) for sx, sy in CONTROL_PLACES]
    boxes = F.array(*[F.array(x, y, x + w, y + h) for x, y in spots])
    return F.when((room[0] >= 0) & (room[1] >= 0), F.get(F.filter(boxes, lambda b: ~overlaps(b, box)), F.lit(0)))


def norm_1023(value: Column, extent: Column) -> Column:
    """Pixel to the 0..1023 grid, half to even, clamped."""
    return F.least(F.greatest(F.bround(F.try_divide(value.cast("double") * 1023, extent), 0).cast("int"), F.lit(0)), F.lit(1023))


def rle_box(counts: Column, height: Column) -> Column:
    """Tight box [x1, y1, x2, y2] (exclusive ends) of a column-major run-length mask whose runs alternate 0, 1, 0, 1...

    Works on runs, not pixels, in one pass: a run inside one column bounds its rows, a run over several columns spans all rows.
    """
    big = F.lit(2**31 - 1).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("on"), big.alias("x1"), big.alias("y1"), F.lit(-1).cast("bigint").alias("x2"), F.lit(-1).cast("bigint").alias("y2"))
    h = height.cast("bigint")

    def step(a: Column, n: Column) -> Column:
        s, e = a["at"], a["at"] + n - 1
        first, last = F.floor(s / h), F.floor(e / h)
        drawn = a["on"] & (n > 0)
        keep = lambda f, new, name: F.when(drawn, f(a[name], new)).otherwise(a[name]).alias(name)
        low, high = F.when(first == last, s % h).otherwise(F.lit(0).cast("bigint")), F.when(first == last, e % h).otherwise(h - 1)
        return F.struct((a["at"] + n).alias("at"), (~a["on"]).alias("on"), keep(F.least, first, "x1"), keep(F.least, low, "y1"), keep(F.greatest, last, "x2"), keep(F.greatest, high, "y2"))

    out = F.aggregate(F.transform(counts, lambda n: n.cast("bigint")), start, step)
    return F.when(out["x2"] >= 0, F.array(out["x1"], out["y1"], out["x2"] + 1, out["y2"] + 1))
