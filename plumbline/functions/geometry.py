"""Column functions over pixel boxes. A box is four integer columns or a struct of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(value: Column) -> Column:
    """Truncate to int."""
    return value.cast("int")


def half_even(value: Column) -> Column:
    return F.rint(value).cast("int")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two xyxy boxes; 0 when the union is empty."""
    width = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    shared = (width * height).cast("double")
    area = [
        F.greatest(F.lit(0), box[2] - box[0]) * F.greatest(F.lit(0), box[3] - box[1]) for box in (a, b)
    ]
    union = area[0] + area[1] - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def corners(box: Column) -> list[Column]:
    return [box[c] for c in ("x1", "y1", "x2", "y2")]


def clamp_xywh(x, y, w, h, width, height) -> list[Column]:
    cx = F.least(F.greatest(F.lit(0), x), F.greatest(F.lit(0), width - 1))
    cy = F.least(F.greatest(F.lit(0), y), F.greatest(F.lit(0), height - 1))
    return [cx, cy, F.greatest(F.lit(1), F.least(w, width - cx)), F.greatest(F.lit(1), F.least(h, height - cy))]


def map_box_to_image(x, y, w, h, map_size: tuple[Column, Column], image_size: tuple[Column, Column]) -> list[Column]:
    """Scale an xywh box from map to image pixels (half-even), at least 1 pixel, inside the image."""
    sx = image_size[0] / F.greatest(F.lit(1), map_size[0])
    sy = image_size[1] / F.greatest(F.lit(1), map_size[1])
    return clamp_xywh(
        half_even(x * sx),
        half_even(y * sy),
        F.greatest(F.lit(1), half_even(w * sx)),
        F.greatest(F.lit(1), half_even(h * sy)),
        *image_size,
    )


def normalized_box(x, y, w, h, width, height) -> list[Column]:
    """cx, cy, w, h as fractions of the image."""
    return [
        (x + w / 2.0) / F.greatest(F.lit(1), width),
        (y + h / 2.0) / F.greatest(F.lit(1), height),
        w / F.greatest(F.lit(1), width),
        h / F.greatest(F.lit(1), height),
    ]


def padded_box(x, y, w, h, factor: float, width, height) -> list[Column]:
    """xyxy of an xywh box grown by a share of its size on each side, inside the image."""
    pw, ph = whole(w * F.lit(factor)), whole(h * F.lit(factor))
    return [
        F.greatest(F.lit(0), x - pw),
        F.greatest(F.lit(0), y - ph),
        F.least(width, x + w + pw),
        F.least(height, y + h + ph),
    ]


def inspection_window(x, y, w, h, width, height, *, share: float = 0.25, floor: int = 224) -> list[Column]:
    """Context window around a region: grown, at most half the image, at least ``floor`` pixels."""

    def side(size, limit):
        grown = size + 2 * whole(size * F.lit(share))
        return F.greatest(F.least(grown, F.floor(limit / 2).cast("int")), F.lit(floor))

    tw, th = side(w, width), side(h, height)
    x1 = F.greatest(F.lit(0), x + F.floor(w / 2).cast("int") - F.floor(tw / 2).cast("int"))
    y1 = F.greatest(F.lit(0), y + F.floor(h / 2).cast("int") - F.floor(th / 2).cast("int"))
    return [x1, y1, F.least(width, x1 + tw), F.least(height, y1 + th)]


MOVES = ["move_left", "move_right", "move_up", "move_down", "zoom_in", "zoom_out"]


def moved_window(action: Column, x1, y1, x2, y2, width, height, *, floor: int = 96) -> Column:
    """Window after one action as a struct, null when too small or unchanged."""
    w, h = x2 - x1, y2 - y1
    step_x, step_y = F.greatest(F.lit(1), whole(w * 0.1)), F.greatest(F.lit(1), whole(h * 0.1))
    zoom_x, zoom_y = whole(w * 0.05), whole(h * 0.05)
    dx = F.when(action == "move_left", -step_x).when(action == "move_right", step_x).otherwise(0)
    dy = F.when(action == "move_up", -step_y).when(action == "move_down", step_y).otherwise(0)
    zx = F.when(action == "zoom_in", zoom_x).when(action == "zoom_out", -zoom_x).otherwise(0)
    zy = F.when(action == "zoom_in", zoom_y).when(action == "zoom_out", -zoom_y).otherwise(0)
    n1, m1 = F.greatest(F.lit(0), x1 + dx + zx), F.greatest(F.lit(0), y1 + dy + zy)
    n2, m2 = F.least(width, x2 + dx - zx), F.least(height, y2 + dy - zy)
    small = ((n2 - n1) < floor) | ((m2 - m1) < floor)
    same = (F.abs(n1 - x1) < 2) & (F.abs(m1 - y1) < 2) & (F.abs(n2 - x2) < 2)
    return F.when(~small & ~same, F.struct(n1.alias("x1"), m1.alias("y1"), n2.alias("x2"), m2.alias("y2")))


def normalized_crop(left, top, right, bottom, width, height) -> list[Column]:
    """Pixel box of a fractional crop, at least one pixel wide and high."""
    x0 = F.greatest(F.lit(0), F.least(width - 1, half_even(left * width)))
    y0 = F.greatest(F.lit(0), F.least(height - 1, half_even(top * height)))
    x1 = F.greatest(x0 + 1, F.least(width, half_even(right * width)))
    y1 = F.greatest(y0 + 1, F.least(height, half_even(bottom * height)))
    return [x0, y0, x1, y1]


def _band(value: Column, low: str, high: str) -> Column:
    return F.when(value < 0.34, low).when(value > 0.66, high).otherwise("center")


def _phrase(horizontal: Column, vertical: Column) -> Column:
    return (
        F.when((horizontal == "center") & (vertical == "center"), "center")
        .when(vertical == "center", F.concat(F.lit("center "), horizontal))
        .when(horizontal == "center", F.concat(vertical, F.lit(" center")))
        .otherwise(F.concat(vertical, F.lit(" "), horizontal))
    )


def spatial_terms(cx: Column, cy: Column) -> dict[str, Column]:
    """Coarse and fine location phrases and the sorted set of location terms of a box centre."""
    hor, ver = _band(cx, "left", "right"), _band(cy, "top", "bottom")
    near_left = (hor == "center") & (cx >= 0.40) & (cx < 0.50)
    near_right = (hor == "center") & (cx > 0.50) & (cx <= 0.60)
    fine_hor = F.when(near_left, "left").when(near_right, "right").otherwise(hor)
    mid = (ver == "center") & (fine_hor == "center")
    near_top, near_bottom = mid & (cy >= 0.40) & (cy < 0.50), mid & (cy > 0.50) & (cy <= 0.60)
    fine_ver = F.when(near_top, "top").when(near_bottom, "bottom").otherwise(ver)
    slightly = near_left | near_right | near_top | near_bottom
    fine = (
        F.when(slightly & fine_hor.isin("left", "right") & (fine_ver == "center"), F.concat(F.lit("center slightly "), fine_hor))
        .when(slightly & fine_ver.isin("top", "bottom") & (fine_hor == "center"), F.concat(F.lit("slightly "), fine_ver, F.lit(" center")))
        .otherwise(_phrase(fine_hor, fine_ver))
    )
    terms = F.array_compact(F.array(hor, ver, fine_hor, fine_ver, F.when(slightly, "slightly")))
    return {
        "horizontal": hor,
        "vertical": ver,
        "coarse_phrase": _phrase(hor, ver),
        "fine_phrase": fine,
        "terms": F.array_sort(F.array_distinct(terms)),
    }
