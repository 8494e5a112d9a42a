"""Rectangles: parsing, clamping, overlap, priors. Boxes are four integer columns x, y, w, h."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of rectangle fields in JSON, in the order in which they are tried.
XYWH_KEYS = [("x", "y", "w", "h"), ("x", "y", "width", "height"), ("left", "top", "width", "height")]
LTRB_KEYS = [("left", "top", "right", "bottom"), ("l", "t", "r", "b"), ("x1", "y1", "x2", "y2")]
POLYGON_KEYS = ["points", "polygon", "poly", "vertices"]
NESTED_KEYS = ["roi", "table", "bbox", "rect", "region", "crop", "area"]

BOX = "struct<x:int,y:int,w:int,h:int>"


_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", re.ASCII)
_JSON = json.JSONDecoder(parse_int=float)
_MOST = 2**31 - 1


def _whole(v: object) -> int | None:
    """A JSON number, truth value or numeric string rounded half to even; None for anything else and beyond 32 bits."""
    if not isinstance(v, float):
        if isinstance(v, bool):
            return int(v)
        if not isinstance(v, str) or not _NUMBER.fullmatch(v):
            return None
        v = float(v)
    return round(v) if -_MOST - 1.5 <= v < _MOST + 0.5 else None


def _sized(x: int | None, y: int | None, w: int | None, h: int | None) -> tuple[int, int, int, int] | None:
    if x is None or y is None or w is None or h is None or not 0 < w <= _MOST or not 0 < h <= _MOST:
        return None
    return x, y, w, h


def _corners(left: int | None, top: int | None, right: int | None, bottom: int | None) -> tuple[int, int, int, int] | None:
    if left is None or top is None or right is None or bottom is None:
        return None
    return _sized(left, top, right - left, bottom - top)


def _polygon(points: object) -> tuple[int, int, int, int] | None:
    """The box around a list of points, objects or lists, without coordinates that are no numbers."""
    if not isinstance(points, list):
        return None
    along: tuple[list[int], list[int]] = ([], [])
    for p in points:
        pair = (p.get("x"), p.get("y")) if isinstance(p, dict) else [*p[:2], None, None][:2] if isinstance(p, list) else (None, None)
        for found, v in zip(along, map(_whole, pair), strict=True):
            if v is not None:
                found.append(v)
    xs, ys = along
    return _corners(min(xs), min(ys), max(xs), max(ys)) if xs and ys else None


_ENCODINGS = [(keys, _sized) for keys in XYWH_KEYS] + [(keys, _corners) for keys in LTRB_KEYS]
_KEY_SETS = [frozenset(keys) for keys, _ in _ENCODINGS]


def first_box(text: str | None) -> tuple[int, int, int, int] | None:
    """x, y, w and h of the first rectangle in a JSON text (see ``operators.rectangles.find_boxes`` for the order of the search)."""
    try:
        left = [_JSON.decode(text or "")]
    except (ValueError, RecursionError):
        return None
    while left:
        node = left.pop()
        if isinstance(node, list):
            if len(node) == 4:
                four = [_whole(v) for v in node]
                if box := _sized(*four) or _corners(*four):
                    return box
        elif isinstance(node, dict):
            here = node.keys()
            for (keys, make), needed in zip(_ENCODINGS, _KEY_SETS, strict=True):
                if here >= needed:
                    if box := make(*[_whole(node[k]) for k in keys]):
                        return box
                    break
            else:
                for k in POLYGON_KEYS:
                    if k in node and (box := _polygon(node[k])):
                        return box
                left += reversed([node[k] for k in NESTED_KEYS if k in node] + [v for k, v in node.items() if k not in NESTED_KEYS])
    return None


def clamped(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> list[Column]:
    """The box inside the frame, at least one pixel in size."""
    cx, cy = F.greatest(F.lit(0), F.least(x, frame_w - 1)), F.greatest(F.lit(0), F.least(y, frame_h - 1))
    return [cx.alias("x"), cy.alias("y"), F.greatest(F.lit(1), F.least(w, frame_w - cx)).alias("w"), F.greatest(F.lit(1), F.least(h, frame_h - cy)).alias("h")]


def play_zone(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> list[Column]:
    """Around a table: its height upwards and a fifth of it below, a quarter of its width to either side, inside the frame."""
    cut = lambda v: v.cast("int")
    zx, zy = F.greatest(F.lit(0), x - cut(w * 0.25)), F.greatest(F.lit(0), y - cut(h * 1.0))
    return [zx.alias("zone_x"), zy.alias("zone_y"), F.least(frame_w - zx, w + cut(w * 0.5)).alias("zone_w"), F.least(frame_h - zy, h + cut(h * 1.2)).alias("zone_h")]


def scaled(v: Column, ratio: float) -> Column:
    return (v * F.lit(ratio)).cast("int")


def box_iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    wide = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    common = (wide * high).cast("double")
    union = (aw * ah + bw * bh).cast("double") - common
    return F.when((common > 0) & (union > 0), common / union).otherwise(0.0)


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common length over the length of the hull."""
    common = F.least(a1, b1) - F.greatest(a0, b0)
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when((common > 0) & (hull > 0), common / hull).otherwise(0.0)


def aspect_prior(w: Column, h: Column) -> Column:
    z = (w / F.greatest(F.lit(1.0), h.cast("double")) - 3.2) / 0.85
    return F.exp(-(z * z))


def centre_prior(x: Column, y: Column, w: Column, h: Column, frame_w: float, frame_h: float, cx: float = 0.5, cy: float = 0.55) -> Column:
    """Elliptic bell around the expected centre, lowered for boxes near the left and right edges."""
    dx, dy = ((x + w / 2.0) / frame_w - cx) / 0.35, ((y + h / 2.0) / frame_h - cy) / 0.28
    left, right = x / F.lit(float(frame_w)), (x + w) / F.lit(float(frame_w))
    edge = F.when((left < 0.03) | (right > 0.97), 0.20).when((left < 0.06) | (right > 0.94), 0.55).otherwise(1.0)
    return F.least(F.greatest(F.exp(-(dx * dx + dy * dy)) * edge, F.lit(0.0)), F.lit(1.0))


def area_confidence(area_ratio: Column) -> Column:
    return F.least(F.greatest((area_ratio - 0.03) / 0.20, F.lit(0.0)), F.lit(1.0))


def near_table(x: Column, w: Column, tx: Column, tw: Column, margin: int = 250) -> Column:
    """Whether a box is beside or before a table: no farther than the margin from it sideways, at any height."""
    return (x < tx + tw + margin) & (x + w > tx - margin)


def large_enough(w: Column, h: Column, frame_w: float, frame_h: float) -> Column:
    return (w >= 0.15 * frame_w) & (h >= 0.06 * frame_h)


def kept_class(class_id: Column, table_ids: list[int] | None = None, person_id: int = 0) -> Column:
    """Whether a detection is of a wanted class; without a list of these, of any but persons."""
    return class_id.isin(table_ids) if table_ids is not None else class_id != person_id


def detection_rank(refined: Column, centre: Column, area_ratio: Column, confidence: Column) -> Column:
    """Rank of a detected table: its evidence and place count most, size and confidence little."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return unit(refined * 1.6) * 0.40 + centre * 0.40 + unit(area_ratio * 6.0) * 0.10 + confidence * 0.10


def recovery_rank(shape: Column, score: Column, centre: Column) -> Column:
    """Rank of a box that replaces a truncated one."""
    return shape * 0.55 + score * 0.20 + centre * 0.25
