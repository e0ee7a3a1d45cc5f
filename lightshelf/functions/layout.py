"""Cells of a page as column expressions: arrays of rectangles (x, y, w, h) in inches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lightshelf.functions.scalar import col


def _rect(x, y, w, h) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in zip("xywh", (F.lit(v) if not isinstance(v, Column) else v for v in (x, y, w, h)))])


def grid(n: Column, x: Column, y: Column, w: Column, h: Column, columns: Column, gutter: float) -> Column:
    """`n` equal cells in rows of `columns` within a rectangle."""
    rows = F.ceil(n / columns)
    wide, high = (w - (columns - 1) * gutter) / columns, (h - (rows - 1) * gutter) / rows
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: _rect(x + (i % columns) * (wide + gutter), y + F.floor(i / columns) * (high + gutter), wide, high))


def cells(n, width: float, height: float, margin: float = 0.4, gutter: float = 0.5) -> Column:
    """Cells for a number of pictures on a page: one fills it, two stand side by side, up to seven are an anchor with a grid beside it, more are a grid."""
    n = F.greatest(F.lit(1), col(n)).cast("int")
    m, g = F.lit(margin), F.lit(gutter)
    inner_w, inner_h = F.lit(width - 2 * margin), F.lit(height - 2 * margin)
    half = (width - 2 * margin - gutter) / 2
    beside = F.lit(width / 2 + gutter / 2)
    anchor = F.array(_rect(m, m, F.lit(width / 2 - gutter / 2 - margin), inner_h))
    rest = F.greatest(F.lit(1), n - 1)
    collage = F.concat(anchor, grid(rest, beside, m, F.lit(width) - beside - m, inner_h, F.when(rest <= 2, 1).otherwise(2), gutter))
    dense = grid(n, m, m, inner_w, inner_h, F.ceil(F.sqrt(n)).cast("int"), gutter)
    return F.when(n == 1, F.array(_rect(0.0, 0.0, width, height))).when(n == 2, F.array(_rect(m, m, F.lit(half), inner_h), _rect(m + half + g, m, F.lit(half), inner_h))).when(n >= 8, dense).otherwise(collage)


#: Kinds of page with an anchor beside the others: the anchor's share of the width, whether it stands right, and whether the others stand side by side (else below each other).
ANCHORED = {"hero_left": (0.64, False, False), "hero_right": (0.64, True, False), "verticals_left": (0.52, False, True), "verticals_right": (0.52, True, True)}


def named_cells(kind, n, width: float, height: float, margin: float = 0.4, gutter: float = 0.5) -> Column:
    """Cells for a kind of page: one of `ANCHORED`, "row" (equal columns), "framed" (one within the margin), "full" (one that fills it); by number as in `cells` for others."""
    kind, n = col(kind), F.greatest(F.lit(1), col(n)).cast("int")
    m, high = F.lit(margin), F.lit(height - 2 * margin)
    out = F.when(kind == "framed", F.array(_rect(m, m, F.lit(width - 2 * margin), high))).when((kind == "full") | (n == 1), F.array(_rect(0.0, 0.0, width, height)))
    rest = F.greatest(F.lit(1), n - 1)
    for name, (share, right, columns) in ANCHORED.items():
        own = width * share - gutter / 2 - margin
        beside = F.lit(width - width * share - gutter / 2 - margin)
        at, side = (width - width * share + gutter / 2, margin) if right else (margin, width * share + gutter / 2)
        others = grid(rest, F.lit(side), m, beside, high, rest if columns else F.lit(1), gutter)
        out = out.when(kind == name, F.concat(F.array(_rect(F.lit(at), m, F.lit(own), high)), others))
    out = out.when(kind == "row", grid(n, m, m, F.lit(width - 2 * margin), high, n, gutter))
    return out.otherwise(cells(n, width, height, margin, gutter))
