"""Replies of models as columns: the JSON in a text, scores, and boxes of subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightshelf.functions.scalar import col, score_1_to_10

# Dimensions of a score with their parts and weights, and the facets of a style.
PARTS = {
    "technical": ["sharpness", "exposure", "depth_of_field", "white_balance"],
    "composition": ["framing", "leading_lines", "rule_of_thirds", "balance"],
    "impact": ["emotion", "originality", "wow"],
}
WEIGHTS = {"technical": 0.30, "composition": 0.30, "impact": 0.40}
FACETS = ["lighting", "mood", "tonal_character", "color", "composition_notes"]


#: An object with objects in it, one level deep; braces in strings do not count.
_TEXT = r'"(?:[^"\\]++|\\.)*+"'
_FLAT = rf"\{{(?:[^{{}}\"]++|{_TEXT})*+\}}"
OBJECT = rf"(?s)\{{(?:[^{{}}\"]++|{_TEXT}|{_FLAT})*+\}}"


def first_object(c) -> Column:
    """The first whole JSON object in a text, with objects in it but none in those; NULL if there is none."""
    return F.nullif(F.regexp_extract(col(c), OBJECT, 0), F.lit(""))


_REPLY = "struct<" + ", ".join(f"{d}: struct<{', '.join(f'{p}: string' for p in [*parts, 'critique'])}>" for d, parts in PARTS.items()) + f", style: struct<{', '.join(f'{f}: string' for f in FACETS)}>, style_tags: array<string>>"


def scored_replies(df: DataFrame, reply: str, out: str = "scores") -> DataFrame:
    """`df` with the scores of a reply: sub_scores, dim_scores and overall, critiques, style and style_tags; NULL unless every part has a number.

    A dimension is the mean of its parts, the whole the weighted mean of the
    dimensions, to 3 places.  The reply is read once, before its parts are used.
    """
    held = df.withColumn("_r", F.from_json(first_object(reply), _REPLY))
    text = lambda path: F.nullif(F.trim(F.col(f"_r.{path}")), F.lit(""))
    parts = F.struct(*[score_1_to_10(f"_r.{d}.{p}").alias(p) for d, ps in PARTS.items() for p in ps])
    held = held.withColumn("_s", parts)
    score = lambda p: F.col(f"_s.{p}")
    means = F.struct(*[F.round(sum((score(p) for p in ps[1:]), score(ps[0])) / len(ps), 3).alias(d) for d, ps in PARTS.items()])
    held = held.withColumn("_d", means)
    overall = F.round(sum((F.col(f"_d.{d}") * w for d, w in WEIGHTS.items()), F.lit(0.0)), 3)
    named = lambda pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    present = lambda pairs: F.map_filter(named(pairs), lambda _, v: v.isNotNull())
    tags = F.array_distinct(F.filter(F.transform("_r.style_tags", lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    whole = F.struct(
        named([(p, score(p)) for ps in PARTS.values() for p in ps]).alias("sub_scores"), named([(d, F.col(f"_d.{d}")) for d in PARTS]).alias("dim_scores"), overall.alias("overall"),
        present([(d, text(f"{d}.critique")) for d in PARTS]).alias("critiques"), present([(f, text(f"style.{f}")) for f in FACETS]).alias("style"), F.coalesce(tags, F.array().cast("array<string>")).alias("style_tags"),
    )
    return held.withColumn(out, F.when(overall.isNotNull(), whole)).drop("_r", "_s", "_d")


_BOXES = "array<struct<bbox_2d: array<string>, bbox: array<string>, label: string>>"


def subject_boxes(c, width, height) -> Column:
    """Boxes of subjects in a reply, as shares of the picture and largest first: label, bbox (x1, y1, x2, y2) and area_frac.

    The reply is a JSON array or one object, in whatever text.  Corners may come
    in any order; boxes are held within the picture, and those under a pixel go.
    """
    w, h = col(width).cast("double"), col(height).cast("double")
    array, single = F.regexp_extract(col(c), r"(?s)(\[\s*\{.*\}\s*\])", 1), F.regexp_extract(col(c), r"(?s)(\{.*\})", 1)
    boxes = F.coalesce(*[F.from_json(F.nullif(t, F.lit("")), _BOXES) for t in (F.trim(col(c)), array, single)], F.array().cast(_BOXES))

    def one(b: Column) -> Column:
        v = F.transform(F.coalesce(b["bbox_2d"], b["bbox"]), lambda x: x.try_cast("double"))
        inside = lambda x, most: F.greatest(F.lit(0.0), F.least(x, most))
        ok = (F.size(v) == 4) & ~F.exists(v, lambda x: x.isNull()) & (w > 0) & (h > 0)
        x1, x2 = inside(F.least(v[0], v[2]), w), inside(F.greatest(v[0], v[2]), w)
        y1, y2 = inside(F.least(v[1], v[3]), h), inside(F.greatest(v[1], v[3]), h)
        box = [F.round(x1 / w, 5), F.round(y1 / h, 5), F.round(x2 / w, 5), F.round(y2 / h, 5)]
        area = F.round((box[2] - box[0]) * (box[3] - box[1]), 5)
        return F.when(ok & (x2 - x1 >= 1) & (y2 - y1 >= 1), F.struct(F.nullif(b["label"], F.lit("")).alias("label"), F.array(*box).alias("bbox"), area.alias("area_frac")))

    kept = F.filter(F.transform(boxes, one), lambda b: b.isNotNull())
    placed = F.transform(kept, lambda b, i: F.struct((-b["area_frac"]).alias("order"), i.alias("at"), b.alias("box")))
    return F.transform(F.array_sort(placed), lambda p: p["box"])
