"""Boxes: features, validity, clipping, crop windows, rescaling and detection filters, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["sequence_id", "page_index"]
#: Taller than so many widths: vertical.
VERTICAL = 1.35


def c(name: str, side: str = "") -> Column:
    return F.col(f"{side}.{name}" if side else name)


def width(side: str = "") -> Column:
    return c("x2", side) - c("x1", side)


def height(side: str = "") -> Column:
    return c("y2", side) - c("y1", side)


def area(side: str = "") -> Column:
    return F.greatest(width(side), F.lit(0.0)) * F.greatest(height(side), F.lit(0.0))


def center_x(side: str = "") -> Column:
    return (c("x1", side) + c("x2", side)) / 2


def center_y(side: str = "") -> Column:
    return (c("y1", side) + c("y2", side)) / 2


def overlap_x(a: str, b: str) -> Column:
    return F.greatest(F.least(c("x2", a), c("x2", b)) - F.greatest(c("x1", a), c("x1", b)), F.lit(0.0))


def overlap_y(a: str, b: str) -> Column:
    return F.greatest(F.least(c("y2", a), c("y2", b)) - F.greatest(c("y1", a), c("y1", b)), F.lit(0.0))


def intersection(a: str, b: str) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def iou(a: str, b: str) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def contains(outer: str, inner: str, margin: float = 0.0) -> Column:
    return (c("x1", outer) <= c("x1", inner) + margin) & (c("y1", outer) <= c("y1", inner) + margin) & (c("x2", outer) >= c("x2", inner) - margin) & (c("y2", outer) >= c("y2", inner) - margin)


def finite(*names: str) -> Column:
    out = F.lit(True)
    for name in names:
        value = F.col(name).cast("double")
        out = out & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return out


def box_features(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """+ area, center_x, center_y, box_width, box_height, aspect, area_ratio (to the page), orientation."""
    joined = boxes.join(pages.select(*KEYS, F.col("width").alias("page_width"), F.col("height").alias("page_height")), KEYS)
    return joined.withColumns(
        {
            "area": area(),
            "center_x": center_x(),
            "center_y": center_y(),
            "box_width": width(),
            "box_height": height(),
            "aspect": F.when(height() > 0, width() / height()),
            "area_ratio": area() / (F.col("page_width") * F.col("page_height")),
            "orientation": F.when(height() > VERTICAL * width(), "vertical").otherwise("horizontal"),
        }
    ).drop("page_width", "page_height")


def is_valid() -> Column:
    return finite("x1", "y1", "x2", "y2") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))


def valid_boxes(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes with finite sides and an area, the rest); the two share no row and lose none."""
    good = F.coalesce(is_valid(), F.lit(False))
    return boxes.where(good), boxes.where(~good)


def clip_boxes(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes cut at the page's edges; those that nothing is left of go."""
    joined = boxes.join(pages.select(*KEYS, "width", "height"), KEYS)
    cut = {side: F.least(F.greatest(F.col(side), F.lit(0.0)), F.col(edge).cast("double")) for side, edge in (("x1", "width"), ("x2", "width"), ("y1", "height"), ("y2", "height"))}
    return joined.withColumns(cut).where("x2 > x1 AND y2 > y1").drop("width", "height")


def crop_windows(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """+ left, top, right, bottom in whole pixels inside the page, or null and the reason why there is no window."""
    w = {
        "left": F.greatest(F.floor("x1"), F.lit(0)),
        "top": F.greatest(F.floor("y1"), F.lit(0)),
        "right": F.least(F.ceil("x2"), F.col("width")),
        "bottom": F.least(F.ceil("y2"), F.col("height")),
    }
    reason = (
        F.when(~finite("x1", "y1", "x2", "y2"), "non_finite")
        .when((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), "degenerate")
        .when((w["left"] >= w["right"]) | (w["top"] >= w["bottom"]), "outside_page")
    )
    joined = boxes.join(pages.select(*KEYS, "width", "height"), KEYS).withColumn("reason", reason)
    return joined.withColumns({k: F.when(F.col("reason").isNull(), v.cast("long")) for k, v in w.items()}).drop("width", "height")


def rescale_boxes(boxes: DataFrame, limit: float = 1.5) -> DataFrame:
    """Boxes relative to a region (rx1, ry1, rx2, ry2), all sides within limit, or absolute in it, to page coordinates, corners in order."""
    relative = F.greatest(*[F.abs(F.col(s)) for s in ("x1", "y1", "x2", "y2")]) <= limit
    def moved(side: str, low: str, high: str) -> Column:
        return F.col(low) + F.when(relative, F.col(side) * (F.col(high) - F.col(low))).otherwise(F.col(side))

    x = [moved(s, "rx1", "rx2") for s in ("x1", "x2")]
    y = [moved(s, "ry1", "ry2") for s in ("y1", "y2")]
    return boxes.withColumns({"x1": F.least(*x), "y1": F.least(*y), "x2": F.greatest(*x), "y2": F.greatest(*y)})


def filter_detections(detections: DataFrame, least: float, categories: dict[int, str]) -> DataFrame:
    """Detections of the named classes with a confidence from least to 1: + category, detection_id."""
    name = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])[F.col("class_id")]
    kept = detections.withColumn("category", name).where(finite("confidence") & F.col("confidence").between(least, 1.0) & F.col("category").isNotNull())
    side = [F.bround(F.col(s)).cast("long") for s in ("x1", "y1", "x2", "y2")]
    return kept.withColumn("detection_id", F.format_string("p%d-%s-%d-%d-%d-%d", F.col("page_index"), F.col("category"), *side))


def detection_boxes(blocks: DataFrame) -> DataFrame:
    """x, y, w, h to x1, y1, x2, y2; sizes that are not positive go, a score outside [0, 1] is no confidence."""
    score = F.col("score").cast("double")
    return (
        blocks.where("w > 0 AND h > 0")
        .withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h"), "confidence": F.when(score.between(0.0, 1.0), score)})
        .drop("x", "y", "w", "h", "score")
    )
