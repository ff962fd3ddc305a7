"""Confidence, geometry and vector arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REVIEW_BELOW = 70.0


def review_required(confidence: Column) -> Column:
    return confidence < REVIEW_BELOW


def mean_confidence(values: Column) -> Column:
    """Mean of an array's values that are not negative, 0 without any."""
    good = F.filter(values, lambda c: c >= 0)
    total = F.aggregate(good, F.lit(0.0), lambda a, b: a + b)
    return F.coalesce(F.try_divide(total, F.size(good)), F.lit(0.0))


def mean_confidence_agg(value: Column) -> Column:
    """Mean of values that are not negative, 0 without any.

    Values are summed as decimals of twelve places, so the mean does not depend on the order of rows or the number of tasks:
    in doubles, a mean that is a whole number comes out on either side of it.  Values of 1e9 and more, infinite or NaN
    are averaged as doubles.
    """
    good = F.when(value >= 0, value.cast("double"))
    exact = F.sum(F.when(good < 1e9, good).cast("decimal(22,12)")).cast("double") / F.count(good)
    return F.coalesce(F.when(F.max(good) < 1e9, exact).otherwise(F.avg(good)), F.lit(0.0))


def logprob_confidence(logprob: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 + logprob / 4) * 100))


def token_confidence_agg(probability: Column) -> Column:
    """Geometric mean of positive token probabilities in percent, at most 100, 0 without any."""
    return F.coalesce(F.round(F.least(F.lit(100.0), F.exp(F.avg(F.ln(F.when(probability > 0, probability)))) * 100), 2), F.lit(0.0))


def native_block_class(text: Column, y0: Column, height: Column) -> Column:
    at = F.when(height == 0, 0.5).otherwise(y0 / F.nullif(height, F.lit(0.0)))
    shout = (text == F.upper(text)) & (text != F.lower(text))
    return (
        F.when(at > 0.92, "footer").when((at < 0.05) & (F.length(text) < 50), "page_number")
        .when((at < 0.20) & (F.length(text) < 200) & shout, "heading").when((at < 0.20) & (F.length(text) < 100), "heading").otherwise("body")
    )


def layout_class(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, header: float = 0.20, footer: float = 0.08) -> Column:
    top, bottom, wide = y0 / height, y1 / height, (x1 - x0) / width
    return (
        F.when(top >= 1 - footer, "footer").when(((top < 0.05) | (bottom > 0.92)) & ((x1 - x0) < width * 0.3), "page_number")
        .when((top < header) & (wide > 0.5), "heading").otherwise("body")
    )


def handwriting_class(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    w, h = x1 - x0, y1 - y0
    at, wide = F.coalesce(F.try_divide(y0, height), F.lit(0.5)), F.coalesce(F.try_divide(w, width), F.lit(0.5))
    aspect = F.coalesce(F.try_divide(w, h), F.lit(1.0))
    return (
        F.when((at > 0.70) & (h < height * 0.12) & (aspect > 2), "signature").when((w < 300) & (h < 80) & (aspect > 0.3) & (aspect < 6), "table_fill")
        .when((h < 60) & (wide < 0.7), "annotation").when(w * h > 10000, "standalone_note").otherwise("unknown")
    )


def handwriting_score(stroke_variance: Column, edge_density: Column, intensity_variance: Column) -> Column:
    strokes = F.least(F.lit(1.0), stroke_variance / 5)
    density = F.when(edge_density.between(0.05, 0.35), 1 - F.abs(edge_density - 0.20) / 0.20).otherwise(0.0)
    intensity = F.least(F.lit(1.0), intensity_variance / (255.0 * 255.0) * 4)
    return F.round(0.4 * strokes + 0.35 * density + 0.25 * intensity, 3)


def reading_order(y0: Column, x0: Column, band: int = 50) -> list[Column]:
    """Sort keys: bands of `band` pixels (50 for print, 60 for handwriting), then from the left."""
    return [F.floor(y0 / band), x0]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs with x0, y0, x1, y1); 0 if apart."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    common = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.coalesce(F.try_divide(common, area(a) + area(b) - common), F.lit(0.0))


def hash_embedding(text: Column, dim: int = 128) -> Column:
    """Deterministic unit vector from the bytes of SHA-256, repeated to `dim`."""
    byte = lambda h, i: F.conv(F.substring(h, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5
    return unit(_bound(F.sha2(text, 256), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: byte(h, i))))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, not once for each element of a lambda inside."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unit(vector: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    return _bound(vector, lambda v: _bound(norm(v), lambda n: F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))))


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; a zero norm counts as 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return dot / (size(a) * size(b))
