"""Boxes as array<double> (x0, y0, x1, y1) in page points from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i))


def area(box: Column) -> Column:
    return F.greatest(at(box, 2) - at(box, 0), F.lit(0.0)) * F.greatest(at(box, 3) - at(box, 1), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0))
    h = F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap_fraction(a: Column, b: Column) -> Column:
    """Intersection as a share of a."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection as a share of the smaller box."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def vertical_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), at(b, 1) - at(a, 3), at(a, 1) - at(b, 3))


def coverage(box: Column, width: Column, height: Column) -> Column:
    """Share of the page that the box covers, clipped to the page."""
    page = F.array(F.lit(0.0), F.lit(0.0), width.cast("double"), height.cast("double"))
    return F.when((width > 0) & (height > 0), intersection(box, page) / (width * height)).otherwise(0.0)


def top_left(box: Column, height: Column) -> Column:
    """From a bottom-left origin."""
    return F.array(at(box, 0), height - at(box, 3), at(box, 2), height - at(box, 1))


def is_degenerate(box: Column) -> Column:
    return (at(box, 2) <= at(box, 0)) | (at(box, 3) <= at(box, 1))
