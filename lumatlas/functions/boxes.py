"""Boxes in relative image coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col


def box_area(x0, y0, x1, y1) -> Column:
    z = F.lit(0.0)
    return F.greatest(z, col(x1) - col(x0)) * F.greatest(z, col(y1) - col(y0))


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of two structs with x0, y0, x1, y1."""
    z = F.lit(0.0)
    w = F.greatest(z, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(z, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    inter = w * h
    area_a = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    area_b = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    return inter / (area_a + area_b - inter + F.lit(1e-9))
