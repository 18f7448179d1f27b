"""Affine transforms and boxes as column expressions; matrices are arrays (a, b, c, d, e, f)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of the horizontal scale above which the vertical part of the base line makes a run skewed, and the least scale. Fixed values.
SKEW, LEAST_SCALE = 0.1, 1e-6


def multiply(m: Column, n: Column) -> Column:
    """The transform that applies n first."""
    linear = [m[r] * n[2 * c] + m[r + 2] * n[2 * c + 1] for c in (0, 1) for r in (0, 1)]
    moved = [m[r] * n[4] + m[r + 2] * n[5] + m[r + 4] for r in (0, 1)]
    return F.array(*linear, *moved)


def effective_em(m: Column) -> Column:
    return F.hypot(m[2], m[3])


def horizontal_scale(m: Column) -> Column:
    return F.hypot(m[0], m[1])


def is_skewed(m: Column) -> Column:
    return F.abs(m[1]) > F.greatest(F.abs(m[0]), F.lit(LEAST_SCALE)) * SKEW


def canonical(viewport: Column, item: Column, width: Column, height: Column) -> Column:
    """Struct of box (x, y, w, h), baseline_y, em and skewed of a text item, y growing downwards. Widths are in page units already; without a height the em stands in."""
    m = multiply(viewport, item)

    def place(m: Column) -> Column:
        em = effective_em(m)
        h = F.when(height != 0, F.abs(height * em)).otherwise(em)
        return F.struct(m[4].alias("x"), (m[5] - h).alias("y"), width.cast("double").alias("w"), h.alias("h"), m[5].alias("baseline_y"), em.alias("em"), is_skewed(m).alias("skewed"))

    # the product is worked out once
    return F.get(F.transform(F.array(m), place), F.lit(0))


def overlap_share(x: Column, w: Column, other_x: Column, other_w: Column) -> Column:
    """How much of a box's width lies within another."""
    common = F.least(x + w, other_x + other_w) - F.greatest(x, other_x)
    return F.when(w <= 0, 0.0).otherwise(F.greatest(common, F.lit(0)) / w)
