"""Rules on the colours of pixels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.numeric import col


def luma(r, g, b) -> Column:
    return col(r) * 0.299 + col(g) * 0.587 + col(b) * 0.114


def saturation(r, g, b) -> Column:
    top, low = F.greatest(col(r), col(g), col(b)), F.least(col(r), col(g), col(b))
    return F.when(top > 0, (top - low) / top).otherwise(0.0)


def green_excess(r, g, b) -> Column:
    return 2 * col(g) - col(r) - col(b)


def conifer(r, g, b) -> Column:
    """A dark, plainly green crown."""
    r, g, b = col(r), col(g), col(b)
    return luma(r, g, b).between(28, 80) & (g >= F.greatest(r, b) + 6) & (green_excess(r, g, b) >= 18) & (saturation(r, g, b) >= 0.18)


def surface(r, g, b, sd) -> Column:
    """1 for water, 2 for pavement, 0 for anything else; sd is the local deviation of luma. The bounds are fixed values."""
    r, g, b, sd = col(r), col(g), col(b), col(sd)
    y, sat, green = luma(r, g, b), saturation(r, g, b), green_excess(r, g, b)
    crown = conifer(r, g, b) | ((g >= b) & (g > r + 4) & (green > 8) & (sd >= 8))
    open_water = (b > r + 10) & (g <= b + 3) & (r <= g + 8) & (y > 22) & (y < 130) & (sat > 0.1) & (green < 24) & (sd < 18)
    pond = y.between(24, 62) & (b > r + 8) & (b > g + 2) & (r <= g + 4) & (green < 10) & (sat > 0.08) & (sat < 0.5) & (sd < 8)
    paved = y.between(108, 198) & (sat < 0.13) & (green < 7) & (sd < 10.5) & (b < r + 14)
    return F.when(crown, 0).when(open_water | pond, 1).when(paved, 2).otherwise(0)
