"""Height domains, bands, materials and confidence as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.numeric import clamp, col, half_up

#: Rank of a height's source, higher replaces lower.
HEIGHT_RANK = {"laser": 40, "lidar": 30, "chm": 25, "osm": 20, "floors": 10, "ms-global": 5}


def building_height(h) -> Column:
    """To 0.1 m inside the open interval (2, 400), else 0."""
    return F.when((col(h) > 2) & (col(h) < 400), half_up(h, 1)).otherwise(0.0)


def foliage_height(h) -> Column:
    return F.when((col(h) > 2) & (col(h) < 80), half_up(h, 1)).otherwise(0.0)


def measured_or_floors(height, floors) -> Column:
    """A measured height if plausible, else three metres a floor."""
    return F.when((col(height) > 2) & (col(height) < 400), col(height)).when(col(floors).between(1, 60), col(floors) * 3.0)


def height_colour(h) -> Column:
    return F.when(col(h) < 6, "green").when(col(h) < 11, "yellow").when(col(h) < 24, "orange").when(col(h) <= 32.25, "red").otherwise("purple")


def building_type(h) -> Column:
    return F.when(col(h) >= 24, "tower").when(col(h) >= 11, "mid").when(col(h) >= 6, "low").otherwise("small")


def foliage_tier(h) -> Column:
    return F.when(col(h).isNull() | (col(h) >= 12), "heavy").when(col(h) > 2, "light").otherwise("none")


def unmeasured_height(m2) -> Column:
    return F.when(col(m2) < 200, 4.5).when(col(m2) < 2000, 8.0).otherwise(12.0)


def legacy_unmeasured_height(m2) -> Column:
    return F.when(col(m2) < 200, 4.5).when(col(m2) < 2000, 8.0).when(col(m2) < 10_000, 16.0).otherwise(40.0)


def crown_base(h) -> Column:
    """Where an individual tree's crown starts: a third of its height, 2.5 m at least."""
    return F.greatest(half_up(col(h) / 3, 1), F.lit(2.5))


def understory_top(h, tier) -> Column:
    return clamp(half_up(col(h) * F.when(col(tier) == "heavy", 0.4).otherwise(0.3), 1), 1.0, 6.0)


def height_confidence(source) -> Column:
    """How far a source's heights are trusted; the first pattern that fits counts, null without a source."""
    s = F.lower(col(source))
    return (
        F.when(s.isNull() | (s == "none"), F.lit(None)).when(s.rlike("laser|lidar|chm|nls"), 0.85).when(s.rlike("osm|overture"), 0.7)
        .when(s.rlike("floors|fema|ms-global|nearby"), 0.5).otherwise(0.4)
    )


def height_rank(source) -> Column:
    r = F.lit(0)
    for name, rank in HEIGHT_RANK.items():
        r = F.when(col(source) == name, rank).otherwise(r)
    return r


def collection_of(material) -> Column:
    """The result collection that a material's name belongs to."""
    m = F.lower(col(material))
    return (
        F.when(m.rlike("foliage|tree|crown|hedge"), "vegetation").when(m.rlike("water|pond"), "water").when(m.rlike("rv|car|boat|truck|semi"), "vehicles")
        .when(m.rlike("wall|fence|pole|rail|bridge|deck"), "outdoor").when(m.rlike("building|roof|tower"), "buildings").otherwise("other")
    )


def lifted(base, top, seat) -> tuple[Column, Column]:
    """Bottom and top above a terrain seat."""
    return half_up(F.coalesce(col(base), F.lit(0.0)) + col(seat), 1), half_up(F.coalesce(col(top), F.lit(0.0)) + col(seat), 1)


#: Labels of outdoor objects and their heights where none is measured.
OUTDOOR_LABELS = {
    "parking": "Parking", "wall": "Wall", "fence": "Fence", "retaining": "Retaining wall", "hedge": "Hedge", "pole": "Light pole", "water": "Water", "guideway": "Guideway",
    "bridge": "Bridge", "rv": "RV", "trailer": "Trailer", "semi": "Semi", "storage": "Storage", "boat": "Boat", "car": "Car",
}
OUTDOOR_HEIGHTS = {"parking": 9.0, "wall": 2.5, "fence": 2.1, "hedge": 2.1, "retaining": 3.0, "guideway": 4.5, "bridge": 2.1, "rv": 3.5, "trailer": 3.2, "semi": 4.1, "boat": 3.5}


def _by_kind(kind: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), kind)


def outdoor_height(kind, h) -> Column:
    """The drawn height: water and car layers are sheets, a pole keeps 3 to 45 m, others a plausible height or their kind's."""
    k = col(kind)
    own = F.when(k == "parking", building_height(h)).otherwise(foliage_height(h))
    own = F.coalesce(own, F.lit(0.0))
    pole = F.when(own.between(3, 45), own).otherwise(9.0)
    return F.when(k == "water", 0.1).when(k == "car", 1.5).when(k == "pole", pole).when(own > 0, own).otherwise(F.coalesce(_by_kind(k, OUTDOOR_HEIGHTS), F.lit(0.0)))


def outdoor_material(kind, h) -> Column:
    """`label height` with one decimal; null for unknown kinds and for what is not over 2 m, sheets aside."""
    top = outdoor_height(kind, h)
    name = F.concat_ws(" ", _by_kind(col(kind), OUTDOOR_LABELS), F.format_string("%.1f", top))
    return F.when(_by_kind(col(kind), OUTDOOR_LABELS).isNotNull() & (col(kind).isin("water", "car") | (top > 2)), name)


def foliage_material(h, kind) -> Column:
    """The stock foliage name where the height is unknown or within 0.25 m of the stock's 19.68 ft, else with the height."""
    top = F.coalesce(foliage_height(h), F.lit(0.0))
    tier = F.when(col(kind).isin("heavy", "light"), col(kind)).when(top >= 12, "heavy").when(top > 2, "light").otherwise("heavy")
    stock = F.when(tier == "heavy", "Foliage - Heavy").otherwise("Foliage - Light")
    return F.when((top == 0) | (F.abs(top - 19.68 / 3.280839895) <= 0.25), stock).otherwise(F.concat_ws(" ", stock, F.format_string("%.1f", top)))


def base_and_top(base, top) -> Column:
    """struct<base, top, thickness>: to 0.01 m, base 0 and top null where unknown; thickness is top less a base inside it."""
    b, t = F.coalesce(col(base), F.lit(0.0)), col(top)
    thick = F.when(t.isNull(), 0.0).when((b > 0) & (t > b), t - b).otherwise(t)
    return F.struct(half_up(b, 2).alias("base"), half_up(t, 2).alias("top"), thick.alias("thickness"))


def checked_height(height, source, measured, keep_stale_towers: bool = False) -> Column:
    """struct<height, source>: a measured height replaces a missing one, or a checked source's of 6 m and more that it is under
    0.6 of; 2.5 m at least. With keep_stale_towers, 45 m and more stay where the measured one is under 0.45 of it."""
    h, m = F.coalesce(col(height), F.lit(0.0)), col(measured)
    missing = ~(h > 2)
    checked = col(source).isin("overture", "overture-floors", "ms-global", "nearby") & (h >= 6)
    replace = F.coalesce((missing | checked) & (m >= 2.5) & (missing | (m < h * 0.6)), F.lit(False))
    if keep_stale_towers:
        replace &= missing | (h < 45) | (m >= h * 0.45)
    return F.struct(F.when(replace, m).otherwise(col(height)).alias("height"), F.when(replace, "lidar-check").otherwise(col(source)).alias("source"))
