"""Frames and projections as Column expressions. A frame is a struct or plain numbers: west, south, east, north, px_w, px_h."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.numeric import clamp, col, half_up

#: Metres in a degree: of longitude at the equator, and of latitude.
LON_M, LAT_M = 111_320.0, 110_540.0
EARTH_R = 6_378_137.0


def metres_per_lon(lat) -> Column:
    return F.cos(F.radians(col(lat))) * LON_M


def metres_per_lat() -> Column:
    return F.lit(LAT_M)


@dataclass(frozen=True)
class Frame:
    """A drawn box with the size of its picture."""

    west: float
    south: float
    east: float
    north: float
    px_w: int = 1000
    px_h: int = 1000

    @property
    def lat0(self) -> float:
        return (self.south + self.north) / 2

    @property
    def width_m(self) -> float:
        return (self.east - self.west) * LON_M * math.cos(math.radians(self.lat0))

    @property
    def length_m(self) -> float:
        return (self.north - self.south) * LAT_M

    def span_error(self, most: float = 15_000, least: float = 10) -> str | None:
        """Which side is too long or too short, or None."""
        for name, m in (("width", self.width_m), ("length", self.length_m)):
            if m > most or m < least:
                return f"{name} {m:.0f} m is outside {least:.0f}..{most:.0f} m"
        return None

    def to_px(self, lon, lat) -> tuple[Column, Column]:
        """Pixels from the south-west corner, y up."""
        return (col(lon) - self.west) / (self.east - self.west) * self.px_w, (col(lat) - self.south) / (self.north - self.south) * self.px_h

    def from_px(self, x, y) -> tuple[Column, Column]:
        return col(x) / self.px_w * (self.east - self.west) + self.west, col(y) / self.px_h * (self.north - self.south) + self.south

    def to_image(self, lon, lat) -> tuple[Column, Column]:
        """Pixels from the north-west corner, y down."""
        x, y = self.to_px(lon, lat)
        return x, F.lit(float(self.px_h)) - y

    def from_image(self, x, y) -> tuple[Column, Column]:
        return self.from_px(x, F.lit(float(self.px_h)) - col(y))

    def px_to_paste(self, x, y) -> tuple[Column, Column]:
        """Metres west and south of the north-east corner, from y-up pixels."""
        return (self.px_w - col(x)) * (self.width_m / self.px_w), (self.px_h - col(y)) * (self.length_m / self.px_h)

    def to_paste(self, lon, lat) -> tuple[Column, Column]:
        return self.px_to_paste(*self.to_px(lon, lat))

    def from_paste(self, x_m, y_m) -> tuple[Column, Column]:
        return self.from_px(self.px_w - col(x_m) / (self.width_m / self.px_w), self.px_h - col(y_m) / (self.length_m / self.px_h))


def km_between(lat_a, lon_a, lat_b, lon_b) -> Column:
    """Flat-earth kilometres, with the first point's latitude."""
    dx = (col(lon_b) - col(lon_a)) * metres_per_lon(lat_a)
    dy = (col(lat_b) - col(lat_a)) * LAT_M
    return F.sqrt(dx * dx + dy * dy) / 1000


def metres_between(lon_a, lat_a, lon_b, lat_b) -> Column:
    return km_between(lat_a, lon_a, lat_b, lon_b) * 1000


def mercator(lon, lat) -> tuple[Column, Column]:
    """Web-Mercator metres."""
    return F.radians(col(lon)) * EARTH_R, F.log(F.tan(F.radians(col(lat)) / 2 + math.pi / 4)) * EARTH_R


def unmercator(x, y) -> tuple[Column, Column]:
    return F.degrees(col(x) / EARTH_R), F.degrees(2 * F.atan(F.exp(col(y) / EARTH_R)) - math.pi / 2)


def tile_of(lon, lat, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile x and y."""
    n, r = float(1 << zoom), F.radians(col(lat))
    x = F.floor((col(lon) + 180.0) / 360.0 * n)
    y = F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n)
    return clamp(x, 0, int(n) - 1).cast("long"), clamp(y, 0, int(n) - 1).cast("long")


def quadkey(x, y, zoom: int) -> Column:
    """The base-4 name of a tile."""
    digit = lambda i: (F.shiftright(col(x), zoom - 1 - i).bitwiseAND(1) + F.shiftright(col(y), zoom - 1 - i).bitwiseAND(1) * 2).cast("string")
    return F.concat(*[digit(i) for i in range(zoom)])


def quadkeys_of_box(west: float, south: float, east: float, north: float, zoom: int = 9) -> list[str]:
    """The tiles that a box touches, for partition pruning; driver-side, a few keys."""

    def tile(lon: float, lat: float) -> tuple[int, int]:
        n, r = 1 << zoom, math.radians(lat)
        return int((lon + 180) / 360 * n), int((1 - math.asinh(math.tan(r)) / math.pi) / 2 * n)

    (x0, y0), (x1, y1) = tile(west, north), tile(east, south)
    key = lambda x, y: "".join(str((x >> i & 1) + 2 * (y >> i & 1)) for i in range(zoom - 1, -1, -1))
    return sorted(key(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))


def box_overlaps(west, south, east, north, box: tuple[float, float, float, float]) -> Column:
    """Four comparisons that reach the Parquet scan as pushed filters."""
    w, s, e, n = box
    return (col(east) >= w) & (col(west) <= e) & (col(north) >= s) & (col(south) <= n)


def turned_box(cx: float, cy: float, width: float, length: float, degrees: float) -> list[tuple[float, float]]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    return [(cx + c * i * width / 2 - s * j * length / 2, cy + s * i * width / 2 + c * j * length / 2) for i, j in corners]


def apply_affine(x, y, a: tuple[float, ...]) -> tuple[Column, Column]:
    """(a0 + a1 x + a2 y, a3 + a4 x + a5 y)."""
    return col(x) * a[1] + col(y) * a[2] + a[0], col(x) * a[4] + col(y) * a[5] + a[3]


def bilinear(z00, z10, z01, z11, fx, fy) -> Column:
    """Between four corners; fx and fy are held within 0..1."""
    u, v = clamp(fx, 0.0, 1.0), clamp(fy, 0.0, 1.0)
    return col(z00) * (1 - u) * (1 - v) + col(z10) * u * (1 - v) + col(z01) * (1 - u) * v + col(z11) * u * v


def tree_budget(km2) -> Column:
    return clamp(half_up(col(km2) * 240 + 200), 180, 800).cast("long")


def cell_side(spacing) -> Column:
    return clamp(half_up(spacing), 2, 8).cast("long")


def canopy_height(pct, lon, lat) -> Column:
    """Height from a canopy percentage: a band's base, jittered by place, to half metres, within 5..28."""
    from plotweave.functions.numeric import hash01

    base = F.when(col(pct) >= 70, 18.0).when(col(pct) >= 50, 14.5).when(col(pct) >= 30, 11.0).when(col(pct) >= 18, 8.5).otherwise(6.5)
    return clamp(half_up((base + (hash01(lon, lat, F.lit(5)) - 0.5) * 2.6) * 2) / 2, 5.0, 28.0)


def padded_extent(west, south, east, north, px_w, px_h) -> Column:
    """struct<west, south, east, north>: a box widened about its middle to the proportions of an image."""
    w, s, e, n = (col(c) for c in (west, south, east, north))
    lon, lat, target = e - w, n - s, col(px_w) / col(px_h)
    now = lon / lat
    box = lambda a, b, c, d: F.struct(a.alias("west"), b.alias("south"), c.alias("east"), d.alias("north"))
    tall, wide = lon / target / 2, lat * target / 2
    mid_x, mid_y = (w + e) / 2, (s + n) / 2
    odd = (col(px_w) > 0) & (col(px_h) > 0) & (lon > 0) & (lat > 0) & (F.abs(now - target) > F.abs(target) * 1e-9)
    return F.when(odd & (now > target), box(w, mid_y - tall, e, mid_y + tall)).when(odd, box(mid_x - wide, s, mid_x + wide, n)).otherwise(box(w, s, e, n))


def turned_bounds(west, south, east, north, degrees, margin: float = 3.0) -> Column:
    """struct<west, south, east, north>: the north-up box around a box turned about its middle, with a margin in metres."""
    w, s, e, n = (col(c) for c in (west, south, east, north))
    lon0, lat0, t = (w + e) / 2, (s + n) / 2, F.radians(col(degrees))
    m_lon, m_lat = LON_M * F.cos(F.radians(lat0)), F.lit(LAT_M)
    half_w, half_l = (e - w) * m_lon / 2, (n - s) * m_lat / 2
    c, d = F.abs(F.cos(t)), F.abs(F.sin(t))
    he, hn = half_w * c + half_l * d + margin, half_w * d + half_l * c + margin
    return F.struct((lon0 - he / m_lon).alias("west"), (lat0 - hn / m_lat).alias("south"), (lon0 + he / m_lon).alias("east"), (lat0 + hn / m_lat).alias("north"))


def turned_grid(lon0, lat0, width_m, length_m, degrees, frame: Frame) -> Column:
    """struct<w, h, fwd, inv>: the pixel grid of a turned box at the frame's pixel size, and the affine maps from its pixels to
    the frame's and back, as six numbers (x = a u + b v + c, y = d u + e v + f), y up."""
    metre = frame.width_m / frame.px_w
    w, h = F.greatest(half_up(col(width_m) / metre), F.lit(2.0)), F.greatest(half_up(col(length_m) / metre), F.lit(2.0))
    t = F.radians(col(degrees))
    c, s = F.cos(t), F.sin(t)
    sx = frame.px_w / (frame.east - frame.west) / (LON_M * F.cos(F.radians(col(lat0))))
    sy = F.lit(frame.px_h / (frame.north - frame.south) / LAT_M)
    ox = (col(lon0) - frame.west) / (frame.east - frame.west) * frame.px_w - (w * c + h * s) * metre / 2 * sx
    oy = (col(lat0) - frame.south) / (frame.north - frame.south) * frame.px_h - (h * c - w * s) * metre / 2 * sy
    a, b, d, e = c * metre * sx, s * metre * sx, -s * metre * sy, c * metre * sy
    det = a * e - b * d
    inv = (e / det, -b / det, -(e * ox - b * oy) / det, -d / det, a / det, -(a * oy - d * ox) / det)
    return F.struct(w.cast("long").alias("w"), h.cast("long").alias("h"), F.array(a, b, ox, d, e, oy).alias("fwd"), F.array(*inv).alias("inv"))


def pixel_window(box: Column, origin_x, origin_y, step_x, step_y, px_w: int, px_h: int) -> Column:
    """struct<left, top, right, bottom> of the raster pixels under a lon/lat box in a Mercator raster; null if under 2 x 2."""
    px = lambda x: (x - col(origin_x)) / col(step_x)
    py = lambda y: (y - col(origin_y)) / col(step_y)
    (xw, ys), (xe, yn) = mercator(box["west"], box["south"]), mercator(box["east"], box["north"])
    left, right = F.floor(F.least(px(xw), px(xe))), F.ceil(F.greatest(px(xw), px(xe)))
    top, bottom = F.floor(F.least(py(ys), py(yn))), F.ceil(F.greatest(py(ys), py(yn)))
    met = (right > 0) & (bottom > 0) & (left < px_w) & (top < px_h)
    left, top, right, bottom = F.greatest(left, F.lit(0)), F.greatest(top, F.lit(0)), F.least(right, F.lit(px_w)), F.least(bottom, F.lit(px_h))
    return F.when(met & (right - left >= 2) & (bottom - top >= 2), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


#: The southern border of Canada, west to east.
CANADA_SOUTH = (
    (-141, 60), (-130, 55), (-123.3, 49), (-95.15, 49), (-89.6, 48), (-84.8, 46.5), (-82.4, 45.3), (-82.5, 42.2), (-79, 43.3), (-76.5, 44),
    (-74.7, 45), (-71.5, 45), (-70.7, 45.4), (-69.2, 47.4), (-67.8, 47.1), (-67.8, 45.7), (-67, 44.8), (-52, 44.8),
)


def in_canada(lon, lat) -> Column:
    """North of the border's first stretch that spans the longitude, south of 84 degrees."""
    border = F.when(F.lit(False), F.lit(0.0))
    for (ax, ay), (bx, by) in zip(CANADA_SOUTH, CANADA_SOUTH[1:], strict=False):
        if bx >= ax:
            border = border.when(col(lon).between(ax, bx), ay + (by - ay) * ((col(lon) - ax) / (bx - ax) if bx > ax else F.lit(0.0)))
    return F.coalesce((col(lon) > -141) & (col(lon) < -52) & (col(lat) < 84) & (col(lat) > border), F.lit(False))


def restroom_label(lon, lat) -> Column:
    """What a public toilet building is called at a place."""
    x, y = col(lon), col(lat)
    inside = lambda a, b, c, d: (x > a) & (x < b) & (y > c) & (y < d)
    states = inside(-125, -66.5, 24.4, 49.4) | ((x < -129.9) & (y > 51) & (y < 72)) | inside(-161, -154, 18.5, 22.6) | inside(-67.5, -65, 17.8, 18.6)
    return F.when(x.isNull() | y.isNull(), "Toilets").when(in_canada(x, y), "Washrooms").when(states, "Restrooms").otherwise("Toilets")


def transverse_mercator(lon, lat, meridian: float = 27.0, scale: float = 0.9996, false_east: float = 500_000.0, axis: float = 6_378_137.0, flattening: float = 1 / 298.257222101) -> Column:
    """struct<east, north> in metres by Snyder's series for the ellipsoid; the defaults are those of ETRS-TM35FIN on GRS80."""
    e2 = flattening * (2 - flattening)
    second = e2 / (1 - e2)
    phi = F.radians(col(lat))
    # the meridian's arc: coefficients of phi, sin 2 phi, sin 4 phi, sin 6 phi
    arc = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024), 15 * e2**2 / 256 + 45 * e2**3 / 1024, -35 * e2**3 / 3072)
    along = axis * (phi * arc[0] + F.sin(phi * 2) * arc[1] + F.sin(phi * 4) * arc[2] + F.sin(phi * 6) * arc[3])
    radius = axis / F.sqrt(1 - F.pow(F.sin(phi), 2) * e2)
    t, c = F.pow(F.tan(phi), 2), F.pow(F.cos(phi), 2) * second
    a = F.radians(col(lon) - meridian) * F.cos(phi)
    east = a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * F.pow(a, 5) / 120
    north = F.pow(a, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * F.pow(a, 6) / 720
    return F.struct((false_east + scale * radius * east).alias("east"), (scale * (along + radius * F.tan(phi) * north)).alias("north"))


def degree_tiles(west, south, east, north) -> Column:
    """array<struct<lat, lon>> of the whole-degree tiles under a box, by their lower left corners; an upper edge on a degree adds none."""
    span = lambda a, b: F.sequence(F.floor(col(a)), F.floor(F.greatest(col(a), col(b) - 1e-12)))
    return F.flatten(F.transform(span(south, north), lambda y: F.transform(span(west, east), lambda x: F.struct(y.alias("lat"), x.alias("lon")))))


def prefixes(low, high, pad: float) -> Column:
    """Every hundredth of a range, as text: what a coordinate in it begins with."""
    return F.transform(F.sequence(F.floor((col(low) - pad) * 100), F.ceil((col(high) + pad) * 100)), lambda i: F.format_string("%.2f", i / 100))
