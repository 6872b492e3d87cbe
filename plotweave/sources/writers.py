"""Writers: nested result documents, scoreboards, zip archives."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.numeric import half_up


def area_record(ring: Column, name, top, base, colour, mpu: float) -> Column:
    """One nested area: its ring in pixels, metres and feet, and its material."""
    unit = lambda p, k, u: F.struct(F.struct(half_up(p["x"] * k, 2).alias("x"), half_up(p["y"] * k, 2).alias("y"), F.lit(u).alias("unit")).alias("coordinate_xyz"))
    triples = F.flatten(F.transform(ring, lambda p: F.array(unit(p, 1.0, "pixels"), unit(p, mpu, "meters"), unit(p, mpu / 0.3048, "feet"))))
    material = F.struct(name.alias("name"), top.alias("top_height"), base.alias("bottom_height"), colour.alias("display_color"))
    return F.struct(F.struct(triples.alias("coordinates")).alias("area"), material.alias("area_material"))


def feature(ring: Column, **properties: Column) -> Column:
    """A GeoJSON feature of a ring as a struct."""
    xy = F.transform(ring, lambda p: F.array(half_up(p["x"], 6), half_up(p["y"], 6)))
    return F.struct(F.lit("Feature").alias("type"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(xy).alias("coordinates")).alias("geometry"))


def write_collections(features: DataFrame, path: str) -> None:
    """features (collection, feature struct) as JSON lines, a folder per collection; nothing is gathered."""
    features.select("collection", F.to_json("feature").alias("value")).write.mode("overwrite").partitionBy("collection").text(path)


def write_board(scores: DataFrame, path: str) -> None:
    scores.coalesce(1).write.mode("overwrite").csv(path, header=True)


def zipped(files: dict[str, bytes], most: int | None = None) -> bytes:
    """A zip of small files, stored, or deflated where the stored one would exceed `most`."""
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            for name in sorted(files):
                z.writestr(zipfile.ZipInfo(name), files[name], method)
        if most is None or len(out.getvalue()) <= most:
            break
    return out.getvalue()
