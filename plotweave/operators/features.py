"""Derived features: tiles, pads, rows, shells, notes, packings and named tasks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.functions import rings
from plotweave.functions.numeric import half_up


def tiles(spark: SparkSession, box: tuple[float, float, float, float], side_deg: float, most: int = 16) -> DataFrame:
    """A box as a grid of at most `most` tiles: (tx, ty, west, south, east, north)."""
    west, south, east, north = box
    cols, rows = max(1, -int(-(east - west) // side_deg)), max(1, -int(-(north - south) // side_deg))
    while cols * rows > most:
        cols, rows = (cols - 1, rows) if cols >= rows else (cols, rows - 1)
    d = spark.range(cols * rows).select((F.col("id") % cols).alias("tx"), F.floor(F.col("id") / cols).alias("ty"))
    dx, dy = (east - west) / cols, (north - south) / rows
    return d.select("tx", "ty", (F.col("tx") * dx + west).alias("west"), (F.col("ty") * dy + south).alias("south"), ((F.col("tx") + 1) * dx + west).alias("east"), ((F.col("ty") + 1) * dy + south).alias("north"))


def quarters(tiles: DataFrame) -> DataFrame:
    """Each tile cut in four, as a failed read is retried."""
    mx, my = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    part = lambda w, s, e, n: F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    return tiles.select("tx", "ty", F.posexplode(F.array(part(w, s, mx, my), part(mx, s, e, my), part(w, my, mx, n), part(mx, my, e, n))).alias("part", "t")).select("tx", "ty", "part", "t.*")


def shell(areas: DataFrame, wall: float = 0.3, cap: int = 19_000) -> DataFrame:
    """Boxes as four walls and a roof slab while at most `cap` parts result; beyond that, boxes stay whole."""
    box = lambda name, x0, y0, x1, y1: F.struct(F.lit(name).alias("part"), x0.alias("px0"), y0.alias("py0"), x1.alias("px1"), y1.alias("py1"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    walls = F.array(box("south", x0, y0, x1, y0 + wall), box("north", x0, y1 - wall, x1, y1), box("west", x0, y0 + wall, x0 + wall, y1 - wall), box("east", x1 - wall, y0 + wall, x1, y1 - wall), box("roof", x0, y0, x1, y1))
    fits = F.row_number().over(W.orderBy("fid")) * 5 <= cap
    return areas.withColumn("_fits", fits).select("fid", F.inline(F.when(F.col("_fits"), walls).otherwise(F.array(box("whole", x0, y0, x1, y1)))))


def tree_parts(trees: DataFrame) -> DataFrame:
    """A stem and a crown for each tree (id, height, diameter)."""
    base = F.greatest(half_up(F.col("height") / 3, 1), F.lit(2.5))
    part = lambda name, low, high, d: F.struct(F.lit(name).alias("part"), low.alias("bottom"), high.alias("top"), d.alias("across"))
    return trees.select("id", F.inline(F.array(part("stem", F.lit(0.0), base, F.lit(0.5)), part("crown", base, F.col("height").cast("double"), F.col("diameter").cast("double")))))


def slices(features: DataFrame, thick: float = 7.0, least: int = 8, most: int = 16) -> DataFrame:
    """A sphere (id, height, diameter) as stacked discs of about `thick` metres: (id, k, bottom, top, across)."""
    n = F.least(F.greatest(F.ceil(F.col("height") / thick), F.lit(least)), F.lit(most))
    d = features.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    mid = (F.col("k") + 0.5) / F.col("_n")
    return d.select("id", "k", (F.col("height") * F.col("k") / F.col("_n")).alias("bottom"), (F.col("height") * (F.col("k") + 1) / F.col("_n")).alias("top"), (F.col("diameter") * F.sqrt(1 - F.pow(mid * 2 - 1, F.lit(2)))).alias("across"))


def two_levels(z: Column) -> Column:
    """The two heights of a polygon that has exactly two, lower first; null otherwise."""
    d = F.array_sort(F.array_distinct(z))
    return F.when(F.size(d) == 2, d)


def gap_fills(spots: DataFrame, line: str, at: str, least: int = 6) -> DataFrame:
    """Places missing from rows of evenly spaced spots: where two neighbours lie k spacings apart, k - 1 between them. The
    spacing is the row's upper median gap; rows of fewer than `least` spots have no pattern."""
    from plotweave.operators.ranking import upper_gap

    w = W.partitionBy(line).orderBy(at)
    n = spots.groupBy(line).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(line)
    d = spots.join(n, line, "left_semi").join(upper_gap(spots, [line], at), line).withColumn("_next", F.lead(at).over(w))
    k = half_up((F.col("_next") - F.col(at)) / F.col("gap")).cast("int")
    return d.where(k >= 2).withColumn("_k", F.explode(F.sequence(F.lit(1), k - 1))).select(line, (F.col(at) + F.col("_k") * F.col("gap")).alias(at))


def unreached_tiles(boxes: DataFrame, roads: DataFrame, side: float) -> DataFrame:
    """(fid, cx, cy): tiles of `side` inside boxes in which no road point (x, y) lies."""
    from plotweave.operators.joins import on_cells

    inside = on_cells(boxes, "x0", "y0", F.col("x1") - 1e-9, F.col("y1") - 1e-9, side)
    met = roads.select(F.floor(F.col("x") / side).alias("_cx"), F.floor(F.col("y") / side).alias("_cy")).distinct()
    return inside.join(met, ["_cx", "_cy"], "left_anti").select("fid", F.col("_cx").alias("cx"), F.col("_cy").alias("cy"))


def replaced_lines(lines: DataFrame, boxes: DataFrame, side: float) -> DataFrame:
    """Lines (id, x, y of the middle) that no polygon covers: a mapped deck replaces its centre line.

    Lines at one place ask once, and a semi-join leaves a place at the first box that covers it.
    """
    from plotweave.operators.joins import fitted_side, on_cells

    s = fitted_side(boxes, side, parts=2.0)
    spots = lines.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct().withColumns({"_cx": F.floor(F.col("_x") / s), "_cy": F.floor(F.col("_y") / s)})
    dealt = on_cells(boxes.select("x0", "y0", "x1", "y1").distinct(), "x0", "y0", "x1", "y1", s).withColumnsRenamed({"_cx": "_bx", "_cy": "_by"})
    holds = (F.col("_x") >= F.col("x0")) & (F.col("_x") <= F.col("x1")) & (F.col("_y") >= F.col("y0")) & (F.col("_y") <= F.col("y1"))
    covered = spots.join(dealt, (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by")) & holds, "left_semi")
    return lines.join(covered.select(F.col("_x").alias("x"), F.col("_y").alias("y")), ["x", "y"], "left_anti").select(*lines.columns)


def dense_rows(cars: DataFrame, key: str, least: int = 8) -> DataFrame:
    """Rows with `least` cars or more become one layer: (key, n, x0, y0, x1, y1)."""
    return cars.groupBy(key).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).where(F.col("n") >= least)


def _by_group(df: DataFrame, group: str, schema: str, run: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return df.groupBy(group).applyInPandas(run, schema)


def seeded_groups(points: DataFrame, group: str, apart: float) -> DataFrame:
    """Greedy clusters per group: in x, y order a point joins the first seed within `apart`, else it is one. (group, id, seed)."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, seeds, out = pdf.sort_values(["x", "y", "id"]), [], []
        for i, x, y in pdf[["id", "x", "y"]].itertuples(index=False):
            s = next((s for s, a, b in seeds if (x - a) ** 2 + (y - b) ** 2 <= apart * apart), None)
            if s is None:
                s = i
                seeds.append((i, x, y))
            out.append(s)
        return pdf.assign(seed=out)[[group, "id", "seed"]]

    return _by_group(points, group, f"{group} {kinds[group]}, id long, seed long", run)


def offset_rows(points: DataFrame, group: str, across: str, apart: float = 3.2) -> DataFrame:
    """Rows by offset: sorted by `across`, a point farther than `apart` from the row's running mean starts a new row."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, row, total, n, out = pdf.sort_values([across, "id"]), -1, 0.0, 0, []
        for v in pdf[across]:
            if n == 0 or abs(v - total / n) > apart:
                row, total, n = row + 1, 0.0, 0
            total, n = total + v, n + 1
            out.append(row)
        return pdf.assign(line=out)[[group, "id", "line"]]

    return _by_group(points, group, f"{group} {kinds[group]}, id long, line long", run)


def packed_circles(circles: DataFrame, group: str) -> DataFrame:
    """Largest first, circles (id, x, y, r) that touch none kept before: (group, id)."""
    kinds = {f.name: f.dataType.simpleString() for f in circles.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[float, float, float]] = []
        ids = []
        for i, x, y, r in pdf.sort_values(["r", "id"], ascending=[False, True])[["id", "x", "y", "r"]].itertuples(index=False):
            if all((x - a) ** 2 + (y - b) ** 2 >= (r + s) ** 2 for a, b, s in kept):
                kept.append((x, y, r))
                ids.append(i)
        return pd.DataFrame({group: pdf[group].iat[0], "id": ids})

    return _by_group(circles, group, f"{group} {kinds[group]}, id long", run)


def first_known(*sources: tuple[str, str]) -> tuple[Column, Column]:
    """The first source with a value, and its name, from (column, name) pairs in order of trust."""
    value = F.coalesce(*[F.col(c) for c, _ in sources])
    name = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in sources])
    return value, name


TASKS: dict[str, tuple[str, Callable[[pd.DataFrame], pd.DataFrame]]] = {}


def task(name: str, schema: str):
    """Registers a named task: a function of one payload table, with its result's schema."""

    def add(f):
        TASKS[name] = (schema, f)
        return f

    return add


def run_task(name: str, payloads: DataFrame, key: str) -> DataFrame:
    """Runs a registered task on each payload (rows of one key); an unknown name fails at once."""
    schema, f = TASKS[name]
    return payloads.groupBy(key).applyInPandas(f, schema)


@task("trace_cells", "gid long, cells long, top double")
def _trace(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"gid": [pdf["gid"].iat[0]], "cells": [len(pdf)], "top": [pdf["v"].max()]})


@task("hull_of_points", "kind string, corners long, area double")
def _hull(pdf: pd.DataFrame) -> pd.DataFrame:
    from plotweave.functions.polygons import hull, shoelace

    h = hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))
    return pd.DataFrame({"kind": [pdf["kind"].iat[0]], "corners": [len(h)], "area": [shoelace(h) if len(h) > 2 else 0.0]})


def clipped_areas(boxes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(fid, area, share) of footprints clipped to a box, in Arrow batches; those outside drop out."""
    from plotweave.functions.polygons import clip_to_box, shoelace

    def run(batches):
        for d in batches:
            out = []
            for fid, x0, y0, x1, y1 in d[["fid", "x0", "y0", "x1", "y1"]].itertuples(index=False):
                ring = clip_to_box([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], *box)
                if len(ring) > 2 and (a := abs(shoelace(ring))) > 0:
                    out.append((fid, a, a / ((x1 - x0) * (y1 - y0))))
            yield pd.DataFrame(out, columns=["fid", "area", "share"])

    return boxes.select("fid", "x0", "y0", "x1", "y1").mapInPandas(run, "fid long, area double, share double")


def ring_of(df: DataFrame) -> DataFrame:
    return df.withColumn("ring", rings.box_ring("x0", "y0", "x1", "y1"))
