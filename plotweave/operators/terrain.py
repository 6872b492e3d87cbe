"""Terrain lattices, ramps, plates and seats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.functions.numeric import col, half_up


def snapped(z, step: float) -> Column:
    return half_up(col(z) / step) * step


def lattice(samples: DataFrame, digits: int = 7, least: int = 4) -> DataFrame:
    """Samples (ord, x, y, z) to a lattice keyed by rounded place, rows numbered from north; the last of equal places counts (of equal ord, the highest).
    Empty if fewer than `least` places are known."""
    p = samples.where("z is not null and not isnan(z)").withColumns({"x": half_up("x", digits), "y": half_up("y", digits)})
    last = p.groupBy("x", "y").agg(F.max_by("z", F.struct("ord", "z")).alias("z"))
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    placed = last.withColumns({"row": F.dense_rank().over(W.orderBy(F.col("y").desc())), "col": F.dense_rank().over(W.orderBy("x")), "_n": n})
    return placed.where(F.col("_n") >= least).drop("_n")


def ramp_axis(sw, se, ne, nw) -> Column:
    """Which way a planar ramp fits a cell's corners better: ns on a tie."""
    sw, se, ne, nw = (col(c) for c in (sw, se, ne, nw))
    ns, ew = F.abs(sw - se) + F.abs(nw - ne), F.abs(sw - nw) + F.abs(se - ne)
    return F.when(ns <= ew, "ns").otherwise("ew")


def lattice_cells(nodes: DataFrame) -> DataFrame:
    """Cells with their corners from a lattice (gid, ix, iy, z): two windows, no join."""
    east = W.partitionBy("gid", "iy").orderBy("ix")
    d = nodes.withColumns({"_e": F.lead("z").over(east), "_ex": F.lead("ix").over(east)})
    north = W.partitionBy("gid", "ix").orderBy("iy")
    d = d.withColumns({"nw": F.lead("z").over(north), "ne": F.lead("_e").over(north), "_nx": F.lead("_ex").over(north), "_ny": F.lead("iy").over(north)})
    ok = (F.col("_ex") == F.col("ix") + 1) & (F.col("_ny") == F.col("iy") + 1) & (F.col("_nx") == F.col("ix") + 1)
    return d.where(ok).select("gid", "ix", "iy", F.col("z").alias("sw"), F.col("_e").alias("se"), "ne", "nw")


def plates(cells: DataFrame, step: float) -> DataFrame:
    """A row for every plate under a cell's height: step, 2 step, and so on."""
    n = F.floor(F.col("v") / step).cast("int")
    return cells.where(n >= 1).withColumn("_k", F.explode(F.sequence(F.lit(1), n))).select("gid", "ix", "iy", (F.col("_k") * step).alias("v"))


def finest_step(cells: DataFrame, steps: list[float], most: int) -> float:
    """The finest step whose plates stay within `most`, from one pass over the cells; the coarsest if none does."""
    counts = cells.agg(*[F.sum(F.floor(F.col("v") / s)).alias(f"s{i}") for i, s in enumerate(steps)]).first()
    return next((s for i, s in sorted(enumerate(steps), key=lambda e: e[1]) if (counts[f"s{i}"] or 0) <= most), max(steps))


def seats(boxes: DataFrame, cells: DataFrame, side: float, box_id: str) -> DataFrame:
    """Per box: the least terrain under it rounded down, the greatest rounded up, to 0.1. cells: ix, iy, z of side `side`."""
    from plotweave.operators.joins import on_cells

    under = on_cells(boxes, "x0", "y0", "x1", "y1", side).withColumnsRenamed({"_cx": "ix", "_cy": "iy"}).join(cells.select("ix", "iy", "z"), ["ix", "iy"])
    return under.groupBy(box_id).agg((F.floor(F.min("z") * 10) / 10).alias("seat"), (F.ceil(F.max("z") * 10) / 10).alias("top"))


def mesh_error(truth: DataFrame, mesh: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, root mean square and greatest error, and the share of places that the mesh covers."""
    m = truth.join(mesh.withColumnRenamed("z", "_m"), keys, "left")
    e = F.col("z") - F.col("_m")
    return m.agg(F.avg(F.abs(e)).alias("mean"), F.sqrt(F.avg(e * e)).alias("rms"), F.max(F.abs(e)).alias("worst"), (F.count("_m") / F.count("*")).alias("cover"))


def plane_slope(points: DataFrame, keys: list[str]) -> DataFrame:
    """Steepness of the least-squares plane through x, y, z."""
    m = points.groupBy(*keys).agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a, b = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    return m.where(F.abs(det) > 1e-12).select(*keys, F.sqrt(a * a + b * b).alias("slope"))


def steep_cells(nodes: DataFrame, side: float, least: float = 0.45) -> DataFrame:
    """Lattice cells whose steepest side rises by `least` of its run or more."""
    c = lattice_cells(nodes)
    rise = F.greatest(F.abs(F.col("se") - F.col("sw")), F.abs(F.col("ne") - F.col("nw")), F.abs(F.col("nw") - F.col("sw")), F.abs(F.col("ne") - F.col("se")))
    return c.withColumn("grade", rise / side).where(F.col("grade") >= least)
