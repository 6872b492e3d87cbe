"""Operators on sparse cell tables (gid, ix, iy, v): neighbourhoods, morphology, components, growth, interpolation."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.functions.numeric import upper_median

FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))
EIGHT = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)


def shifted(cells: DataFrame, offsets=EIGHT, value: str = "v") -> DataFrame:
    """Each cell's value at its neighbours' places: (gid, ix, iy, nv). A map, not a join; group it by place."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    return cells.select("gid", "ix", "iy", F.col(value).alias("nv"), o.alias("o")).select("gid", (F.col("ix") + F.col("o.i")).alias("ix"), (F.col("iy") + F.col("o.j")).alias("iy"), "nv")


def neighbour_stats(cells: DataFrame, offsets=EIGHT) -> DataFrame:
    """(gid, ix, iy, n, top, mean) over the neighbours of every place that has any; one shuffle on the place."""
    return shifted(cells, offsets).groupBy("gid", "ix", "iy").agg(F.count("*").alias("n"), F.max("nv").alias("top"), F.avg("nv").alias("mean"))


def local_maxima(cells: DataFrame, least_neighbours: int = 2) -> DataFrame:
    """Cells not lower than any of their eight neighbours, with least_neighbours of these present."""
    return cells.join(neighbour_stats(cells), ["gid", "ix", "iy"]).where((F.col("v") >= F.col("top")) & (F.col("n") >= least_neighbours)).select("gid", "ix", "iy", "v")


def neighbour_medians(cells: DataFrame, offsets=EIGHT) -> DataFrame:
    """(gid, ix, iy, n, middle): the upper median over the neighbours of every place that has any, at most eight values each."""
    g = shifted(cells, offsets).groupBy("gid", "ix", "iy").agg(F.collect_list("nv").alias("_vs"))
    return g.select("gid", "ix", "iy", F.size("_vs").alias("n"), upper_median(F.col("_vs")).alias("middle"))


def despeckled(cells: DataFrame, fill_at: int = 6) -> DataFrame:
    """Cells without a neighbour go; places with fill_at neighbours or more take their upper median. All read the old values."""
    m = cells.join(neighbour_medians(cells), ["gid", "ix", "iy"], "full")
    keep = F.when(F.col("v").isNotNull() & (F.coalesce("n", F.lit(0)) > 0), F.col("v")).when(F.col("v").isNull() & (F.col("n") >= fill_at), F.col("middle"))
    return m.withColumn("v", keep).where("v is not null").select("gid", "ix", "iy", "v")


def dilated(cells: DataFrame, offsets=EIGHT) -> DataFrame:
    """The cells and their neighbours; a new place takes the greatest value beside it."""
    grown = shifted(cells, offsets).groupBy("gid", "ix", "iy").agg(F.max("nv").alias("nv"))
    return cells.join(grown, ["gid", "ix", "iy"], "full").select("gid", "ix", "iy", F.coalesce("v", "nv").alias("v"))


def eroded(cells: DataFrame, offsets=EIGHT) -> DataFrame:
    """Cells all of whose neighbours are present."""
    full = neighbour_stats(cells, offsets).where(F.col("n") == len(offsets)).select("gid", "ix", "iy")
    return cells.join(full, ["gid", "ix", "iy"], "left_semi")


def closed(cells: DataFrame, support: int = 4) -> DataFrame:
    """A dilation, then an erosion; old cells always stay. A place so closed takes the upper median of the cells beside it,
    and only where there are `support` of them."""
    gaps = eroded(dilated(cells)).select("gid", "ix", "iy").join(cells.select("gid", "ix", "iy"), ["gid", "ix", "iy"], "left_anti")
    filled = gaps.join(neighbour_medians(cells).where(F.col("n") >= support), ["gid", "ix", "iy"])
    return cells.unionByName(filled.select("gid", "ix", "iy", F.col("middle").alias("v")))


#: The places a pixel's local deviation looks at.
SEVEN = ((0, 0), (3, 0), (-3, 0), (0, 3), (0, -3), (3, 3), (-3, 2))


def local_deviation(cells: DataFrame, offsets=SEVEN) -> DataFrame:
    """cells with `sd`, the population deviation over those of the offsets that are in the grid."""
    back = [(-i, -j) for i, j in offsets]
    g = shifted(cells, back).groupBy("gid", "ix", "iy").agg(F.avg("nv").alias("_m"), F.avg(F.col("nv") * F.col("nv")).alias("_q"))
    return cells.join(g, ["gid", "ix", "iy"]).select("gid", "ix", "iy", "v", F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0))).alias("sd"))


def gaps_filled(cells: DataFrame, passes: int = 2) -> DataFrame:
    """A dense grid whose unknown values (v null) take the nearest known one along the row or the column, west, east, north and
    south in turn at each distance. In row order and in place, as later fills read earlier ones; one grouped-map call a grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = pdf["ix"].min(), pdf["iy"].min()
        z = np.full((pdf["iy"].max() - y0 + 1, pdf["ix"].max() - x0 + 1), np.nan)
        z[pdf["iy"] - y0, pdf["ix"] - x0] = pdf["v"]
        rows, cols = z.shape
        for _ in range(passes):
            for r, c in np.argwhere(np.isnan(z)).tolist():
                best = []
                for k, line in enumerate((z[r, :c][::-1], z[r, c + 1 :], z[:r, c][::-1], z[r + 1 :, c])):
                    known = np.flatnonzero(~np.isnan(line))
                    if len(known):
                        best.append((known[0], k, line[known[0]]))
                if best:
                    z[r, c] = min(best)[2]
        return pd.DataFrame({"gid": pdf["gid"], "ix": pdf["ix"], "iy": pdf["iy"], "v": z[pdf["iy"] - y0, pdf["ix"] - x0]})

    return cells.groupBy("gid").applyInPandas(run, "gid long, ix long, iy long, v double")


def bilinear_at(points: DataFrame, grid: DataFrame, width: int, height: int) -> DataFrame:
    """points (id, px, py) with z, bilinear between the four cells around (px, py); unknown cells count 0, points off the grid are 0.

    One equi-join on the cell: each point asks for its four corners and their weights.
    """
    inside = (F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") <= width - 1) & (F.col("py") <= height - 1)
    x0, y0 = F.floor("px"), F.floor("py")
    tx, ty = F.col("px") - x0, F.col("py") - y0
    x1, y1 = F.least(x0 + 1, F.lit(width - 1)), F.least(y0 + 1, F.lit(height - 1))
    corner = lambda x, y, w: F.struct(x.cast("long").alias("ix"), y.cast("long").alias("iy"), w.alias("w"))
    corners = F.array(corner(x0, y0, (1 - tx) * (1 - ty)), corner(x1, y0, tx * (1 - ty)), corner(x0, y1, (1 - tx) * ty), corner(x1, y1, tx * ty))
    asked = points.where(inside).select("gid", "id", F.explode(corners).alias("c")).select("gid", "id", "c.*")
    z = asked.join(grid.select("gid", "ix", "iy", "v"), ["gid", "ix", "iy"]).groupBy("gid", "id").agg(F.sum(F.col("w") * F.col("v")).alias("z"))
    return points.join(z, ["gid", "id"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))


def grown(cells: DataFrame, allowed: DataFrame, passes: int = 4, touch: int = 2) -> DataFrame:
    """Region growing: in each pass, allowed places with `touch` cells beside them join with their mean; passes are synchronous."""
    for _ in range(passes):
        new = neighbour_stats(cells).where(F.col("n") >= touch).join(cells.select("gid", "ix", "iy"), ["gid", "ix", "iy"], "left_anti").join(allowed, ["gid", "ix", "iy"], "left_semi")
        cells = cells.unionByName(new.select("gid", "ix", "iy", F.col("mean").alias("v")))
    return cells


def merged_sources(measured: DataFrame, model: DataFrame) -> DataFrame:
    """A full join in which the measured value wins; says where each came from."""
    m = measured.select("gid", "ix", "iy", F.col("v").alias("a")).join(model.select("gid", "ix", "iy", F.col("v").alias("b")), ["gid", "ix", "iy"], "full")
    return m.select("gid", "ix", "iy", F.coalesce("a", "b").alias("v"), F.when(F.col("a").isNotNull(), "measured").otherwise("model").alias("source"))


def _labels(pdf: pd.DataFrame, offsets) -> np.ndarray:
    """Component numbers of a table of cells, by union-find."""
    place = {(x, y): i for i, (x, y) in enumerate(zip(pdf["ix"].tolist(), pdf["iy"].tolist(), strict=True))}
    parent = list(range(len(place)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (x, y), i in place.items():
        for dx, dy in offsets[:2] if offsets is FOUR else offsets:
            j = place.get((x + dx, y + dy))
            if j is not None:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        if offsets is FOUR and (j := place.get((x, y + 1))) is not None:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(parent))])


def components(cells: DataFrame, four: bool = True) -> DataFrame:
    """cells with `label`, the component's first cell as "ix,iy" in row order; one grouped-map call for each gid (tile)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["iy", "ix"]).drop_duplicates(["ix", "iy"]).reset_index(drop=True)
        first = _labels(pdf, FOUR if four else EIGHT)
        pdf["label"] = [f"{pdf['ix'].iat[i]},{pdf['iy'].iat[i]}" for i in first]
        return pdf[["gid", "ix", "iy", "v", "label"]]

    return cells.groupBy("gid").applyInPandas(run, "gid long, ix long, iy long, v double, label string")


def wide_components(cells: DataFrame, rounds: int = 200) -> DataFrame:
    """The same for grids too large for a task: labels spread to neighbours, then each label jumps to its label's label, until
    nothing changes. Rounds are written to the shared folder."""
    from plotweave.operators.stages import settled

    key = lambda x, y: F.shiftleft(F.col(y) + (1 << 30), 31) + F.col(x) + (1 << 30)
    start = cells.select("gid", "ix", "iy", "v", key("ix", "iy").alias("label"))

    def step(now: DataFrame) -> DataFrame:
        beside = shifted(now, FOUR, "label").groupBy("gid", "ix", "iy").agg(F.min("nv").alias("m"))
        near = now.join(beside, ["gid", "ix", "iy"], "left").withColumn("label", F.least("label", F.coalesce("m", "label"))).drop("m")
        of = near.select("gid", key("ix", "iy").alias("label"), F.col("label").alias("_up"))
        return near.join(of, ["gid", "label"]).withColumn("label", F.col("_up")).drop("_up").select("gid", "ix", "iy", "v", "label")

    done = settled(start, step, F.sum(F.col("label").cast("decimal(38,0)")), rounds)
    return done.select("gid", "ix", "iy", "v", F.concat_ws(",", F.col("label") % (1 << 31) - (1 << 30), F.shiftright("label", 31) - (1 << 30)).alias("label"))


def component_sizes(labelled: DataFrame, cell_m: float) -> DataFrame:
    """Per component: cells, area, bounds, aspect and fill."""
    g = labelled.groupBy("gid", "label").agg(F.count("*").alias("cells"), F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1"), F.max("v").alias("top"), F.min("v").alias("low"))
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return g.withColumns({"area_m2": F.col("cells") * cell_m * cell_m, "aspect": F.greatest(w, h) / F.least(w, h), "fill": F.col("cells") / (w * h)})


def solid_components(labelled: DataFrame, cell_m: float, least_m2: float, aspect: float = 3.6, fill: float = 0.62) -> DataFrame:
    """Cells of components that are large, compact and full enough."""
    good = component_sizes(labelled, cell_m).where((F.col("area_m2") >= least_m2) & (F.col("aspect") <= aspect) & (F.col("fill") >= fill)).select("gid", "label")
    return labelled.join(good, ["gid", "label"], "left_semi")


def without_flat_tops(labelled: DataFrame, least_cells: int, spread: float) -> DataFrame:
    """Without large components whose heights hardly differ (roofs, not crowns)."""
    flat = labelled.groupBy("gid", "label").agg(F.count("*").alias("n"), (F.max("v") - F.min("v")).alias("s")).where((F.col("n") >= least_cells) & (F.col("s") < spread))
    return labelled.join(flat, ["gid", "label"], "left_anti")


def without_thin_lines(labelled: DataFrame, least_cells: int = 4) -> DataFrame:
    """Without components of at least least_cells that are one cell wide either way."""
    b = labelled.groupBy("gid", "label").agg(F.count("*").alias("n"), (F.max("ix") - F.min("ix")).alias("w"), (F.max("iy") - F.min("iy")).alias("h"))
    return labelled.join(b.where((F.col("n") >= least_cells) & ((F.col("w") == 0) | (F.col("h") == 0))), ["gid", "label"], "left_anti")


def outline_edges(cells: DataFrame) -> DataFrame:
    """Edges of a cell set's outline: sides of one cell only. (gid, ax, ay, bx, by) with a before b."""
    sides = F.expr("array(struct(ix AS ax, iy AS ay, ix + 1 AS bx, iy AS by), struct(ix AS ax, iy + 1 AS ay, ix + 1 AS bx, iy + 1 AS by), struct(ix AS ax, iy AS ay, ix AS bx, iy + 1 AS by), struct(ix + 1 AS ax, iy AS ay, ix + 1 AS bx, iy + 1 AS by))")
    return cells.select("gid", F.explode(sides).alias("s")).groupBy("gid", "s").agg(F.count("*").alias("n")).where("n = 1").select("gid", "s.*")


def watershed(cells: DataFrame, least: float = 5.0, small: int = 8) -> DataFrame:
    """Marker watershed per gid: tops of `least` or more are seeds, cells join by falling height over four neighbours, and
    pieces of fewer than `small` cells join the neighbour with the longest shared edge, three passes at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["iy", "ix"]).drop_duplicates(["ix", "iy"]).reset_index(drop=True)
        h = {(x, y): v for x, y, v in zip(pdf["ix"].tolist(), pdf["iy"].tolist(), pdf["v"].tolist(), strict=True)}
        label, heap = {}, []
        for (x, y), v in h.items():
            higher = any((h.get((x + i, y + j), -1), -(y + j), -(x + i)) > (v, -y, -x) for i, j in EIGHT)
            if v >= least and not higher:
                label[x, y] = len(label)
                heapq.heappush(heap, (-v, y, x))
        while heap:
            _, y, x = heapq.heappop(heap)
            for i, j in FOUR:
                p = (x + i, y + j)
                if p in h and p not in label:
                    label[p] = label[x, y]
                    heapq.heappush(heap, (-h[p], p[1], p[0]))
        for _ in range(3):
            size = pd.Series(list(label.values()), dtype="int64").value_counts().to_dict()
            edge: dict[int, dict[int, int]] = {}
            for (x, y), k in label.items():
                if size[k] < small:
                    for i, j in FOUR:
                        o = label.get((x + i, y + j), k)
                        if o != k:
                            edge.setdefault(k, {})[o] = edge.get(k, {}).get(o, 0) + 1
            to = {k: max(sorted(e), key=e.get) for k, e in edge.items()}
            if not to:
                break
            label = {p: to.get(k, k) for p, k in label.items()}
        pdf["segment"] = [label.get((x, y), -1) for x, y in zip(pdf["ix"].tolist(), pdf["iy"].tolist(), strict=True)]
        return pdf[["gid", "ix", "iy", "v", "segment"]]

    return cells.groupBy("gid").applyInPandas(run, "gid long, ix long, iy long, v double, segment long")


def distance_inside(cells: DataFrame) -> DataFrame:
    """Chessboard steps from each cell to the nearest place outside the set, by grouped breadth-first search."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        here = set(zip(pdf["ix"].tolist(), pdf["iy"].tolist(), strict=True))
        now, d, out = here, 0, {}
        while now:
            d += 1
            rim = {p for p in now if any((p[0] + i, p[1] + j) not in now for i, j in EIGHT)}
            out |= dict.fromkeys(rim, d)
            now = now - rim
        pdf["d"] = [out[p] for p in zip(pdf["ix"].tolist(), pdf["iy"].tolist(), strict=True)]
        return pdf[["gid", "ix", "iy", "d"]]

    return cells.groupBy("gid").applyInPandas(run, "gid long, ix long, iy long, d long")


def enclosed_places(cells: DataFrame) -> DataFrame:
    """Empty places inside a gid's bounds that no path of empty places joins to their border."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["ix"].min()) - 1, int(pdf["iy"].min()) - 1
        solid = np.zeros((int(pdf["iy"].max()) - y0 + 2, int(pdf["ix"].max()) - x0 + 2), bool)
        solid[pdf["iy"].to_numpy() - y0, pdf["ix"].to_numpy() - x0] = True
        out, todo = np.zeros_like(solid), [(0, 0)]
        out[0, 0] = True
        while todo:
            r, c = todo.pop()
            for i, j in FOUR:
                a, b = r + i, c + j
                if 0 <= a < solid.shape[0] and 0 <= b < solid.shape[1] and not solid[a, b] and not out[a, b]:
                    out[a, b] = True
                    todo.append((a, b))
        r, c = np.nonzero(~solid & ~out)
        return pd.DataFrame({"gid": pdf["gid"].iat[0], "ix": c + x0, "iy": r + y0})

    return cells.groupBy("gid").applyInPandas(run, "gid long, ix long, iy long")


def interpolated(samples: DataFrame, targets: DataFrame, sample_rows: int = 20_000, target_rows: int = 5_000) -> DataFrame:
    """Inverse-square-distance means at targets (tid, x, y) over all samples (x, y, z); a sample on the target decides.

    Samples of one place are summed first. Targets and samples are dealt into blocks of about the given rows; each pair of
    blocks gives its targets' partial sums in numpy, which are then added up, so no task holds more than two blocks.
    Several samples on a target give their mean. Without samples z is null.
    """
    places = samples.groupBy("x", "y").agg(F.sum("z").alias("z"), F.count("*").cast("double").alias("n"))
    n_samples, n_targets = places.count(), targets.count()
    s_blocks, t_blocks = -(-max(1, n_samples) // sample_rows), -(-max(1, n_targets) // target_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = targets.select("tid", "x", "y", F.pmod(F.xxhash64("tid"), F.lit(t_blocks)).cast("int").alias("tb"), every(s_blocks).alias("sb"))
    b = places.select("x", "y", "z", "n", F.pmod(F.xxhash64("x", "y"), F.lit(s_blocks)).cast("int").alias("sb"), every(t_blocks).alias("tb"))

    def run(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(t), 4))
        sx, sy, sz, sn = (s[c].to_numpy() for c in ("x", "y", "z", "n"))
        at = t[["x", "y"]].to_numpy()
        for i in range(0, len(t), 200):
            d2 = (at[i : i + 200, :1] - sx) ** 2 + (at[i : i + 200, 1:] - sy) ** 2
            hit = d2 < 1e-18
            w = np.where(hit, 0.0, 1 / np.where(hit, 1.0, d2))
            out[i : i + 200] = np.stack([w @ sz, w @ sn, hit @ sz, hit @ sn], axis=1)
        return pd.DataFrame({"tid": t["tid"], "zw": out[:, 0], "w": out[:, 1], "zh": out[:, 2], "h": out[:, 3]})

    parts = a.groupBy("tb", "sb").cogroup(b.groupBy("tb", "sb")).applyInPandas(run, "tid long, zw double, w double, zh double, h double")
    sums = parts.groupBy("tid").agg(*[F.sum(c).alias(c) for c in ("zw", "w", "zh", "h")])
    return sums.select("tid", F.when(F.col("h") > 0, F.col("zh") / F.col("h")).when(F.col("w") > 0, F.col("zw") / F.col("w")).alias("z"))


def interpolated_near(samples: DataFrame, targets: DataFrame, side: float, reach: int = 1) -> DataFrame:
    """An approximation of interpolated() by the samples in the cells around: targets without one drop out."""
    ring = F.expr(f"flatten(transform(sequence(-{reach}, {reach}), i -> transform(sequence(-{reach}, {reach}), j -> struct(i, j))))")
    t = targets.withColumn("_o", F.explode(ring)).withColumns({"_cx": F.floor(F.col("x") / side) + F.col("_o.i"), "_cy": F.floor(F.col("y") / side) + F.col("_o.j")}).drop("_o")
    s = samples.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "z").withColumns({"_cx": F.floor(F.col("_x") / side), "_cy": F.floor(F.col("_y") / side)})
    d2 = F.pow(F.col("x") - F.col("_x"), F.lit(2)) + F.pow(F.col("y") - F.col("_y"), F.lit(2))
    m = t.join(s, ["_cx", "_cy"]).withColumn("_d2", d2)
    inverse = F.when(F.col("_d2") > 0, 1 / F.col("_d2"))
    return m.groupBy("tid").agg(F.coalesce(F.avg(F.when(F.col("_d2") == 0, F.col("z"))), F.sum(F.col("z") * inverse) / F.sum(inverse)).alias("z"))


def rectangles(cells: DataFrame) -> DataFrame:
    """Cells as rectangles: row runs, then runs of equal span on consecutive rows. (gid, x0, x1, y0, y1), ends inclusive.

    Two rounds of gaps and islands, by windows only.
    """
    row = W.partitionBy("gid", "iy").orderBy("ix")
    runs = cells.select("gid", "ix", "iy").distinct().withColumn("_g", F.col("ix") - F.row_number().over(row)).groupBy("gid", "iy", "_g").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"))
    column = W.partitionBy("gid", "x0", "x1").orderBy("iy")
    return runs.withColumn("_h", F.col("iy") - F.row_number().over(column)).groupBy("gid", "x0", "x1", "_h").agg(F.min("iy").alias("y0"), F.max("iy").alias("y1")).drop("_h")


def prefix_sums(cells: DataFrame) -> DataFrame:
    """Summed-area values s of a grid at its cells: rows first, then columns. Absent cells count 0; for this the grid is made dense."""
    span = cells.groupBy("gid").agg(F.min("ix").alias("a"), F.max("ix").alias("b"), F.min("iy").alias("c"), F.max("iy").alias("d"))
    dense = span.select("gid", "c", "d", F.explode(F.sequence("a", "b")).alias("ix")).select("gid", "ix", F.explode(F.sequence("c", "d")).alias("iy"))
    full = dense.join(cells.select("gid", "ix", "iy", "v"), ["gid", "ix", "iy"], "left").select("gid", "ix", "iy", F.coalesce("v", F.lit(0.0)).alias("v"))
    return _dense_prefix_sums(full).join(cells.select("gid", "ix", "iy"), ["gid", "ix", "iy"], "left_semi")


def _dense_prefix_sums(cells: DataFrame) -> DataFrame:
    a = cells.withColumn("_r", F.sum("v").over(W.partitionBy("gid", "iy").orderBy("ix").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return a.withColumn("s", F.sum("_r").over(W.partitionBy("gid", "ix").orderBy("iy").rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_r")


def overlap_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """(gid, iou) of two cell sets."""
    m = a.select("gid", "ix", "iy", F.lit(1).alias("a")).join(b.select("gid", "ix", "iy", F.lit(1).alias("b")), ["gid", "ix", "iy"], "full")
    return m.groupBy("gid").agg((F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)) / F.count("*")).alias("iou"))


def disc(radius: int) -> tuple[tuple[int, int], ...]:
    """The offsets within a radius, the middle included."""
    span = range(-radius, radius + 1)
    return tuple((i, j) for i in span for j in span if i * i + j * j <= radius * radius)


def dilated_within(cells: DataFrame, allowed: DataFrame, radius: int) -> DataFrame:
    """(gid, ix, iy): the places of `allowed` within the radius of a cell, cells included."""
    places = ["gid", "ix", "iy"]
    return allowed.select(*places).distinct().join(shifted(cells, disc(radius)).select(*places), places, "left_semi")


def looked_up(points: DataFrame, cells: DataFrame, west: float, south: float, east: float, north: float, wide: int, high: int) -> DataFrame:
    """points with `height`: the value of the cell, counted from the upper left corner, that a point lies in, 0 where there is none."""
    ix, iy = F.floor((F.col("x") - west) / (east - west) * wide), F.floor((north - F.col("y")) / (north - south) * high)
    g = cells.select(F.col("ix").cast("long").alias("_ix"), F.col("iy").cast("long").alias("_iy"), F.col("v").alias("_v")).where(F.col("_ix").between(0, wide - 1) & F.col("_iy").between(0, high - 1))
    met = points.withColumns({"_ix": ix, "_iy": iy}).join(g, ["_ix", "_iy"], "left")
    return met.withColumn("height", F.coalesce("_v", F.lit(0))).drop("_ix", "_iy", "_v")
