"""Top-k, caps, budgets, stratified and greedy selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows; each task keeps k at most."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def capped_per_kind(df: DataFrame, kind: str, caps: dict[str, int], *order) -> DataFrame:
    """At most caps[kind] rows of each kind; kinds without a cap go."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(kind))
    return df.withColumn("_n", F.row_number().over(W.partitionBy(kind).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def truncated_kinds(df: DataFrame, kind: str, caps: dict[str, int]) -> DataFrame:
    """(kind, n, cap, dropped) of the kinds that a cap cuts."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(kind))
    return df.groupBy(kind).agg(F.count("*").alias("n")).withColumn("cap", limit).where("n > cap").withColumn("dropped", F.col("n") - F.col("cap"))


def stratified(df: DataFrame, k: int, cells: int, bounds: tuple[float, float, float, float], *order) -> DataFrame:
    """k rows spread over a cells x cells grid: the best of every cell first, then the second best, and so on."""
    x0, y0, x1, y1 = bounds
    place = lambda c, a, b: F.least(F.floor((F.col(c) - a) / (b - a) * cells), F.lit(cells - 1))
    d = df.withColumns({"_cx": place("x", x0, x1), "_cy": place("y", y0, y1)})
    d = d.withColumn("_n", F.row_number().over(W.partitionBy("_cx", "_cy").orderBy(*order)))
    return d.orderBy("_n", "_cx", "_cy").limit(k).drop("_n", "_cx", "_cy")


def best_per_cell(df: DataFrame, side: float, *order) -> DataFrame:
    w = W.partitionBy(F.floor(F.col("x") / side), F.floor(F.col("y") / side)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def running_budget(df: DataFrame, size: str, budget: float, order: list[str], buckets: str | None = None) -> DataFrame:
    """The longest prefix in order whose sizes stay within the budget.

    Without buckets one global window does it. `buckets` names an integer column that rises with the order; then sums are
    taken per bucket and joined to offsets, and no task sees more than a bucket.
    """
    if buckets is None:
        w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumn("_upto", F.sum(size).over(w)).where(F.col("_upto") <= budget).drop("_upto")
    sums = df.groupBy(buckets).agg(F.sum(size).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(W.orderBy(buckets).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    w = W.partitionBy(buckets).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = df.join(before.where(F.col("_before") <= budget), buckets)
    return met.withColumn("_upto", F.col("_before") + F.sum(size).over(w)).where(F.col("_upto") <= budget).drop("_upto", "_before")


def document_budget(df: DataFrame, size: str, catalogue: str, catalogue_size: str, budget: float, order: list[str]) -> DataFrame:
    """The longest prefix whose document fits: a row costs its own bytes, and its catalogue entry's on first use."""
    first = F.row_number().over(W.partitionBy(catalogue).orderBy(*order)) == 1
    cost = df.withColumn("_cost", F.col(size) + F.when(first, F.col(catalogue_size)).otherwise(0))
    return running_budget(cost, "_cost", budget, order).drop("_cost")


def grouped_cap(df: DataFrame, group: str, order: str, cap: int, shelf: str) -> DataFrame:
    """Whole groups in order while they fit under cap rows; a group that does not fit is passed over, later ones may still.

    It is sequential within a shelf (one export), so each shelf is one grouped-map call over its groups' sizes only.
    """
    sizes = df.groupBy(shelf, group).agg(F.min(order).alias("_first"), F.count("*").alias("_rows"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, left, keep = pdf.sort_values(["_first", group]), cap, []
        for rows in pdf["_rows"]:
            keep.append(rows <= left)
            left -= rows if keep[-1] else 0
        return pdf[keep][[shelf, group]]

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    kept = sizes.groupBy(shelf).applyInPandas(pick, f"{shelf} {fields[shelf]}, {group} {fields[group]}")
    return df.join(kept, [shelf, group], "left_semi")


def greedy_apart(df: DataFrame, group: str, gap: float, most: int, schema: str) -> DataFrame:
    """Non-maximum suppression: in order of falling v (then id), a row stays if none kept lies within gap. Columns id, x, y, v."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept, cells = pdf.sort_values(["v", "id"], ascending=[False, True]), [], {}
        for i, (x, y) in enumerate(zip(pdf["x"].to_numpy(), pdf["y"].to_numpy(), strict=True)):
            cx, cy = int(x // gap), int(y // gap)
            near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in cells.get((cx + a, cy + b), ()))
            if all((x - p) ** 2 + (y - q) ** 2 >= gap * gap for p, q in near):
                kept.append(i)
                cells.setdefault((cx, cy), []).append((x, y))
                if len(kept) == most:
                    break
        return pdf.iloc[kept]

    return df.groupBy(group).applyInPandas(pick, schema)


def paged(df: DataFrame, page: int, size: int, order: list[str], collection: str = "collection") -> DataFrame:
    """One page of every collection, with its total and page count."""
    n = F.count("*").over(W.partitionBy(collection))
    d = df.withColumns({"_n": F.row_number().over(W.partitionBy(collection).orderBy(*order)), "total": n})
    return d.where(F.col("_n").between((page - 1) * size + 1, page * size)).withColumn("pages", F.ceil(F.col("total") / size)).drop("_n")


def tiered_top(df: DataFrame, k: int, area: str, height: str, order: str, bulk: float = 0.5, tall: float = 0.3) -> DataFrame:
    """A tiered top k: the largest half, then the tallest of the rest, then the largest again."""
    a, b = int(k * bulk), int(k * tall)
    one = df.withColumn("_a", F.row_number().over(W.orderBy(F.col(area).desc(), order)))
    two = one.withColumn("_h", F.row_number().over(W.orderBy((F.col("_a") <= a).cast("int"), F.col(height).desc(), order)))
    tier = F.when(F.col("_a") <= a, 1).when(F.col("_h") <= b, 2).otherwise(3)
    return two.withColumn("tier", tier).orderBy("tier", "_a").limit(k).drop("_a", "_h")


def monotone(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """value as it may be shown: it never falls."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("shown", F.max(value).over(w))


def folded_until_final(df: DataFrame, keys: list[str], order: str, state: str, final: tuple[str, ...]) -> DataFrame:
    """Events that still count: none after the first final state."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col(state).isin(*final).cast("int")).over(w), F.lit(0))
    return df.withColumn("_done", done).where("_done = 0").drop("_done")


def upper_gap(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the upper median of the positive gaps between sorted distinct values; null without any."""
    from plotweave.functions.numeric import upper_median

    d = df.select(*keys, value).distinct()
    g = d.withColumn("_g", F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(value))).where("_g > 0")
    return g.groupBy(*keys).agg(upper_median(F.collect_list("_g")).alias("gap"))


def arc_lengths(points: DataFrame, line: str, order: str) -> DataFrame:
    """Points of lines with the length travelled so far."""
    w = W.partitionBy(line).orderBy(order)
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2))), F.lit(0.0))
    return points.withColumn("_s", step).withColumn("along", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_s")


def stations(points: DataFrame, line: str, order: str, spacing: float) -> DataFrame:
    """(line, k, x, y): a point every `spacing` along each line, interpolated between its vertices."""
    w = W.partitionBy(line).orderBy(order)
    seg = arc_lengths(points, line, order).withColumns({"_x": F.lead("x").over(w), "_y": F.lead("y").over(w), "_b": F.lead("along").over(w)}).where("_b > along")
    first = F.ceil(F.col("along") / spacing)
    last = F.ceil(F.col("_b") / spacing) - 1
    k = seg.where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    t = (F.col("k") * spacing - F.col("along")) / (F.col("_b") - F.col("along"))
    return k.select(line, "k", (F.col("x") + t * (F.col("_x") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("_y") - F.col("y"))).alias("y"))
