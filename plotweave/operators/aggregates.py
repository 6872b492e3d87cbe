"""Grid, period and distribution aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.functions.numeric import col, floor_rank, half_up, nearest_rank, ratio


def cell(x, side: float, origin: float = 0.0) -> Column:
    return F.floor((col(x) - origin) / side).cast("long")


def grid_points(points: DataFrame, side: float) -> DataFrame:
    """Point cloud to cells: counts by class, ground, top and first-return heights. points: x, y, z, cls, ret, nret.

    Noise classes 7 and 18 drop out. All aggregates combine on the map side.
    """
    p = points.where(~F.col("cls").isin(7, 18))
    first = F.col("ret") == 1
    return p.groupBy(cell("x", side).alias("ix"), cell("y", side).alias("iy")).agg(
        F.count("*").alias("n"), F.count_if(F.col("cls") == 2).alias("n_ground"), F.count_if(F.col("cls") == 6).alias("n_building"),
        F.count_if(F.col("cls").isin(3, 4, 5)).alias("n_veg"), F.count_if(F.col("nret") > 1).alias("n_split"),
        F.min(F.when(F.col("cls") == 2, F.col("z"))).alias("ground"), F.max("z").alias("top"), F.max(F.when(first, F.col("z"))).alias("first_top"), F.count_if(first).alias("n_first"),
    )


def ground_fallback(cells: DataFrame, reach: int = 3) -> DataFrame:
    """Each cell's ground, or the least ground in the nearest square ring within reach that has any."""
    have = cells.where("ground is not null").select("ix", "iy", F.col("ground").alias("_g"))
    rings = F.expr(f"flatten(transform(sequence(-{reach}, {reach}), i -> transform(sequence(-{reach}, {reach}), j -> struct(i, j, greatest(abs(i), abs(j)) AS r))))")
    around = have.withColumn("_o", F.explode(rings)).select((F.col("ix") + F.col("_o.i")).alias("ix"), (F.col("iy") + F.col("_o.j")).alias("iy"), F.col("_o.r").alias("_r"), "_g")
    best = around.groupBy("ix", "iy").agg(F.min(F.struct("_r", "_g")).alias("_b"))
    return cells.join(best, ["ix", "iy"], "left").withColumn("ground_used", F.coalesce("ground", F.col("_b._g"))).drop("_b")


def rank_percentile(values: str, p: float, floor: bool = False) -> Column:
    """A nearest-rank percentile over a group (collects it; for bounded groups such as cells and rings)."""
    return (floor_rank if floor else nearest_rank)(F.collect_list(values), p)


def exact_rank_percentile(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The same for groups of any size, without collecting: by rank in a histogram of distinct values."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    total = hist.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = hist.join(total, keys).withColumn("_upto", upto).where(F.col("_upto") > F.floor((F.col("_all") - 1) * p + 0.5))
    return ranked.groupBy(*keys).agg(F.min(value).alias(value))


def peak_pool(cells: DataFrame, stride: int, least: float, most: float, value: str = "v") -> DataFrame:
    """Max-pooled blocks of stride x stride cells that hold two or more values in [least, most)."""
    kept = cells.where((F.col(value) >= least) & (F.col(value) < most))
    return kept.groupBy(F.floor(F.col("ix") / stride).alias("bx"), F.floor(F.col("iy") / stride).alias("by")).agg(F.max(value).alias("peak"), F.count("*").alias("n")).where("n >= 2")


def period_usage(events: DataFrame, keys: list[str]) -> DataFrame:
    """Usage per period key(s): events needs visitor and kind (pv, st, dn, er, ca)."""
    per = events.groupBy(*keys, "visitor").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("pv", "st", "dn", "er", "ca")])
    out = per.groupBy(*keys).agg(
        F.sum("pv").alias("page_views"), F.count_if((F.col("pv") > 0) | (F.col("st") > 0)).alias("unique_users"), F.count_if(F.col("st") > 0).alias("exporting_users"),
        F.sum("st").alias("started"), F.sum("dn").alias("done"), F.sum("er").alias("errors"), F.sum("ca").alias("cancelled"),
    )
    return out.withColumns({"conversion": ratio("exporting_users", "unique_users"), "success": ratio("done", "started"), "mean_starts": ratio("started", "exporting_users")})


def host_rollup(usage: DataFrame, keys: list[str], host: str = "host") -> DataFrame:
    """Rows per host and, with host 'all', their sums; distinct users are summed over hosts, not recounted."""
    sums = ["page_views", "unique_users", "exporting_users", "started", "done", "errors", "cancelled"]
    return usage.groupingSets([[*map(F.col, keys), F.col(host)], [*map(F.col, keys)]], *keys, host).agg(*[F.sum(c).alias(c) for c in sums]).withColumn(host, F.coalesce(host, F.lit("all")))


def starts_histogram(per_user: DataFrame, n: str = "st") -> DataFrame:
    """Users by starts, in the buckets 1, 2-3, 4-10 and 11+."""
    bucket = F.when(F.col(n) == 1, "1").when(F.col(n) <= 3, "2-3").when(F.col(n) <= 10, "4-10").otherwise("11+")
    return per_user.where(F.col(n) > 0).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("users"), F.sum(n).alias("starts"))


def span_union(spans: DataFrame, keys: list[str], start: str = "t0", end: str = "t1") -> DataFrame:
    """Total time per key that any span covers: overlaps count once."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = spans.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int")).withColumn("_island", F.sum("_new").over(w))
    return new.groupBy(*keys, "_island").agg(F.min(start).alias("a"), F.max(end).alias("b")).groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("covered"), F.count("*").alias("islands"))


def fit_affine(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Least-squares u, v from x, y, by nine sums and a closed form: u = a0 + a1 x + a2 y, v = b0 + b1 x + b2 y."""
    g = points.groupBy(*(keys or []))
    x, y = F.col("x"), F.col("y")
    m = g.agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"),
        F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop(x, F.col("u")).alias("xu"), F.covar_pop(y, F.col("u")).alias("yu"),
        F.covar_pop(x, F.col("v")).alias("xv"), F.covar_pop(y, F.col("v")).alias("yv"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    one = lambda c: (F.col(f"x{c}") * F.col("yy") - F.col(f"y{c}") * F.col("xy")) / det
    two = lambda c: (F.col(f"y{c}") * F.col("xx") - F.col(f"x{c}") * F.col("xy")) / det
    m = m.withColumns({"a1": one("u"), "a2": two("u"), "b1": one("v"), "b2": two("v")})
    m = m.withColumns({"a0": F.col("mu") - F.col("a1") * F.col("mx") - F.col("a2") * F.col("my"), "b0": F.col("mv") - F.col("b1") * F.col("mx") - F.col("b2") * F.col("my")})
    return m.where("n >= 3").select(*(keys or []), "n", "a0", "a1", "a2", "b0", "b1", "b2")


def levels(values: DataFrame, value: str, k: int, step: float = 0.5, rounds: int = 25) -> list[float]:
    """One-dimensional k-means on a histogram of step-wide bins (bounded by the domain over step, not by rows).

    Centres start at quantiles, are rounded to 0.1 and made distinct each round, and stop when none moves by 0.05.
    """
    bins = values.where(F.col(value).isNotNull()).groupBy(half_up(F.col(value) / step).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
    if not bins:
        return []
    xs, ns = [r["b"] * step for r in bins], [r["n"] for r in bins]
    total, centres, seen, i = sum(ns), [], 0, 0
    for j in range(k):
        goal = (j + 0.5) / k * total
        while i < len(xs) - 1 and seen + ns[i] < goal:
            seen += ns[i]
            i += 1
        centres.append(xs[i])
    centres = sorted({round(c, 1) for c in centres})
    for _ in range(rounds):
        sums = [[0.0, 0] for _ in centres]
        for x, n in zip(xs, ns, strict=True):
            c = min(range(len(centres)), key=lambda m: abs(centres[m] - x))
            sums[c][0] += x * n
            sums[c][1] += n
        new = sorted({round(s / n, 1) for s, n in sums if n})
        if len(new) == len(centres) and max(abs(a - b) for a, b in zip(new, centres, strict=True)) < 0.05:
            return new
        centres = new
    return centres


def cell_heights(cloud: DataFrame, side: float) -> DataFrame:
    """(cx, cy, h, kind) of the cells of a point cloud that hold a roof: 0.9 rank of building returns 2 m over the ground, else
    of three flat single returns (within 6 m, no vegetation) 3 m over it. Ground is the lowest ground return; none, no row.

    Ranks are by sorted values of a cell, which a laser's density bounds.
    """
    c = cloud.select(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"), "z", "cls", "nret")
    flat = F.when((F.col("cls") == 1) & (F.col("nret") == 1), F.col("z"))
    g = c.groupBy("cx", "cy").agg(
        F.min(F.when(F.col("cls") == 2, F.col("z"))).alias("ground"), F.collect_list(F.when(F.col("cls") == 6, F.col("z"))).alias("b"), F.collect_list(flat).alias("u"), F.count_if(F.col("cls").isin(3, 4, 5)).alias("vc"),
    )
    high, low = nearest_rank(F.col("b"), 0.9) - F.col("ground"), nearest_rank(F.col("u"), 0.9) - F.col("ground")
    by_class = F.coalesce(high >= 2, F.lit(False))
    by_shape = (F.size("u") >= 3) & (F.col("vc") == 0) & (F.array_max("u") - F.array_min("u") <= 6) & (low > 3)
    return g.where(F.col("ground").isNotNull() & (by_class | by_shape)).select("cx", "cy", F.when(by_class, high).otherwise(low).alias("h"), F.when(by_class, "class6").otherwise("ndsm").alias("kind"))


def finishes_by_creation(events: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """(day, a column per kind): a finish belongs to the key's last start before it; a job's first finish counts, on the day
    of its start. One window a key."""
    w = W.partitionBy(key).orderBy("ts", "id").rowsBetween(W.unboundedPreceding, -1)
    started = F.last(F.when(F.col("kind") == "st", F.struct("ts", "id")), ignorenulls=True).over(w)
    ends = events.withColumn("job", started).where(F.col("kind").isin(*kinds) & F.col("job").isNotNull())
    first = ends.groupBy(key, "job").agg(F.min_by("kind", F.struct("ts", "id")).alias("kind"))
    return first.groupBy(F.date_format("job.ts", "yyyy-MM-dd").alias("day")).agg(*[F.count_if(F.col("kind") == k).alias(name) for k, name in kinds.items()])


def floored_sums(events: DataFrame, keys: list[str], delta: str, order: list[str], name: str) -> DataFrame:
    """Per key what is left of adding the deltas in order, held at 0 from below: the sum less the least running sum under 0."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = events.withColumn("_run", F.sum(delta).over(w))
    return run.groupBy(*keys).agg((F.sum(delta) - F.least(F.min("_run"), F.lit(0))).alias(name))


def reserved_slots(calls: DataFrame, keys: list[str], at: str, order: list[str], gap: int) -> DataFrame:
    """calls with `slot`: not before the call, and gap after the key's last slot: a running maximum of the calls less their turns."""
    w = W.partitionBy(*keys).orderBy(*order)
    turn = calls.withColumn("_turn", (F.row_number().over(w).cast("long") - 1) * gap)
    return turn.withColumn("slot", F.max(F.col(at) - F.col("_turn")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("_turn")).drop("_turn")


def month_sweep(events: DataFrame, today: str) -> DataFrame:
    """(month, due, users, views, raw_left): totals of each month; months three days past their end keep no raw rows."""
    from plotweave.functions.dates import month_due, month_key

    m = events.withColumn("month", month_key("ts"))
    g = m.groupBy("month").agg(F.countDistinct("visitor").alias("users"), F.count_if(F.col("kind") == "pv").alias("views"), F.count("*").alias("n"))
    g = g.withColumn("due", month_due("month", F.to_date(F.lit(today))))
    return g.select("month", "due", "users", "views", F.when(F.col("due"), 0).otherwise(F.col("n")).alias("raw_left"))


def bounded_sample(df: DataFrame, keys: list[str], order: list[str], value: str, cap: int, every: int = 4) -> DataFrame:
    """keys, slot, value: what a running sample of `cap` slots holds after the last row. The first cap rows fill it; of the
    later ones each `every`-th, counted from 1, overwrites the slot of its number modulo cap.

    A slot's last writer is an aggregate, so only the numbering needs a window, one within each key.
    """
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    slot = F.when(F.col("_n") <= cap, F.col("_n") - 1).when(F.col("_n") % every == 0, F.col("_n") % cap)
    written = df.withColumn("_n", n).withColumn("slot", slot).where("slot is not null")
    return written.groupBy(*keys, "slot").agg(F.max_by(value, "_n").alias(value))


def settled(calls: DataFrame, keys: list[str], at: str, order: list[str], wait: int) -> DataFrame:
    """The calls after which `wait` seconds pass without another of the key, with fires_at: a trailing debounce."""
    following = F.lead(at).over(W.partitionBy(*keys).orderBy(at, *order))
    due = F.col(at) + F.make_dt_interval(secs=F.lit(wait))
    return calls.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") >= due)).withColumn("fires_at", due).drop("_next")
