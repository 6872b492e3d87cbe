"""Usage as streams: incremental metrics with retraction, rate limits, admission, heartbeats.

Sources are any streaming DataFrames; stateful steps keep small state per key and expire it by event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", key: str = "key") -> DataFrame:
    """Calls per key and fixed window, closed by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def tumbling_verdicts(events: DataFrame, every: str, limit: int, key: str = "key", order: str = "id") -> DataFrame:
    """Which calls a fixed-window limit lets through: the first `limit` of each key and window (refused ones do not count)."""
    w = W.partitionBy(key, F.window("ts", every)).orderBy("ts", order)
    return events.withColumn("allowed", F.row_number().over(w) <= limit)


def sliding_verdicts(events: DataFrame, limits: list[tuple[int, int]], key: str = "key", order: str = "id") -> DataFrame:
    """Which calls a log of accepted calls lets through: fewer than n in the last s seconds, for each (s, n). Refused calls
    are not logged, so each key is one sequential pass."""

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, log, out = pdf.sort_values(["ts", order]), [], []
        longest = pd.Timedelta(seconds=max(s for s, _ in limits))
        for t in pdf["ts"]:
            log = [x for x in log if t - x <= longest]
            ok = all(sum(t - x <= pd.Timedelta(seconds=s) for x in log) < n for s, n in limits)
            out.append(ok)
            if ok:
                log.append(t)
        return pdf.assign(allowed=out)

    return events.groupBy(key).applyInPandas(run, f"{fields}, allowed boolean")


def visitor_effects(events: DataFrame) -> DataFrame:
    """Stream of deltas per (period, host): each event (visitor, host, period, kind, delta) updates its visitor's counts and
    yields what changes in the totals: events, distinct users, exporting users. delta may be -1, clipped at zero."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = dict(zip(("pv", "st", "dn", "er", "ca"), state.get, strict=True)) if state.exists else dict.fromkeys(("pv", "st", "dn", "er", "ca"), 0)
        rows = []
        for pdf in parts:
            for kind, delta in pdf.sort_values("ts")[["kind", "delta"]].itertuples(index=False):
                was = dict(counts)
                counts[kind] = max(0, counts[kind] + int(delta))
                user = lambda c: c["pv"] > 0 or c["st"] > 0
                rows.append((key[0], key[1], kind, counts[kind] - was[kind], int(user(counts)) - int(user(was)), int(counts["st"] > 0) - int(was["st"] > 0)))
        state.update(tuple(counts.values()))
        yield pd.DataFrame(rows, columns=["period", "host", "kind", "events", "users", "exporting"])

    out = "period string, host string, kind string, events long, users long, exporting long"
    return events.groupBy("period", "host", "visitor").applyInPandasWithState(run, out, "pv long, st long, dn long, er long, ca long", "append", GroupStateTimeout.NoTimeout)


def folded(effects: DataFrame) -> DataFrame:
    """Totals from deltas; equal to the batch aggregate over the same events."""
    s = lambda k: F.sum(F.when(F.col("kind") == k, F.col("events")).otherwise(0))
    return effects.groupBy("period", "host").agg(s("pv").alias("page_views"), F.sum("users").alias("unique_users"), F.sum("exporting").alias("exporting_users"), s("st").alias("started"), s("dn").alias("done"), s("er").alias("errors"), s("ca").alias("cancelled"))


def once(events: DataFrame, key: str = "job", ttl: str = "24 hours") -> DataFrame:
    """The first event of each key within the time to live."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def admissions(events: DataFrame, most: int = 2) -> DataFrame:
    """FIFO admission per owner: events (owner, ts, job, op add|done) to rows (owner, job, state) as jobs start or wait."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, waiting = (list(x) for x in state.get) if state.exists else ([], [])
        rows = []
        for pdf in parts:
            for job, op in pdf.sort_values("ts")[["job", "op"]].itertuples(index=False):
                if op == "add" and job not in active and job not in waiting:
                    (active if len(active) < most else waiting).append(job)
                    rows.append((key[0], job, "active" if job in active else "waiting"))
                elif op == "done":
                    active, waiting = [j for j in active if j != job], [j for j in waiting if j != job]
                    while waiting and len(active) < most:
                        active.append(waiting.pop(0))
                        rows.append((key[0], active[-1], "active"))
        state.update((active, waiting))
        yield pd.DataFrame(rows, columns=["owner", "job", "state"])

    return events.groupBy("owner").applyInPandasWithState(run, "owner string, job string, state string", "active array<string>, waiting array<string>", "append", GroupStateTimeout.NoTimeout)


def beats(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of heartbeats per job with no pause of `gap`: session windows, closed by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "job").agg(F.count("*").alias("n")).select("job", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("stale_at"), "n")


def stale_gaps(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Batch form: pauses of at least `seconds` between a key's events."""
    w = W.partitionBy(key).orderBy("ts", "id")
    d = events.withColumn("prev", F.lag("ts").over(w))
    return d.withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.col("prev").cast("timestamp")) / 1e6).where(F.col("gap") >= seconds)


def unexpired(rows: DataFrame, now, ttl: DataFrame, kind: str = "kind") -> DataFrame:
    """Rows whose kind's time to live has not run out; ttl is a small table (kind, seconds)."""
    return rows.join(ttl, kind).where(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.col("seconds") >= F.unix_micros(F.lit(now).cast("timestamp")) / 1e6).drop("seconds")
