import datetime as dt

import pytest
from pyspark.sql import functions as F

from plotweave.operators import aggregates
from plotweave.streaming import usage

T0 = dt.datetime(2024, 1, 1)


def streamed(spark, rows, schema, path, batches=3):
    for i in range(batches):
        spark.createDataFrame(rows[i::batches], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drained(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_incremental_usage_equals_batch(spark, tmp_path):
    kinds = ("pv", "st", "dn", "er")
    rows = [(f"2024-01-{1 + i % 3:02d}", "prod" if i % 4 else "dev", i * 7 % 11, T0 + dt.timedelta(minutes=i), kinds[i * 5 % 4], 1) for i in range(120)]
    schema = "period string, host string, visitor long, ts timestamp, kind string, delta int"
    got = usage.folded(drained(usage.visitor_effects(streamed(spark, rows, schema, tmp_path / "in")), tmp_path, "effects"))
    want = aggregates.period_usage(spark.createDataFrame(rows, schema), ["period", "host"]).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_retraction_is_clipped(spark, tmp_path):
    rows = [("p", "h", 1, T0, "st", 1), ("p", "h", 1, T0 + dt.timedelta(1), "st", -1), ("p", "h", 1, T0 + dt.timedelta(2), "st", -1)]
    schema = "period string, host string, visitor long, ts timestamp, kind string, delta int"
    total = usage.folded(drained(usage.visitor_effects(streamed(spark, rows, schema, tmp_path / "in", 1)), tmp_path, "undone")).first()
    assert (total["started"], total["exporting_users"], total["unique_users"]) == (0, 0, 0)


def test_admission_is_first_in_first_out(spark, tmp_path):
    ops = [("a", "add"), ("b", "add"), ("c", "add"), ("d", "add"), ("a", "done"), ("c", "done")]
    rows = [("me", T0 + dt.timedelta(seconds=i), job, op) for i, (job, op) in enumerate(ops)]
    out = drained(usage.admissions(streamed(spark, rows, "owner string, ts timestamp, job string, op string", tmp_path / "in", 1)), tmp_path, "admitted")
    assert [tuple(r) for r in out.select("job", "state").collect()] == [("a", "active"), ("b", "active"), ("c", "waiting"), ("d", "waiting"), ("c", "active"), ("d", "active")]


def test_tumbling_and_sessions(spark, tmp_path):
    rows = [("k", T0 + dt.timedelta(minutes=m)) for m in (0, 1, 2, 61, 62, 600)]
    counts = drained(usage.tumbling_counts(streamed(spark, rows, "key string, ts timestamp", tmp_path / "in", 1)), tmp_path, "counts")
    assert sorted(r["n"] for r in counts.collect())[-1] <= 3
    beats = [("j", T0 + dt.timedelta(minutes=m)) for m in (0, 2, 4, 30, 31, 900)]
    runs = drained(usage.beats(streamed(spark, beats, "job string, ts timestamp", tmp_path / "in2", 1)), tmp_path / "b", "beats")
    assert {r["n"] for r in runs.collect()} <= {3, 2, 1}


@pytest.mark.parametrize("limits", [[(600, 3), (86_400, 10)]])
def test_sliding_log(spark, limits):
    times = [T0 + dt.timedelta(seconds=s) for s in (0, 10, 20, 30, 615, 640)]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(times)], "id long, key string, ts timestamp")
    got = {r["id"]: r["allowed"] for r in usage.sliding_verdicts(df, limits).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True}


def test_once(spark, tmp_path):
    rows = [("j1", T0), ("j1", T0 + dt.timedelta(hours=1)), ("j2", T0)]
    out = drained(usage.once(streamed(spark, rows, "job string, ts timestamp", tmp_path / "in", 1)), tmp_path, "once")
    assert sorted(r["job"] for r in out.collect()) == ["j1", "j2"]


def test_pages_source(spark):
    from plotweave.sources.readers import PagedFeatures

    class Numbers(PagedFeatures):
        @staticmethod
        def fetch(first, size):
            return ((i, f"f{i}") for i in range(first, first + size))

    spark.dataSource.register(Numbers)
    df = spark.read.format("paged_features").option("rows", 25).option("page", 10).load()
    assert df.count() == 25 and df.rdd.getNumPartitions() == 3


def test_map_sources(spark, tmp_path):
    from plotweave.sources.readers import classified_elements, map_elements, map_xml

    (tmp_path / "m.json").write_text('{"elements":[{"type":"way","id":1,"tags":{"barrier":"fence"},"geometry":[{"lat":1,"lon":2}]},{"type":"way","id":1,"tags":{"barrier":"wall"}},{"type":"node","id":2,"tags":{"tunnel":"yes","natural":"water"}}]}')
    got = classified_elements(map_elements(spark, str(tmp_path / "m.json"))).select("id", "kind").collect()
    assert [tuple(r) for r in got] == [(1, "fence")]
    (tmp_path / "m.osm").write_text('<osm><node id="1" lat="1.0" lon="2.0"/><node id="2" lat="3.0" lon="4.0"/><way id="9"><nd ref="2"/><nd ref="1"/><tag k="building" v="yes"/></way></osm>')
    _, ways = map_xml(spark, str(tmp_path / "m.osm"))
    row = ways.first()
    assert (row["id"], [(p["lat"], p["lon"]) for p in row["geometry"]], row["tags"]["building"]) == (9, [(3.0, 4.0), (1.0, 2.0)], "yes")


def test_raster_and_writers(spark, tmp_path):
    from plotweave.functions import rings
    from plotweave.sources import readers, writers

    tile = spark.createDataFrame([(7, 2, 2, bytearray([0, 255, 16, 3]))], "gid long, width int, height int, values binary")
    assert {(r["ix"], r["iy"]): r["v"] for r in readers.raster_cells(tile).collect()} == {(0, 0): 0.0, (1, 0): 255.0, (0, 1): 16.0, (1, 1): 3.0}
    f = spark.range(2).select(F.lit("a").alias("collection"), writers.feature(rings.box_ring(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), id=F.col("id")).alias("feature"))
    writers.write_collections(f, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert len(writers.zipped({"a": b"x" * 5000}, 1000)) < 1000 < len(writers.zipped({"a": b"x" * 5000}))
