"""Readers: box scans of Parquet footprints, quadkey JSON, street-map XML and JSON, point clouds, raster cells, paged features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plotweave.functions.geo import box_overlaps, quadkeys_of_box
from plotweave.functions.heights import measured_or_floors

FOOTPRINT = "height double, num_floors int, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, geometry binary, is_underground boolean, roof_shape string, roof_direction double, roof_height double"
ELEMENTS = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,members:array<struct<type:string,ref:bigint,role:string>>>>"


def footprints(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Footprints that touch a box: eight columns, and the box test on nested leaves reaches the row groups' statistics."""
    d = spark.read.schema(FOOTPRINT).parquet(path).where(box_overlaps("bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax", box))
    return d.where(~F.coalesce("is_underground", F.lit(False)) & F.col("geometry").isNotNull()).withColumn("height", measured_or_floors("height", "num_floors"))


def quadkey_features(spark: SparkSession, path: str, box: tuple[float, float, float, float], schema: str, zoom: int = 9) -> DataFrame:
    """JSON lines partitioned by quadkey: only the partitions that the box touches are read."""
    return spark.read.schema(f"{schema}, quadkey string").json(path).where(F.col("quadkey").isin(quadkeys_of_box(*box, zoom)))


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Street-map JSON to one row per element, the first of each (type, id); rows without an id all stay."""
    e = spark.read.schema(ELEMENTS).option("multiLine", True).json(path).select(F.posexplode("elements").alias("pos", "e")).select("pos", "e.*")
    named = e.where("id is not null").groupBy("type", "id").agg(F.min_by(F.struct("pos", "tags", "geometry", "members"), "pos").alias("r")).select("type", "id", "r.*")
    return named.unionByName(e.where("id is null").select(*named.columns))


def map_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Street-map XML to (nodes, ways): ways come with their nodes' places in order, by one join."""
    node = "_id bigint, _lat double, _lon double, tag array<struct<_k:string,_v:string>>"
    way = "_id bigint, nd array<struct<_ref:bigint>>, tag array<struct<_k:string,_v:string>>"
    tags = F.map_from_arrays(F.transform(F.coalesce("tag", F.array()), lambda t: t["_k"]), F.transform(F.coalesce("tag", F.array()), lambda t: t["_v"]))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(node).load(path).select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags.alias("tags"))
    ways = spark.read.format("xml").option("rowTag", "way").schema(way).load(path).select(F.col("_id").alias("id"), "nd", tags.alias("tags"))
    refs = ways.select("id", F.posexplode("nd").alias("pos", "nd")).select("id", "pos", F.col("nd._ref").alias("ref"))
    placed = refs.join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))).alias("g"))
    line = F.transform("g", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return nodes, ways.join(placed, "id").select("id", "tags", line.alias("geometry"))


def classified_elements(elements: DataFrame) -> DataFrame:
    """Elements with a kind from their tags; the first rule that fits counts, others drop out."""
    t = lambda k: F.element_at("tags", F.lit(k))
    kind = (
        F.when((t("natural") == "water") | t("waterway").isNotNull(), "water").when(t("amenity") == "parking", "parking").when(t("barrier").isin("wall", "retaining_wall"), "wall")
        .when(t("barrier") == "fence", "fence").when(t("barrier") == "hedge", "hedge").when(t("power").isin("pole", "tower") | (t("highway") == "street_lamp"), "pole")
        .when(t("bridge").isNotNull() & t("highway").isNotNull(), "bridge").when(t("railway").isin("monorail", "light_rail") & (F.coalesce(t("bridge"), F.lit("no")) != "no"), "rail")
        .when(t("tourism").isin("caravan_site", "camp_site"), "camp").when(t("building").isNotNull(), "building")
    )
    buried = (F.coalesce(t("layer").try_cast("int"), F.lit(0)) < 0) | (F.coalesce(t("tunnel"), F.lit("no")) != "no")
    return elements.withColumn("kind", kind).where(F.col("kind").isNotNull() & ~buried)


def raster_cells(tiles: DataFrame) -> DataFrame:
    """Raster tiles (gid, width, height, values binary, one byte a cell, row 0 north) to cells (gid, ix, iy, v), in the JVM."""
    n = F.col("width") * F.col("height")
    byte = lambda i: F.conv(F.hex(F.substring(F.col("values"), i + 1, 1)), 16, 10).cast("double")
    e = tiles.withColumn("i", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return e.select("gid", (F.col("i") % F.col("width")).cast("long").alias("ix"), F.floor(F.col("i") / F.col("width")).cast("long").alias("iy"), byte(F.col("i")).alias("v"))


class Page(InputPartition):
    def __init__(self, first: int, size: int):
        self.first, self.size = first, size


class PagedFeatures(DataSource):
    """A batch source over an offset-paged service: one partition a page, so a failed page is retried alone.

    Subclasses give `fetch`; options: rows (all rows to read), page (rows a page).
    """

    fetch: Callable[[int, int], Iterator[tuple]]

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "id long, body string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options, type(self).fetch)


class PageReader(DataSourceReader):
    def __init__(self, options: dict, fetch):
        self.rows, self.page, self.fetch = int(options.get("rows", 2000)), int(options.get("page", 500)), fetch

    def partitions(self) -> list[Page]:
        return [Page(a, min(self.page, self.rows - a)) for a in range(0, self.rows, self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.fetch(partition.first, partition.size)


def dem_samples(bodies: DataFrame, body: str) -> DataFrame:
    """(the other columns, i, lon, lat, z): samples of an elevation service's JSON body; those without finite numbers, or with
    heights outside -500..9000 m, drop out. A body that is no such JSON gives none."""
    schema = "struct<samples: array<struct<location: struct<x: double, y: double>, value: string>>>"
    rest = [c for c in bodies.columns if c != body]
    rows = bodies.select(*rest, F.posexplode(F.from_json(body, schema)["samples"]).alias("i", "s"))
    z = F.col("s.value").try_cast("double")
    out = rows.select(*rest, "i", F.col("s.location.x").alias("lon"), F.col("s.location.y").alias("lat"), z.alias("z"))
    return out.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat) and z between -500 and 9000")


def geometry_rings(geometry: Column) -> Column:
    """The outer rings of a GeoJSON geometry in text."""
    from plotweave.functions.rings import exterior_rings

    kind = F.get_json_object(geometry, "$.type")
    part = "array<array<array<double>>>"
    raw = F.get_json_object(geometry, "$.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(raw, part))).when(kind == "MultiPolygon", F.from_json(raw, f"array<{part}>"))
    return exterior_rings(kind, polygons)
