"""Readers of feature collections, timetable archives, ownership files and samples.

All of them are DataFrame sources: paths may be globs or folders of any store
that Spark reads, and files are read on the executors.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a record batch that a reader makes.
BATCH_ROWS = 10_000
#: Columns of the timetable files that the engine needs (fixed names).
GTFS: Mapping[str, Sequence[str]] = {
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "trips": ("route_id", "service_id", "trip_id"),
    "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
}
#: Classes of the ownership file (fixed values).
OWNERS = {"kaupunki": "city", "muu omistaja": "non_city"}

_FEATURES = (
    "crs struct<properties: struct<name: string>>, "
    "features array<struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
)


def geojson(spark: SparkSession, path: str, crs: str | None = None) -> DataFrame:
    """Features as (file, feature_id, properties, kind, polygons, point).

    ``polygons`` has the rings of each polygon, of a Polygon too; ``point``
    is a Point's position.  ``crs``: the code, such as ``EPSG:3879``, that a
    file's reference system must name; a file that names none passes.
    """
    files = spark.read.schema(_FEATURES).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), "crs", "features")
    if crs:
        name = F.upper(F.regexp_replace("crs.properties.name", r"^urn:ogc:def:crs:([A-Za-z]+):[^:]*:", "$1:"))
        wrong = F.raise_error(F.concat(F.lit("reference system "), name, F.lit(f" instead of {crs} in "), F.col("file")))
        files = files.withColumn("features", F.when(F.coalesce(name, F.lit(crs.upper())) == crs.upper(), F.col("features")).otherwise(wrong))
    f = files.select("file", F.explode("features").alias("f")).select("file", "f.*")
    kind, at = F.col("geometry.type"), F.col("geometry.coordinates")
    ring = "array<array<array<double>>>"
    polygons = F.when(kind == "Polygon", F.array(F.from_json(at, ring))).when(kind == "MultiPolygon", F.from_json(at, f"array<{ring}>"))
    return f.select(
        "file", F.col("id").alias("feature_id"), "properties", kind.alias("kind"), polygons.alias("polygons"),
        F.when(kind == "Point", F.from_json(at, "array<double>")).alias("point"),
    )


def gtfs(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of timetable archives, all columns as text; an archive without
    the file, which is allowed for calendars, gives no rows."""
    names = GTFS[table]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        def batch(rows: list[list[str | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=list(names))

        for b in batches:
            for content in b.column(0):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    if f"{table}.txt" not in z.namelist():
                        continue
                    rows: list[list[str | None]] = []
                    for r in csv.DictReader(io.TextIOWrapper(z.open(f"{table}.txt"), "utf-8-sig", newline="")):
                        rows.append([r.get(n) for n in names])
                        if len(rows) == BATCH_ROWS:
                            yield batch(rows)
                            rows = []
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} string" for n in names))


def ownership(spark: SparkSession, path: str) -> DataFrame:
    """(building_id, owner, confidence) of an ownership file.  Another header,
    an empty id, another class and an id with two classes are errors."""
    rows = spark.read.schema("building_id string, luokka string").csv(path, header=True, enforceSchema=False)
    id_, cls = F.coalesce(F.trim("building_id"), F.lit("")), F.coalesce(F.trim("luokka"), F.lit(""))
    owner = F.coalesce(*[F.when(cls == k, v) for k, v in OWNERS.items()], F.raise_error(F.concat(F.lit("unsupported class: "), cls)))
    rows = rows.select(F.when(id_ != "", id_).otherwise(F.raise_error(F.lit("empty building_id"))).alias("building_id"), owner.alias("owner"))
    g = rows.groupBy("building_id").agg(F.min("owner").alias("owner"), F.max("owner").alias("most"))
    one = F.when(F.col("owner") == F.col("most"), F.col("owner")).otherwise(F.raise_error(F.concat(F.lit("conflicting class: "), F.col("building_id"))))
    return g.select("building_id", one.alias("owner")).withColumn("confidence", F.when(F.col("owner") == "city", "high").otherwise("low"))


#: Columns of stored journey samples.
SAMPLES = (
    "building_id string, departure_time string, state string, duration_seconds double, transfers int, walk_seconds double, "
    "transport_modes array<string>, boardings int, first_boarding_walk_m double, itinerary_start_time_ms long, itinerary_end_time_ms long"
)


def journey_samples(spark: SparkSession, path: str, buildings: DataFrame | None = None) -> DataFrame:
    """Stored journey samples, of known buildings only if these are given."""
    rows = spark.read.schema(SAMPLES).parquet(path)
    return rows if buildings is None else rows.join(buildings.select("building_id"), "building_id", "left_semi")


def parquet_footers(spark: SparkSession, path: str, key: str = "transit_parameters") -> DataFrame:
    """(file, n_rows, parameters) of each Parquet file, from its footer;
    parameters is the JSON text kept there under ``key``, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            meta = [pq.read_metadata(pa.BufferReader(c.as_buffer())) for c in b.column(1)]
            said = [(m.metadata or {}).get(key.encode()) for m in meta]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([m.num_rows for m in meta], pa.int64()), pa.array([s and s.decode() for s in said], pa.string())], names=["file", "n_rows", "parameters"]
            )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, n_rows long, parameters string")
