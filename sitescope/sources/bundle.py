"""The static bundle: tiles of geometries and layer values, as partitioned
JSON, with the index of tiles that each layer has.

Files are written by the executors, one folder for each tile of a layer;
a layer that is written again replaces its own tiles alone.  Readers give
DataFrames, so that a view reads the folders it names and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTS = ("layer_id", "tx", "ty")


def _write(rows: DataFrame, path: str, parts: tuple[str, ...], order: str) -> None:
    # rows of a tile come from one task, so that a tile is one file
    ordered = rows.repartition(*parts).sortWithinPartitions(*parts, order)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy(*parts).json(path)


def write_layers(values: DataFrame, tiles: DataFrame, path: str) -> None:
    """Known and partial ``values`` (building_id, layer_id, state, value) in
    the tiles (building_id, tx, ty) of their buildings.  Tiles of the layers
    at hand that have no value any more are emptied."""
    shown = values.where(F.col("state").isin("known", "partial")).join(tiles, "building_id")
    spark = values.sparkSession
    gone = None
    if exists(spark, path):
        old = spark.read.schema("building_id string").option("basePath", path).json(path).select("layer_id", "tx", "ty").distinct()
        old = old.join(values.select("layer_id").distinct(), "layer_id", "left_semi")
        gone = old.join(shown.select("layer_id", F.col("tx").cast("int"), F.col("ty").cast("int")).distinct(), list(_PARTS), "left_anti").collect()
    _write(shown.select("building_id", "state", "value", *_PARTS), path, _PARTS, "building_id")
    for r in gone or []:
        _delete(spark, f"{path}/layer_id={r['layer_id']}/tx={r['tx']}/ty={r['ty']}")


def write_geometries(buildings: DataFrame, tiles: DataFrame, path: str) -> None:
    """``buildings`` with a building_id in every tile they touch."""
    _write(buildings.join(tiles, "building_id"), path, ("tx", "ty"), "building_id")


def read_layer(spark: SparkSession, path: str, layer_id: str, schema: str = "building_id long, state string, value double") -> DataFrame:
    """All tiles of a layer; the other layers' folders are not read."""
    return spark.read.schema(schema + ", layer_id string, tx int, ty int").json(path).where(F.col("layer_id") == layer_id)


def availability(spark: SparkSession, path: str) -> DataFrame:
    """(layer_id, tiles): the sorted keys x/y of the tiles that a layer has."""
    rows = spark.read.schema("building_id string, layer_id string, tx int, ty int").json(path)
    return rows.groupBy("layer_id").agg(F.sort_array(F.collect_set(F.concat_ws("/", "tx", "ty"))).alias("tiles"))


def misplaced(geometries: DataFrame, layers: DataFrame) -> DataFrame:
    """(building_id, tx, ty, layer_id) of values in a tile where their building isn't."""
    return layers.join(geometries.select("building_id", "tx", "ty"), ["building_id", "tx", "ty"], "left_anti").select("building_id", "tx", "ty", "layer_id")


def asset_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, largest) of a bundle; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.max("length"), F.lit(0)).alias("largest"))


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)
