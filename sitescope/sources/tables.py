"""Tables of a data directory, and the engine's views over them.

The views give the star-schema tables the roles of the engine's own inputs
(sites, zones, destinations, long layer values) by integer arithmetic alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as buildings: an id, a municipality and a footprint."""
    c = load(spark, sf_dir, "customer")
    n = load(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    out = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("building_id"), F.col("n_name").alias("municipality"), F.col("n_regionkey").alias("region"), "c_acctbal", "c_mktsegment",
        ((k * 7919) % 20000).alias("x"), ((k * 104729) % 20000).alias("y"), (k % 7 + 10).alias("w"), (k % 5 + 10).alias("h"),
    )
    return out.withColumns({"lon": F.lit(24.6) + F.col("x") / F.lit(55600.0), "lat": F.lit(60.1) + F.col("y") / F.lit(111200.0)})


SITES_SQL = """sites AS (SELECT c_custkey AS building_id, n_name AS municipality, n_regionkey AS region, c_acctbal, c_mktsegment,
  (c_custkey * 7919) % 20000 AS x, (c_custkey * 104729) % 20000 AS y, c_custkey % 7 + 10 AS w, c_custkey % 5 + 10 AS h,
  24.6::DOUBLE + ((c_custkey * 7919) % 20000) / 55600.0::DOUBLE AS lon, 60.1::DOUBLE + ((c_custkey * 104729) % 20000) / 111200.0::DOUBLE AS lat
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as square zones with a value and a category."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("zone_id"), ((k * 15485863) % 20000).alias("zx"), ((k * 32452843) % 20000).alias("zy"),
        (F.col("p_size").cast("long") + 200).alias("side"), (F.col("p_size").cast("long") % 7 * 5 + 45).alias("value"), F.col("p_type").alias("category"),
    )


ZONES_SQL = """zones AS (SELECT p_partkey AS zone_id, (p_partkey * 15485863) % 20000 AS zx, (p_partkey * 32452843) % 20000 AS zy,
  CAST(p_size AS BIGINT) + 200 AS side, CAST(p_size AS BIGINT) % 7 * 5 + 45 AS value, p_type AS category FROM part)"""


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as destination points in ten groups."""
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    out = s.select(k.alias("destination_id"), (k % 10).alias("grp"), ((k * 6151) % 20000).alias("dx"), ((k * 99991) % 20000).alias("dy"))
    return out.withColumns({"dlon": F.lit(24.6) + F.col("dx") / F.lit(55600.0), "dlat": F.lit(60.1) + F.col("dy") / F.lit(111200.0)})


DESTINATIONS_SQL = """destinations AS (SELECT s_suppkey AS destination_id, s_suppkey % 10 AS grp, (s_suppkey * 6151) % 20000 AS dx, (s_suppkey * 99991) % 20000 AS dy,
  24.6::DOUBLE + ((s_suppkey * 6151) % 20000) / 55600.0::DOUBLE AS dlon, 60.1::DOUBLE + ((s_suppkey * 99991) % 20000) / 111200.0::DOUBLE AS dlat FROM supplier)"""


def layer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long layer values: building_id, layer_id, state, nums, cats, coverage.

    balance: one number, negative is a sentinel; segment: one category;
    order_totals: all totals of a customer's orders, partial when an order is
    pending; latest_year: year of the latest order; priority: the categories
    of its orders.
    """
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    no_n, no_c = F.array().cast("array<double>"), F.array().cast("array<string>")
    known = F.lit("known")
    balance = c.select(
        F.col("c_custkey").alias("building_id"), F.lit("balance").alias("layer_id"), F.when(F.col("c_acctbal") < 0, "unknown").otherwise("known").alias("state"),
        F.when(F.col("c_acctbal") < 0, no_n).otherwise(F.array("c_acctbal")).alias("nums"), no_c.alias("cats"),
    )
    segment = c.select(F.col("c_custkey").alias("building_id"), F.lit("segment").alias("layer_id"), known.alias("state"), no_n.alias("nums"), F.array("c_mktsegment").alias("cats"))
    per = o.groupBy(F.col("o_custkey").alias("building_id")).agg(
        F.sort_array(F.collect_list("o_totalprice")).alias("totals"), F.max(F.year("o_orderdate")).cast("double").alias("latest"),
        F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"), F.max(F.col("o_orderstatus") == "P").alias("pending"),
    )
    orders = per.select(
        "building_id",
        F.explode(F.array(
            F.struct(F.lit("order_totals").alias("layer_id"), F.when(F.col("pending"), "partial").otherwise("known").alias("state"), F.col("totals").alias("nums"), no_c.alias("cats")),
            F.struct(F.lit("latest_year").alias("layer_id"), known.alias("state"), F.array("latest").alias("nums"), no_c.alias("cats")),
            F.struct(F.lit("priority").alias("layer_id"), known.alias("state"), no_n.alias("nums"), F.col("priorities").alias("cats")),
        )).alias("v"),
    ).select("building_id", "v.*")
    return balance.unionByName(segment).unionByName(orders)


LAYERS_SQL = """orders_of AS (SELECT o_custkey AS building_id, list_sort(list(o_totalprice)) AS totals, CAST(max(year(o_orderdate)) AS DOUBLE) AS latest,
  list_sort(list(DISTINCT o_orderpriority)) AS priorities, bool_or(o_orderstatus = 'P') AS pending FROM orders GROUP BY o_custkey),
layer_values AS (
  SELECT c_custkey AS building_id, 'balance' AS layer_id, CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE 'known' END AS state,
    CASE WHEN c_acctbal < 0 THEN CAST([] AS DOUBLE[]) ELSE [c_acctbal] END AS nums, CAST([] AS VARCHAR[]) AS cats FROM customer
  UNION ALL SELECT c_custkey, 'segment', 'known', CAST([] AS DOUBLE[]), [c_mktsegment] FROM customer
  UNION ALL SELECT building_id, 'order_totals', CASE WHEN pending THEN 'partial' ELSE 'known' END, totals, CAST([] AS VARCHAR[]) FROM orders_of
  UNION ALL SELECT building_id, 'latest_year', 'known', [latest], CAST([] AS VARCHAR[]) FROM orders_of
  UNION ALL SELECT building_id, 'priority', 'known', CAST([] AS DOUBLE[]), priorities FROM orders_of)"""
