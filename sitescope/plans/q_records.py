"""Queries over records: normalisation, membership, viewports, labels, ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.operators import records as R
from sitescope.sources.tables import DESTINATIONS_SQL, SITES_SQL, destinations, load, sites

_CODES = {"0": "Helsinki", "1": "Espoo", "2": "Vantaa", "3": "Kauniainen"}
_VIEW = (4000.0, 5000.0, 12000.0, 9000.0)
_GROUPS = {"family": ["ECONOMY", "LARGE"], "health": ["PROMO", "SMALL"], "senior": ["ECONOMY", "SMALL"]}


def register_records(spark, sf):
    c = load(spark, sf, "customer")
    x = F.when(F.col("c_custkey") % 3 == 0, F.floor("c_acctbal").cast("double")).when(F.col("c_custkey") % 3 == 1, F.col("c_acctbal") + 0.25)
    return c.select(
        F.col("c_custkey").alias("building_id"), R.code((F.col("c_nationkey") % 6).cast("string"), _CODES).alias("municipality"),
        (F.col("c_mktsegment") == "FURNITURE").alias("residential"), R.integral(x).alias("year"), R.count_or_null(x).alias("storeys"),
    )


def plan_properties(spark, sf):
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 6 == 0, "NaN").when(k % 6 == 1, "  ").when(k % 6 == 2, F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))).when(k % 6 == 3, "<NA>").otherwise(F.col("o_orderstatus"))
    number = F.when(k % 4 == 0, "NaN").when(k % 4 == 1, "x1").when(k % 4 == 2, F.concat((k % 100).cast("string"), F.lit(".5")))
    return o.select("o_orderkey", R.clean_text(text).alias("name"), R.clean_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("approved"), R.clean_number(number).alias("area"))


def facts_long(spark, sf):
    c = load(spark, sf, "customer").where("c_nationkey < 12")
    k = F.col("c_custkey")
    facts = c.select(k.alias("building_id"), F.when(k % 4 > 0, k % 9).alias("storeys"), F.when(k % 5 > 1, F.col("c_mktsegment")).alias("heating"))
    return R.facts_to_values(facts, "building_id", ["storeys", "heating"])


def active_destinations(spark, sf):
    d = destinations(spark, sf)
    return d.where(F.col("grp").isin(1, 4, 7)).select("destination_id", "grp")


def viewport(spark, sf):
    s = sites(spark, sf)
    return s.where(R.in_view([F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")], _VIEW)).select("building_id")


def admitted_sources(spark, sf):
    s = load(spark, sf, "supplier")
    k = F.col("s_suppkey")
    fields = [F.when(k % 7 != 0, F.col("s_name")), F.when(k % 5 != 0, F.lit("x")).otherwise(" "), F.col("s_nationkey")]
    return s.select("s_suppkey", R.admitted(fields, F.when(k % 3 == 0, "excluded").when(k % 3 == 1, "active")).alias("admitted"))


def house_types(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("building_id"), F.col("c_nationkey").alias("municipality"))
    t = load(spark, sf, "supplier").select((F.col("s_suppkey") * 2).alias("building_id"), (F.col("s_suppkey") % 25).alias("municipality"), F.col("s_name").alias("house_type"))
    return c.join(t, ["building_id", "municipality"], "left").select("building_id", F.coalesce("house_type", F.lit("unknown")).alias("house_type"))


def geometry_attributes(spark, sf):
    s = sites(spark, sf).select("building_id", "x", "y")
    a = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("building_id")).agg(F.max("o_totalprice").alias("value"))
    return s.join(a, "building_id", "left")


def channel_services(spark, sf):
    o, li, p = load(spark, sf, "orders"), load(spark, sf, "lineitem"), load(spark, sf, "part")
    j = o.where("o_orderstatus = 'F'").join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_type").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_orders"))


def supplemented(spark, sf):
    d = destinations(spark, sf).select(F.lit("a").alias("provider"), F.col("destination_id").alias("id"), F.col("dx").cast("double").alias("x"), F.col("dy").cast("double").alias("y"))
    s = sites(spark, sf).select(F.lit("b").alias("provider"), F.col("building_id").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return R.supplement(d, s, "x", "y", 400.0)


def journey_maximum(spark, sf):
    li = load(spark, sf, "lineitem")
    state = F.when(F.col("l_quantity") % 5 == 0, "failed").otherwise("known")
    return R.journey_maximum(li.select("l_orderkey", state.alias("s"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity") * 60).alias("seconds")), "l_orderkey", "s", "seconds")


def nearest_rank(spark, sf):
    return R.nearest_rank(load(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", 0.95)


def graph_counts(spark, sf):
    k = load(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    e = k.select(F.col("k").alias("src"), (F.col("k") + 1).alias("dst")).unionByName(k.select(F.col("k").alias("src"), (F.col("k") + 20).alias("dst")))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return both.agg(F.countDistinct("src").alias("nodes"), F.count("*").alias("edges"))


def distinct_names(spark, sf):
    p = load(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name")))
    return p.select("p_brand", F.trim(name).alias("name")).where("name <> ''").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))


def departures_descending(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("place"))


def all_destinations(spark, sf):
    a = load(spark, sf, "supplier").select(F.lit("ptv").alias("provider"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).alias("kind"))
    b = load(spark, sf, "part").where("p_size > 40").select(F.lit("osm").alias("provider"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("kind"))
    return a.unionByName(b).groupBy("provider", "kind").agg(F.count("*").alias("n"))


def _tile():
    return [F.floor(F.col("x") / 500).alias("tx"), F.floor(F.col("y") / 500).alias("ty")]


def tile_set_difference(spark, sf):
    s = sites(spark, sf)
    return R.one_sided(s.where("building_id % 11 <> 3").select(*_tile()), s.where("building_id % 7 <> 2").select(*_tile()), ["tx", "ty"])


def first_missing_tile(spark, sf):
    s = sites(spark, sf)
    key = F.concat_ws("-", F.floor(F.col("x") / 500), F.floor(F.col("y") / 500)).alias("key")
    gone = s.select("municipality", key).distinct().join(s.where("building_id % 3 <> 1").select("municipality", key).distinct(), ["municipality", "key"], "left_anti")
    return gone.groupBy("municipality").agg(F.min("key").alias("first_missing"), F.count("*").alias("n_missing"))


def unresolved_sources(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", F.array(F.col("p_partkey") % 31, F.col("p_partkey") % 57).alias("source_ids"))
    return R.unresolved(p, "p_partkey", "source_ids", load(spark, sf, "supplier").where("s_suppkey % 5 <> 3"), "s_suppkey")


def bike_minutes(spark, sf):
    s = sites(spark, sf)
    return s.select("building_id", R.bike_minutes((F.col("x") + F.col("y")).cast("double"), 15.0).alias("minutes"))


def map_lookup(spark, sf):
    c = load(spark, sf, "customer")
    shares = F.map_from_arrays(F.array(F.lit("FURNITURE"), F.lit("BUILDING"), F.lit("MACHINERY")), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.125)))
    return c.select("c_custkey", F.coalesce(F.try_element_at(shares, F.col("c_mktsegment")), F.lit(0.0)).alias("share"))


def number_labels(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", R.finnish_number(F.floor(F.col("o_totalprice") * 10) / 10).alias("label"))


def service_groups(spark, sf):
    p = load(spark, sf, "part")
    found = R.service_groups(F.split("p_type", " "), _GROUPS)
    extra = F.when(F.col("p_size") > 25, F.array(F.lit("family"))).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", F.array_join(F.array_sort(F.array_union(found, extra)), ",").alias("groups"))


def destination_names(spark, sf):
    p = load(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", R.first_name(F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, " "), F.when(k % 4 == 0, F.col("p_brand")), fallback="Kauppa").alias("name"))


def default_ramps(spark, sf):
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    breaks = F.transform(F.sequence(F.lit(0), (k % 9).cast("int")), lambda i: (i * (k % 13 + 1)).cast("double") / 4)
    low, high = R.default_ramp(F.slice(breaks, 1, (k % 9).cast("int")), (k % 50).cast("double"), (k % 50 + k % 400).cast("double"))
    return c.select("c_custkey", low.cast("double").alias("low"), high.cast("double").alias("high"))


def axis_ticks(spark, sf):
    o = load(spark, sf, "orders")
    low, high = (F.col("o_orderkey") % 50).cast("double"), (F.col("o_orderkey") % 50 + F.col("o_custkey") % 300).cast("double")
    ticks = R.axis_ticks(low, high)
    return o.select("o_orderkey", R.tick_step(low, high).alias("step"), F.size(ticks).alias("n"), F.try_element_at(ticks, F.lit(1)).alias("first"), F.try_element_at(ticks, F.lit(-1)).alias("last"))


def overview_tier(spark, sf):
    c = load(spark, sf, "customer")
    return c.select("c_custkey", R.tier((F.col("c_custkey") % 70).cast("double") / 4, [("coarse", 5, 9), ("middle", 10, 11), ("fine", 12, 13)]).alias("tier"))


def batch_validity(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"))
    make = lambda v, w: F.create_map(F.lit("version"), v.cast("string"), F.lit("workers"), w.cast("string"))
    k = F.col("l_orderkey")
    return li.select("l_orderkey", R.batch_is_complete(F.col("n"), F.col("m"), make(k % 2, k % 3), make(k % 4 % 2 + F.when(k % 5 == 0, 1).otherwise(0), F.lit(9)), ["workers"]).alias("valid"))


_TYPES = {g: c for g, c in _GROUPS.items()}
_SERVICE = ", ".join(f"CASE WHEN list_has_any(string_split(p_type, ' '), {c!r}) THEN '{g}' END" for g, c in sorted(_TYPES.items()))
_CODE_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items())
_X = "CASE c_custkey % 3 WHEN 0 THEN floor(c_acctbal) WHEN 1 THEN c_acctbal + 0.25::DOUBLE END"
_CLEAN = "CASE WHEN trim({0}) NOT IN ('', 'None', 'NaN', 'nan', 'NaT', '<NA>') THEN trim({0}) END"
_STEP = "(CASE WHEN share >= 5 THEN 10 WHEN share >= 2 THEN 5 WHEN share >= 1 THEN 2 ELSE 1 END * magnitude)"
_NICE = "CASE WHEN abs({0}) >= 10 THEN floor({0} + 0.5::DOUBLE) ELSE floor({0} * 10 + 0.5::DOUBLE) / 10 END"

QUERIES = {f.__name__: f for f in (
    register_records, plan_properties, facts_long, active_destinations, viewport, admitted_sources, house_types, geometry_attributes, channel_services,
    supplemented, journey_maximum, nearest_rank, graph_counts, distinct_names, departures_descending, all_destinations, tile_set_difference,
    first_missing_tile, unresolved_sources, bike_minutes, map_lookup, number_labels, service_groups, destination_names, default_ramps, axis_ticks,
    overview_tier, batch_validity,
)}

SQL = {
    "register_records": f"SELECT c_custkey AS building_id, CASE CAST(c_nationkey % 6 AS VARCHAR) {_CODE_SQL} ELSE 'unknown' END AS municipality, c_mktsegment = 'FURNITURE' AS residential, CASE WHEN x = floor(x) THEN CAST(x AS BIGINT) END AS year, CASE WHEN x >= 0 AND x = floor(x) THEN CAST(x AS BIGINT) END AS storeys FROM (SELECT *, {_X} AS x FROM customer)",
    "plan_properties": f"SELECT o_orderkey, {_CLEAN.format('t')} AS name, strftime(o_orderdate, '%Y-%m-%d') AS approved, CASE WHEN o_orderkey % 4 = 2 THEN (o_orderkey % 100) + 0.5::DOUBLE END AS area FROM (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN '  ' WHEN 2 THEN ' ' || o_orderpriority || ' ' WHEN 3 THEN '<NA>' ELSE o_orderstatus END AS t FROM orders)",
    "facts_long": "SELECT building_id, layer_id, CASE WHEN value IS NULL THEN 'unknown' ELSE 'known' END AS state, value FROM (SELECT c_custkey AS building_id, 'storeys' AS layer_id, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 9 AS VARCHAR) END AS value FROM customer WHERE c_nationkey < 12 UNION ALL SELECT c_custkey, 'heating', CASE WHEN c_custkey % 5 > 1 THEN c_mktsegment END FROM customer WHERE c_nationkey < 12)",
    "active_destinations": f"WITH {DESTINATIONS_SQL} SELECT destination_id, grp FROM destinations WHERE grp IN (1, 4, 7)",
    "viewport": f"WITH {SITES_SQL} SELECT building_id FROM sites WHERE x <= 12000 AND x + w >= 4000 AND y <= 9000 AND y + h >= 5000",
    "admitted_sources": "SELECT s_suppkey, s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AS admitted FROM supplier",
    "house_types": "SELECT c_custkey AS building_id, coalesce(s_name, 'unknown') AS house_type FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 2 AND c_nationkey = s_suppkey % 25",
    "geometry_attributes": f"WITH {SITES_SQL} SELECT building_id, x, y, v AS value FROM sites LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = building_id",
    "channel_services": "SELECT p_type, count(*) AS n, count(DISTINCT o_orderkey) AS n_orders FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' GROUP BY 1",
    "supplemented": f"WITH {SITES_SQL}, {DESTINATIONS_SQL} SELECT 'a' AS provider, destination_id AS id, dx::DOUBLE AS x, dy::DOUBLE AS y FROM destinations UNION ALL SELECT 'b', building_id, x::DOUBLE, y::DOUBLE FROM sites WHERE NOT EXISTS (SELECT 1 FROM destinations WHERE (x - dx) * (x - dx) + (y - dy) * (y - dy) <= 160000)",
    "journey_maximum": "SELECT l_orderkey, CASE WHEN ok = 0 THEN 'unknown' WHEN ok = n THEN 'known' ELSE 'partial' END AS state, most / 60 AS minutes, ok / n::DOUBLE AS coverage FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity % 5 <> 0 AND l_linenumber < 6) AS ok, max(l_quantity * 60) FILTER (l_quantity % 5 <> 0 AND l_linenumber < 6) AS most FROM lineitem GROUP BY 1)",
    "nearest_rank": "SELECT o_orderpriority, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n FROM orders) WHERE k = ceil(n * 0.95::DOUBLE)",
    "graph_counts": "WITH e AS (SELECT p_partkey AS s, p_partkey + 1 AS d FROM part UNION ALL SELECT p_partkey, p_partkey + 20 FROM part), b AS (SELECT s, d FROM e UNION SELECT d, s FROM e) SELECT count(DISTINCT s) AS nodes, count(*) AS edges FROM b",
    "distinct_names": "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS names FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1",
    "departures_descending": "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)",
    "all_destinations": "SELECT provider, kind, count(*) AS n FROM (SELECT 'ptv' AS provider, s_suppkey % 4 AS kind FROM supplier UNION ALL SELECT 'osm', p_partkey % 4 FROM part WHERE p_size > 40) GROUP BY 1, 2",
    "tile_set_difference": f"WITH {SITES_SQL}, a AS (SELECT x // 500 AS tx, y // 500 AS ty FROM sites WHERE building_id % 11 <> 3), b AS (SELECT x // 500 AS tx, y // 500 AS ty FROM sites WHERE building_id % 7 <> 2) SELECT *, 'a' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "first_missing_tile": f"WITH {SITES_SQL} SELECT municipality, min(key) AS first_missing, count(*) AS n_missing FROM (SELECT municipality, (x // 500) || '-' || (y // 500) AS key FROM sites EXCEPT SELECT municipality, (x // 500) || '-' || (y // 500) FROM sites WHERE building_id % 3 <> 1) GROUP BY 1",
    "unresolved_sources": "SELECT p_partkey, reference FROM (SELECT p_partkey, unnest([p_partkey % 31, p_partkey % 57]) AS reference FROM part) WHERE reference NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 3)",
    "bike_minutes": f"WITH {SITES_SQL} SELECT building_id, (x + y) / (15 * 1000 / 60) AS minutes FROM sites",
    "map_lookup": "SELECT c_custkey, CASE c_mktsegment WHEN 'FURNITURE' THEN 0.5::DOUBLE WHEN 'BUILDING' THEN 0.25::DOUBLE WHEN 'MACHINERY' THEN 0.125::DOUBLE ELSE 0::DOUBLE END AS share FROM customer",
    "number_labels": "SELECT o_orderkey, translate(regexp_replace(format('{:,.1f}', floor(o_totalprice * 10) / 10), '\\.0$', ''), ',.', chr(160) || ',') AS label FROM orders",
    "service_groups": f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([{_SERVICE}, CASE WHEN p_size > 25 THEN 'family' END], lambda g: g IS NOT NULL))), ',') AS groups FROM part",
    "destination_names": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 4 = 0 THEN p_brand ELSE 'Kauppa' END AS name FROM part",
    "default_ramps": f"SELECT c_custkey, ({_NICE.format('a')})::DOUBLE AS low, ({_NICE.format('b')})::DOUBLE AS high FROM (SELECT c_custkey, CASE WHEN n >= 2 THEN greatest(1, floor(n / 4)) * w / 4 ELSE lo + (c_custkey % 400) * 0.25::DOUBLE END AS a, CASE WHEN n >= 2 THEN least(n - 1, floor(n * 0.75::DOUBLE)) * w / 4 ELSE lo + (c_custkey % 400) * 0.75::DOUBLE END AS b FROM (SELECT c_custkey, c_custkey % 9 AS n, (c_custkey % 13 + 1)::DOUBLE AS w, (c_custkey % 50)::DOUBLE AS lo FROM customer))",
    "axis_ticks": f"SELECT o_orderkey, step, CASE WHEN step IS NULL THEN 0 ELSE greatest(0, z - a + 1)::INT END AS n, CASE WHEN z >= a THEN round(a * step, 6) END AS first, CASE WHEN z >= a THEN round(z * step, 6) END AS last FROM (SELECT *, ceil(lo / step) AS a, floor((hi + step * 0.000001::DOUBLE) / step) AS z FROM (SELECT *, CASE WHEN hi > lo THEN {_STEP} END AS step FROM (SELECT *, rough / magnitude AS share FROM (SELECT *, pow(10::DOUBLE, floor(log10(rough))) AS magnitude FROM (SELECT o_orderkey, (o_orderkey % 50)::DOUBLE AS lo, (o_orderkey % 50 + o_custkey % 300)::DOUBLE AS hi, CASE WHEN o_custkey % 300 > 0 THEN (o_custkey % 300)::DOUBLE / 7 END AS rough FROM orders)))))",
    "overview_tier": "SELECT c_custkey, CASE WHEN z >= 5 AND z < 10 THEN 'coarse' WHEN z >= 10 AND z < 12 THEN 'middle' WHEN z >= 12 AND z < 14 THEN 'fine' END AS tier FROM (SELECT c_custkey, (c_custkey % 70) / 4.0::DOUBLE AS z FROM customer)",
    "batch_validity": "SELECT l_orderkey, count(*) = max(l_linenumber) AND l_orderkey % 2 = l_orderkey % 4 % 2 + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS valid FROM lineitem GROUP BY l_orderkey",
}
