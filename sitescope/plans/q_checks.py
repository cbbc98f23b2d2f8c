"""Queries over release checks, geometries, distributions and timetables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.functions import text, ways
from sitescope.operators import checks, geometry, graph, spatial, stats, transit
from sitescope.plans.q_values import _HIST
from sitescope.sources.tables import LAYERS_SQL, SITES_SQL, layer_values, load, sites

_COMPOSITES = {"selected_grocery": ("lidl_walk_m", "prisma_walk_m"), "health": ("clinic_walk_m", "lidl_walk_m")}


# ---------------------------------------------------------------- checks
def _release(spark, sf):
    o, c, s = load(spark, sf, "orders"), load(spark, sf, "customer"), load(spark, sf, "supplier")
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "known").when(F.col("o_orderstatus") == "P", "partial").otherwise("unknown")
    cited = F.when(k % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k, k - k % 50))
    return (
        s.where("s_suppkey % 9 <> 4").select(F.col("s_suppkey").alias("source_id")),
        o.where("o_orderkey % 13 <> 5").select(k.alias("evidence_id"), (F.col("o_custkey") % 10 + 1).alias("source_id")),
        c.where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("building_id"), (F.col("c_nationkey") % 11).cast("long").alias("source_id")),
        o.select(k.alias("value_id"), F.col("o_custkey").alias("building_id"), state.alias("state"), cited.alias("evidence_ids")),
    )


def release_references(spark, sf):
    return checks.release_faults(*_release(spark, sf))


def attribute_integrity(spark, sf):
    c, o, n = load(spark, sf, "customer"), load(spark, sf, "orders"), load(spark, sf, "nation")
    k = F.col("c_custkey")
    buildings = c.where(k % 10 != 3).select(k.alias("building_id")).unionByName(c.where(k % 17 == 1).select(k.alias("building_id")))
    values = o.select(
        F.col("o_orderkey").alias("value_id"), F.col("o_custkey").alias("building_id"), (F.col("o_orderkey") % 30).alias("layer_id"),
        F.when(F.col("o_orderstatus") == "F", "known").when(F.col("o_orderstatus") == "O", "unknown").when(F.col("o_orderkey") % 3 == 0, "stale").alias("state"),
    )
    return checks.attribute_faults(buildings, n.select(F.col("n_nationkey").alias("layer_id")), values)


def distribution_faults(spark, sf):
    p, li = load(spark, sf, "part"), load(spark, sf, "lineitem")
    k = F.col("l_partkey")
    d = li.groupBy("l_partkey").agg(
        F.array(F.count(F.when(F.col("l_linenumber") < 3, 1)) - F.when(F.first("l_partkey") % 5 == 0, 4).otherwise(0), F.count(F.when(F.col("l_linenumber") >= 3, 1))).alias("counts"),
        (F.count("*") - F.when(F.first("l_partkey") % 7 == 0, 2).otherwise(0)).alias("known_count"), F.min("l_quantity").alias("min"),
        (F.max("l_quantity") - F.when(F.first("l_partkey") % 3 == 0, 40).otherwise(0)).alias("max"),
    ).withColumn("counts", F.when(k % 19 == 4, F.array().cast("array<bigint>")).otherwise(F.col("counts"))).where(k % 11 != 6)
    d = d.unionByName(d.where(k % 23 == 1)).withColumnRenamed("l_partkey", "layer_id")
    layers = p.select(F.col("p_partkey").alias("layer_id"), F.when(F.col("p_size") % 4 == 0, "categorical").otherwise("numeric").alias("kind"))
    return checks.distribution_faults(layers, d)


def _audit_rows(spark, sf):
    return layer_values(spark, sf).join(sites(spark, sf).select("building_id", "municipality"), "building_id").select("building_id", "municipality", "layer_id", "state")


def audit_reconcile(spark, sf):
    """An audit that was stored before some values became unknown, against the recount."""
    rows = _audit_rows(spark, sf)
    now = rows.withColumn("state", F.when((F.col("building_id") % 50 == 7) & (F.col("layer_id") == "segment"), "unknown").otherwise(F.col("state")))
    return checks.audit_faults(stats.audit(rows.drop("building_id")), now.drop("building_id"))


def audit_buildings(spark, sf):
    return _audit_rows(spark, sf).groupBy("municipality").agg(F.countDistinct("building_id").alias("n_buildings"), F.count(F.when(F.col("state") != "unknown", 1)).alias("n_evidence"))


def layer_registry(spark, sf):
    p = load(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    categories = F.when(k % 5 == 0, F.when(k % 15 == 0, F.array(F.col("p_brand"), F.lit("unknown"))).otherwise(F.array("p_brand"))).otherwise(F.array().cast("array<string>"))
    span = F.when(k % 4 != 0, F.array(size, size + k % 3 - 1))
    faults = checks.layer_faults(F.when(k % 2 == 0, "numeric").otherwise("categorical"), categories, span)
    return p.select("p_partkey", F.array_join(faults, ",").alias("faults"))


def public_fields(spark, sf):
    k = F.col("c_custkey")
    fields = F.array_compact(F.array(F.lit("value"), F.when(k % 3 == 0, "tenant_name"), F.when(k % 4 == 0, "owner_name"), F.when(k % 5 == 0, "leaseholder_name")))
    return load(spark, sf, "customer").select("c_custkey", checks.forbidden_field(fields).alias("forbidden"))


def active_layer_ids(spark, sf):
    p = load(spark, sf, "part")
    k = F.col("p_partkey")
    shown = F.when(k % 5 == 0, "overall").when(k % 5 == 1, "selected_grocery").when(k % 5 == 2, "none").otherwise(F.col("p_brand"))
    criteria = F.when(k % 3 == 0, F.array(F.lit("health"), F.col("p_brand"))).when(k % 3 == 1, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", F.array_join(checks.active_layers(shown, criteria, _COMPOSITES), ",").alias("layers"))


# ---------------------------------------------------------------- geometry
def geometry_bounds(spark, sf):
    li = load(spark, sf, "lineitem")
    point = F.when(F.col("l_quantity") < 10, F.array(F.col("l_partkey") % 997, F.col("l_suppkey") * 3 % 101))
    g = li.groupBy("l_orderkey").agg(F.collect_list(point).alias("points"))
    return g.select("l_orderkey", geometry.bounds(F.col("points")).alias("b")).select("l_orderkey", "b.*")


def bearings(spark, sf):
    s = sites(spark, sf).select("building_id", "lon", "lat")
    nxt = [s.select((F.col("building_id") - i).alias("building_id"), F.col("lon").alias(f"lon{i}"), F.col("lat").alias(f"lat{i}")) for i in (1, 2)]
    j = s.join(nxt[0], "building_id").join(nxt[1], "building_id")
    b1 = geometry.bearing(F.col("lon"), F.col("lat"), F.col("lon1"), F.col("lat1"))
    b2 = geometry.bearing(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    return j.select("building_id", F.round(b1, 4).alias("bearing"), F.round(graph.heading_change(b1, b2), 4).alias("change"))


def edge_attributes(spark, sf):
    p, li = load(spark, sf, "part"), load(spark, sf, "lineitem")
    k = F.col("p_partkey")
    known = p.where(k % 6 != 5).select(F.when(k % 2 == 0, k).otherwise(k + 1).alias("src"), F.when(k % 2 == 0, k + 1).otherwise(k).alias("dst"), F.col("p_size").alias("length"))
    steps = li.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") + F.when(F.col("l_quantity") % 2 == 0, 1).otherwise(-1)).alias("b"))
    return geometry.edge_attributes(steps, "l_partkey", "b", known)


def geojson_features(spark, sf):
    s = sites(spark, sf)
    x, y, w, h = (F.col(c) for c in "xywh")
    ring = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h), F.array(x, y))
    text = geometry.feature(ring, building_id=F.col("building_id"), municipality=F.col("municipality"))
    return s.select("building_id", text.alias("feature")).select("building_id", "feature", F.get(F.get(geometry.feature_ring(F.col("feature")), F.lit(2)), F.lit(1)).alias("top"))


def point_inspection(spark, sf):
    """What lies under a click: the building with all its values, or open ground."""
    s = sites(spark, sf).withColumns({"x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")})
    k = F.col("building_id")
    clicks = s.select(k.alias("click"), (F.col("x") + k % 20).alias("px"), (F.col("y") + k % 17).alias("py"))
    hit = spatial.box_join(clicks, s.select("building_id", "x", "y", "x2", "y2"), ("px", "py", "px", "py"), ("x", "y", "x2", "y2"), 500.0)
    top = hit.groupBy("click").agg(F.min("building_id").alias("building_id"))
    v = layer_values(spark, sf).select("building_id", F.concat_ws("=", "layer_id", "state").alias("v"))
    values = top.join(v, "building_id").groupBy("click", "building_id").agg(F.array_join(F.array_sort(F.collect_list("v")), ";").alias("shown"))
    return clicks.select("click").join(values, "click", "left").withColumn("shown", F.coalesce("shown", F.lit("no_score")))


def cell_layers(spark, sf):
    """Cells of all sites with the values of two layers, where they have any."""
    cell = [F.floor(F.col(c) / 2000).cast("long").alias(f"c{c}") for c in "xy"]
    s = sites(spark, sf).select("building_id", *cell)
    v = layer_values(spark, sf).where("state <> 'unknown'").select("building_id", "layer_id", stats.number(F.col("state"), F.col("nums")).alias("v"))
    out = s.select("cx", "cy").distinct()
    for layer in ("balance", "latest_year"):
        rows = v.where(F.col("layer_id") == layer).join(s, "building_id")
        out = out.join(stats.overview_numeric(rows, "v", ["cx", "cy"]).select("cx", "cy", F.round("median", 4).alias(layer)), ["cx", "cy"], "left")
    return out


# ---------------------------------------------------------------- distributions
def layer_distributions(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("layer_id"), F.col("o_totalprice").alias("v"))
    c = o.select("layer_id").distinct().withColumn("breaks", F.array(F.lit(1.0), F.lit(2.0)))
    more = spark.createDataFrame([("no_values", [0.5, 3.0, 10.0]), ("one_break", [1.0])], "layer_id string, breaks array<double>")
    d = stats.distributions(o, "v", c.unionByName(more))
    return d.select("layer_id", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"), "known_count", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def fallback_breaks(spark, sf):
    o = load(spark, sf, "orders")
    b = stats.layer_breaks(o, "o_totalprice", ["o_custkey"], 0.0, 1000.0)
    return b.select("o_custkey", F.posexplode("breaks").alias("i", "brk")).withColumn("brk", F.round("brk", 4))


def discrete_breaks(spark, sf):
    b = stats.layer_breaks(load(spark, sf, "lineitem"), "l_linenumber", ["l_partkey"], 0.0, 10.0, discrete=True)
    return b.select("l_partkey", F.posexplode("breaks").alias("i", "brk")).withColumn("brk", F.round("brk", 4))


def overview_mixed(spark, sf):
    cell = [F.floor(F.col(c) / 4000).cast("long").alias(f"c{c}") for c in "xy"]
    v = layer_values(spark, sf).where("layer_id = 'priority'").join(sites(spark, sf).select("building_id", *cell), "building_id").withColumn("c", stats.one_category(F.col("cats")))
    return stats.overview_categorical(v, "c", ["cx", "cy"]).select("cx", "cy", "mode", F.round("mode_share", 6).alias("mode_share"))


def composite_all(spark, sf):
    li, o, c = load(spark, sf, "lineitem"), load(spark, sf, "orders").select("o_orderkey", "o_custkey"), load(spark, sf, "customer")
    g = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("building_id"), (F.col("l_suppkey") % 10).cast("string").alias("grp")).agg(F.min("l_quantity").alias("m"))
    g = g.select("building_id", "grp", F.when(F.col("m") > 12, "unknown").otherwise("known").alias("state"), F.when(F.col("m") <= 12, F.col("m")).alias("value"))
    out = stats.composite_complete(c.select(F.col("c_custkey").alias("building_id")), stats.composite_minimum(g, ["4", "2"]))
    return out.select("building_id", "state", "value", F.round("coverage", 6).alias("coverage"))


def main_component(spark, sf):
    k = load(spark, sf, "part").select(F.col("p_partkey").alias("src"))
    long, short = k.where("src % 25 = 3"), k.where("src % 25 <> 3")
    edges = long.select("src", (F.col("src") + 25).alias("dst")).unionByName(short.select("src", (F.col("src") - F.col("src") % 25 + 200_000_000).alias("dst")))
    return graph.main_component(edges.withColumn("w", F.lit(1.0)))


# ---------------------------------------------------------------- timetables
def _timetable(spark, sf):
    s, o, li = load(spark, sf, "supplier"), load(spark, sf, "orders"), load(spark, sf, "lineitem")
    k = F.col("s_suppkey")
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    calendar = s.select(
        k.cast("string").alias("service_id"), *[(k % (i + 2) != 0).cast("int").cast("string").alias(d) for i, d in enumerate(days)],
        F.lit("20260105").alias("start_date"), F.when(k % 4 == 1, "20260301").otherwise("20261231").alias("end_date"),
    )
    exceptions = s.where("s_suppkey % 3 = 0").select(k.cast("string").alias("service_id"), F.when(k % 2 == 0, "20260603").otherwise("20260604").alias("date"), F.when(k % 4 < 2, "1").otherwise("2").alias("exception_type"))
    trips = o.select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 12 + 1).cast("string").alias("service_id"))
    t = F.col("l_linenumber") * 11
    hms = lambda m: F.format_string("%02d:%02d:30", F.floor((m + 1380) / 60), (m + 1380) % 60)
    stops = li.groupBy(F.col("l_orderkey").alias("trip_id"), "l_linenumber").agg(F.min("l_partkey").cast("string").alias("stop_id"))
    stops = stops.select("trip_id", "stop_id", F.col("l_linenumber").cast("string").alias("stop_sequence"), hms(t).alias("arrival_time"), hms(t + 2).alias("departure_time"))
    return calendar, exceptions, trips, stops


def running_services(spark, sf):
    calendar, exceptions, _, _ = _timetable(spark, sf)
    return transit.active_services(calendar, exceptions, "20260603")


def running_connections(spark, sf):
    calendar, exceptions, trips, stops = _timetable(spark, sf)
    return transit.connections(stops, trips, transit.active_services(calendar, exceptions, "20260603"))


def wall_times(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", transit.epoch_ms(F.to_date("o_orderdate"), (F.col("o_orderkey") % 720 + 360).cast("int")).alias("ms"))


def sample_labels(spark, sf):
    return load(spark, sf, "supplier").select("s_suppkey", F.posexplode(transit.sample_labels()).alias("i", "label"))


# ---------------------------------------------------------------- classes
_TAGS = {
    "highway": (17, (*ways.WALKED, "motorway", "crossing", "traffic_signals", None, "steps")), "bicycle": (5, ("yes", "no", "designated", None, None)), "foot": (3, ("no", None, "yes")),
    "surface": (7, ("asphalt", "gravel", None, "sett", "paved", None, None)), "segregated": (4, ("no", "yes", None, None)), "crossing": (2, ("traffic_signals", None)), "crossing:signals": (11, ("yes", *[None] * 10)),
    "railway": (13, ("rail", "tram", *[None] * 11)), "waterway": (19, ("canal", "ditch", *[None] * 17)), "natural": (8, ("coastline", "water", "wood", *[None] * 5)), "leisure": (6, ("park", *[None] * 5)),
    "amenity": (9, ("kindergarten", "school", "clinic", "library", "cafe", "childcare", "hospital", None, None)), "healthcare": (10, ("doctor", "clinic", *[None] * 8)),
    "brand": (14, ("Terveystalo", *[None] * 13)), "name": (12, ("Mehiläinen Töölö", "PIHLAJALINNA", *[None] * 10)),
}


def _tagged(spark, sf):
    k = F.col("o_orderkey")
    value = lambda n, values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % n).cast("int"))
    tags = F.map_from_arrays(F.array(*[F.lit(t) for t in _TAGS]), F.array(*[value(*v) for v in _TAGS.values()]))
    return load(spark, sf, "orders").select("o_orderkey", F.map_filter(tags, lambda _, v: v.isNotNull()).alias("tags"))


def way_classes(spark, sf):
    t = F.col("tags")
    return _tagged(spark, sf).select(
        "o_orderkey", ways.walkable(t).alias("walk"), ways.cyclable(t).alias("ride"), ways.shared(t).alias("shared"), ways.slow(t).alias("slow"), ways.signal(t).alias("signal"),
        ways.line_class(t).alias("line"), ways.area_class(t).alias("area"),
    )


def amenity_classes(spark, sf):
    return _tagged(spark, sf).select("o_orderkey", ways.amenity_class(F.col("tags")).alias("class"), ways.provider(F.col("tags")).alias("provider"))


def _decisions(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), (k % n).cast("int"))
    subject = pick(4, "VUOKRAUS", "Alivuokra", "Myynti", "asunnon vuokran tarkistus")
    body = F.concat(pick(3, "TONTTIA ", "maa-alueen ", "laitteen "), pick(5, "Helsingin kaupungin ", "helsingin KAUPUNGIN ", "Espoon kaupungin ", "Uushelsingin kaupungin ", "Helsingin kaupungin "), F.lit("rakennus 10"), F.lpad((k % 1000).cast("string"), 7, "0"), pick(2, "a", "Ab"), F.lit("."))
    return load(spark, sf, "orders").select("o_orderkey", subject.alias("subject"), body.alias("body"))


def lease_candidates(spark, sf):
    return _decisions(spark, sf).select("o_orderkey", text.lease_candidate(F.col("subject"), F.col("body")).alias("lease"), F.array_join(text.building_ids(F.col("body")), ",").alias("ids"))


def workplace_layers(spark, sf):
    k = F.col("s_suppkey")
    return load(spark, sf, "supplier").select("s_suppkey", F.explode(text.workplace_layer_ids(k.cast("string"), k % 3 == 0)).alias("layer_id"))


QUERIES = {f.__name__: f for f in (
    release_references, attribute_integrity, distribution_faults, audit_reconcile, audit_buildings, layer_registry, public_fields, active_layer_ids, geometry_bounds, bearings,
    edge_attributes, geojson_features, point_inspection, cell_layers, layer_distributions, fallback_breaks, discrete_breaks, overview_mixed, composite_all, main_component,
    running_services, running_connections, wall_times, sample_labels, way_classes, amenity_classes, lease_candidates, workplace_layers,
)}

_STATE = "CASE o_orderstatus WHEN 'F' THEN 'known' WHEN 'P' THEN 'partial' ELSE 'unknown' END"
_AUDIT = "SELECT municipality, layer_id, state, count(*) AS n FROM {0} GROUP BY GROUPING SETS ((state), (municipality, state), (layer_id, state), (municipality, layer_id, state))"
_P = "[0.02, 0.08, 0.16, 0.28, 0.44, 0.64, 0.85]"
_BEARING = "degrees(atan2(({2} - {0}) * cos(radians(({1} + {3}) / 2)), {3} - {1}))"
_ACTIVE = """d AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS service_id FROM supplier),
act AS (SELECT service_id FROM d WHERE (k % 4 <> 0 AND k % 4 <> 1 OR k % 3 = 0 AND k % 2 = 0 AND k % 4 < 2) AND NOT (k % 3 = 0 AND k % 2 = 0 AND k % 4 >= 2))"""
_LAST_SUNDAY = "(make_date(year(d), {0}, {1}) - CAST(dayofweek(make_date(year(d), {0}, {1})) AS INTEGER))"



def _sql_tag(name: str) -> str:
    n, values = _TAGS[name]
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[o_orderkey % {n} + 1]"


_TAGGED = "x AS (SELECT o_orderkey, " + ", ".join(f'{_sql_tag(t)} AS {t.replace("crossing:signals", "sig").replace("natural", "nat")}' for t in _TAGS) + " FROM orders)"
_SHARED = "coalesce(highway IN ('footway', 'pedestrian') AND bicycle IN ('yes', 'designated'), false)"
_CARE = "coalesce(amenity IN ('clinic', 'doctors', 'hospital'), false) OR coalesce(healthcare IN ('clinic', 'doctor', 'hospital'), false)"
_CLASS = f"CASE WHEN amenity IN ('kindergarten', 'childcare') THEN 'daycare' WHEN amenity = 'school' THEN 'school' WHEN {_CARE} THEN 'healthcare' WHEN amenity = 'library' THEN 'library' END"

SQL = {
    "way_classes": f"""WITH {_TAGGED} SELECT o_orderkey, coalesce(highway NOT IN ('motorway', 'crossing', 'traffic_signals', 'steps'), false) AND coalesce(foot, '') <> 'no' AS walk,
  coalesce(highway NOT IN ('motorway', 'crossing', 'traffic_signals', 'steps', 'footway', 'pedestrian'), false) AND coalesce(bicycle, '') <> 'no' OR {_SHARED} AS ride, {_SHARED} AS shared,
  {_SHARED} OR coalesce(surface IN ('gravel', 'sett'), false) OR coalesce(segregated = 'no', false) OR coalesce(highway = 'path', false) AND segregated IS NULL AND coalesce(foot, '') <> 'no' AS slow,
  coalesce(highway = 'traffic_signals', false) OR coalesce(highway = 'crossing', false) AND (crossing IS NOT NULL OR sig IS NOT NULL) AS signal,
  CASE WHEN highway IN ('motorway', 'primary', 'secondary', 'tertiary') THEN 'road-major' WHEN railway = 'rail' THEN 'rail' WHEN waterway = 'canal' THEN 'waterway' WHEN "natural" = 'coastline' THEN 'coastline' END AS line,
  CASE WHEN "natural" = 'water' THEN 'water' WHEN leisure = 'park' OR "natural" = 'wood' THEN 'green' END AS area FROM x""".replace('"natural"', "nat"),
    "amenity_classes": f"WITH {_TAGGED} SELECT o_orderkey, {_CLASS} AS class, CASE WHEN {_CLASS} <> 'healthcare' THEN NULL WHEN {_CLASS} IS NULL THEN NULL WHEN name LIKE 'Mehi%' THEN 'mehilainen' WHEN brand IS NOT NULL THEN 'terveystalo' WHEN name IS NOT NULL THEN 'pihlajalinna' END AS provider FROM x",
    "lease_candidates": """SELECT o_orderkey, o_orderkey % 4 IN (0, 3) AND o_orderkey % 3 <> 2 AND o_orderkey % 5 IN (0, 1, 4) AS lease,
  CASE WHEN o_orderkey % 2 = 0 THEN '10' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 7, '0') || 'A' ELSE '' END AS ids FROM orders""",
    "workplace_layers": """SELECT s_suppkey, 'bike_workplace_' || s_suppkey || '_effective_min' AS layer_id FROM supplier
UNION ALL SELECT s_suppkey, 'transit_workplace_' || s_suppkey || '_' || e FROM supplier, (SELECT unnest(['min_min', 'median_min', 'max_min', 'median_boarding']) AS e) WHERE s_suppkey % 3 = 0""",
    "release_references": f"""WITH s AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 9 <> 4), e AS (SELECT o_orderkey AS id, o_custkey % 10 + 1 AS src FROM orders WHERE o_orderkey % 13 <> 5),
b AS (SELECT c_custkey AS id, c_nationkey % 11 AS src FROM customer WHERE c_custkey % 10 <> 3), c AS (SELECT o_orderkey AS v, unnest([o_orderkey, o_orderkey - o_orderkey % 50]) AS id FROM orders WHERE o_orderkey % 7 <> 0)
SELECT 'evidence_source' AS rule, CAST(id AS VARCHAR) AS record FROM e WHERE src NOT IN (SELECT id FROM s) UNION ALL SELECT 'building_source', CAST(id AS VARCHAR) FROM b WHERE src NOT IN (SELECT id FROM s)
UNION ALL SELECT 'value_building', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT id FROM b) UNION ALL SELECT 'no_evidence', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 7 = 0 AND {_STATE} <> 'unknown'
UNION ALL SELECT 'value_evidence', CAST(v AS VARCHAR) FROM c WHERE id NOT IN (SELECT id FROM e)""",
    "attribute_integrity": """WITH b AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 17 = 1)
SELECT 'duplicate_building' AS rule, CAST(id AS VARCHAR) AS record FROM b GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown_building', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT id FROM b)
UNION ALL SELECT 'unknown_layer', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 30 NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'state', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""",
    "distribution_faults": """WITH g AS (SELECT l_partkey AS k, count(*) FILTER (l_linenumber < 3) - CASE WHEN l_partkey % 5 = 0 THEN 4 ELSE 0 END AS a, count(*) FILTER (l_linenumber >= 3) AS b, count(*) - CASE WHEN l_partkey % 7 = 0 THEN 2 ELSE 0 END AS known,
  min(l_quantity) AS lo, max(l_quantity) - CASE WHEN l_partkey % 3 = 0 THEN 40 ELSE 0 END AS hi, l_partkey % 19 = 4 AS none FROM lineitem WHERE l_partkey % 11 <> 6 GROUP BY l_partkey),
d AS (SELECT * FROM g UNION ALL SELECT * FROM g WHERE k % 23 = 1), num AS (SELECT p_partkey AS k FROM part WHERE p_size % 4 <> 0)
SELECT k AS layer_id, 'empty' AS rule FROM d WHERE none UNION ALL SELECT k, 'negative_count' FROM d WHERE NOT none AND (a < 0 OR b < 0) UNION ALL SELECT k, 'more_than_known' FROM d WHERE CASE WHEN none THEN 0 ELSE a + b END > known
UNION ALL SELECT k, 'bounds' FROM d WHERE hi < lo UNION ALL SELECT k, 'duplicate' FROM d GROUP BY k HAVING count(*) > 1 UNION ALL SELECT DISTINCT k, 'no_layer' FROM d WHERE k NOT IN (SELECT k FROM num) UNION ALL SELECT k, 'missing' FROM num WHERE k NOT IN (SELECT k FROM d)""",
    "audit_reconcile": f"""WITH {SITES_SQL}, {LAYERS_SQL}, r AS (SELECT building_id, municipality, layer_id, state FROM layer_values JOIN sites USING (building_id)),
r2 AS (SELECT municipality, layer_id, CASE WHEN building_id % 50 = 7 AND layer_id = 'segment' THEN 'unknown' ELSE state END AS state FROM r), a AS ({_AUDIT.format('r')}), b AS ({_AUDIT.format('r2')})
SELECT *, 'stored' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'recount' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "audit_buildings": f"WITH {SITES_SQL}, {LAYERS_SQL} SELECT municipality, count(DISTINCT building_id) AS n_buildings, count(*) FILTER (state <> 'unknown') AS n_evidence FROM layer_values JOIN sites USING (building_id) GROUP BY 1",
    "layer_registry": """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 = 0 THEN 'numeric_with_categories' END, CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 4 = 0 OR p_partkey % 3 < 2) THEN 'no_ascending_range' END,
  CASE WHEN p_partkey % 2 = 1 THEN 'categorical_with_range' END, CASE WHEN p_partkey % 15 = 0 THEN 'unknown_accepted' END) AS faults FROM part""",
    "public_fields": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'leaseholder_name' WHEN c_custkey % 4 = 0 THEN 'owner_name' WHEN c_custkey % 3 = 0 THEN 'tenant_name' END AS forbidden FROM customer",
    "active_layer_ids": """WITH x AS (SELECT p_partkey, p_brand, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'lidl_walk_m,prisma_walk_m' WHEN 2 THEN '' ELSE p_brand END AS a, p_partkey % 5 = 1 AS g, p_partkey % 5 >= 3 AS own, p_partkey % 3 AS t FROM part)
SELECT p_partkey, concat_ws(',', nullif(a, ''), CASE WHEN t = 0 THEN CASE WHEN g THEN 'clinic_walk_m' ELSE 'clinic_walk_m,lidl_walk_m' END END, CASE WHEN t < 2 AND NOT own THEN p_brand END) AS layers FROM x""",
    "geometry_bounds": "SELECT l_orderkey, min(l_partkey % 997) FILTER (l_quantity < 10) AS west, min(l_suppkey * 3 % 101) FILTER (l_quantity < 10) AS south, max(l_partkey % 997) FILTER (l_quantity < 10) AS east, max(l_suppkey * 3 % 101) FILTER (l_quantity < 10) AS north FROM lineitem GROUP BY 1",
    "bearings": f"""WITH {SITES_SQL}, j AS (SELECT a.building_id, {_BEARING.format('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS b1, {_BEARING.format('b.lon', 'b.lat', 'c.lon', 'c.lat')} AS b2 FROM sites a JOIN sites b ON b.building_id = a.building_id + 1 JOIN sites c ON c.building_id = a.building_id + 2)
SELECT building_id, round(b1, 4) AS bearing, round(least(abs(b2 - b1), 360 - abs(b2 - b1)), 4) AS change FROM j""",
    "edge_attributes": "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey + CASE WHEN l_quantity % 2 = 0 THEN 1 ELSE -1 END AS b, p_size AS length FROM lineitem LEFT JOIN part ON p_partkey = l_partkey - CASE WHEN l_quantity % 2 = 0 THEN 0 ELSE 1 END AND p_partkey % 6 <> 5",
    "geojson_features": f"""WITH {SITES_SQL} SELECT building_id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || x || ',' || y || '],[' || (x + w) || ',' || y || '],[' || (x + w) || ',' || (y + h) || '],[' || x || ',' || (y + h) || '],[' || x || ',' || y || ']]]}},"properties":{{"building_id":' || building_id || ',"municipality":"' || municipality || '"}}}}' AS feature, (y + h)::DOUBLE AS top FROM sites""",
    "point_inspection": f"""WITH {SITES_SQL}, {LAYERS_SQL}, p AS (SELECT building_id AS click, x + building_id % 20 AS px, y + building_id % 17 AS py FROM sites),
t AS (SELECT click, min(building_id) AS building_id FROM p JOIN sites ON px BETWEEN x AND x + w AND py BETWEEN y AND y + h GROUP BY 1), v AS (SELECT click, building_id, array_to_string(list_sort(list(layer_id || '=' || state)), ';') AS shown FROM t JOIN layer_values USING (building_id) GROUP BY 1, 2)
SELECT p.click, building_id, coalesce(shown, 'no_score') AS shown FROM p LEFT JOIN v ON v.click = p.click""",
    "cell_layers": f"""WITH {SITES_SQL}, {LAYERS_SQL}, c AS (SELECT DISTINCT x // 2000 AS cx, y // 2000 AS cy FROM sites), v AS (SELECT x // 2000 AS cx, y // 2000 AS cy, layer_id, median(nums[1]) AS m FROM layer_values JOIN sites USING (building_id) WHERE layer_id IN ('balance', 'latest_year') AND state <> 'unknown' GROUP BY 1, 2, 3)
SELECT c.cx, c.cy, round(a.m, 4) AS balance, round(b.m, 4) AS latest_year FROM c LEFT JOIN v a ON a.cx = c.cx AND a.cy = c.cy AND a.layer_id = 'balance' LEFT JOIN v b ON b.cx = c.cx AND b.cy = c.cy AND b.layer_id = 'latest_year'""",
    "layer_distributions": f"""WITH {_HIST}, f AS (SELECT t.o_orderpriority, i AS bin, t.known, t.lo, t.hi FROM t, (SELECT unnest(range(40)) AS i)), n AS (SELECT f.*, coalesce(h.n, 0) AS n FROM f LEFT JOIN h ON h.o_orderpriority = f.o_orderpriority AND h.bin = f.bin)
SELECT o_orderpriority AS layer_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY bin) AS counts, max(known) AS known_count, round(max(lo), 4) AS lo, round(max(hi), 4) AS hi FROM n GROUP BY 1 UNION ALL SELECT 'no_values', '0' || repeat(',0', 39), 0, 0.5, 10.0""",
    "fallback_breaks": f"""WITH q AS (SELECT o_custkey, CASE WHEN count(DISTINCT o_totalprice) > 1 THEN quantile_cont(o_totalprice, {_P}) ELSE [20.0, 80.0, 160.0, 280.0, 440.0, 640.0, 850.0] END AS b FROM orders GROUP BY 1)
SELECT o_custkey, CAST(unnest(range(len(b))) AS INTEGER) AS i, round(unnest(b), 4) AS brk FROM q""",
    "discrete_breaks": """WITH q AS (SELECT l_partkey, CASE WHEN count(DISTINCT l_linenumber) > 1 THEN list_sort(list(DISTINCT l_linenumber::DOUBLE)) ELSE [0.2, 0.8, 1.6, 2.8, 4.4, 6.4, 8.5] END AS b FROM lineitem GROUP BY 1)
SELECT l_partkey, CAST(unnest(range(len(b))) AS INTEGER) AS i, round(unnest(b), 4) AS brk FROM q""",
    "overview_mixed": f"""WITH {SITES_SQL}, b AS (SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN max(o_orderpriority) ELSE 'mixed' END AS c FROM orders GROUP BY 1), n AS (SELECT x // 4000 AS cx, y // 4000 AS cy, c, count(*) AS k FROM b JOIN sites ON building_id = o_custkey GROUP BY 1, 2, 3),
m AS (SELECT *, max(k) OVER (PARTITION BY cx, cy) AS mx, sum(k) OVER (PARTITION BY cx, cy) AS t FROM n) SELECT cx, cy, CASE WHEN count(*) = 1 THEN max(c) ELSE 'mixed' END AS mode, round(max(mx) / max(t)::DOUBLE, 6) AS mode_share FROM m WHERE k = mx GROUP BY 1, 2""",
    "composite_all": """WITH g AS (SELECT o_custkey AS k, l_suppkey % 10 AS grp, min(l_quantity) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 10 IN (2, 4) GROUP BY 1, 2), a AS (SELECT k, count(*) AS n, count(*) FILTER (m <= 12) AS ok, min(m) FILTER (m <= 12) AS v FROM g GROUP BY 1)
SELECT c_custkey AS building_id, CASE WHEN coalesce(ok, 0) = 0 THEN 'unknown' WHEN ok < n THEN 'partial' ELSE 'known' END AS state, v AS value, round(coalesce(ok / n, 0)::DOUBLE, 6) AS coverage FROM customer LEFT JOIN a ON k = c_custkey""",
    "main_component": """WITH n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 25 = 3 THEN -1 ELSE p_partkey // 25 END AS g FROM part), s AS (SELECT g, min(k) AS least, count(*) + 1 AS size FROM n GROUP BY 1), best AS (SELECT g FROM s ORDER BY size DESC, least LIMIT 1)
SELECT k AS node FROM n JOIN best USING (g) UNION ALL SELECT CASE WHEN g = -1 THEN (SELECT max(k) FROM n WHERE g = -1) + 25 ELSE g * 25 + 200000000 END FROM best""",
    "running_services": f"WITH {_ACTIVE} SELECT service_id FROM act",
    "running_connections": f"""WITH {_ACTIVE}, s AS (SELECT l_orderkey AS trip_id, l_linenumber AS n, CAST(min(l_partkey) AS VARCHAR) AS stop FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(o_custkey % 12 + 1 AS VARCHAR) IN (SELECT service_id FROM act) GROUP BY 1, 2),
w AS (SELECT trip_id, lag(stop) OVER x AS from_stop, (lag(n) OVER x * 11 + 1382) * 60 + 30 AS departure, stop AS to_stop, (n * 11 + 1380) * 60 + 30 AS arrival FROM s WINDOW x AS (PARTITION BY trip_id ORDER BY n)) SELECT * FROM w WHERE from_stop IS NOT NULL""",
    "wall_times": f"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT *, {_LAST_SUNDAY.format(3, 31)} AS a, CASE WHEN year(d) < 1996 THEN {_LAST_SUNDAY.format(9, 30)} ELSE {_LAST_SUNDAY.format(10, 31)} END AS z FROM d)
SELECT o_orderkey, CAST(epoch_ms(CAST(d AS TIMESTAMP)) + (o_orderkey % 720 + 360) * 60000 - CASE WHEN d >= a AND d < z THEN 3 ELSE 2 END * 3600000 AS BIGINT) AS ms FROM s""",
    "sample_labels": "SELECT s_suppkey, i::INT AS i, lpad(CAST((420 + i) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((420 + i) % 60 AS VARCHAR), 2, '0') AS label FROM supplier, (SELECT unnest(range(61)) AS i)",
}
