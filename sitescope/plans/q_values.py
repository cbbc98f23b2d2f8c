"""Registered queries of normalisation, conflicts, statistics and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.operators import stats
from sitescope.operators import values as V
from sitescope.sources.tables import LAYERS_SQL, SITES_SQL, layer_values, load, sites

# House type of a building class.
HOUSE_TYPES = {"0110": "omakotitalo", "0111": "paritalo", "0112": "rivitalo", "0120": "kerrostalo", "0121": "kerrostalo"}
# Heating method codes.
HEATING = {"1": "water_central", "2": "air_central", "3": "direct_electric", "4": "stove", "5": "no_fixed_heating"}
LAYERS = ["balance", "segment", "order_totals", "latest_year", "priority"]


def normalize_entities(spark, sf):
    c = sites(spark, sf)
    national = F.when(F.col("building_id") % 3 != 0, F.concat(F.lit(" B"), F.col("building_id").cast("string"), F.lit(" ")))
    return c.select(F.col("building_id").alias("record"), V.entity_id(national, "register", F.col("building_id")).alias("entity_id"), F.lower(F.trim("municipality")).alias("municipality"))


def scored_filter(spark, sf):
    c = load(spark, sf, "customer")
    done, home = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 4 != 0), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 2 == 0)
    kind = F.when(F.col("c_custkey") % 3 == 0, "x")
    return c.where(V.scored(done, home, kind)).select("c_custkey")


def municipality_filter(spark, sf):
    return sites(spark, sf).where("municipality = 'NATION_3'").select("building_id", "municipality")


def sentinel_income(spark, sf):
    v = V.finite(F.when(F.col("c_acctbal") < 0, -1.0).otherwise(F.col("c_acctbal")), -1.0)
    return load(spark, sf, "customer").select("c_custkey", F.when(v.isNull(), "unknown").otherwise("known").alias("state"), v.alias("value"))


def code_map_lookup(spark, sf):
    p = load(spark, sf, "part")
    klass = F.concat(F.lit("01"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"))
    return p.select("p_partkey", V.code(F.substring(klass, 1, 4), HOUSE_TYPES).alias("house_type"), V.code((F.col("p_size") % 8).cast("string"), HEATING).alias("heating"))


def unknown_completion(spark, sf):
    b = load(spark, sf, "customer").select(F.col("c_custkey").alias("building_id"))
    return V.complete(b, LAYERS, layer_values(spark, sf).select("building_id", "layer_id", "state"))


def evidence_attach(spark, sf):
    v = layer_values(spark, sf).where("layer_id = 'balance'")
    return v.select("building_id", "state", F.array_join(V.attach_evidence(F.col("state"), F.concat(F.lit("ev-"), F.col("building_id").cast("string"))), ",").alias("evidence"))


def evidence_resolution(spark, sf):
    li = load(spark, sf, "lineitem")
    method = F.element_at(F.array(*[F.lit(x) for x in ("direct", "aggregated", "derived", "inferred")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    conf = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("l_quantity").cast("int") % 3 + 1))
    claims = li.select("l_orderkey", F.col("l_returnflag").alias("claim"), method.alias("method"), conf.alias("confidence"))
    return V.resolve_evidence(claims, ["l_orderkey"], "claim")


def conflict_free_lookup(spark, sf):
    li = load(spark, sf, "lineitem")
    return V.conflict_free(li, ["l_orderkey"], ["l_returnflag"]).where("l_returnflag IS NOT NULL")


def fact_merge(spark, sf):
    return V.conflict_free(load(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus", "l_suppkey"])


def _dedupe(order):
    def run(spark, sf):
        li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        cols = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
        return V.keep_one(li, ["l_orderkey", "l_linenumber"], [order(F.col(c)) for c in cols])
    return run


def owner_precedence(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("building_id"))
    s = load(spark, sf, "supplier")
    first = s.select((F.col("s_suppkey") * 7).alias("building_id"), F.lit("city").alias("a"))
    second = s.select((F.col("s_suppkey") * 3).alias("building_id"), F.lit("non_city").alias("b"))
    return c.join(first, "building_id", "left").join(second, "building_id", "left").select("building_id", F.coalesce("a", "b", F.lit("unknown")).alias("owner"))


def semi_anti_membership(spark, sf):
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    have = o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey", F.lit("with_items").alias("kind"))
    return have.unionByName(o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey", F.lit("without").alias("kind")))


def published_source_pruning(spark, sf):
    p = load(spark, sf, "part")
    ids = F.array((F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 11).cast("string"), (F.col("p_partkey") % 13).cast("string"))
    admitted = ["1", "2", "3", "5", "8"]
    return p.select("p_partkey", F.array_join(F.filter(F.array_distinct(ids), lambda x: x.isin(admitted)), ",").alias("sources"), F.arrays_overlap(ids, F.array(*map(F.lit, admitted))).alias("has_source"))


def union_layers(spark, sf):
    return layer_values(spark, sf).groupBy("layer_id", "state").agg(F.count("*").alias("n"), F.sum(F.size("nums") + F.size("cats")).alias("n_values"))


def exact_median(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.median("o_totalprice"), 6).alias("median"))


def quantile_breaks(spark, sf):
    o = load(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").alias("v"))
    return stats.quantile_breaks(o, "v", ["o_orderpriority"], "income").select("o_orderpriority", F.posexplode("breaks").alias("i", "brk"))


def boarding_breaks(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.array_join(F.transform(F.sort_array(F.collect_set("l_linenumber")), lambda x: x.cast("string")), ",").alias("breaks"))


def linear_histogram(spark, sf):
    o = load(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").alias("v"))
    h = stats.histogram(o, "v", ["o_orderpriority"])
    return h.select("o_orderpriority", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "known", "bin", "n")


def _celled(spark, sf, layer):
    cells = sites(spark, sf).select("building_id", F.floor(F.col("x") / 2000).cast("long").alias("cx"), F.floor(F.col("y") / 2000).cast("long").alias("cy"))
    return layer_values(spark, sf).where(F.col("layer_id") == layer).join(cells, "building_id")


def overview_numeric(spark, sf):
    v = _celled(spark, sf, "order_totals").withColumn("v", stats.number(F.col("state"), F.col("nums")))
    r = stats.overview_numeric(v, "v", ["cx", "cy"])
    return r.select("cx", "cy", *[F.round(c, 4).alias(c) for c in ("least", "median", "most")], "n")


def overview_categorical(spark, sf):
    v = _celled(spark, sf, "segment").withColumn("c", F.col("cats")[0])
    return stats.overview_categorical(v, "c", ["cx", "cy"]).select("cx", "cy", "mode", F.round("mode_share", 6).alias("mode_share"))


def state_counts(spark, sf):
    return stats.state_counts(_celled(spark, sf, "order_totals"), ["cx", "cy"])


def audit_grouping_sets(spark, sf):
    m = sites(spark, sf).select("building_id", "municipality")
    return stats.audit(layer_values(spark, sf).join(m, "building_id").select("municipality", "layer_id", "state"))


def _groups(spark, sf):
    li, o = load(spark, sf, "lineitem"), load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    g = (F.col("l_suppkey") % 10).cast("string")
    return j.groupBy(F.col("o_custkey").alias("building_id"), g.alias("grp")).agg(
        F.min("l_quantity").alias("value"), F.when(F.max("l_linestatus") == F.min("l_linestatus"), "known").otherwise("partial").alias("state")
    )


def composite_min(spark, sf):
    return stats.composite_minimum(_groups(spark, sf), ["3", "1", "7"]).select("building_id", "state", "value", "grp", F.round("coverage", 6).alias("coverage"))


def composite_cell(spark, sf):
    c = stats.composite_minimum(_groups(spark, sf), ["3", "1", "7"])
    cells = sites(spark, sf).select("building_id", F.floor(F.col("x") / 2000).cast("long").alias("cx"), F.floor(F.col("y") / 2000).cast("long").alias("cy"))
    j = c.join(cells, "building_id")
    return j.groupBy("cx", "cy").agg(F.min("value").alias("least"), F.round(F.median("value"), 6).alias("median"), F.max("value").alias("most"), F.count(F.when(F.col("state") == "known", 1)).alias("n_known"), F.count("*").alias("n"))


def score_inputs_nested(spark, sf):
    v = layer_values(spark, sf)
    e = F.concat_ws("=", "layer_id", "state", F.size("nums").cast("string"), F.size("cats").cast("string"))
    return v.groupBy("building_id").agg(F.array_join(F.sort_array(F.collect_list(e)), ";").alias("inputs"))


def integrity_orphans(spark, sf):
    c, o, li, p = (load(spark, sf, t) for t in ("customer", "orders", "lineitem", "part"))
    a = o.join(c, o.o_custkey == c.c_custkey, "left_anti").agg(F.count("*").alias("n")).select(F.lit("order_customer").alias("reference"), "n")
    b = li.join(o, li.l_orderkey == o.o_orderkey, "left_anti").agg(F.count("*").alias("n")).select(F.lit("item_order").alias("reference"), "n")
    d = li.join(p, li.l_partkey == p.p_partkey, "left_anti").agg(F.count("*").alias("n")).select(F.lit("item_part").alias("reference"), "n")
    return a.unionByName(b).unionByName(d)


def json_round_trip(spark, sf):
    e = load(spark, sf, "events")
    p = F.from_json("props", "k int")
    back = F.from_json(F.to_json(F.struct(F.col("event_type").alias("a"), p["k"].alias("k"))), "a string, k int")
    return e.select("event_id", back["a"].alias("event_type"), back["k"].alias("k"))


_AUD = SITES_SQL + ", " + LAYERS_SQL
_HIST = """b AS (SELECT o_orderpriority, min(o_totalprice) AS mn, max(o_totalprice) AS mx, round(quantile_cont(o_totalprice, 0.01), 6) AS p1, round(quantile_cont(o_totalprice, 0.99), 6) AS p9, count(*) AS known FROM orders GROUP BY 1),
s AS (SELECT *, (p9 - p1) / 2 AS g FROM b), t AS (SELECT o_orderpriority, known, CASE WHEN g > 0 AND p1 - mn <= g THEN mn ELSE p1 END AS lo, CASE WHEN g > 0 AND mx - p9 <= g THEN mx ELSE p9 END AS hi FROM s),
h AS (SELECT t.o_orderpriority, lo, hi, known, CAST(least(39, greatest(0, floor((o_totalprice - lo) / ((hi - lo) / 40)))) AS INTEGER) AS bin, count(*) AS n FROM t JOIN orders o ON o.o_orderpriority = t.o_orderpriority AND o_totalprice BETWEEN lo AND hi GROUP BY ALL)"""
_COMP = """j AS (SELECT o_custkey AS building_id, CAST(l_suppkey % 10 AS VARCHAR) AS grp, min(l_quantity) AS value, CASE WHEN max(l_linestatus) = min(l_linestatus) THEN 'known' ELSE 'partial' END AS state
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), r AS (SELECT *, CASE grp WHEN '3' THEN 1 WHEN '1' THEN 2 ELSE 3 END AS rank FROM j WHERE grp IN ('3','1','7')),
comp AS (SELECT building_id, CASE WHEN bool_or(state = 'partial') THEN 'partial' ELSE 'known' END AS state, min(value) AS value, arg_min(grp, value * 10 + rank) AS grp, 1.0 AS coverage FROM r GROUP BY 1)"""
QUERIES = {f.__name__: f for f in (
    normalize_entities, scored_filter, municipality_filter, sentinel_income, code_map_lookup, unknown_completion, evidence_attach, evidence_resolution, conflict_free_lookup, fact_merge,
    owner_precedence, semi_anti_membership, published_source_pruning, union_layers, exact_median, quantile_breaks, boarding_breaks, linear_histogram, overview_numeric, overview_categorical,
    state_counts, audit_grouping_sets, composite_min, composite_cell, score_inputs_nested, integrity_orphans, json_round_trip)}
QUERIES |= {"dedupe_first": _dedupe(lambda c: c.asc()), "dedupe_last": _dedupe(lambda c: c.desc())}


def _dd(d):
    o = ", ".join(f"{c} {d}" for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {o}) AS rn FROM lineitem) WHERE rn = 1"


SQL = {
    "normalize_entities": f"WITH {SITES_SQL} SELECT building_id AS record, CASE WHEN building_id % 3 <> 0 THEN 'B' || building_id ELSE 'register:' || sha256('register:' || building_id) END AS entity_id, lower(trim(municipality)) AS municipality FROM sites",
    "scored_filter": "SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 AND ((c_custkey % 7 <> 0 AND c_custkey % 2 = 0) OR c_custkey % 3 = 0)",
    "municipality_filter": f"WITH {SITES_SQL} SELECT building_id, municipality FROM sites WHERE municipality = 'NATION_3'",
    "sentinel_income": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE 'known' END AS state, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS value FROM customer",
    "code_map_lookup": """SELECT p_partkey, CASE '01' || lpad(CAST(p_size % 30 AS VARCHAR), 2, '0') WHEN '0110' THEN 'omakotitalo' WHEN '0111' THEN 'paritalo' WHEN '0112' THEN 'rivitalo' WHEN '0120' THEN 'kerrostalo' WHEN '0121' THEN 'kerrostalo' END AS house_type,
  CASE p_size % 8 WHEN 1 THEN 'water_central' WHEN 2 THEN 'air_central' WHEN 3 THEN 'direct_electric' WHEN 4 THEN 'stove' WHEN 5 THEN 'no_fixed_heating' END AS heating FROM part""",
    "unknown_completion": f"WITH {LAYERS_SQL} SELECT c_custkey AS building_id, l.layer_id, coalesce(v.state, 'unknown') AS state FROM customer CROSS JOIN (SELECT unnest(['balance','segment','order_totals','latest_year','priority']) AS layer_id) l LEFT JOIN layer_values v ON v.building_id = c_custkey AND v.layer_id = l.layer_id",
    "evidence_attach": "SELECT c_custkey AS building_id, CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE 'known' END AS state, CASE WHEN c_acctbal < 0 THEN '' ELSE 'ev-' || c_custkey END AS evidence FROM customer",
    "evidence_resolution": """SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN 'known' ELSE 'conflict' END AS state, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN max(l_returnflag) ELSE 'mixed' END AS value,
  (['direct','aggregated','derived','inferred'])[CAST(max(l_linenumber % 4) AS INTEGER) + 1] AS method, (['high','medium','low'])[CAST(max(CAST(l_quantity AS INTEGER) % 3) AS INTEGER) + 1] AS confidence, count(*) AS n_records FROM lineitem GROUP BY l_orderkey""",
    "conflict_free_lookup": "SELECT l_orderkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey HAVING min(l_returnflag) = max(l_returnflag)",
    "fact_merge": "SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN max(l_returnflag) END AS l_returnflag, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN max(l_linestatus) END AS l_linestatus, CASE WHEN min(l_suppkey) = max(l_suppkey) THEN max(l_suppkey) END AS l_suppkey FROM lineitem GROUP BY l_orderkey",
    "dedupe_first": _dd("ASC"), "dedupe_last": _dd("DESC"),
    "owner_precedence": "SELECT c_custkey AS building_id, coalesce(a.v, b.v, 'unknown') AS owner FROM customer LEFT JOIN (SELECT s_suppkey * 7 AS k, 'city' AS v FROM supplier) a ON a.k = c_custkey LEFT JOIN (SELECT s_suppkey * 3 AS k, 'non_city' AS v FROM supplier) b ON b.k = c_custkey",
    "semi_anti_membership": "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'with_items' ELSE 'without' END AS kind FROM orders",
    "published_source_pruning": """WITH x AS (SELECT p_partkey, CAST(p_partkey % 7 AS VARCHAR) AS a, CAST(p_partkey % 11 AS VARCHAR) AS b, CAST(p_partkey % 13 AS VARCHAR) AS c FROM part), y AS (SELECT *, ['1','2','3','5','8'] AS ok FROM x)
SELECT p_partkey, concat_ws(',', CASE WHEN list_contains(ok, a) THEN a END, CASE WHEN list_contains(ok, b) AND b <> a THEN b END, CASE WHEN list_contains(ok, c) AND c <> a AND c <> b THEN c END) AS sources, list_contains(ok, a) OR list_contains(ok, b) OR list_contains(ok, c) AS has_source FROM y""",
    "union_layers": f"WITH {LAYERS_SQL} SELECT layer_id, state, count(*) AS n, CAST(sum(len(nums) + len(cats)) AS BIGINT) AS n_values FROM layer_values GROUP BY 1, 2",
    "exact_median": "SELECT o_custkey, round(median(o_totalprice), 6) AS median FROM orders GROUP BY o_custkey",
    "quantile_breaks": """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, [0.02, 0.15, 0.36, 0.56, 0.72, 0.84, 0.92]) AS b FROM orders GROUP BY 1)
SELECT o_orderpriority, CAST(unnest(range(len(b))) AS INTEGER) AS i, round(unnest(b), 6) AS brk FROM q""",
    "boarding_breaks": "SELECT l_returnflag, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS breaks FROM lineitem GROUP BY 1",
    "linear_histogram": f"WITH {_HIST} SELECT o_orderpriority, round(lo, 4) AS lo, round(hi, 4) AS hi, known, bin, n FROM h",
    "overview_numeric": f"""WITH {_AUD}, v AS (SELECT x // 2000 AS cx, y // 2000 AS cy, median(t) AS v FROM sites JOIN (SELECT building_id, unnest(totals) AS t FROM orders_of) USING (building_id) GROUP BY building_id, cx, cy)
SELECT cx, cy, round(min(v), 4) AS least, round(median(v), 4) AS median, round(max(v), 4) AS most, count(*) AS n FROM v GROUP BY 1, 2""",
    "overview_categorical": f"""WITH {SITES_SQL}, n AS (SELECT x // 2000 AS cx, y // 2000 AS cy, c_mktsegment AS c, count(*) AS k FROM sites GROUP BY 1, 2, 3), m AS (SELECT *, max(k) OVER (PARTITION BY cx, cy) AS mx, sum(k) OVER (PARTITION BY cx, cy) AS t FROM n)
SELECT cx, cy, CASE WHEN count(*) = 1 THEN max(c) ELSE 'mixed' END AS mode, round(max(mx) / max(t)::DOUBLE, 6) AS mode_share FROM m WHERE k = mx GROUP BY 1, 2""",
    "state_counts": f"WITH {_AUD} SELECT x // 2000 AS cx, y // 2000 AS cy, count(*) FILTER (WHERE state = 'known') AS known, count(*) FILTER (WHERE state = 'partial') AS partial, count(*) FILTER (WHERE state = 'unknown') AS unknown FROM layer_values JOIN sites USING (building_id) WHERE layer_id = 'order_totals' GROUP BY 1, 2",
    "audit_grouping_sets": f"WITH {_AUD} SELECT municipality, layer_id, state, count(*) AS n FROM layer_values JOIN sites USING (building_id) GROUP BY GROUPING SETS ((state), (municipality, state), (layer_id, state), (municipality, layer_id, state))",
    "composite_min": f"WITH {_COMP} SELECT * FROM comp",
    "composite_cell": f"WITH {SITES_SQL}, {_COMP} SELECT x // 2000 AS cx, y // 2000 AS cy, min(value) AS least, round(median(value), 6) AS median, max(value) AS most, count(*) FILTER (WHERE state = 'known') AS n_known, count(*) AS n FROM comp JOIN sites USING (building_id) GROUP BY 1, 2",
    "score_inputs_nested": f"WITH {LAYERS_SQL}, e AS (SELECT building_id, layer_id || '=' || state || '=' || len(nums) || '=' || len(cats) AS e FROM layer_values) SELECT building_id, array_to_string(list_sort(list(e)), ';') AS inputs FROM e GROUP BY 1",
    "integrity_orphans": """SELECT 'order_customer' AS reference, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'item_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'item_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""",
    "json_round_trip": "SELECT event_id, event_type, CAST(props->>'k' AS INTEGER) AS k FROM events",
}
