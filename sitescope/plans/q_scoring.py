"""Registered queries of preference evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.operators import scoring as S
from sitescope.operators import stats
from sitescope.sources.tables import LAYERS_SQL, SITES_SQL, layer_values, load, sites

GROUPS = (
    S.Group("money", (S.Criterion("balance", 1000.0, 8000.0), S.Criterion("segment", categories=("BUILDING", "MACHINERY", "HOUSEHOLD"))), "and", 2.0),
    S.Group("recent", (S.Criterion("latest_year", ramp=S.Ramp("higher_is_better", 2001.0, 1996.0)),), "and", 1.0),
    S.Group("any", (S.Criterion("order_totals", 400000.0), S.Criterion("balance", None, 2000.0)), "or", 0.5),
    S.Group("must", (S.Criterion("order_totals", 20000.0),), "and", 1.0, True),
)

_EVAL = LAYERS_SQL + """,
w AS (SELECT c_custkey AS building_id, c_acctbal AS bal, c_mktsegment AS seg, totals, latest, pending FROM customer LEFT JOIN orders_of ON c_custkey = building_id),
c AS (SELECT building_id, bal, seg, totals, latest, pending,
  CASE WHEN bal >= 0 THEN (bal >= 1000 AND bal <= 8000) END AS p1,
  seg IN ('BUILDING','MACHINERY','HOUSEHOLD') AS p2,
  CASE WHEN latest IS NOT NULL THEN greatest(0.0, least(1.0, (latest - 1996.0) / 5.0)) END AS s3,
  CASE WHEN totals IS NOT NULL THEN list_max(totals) >= 400000 END AS p4,
  CASE WHEN bal >= 0 THEN bal <= 2000 END AS p5,
  CASE WHEN totals IS NOT NULL THEN list_max(totals) >= 20000 END AS p6,
  bal < 0 AS m_bal, (totals IS NULL OR pending) AS m_tot FROM w),
g AS (SELECT building_id,
  CASE WHEN NOT (p1 AND p2) THEN 0.0 WHEN p1 AND p2 THEN 1.0 END AS money, m_bal AS m_money,
  s3 AS recent, latest IS NULL AS m_recent,
  CASE WHEN NOT (p4 OR p5) THEN 0.0 WHEN p4 OR p5 THEN 1.0 END AS any_, (m_tot OR m_bal) AS m_any,
  CASE WHEN p6 THEN 1.0 WHEN NOT p6 THEN 0.0 END AS must, m_tot AS m_must, p6 FROM c)"""


def _score_sql(fails: str, digits: str = "6") -> str:
    return f"""WITH {_EVAL},
r AS (SELECT *, {fails} AS bad, coalesce(2.0*money,0)+coalesce(recent,0)+coalesce(0.5*any_,0)+coalesce(must,0) AS num,
  CASE WHEN money IS NULL THEN 0 ELSE 2.0 END + CASE WHEN recent IS NULL THEN 0 ELSE 1.0 END + CASE WHEN any_ IS NULL THEN 0 ELSE 0.5 END + CASE WHEN must IS NULL THEN 0 ELSE 1.0 END AS den FROM g)
SELECT building_id, NOT bad AS eligible, CASE WHEN NOT bad AND den > 0 THEN round(num / den, {digits}) END AS score,
  CASE WHEN bad THEN 'must' ELSE '' END AS failed,
  concat_ws(',', CASE WHEN m_money THEN 'money' END, CASE WHEN m_recent THEN 'recent' END, CASE WHEN m_any THEN 'any' END, CASE WHEN m_must THEN 'must' END) AS missing FROM r"""


def _suit(spark: SparkSession, sf: str, groups=GROUPS, fails: bool = False) -> DataFrame:
    b = load(spark, sf, "customer").select(F.col("c_custkey").alias("building_id"))
    return S.suitability(layer_values(spark, sf), b, S.Preferences(tuple(groups), fails))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("building_id", "eligible", F.round("score", 6).alias("score"), F.array_join("failed", ",").alias("failed"), F.array_join("missing", ",").alias("missing"))


def suitability_by_building(spark, sf):
    return _flat(_suit(spark, sf))


def suitability_policy_fail(spark, sf):
    return _flat(_suit(spark, sf, fails=True))


def suitability_legacy_layers(spark, sf):
    b = load(spark, sf, "customer").select(F.col("c_custkey").alias("building_id"))
    crit = [
        (S.Criterion("balance", 1000.0, 8000.0), 2.0, False), (S.Criterion("latest_year", ramp=S.Ramp("higher_is_better", 2001.0, 1996.0)), 1.0, False),
        (S.Criterion("order_totals", 20000.0), 1.0, True),
    ]
    return _flat(S.suitability_by_layer(layer_values(spark, sf), b, crit))


def _group(op):
    def run(spark, sf):
        g = S.Group("g", (S.Criterion("balance", 1000.0, 8000.0), S.Criterion("order_totals", 400000.0)), op)
        v = S.wide(layer_values(spark, sf), ["balance", "order_totals"])
        r = S.evaluate_group(g, {x: F.col(f"v_{x}") for x in ("balance", "order_totals")})
        return v.select("building_id", F.when(r.passed, "pass").when(~r.passed, "fail").otherwise("unknown").alias("status"), F.round(r.score, 6).alias("score"), F.coalesce(r.missing, F.lit(True)).alias("has_missing"))
    return run


def _group_sql(op):
    return f"""WITH {_EVAL} SELECT building_id, CASE WHEN p1 {op} p4 THEN 'pass' WHEN NOT (p1 {op} p4) THEN 'fail' ELSE 'unknown' END AS status,
  CASE WHEN p1 {op} p4 THEN 1.0 WHEN NOT (p1 {op} p4) THEN 0.0 END AS score, (m_bal OR m_tot) AS has_missing FROM c"""


RAMPS = {"lower": S.Ramp("lower_is_better", 50000.0, 300000.0), "higher": S.Ramp("higher_is_better", 300000.0, 50000.0), "band": S.Ramp("range", 100000.0, 200000.0)}


def ramp_scores(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", *[F.round(r.score(F.col("o_totalprice")), 6).alias(n) for n, r in RAMPS.items()])


def any_match_range(spark, sf):
    v = S.wide(layer_values(spark, sf), ["order_totals"])
    r = S.evaluate(S.Criterion("order_totals", 100000.0, 110000.0), F.col("v_order_totals"))
    return v.where(F.col("v_order_totals").isNotNull()).select("building_id", r.passed.alias("passed"), r.missing.alias("has_missing"))


def category_match(spark, sf):
    v = S.wide(layer_values(spark, sf), ["segment", "priority"])
    a = S.evaluate(S.Criterion("segment", categories=("BUILDING",)), F.col("v_segment"))
    b = S.evaluate(S.Criterion("priority", categories=("1-URGENT", "2-HIGH")), F.col("v_priority"))
    return v.select("building_id", a.passed.alias("segment_ok"), b.passed.alias("priority_ok"))


def display_status_building(spark, sf):
    s = _suit(spark, sf)
    return s.select("building_id", S.display_status(F.col("eligible"), F.col("score"), F.size("missing")).alias("status"))


def _cells(spark, sf):
    return sites(spark, sf).select("building_id", F.floor(F.col("x") / 1000).cast("long").alias("cx"), F.floor(F.col("y") / 1000).cast("long").alias("cy"))


def suitability_cell(spark, sf):
    s = _suit(spark, sf).join(_cells(spark, sf), "building_id")
    ok = F.when(F.col("eligible"), F.col("score"))
    out = s.groupBy("cx", "cy").agg(F.min(ok).alias("least"), F.median(ok).alias("median"), F.max(ok).alias("most"), F.count(ok).alias("n_scored"), F.count("*").alias("n"), F.count(F.when(~F.col("eligible"), 1)).alias("n_failed"))
    status = F.when(F.col("n_scored") > 0, "known").when(F.col("n_failed") > 0, "failed_dealbreaker").otherwise("unknown")
    return out.select("cx", "cy", F.round("least", 6).alias("least"), F.round("median", 6).alias("median"), F.round("most", 6).alias("most"), F.round(F.col("n_scored") / F.col("n"), 6).alias("coverage"), status.alias("status"))


def display_status_cell(spark, sf):
    v = layer_values(spark, sf).where("layer_id = 'balance'").join(_cells(spark, sf), "building_id")
    c = stats.state_counts(v, ["cx", "cy"])
    total = F.col("known") + F.col("partial") + F.col("unknown")
    cov = (F.col("known") + F.col("partial")) / total
    return c.select("cx", "cy", F.round(cov, 6).alias("coverage"), F.when(F.col("known") + F.col("partial") == 0, "unknown").when(cov < 1, "partial").otherwise("known").alias("status"))


def score_histogram(spark, sf):
    s = _suit(spark, sf).where("eligible AND score IS NOT NULL").select((F.col("score") * 100).alias("v"))
    return stats.fixed_histogram(s, F.round(F.col("v"), 6), 0.0, 100.0)


BREAKS = [20000.0, 60000.0, 120000.0, 200000.0, 300000.0]


def color_class(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", S.color_class(F.col("o_totalprice"), BREAKS).alias("class"))


_BAD = "coalesce(NOT p6, FALSE)"
_CELLS = SITES_SQL + ", cells AS (SELECT building_id, x // 1000 AS cx, y // 1000 AS cy FROM sites)"
QUERIES = {
    "suitability_by_building": suitability_by_building, "suitability_policy_fail": suitability_policy_fail, "suitability_legacy_layers": suitability_legacy_layers,
    "group_and": _group("and"), "group_or": _group("or"), "ramp_scores": ramp_scores, "any_match_range": any_match_range, "category_match": category_match,
    "display_status_building": display_status_building, "display_status_cell": display_status_cell, "suitability_cell": suitability_cell,
    "score_histogram": score_histogram, "color_class": color_class,
}
_BASE = _score_sql(_BAD)
SQL = {
    "suitability_by_building": _BASE,
    "suitability_policy_fail": _score_sql(f"({_BAD} OR m_must)"),
    "suitability_legacy_layers": f"""WITH {_EVAL}, r AS (SELECT *, {_BAD} AS bad, CASE WHEN p1 THEN 2.0 ELSE 0 END + coalesce(s3, 0) AS num,
  CASE WHEN p1 IS NULL THEN 0 ELSE 2.0 END + CASE WHEN s3 IS NULL THEN 0 ELSE 1.0 END AS den FROM c)
SELECT building_id, NOT bad AS eligible, CASE WHEN NOT bad AND den > 0 THEN round(num / den, 6) END AS score, CASE WHEN bad THEN 'order_totals' ELSE '' END AS failed,
  concat_ws(',', CASE WHEN m_bal THEN 'balance' END, CASE WHEN latest IS NULL THEN 'latest_year' END, CASE WHEN m_tot THEN 'order_totals' END) AS missing FROM r""",
    "group_and": _group_sql("AND"), "group_or": _group_sql("OR"),
    "ramp_scores": """SELECT o_orderkey, round(greatest(0.0, least(1.0, (o_totalprice - 300000.0) / -250000.0)), 6) AS lower, round(greatest(0.0, least(1.0, (o_totalprice - 50000.0) / 250000.0)), 6) AS higher,
  CASE WHEN o_totalprice BETWEEN 100000 AND 200000 THEN 1.0 ELSE 0.0 END AS band FROM orders""",
    "any_match_range": f"WITH {LAYERS_SQL} SELECT building_id, len(list_filter(totals, lambda t: t >= 100000 AND t <= 110000)) > 0 AS passed, pending AS has_missing FROM orders_of",
    "category_match": f"WITH {LAYERS_SQL} SELECT c_custkey AS building_id, c_mktsegment = 'BUILDING' AS segment_ok, CASE WHEN priorities IS NOT NULL THEN list_contains(priorities, '1-URGENT') OR list_contains(priorities, '2-HIGH') END AS priority_ok FROM customer LEFT JOIN orders_of ON c_custkey = building_id",
    "display_status_building": f"SELECT building_id, CASE WHEN NOT eligible THEN 'failed_dealbreaker' WHEN score IS NULL THEN 'no_score' WHEN missing <> '' THEN 'partial' ELSE 'scored' END AS status FROM ({_BASE})",
    "display_status_cell": f"""WITH {_CELLS}, n AS (SELECT cx, cy, count(*) AS t, count(*) FILTER (WHERE c_acctbal >= 0) AS k FROM cells JOIN customer ON c_custkey = building_id GROUP BY cx, cy)
SELECT cx, cy, round(k / t::DOUBLE, 6) AS coverage, CASE WHEN k = 0 THEN 'unknown' WHEN k < t THEN 'partial' ELSE 'known' END AS status FROM n""",
    "suitability_cell": f"""WITH {_CELLS}, s AS ({_score_sql(_BAD, "15")}), j AS (SELECT cx, cy, eligible, CASE WHEN eligible THEN score END AS ok FROM s JOIN cells USING (building_id)),
a AS (SELECT cx, cy, min(ok) AS least, median(ok) AS median, max(ok) AS most, count(ok) AS ns, count(*) AS n, count(*) FILTER (WHERE NOT eligible) AS nf FROM j GROUP BY cx, cy)
SELECT cx, cy, round(least, 6) AS least, round(median, 6) AS median, round(most, 6) AS most, round(ns / n::DOUBLE, 6) AS coverage, CASE WHEN ns > 0 THEN 'known' WHEN nf > 0 THEN 'failed_dealbreaker' ELSE 'unknown' END AS status FROM a""",
    "score_histogram": f"SELECT CAST(least(39, greatest(0, floor(round(score * 100, 6) / 2.5))) AS INTEGER) AS bin, count(*) AS n FROM ({_BASE}) WHERE eligible AND score IS NOT NULL GROUP BY 1",
    "color_class": "SELECT o_orderkey, CAST(o_totalprice >= 20000 AS INTEGER) + CAST(o_totalprice >= 60000 AS INTEGER) + CAST(o_totalprice >= 120000 AS INTEGER) + CAST(o_totalprice >= 200000 AS INTEGER) + CAST(o_totalprice >= 300000 AS INTEGER) AS class FROM orders",
}
