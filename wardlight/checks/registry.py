"""One entry per operator: a Spark query over the supplied tables and its independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlight import domain
from wardlight.checks import oracle_text as O
from wardlight.checks.views import VIEWS, load, with_views
from wardlight.functions import display, geo, scoring, text as tx
from wardlight.operators import aggregates, clustering, districts as dist, enrichment, joins, nearest, store, validation
from wardlight.operators.components import connected_components
from wardlight.operators.rate_limit import token_bucket
from wardlight.plans import classify, hotspots as hot, ingest, stats as st
from wardlight.sources import seed as seeds, sinks, tables
from wardlight.streaming import reports as streams, stateful, status, upsert
from wardlight.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, views: list[str] = (), sql: str | None = None):
    """Register a query; ``views`` are the derived views that ``sql`` reads."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(list(views), sql)
        return fn

    return add


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def _ranked_columns(df: DataFrame) -> DataFrame:
    return _rounded(
        df.withColumn("categoryFrequency", aggregates.frequency_text(F.col("categoryFrequency"))),
        priorityScore=9, avgSeverity=9,
    )


def load_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and submissions come from one small file each but take long per row."""
    return joins.spread(load(spark, sf, "texts"))


def _submissions(spark: SparkSession, sf: str) -> DataFrame:
    return joins.spread(load(spark, sf, "submissions"))


# -- ranking -------------------------------------------------------------------------

RANK_SQL = """--cte counts AS (
    SELECT coalesce(districtId, '') AS d, category AS c, count(*) AS n, sum(severity) AS s FROM complaints GROUP BY 1, 2),
  top AS (SELECT d, c FROM (SELECT d, c, row_number() OVER (PARTITION BY d ORDER BY n DESC, c) AS r FROM counts) WHERE r = 1),
  agg AS (SELECT counts.d AS districtId, CAST(sum(n) AS BIGINT) AS complaintCount, CAST(sum(s) AS DOUBLE) AS severitySum,
                 any_value(top.c) AS topCategory, string_agg(counts.c || '=' || n, ',' ORDER BY counts.c) AS categoryFrequency
          FROM counts JOIN top USING (d) GROUP BY counts.d),
  scored AS (SELECT districtId, name AS districtName,
                    round(complaintCount * (severitySum / complaintCount) / greatest(infraScore, 1.0::DOUBLE), 9) AS priorityScore,
                    round(severitySum / complaintCount, 9) AS avgSeverity, complaintCount, topCategory, categoryFrequency
             FROM agg JOIN districts ON districts.id = districtId)
"""


@query("aggregate_by_district", ["complaints", "districts"], RANK_SQL + "SELECT * FROM agg")
def _(spark, sf):
    df = aggregates.aggregate_by_district(load(spark, sf, "complaints"))
    return df.withColumn("categoryFrequency", aggregates.frequency_text(F.col("categoryFrequency")))


@query("district_scores", ["complaints", "districts"], RANK_SQL + "SELECT * FROM scored")
def _(spark, sf):
    scored = aggregates.score_districts(
        aggregates.aggregate_by_district(load(spark, sf, "complaints")), load(spark, sf, "districts")
    )
    return _ranked_columns(scored)


@query(
    "top_districts", ["complaints", "districts"],
    RANK_SQL + "SELECT * FROM scored ORDER BY priorityScore DESC, districtId LIMIT 5",
)
def _(spark, sf):
    return _ranked_columns(aggregates.top_districts(load(spark, sf, "complaints"), load(spark, sf, "districts"), 5))


# -- spatial -------------------------------------------------------------------------


@query("radius_join", ["complaints"], f"""
    SELECT a.district AS district, a.ord AS a_ord, b.ord AS b_ord, round({O.haversine('a', 'b')}, 6) AS distance_m
    FROM complaints a JOIN complaints b ON a.district = b.district AND a.ord < b.ord
    WHERE {O.haversine('a', 'b')} <= 400""")
def _(spark, sf):
    return _rounded(clustering.radius_join(load(spark, sf, "complaints"), 400.0, ["district"]), distance_m=6)


@query("dedup_reports", ["complaints"], O.DEDUP + "SELECT ord, id, category, severity FROM uniq")
def _(spark, sf):
    return clustering.dedup_reports(load(spark, sf, "complaints"), 50.0).select("ord", "id", "category", "severity")


@query("dedup_metrics", ["complaints"], O.DEDUP + """
    SELECT (SELECT count(*) FROM uniq) AS uniqueComplaintCount,
           (SELECT count(*) FROM complaints) - (SELECT count(*) FROM uniq) AS duplicatesRemoved""")
def _(spark, sf):
    rows = load(spark, sf, "complaints")
    return aggregates.dedup_metrics(rows, clustering.dedup_reports(rows, 50.0))


@query("dbscan_members", ["complaints"], O.DBSCAN + "SELECT ord, clusterId, core FROM members")
def _(spark, sf):
    unique = clustering.dedup_reports(load(spark, sf, "complaints"), 50.0)
    return clustering.dbscan(unique, 1500.0, 3).members()


@query("cluster_summary", ["complaints"], O.DBSCAN + "SELECT * FROM clusters")
def _(spark, sf):
    unique = clustering.dedup_reports(load(spark, sf, "complaints"), 50.0)
    return _rounded(clustering.dbscan(unique, 1500.0, 3).summary(), lat=9, lng=9)


@query("connected_components", [], """--cte edges AS (
      SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer
      WHERE (c_custkey * 7919) % 11 <> 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)),
    twoway AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
    reach(node, other) AS (
      SELECT c_custkey, c_custkey FROM customer UNION SELECT reach.node, twoway.dst FROM reach JOIN twoway ON reach.other = twoway.src)
    SELECT node, min(other) AS label FROM reach GROUP BY node""")
def _(spark, sf):
    nodes = load(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    edges = nodes.filter((F.col("node") * 7919) % 11 != 0).select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    return connected_components(nodes, edges.join(nodes.toDF("dst").hint("merge"), "dst", "left_semi"))


@query("nearest_district", ["points", "districts"], f"""
    SELECT id, districtId, districtName, state, districtLat, districtLng, round(metres, 6) AS distanceMeters
    FROM (SELECT p.id, d.id AS districtId, d.name AS districtName, d.state, d.lat AS districtLat, d.lng AS districtLng,
                 {O.haversine('p', 'd')} AS metres,
                 row_number() OVER (PARTITION BY p.id ORDER BY {O.chord_sq('p', 'd')}, d.id) AS r
          FROM points p CROSS JOIN districts d) WHERE r = 1""")
def _(spark, sf):
    return _rounded(
        nearest.nearest_district(load(spark, sf, "points"), load(spark, sf, "districts")), distanceMeters=6
    )


@query("nearest_district_planar", ["points", "districts"], f"""
    SELECT id, districtId, districtName, country, infraScore FROM (
      SELECT p.id, d.id AS districtId, d.name AS districtName, d.country, d.infraScore,
             row_number() OVER (PARTITION BY p.id ORDER BY {O.planar('p', 'd')}, d.ord) AS r
      FROM points p CROSS JOIN districts d) WHERE r = 1""")
def _(spark, sf):
    return nearest.nearest_district_planar(load(spark, sf, "points"), load(spark, sf, "districts"), "id")


@query("geo_functions", ["complaints"], f"""
    SELECT a.ord, round({O.haversine('a', 'b')}, 6) AS haversine, round({O.chord_sq('a', 'b')}, 12) AS chordSq,
           round({O.planar('a', 'b')}, 9) AS planar,
           CAST(floor(cos(radians(a.lat)) * cos(radians(a.lng)) / {O.CHORD_1500}) AS BIGINT) AS cx,
           CAST(floor(cos(radians(a.lat)) * sin(radians(a.lng)) / {O.CHORD_1500}) AS BIGINT) AS cy,
           CAST(floor(sin(radians(a.lat)) / {O.CHORD_1500}) AS BIGINT) AS cz
    FROM complaints a JOIN complaints b ON b.ord = a.ord + 1""")
def _(spark, sf):
    rows = load(spark, sf, "complaints").select("ord", "lat", "lng")
    pairs = rows.join(rows.select((F.col("ord") - 1).alias("ord"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2")), "ord")
    a, b = (F.col("lat"), F.col("lng")), (F.col("lat2"), F.col("lng2"))
    cx, cy, cz = geo.grid_cell(*a, 1500.0)
    return pairs.select(
        "ord", F.round(geo.haversine_m(*a, *b), 6).alias("haversine"),
        F.round(geo.chord_sq(geo.unit_vector(*a), geo.unit_vector(*b)), 12).alias("chordSq"),
        F.round(geo.planar_dist_sq(*a, *b), 9).alias("planar"), cx.alias("cx"), cy.alias("cy"), cz.alias("cz"),
    )


# -- flagship ------------------------------------------------------------------------


@query("hotspots", ["complaints", "districts"], O.HOTSPOTS + """
    SELECT districtId, districtName, country, lat, lng, priorityScore, topCategory, complaintCount, avgSeverity, recommendation
    FROM ranked ORDER BY priorityScore DESC, districtId LIMIT 5""")
def _(spark, sf):
    districts = load(spark, sf, "districts")
    placed = dist.assign_district(load(spark, sf, "complaints"), districts)
    return _rounded(hot.hotspots(placed, districts)[0], priorityScore=9, avgSeverity=9)


@query("hotspot_clusters", ["complaints", "districts"], O.HOTSPOTS + "SELECT * FROM enriched")
def _(spark, sf):
    districts = load(spark, sf, "districts")
    placed = dist.assign_district(load(spark, sf, "complaints"), districts)
    return _rounded(hot.hotspots(placed, districts)[1], lat=9, lng=9, priorityScore=9, avgSeverity=9)


# -- districts -----------------------------------------------------------------------


@query("lookup_district", ["complaints", "districts"], """
    SELECT c.id, c.districtId, coalesce(d.name, c.districtId) AS districtName, coalesce(d.country, 'Unknown') AS country,
           coalesce(d.lat, 0) AS lat, coalesce(d.lng, 0) AS lng
    FROM complaints c LEFT JOIN districts d ON d.id = c.districtId""")
def _(spark, sf):
    rows = load(spark, sf, "complaints").select("id", "districtId")
    return dist.lookup_district(rows, load(spark, sf, "districts"))


@query("canonicalize_districts", ["catalog", "district_docs"], """--cte m AS (
      SELECT docId, ord, coalesce(a.districtId, b.districtId, d.id) AS id, coalesce(a.districtName, b.districtName, d.name) AS name,
             country, coalesce(a.stateName, b.stateName, d.state) AS state, lat, lng, infraScore, population
      FROM district_docs d LEFT JOIN catalog a ON a.districtId = d.id
      LEFT JOIN catalog b ON lower(b.stateName) || '__' || lower(b.districtName) = lower(d.state) || '__' || lower(d.name))
    SELECT id, docId, ord, name, country, state, lat, lng, infraScore, population FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY (docId <> id), ord) AS r FROM m) WHERE r = 1""")
def _(spark, sf):
    return dist.canonicalize_districts(load(spark, sf, "district_docs"), load(spark, sf, "catalog"))


@query("resolve_admin_unit", ["addresses", "catalog"], """--cte f AS (
      SELECT pointId, lat, lng, state, country_code, 0 AS pos, state_district AS v FROM addresses
      UNION ALL SELECT pointId, lat, lng, state, country_code, 1, district FROM addresses
      UNION ALL SELECT pointId, lat, lng, state, country_code, 2, county FROM addresses
      UNION ALL SELECT pointId, lat, lng, state, country_code, 3, city_district FROM addresses
      UNION ALL SELECT pointId, lat, lng, state, country_code, 4, municipality FROM addresses
      UNION ALL SELECT pointId, lat, lng, state, country_code, 5, city FROM addresses
      UNION ALL SELECT pointId, lat, lng, state, country_code, 6, town FROM addresses),
    k AS (SELECT pointId, lat, lng, pos, trim(regexp_replace(lower(state), '[^a-z0-9]+', ' ', 'g')) AS s,
                 regexp_replace(trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')), '\\s+district$', '') AS d
          FROM f WHERE country_code = 'in' AND state IS NOT NULL AND v IS NOT NULL),
    c AS (SELECT *, trim(regexp_replace(lower(stateName), '[^a-z0-9]+', ' ', 'g')) AS s,
                 regexp_replace(trim(regexp_replace(lower(districtName), '[^a-z0-9]+', ' ', 'g')), '\\s+district$', '') AS d FROM catalog),
    hit AS (SELECT *, row_number() OVER (PARTITION BY pointId ORDER BY pos) AS r FROM k JOIN c USING (s, d))
    SELECT a.pointId, districtId AS id, districtName AS name, CASE WHEN districtId IS NOT NULL THEN 'India' END AS country,
           stateName AS state, hit.lat, hit.lng, CASE WHEN districtId IS NOT NULL THEN 5::DOUBLE END AS infraScore,
           CAST(NULL AS BIGINT) AS population
    FROM addresses a LEFT JOIN hit ON hit.pointId = a.pointId AND hit.r = 1""")
def _(spark, sf):
    return dist.resolve_admin_unit(load(spark, sf, "addresses"), load(spark, sf, "catalog"))


_REPORTED = """--cte reported AS (
      SELECT id, ord, lat, lng, timestamp,
             's' || CAST(district % 5 AS VARCHAR) || '__nation-' || CAST(district AS VARCHAR) AS districtId FROM complaints)"""


def _reported(spark, sf):
    rows = load(spark, sf, "complaints")
    unit = F.format_string("s%d__nation-%d", F.col("district") % 5, F.col("district"))
    return rows.select("id", "ord", "lat", "lng", "timestamp", unit.alias("districtId"))


@query("ensure_district_rows", ["complaints", "districts", "catalog"], _REPORTED + """,
    first AS (SELECT *, row_number() OVER (PARTITION BY districtId ORDER BY timestamp, id) AS r FROM reported)
    SELECT id, name, country, state, lat, lng, infraScore, population FROM districts
    UNION ALL SELECT c.districtId, c.districtName, 'India', c.stateName, f.lat, f.lng, 5, NULL
    FROM first f JOIN catalog c ON c.districtId = f.districtId
    WHERE r = 1 AND f.districtId NOT IN (SELECT id FROM districts)""")
def _(spark, sf):
    return dist.ensure_district_rows(_reported(spark, sf), load(spark, sf, "districts"), load(spark, sf, "catalog"))


@query("assign_district", ["complaints", "districts"], O.ASSIGN + "SELECT id, districtId, stateName FROM placed")
def _(spark, sf):
    return dist.assign_district(load(spark, sf, "complaints"), load(spark, sf, "districts")).select("id", "districtId", "stateName")


@query("orphan_complaints", ["complaints", "districts"], """
    SELECT id, districtId FROM complaints WHERE districtId IS NOT NULL AND districtId NOT IN (SELECT id FROM districts)""")
def _(spark, sf):
    return dist.orphans(load(spark, sf, "complaints").select("id", "districtId"), "districtId", load(spark, sf, "districts"), "id")


@query("flatten_admin_catalog", ["catalog"], """
    SELECT districtId, districtName, lgdCode, stateId, stateName, kind, CAST(NULL AS VARCHAR) AS stateLgdCode,
           lower(stateName) AS stateKey, lower(stateName) || '__' || lower(districtName) AS pairKey FROM catalog""")
def _(spark, sf):
    nested = load(spark, sf, "catalog").groupBy(F.col("stateId").alias("id"), F.col("stateName").alias("name"), "kind").agg(
        F.collect_list(
            F.struct(F.col("districtId").alias("id"), F.col("districtName").alias("name"), "stateId", "lgdCode")
        ).alias("districts")
    ).withColumn("lgdCode", F.lit("undefined"))
    return dist.flatten_admin_catalog(nested)


@query("catalog_quality", ["catalog", "district_docs"], """
    SELECT 'kind' AS "check", kind AS key, count(DISTINCT stateId) AS n FROM catalog GROUP BY kind
    UNION ALL SELECT 'districts', stateName, count(*) FROM catalog GROUP BY stateName
    UNION ALL SELECT 'duplicate', districtId, count(*) FROM catalog GROUP BY districtId HAVING count(*) > 1
    UNION ALL SELECT 'invalid', districtId, count(*) FROM catalog
      WHERE NOT regexp_full_match(districtId, '[a-z0-9]+(-[a-z0-9]+)*__[a-z0-9]+(-[a-z0-9]+)*') GROUP BY districtId
    UNION ALL SELECT 'missing', id, 1 FROM district_docs WHERE id NOT IN (SELECT districtId FROM catalog)""")
def _(spark, sf):
    return dist.catalog_quality(load(spark, sf, "catalog"), load(spark, sf, "district_docs"))


@query("seed_quality", ["districts", "complaints"], """
    SELECT (SELECT count(*) BETWEEN 25 AND 28 FROM districts) AS districtCountOk,
           (SELECT count(DISTINCT state) >= 10 FROM districts) AS statesOk,
           (SELECT count(*) = 0 FROM districts WHERE country <> 'India') AS onlyIndia,
           (SELECT count(*) FROM complaints) = 4 * (SELECT count(*) FROM districts) AS complaintCountOk,
           (SELECT count(DISTINCT detectedLanguage) = 4 FROM complaints WHERE detectedLanguage IN ('en', 'hi', 'bn', 'ta')) AS languagesOk,
           (SELECT count(*) = 0 FROM complaints WHERE districtId IS NULL OR districtId NOT IN (SELECT id FROM districts)) AS noOrphans""")
def _(spark, sf):
    return dist.seed_quality(load(spark, sf, "districts"), load(spark, sf, "complaints"))


@query("gen_seed", [], f"""
    SELECT 'demo-c' || c_custkey || '-' || (i + 1) AS id, CAST(NULL AS VARCHAR) AS userId, 'submitted' AS status,
           {O.SEED_TEXT} AS rawText, {O.SEED_ENGLISH} AS translatedText, (['en', 'hi', 'bn', 'ta'])[(c_custkey + i) % 4 + 1] AS detectedLanguage,
           (['roads', 'water', 'electricity', 'sanitation', 'healthcare', 'internet'])[(c_custkey + i) % 6 + 1] AS category,
           CAST((c_custkey + i) % 5 + 1 AS INTEGER) AS severity, 'c' || c_custkey AS districtId,
           CAST(c_nationkey AS DOUBLE) AS lat, CAST(c_nationkey * 2 AS DOUBLE) AS lng,
           strftime(DATE '2025-01-01' + CAST(c_custkey * 4 + i AS INTEGER), '%Y-%m-%d') AS day,
           (['text', 'voice', 'messaging'])[i % 3 + 1] AS source
    FROM customer CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i)""")
def _(spark, sf):
    places = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_nationkey").cast("double").alias("lat"), (F.col("c_nationkey") * 2).cast("double").alias("lng"),
    )
    # Four days a customer reach the year 10000 at key 728,202; a date pattern writes that with a sign.
    at = F.col("timestamp")
    day = F.format_string("%04d-%02d-%02d", F.year(at), F.month(at), F.dayofmonth(at))
    return seeds.gen_seed(places).withColumn("day", day).drop("timestamp")


@query("signup_districts", ["districts"], """
    SELECT id, name, country, state, lat, lng, infraScore, population FROM districts WHERE country = 'India' AND state IS NOT NULL""")
def _(spark, sf):
    return dist.signup_districts(load(spark, sf, "districts"), seeds.seed_districts(spark))


@query("search_admin_units", ["catalog"], """
    SELECT districtId, districtName, stateName FROM catalog
    WHERE (contains(lower(stateName), 'e 2') OR stateName = 'State 4') AND (contains(lower(districtName), 'on_1') OR districtId = 's2__nation-2')""")
def _(spark, sf):
    return dist.search_admin_units(load(spark, sf, "catalog"), "E 2", "oN_1", "State 4", "s2__nation-2").select(
        "districtId", "districtName", "stateName"
    )


# -- statistics ----------------------------------------------------------------------


def _stats_rows(spark, sf, everything=False):
    odd = F.when(F.col("ord") % 101 == 7, "noise").when(F.col("ord") % 10 == 3, "drainage").otherwise(F.col("category"))
    return st.stats(load(spark, sf, "complaints").withColumn("category", odd), load(spark, sf, "districts"), everything)


def _stats_sql(languages: list[str]) -> str:
    return f"""--cte odd AS (
      SELECT CASE WHEN ord % 101 = 7 THEN 'noise' WHEN ord % 10 = 3 THEN 'drainage' ELSE category END AS category,
             detectedLanguage, districtId FROM complaints),
    stats AS (
      SELECT 'total' AS dimension, '' AS key, count(*) AS n FROM odd
      UNION ALL SELECT 'category', k, (SELECT count(*) FROM odd WHERE category = k) FROM (SELECT unnest({domain.CATEGORIES}) AS k)
      UNION ALL SELECT 'language', k, CASE WHEN k IN ({', '.join(repr(x) for x in languages)}) THEN (SELECT count(*) FROM odd WHERE detectedLanguage = k) ELSE 0 END
        FROM (SELECT unnest({domain.LANGUAGES}) AS k)
      UNION ALL SELECT 'country', coalesce(country, 'Unknown'), count(*) FROM odd LEFT JOIN districts ON id = districtId GROUP BY 2
      UNION ALL SELECT 'districts', '', count(DISTINCT coalesce(districtId, '')) FROM odd)
    """


@query("stats", ["complaints", "districts"], _stats_sql(domain.COUNTED_LANGUAGES) + "SELECT * FROM stats")
def _(spark, sf):
    return _stats_rows(spark, sf)


@query("stats_all_languages", ["complaints", "districts"], _stats_sql(domain.LANGUAGES) + "SELECT * FROM stats")
def _(spark, sf):
    return _stats_rows(spark, sf, True)


@query("chart_series", ["complaints", "districts"], _stats_sql(domain.COUNTED_LANGUAGES) + f"""
    SELECT dimension AS chart, CASE WHEN dimension = 'category' THEN {O.map_case('key', domain.CATEGORY_LABELS)} ELSE key END AS name, n AS value
    FROM stats WHERE n > 0 AND (dimension = 'category' OR dimension = 'country')""")
def _(spark, sf):
    return st.chart_series(_stats_rows(spark, sf))


@query("country_names", ["complaints", "districts"], _stats_sql(domain.COUNTED_LANGUAGES) + """
    SELECT key AS country FROM stats WHERE dimension = 'country' AND n > 0 ORDER BY 1""")
def _(spark, sf):
    return st.country_names(_stats_rows(spark, sf))


def _scored_rows(spark, sf):
    districts = load(spark, sf, "districts")
    scored = aggregates.score_districts(aggregates.aggregate_by_district(load(spark, sf, "complaints")), districts)
    return dist.lookup_district(scored.drop("districtName", "categoryFrequency"), districts)


_SCORED = RANK_SQL + ", rows AS (SELECT s.*, d.country FROM scored s JOIN districts d ON d.id = s.districtId) "


@query("kpis", ["complaints", "districts"], _SCORED + """
    SELECT 'languages' AS name, count(DISTINCT detectedLanguage) AS n FROM complaints
      WHERE detectedLanguage NOT IN ('or', 'hi-Latn', 'xx')
    UNION ALL SELECT 'highPriority', count(*) FROM rows WHERE priorityScore >= 12""")
def _(spark, sf):
    return st.kpis(_stats_rows(spark, sf), _scored_rows(spark, sf))


@query("resolved_by_user", ["complaints"], """
    SELECT userId, count(*) AS submitted, count(*) FILTER (WHERE status = 'resolved') AS resolved
    FROM complaints WHERE userId IS NOT NULL GROUP BY userId""")
def _(spark, sf):
    return aggregates.resolved_by_user(load(spark, sf, "complaints"))


@query("filter_hotspots", ["complaints", "districts"], _SCORED + """
    SELECT districtId, country, topCategory, avgSeverity FROM rows WHERE country = 'India' AND topCategory = 'roads' AND avgSeverity >= 2
    UNION ALL SELECT districtId, country, topCategory, avgSeverity FROM rows WHERE avgSeverity >= 3""")
def _(spark, sf):
    rows = _scored_rows(spark, sf)
    both = st.filter_hotspots(rows, "India", "roads", 2).unionByName(st.filter_hotspots(rows, min_severity=3))
    return _rounded(both.select("districtId", "country", "topCategory", "avgSeverity"), avgSeverity=9)


@query("facet_counts", ["complaints", "districts"], _SCORED + """
    SELECT 'country' AS facet, country AS key, count(*) AS n FROM rows GROUP BY country
    UNION ALL SELECT 'category', topCategory, count(*) FROM rows GROUP BY topCategory
    UNION ALL SELECT 'severity', CAST(t AS VARCHAR), count(*) FROM rows JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS t) ON avgSeverity >= t GROUP BY t""")
def _(spark, sf):
    return st.facet_counts(_scored_rows(spark, sf))


# -- validation and scoring ----------------------------------------------------------


@query("validate_complaints", ["submissions", "catalog"], O.VALIDATE + """
    SELECT id, array_to_string(errors, ',') AS errors, errors[1] AS reason, text, lat, lng FROM checked""")
def _(spark, sf):
    valid, rejects = validation.split_valid(
        validation.validate_complaints(_submissions(spark, sf), load(spark, sf, "catalog"))
    )
    good = valid.select("id", F.lit("").alias("errors"), F.lit(None).cast("string").alias("reason"), "text", "lat", "lng")
    return good.unionByName(
        rejects.select("id", F.array_join("errors", ",").alias("errors"), "reason", "text", "lat", "lng")
    )


@query("mask_anonymous", ["complaints"], """
    SELECT id, CASE WHEN NOT isAnonymous THEN userId END AS userId, CASE WHEN NOT isAnonymous THEN contactPhone END AS contactPhone FROM complaints""")
def _(spark, sf):
    return scoring.mask_anonymous(load(spark, sf, "complaints")).select("id", "userId", "contactPhone")


@query("effective_severity", ["complaints"], f"SELECT id, {O.severity('severity')} AS effective FROM complaints")
def _(spark, sf):
    return load(spark, sf, "complaints").select(
        "id", scoring.effective_severity(F.col("severity"), F.col("urgency"), F.col("affectedScale"), F.col("duration")).alias("effective")
    )


@query("reference_id", ["complaints"], """
    SELECT id, 'CP-' || year(timestamp) || '-' || lpad(CAST((ord * 7919) % 1000000 AS VARCHAR), 6, '0') AS referenceId FROM complaints""")
def _(spark, sf):
    return load(spark, sf, "complaints").select("id", scoring.reference_id(F.col("timestamp"), F.col("ord") * 7919).alias("referenceId"))


@query("conform_hotspots", ["complaints", "districts"], _SCORED + "SELECT districtId, topCategory, complaintCount FROM rows")
def _(spark, sf):
    return validation.conform_hotspots(_scored_rows(spark, sf)).select("districtId", "topCategory", "complaintCount")


# -- store ---------------------------------------------------------------------------


def _halves(spark, sf):
    rows = load(spark, sf, "complaints").select("id", "ord", "severity")
    return rows.filter("ord % 3 <> 0"), rows.filter("ord % 2 = 0 OR ord % 3 = 0").withColumn("severity", F.col("severity") + 10)


@query("overlay_base_wins", ["complaints"], """
    SELECT id, ord, CASE WHEN ord % 3 <> 0 THEN severity ELSE severity + 10 END AS severity FROM complaints""")
def _(spark, sf):
    return store.overlay_union(*_halves(spark, sf), prefer="base")


@query("overlay_wins", ["complaints"], """
    SELECT id, ord, CASE WHEN ord % 2 = 0 OR ord % 3 = 0 THEN severity + 10 ELSE severity END AS severity FROM complaints""")
def _(spark, sf):
    return store.overlay_union(*_halves(spark, sf), prefer="overlay")


@query("upsert_complaints", ["complaints"], """
    SELECT userId AS id, ord, category FROM (
      SELECT *, row_number() OVER (PARTITION BY userId ORDER BY ord DESC) AS r FROM complaints WHERE userId IS NOT NULL) WHERE r = 1""")
def _(spark, sf):
    rows = load(spark, sf, "complaints").filter("userId IS NOT NULL").select(F.col("userId").alias("id"), "ord", "category")
    return store.upsert_complaints(rows, "ord")


@query("get_complaint", ["complaints"], """
    SELECT id, referenceId FROM complaints WHERE id = 'CP-2024-000123' OR referenceId = 'CP-2024-000123'
    ORDER BY CASE WHEN id = 'CP-2024-000123' THEN 0 ELSE 1 END, id LIMIT 1""")
def _(spark, sf):
    return store.get_complaint(load(spark, sf, "complaints"), "CP-2024-000123").select("id", "referenceId")


@query("resolve_complaints", ["complaints"], """--cte asked AS (
      SELECT DISTINCT CASE WHEN ord % 3 = 0 THEN id WHEN ord % 3 = 1 THEN printf('CP-2024-%06d', ord) ELSE 'q' || id END AS wanted FROM complaints)
    SELECT wanted, coalesce((SELECT id FROM complaints c WHERE c.id = wanted), (SELECT min(id) FROM complaints c WHERE c.referenceId = wanted)) AS complaintId FROM asked""")
def _(spark, sf):
    rows = load(spark, sf, "complaints")
    asked = rows.select(
        F.when(F.col("ord") % 3 == 0, F.col("id"))
        .when(F.col("ord") % 3 == 1, F.format_string("CP-2024-%06d", "ord"))
        .otherwise(F.concat(F.lit("q"), "id")).alias("wanted")
    )
    return store.resolve_complaints(asked, rows)


@query("my_reports", ["complaints"], "SELECT id, userId FROM complaints WHERE userId = 'u8'")
def _(spark, sf):
    return store.my_reports(load(spark, sf, "complaints"), "u8").select("id", "userId")


_CURSOR = "c100"


@query("page_reports", ["complaints"], """--cte cur AS (SELECT timestamp AS t, id AS i FROM complaints WHERE id = 'c100'),
    p AS (SELECT c.id, c.timestamp, row_number() OVER (ORDER BY c.timestamp DESC, c.id) AS r
          FROM complaints c, cur WHERE c.timestamp < t OR (c.timestamp = t AND c.id > i))
    SELECT CAST(r - 1 AS INTEGER) AS position, id, timestamp,
           (SELECT replace(replace(rtrim(base64(encode(id)), '='), '+', '-'), '/', '_') FROM p WHERE r = 20 AND (SELECT max(r) FROM p) > 20) AS nextCursor
    FROM p WHERE r <= 20""")
def _(spark, sf):
    rows = load(spark, sf, "complaints").select("id", "userId", F.col("timestamp"))
    page = store.page_reports(rows, 20, "YzEwMA").select("position", "id", "timestamp", "nextCursor")
    return page.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("moderation_queue", ["complaints"], f"""--cte p AS (
      SELECT *, row_number() OVER (ORDER BY timestamp DESC, id) AS r FROM complaints)
    SELECT CAST(r - 1 AS INTEGER) AS position, id, {O.summary('rawText', 150)} AS summary, upper(substr(districtId, 1, 1)) || substr(districtId, 2) AS district,
           {O.map_case('category', domain.CATEGORY_LABELS)} AS categoryLabel, strftime(timestamp, '%Y-%m-%d') AS day,
           {O.map_case("coalesce(classifiedBy, 'fallback')", domain.CLASSIFIER_LABELS)} AS classifier,
           {O.map_case('urgency', domain.URGENCY_LABELS)} AS urgencyLabel, {O.map_case('affectedScale', domain.SCALE_LABELS)} AS scaleLabel,
           replace(duration, '_', ' ') AS durationText, coalesce(referenceId, id) AS reference
    FROM p WHERE r <= 20""")
def _(spark, sf):
    return store.moderation_queue(load(spark, sf, "complaints"), 20)


@query("fold_status_events", ["status_events", "complaints"], """--cte ok AS (
      SELECT coalesce(c.id, r.id) AS complaintId, seq, updatedAt, e.status, adminId, CASE WHEN trim(note) <> '' THEN trim(note) END AS note
      FROM status_events e LEFT JOIN complaints c ON c.id = e.complaintId
      LEFT JOIN (SELECT referenceId, min(id) AS id FROM complaints GROUP BY referenceId) r ON r.referenceId = e.complaintId
      WHERE e.status IN ('submitted', 'reviewing', 'in_progress', 'resolved') AND (note IS NULL OR length(trim(note)) <= 500)
        AND coalesce(c.id, r.id) IS NOT NULL),
    d AS (SELECT complaintId, updatedAt, status, adminId, note, max(seq) AS seq FROM ok GROUP BY ALL)
    SELECT complaintId, arg_max(status, (updatedAt, seq)) AS status,
           arg_max(note, (updatedAt, seq)) FILTER (WHERE note IS NOT NULL) AS adminNote, max(updatedAt) AS updatedAt,
           string_agg(seq || ':' || status || ':' || adminId || ':' || coalesce(note, ''), '|' ORDER BY updatedAt, seq) AS history
    FROM d GROUP BY complaintId""")
def _(spark, sf):
    folded = store.fold_status_events(load(spark, sf, "status_events"), load(spark, sf, "complaints"))
    line = F.transform(
        "history",
        lambda h: F.concat_ws(":", h["seq"].cast("string"), h["status"], h["adminId"], F.coalesce(h["note"], F.lit(""))),
    )
    return folded.withColumns({"history": F.array_join(line, "|"), "updatedAt": F.col("updatedAt").cast("timestamp_ntz")})


_EVENTS_SQL = """--cte ok AS (
      SELECT coalesce(c.id, r.id) AS complaintId, seq, updatedAt, e.status, adminId, CASE WHEN trim(note) <> '' THEN trim(note) END AS note
      FROM status_events e LEFT JOIN complaints c ON c.id = e.complaintId
      LEFT JOIN (SELECT referenceId, min(id) AS id FROM complaints GROUP BY referenceId) r ON r.referenceId = e.complaintId
      WHERE e.status IN ('submitted', 'reviewing', 'in_progress', 'resolved') AND (note IS NULL OR length(trim(note)) <= 500)
        AND coalesce(c.id, r.id) IS NOT NULL),
    d AS (SELECT complaintId, updatedAt, status, adminId, note, max(seq) AS seq FROM ok GROUP BY ALL)
    """


@query("status_history", ["status_events", "complaints"], _EVENTS_SQL + "SELECT * FROM d")
def _(spark, sf):
    history = store.status_history(load(spark, sf, "status_events"), load(spark, sf, "complaints"))
    return history.withColumn("updatedAt", F.col("updatedAt").cast("timestamp_ntz"))


@query("current_status", ["status_events", "complaints"], _EVENTS_SQL + """
    SELECT complaintId, arg_max(status, (updatedAt, seq)) AS status, arg_max(note, (updatedAt, seq)) FILTER (WHERE note IS NOT NULL) AS adminNote,
           max(updatedAt) AS updatedAt, count(*) AS entries FROM d GROUP BY complaintId""")
def _(spark, sf):
    history = store.status_history(load(spark, sf, "status_events"), load(spark, sf, "complaints"))
    return store.current_status(history).withColumn("updatedAt", F.col("updatedAt").cast("timestamp_ntz"))


_RATE = 1 / 8192


@query("token_bucket", [], """--cte ev AS (
      SELECT event_id, user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    run AS (
      SELECT user_id, event_id, us, r, true AS allowed, 2::DOUBLE AS tokens FROM ev WHERE r = 1
      UNION ALL
      SELECT ev.user_id, ev.event_id, ev.us, ev.r,
             least(3::DOUBLE, tokens + (ev.us - run.us) / 1e6::DOUBLE * (1 / 8192::DOUBLE)) >= 1,
             CASE WHEN least(3::DOUBLE, tokens + (ev.us - run.us) / 1e6::DOUBLE * (1 / 8192::DOUBLE)) >= 1
                  THEN least(3::DOUBLE, tokens + (ev.us - run.us) / 1e6::DOUBLE * (1 / 8192::DOUBLE)) - 1
                  ELSE least(3::DOUBLE, tokens + (ev.us - run.us) / 1e6::DOUBLE * (1 / 8192::DOUBLE)) END
      FROM run JOIN ev ON ev.user_id = run.user_id AND ev.r = run.r + 1)
    SELECT user_id, event_id, allowed FROM run""")
def _(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return token_bucket(events, "user_id", "ts", "event_id", capacity=3.0, refill_per_s=_RATE).select("user_id", "event_id", "allowed")


# -- text ----------------------------------------------------------------------------


@query("normalize_text", ["texts"], "SELECT id, md5(lower(nfc_normalize(text))) AS digest FROM texts")
def _(spark, sf):
    return load_texts(spark, sf).select("id", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


@query("text_fingerprint", ["texts"], """
    SELECT id, sha256(coalesce(language, 'auto') || chr(0) || regexp_replace(trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g')), ' +', ' ', 'g'))
               || coalesce('_' || userCategory, '') AS fingerprint FROM texts""")
def _(spark, sf):
    return load_texts(spark, sf).select(
        "id", tx.text_fingerprint(F.col("text"), F.col("language"), F.col("userCategory")).alias("fingerprint")
    )


@query("keyword_classify", ["texts"], O.KEYWORDS + """
    SELECT t.id, k.category, k.language, k.confidence, k.summary FROM texts t LEFT JOIN keyword k USING (id)""")
def _(spark, sf):
    return tx.keyword_classify(load_texts(spark, sf)).select(
        "id", "keyword.category", "keyword.language", F.round("keyword.confidence", 6).alias("confidence"), "keyword.summary"
    )


@query("detect_script", ["texts"], O.SCRIPT + "SELECT id, code, label, round(confidence, 9) AS confidence FROM script")
def _(spark, sf):
    s = load_texts(spark, sf).select("id", tx.detect_script(F.col("text")).alias("s"))
    return s.select("id", "s.code", "s.label", F.round("s.confidence", 9).alias("confidence"))


@query("admin_names_and_letters", ["texts"], """
    SELECT id, md5(regexp_replace(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), '\\s+district$', '')) AS adminName,
           CAST(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS INTEGER) AS letters FROM texts""")
def _(spark, sf):
    text = F.col("text")
    return load_texts(spark, sf).select(
        "id", F.md5(tx.strip_district_suffix(tx.normalize_admin_name(text))).alias("adminName"),
        tx.count_letters(text).alias("letters"),
    )


@query("language_guesses", ["texts"], O.KEYWORDS_SCRIPT + """
    SELECT s.id, f AS firstScript, coalesce(t.language, f) AS hintedScript,
           CASE WHEN regexp_matches(t.text, '[\\x{0400}-\\x{04FF}]') THEN 'ru' ELSE coalesce(k.language, 'en') END AS guess,
           CASE WHEN regexp_matches(t.text, '[\\x{0400}-\\x{04FF}]') THEN 'ru'
                WHEN regexp_matches(t.text, '(?i)[ãõáâàéêíóôúç]') OR regexp_matches(t.text, '(?i)(^|[^A-Za-z0-9_])(rua|água|buraco|lixo|saúde|energia)([^A-Za-z0-9_]|$)') THEN 'pt'
                ELSE 'en' END AS formLanguage,
           CASE WHEN s.code = 'hi-Latn' AND t.language IN ('hi', 'mr') THEN t.language WHEN s.code = 'en' THEN coalesce(t.language, f) ELSE s.code END AS resolved
    FROM script s JOIN texts t USING (id) LEFT JOIN keyword k USING (id),
         LATERAL (SELECT CASE WHEN regexp_matches(t.text, '\\p{Cyrillic}') THEN 'ru' ELSE 'en' END AS f)""")
def _(spark, sf):
    text, hint = F.col("text"), F.col("language")
    rows = tx.keyword_classify(load_texts(spark, sf)).withColumn("s", tx.detect_script(text)["code"])
    return rows.select(
        "id", tx.first_script(text).alias("firstScript"), tx.first_script(text, hint).alias("hintedScript"),
        tx.guess_language(text, F.col("keyword.language")).alias("guess"),
        tx.guess_form_language(text).alias("formLanguage"),
        tx.resolve_language(F.col("s"), hint, text).alias("resolved"),
    )


@query("display_texts", ["texts"], f"""
    SELECT id, {O.summary('text', 150)} AS queueSummary, {O.summary('text', 140)} AS reportSummary FROM texts""")
def _(spark, sf):
    return load_texts(spark, sf).select(
        "id", display.summarize_text(F.col("text"), 150).alias("queueSummary"),
        display.summarize_text(F.col("text"), 140).alias("reportSummary"),
    )


@query("pretty_district", [], """--cte w AS (
      SELECT c_custkey AS id, unnest(string_split('new-' || lower(c_mktsegment) || ' east_end ' || c_custkey || 'x', ' ')) AS p, generate_subscripts(string_split('new-' || lower(c_mktsegment) || ' east_end ' || c_custkey || 'x', ' '), 1) AS i FROM customer)
    SELECT id, string_agg(CASE WHEN i = 1 THEN 'New ' || upper(substr(p, 5, 1)) || substr(p, 6) ELSE upper(substr(p, 1, 1)) || substr(p, 2) END, ' ' ORDER BY i) AS pretty
    FROM w GROUP BY id""")
def _(spark, sf):
    key = F.concat(F.lit("in-new-"), F.lower("c_mktsegment"), F.lit("-east_end-"), F.col("c_custkey").cast("string"), F.lit("x"))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), display.pretty_district(key).alias("pretty"))


@query("labels", ["complaints"], f"""
    SELECT id, {O.map_case('category', domain.CATEGORY_LABELS)} AS category, {O.map_case('status', domain.STATUS_LABELS)} AS status,
           {O.map_case("coalesce(classifiedBy, 'fallback')", domain.CLASSIFIER_LABELS)} AS classifier,
           {O.map_case('urgency', domain.URGENCY_LABELS)} AS urgency, {O.map_case('affectedScale', domain.SCALE_LABELS)} AS scale,
           {O.map_case('duration', domain.DURATION_LABELS)} AS duration FROM complaints""")
def _(spark, sf):
    return load(spark, sf, "complaints").select(
        "id", display.category_label(F.col("category")).alias("category"), display.status_label(F.col("status")).alias("status"),
        display.classifier_label(F.col("classifiedBy")).alias("classifier"), display.urgency_label(F.col("urgency")).alias("urgency"),
        display.scale_label(F.col("affectedScale")).alias("scale"), display.duration_label(F.col("duration")).alias("duration"),
    )


@query("recommendation_text", [], f"""
    SELECT l_orderkey, l_linenumber, 'Prioritize ' || {O.map_case('c', domain.PROJECT_PHRASES)} || '. ' || CAST(l_quantity AS BIGINT)
           || ' reports average severity ' || {O.one_decimal('l_extendedprice / 1000')} || ' and a priority score of ' || {O.one_decimal('l_quantity / 20')} || '.' AS recommendation
    FROM (SELECT *, ({domain.CATEGORIES})[l_orderkey % 11 + 1] AS c FROM lineitem)""")
def _(spark, sf):
    category = F.array(*[F.lit(c) for c in domain.CATEGORIES])[(F.col("l_orderkey") % 11).cast("int")]
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        display.recommendation_text(
            category, F.col("l_quantity").cast("long"), F.col("l_extendedprice") / 1000, F.col("l_quantity") / 20
        ).alias("recommendation"),
    )


@query("priority_display", [], """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 12 THEN 'High priority' WHEN l_quantity >= 5 THEN 'Medium priority' ELSE 'Lower priority' END AS tone,
           round(greatest(7, least(23, 6 + 2.2::DOUBLE * sqrt(l_quantity))), 9) AS radius, greatest(0.08::DOUBLE, least(1, l_quantity / 20)) AS ring FROM lineitem""")
def _(spark, sf):
    q = F.col("l_quantity")
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", display.priority_tone(q).alias("tone"),
        F.round(display.marker_radius(q), 9).alias("radius"), display.ring_progress(q).alias("ring"),
    )


@query("cursors", [], """
    SELECT p_partkey, replace(replace(rtrim(base64(encode(p_name || p_partkey)), '='), '+', '-'), '/', '_') AS encoded, p_name || p_partkey AS decoded FROM part""")
def _(spark, sf):
    value = F.concat("p_name", F.col("p_partkey").cast("string"))
    rows = load(spark, sf, "part").select("p_partkey", display.encode_cursor(value).alias("encoded"))
    return rows.withColumn("decoded", display.decode_cursor(F.col("encoded")))


# -- classification and ingestion ----------------------------------------------------


@query("sanitize_enrichment", ["model_json"], O.ENRICH + """
    SELECT id, category, severity, summary, tags, detectedLanguage, translatedText FROM model""")
def _(spark, sf):
    e = enrichment.sanitize_enrichment(load(spark, sf, "model_json")).select("id", "enrichment.*")
    return e.withColumn("tags", F.array_join("tags", "|"))


@query("merge_recommendations", ["complaints", "districts"], RANK_SQL + f""", said AS (
      SELECT 'd' || lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') AS d, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Plan ' || event_id END AS t, event_id
      FROM events),
    last AS (SELECT d, arg_max(t, event_id) AS t FROM said WHERE t <> '' AND d NOT IN ('d03', 'd04') GROUP BY d)
    SELECT districtId, coalesce(t, 'Prioritize ' || {O.map_case('topCategory', domain.PROJECT_PHRASES)} || '. ' || complaintCount || ' reports average severity '
           || {O.one_decimal('avgSeverity')} || ' and a priority score of ' || {O.one_decimal('priorityScore')} || '.') AS recommendation
    FROM scored LEFT JOIN last ON d = districtId""")
def _(spark, sf):
    key = F.format_string("d%02d", F.col("event_id") % 40)
    item = F.struct(
        F.when(~key.isin("d03", "d04"), key).alias("districtId"),
        F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" Plan "), F.col("event_id").cast("string"), F.lit(" "))).alias("recommendation"),
    )
    said = load(spark, sf, "events").select(
        F.col("event_id").alias("ord"), F.to_json(F.struct(F.array(item).alias("recommendations"))).alias("json")
    )
    scored = _rounded(_scored_rows(spark, sf), priorityScore=9, avgSeverity=9)
    return enrichment.merge_recommendations(scored, said).select("districtId", "recommendation")


def _enriched_texts(spark, sf):
    model = enrichment.sanitize_enrichment(load(spark, sf, "model_json")).select("id", "enrichment")
    return load_texts(spark, sf).join(model, "id", "left")


def _flat_classes(df):
    return df.select("id", "classification.*").select(
        "id", "category", "severity", F.md5("summary").alias("summary"), F.array_join("tags", "|").alias("tags"),
        F.md5("translatedText").alias("translated"), "detectedLanguage", "classifiedBy",
    )


_CLASSES = "SELECT id, category, severity, md5(summary) AS summary, tags, md5(translated) AS translated, detectedLanguage, classifiedBy FROM classes"


@query("classify_reports", ["texts", "model_json"], O.CLASSIFY + _CLASSES)
def _(spark, sf):
    return _flat_classes(classify.classify_reports(_enriched_texts(spark, sf)))


@query("classify_once_per_text", ["texts", "model_json"], O.CLASSIFY_PLAIN + _CLASSES)
def _(spark, sf):
    # Equal fingerprints may differ in case and spacing; compare over texts in normal form.
    rows = load_texts(spark, sf).withColumn("text", tx.collapse_spaces(F.lower("text")))
    return _flat_classes(classify.classify_once_per_text(rows))


@query("preview_category", ["texts"], O.KEYWORDS + """
    SELECT t.id, k.category, k.confidence, CASE WHEN k.category IS NOT NULL THEN 'trie' END AS classifiedBy
    FROM texts t LEFT JOIN keyword k USING (id) WHERE length(trim(t.text)) >= 15""")
def _(spark, sf):
    return classify.preview_category(load_texts(spark, sf).select("id", "text")).select(
        "id", "category", F.round("confidence", 6).alias("confidence"), "classifiedBy"
    )


_STORED = [
    "id", "userId", "status", "rawText", "detectedLanguage", "category", "classifiedBy", "severity", "districtId",
    "lat", "lng", "source", "userCategory", "stateName", "contactPhone", "isAnonymous", "referenceId",
]


@query("ingest_reports", ["submissions", "catalog", "districts", "district_rows"], O.INGEST)
def _(spark, sf):
    stored, _rejects, _districts = ingest.ingest_reports(
        _submissions(spark, sf).withColumn("photoUrls", F.lit(None).cast("array<string>")),
        load(spark, sf, "district_rows"), load(spark, sf, "catalog"),
    )
    return stored.select(*_STORED)


@query("hotspots_json", ["complaints", "districts"], O.HOTSPOTS + """
    SELECT 'hotspot' AS kind, districtId, complaintCount AS n FROM (SELECT * FROM ranked ORDER BY priorityScore DESC, districtId LIMIT 5)
    UNION ALL SELECT 'cluster', districtId, memberCount FROM enriched""")
def _(spark, sf):
    districts = load(spark, sf, "districts")
    placed = dist.assign_district(load(spark, sf, "complaints"), districts)
    lines = sinks.hotspots_json(*hot.hotspots(placed, districts))
    return lines.select(
        "kind", F.get_json_object("json", "$.districtId").alias("districtId"),
        F.coalesce(F.get_json_object("json", "$.complaintCount"), F.get_json_object("json", "$.memberCount")).cast("long").alias("n"),
    )


@query("stats_json", ["complaints", "districts"], _stats_sql(domain.COUNTED_LANGUAGES) + """
    SELECT (SELECT n FROM stats WHERE dimension = 'total') AS total, (SELECT n FROM stats WHERE dimension = 'category' AND key = 'roads') AS roads,
           (SELECT n FROM stats WHERE dimension = 'country' AND key = 'Unknown') AS unknown""")
def _(spark, sf):
    return sinks.stats_json(_stats_rows(spark, sf)).select(
        F.get_json_object("json", "$.totalComplaints").cast("long").alias("total"),
        F.get_json_object("json", "$.categories.roads").cast("long").alias("roads"),
        F.get_json_object("json", "$.countries.Unknown").cast("long").alias("unknown"),
    )


def _written_reports(spark, sf) -> str:
    """The reports view as JSON lines, written in files of at most 500 rows."""
    path = f"{Workspace(spark).root}/reports"
    sinks.write_batched(load(spark, sf, "complaints").drop("ord", "district"), path, fmt="json")
    return path


@query("read_complaints", ["complaints"], """
    SELECT id, category, coalesce(districtId, '') AS districtId, CAST(severity AS DOUBLE) AS severity, lat, lng, userId, status FROM complaints""")
def _(spark, sf):
    rows = tables.read_complaints(spark, _written_reports(spark, sf), "json-lines")
    return rows.select("id", "category", "districtId", "severity", "lat", "lng", "userId", "status")


@query("write_batched", ["complaints"], "SELECT count(*) AS n, true AS in_batches FROM complaints")
def _(spark, sf):
    files = spark.read.json(_written_reports(spark, sf)).groupBy(F.input_file_name().alias("file")).count()
    return files.agg(F.sum("count").alias("n"), F.bool_and(F.col("count") <= sinks.MAX_BATCH).alias("in_batches"))


# -- streams: the same results from a file stream over the events table ---------------


#: Rows from which on a micro-batch comes in several files.
_FILE_ROWS = 25_000


def _stream(spark, sf, view: str | None = None, batches: int = 1) -> DataFrame:
    """The events table, or a view over it, as a stream of so many micro-batches in event order."""
    events = load(spark, sf, "events")
    if batches == 1:
        source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    else:
        folder = f"{Workspace(spark).root}/events"
        size = events.agg(F.max("event_id").alias("last"), F.count("*").alias("rows")).first()
        # One file, hence one task, for a small batch only.
        files = max(1, min(spark.sparkContext.defaultParallelism, size.rows // (batches * _FILE_ROWS)))
        for i in range(batches):
            # Files are taken in the order in which they were written.
            part = events.filter(F.floor(F.col("event_id") * batches / ((size.last or 0) + 1)) == i)
            part.repartition(files).write.mode("append").parquet(folder)
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return spark.sql(VIEWS[view], events=source) if view else source


@query("stream_ingest", ["submissions", "catalog", "districts", "district_rows"], O.INGEST)
def _(spark, sf):
    root = Workspace(spark).root
    rows = _stream(spark, sf, "submissions").withColumn("photoUrls", F.lit(None).cast("array<string>"))
    streams.stream_ingest(
        rows, load(spark, sf, "district_rows"), load(spark, sf, "catalog"), f"{root}/stored", f"{root}/rejects", f"{root}/log"
    ).awaitTermination()
    return streams.read_batches(spark, f"{root}/stored", domain.COMPLAINT).select(*_STORED)


@query("stream_stats", ["complaints", "districts"], _stats_sql(domain.COUNTED_LANGUAGES).replace(
    "CASE WHEN ord % 101 = 7 THEN 'noise' WHEN ord % 10 = 3 THEN 'drainage' ELSE category END AS category", "category"
) + "SELECT * FROM stats")
def _(spark, sf):
    root = Workspace(spark).root
    streams.stream_stats(
        _stream(spark, sf, "complaints"), load(spark, sf, "districts"), f"{root}/stats", f"{root}/log"
    ).awaitTermination()
    return streams.latest_batch(spark, f"{root}/stats").select("dimension", "key", "n")


@query("stream_hotspots", ["complaints", "districts"], O.HOTSPOTS_GIVEN + """
    SELECT districtId, priorityScore, topCategory, complaintCount, avgSeverity FROM ranked ORDER BY priorityScore DESC, districtId LIMIT 5""")
def _(spark, sf):
    root = Workspace(spark).root
    streams.stream_hotspots(
        _stream(spark, sf, "complaints", 3), load(spark, sf, "districts"), f"{root}/stored", f"{root}/ranked",
        f"{root}/clusters", f"{root}/log", every=None, buckets=16,
    ).awaitTermination()
    ranked = streams.latest_batch(spark, f"{root}/ranked")
    return _rounded(
        ranked.select("districtId", "priorityScore", "topCategory", "complaintCount", "avgSeverity"), priorityScore=9, avgSeverity=9
    )


@query("stream_status", ["status_events", "complaints"], """--cte ok AS (
      SELECT coalesce(c.id, r.id) AS complaintId, seq, updatedAt, e.status, adminId, CASE WHEN trim(note) <> '' THEN trim(note) END AS note
      FROM status_events e LEFT JOIN complaints c ON c.id = e.complaintId
      LEFT JOIN (SELECT referenceId, min(id) AS id FROM complaints GROUP BY referenceId) r ON r.referenceId = e.complaintId
      WHERE e.status IN ('submitted', 'reviewing', 'in_progress', 'resolved') AND (note IS NULL OR length(trim(note)) <= 500)
        AND coalesce(c.id, r.id) IS NOT NULL),
    d AS (SELECT complaintId, updatedAt, status, adminId, note, max(seq) AS seq FROM ok GROUP BY ALL)
    SELECT complaintId, arg_max(status, (updatedAt, seq)) AS status, arg_max(note, (updatedAt, seq)) FILTER (WHERE note IS NOT NULL) AS adminNote,
           epoch_us(max(updatedAt)) AS updatedUs, CAST(count(*) AS INTEGER) AS entries FROM d GROUP BY complaintId""")
def _(spark, sf):
    kept = _streamed_status(spark, sf)
    entries = kept.history().groupBy("complaintId").agg(F.count("*").cast("int").alias("entries"))
    return kept.current().join(entries, "complaintId").select(
        "complaintId", "status", "adminNote", F.unix_micros("updatedAt").alias("updatedUs"), "entries"
    )


def _streamed_status(spark, sf) -> status.StatusStore:
    root = Workspace(spark).root
    status.stream_status(
        _stream(spark, sf, "status_events", 3), load(spark, sf, "complaints"), f"{root}/status", f"{root}/log", buckets=16
    ).awaitTermination()
    return status.StatusStore(spark, f"{root}/status")


@query("stream_status_rejects", ["status_events", "complaints"], """
    SELECT complaintId, seq, reason FROM (
      SELECT e.complaintId, seq, CASE WHEN e.status IS NULL OR e.status NOT IN ('submitted', 'reviewing', 'in_progress', 'resolved') THEN 'status'
             WHEN length(note) > 500 THEN 'note' WHEN c.id IS NULL AND r.referenceId IS NULL THEN 'complaintId' END AS reason
      FROM status_events e LEFT JOIN complaints c ON c.id = e.complaintId
      LEFT JOIN (SELECT DISTINCT referenceId FROM complaints) r ON r.referenceId = e.complaintId) WHERE reason IS NOT NULL""")
def _(spark, sf):
    return _streamed_status(spark, sf).rejected().select("complaintId", "seq", "reason")


@query("stream_upsert", [], SQL["upsert_complaints"])
def _(spark, sf):
    root, schema = Workspace(spark).root, "id string, ord long, category string"
    rows = _stream(spark, sf, "complaints", 3).filter("userId IS NOT NULL").select(F.col("userId").alias("id"), "ord", "category")
    upsert.stream_upsert(rows, f"{root}/rows", schema, "ord", f"{root}/log", buckets=16).awaitTermination()
    return upsert.UpsertStore(spark, f"{root}/rows", schema, "ord", buckets=16).read()


@query("stream_token_bucket", [], SQL["token_bucket"])
def _(spark, sf):
    root = Workspace(spark).root
    flags = stateful.stream_token_bucket(
        _stream(spark, sf, batches=4).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "event_id", 3.0, _RATE
    )
    flags.writeStream.format("parquet").option("path", f"{root}/flags").option("checkpointLocation", f"{root}/log").trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(f"{root}/flags").select("user_id", "event_id", "allowed")
