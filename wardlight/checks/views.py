"""Report tables derived from the supplied tables with integer arithmetic.

Each view is one SQL text that Spark and DuckDB read alike; ``{name}`` stands for a
source table or another view.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from wardlight import domain

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Report texts: dictionary words in several languages, nested and repeated phrases, ties, none.
SENTENCES = [
    "The road is broken and the road is full of potholes.",
    "No water since Monday, the tap is dry",
    "The streetlight is not working near the clinic.",
    "O buraco na estrada é grande, há lixo e esgoto",
    "Вода и свет: дорога, дороги, яма",
    "Nothing to report here.",
    "hospital road hospital road",
    "Sem internet e sem energia; internet!",
    "Road par bade gadhe hain, gaadi nikalna mushkil hai",
    "wifi-router/broadband (POWER outage) 24x7",
    "railroad tapwater powerful internets",
    "мусор мусор больница",
    "A água está suja. Saúde pública em risco",
    "kab hoga",
]


def case_list(key: str, values: list[str | None]) -> str:
    def literal(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    arms = " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values))
    return f"CASE {key} {arms} END"


def _micro(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE) / CAST(1000000 AS DOUBLE)"


def _pad2(expr: str) -> str:
    return f"lpad(CAST({expr} AS STRING), 2, '0')"


_SLUG = "lower(replace(n_name, '_', '-'))"

VIEWS: dict[str, str] = {
    "districts": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS ord, 'd' || {_pad2('n_nationkey')} AS id, n_name AS name,
               CASE WHEN r_name = 'ASIA' THEN 'India' ELSE r_name END AS country,
               CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE 'State ' || CAST(n_regionkey AS STRING) END AS state,
               {_micro('CAST(n_nationkey AS BIGINT) * 4000000 - 49800000')} AS lat,
               {_micro('CAST(n_nationkey AS BIGINT) * 13000000 - 159800000')} AS lng,
               CAST(50 + (n_nationkey % 10) * 75 AS DOUBLE) / CAST(100 AS DOUBLE) AS infraScore,
               CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE CAST(n_nationkey AS BIGINT) * 1000 + 5 END AS population
        FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey""",
    "catalog": f"""
        SELECT 's' || CAST(n_regionkey AS STRING) || '__' || {_SLUG} AS districtId,
               CASE WHEN n_nationkey % 5 = 1 THEN n_name || ' District' ELSE n_name END AS districtName,
               CAST(600 + n_nationkey AS STRING) AS lgdCode, 's' || CAST(n_regionkey AS STRING) AS stateId,
               'State ' || CAST(n_regionkey AS STRING) AS stateName,
               CASE WHEN n_regionkey < 4 THEN 'state' ELSE 'union-territory' END AS kind
        FROM {{nation}}""",
    "complaints": f"""
        SELECT e AS ord, 'c' || CAST(e AS STRING) AS id, g % 25 AS district,
               {case_list('g % 6', domain.MODEL_CATEGORIES)} AS category,
               CASE WHEN e % 7 = 3 THEN NULL WHEN e % 97 = 0 THEN 'zz' ELSE 'd' || {_pad2('g % 25')} END AS districtId,
               CAST(e % 5 + 1 AS INT) AS severity,
               {_micro('(g % 25) * 4000000 - 50000000 + (k * 7919 % 40009) * 10 + CASE WHEN e % 5 = 4 THEN 100 ELSE 0 END')} AS lat,
               {_micro('(g % 25) * 13000000 - 160000000 + (k * 104729 % 40009) * 10')} AS lng,
               CASE WHEN e % 13 = 0 THEN NULL ELSE 'u' || CAST(user_id AS STRING) END AS userId,
               CAST(ts AS TIMESTAMP) AS timestamp,
               {case_list('e % 4', domain.STATUSES)} AS status,
               {case_list(f'g % {len(SENTENCES)}', SENTENCES)} AS rawText,
               {case_list('g % 15', [*domain.LANGUAGES, 'xx'])} AS detectedLanguage,
               {case_list('e % 5', ['user', 'trie', 'model', 'fallback', None])} AS classifiedBy,
               {case_list('e % 3', domain.SOURCES)} AS source,
               {case_list('e % 5', [*domain.URGENCIES, None])} AS urgency,
               {case_list('g % 5', [*domain.DURATIONS, None])} AS duration,
               {case_list('CAST(floor(e / 25) AS BIGINT) % 5', [*domain.SCALES, None])} AS affectedScale,
               CASE WHEN e % 3 = 0 THEN '98765' || lpad(CAST(e % 100000 AS STRING), 5, '0') END AS contactPhone,
               e % 4 = 1 AS isAnonymous,
               CASE WHEN e % 9 = 0 THEN NULL ELSE 'CP-2024-' || lpad(CAST(e % 1000000 AS STRING), 6, '0') END AS referenceId
        FROM (SELECT event_id AS e, CAST(floor(event_id / 5) AS BIGINT) AS g,
                     CASE WHEN event_id % 5 = 4 THEN event_id - 1 ELSE event_id END AS k, user_id, ts
              FROM {{events}}) b""",
    # One chosen catalog district has a row, under an old name and state; the other has none.
    "district_rows": """
        SELECT id, name, country, state, lat, lng, infraScore, population FROM {districts}
        UNION ALL SELECT 's1__nation-1', 'Old name', 'India', 'Old state', CAST(12 AS DOUBLE), CAST(77 AS DOUBLE), CAST(4 AS DOUBLE), NULL""",
    "points": f"""
        SELECT c_custkey AS id, {_micro('(c_custkey * 7919017 % 179990003) - 89995000')} AS lat,
               {_micro('(c_custkey * 104729011 % 359980013) - 179990000')} AS lng
        FROM {{customer}}""",
    "texts": f"""
        SELECT doc_id AS id,
               CASE doc_id % 4 WHEN 0 THEN s || ' ' || text WHEN 1 THEN text WHEN 2 THEN s || ' / ' || text ELSE text || ' -- ' || s END AS text,
               {case_list('CAST(floor(doc_id / 4) AS BIGINT) % 6', [None, 'mr', 'hi', 'en', None, 'pt'])} AS language,
               CASE WHEN doc_id % 10 = 7 THEN 'safety' END AS userCategory
        FROM (SELECT doc_id, text, {case_list(f'CAST(floor(doc_id / 2) AS BIGINT) % {len(SENTENCES)}', SENTENCES)} AS s
              FROM {{documents}}) d""",
    "submissions": f"""
        SELECT 'n' || CAST(e AS STRING) AS id, e AS ord, 'u' || CAST(user_id AS STRING) AS userId,
               CAST(ts AS TIMESTAMP) AS timestamp,
               CASE WHEN e % 53 = 0 THEN '   ' WHEN e % 211 = 1 THEN repeat('x', 5001)
                    WHEN e % 59 = 0 THEN NULL ELSE ' ' || {case_list(f'g % {len(SENTENCES)}', SENTENCES)} || ' ' END AS text,
               CASE WHEN e % 37 = 0 THEN '91' WHEN e % 41 = 0 THEN ' ' WHEN e % 43 = 0 THEN 'abc'
                    ELSE CAST((e * 7919) % 178 - 89 AS STRING) || '.25' END AS lat,
               CASE WHEN e % 47 = 0 THEN '-181' ELSE CAST((e * 104729) % 358 - 179 AS STRING) || '.5' END AS lng,
               CASE WHEN e % 31 = 0 THEN 'fax' WHEN e % 4 = 3 THEN NULL ELSE {case_list('e % 3', domain.SOURCES)} END AS source,
               CASE WHEN e % 61 = 0 THEN 'zh' WHEN e % 3 = 0 THEN NULL ELSE {case_list('g % 14', domain.LANGUAGES)} END AS language,
               CASE WHEN e % 67 = 0 THEN 'noise' WHEN e % 5 = 0 THEN {case_list('g % 11', domain.CATEGORIES)} END AS userCategory,
               CASE WHEN e % 71 = 0 THEN 'soon' ELSE {case_list('e % 5', [*domain.URGENCIES, None])} END AS urgency,
               CASE WHEN e % 73 = 0 THEN 'long' ELSE {case_list('g % 5', [*domain.DURATIONS, None])} END AS duration,
               CASE WHEN e % 79 = 0 THEN 'all' ELSE {case_list('CAST(floor(e / 25) AS BIGINT) % 5', [*domain.SCALES, None])} END AS affectedScale,
               CASE WHEN e % 83 = 0 THEN repeat('l', 201) WHEN e % 6 = 0 THEN 'near ' || CAST(e AS STRING) END AS landmark,
               CASE WHEN e % 89 = 0 THEN '12345' WHEN e % 2 = 0 THEN '98765' || lpad(CAST(e % 100000 AS STRING), 5, '0') END AS contactPhone,
               CASE WHEN e % 101 = 0 THEN 'Nowhere' WHEN e % 3 = 1 THEN 'STATE ' || CAST(e % 5 AS STRING) END AS stateName,
               CASE WHEN e % 103 = 0 THEN 'nope' WHEN e % 16 = 0 THEN 's0__nation-0' WHEN e % 16 = 8 THEN 's1__nation-1' END AS districtId,
               CAST(CASE WHEN e % 107 = 0 THEN 4 ELSE e % 4 END AS INT) AS photoCount,
               e % 4 = 1 AS isAnonymous
        FROM (SELECT event_id AS e, CAST(floor(event_id / 5) AS BIGINT) AS g, user_id, ts FROM {{events}}) b""",
    "model_json": """
        SELECT e AS id,
               CASE WHEN e % 17 = 0 THEN '{{"category": "roads", ' WHEN e % 19 = 0 THEN '[1, 2]'
                    ELSE '{{"category": "' || category || '", "severity": ' || severity
                         || ', "summary": "' || repeat('s', CAST(e % 3 AS INT) * 260) || ' case ' || CAST(e AS STRING)
                         || '", "tags": ' || tags || ', "detectedLanguage": "' || lang
                         || '", "translatedText": "text ' || CAST(e AS STRING) || '"}}' END AS json
        FROM (SELECT event_id AS e,
                     CASE event_id % 8 WHEN 0 THEN 'roads' WHEN 1 THEN 'water' WHEN 2 THEN 'safety' WHEN 3 THEN 'internet'
                          ELSE 'sanitation' END AS category,
                     CASE event_id % 7 WHEN 0 THEN '0' WHEN 1 THEN '2.5' WHEN 2 THEN '9' WHEN 3 THEN '"3"' WHEN 4 THEN '4.4'
                          WHEN 5 THEN '1' ELSE 'null' END AS severity,
                     CASE event_id % 5 WHEN 0 THEN '["a", " b ", "c", "d", "e", "f"]' WHEN 1 THEN '[]' WHEN 2 THEN '["x", 1]'
                          WHEN 3 THEN '["' || repeat('t', 50) || '"]' ELSE '"none"' END AS tags,
                     CASE event_id % 3 WHEN 0 THEN 'hi-IN' WHEN 1 THEN 'en-IN' ELSE CASE WHEN event_id % 2 = 0 THEN 'fr-FR' ELSE 'ru-RU' END END AS lang
              FROM {events}) b""",
    "status_events": f"""
        SELECT CASE WHEN e % 50 = 0 THEN 'zz' || CAST(e AS STRING) WHEN e % 7 = 2 THEN 'CP-2024-' || lpad(CAST(CAST(floor(e / 4) AS BIGINT) % 1000000 AS STRING), 6, '0')
                    ELSE 'c' || CAST(CAST(floor(e / 4) AS BIGINT) AS STRING) END AS complaintId,
               e AS seq, CAST(ts AS TIMESTAMP) AS updatedAt,
               CASE WHEN e % 29 = 0 THEN 'lost' ELSE {case_list('e % 4', domain.STATUSES)} END AS status,
               'a' || CAST(e % 3 AS STRING) AS adminId,
               CASE WHEN e % 6 = 0 THEN ' note ' || CAST(e AS STRING) || ' ' WHEN e % 6 = 1 THEN '  '
                    WHEN e % 31 = 2 THEN repeat('n', 501) END AS note
        FROM (SELECT event_id AS e, ts FROM {{events}}
              UNION ALL SELECT event_id AS e, ts FROM {{events}} WHERE event_id % 10 = 3) b""",
    "addresses": """
        SELECT CAST(c_custkey AS BIGINT) AS pointId, CAST(c_custkey % 90 AS DOUBLE) AS lat, CAST(c_custkey % 180 AS DOUBLE) AS lng,
               CASE WHEN c_custkey % 11 = 0 THEN 'us' ELSE 'in' END AS country_code,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE ' STATE--' || CAST(c_nationkey % 5 AS STRING) END AS state,
               CASE WHEN c_custkey % 3 = 0 THEN 'Unheard of' END AS state_district,
               CASE WHEN c_custkey % 5 = 0 THEN 'NATION ' || CAST(c_nationkey AS STRING) || ' District' END AS district,
               CASE WHEN c_custkey % 2 = 0 THEN 'nation-' || CAST((c_nationkey + 4) % 25 AS STRING) END AS county,
               CASE WHEN c_custkey % 7 = 0 THEN 'NATION--' || CAST((c_nationkey + 10) % 25 AS STRING) END AS city_district,
               CASE WHEN c_custkey % 3 = 1 THEN 'nation ' || CAST((c_nationkey + 15) % 25 AS STRING) || ' district' END AS municipality,
               CASE WHEN c_custkey % 4 <> 1 THEN 'Nation_' || CAST(c_nationkey AS STRING) END AS city,
               CASE WHEN c_custkey % 8 = 1 THEN 'Nation ' || CAST(c_nationkey AS STRING) END AS town
        FROM {customer}""",
    "district_docs": f"""
        SELECT s_suppkey AS ord,
               CASE WHEN s_suppkey % 5 = 4 THEN catalog_id ELSE 'doc-' || CAST(s_suppkey AS STRING) END AS docId,
               CASE s_suppkey % 3 WHEN 0 THEN catalog_id WHEN 1 THEN 'legacy-' || CAST(n_nationkey AS STRING)
                    ELSE 'other-' || CAST(s_suppkey AS STRING) END AS id,
               CASE s_suppkey % 3 WHEN 1 THEN lower(n_name) WHEN 0 THEN 'Old name' ELSE s_name END AS name,
               'X' AS country, CASE WHEN s_suppkey % 3 = 2 AND s_suppkey % 2 = 0 THEN NULL ELSE 'STATE ' || CAST(n_regionkey AS STRING) END AS state,
               CAST(s_suppkey % 90 AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lng,
               CAST(s_suppkey % 9 AS DOUBLE) AS infraScore, s_suppkey AS population
        FROM (SELECT s_suppkey, s_name, n_nationkey, n_name, n_regionkey,
                     's' || CAST(n_regionkey AS STRING) || '__' || {_SLUG} AS catalog_id
              FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey) b""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table or a derived view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    text = VIEWS[name]
    used = {t: load(spark, sf_dir, t) for t in [*TABLES, *VIEWS] if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_views(names: list[str], query: str) -> str:
    """Prefix a DuckDB query with the derived views it uses as common table expressions."""
    plain = {t: t for t in [*TABLES, *VIEWS]}
    ctes = [f"{n} AS ({VIEWS[n].format(**plain)})" for n in names]
    if query.lstrip().startswith("--cte"):
        # The query goes on with its own expressions.
        return "WITH RECURSIVE " + ", ".join([*ctes, query.replace("--cte", "", 1)])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + query
