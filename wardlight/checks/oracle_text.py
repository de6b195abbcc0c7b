"""Shared pieces of the DuckDB queries that check the operators."""

from __future__ import annotations

import math

from wardlight import domain
from wardlight.sources.seed import SEED_SENTENCES

R = "6371008.8::DOUBLE"
CHORD_1500 = repr(2 * math.sin(1500.0 / 6371008.8 / 2)) + "::DOUBLE"
_CHORD_SQ_1500 = repr((2 * math.sin(1500.0 / 6371008.8 / 2)) ** 2) + "::DOUBLE"


def haversine(a: str, b: str) -> str:
    h = (
        f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat))"
        f" * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)"
    )
    return f"(2 * {R} * asin(sqrt(least(1, {h}))))"


def chord_sq(a: str, b: str) -> str:
    def xyz(t):
        return (
            f"cos(radians({t}.lat)) * cos(radians({t}.lng))", f"cos(radians({t}.lat)) * sin(radians({t}.lng))",
            f"sin(radians({t}.lat))",
        )

    return "(" + " + ".join(f"pow({p} - {q}, 2)" for p, q in zip(xyz(a), xyz(b))) + ")"


def planar(a: str, b: str) -> str:
    return f"(pow({a}.lat - {b}.lat, 2) + pow(({a}.lng - {b}.lng) * cos(radians({a}.lat)), 2))"


def map_case(expr: str, labels: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


def summary(text: str, longest: int) -> str:
    clean = f"regexp_replace(trim(regexp_replace({text}, '\\s+', ' ', 'g')), ' +', ' ', 'g')"
    return f"CASE WHEN length({clean}) > {longest} THEN substr({clean}, 1, {longest - 3}) || '…' ELSE {clean} END"


def one_decimal(x: str) -> str:
    # printf works on the exact value; only exact ties (k + 0.25, k + 0.75) must be lifted.
    return f"(CASE WHEN ({x}) * 4 = floor(({x}) * 4) AND ({x}) * 2 <> floor(({x}) * 2) THEN printf('%.1f', ({x}) + 0.01) ELSE printf('%.1f', {x}) END)"


# Pairs are sought inside the derived district boxes only, which lie far apart.
DEDUP = f"""--cte close AS (
      SELECT a.ord AS a, b.ord AS b FROM complaints a JOIN complaints b
        ON a.district = b.district AND a.category = b.category AND a.ord <> b.ord
      WHERE abs(a.lat - b.lat) < 0.001 AND {haversine('a', 'b')} <= 50),
    reach(node, other) AS (
      SELECT a, a FROM close UNION SELECT reach.node, close.b FROM reach JOIN close ON reach.other = close.a),
    uniq AS (SELECT * FROM complaints WHERE ord NOT IN (SELECT node FROM reach GROUP BY node HAVING min(other) < node))
    """

DBSCAN = DEDUP + f""", near AS (
      SELECT a.ord AS a, b.ord AS b FROM uniq a JOIN uniq b ON a.district = b.district
      WHERE abs(a.lat - b.lat) < 0.02 AND {chord_sq('a', 'b')} <= {_CHORD_SQ_1500}),
    cores AS (SELECT a AS ord FROM near GROUP BY a HAVING count(*) >= 3),
    links AS (SELECT a, b FROM near WHERE a IN (SELECT ord FROM cores) AND b IN (SELECT ord FROM cores)),
    comp(node, other) AS (
      SELECT ord, ord FROM cores UNION SELECT comp.node, links.b FROM comp JOIN links ON comp.other = links.a),
    lab AS (SELECT node AS ord, min(other) AS label FROM comp GROUP BY node),
    ranks AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS clusterId FROM (SELECT DISTINCT label FROM lab)),
    labelled AS (
      SELECT ord, label, true AS core FROM lab
      UNION ALL SELECT near.a, min(lab.label), false FROM near JOIN lab ON lab.ord = near.b
        WHERE near.a NOT IN (SELECT ord FROM cores) GROUP BY near.a),
    members AS (SELECT ord, clusterId, core FROM labelled JOIN ranks USING (label)),
    clusters AS (SELECT clusterId, round(avg(lat), 9) AS lat, round(avg(lng), 9) AS lng, count(*) AS memberCount
                 FROM members JOIN uniq USING (ord) GROUP BY clusterId)
    """

_NEAREST = f"""
      SELECT c.id, arg_min(d.id, ({chord_sq('c', 'd')}, d.id)) AS near FROM {{rows}} c CROSS JOIN districts d GROUP BY c.id"""

ASSIGN = f"""--cte nearby AS ({_NEAREST.format(rows='complaints')}),
    placed AS (
      SELECT c.* EXCLUDE (districtId), coalesce(d.id, n.near) AS districtId, (SELECT state FROM districts x WHERE x.id = coalesce(d.id, n.near)) AS stateName
      FROM complaints c LEFT JOIN districts d ON d.id = c.districtId LEFT JOIN nearby n ON n.id = c.id)
    """

_FIGURES = """(SELECT districtId, count(*) AS complaintCount, CAST(sum(severity) AS DOUBLE) AS total,
                 arg_min(category, (-n, category)) AS topCategory
          FROM (SELECT *, count(*) OVER (PARTITION BY districtId, category) AS n FROM {rows}) GROUP BY districtId)"""

HOTSPOTS = ASSIGN + "," + DBSCAN.replace("--cte", "", 1) + f""", best AS (
      SELECT id, name, country, lat, lng, complaintCount, topCategory, total / complaintCount AS mean,
             complaintCount * (total / complaintCount) / greatest(infraScore, 1.0::DOUBLE) AS score
      FROM {_FIGURES.format(rows="(SELECT p.* FROM placed p WHERE ord IN (SELECT ord FROM uniq))")} f JOIN districts ON id = districtId),
    ranked AS (
      SELECT id AS districtId, name AS districtName, country, lat, lng, round(score, 9) AS priorityScore, topCategory,
             complaintCount, round(mean, 9) AS avgSeverity,
             'Prioritize ' || {map_case('topCategory', domain.PROJECT_PHRASES)} || '. ' || complaintCount || ' reports average severity '
               || {one_decimal('mean')} || ' and a priority score of ' || {one_decimal('score')} || '.' AS recommendation
      FROM best),
    homes AS (SELECT c.clusterId, arg_min(d.id, ({planar('c', 'd')}, d.ord)) AS districtId FROM clusters c CROSS JOIN districts d GROUP BY c.clusterId),
    enriched AS (
      SELECT clusterId, h.districtId, d.name AS districtName, d.country, c.lat, c.lng, memberCount,
             round(complaintCount * (total / complaintCount) / greatest(infraScore, 1.0::DOUBLE), 9) AS priorityScore,
             round(total / complaintCount, 9) AS avgSeverity, topCategory
      FROM clusters c JOIN homes h USING (clusterId) JOIN districts d ON d.id = h.districtId
      JOIN {_FIGURES.format(rows='placed')} f ON f.districtId = h.districtId)
    """

# The same over reports whose district is taken as given.
HOTSPOTS_GIVEN = "--cte placed AS (SELECT * FROM complaints)," + HOTSPOTS[len(ASSIGN) + 1:]

_SEED_LISTS = "[" + ", ".join(
    "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in group) + "]" for group in SEED_SENTENCES.values()
) + "]"
SEED_TEXT = f"({_SEED_LISTS})[(c_custkey + i) % 4 + 1][(c_custkey + i) % 6 + 1]"
SEED_ENGLISH = f"({_SEED_LISTS})[1][(c_custkey + i) % 6 + 1]"


def _level(column: str, five: str, four: str, two: str) -> str:
    return f"CASE {column} WHEN '{five}' THEN 5 WHEN '{four}' THEN 4 WHEN '{two}' THEN 2 ELSE 1 END"


def severity(base: str) -> str:
    total = (
        f"0.4::DOUBLE * {base} + 0.3::DOUBLE * ({_level('urgency', 'emergency', 'high', 'medium')})"
        f" + 0.2::DOUBLE * ({_level('affectedScale', 'wide_area', 'neighbourhood', 'street')})"
        f" + 0.1::DOUBLE * ({_level('duration', 'over_6_months', '1_to_6_months', '1_to_4_weeks')})"
    )
    return (
        f"CASE WHEN coalesce(urgency, affectedScale, duration) IS NULL THEN {base} "
        f"ELSE CAST(greatest(1, least(5, floor({total} + 0.5::DOUBLE))) AS INTEGER) END"
    )


def _in(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


VALIDATE = f"""--cte checked AS (
      SELECT * EXCLUDE (text, lat, lng), trim(text) AS text,
             CASE WHEN abs(TRY_CAST(lat AS DOUBLE)) <= 90 THEN TRY_CAST(lat AS DOUBLE) END AS lat,
             CASE WHEN abs(TRY_CAST(lng AS DOUBLE)) <= 180 THEN TRY_CAST(lng AS DOUBLE) END AS lng,
             list_filter([
               CASE WHEN text IS NULL OR trim(text) = '' OR length(text) > 5000 THEN 'text' END,
               CASE WHEN abs(TRY_CAST(lat AS DOUBLE)) <= 90 THEN NULL ELSE 'lat' END,
               CASE WHEN abs(TRY_CAST(lng AS DOUBLE)) <= 180 THEN NULL ELSE 'lng' END,
               CASE WHEN NOT {_in('source', domain.SOURCES)} THEN 'source' END,
               CASE WHEN NOT {_in('language', domain.LANGUAGES)} THEN 'language' END,
               CASE WHEN NOT {_in('userCategory', domain.CATEGORIES)} THEN 'userCategory' END,
               CASE WHEN NOT {_in('urgency', domain.URGENCIES)} THEN 'urgency' END,
               CASE WHEN NOT {_in('duration', domain.DURATIONS)} THEN 'duration' END,
               CASE WHEN NOT {_in('affectedScale', domain.SCALES)} THEN 'affectedScale' END,
               CASE WHEN length(landmark) > 200 THEN 'landmark' END,
               CASE WHEN NOT regexp_full_match(contactPhone, '[6-9][0-9]{{9}}') THEN 'contactPhone' END,
               CASE WHEN lower(stateName) NOT IN (SELECT lower(stateName) FROM catalog) THEN 'stateName' END,
               CASE WHEN districtId NOT IN (SELECT districtId FROM catalog) THEN 'districtId' END,
               CASE WHEN photoCount > 3 THEN 'photos' END], lambda x: x IS NOT NULL) AS errors
      FROM submissions)
    """

# -- text: dictionary terms without combining marks, found between doubled blanks ----


def _plain(term: str) -> bool:
    return all(ord(c) < 0x0530 for c in term)


_TERM_ROWS, _seen = [], set()
for _n, (_phrase, _category, _language) in enumerate(domain.KEYWORDS):
    if _plain(_phrase) and _phrase not in _seen:
        _seen.add(_phrase)
        _TERM_ROWS.append(f"('{_phrase}', '{_category}', '{_language}')")


def _keywords(source: str) -> str:
    # Words are separated by two blanks; a term owns one blank on each side, so
    # neighbouring hits do not overlap and every replace removes exactly one hit.
    return f"""words AS (
      SELECT id, ' ' || regexp_replace(lower(nfc_normalize(text)), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ' AS w FROM {source}),
    terms AS (SELECT phrase, category, language, ' ' || replace(phrase, ' ', '  ') || ' ' AS t
              FROM (VALUES {', '.join(_TERM_ROWS)}) v(phrase, category, language)),
    found AS (
      SELECT id, phrase, category, language, length(phrase) AS len,
             CAST((length(w) - length(replace(w, t, ''))) / length(t) AS BIGINT) AS n, strpos(w, t) AS first,
             length(w) - strpos(reverse(w), reverse(t)) - length(t) + 2 AS final
      FROM words JOIN terms ON contains(w, t)),
    per_category AS (SELECT id, category, sum(n) AS n, min((first, len)) AS opened, arg_max(phrase, (final, len)) AS last FROM found GROUP BY id, category),
    per_language AS (SELECT id, language, sum(n) AS n, min((first, len)) AS opened FROM found GROUP BY id, language),
    keyword AS (
      SELECT id, category, language, round(least(0.99::DOUBLE, 0.88::DOUBLE + (n - 1) * 0.04::DOUBLE), 6) AS confidence,
             'Citizen reported a ' || category || ' issue (' || last || ').' AS summary
      FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, opened) AS r FROM per_category) c
      JOIN (SELECT id, language FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, opened) AS r FROM per_language) WHERE r = 1) l USING (id)
      WHERE c.r = 1)
    """


KEYWORDS = "--cte " + _keywords("texts")

_HINDI = "[" + ", ".join(f"'{w}'" for w in domain.ROMANISED_HINDI) + "]"


def _script(source: str) -> str:
    # No supplied text holds Indic letters, so Latin letters decide alone.
    return f"""script_counts AS (
      SELECT id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, regexp_extract_all(lower(text), '[a-z]+') AS tokens FROM {source}),
    script_hits AS (SELECT *, len(list_filter(tokens, lambda t: list_contains({_HINDI}, t))) AS hits FROM script_counts),
    script AS (
      SELECT id, CASE WHEN latin THEN 'hi-Latn' ELSE 'en' END AS code, CASE WHEN latin THEN 'Hinglish' ELSE 'English' END AS label,
             CASE WHEN letters = 0 THEN 0 WHEN latin THEN hits / len(tokens)::DOUBLE ELSE 1 END AS confidence
      FROM (SELECT *, letters > 0 AND hits >= greatest(2, ceil(len(tokens) * 0.25::DOUBLE)) AS latin FROM script_hits))
    """


SCRIPT = "--cte " + _script("texts")
KEYWORDS_SCRIPT = KEYWORDS + ", " + _script("texts")

# -- classification ------------------------------------------------------------------

_MODEL = f"""parsed AS (
      SELECT id, CASE WHEN json_valid(json) THEN json::JSON END AS j FROM model_json),
    fields AS (
      SELECT id, j ->> '$.category' AS category, TRY_CAST(j ->> '$.severity' AS DOUBLE) AS severity, json_type(j, '$.severity') AS st,
             j ->> '$.summary' AS summary, json_type(j, '$.tags') AS tt, CAST(j -> '$.tags[*]' AS JSON[]) AS tags,
             {map_case("j ->> '$.detectedLanguage'", domain.MODEL_LANGUAGE_TAGS)} AS detectedLanguage, j ->> '$.translatedText' AS translatedText
      FROM parsed),
    sound AS (
      SELECT * FROM fields
      WHERE {_in('category', domain.MODEL_CATEGORIES)} AND st IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND tt = 'ARRAY'
        AND len(list_filter(tags, lambda x: json_type(x) <> 'VARCHAR')) = 0 AND detectedLanguage IS NOT NULL AND summary IS NOT NULL AND translatedText IS NOT NULL),
    good AS (
      SELECT id, category, CAST(greatest(1, least(5, floor(severity + 0.5::DOUBLE))) AS INTEGER) AS severity, substr(summary, 1, 500) AS summary,
             array_to_string(list_transform(tags[1:5], lambda x: substr(trim(x ->> '$'), 1, 40)), '|') AS tags, detectedLanguage, translatedText FROM sound)
    """

ENRICH = "--cte " + _MODEL + """, model AS (
      SELECT m.id, category, severity, summary, tags, detectedLanguage, translatedText FROM model_json m LEFT JOIN good USING (id))
    """


def _classes(source: str, model: str) -> str:
    opening = "coalesce(nullif(substr(trim(regexp_replace(t.text, '^\\s+|\\s+$', '', 'g')), 1, 300), ''), 'Infrastructure issue reported.')"
    return f"""first AS (SELECT id, CASE WHEN regexp_matches(text, '\\p{{Cyrillic}}') THEN 'ru' ELSE 'en' END AS f FROM {source}),
    routed AS (
      SELECT t.id, t.text, t.language, t.userCategory, k.category AS kc, k.summary AS ks, m.category AS mc, m.severity AS ms, m.summary AS mm,
             m.tags AS mt, m.detectedLanguage AS ml, m.translatedText AS mx,
             CASE WHEN s.code = 'hi-Latn' AND t.language IN ('hi', 'mr') THEN t.language WHEN s.code = 'en' THEN coalesce(t.language, f) ELSE s.code END AS local,
             CASE WHEN t.userCategory IS NOT NULL THEN 'user' WHEN k.category IS NOT NULL THEN 'trie' WHEN m.category IS NOT NULL THEN 'model' ELSE 'fallback' END AS branch
      FROM {source} t JOIN script s USING (id) JOIN first USING (id) LEFT JOIN keyword k USING (id) LEFT JOIN {model} m USING (id)),
    classes AS (
      SELECT id, CASE branch WHEN 'user' THEN userCategory WHEN 'trie' THEN kc WHEN 'model' THEN mc ELSE 'roads' END AS category,
             CASE WHEN branch IN ('user', 'model') THEN coalesce(ms, 3) ELSE 3 END AS severity,
             CASE WHEN branch = 'trie' THEN ks WHEN branch IN ('user', 'model') THEN coalesce(mm, {opening}) ELSE {opening} END AS summary,
             CASE WHEN branch IN ('user', 'model') THEN coalesce(mt, '') ELSE '' END AS tags,
             CASE WHEN branch IN ('user', 'model') THEN coalesce(mx, t.text) ELSE t.text END AS translated,
             CASE branch WHEN 'user' THEN coalesce(language, ml, local) WHEN 'model' THEN coalesce(language, ml) ELSE local END AS detectedLanguage,
             branch AS classifiedBy
      FROM routed t)
    """


CLASSIFY = "--cte " + ", ".join([_MODEL, _keywords("texts"), _script("texts"), _classes("texts", "good")])

_NO_MODEL = """none AS (SELECT id, '' AS category, 0 AS severity, '' AS summary, '' AS tags, '' AS detectedLanguage, '' AS translatedText
      FROM texts WHERE false)"""
_FLAT = """flat AS (SELECT id, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' +', ' ', 'g') AS text, language, userCategory FROM texts)"""
CLASSIFY_PLAIN = "--cte " + ", ".join([_NO_MODEL, _FLAT, _keywords("flat"), _script("flat"), _classes("flat", "none")])

_VALID = """valid AS (SELECT * FROM checked WHERE len(errors) = 0)"""
_NO_MODEL_V = _NO_MODEL.replace("texts", "valid")
INGEST = VALIDATE + ", " + ", ".join(
    [_VALID, _NO_MODEL_V, _keywords("valid"), _script("valid"), _classes("valid", "none")]
) + f""", wanted AS (
      SELECT districtId, arg_min(lat, (timestamp, id)) AS lat, arg_min(lng, (timestamp, id)) AS lng FROM valid
      WHERE coalesce(districtId, '') <> '' AND districtId NOT IN (SELECT id FROM district_rows) GROUP BY districtId),
    known AS (
      SELECT r.id, coalesce(stateName, state) AS state, lat, lng FROM district_rows r LEFT JOIN catalog k ON k.districtId = r.id
      UNION ALL SELECT districtId, stateName, lat, lng FROM wanted JOIN catalog USING (districtId)),
    nearby AS ({_NEAREST.format(rows='valid').replace('districts d', 'known d')})
    SELECT v.id, CASE WHEN NOT isAnonymous THEN userId END AS userId, 'submitted' AS status, v.text AS rawText, c.detectedLanguage, c.category,
           c.classifiedBy, {severity('c.severity')} AS severity, coalesce(nullif(v.districtId, ''), near) AS districtId, v.lat, v.lng,
           coalesce(v.source, 'text') AS source, v.userCategory,
           (SELECT state FROM known x WHERE x.id = coalesce(nullif(v.districtId, ''), near)) AS stateName,
           CASE WHEN NOT isAnonymous THEN contactPhone END AS contactPhone, isAnonymous,
           'CP-' || year(timestamp) || '-' || lpad(CAST(CAST('0x' || substr(md5(v.id), 1, 8) AS BIGINT) % 1000000 AS VARCHAR), 6, '0') AS referenceId
    FROM valid v JOIN classes c USING (id) JOIN nearby n USING (id)"""
