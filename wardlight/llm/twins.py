"""DuckDB twins of the operators that SQL can express."""

WORDS = r"""
words AS (
    SELECT {key}, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda w: w <> '') AS w
    FROM {table}),
grams AS (
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
    FROM words)"""


def _words(table: str, key: str, prefix: str) -> str:
    return WORDS.format(table=table, key=key).replace("words AS", f"{prefix}_words AS").replace(
        "grams AS", f"{prefix}_grams AS").replace("FROM words", f"FROM {prefix}_words")


NGRAM_JOIN = f"""
WITH RECURSIVE {_words('documents', 'doc_id', 'd')},
sizes AS (SELECT doc_id, count(*) AS n FROM d_grams GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM d_grams a JOIN d_grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id, s.n
"""

DECONTAMINATION = f"""
WITH {_words('documents', 'doc_id', 'd')}, {_words('benchmark', 'item_id', 'i')},
sizes AS (SELECT item_id, count(*) AS n FROM i_grams GROUP BY item_id)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found, count(*) / n AS containment
FROM d_grams JOIN i_grams USING (g) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
    SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s
    FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS p FROM d)),
numbered AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS i FROM windows),
repeats AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM numbered WHERE i > 1),
islands AS (
    SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY p) AS k FROM repeats),
spans AS (SELECT doc_id, k, min(p) AS b, max(p) + 100 AS e FROM islands GROUP BY doc_id, k),
edges AS (
    SELECT doc_id, h, b, e, coalesce(lag(e) OVER w, 0) AS from_, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n
    FROM d JOIN spans USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY b)),
kept AS (
    SELECT doc_id, sum(e - b) AS removed, max(n) AS spans,
        string_agg(substr(h, 2 * from_ + 1, 2 * (b - from_)) || CASE WHEN k = n THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY k) AS h
    FROM edges GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

CHAT = """
WITH turns AS (
    SELECT conv_id, list({'turn': turn, 'role': coalesce(role, 'user'), 'text': coalesce(text, '')}
        ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) AS t
    FROM conversations GROUP BY conv_id),
keys AS (SELECT conv_id, list_transform(t, lambda x: x.role || chr(1) || x.text) AS k, t FROM turns),
prefixes AS (SELECT DISTINCT k[1:n] AS k FROM (SELECT k, unnest(range(1, len(k))) AS n FROM keys)),
kept AS (
    SELECT min(conv_id) AS conv_id, count(*) AS n_snapshots, k FROM keys
    WHERE k NOT IN (SELECT k FROM prefixes) GROUP BY k)
SELECT conv_id, len(kept.k) AS n_turns, n_snapshots,
    array_to_string(list_transform(t, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>'), chr(10)) AS text
FROM kept JOIN keys USING (conv_id)
"""
