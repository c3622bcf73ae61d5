"""The registered queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from tracewell.llm.decontaminate import op10_decontamination
from tracewell.llm.importance import op11_importance
from tracewell.llm.language_model import op13_language_model
from tracewell.llm.line_dedup import op1_line_dedup
from tracewell.llm.near_dedup import op7_near_dedup
from tracewell.llm.packing import op9_packing
from tracewell.llm.pii import op4_pii
from tracewell.llm.quality import op8_quality
from tracewell.llm.ranked_search import op12_ranked_search
from tracewell.llm.substring_dedup import op2_substring_dedup
from tracewell.llm.topk_search import op5_topk_search
from tracewell.llm.url_filter import op6_url_filter
from tracewell.llm.wrappers import op3_html_text

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_text": op3_html_text,
    "op4_pii": op4_pii,
    "op5_topk_search": op5_topk_search,
    "op6_url_filter": op6_url_filter,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_importance": op11_importance,
    "op12_ranked_search": op12_ranked_search,
    "op13_language_model": op13_language_model,
}

ORACLE_SQL = {
    "op7_near_dedup": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
), n AS (
    SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s
), u AS (
    SELECT doc_id, unnest(sh) AS x FROM s
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), r AS (
    SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e2.b FROM r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) e2 ON r.b = e2.a
)
SELECT doc_id, n AS n_shingles, min(b) AS component_id, min(b) = doc_id AS kept FROM r JOIN n ON a = doc_id GROUP BY doc_id, n
""",
    "op6_url_filter": r"""
WITH RECURSIVE p AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
           CASE WHEN contains(url, '://') THEN concat(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                CASE WHEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) END) END AS k,
           url, html
    FROM pages
), found AS (
    SELECT k, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS base, unnest([
        regexp_extract(html, '(?i)<link[^>]*rel\s*=\s*["'']?canonical["'']?[^>]*href\s*=\s*["'']?([^"''\s>]+)', 1),
        regexp_extract(html, '(?i)<link[^>]*href\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*rel\s*=\s*["'']?canonical', 1),
        regexp_extract(html, '(?i)<meta[^>]*http-equiv\s*=\s*["'']?refresh["'']?[^>]*content\s*=\s*["'']?[0-9.\s]*;\s*url\s*=\s*[''"]?([^"''\s>]+)', 1)]) AS t
    FROM p
), absolute AS (
    SELECT k, replace(CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN base || t END, '&amp;', '&') AS u FROM found WHERE t <> ''
), edge AS (
    SELECT k AS a, concat(translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           CASE WHEN regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) END) AS b
    FROM absolute WHERE u IS NOT NULL
), reach AS (
    SELECT a, b FROM edge UNION SELECT b, a FROM edge UNION SELECT a, a FROM edge UNION SELECT b, b FROM edge
    UNION SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM edge UNION SELECT b, a FROM edge) e ON r.b = e.a
), rules(verdict, h, pre) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), node AS (
    SELECT b, regexp_extract(b, '(?s)^([^/?]*)', 1) AS host, regexp_extract(b, '(?s)^[^/?]*([^?]*)', 1) AS path FROM (SELECT DISTINCT b FROM reach)
), blocked AS (
    SELECT b FROM node JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY b HAVING arg_max(verdict, length(h || pre)) = 'block'
), tainted AS (
    SELECT DISTINCT a FROM reach JOIN blocked USING (b)
), judged AS (
    SELECT rowid, page_id, host, path, k, arg_max(h || pre, length(h || pre)) FILTER (h IS NOT NULL) AS rule, arg_max(verdict, length(h || pre)) FILTER (h IS NOT NULL) AS own
    FROM (SELECT *, row_number() OVER () AS rowid FROM p) LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
    GROUP BY rowid, page_id, host, path, k
)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN tainted ON k = a
""",
    "op5_topk_search": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
    WHERE a.vec_id % 50 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op2_substring_dedup": r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
    SELECT doc_id, i, list_aggregate(ws[i:i + 12], 'string_agg', ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), late AS (
    SELECT win.doc_id, win.i FROM win JOIN (SELECT s, min(doc_id) AS d FROM win GROUP BY s) USING (s) WHERE win.doc_id > d
), gone AS (
    SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM late) GROUP BY doc_id
), pos AS (
    SELECT w.doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed,
           CASE WHEN js IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(js, k)), lambda k: ws[k]) END AS kept
    FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM pos
""",
    "op12_ranked_search": r"""
WITH d AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents
), n AS (
    SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), c AS (
    SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n
), q AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL
), p AS (
    SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term
), i AS (
    SELECT term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS impact FROM p JOIN w USING (term) JOIN n USING (doc_id), c
), s AS (
    SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL
), r AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
""",
}
