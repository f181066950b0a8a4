"""SQL of those queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SOURCE_DIVERGENCE = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS MATERIALIZED (
  SELECT r, lang, source, term, count(*) AS n
  FROM (SELECT r, lang, source, translate(unnest(words), '{UPPER}', '{LOWER}') AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, sum(n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM every JOIN v USING (lang)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term) JOIN v USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
             ("block", "net", "/fr/")]

URL_FILTER = rf"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(map(str, URL_RULES))}),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
best AS (
  SELECT host, path, max_by(fits, length(fits.rule)) AS best FROM (
    SELECT DISTINCT u.host, u.path, {{'rule': r.host || r.path, 'verdict': r.verdict}} AS fits
    FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) GROUP BY ALL)
SELECT page_id, u.host, u.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""

FILTER_INTERACTIONS = r"""
WITH text AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lowest AS (SELECT text, min(doc_id) AS low FROM text GROUP BY text),
marks AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::BIGINT) AS good, max((coalesce(toxic, 0) = 1)::BIGINT) AS toxic FROM labels GROUP BY doc_id),
docs AS MATERIALIZED (
  SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
                100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > low, false)] AS fails,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM text JOIN lowest USING (text) LEFT JOIN marks USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL),
letter(f, k) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS places, a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letter a JOIN letter b ON b.k <> a.k JOIN letter c ON c.k NOT IN (a.k, b.k) JOIN letter d ON d.k NOT IN (a.k, b.k, c.k)
  JOIN letter e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
steps AS (SELECT filter_order, places, unnest(range(1, 6)) AS step FROM orders),
counted AS (
  SELECT part, filter_order, step, places[step] AS k,
    sum(n) FILTER (NOT fails[places[step]] AND NOT before) AS kept, sum(n) FILTER (fails[places[step]] AND NOT before) AS removed,
    sum(n) FILTER (fails[places[step]] AND before) AS redundant,
    sum(n) FILTER (fails[places[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (fails[places[step]] AND NOT before) AS good_lost, sum(toxic) FILTER (fails[places[step]] AND NOT before) AS toxic_lost
  FROM (SELECT m.*, s.*, len(list_filter(places[:step - 1], lambda x: fails[x])) > 0 AS before FROM masks m CROSS JOIN steps s) GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, f AS filter, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM counted JOIN letter USING (k)
"""
