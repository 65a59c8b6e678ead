"""DuckDB SQL of the queries that SQL can express, written from their definitions."""

from cytotide.llm.urls import rounds_of

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLES = {
    "op1_decontaminate": r"""
WITH i AS (
  SELECT item_id, md5(array_to_string(ws, ' ')) AS item_key, ws, least(len(ws), 5) AS k
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM benchmark WHERE text IS NOT NULL)
  WHERE len(ws) > 0),
s AS (
  SELECT DISTINCT item_id, item_key, k, array_to_string(ws[p:p + k - 1], ' ') AS shingle
  FROM (SELECT item_id, item_key, k, ws, unnest(range(1, len(ws) - k + 2)) AS p FROM i)),
n AS (SELECT item_id, item_key, count(*) AS n_item FROM s GROUP BY ALL),
d AS (
  SELECT row, doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents) WHERE text IS NOT NULL),
r AS (
  SELECT row, doc_id, k, array_to_string(ws[p:p + k - 1], ' ') AS shingle
  FROM (SELECT row, doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS p
        FROM d CROSS JOIN (SELECT DISTINCT k FROM i) WHERE len(ws) >= k)),
m AS (
  SELECT row, doc_id, item_id, item_key, count(DISTINCT shingle) AS n_shared
  FROM r JOIN s USING (k, shingle) GROUP BY row, doc_id, item_id, item_key)
SELECT doc_id, m.item_id, CAST(n_item AS INTEGER) AS n_item, n_shared, n_shared / n_item AS containment
FROM m JOIN n ON m.item_id IS NOT DISTINCT FROM n.item_id AND m.item_key = n.item_key
WHERE n_shared >= 0.8 * n_item - 1e-9""",
    "op4_mix_sources": f"""
WITH d AS (
  SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM d GROUP BY source),
w AS (
  SELECT *, CAST(list_value(5, 2, 1)[(pos - 1) % 3 + 1] AS DOUBLE) AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, pos) AS ord FROM w),
t AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, ord) FROM l WHERE level <= ratio)) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs,
         CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
r AS (
  SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
         count(*) OVER (PARTITION BY source, key, doc_id, size) AS n,
         sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size) AS upto
  FROM d JOIN p USING (source))
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, rest - (upto - n * size)) // n) AS BIGINT) AS taken
FROM r""",
    "op5_substrings": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS doc,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT r, doc, p, array_to_string(ws[p:p + 19], ' ') AS run
  FROM (SELECT r, doc, ws, unnest(range(1, len(ws) - 18)) AS p FROM d WHERE len(ws) >= 20)),
f AS (SELECT run, min({'doc': doc, 'p': p}) AS first FROM w GROUP BY run),
gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 20)) AS pos FROM w JOIN f USING (run)
  WHERE doc > first.doc OR doc = first.doc AND p > first.p),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d) ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op8_url_filter": r"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS page, page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(action, site, start) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
h AS (
  SELECT page, arg_max({'action': action, 'rule': site || start, 'whole': start = '/'}, len(site || start)) AS hit
  FROM p JOIN r ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page),
u AS (SELECT page_id, host, path, hit FROM p LEFT JOIN h USING (page)),
e AS (
  SELECT DISTINCT src, dst FROM (
    SELECT host AS src, translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN ':' || link ELSE link END,
                                                 '(?s)^.*?://([^/?#]*)', 1),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
    FROM (SELECT host, unnest(regexp_extract_all(html,
      '(?i)<a\s[^<>]*?href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s<>]+)', 1)) AS link FROM p))
  WHERE src <> '' AND dst <> '' AND src <> dst),
ways AS (
  SELECT kind, host, next, count(*) OVER (PARTITION BY kind, per) AS fan
  FROM (SELECT 'trust' AS kind, src AS host, dst AS next, src AS per FROM e
        UNION ALL SELECT 'distrust', dst, src, dst FROM e UNION ALL SELECT 'exposure', dst, src, src FROM e)),
m AS (
  SELECT 0 AS round, kind, host, 1.0::DOUBLE - 0.85::DOUBLE AS score
  FROM (SELECT DISTINCT unnest(CASE WHEN hit.action = 'allow' THEN ['trust'] WHEN hit.whole THEN ['distrust', 'exposure'] ELSE [] END) AS kind, host
        FROM u WHERE hit IS NOT NULL)
  UNION ALL
  SELECT round + 1, kind, next, sum(score / fan) * 0.85::DOUBLE FROM m JOIN ways USING (kind, host)
  WHERE round < ROUNDS GROUP BY round, kind, next),
s AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust,
             greatest(coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0), coalesce(sum(score) FILTER (WHERE kind = 'exposure'), 0)) AS against
      FROM m GROUP BY host)
SELECT page_id, u.host, path, hit.rule AS rule,
       coalesce(hit.action, CASE WHEN against >= 0.01 AND against > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN s ON u.host = s.host""".replace("ROUNDS", str(rounds_of())),
    "op11_lexical_search": r"""
WITH i AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item, term, count(*) AS qtf FROM (SELECT item, unnest(ts) AS term FROM i) GROUP BY ALL),
d AS (
  SELECT * FROM (
    SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents WHERE text IS NOT NULL) WHERE len(ts) > 0),
a AS (SELECT count(*) AS N, CAST(sum(len(ts)) AS BIGINT) AS L FROM d),
t AS (
  SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(N) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM t, a GROUP BY term),
x AS (
  SELECT doc, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(ts) * N) // L)))) AS part
  FROM t JOIN w USING (term) JOIN d USING (doc), a),
s AS (SELECT item, doc, CAST(sum(qtf * part) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY item, doc),
r AS (
  SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s JOIN d USING (doc) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r JOIN i USING (item) WHERE rank <= 20""",
    "op12_repair": r"""
WITH RECURSIVE t AS (
  SELECT [list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) for i in range(256)] AS tab),
k AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (
  SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                              lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM k, t),
g AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         left(role, 1) AS c, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM g),
m AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS what,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
pre(state, ins, spent, lines, here) AS (
  VALUES ('^', '', 0, '', '^'), ('^', 'I', 3, E'\nuser:', 'u'), ('^', 'II', 6, E'\nuser:\nassistant:', 'a'),
         ('s', '', 0, '', 's'), ('s', 'I', 3, E'\nuser:', 'u'), ('s', 'II', 6, E'\nuser:\nassistant:', 'a'),
         ('u', '', 0, '', 'u'), ('u', 'I', 3, E'\nassistant:', 'a'), ('u', 'II', 6, E'\nassistant:\nuser:', 'u'),
         ('a', '', 0, '', 'a'), ('a', 'I', 3, E'\nuser:', 'u'), ('a', 'II', 6, E'\nuser:\nassistant:', 'a')),
p AS (
  SELECT conv_id, 0 AS i, '^' AS state, {'cost': 0, 'audit': '', 'lines': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i + 1, state, min({'cost': cost, 'audit': audit, 'lines': lines}) FROM (
    SELECT p.conv_id, p.i, unnest([
      {'state': here, 'cost': best.cost + spent + 4, 'audit': best.audit || ins || 'D', 'lines': best.lines || pre.lines},
      {'state': CASE WHEN what NOT IN ('blank', 'duplicate')
                     AND (c = 's' AND here = '^' OR c = CASE here WHEN 'u' THEN 'a' ELSE 'u' END) THEN c END,
       'cost': best.cost + spent + CASE what WHEN 'truncated' THEN 3 ELSE 0 END, 'audit': best.audit || ins || 'K',
       'lines': best.lines || pre.lines || E'\n' || role || ':' || text},
      {'state': CASE WHEN what NOT IN ('blank', 'duplicate') THEN CASE here WHEN 'u' THEN 'a' ELSE 'u' END END,
       'cost': best.cost + spent + 3 + CASE what WHEN 'truncated' THEN 3 ELSE 0 END, 'audit': best.audit || ins || 'R',
       'lines': best.lines || pre.lines || E'\n' || CASE here WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || text}], recursive := true)
    FROM p JOIN pre USING (state) JOIN m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1)
  WHERE state IS NOT NULL GROUP BY conv_id, i, state),
z AS (
  SELECT conv_id, i, min({'cost': best.cost + spent, 'audit': best.audit || ins, 'lines': best.lines || pre.lines}) AS best
  FROM p JOIN pre USING (state) WHERE here IN ('^', 'a') GROUP BY conv_id, i),
e AS (SELECT conv_id, arg_max(best, i) AS best FROM z GROUP BY conv_id),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE what = 'blank') AS blank,
         count(*) FILTER (WHERE what = 'duplicate') AS duplicate, count(*) FILTER (WHERE what = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM m GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
       sha256(substr(best.lines, 2)) AS repaired_sha256
FROM e LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id""",
}
