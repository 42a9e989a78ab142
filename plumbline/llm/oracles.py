"""DuckDB SQL for the queries that SQL can express."""

OP10 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) >= 2),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN twice USING (doc_id, g), (SELECT unnest(range(0, 5)) AS j)),
rep AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
        (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT source, count(*) AS n, sum((base_failed OR n_symbols > 0.5 * n_words
        OR (n_dup_lines > 0 AND n_dup_lines * 5 > 0.5 * n_words))::INT) AS f FROM b GROUP BY source),
tot AS (SELECT sum(f) / sum(n) AS m, sum(n) AS n, count(*) AS hosts, sum(f * f / n) AS ff FROM f),
bet AS (SELECT m, ff / n - m * m - m * (1 - m) * (hosts - 1) / n AS v FROM tot),
pri AS (SELECT m, CASE WHEN v > 0 THEN greatest(1, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS k FROM bet),
post AS (SELECT source, n, k, (f + k * m) / (n + k) AS r, (f + 1) / (n + 2) AS own FROM f, pri),
host AS (SELECT source, NOT (r - 1.645 * sqrt(r * (1 - r) / (n + k + 1)) > 0.6
                             AND own - 1.645 * sqrt(own * (1 - own) / (n + 3)) > 0.6) AS host_ok FROM post)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_ok,
       NOT base_failed AND host_ok AS kept
FROM b JOIN host ON b.source IS NOT DISTINCT FROM host.source
"""

OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((n - 1) % 3 + 1)::INT] AS w, 3 * ss AS most FROM s),
-- each round closes the sources that the level of the last one fills
lv(k, level) AS (
  SELECT 0, (SELECT sum(ss)::DOUBLE / sum(w) FROM w)
  UNION ALL
  SELECT k + 1, (SELECT (sum(ss) - coalesce(sum(most) FILTER (most < level * w), 0))::DOUBLE
                        / sum(w) FILTER (most >= level * w) FROM w)
  FROM lv WHERE k < 60 AND (SELECT count(*) FILTER (most >= level * w) FROM w) > 0),
t AS (SELECT source, ss, coalesce(least(most::DOUBLE, (SELECT arg_max(level, k) FROM lv WHERE level IS NOT NULL) * w), most) AS target FROM w),
r AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss)::BIGINT ELSE 0 END AS c FROM t),
-- inclusion grows with the root of the size; the sum is of integers
pull AS (SELECT *, floor(16 * sqrt(greatest(size, 1)::DOUBLE))::BIGINT AS pull FROM d),
pulled AS (SELECT source, sum(pull * size)::DOUBLE AS pulled FROM pull GROUP BY source),
q AS (SELECT d.*, ss, target, c, greatest(0.0, target - c * ss) AS rest, pulled FROM pull AS d
      JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN pulled ON d.source IS NOT DISTINCT FROM pulled.source),
odds AS (SELECT *, least(greatest(CASE WHEN pulled > 0 THEN rest / pulled ELSE 0 END * pull, 1e-9), 1 - 1e-9) AS p FROM q),
pareto AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS rank FROM odds),
a AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank) - size / 2 > rest AS over FROM pareto),
x AS (SELECT source, min(rank) FILTER (over) AS cut FROM a GROUP BY source)
SELECT doc_id, size, ss AS source_size, target,
       size * (c + (rest > 0 AND rank < coalesce(cut, 'inf'::DOUBLE))::INT)::BIGINT AS taken
FROM a JOIN x ON a.source IS NOT DISTINCT FROM x.source
"""

#: Every rule is run on every URL here; the patterns are those of url_rules.
OP6 = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(by_host, name, verdict, pattern) AS (VALUES
  (true, 'com/en/', 'block', '^(?:[^/]*\.)?com/en/'),
  (true, 'example.com/en/7', 'allow', '^(?:[^/]*\.)?example\.com/en/7'),
  (true, 'net/de/', 'allow', '^(?:[^/]*\.)?net/de/'),
  (true, 'example.net/de/8', 'block', '^(?:[^/]*\.)?example\.net/de/8'),
  (true, 'org/es/', 'block', '^(?:[^/]*\.)?org/es/'),
  (false, 'login', 'block', '/(?:login|signin)(?:/|$)'),
  (false, 'logout', 'block', '/logout(?:/|$)'),
  (false, 'ads', 'block', '(?:^|[./])ads?[./]'),
  (false, 'tracker', 'block', '^(?:[a-z0-9-]+\.)*tracker\.'),
  (false, 'tag-feed', 'block', '/tag/[^/]+/feed(?:/|$)'),
  (false, 'cart', 'block', '/cart/(?:add|checkout)(?:/|$)'),
  (false, 'mobile-short', 'block', '^m\..*/[a-z]{2}/[0-9]{1,3}(?:[./]|$)'),
  (false, 'blog-html', 'block', '^blog\..*/[0-9]+\.html$'),
  (false, 'blog-en-html', 'allow', '^blog\..*\.example\.org/en/[0-9]+\.html$')),
f AS (SELECT page_id, host, path, max(struct_pack(b := by_host, s := length(name), n := name, v := verdict)) AS best
      FROM h LEFT JOIN r ON regexp_matches(host || path, pattern) GROUP BY page_id, host, path)
SELECT page_id, host, path, CASE WHEN best.b THEN best.n END AS rule, CASE WHEN NOT best.b THEN best.n END AS pattern_rule,
       coalesce(best.v, 'allow') AS verdict
FROM f
"""

OP1 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score
      FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM s
"""

OP12 = r"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)::DOUBLE[] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id, r.label = a.label AS same, list_dot_product(a.e, r.e)::BIGINT AS score FROM v AS a JOIN v AS r ON a.id % 50 = 0 AND r.id <> a.id AND len(r.e) = len(a.e)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same),
n AS (SELECT anchor_id, positive_id, place, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, place ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE place <= 5 AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

#: Every order is gone through step by step here, over the counts of masks.
OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT chr((65 + i)::INT) AS letter, (1 << i)::INT AS bit FROM range(5) AS r(i)),
o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f AS a, f AS b, f AS c, f AS d, f AS e
      WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
        sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit),
z AS (SELECT part, filter_order, step::INT AS step, bit, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
        coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost FROM r)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM z
"""

SQL = {
    "op1_mtree_top_k": OP1,
    "op6_url_rules": OP6,
    "op8_pareto_mixing": OP8,
    "op10_quality_rules": OP10,
    "op11_warc_archive": OP11,
    "op12_ball_tree_negatives": OP12,
    "op13_filter_audit": OP13,
}
