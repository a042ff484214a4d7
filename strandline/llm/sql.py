"""DuckDB SQL of the queries that SQL can express."""

WORDS = r"[^\x20\x09-\x0D]+"

CHAT = r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', '', ''
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', '', ''
), made AS (
    SELECT *, replace(replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn'), '###', '\###') AS safe,
        replace(replace(role, '\', '\\'), '>', '\>') AS safe_role
    FROM given
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<turn ' || safe_role || '>' || chr(10) || safe || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""

QUALITY = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents
), word AS (
    SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM docs
), gram AS (
    SELECT id, p, length(x) AS size, {", ".join(f"CASE WHEN lead(x, {n - 1}) OVER o IS NOT NULL THEN concat_ws(' ', x, {', '.join(f'lead(x, {k}) OVER o' for k in range(1, n))}) END AS g{n}" for n in (3, 5, 7, 10))}
    FROM word WINDOW o AS (PARTITION BY id ORDER BY p)
), twice AS (
    SELECT id, p, size, {", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY id, g{n}) > 1 AS t{n}" for n in (3, 5, 7, 10))} FROM gram
), covered AS (
    SELECT id, size, {", ".join(f"max(t{n}) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in (3, 5, 7, 10))} FROM twice
), by_word AS (
    SELECT id, sum(c3::INT) AS n_repeat_words, {", ".join(f"sum(CASE WHEN c{n} THEN size ELSE 0 END) / sum(size) AS gram_{n}" for n in (5, 7, 10))} FROM covered GROUP BY id
), line AS (
    SELECT id, unnest(string_split(text, chr(10))) AS x FROM docs
), lines AS (
    SELECT id, x, count(*) AS n FROM line WHERE regexp_matches(x, '{WORDS}') GROUP BY id, x
), by_line AS (
    SELECT id, sum(n - 1) AS n_dup_lines, sum((n - 1) * length(x)) / sum(n * length(x)) AS lines FROM lines GROUP BY id
), told AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, gram_5, gram_7, gram_10, lines
    FROM docs LEFT JOIN by_word USING (id) LEFT JOIN by_line USING (id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND gram_5 <= 0.30 AND gram_7 <= 0.25 AND gram_10 <= 0.20 AND coalesce(lines, 0) <= 0.30 AS kept
FROM told
"""

MIXING = rf"""
WITH docs AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS size,
        -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':42'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
        / CASE WHEN length(text) > 0 THEN greatest(0.1::DOUBLE, 1::DOUBLE - 5::DOUBLE * ((length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / length(text)::DOUBLE)) ELSE 0.1::DOUBLE END AS rank_key
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), turns AS (
    SELECT *, list_extract([5::DOUBLE, 2::DOUBLE, 1::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS w, 3::DOUBLE * source_size AS most FROM sources
), shares AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM turns
), targets AS (
    SELECT source, source_size, least(most, coalesce(max(CASE WHEN share <= most / w THEN share END) OVER () * w, most)) AS target FROM shares
), plan AS (
    SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS epochs FROM targets
), ahead AS (
    SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY rank_key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
    FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(size * epochs + CASE WHEN budget > 0 THEN least(size, greatest(0, CAST(floor(budget) AS BIGINT) - before)) ELSE 0 END AS BIGINT) AS taken FROM ahead
"""

URLS = r"""
WITH RECURSIVE parts AS (
    SELECT page_id, html, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS query
    FROM pages
), rules AS (
    SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) r(verdict, rule_host, rule_path)
), tags AS (
    SELECT host, path, query, url, unnest(list_concat(
        list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
        list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS href
    FROM parts
), targets AS (
    SELECT host || path || query AS a, CASE WHEN contains(href, '://') THEN href
        WHEN starts_with(href, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || href
        WHEN starts_with(href, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || href
        WHEN regexp_matches(href, '^[#?]') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || path || href
        ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || CASE WHEN regexp_extract(path, '(?s)^.*/') = '' THEN '/' ELSE regexp_extract(path, '(?s)^.*/') END || href END AS target
    FROM tags WHERE href <> '' AND host <> ''
), links AS (
    SELECT a, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        || regexp_extract(target, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2) || regexp_extract(target, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS b
    FROM targets WHERE regexp_matches(target, '(?s)^.*?://[^/?#]')
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reached(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a
), nodes AS (
    SELECT n, (SELECT verdict FROM rules WHERE (regexp_extract(n, '^([^/?]*)', 1) = rule_host OR ends_with(regexp_extract(n, '^([^/?]*)', 1), '.' || rule_host)) AND starts_with(regexp_extract(n, '^[^/?]*([^?]*)', 1), rule_path)
        ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS v FROM (SELECT DISTINCT b AS n FROM reached)
), told AS (
    SELECT a, max(v = 'block') AND NOT coalesce(max(v = 'allow'), false) AS blocked FROM reached JOIN nodes ON b = n GROUP BY a
), own AS (
    SELECT p.*, (SELECT struct_pack(rule := rule_host || rule_path, verdict := verdict) FROM rules WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
        ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS o FROM parts p
)
SELECT page_id, host, path, o.rule AS rule, coalesce(o.verdict, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM own LEFT JOIN told ON told.a = host || path || query AND host <> ''
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
    SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
    least(vec_id, coalesce((SELECT min(b) FROM reached WHERE a = vec_id), vec_id)) AS component_id,
    vec_id <= coalesce((SELECT min(b) FROM reached WHERE a = vec_id), vec_id) AS kept
FROM v
"""

RESAMPLING = r"""
WITH word AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, 0 AS side, row_number() OVER () AS id FROM documents
    UNION ALL SELECT NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1, row_number() OVER () FROM benchmark
), feature AS (
    SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM word
), counted AS (
    SELECT side, id, f, count(*) AS n FROM feature GROUP BY ALL
), steps AS (  -- of CRC-32: a byte comes in, then eight bits go out
    SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), crc AS (
    SELECT f, xor(4294967295, list_reduce(flatten(list_transform(range(0, len(h) // 2), lambda i: [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT)) % 10000 AS bucket FROM steps
), bucketed AS (
    SELECT side, id, bucket, sum(n) AS n FROM counted JOIN crc USING (f) GROUP BY ALL
), total AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM bucketed GROUP BY bucket
), gain AS (
    SELECT bucket, CAST(floor(1000 * ln(((t + 1) * ((SELECT coalesce(sum(s), 0) FROM total) + 10000)) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM total) + 10000)))) AS BIGINT) AS g FROM total
), weighed AS (
    SELECT id, sum(n) AS n, sum(n * g) AS weight FROM bucketed JOIN gain USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
    SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM word LEFT JOIN weighed USING (id) WHERE side = 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, sum((n_words >= 20)::INT) OVER () AS many FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * many // 100 THEN r END AS rank FROM placed
"""

PATTERNS = r"""
WITH RECURSIVE amount AS (
    SELECT DISTINCT *, CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL
), placed AS (
    SELECT client_id, click_id, kind, cents, ts, row_number() OVER o AS p, lag(cents) OVER o AS cents_0, lag(ts) OVER o AS ts_0
    FROM amount WINDOW o AS (PARTITION BY client_id ORDER BY ts, click_id NULLS FIRST, cents NULLS FIRST, coalesce(kind = 'purchase', false), coalesce(kind <> 'error', false))
), flagged AS (
    SELECT *, coalesce(ts - ts_0 <= INTERVAL 10 MINUTE AND cents IS NOT NULL AND cents_0 IS NOT NULL AND kind = 'purchase', false) AS goal,
        coalesce(ts - ts_0 <= INTERVAL 10 MINUTE AND cents <> cents_0 AND kind <> 'error', false) AS passes FROM placed
), run AS (
    SELECT *, sum((NOT goal AND NOT passes)::INT) OVER (PARTITION BY client_id ORDER BY p) AS run,
        min(CASE WHEN NOT passes THEN p END) OVER (PARTITION BY client_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM flagged
), ended AS (
    SELECT a.client_id, a.run, a.p, min(b.p) AS e FROM run a JOIN run b ON a.client_id = b.client_id AND a.run = b.run
    WHERE b.p > a.p AND b.goal AND b.cents >= a.cents AND (a.stop IS NULL OR b.p <= a.stop) GROUP BY ALL
), taken(client_id, run, p, e) AS (
    SELECT client_id, run, min(p), arg_min(e, p) FROM ended GROUP BY ALL
    UNION ALL
    SELECT t.client_id, t.run, min(n.p), arg_min(n.e, n.p) FROM taken t JOIN ended n ON t.client_id = n.client_id AND t.run = n.run AND n.p > t.e GROUP BY t.client_id, t.run
)
SELECT t.client_id, CAST(row_number() OVER (PARTITION BY t.client_id ORDER BY t.p) AS BIGINT) AS match_no, first(r.click_id) FILTER (r.p = t.p) AS first_id, first(r.click_id) FILTER (r.p = t.e) AS last_id,
    CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(r.cents) AS BIGINT) AS sum_cents,
    sha256(string_agg(CASE WHEN r.p = t.p THEN 'A' WHEN r.p = t.e THEN 'P' WHEN r.cents < r.cents_0 THEN 'D' ELSE 'U' END, '' ORDER BY r.p)) AS labels_sha256
FROM taken t JOIN run r ON t.client_id = r.client_id AND r.p BETWEEN t.p AND t.e GROUP BY t.client_id, t.p
"""

EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents) WINDOW same AS (PARTITION BY x)
"""

QUERIES = {
    "op5_chat_formatting": CHAT, "op6_quality_rules": QUALITY, "op8_mixing_to_weights": MIXING, "op9_url_filters": URLS, "op10_embedding_near_dedup": EMBEDDINGS, "op11_importance_resampling": RESAMPLING,
    "op12_row_pattern_matching": PATTERNS, "op13_exact_dedup": EXACT,
}
