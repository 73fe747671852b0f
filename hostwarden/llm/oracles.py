"""SQL with the results of the operators that SQL can express, over the same tables."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BENCH = rf"regexp_extract_all(translate({{}}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format("text")} AS ws FROM d),
lines AS (
  SELECT r, host, text, line, array_to_string({_WORDS.format(f"translate(line, '{_UPPER}', '{_LOWER}')")}, ' ') AS norm
  FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
sizes AS (SELECT host, count(DISTINCT text) AS size FROM d GROUP BY host),
bad AS (
  SELECT host, norm FROM lines JOIN sizes USING (host) GROUP BY host, norm, size
  HAVING count(DISTINCT text) > 30 AND count(DISTINCT text) > 0.05 * size
),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
lost AS (SELECT r, sum(len(string_split(norm, ' '))) AS n_removed FROM lines SEMI JOIN bad USING (host, norm) GROUP BY r),
tri AS (SELECT r, i, ws[i : i + 2] AS three FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS times FROM tri),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again WHERE times > 1) GROUP BY r),
base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_removed
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed <= 0.5 * n_words AS kept,
  n_removed
FROM base
"""

OP3 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT r, doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS key FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
late AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY key) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM late)),
words AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""

OP6 = rf"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_BENCH.format("coalesce(text, '')")} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(ws), 13) AS size, array_to_string(ws[i : i + 12], ' ') AS key
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM items WHERE len(ws) > 0)
),
d AS (SELECT row_number() OVER () AS r, doc_id, {_BENCH.format("coalesce(text, '')")} AS ws FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
places AS (SELECT r, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size),
hits AS (SELECT r, i, size, item FROM (SELECT r, i, size, array_to_string(ws[i : i + size - 1], ' ') AS key FROM places) JOIN win USING (size, key)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

OP11 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
places AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS sizes(size) WHERE len(ws) >= size),
f AS (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
cuts AS (SELECT *, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, (1000 * c.a::HUGEINT * n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) WHERE place = 1),
inside AS (
  SELECT lang, array_to_string(ws[i : i + part - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, size - part + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS part FROM cand)) GROUP BY ALL
),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS key FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
late AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY key) AS least FROM win) WHERE least < doc_id),
marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM late),
runs AS (SELECT r, min(i) AS b, max(i) + 50 AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM marked) GROUP BY r, run),
gaps AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS before FROM runs),
cut AS (
  SELECT r, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS head
  FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN head IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

LLM_ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op3_substring_dedup": OP3, "op6_decontamination": OP6, "op11_collocations": OP11, "op12_suffix_radix": OP12}
