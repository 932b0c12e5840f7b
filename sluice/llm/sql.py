"""DuckDB SQL of the operators that SQL can express. Tokenizers, trained models, decoding and bit-parallel search have
none; tests hold them against brute force."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SYMBOLS = r"[#*$%&|<>]"
_count = lambda text, signs: f"(length({text}) - length(regexp_replace({text}, '{signs}', '', 'g')))"

ORACLE_SQL: dict[str, str] = {
    "op2_warc_archive": """
WITH h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest
           FROM (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages)),
 r AS (SELECT payload_digest, max(page_id) AS response FROM h WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN response <> page_id THEN response END AS refers_to
FROM h LEFT JOIN r USING (payload_digest)""",
    "op5_jaccard_join": f"""
WITH RECURSIVE cls AS (SELECT text, min(doc_id) AS class_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text),
 w AS (SELECT class_id, {_WORDS.format('text')} AS w FROM cls),
 s AS (SELECT DISTINCT class_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: w[i:i + 4])) AS g FROM w WHERE len(w) > 0),
 n AS (SELECT class_id, count(*) AS n FROM s GROUP BY class_id),
 pairs AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.class_id < b.class_id GROUP BY 1, 2),
 one AS MATERIALIZED (SELECT x, y FROM pairs JOIN n p ON p.class_id = x JOIN n q ON q.class_id = y WHERE same >= 0.8 * (p.n + q.n - same)),
 links AS MATERIALIZED (SELECT x, y FROM one UNION ALL SELECT y, x FROM one),
 reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(c.n_copies, 1) AS n_copies,
 coalesce((SELECT count(*) FROM links WHERE x = c.class_id), 0) AS n_links,
 least(coalesce(c.class_id, d.doc_id), (SELECT min(y) FROM reach WHERE x = c.class_id)) AS group_id
FROM documents d LEFT JOIN cls c ON d.text = c.text""",
    "op9_line_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, {_WORDS.format('t')} AS w FROM d),
 wins AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
 rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM wins) WHERE k > 1) GROUP BY r),
 cut AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
 lines AS (SELECT r, i, line, {_WORDS.format('line')} AS tk, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM cut),
 judged AS (SELECT r, i, line, again, tk, length(array_to_string(tk, '')) AS size, len(tk) AS n,
  again OR (len(tk) >= 4 AND 2 * coalesce(list_sum(list_transform(range(1, len(tk)), lambda j: CASE WHEN tk[j] = tk[j + 1] THEN 1 ELSE 0 END)), 0) >= len(tk))
  OR {_count('line', _SYMBOLS)} * 10 > length(array_to_string(tk, ''))
  OR ({_count('line', '[|]')} >= 3 AND 4 * {_count('line', '[|]')} >= len(tk))
  OR (len(tk) >= 5 AND (3 * {_count('line', '!')} >= len(tk) OR 10 * {_count('line', '[A-Z]')} > 6 * greatest(1, {_count('line', '[A-Za-z]')})))
  OR regexp_matches(line, '(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings|consent)|accept (?:all )?cookies|copyright (?:\(c\)|©|[0-9]{{4}})|(?:licensed|released) under|subscribe to our newsletter|enable javascript')
  OR (len(tk) < 3 AND NOT regexp_matches(tk[len(tk)], '[.!?:;"'')…”»。]$')) AS bad FROM lines),
 sums AS (SELECT r, sum(CASE WHEN n > 0 THEN size ELSE 0 END) AS total, sum(CASE WHEN n > 0 AND bad THEN size ELSE 0 END) AS lost,
  count(*) FILTER (n > 0 AND bad) AS removed, count(*) FILTER (n > 0 AND again) AS dups,
  coalesce(sum(length(line)) FILTER (n = 0 OR NOT bad), 0) + greatest(count(*) FILTER (n = 0 OR NOT bad) - 1, 0) AS cleaned FROM judged GROUP BY r),
 base AS (SELECT d.r, d.doc_id, d.text, len(w.w) AS n_words, CAST(total AS BIGINT) AS word_chars, CAST({_count('t', _SYMBOLS)} AS BIGINT) AS n_symbols, dups AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, removed, cleaned, CASE WHEN total > 0 THEN lost / total ELSE 0.0 END AS loss
  FROM d JOIN w USING (r) JOIN sums USING (r) LEFT JOIN rep USING (r)),
 verdict AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND loss <= 0.3 AS kept, loss AS lost_share,
 removed AS n_lines_removed, CASE WHEN text IS NOT NULL THEN CAST(cleaned AS INT) END AS cleaned_chars FROM verdict""",
}
