"""DuckDB SQL for the queries that SQL can express."""

from vacanta.llm import license_scan, ranked_search, resampling
from vacanta.llm.line_dedup import BLOCKS

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(role) + 24) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS window_text
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT size FROM bw),
  dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS window_text
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
  hit AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw USING (size, window_text)),
  n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
  k AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

LINES = rf"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_replace(replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), chr(10), ' '), '(?i)</?({BLOCKS})([ /][^>]*)?>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages),
  e AS (SELECT r, page_id, host, replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM a),
  p AS MATERIALIZED (SELECT r, page_id, host, trim(regexp_replace(regexp_replace(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^\n|\n$', '', 'g')) AS text FROM e),
  l AS (SELECT r, page_id, host, none, i, trim(s[i]) AS line, s[i] AS full_line FROM (SELECT r, page_id, host, none, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT r, page_id, host, text IS NULL AS none, string_split(coalesce(text, ''), chr(10)) AS s FROM p))),
  t AS (SELECT host, count(*) AS total FROM p WHERE host <> '' GROUP BY host),
  c AS (SELECT host, line, count(DISTINCT r) AS n FROM l WHERE line <> '' AND host <> '' GROUP BY host, line),
  f AS (SELECT host, line, true AS bad FROM c JOIN t USING (host) WHERE total >= 5 AND n > 0.3 * total)
SELECT page_id, host, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped,
  CASE WHEN NOT none THEN coalesce(string_agg(CASE WHEN bad THEN NULL ELSE full_line END, chr(10) ORDER BY i), '') END AS text
FROM l LEFT JOIN f USING (host, line) GROUP BY r, page_id, host, none
"""

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# crc32 of each different word: its bytes one by one through a table of 256, which is made here too.
RESAMPLING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
  x AS (SELECT r, unnest(w) AS word FROM d), y AS (SELECT unnest({WORDS}) AS word FROM benchmark),
  crcs AS (SELECT list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
  v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM x UNION SELECT word FROM y)),
  k AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda c, z: xor(t[CAST(xor(c & 255, z) AS BIGINT) + 1], c // 256)), 4294967295) % {resampling.BUCKETS} AS bucket FROM v, crcs),
  s AS (SELECT bucket, count(*) AS n FROM x JOIN k USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM y JOIN k USING (word) GROUP BY bucket),
  g AS (SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM x) + {resampling.BUCKETS}) / (CAST(s.n + 1 AS DOUBLE) * ((SELECT count(*) FROM y) + {resampling.BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
  m AS (SELECT r, sum(gain) AS weight FROM x JOIN k USING (word) JOIN g USING (bucket) GROUP BY r),
  z AS (SELECT r, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
  o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM z WHERE n_features >= {resampling.LEAST_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM o) THEN rank END AS BIGINT) AS rank FROM z LEFT JOIN o USING (r)
"""

LICENSES = rf"""
WITH t(template, label, phrase, w) AS (VALUES {", ".join(f"({i}, '{label}', {phrase}, string_split('{x}', ' '))" for i, (x, label, phrase) in enumerate([(x, y, True) for x, y in license_scan.PHRASES.items()] + [(x, y, False) for x, y in license_scan.NOTICES.items()]))}),
  d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
  dg AS (SELECT r, i - 1 AS place, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
  tg AS (SELECT template, i - 1 AS a, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT template, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
  v AS (SELECT DISTINCT r, template, place - a AS diag, a FROM dg JOIN tg USING (run)),
  one AS (SELECT r, template, diag, count(DISTINCT a) AS votes, min(a) AS low, max(a) AS high FROM v GROUP BY ALL),
  held AS (SELECT r, template, diag, count(DISTINCT a + o) AS n FROM v, (VALUES (0), (1), (2)) AS q(o) GROUP BY ALL),
  place AS (SELECT r, label, diag FROM one JOIN t USING (template) WHERE phrase AND votes = len(w) - 2),
  c AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diag) AS cluster FROM
    (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, template ORDER BY diag) <= {license_scan.GAP} THEN 0 ELSE 1 END AS fresh FROM one)),
  both_ AS (SELECT r, template, cluster, count(DISTINCT a + o) AS n FROM c JOIN v USING (r, template, diag), (VALUES (0), (1), (2)) AS q(o) GROUP BY ALL),
  long_ AS (SELECT r, template, cluster, max(n) AS alone, max(diag + high) + 3 - min(diag + low) AS span FROM c JOIN held USING (r, template, diag) GROUP BY ALL),
  part AS (SELECT r, label, phrase, greatest(alone, CASE WHEN span <= {license_scan.STRETCH} * len(w) THEN n ELSE 0 END) / CAST(len(w) AS DOUBLE) AS part FROM both_ JOIN long_ USING (r, template, cluster) JOIN t USING (template)),
  b AS (SELECT r, count(*) AS n_base, min(diag) AS first_word, max(diag) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r),
  l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM place UNION SELECT r, label FROM part WHERE NOT phrase AND part >= {license_scan.ENOUGH}) GROUP BY r),
  s AS (SELECT r, max(part) AS score FROM part GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""

RANKED = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents), q AS (SELECT row_number() OVER () AS number, item_id, {WORDS} AS w FROM benchmark),
  a AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM d WHERE len(w) > 0),
  qt AS (SELECT number, term, count(*) AS times FROM (SELECT number, unnest(w) AS term FROM q) GROUP BY ALL),
  tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
  wt AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM tf, a GROUP BY term, n_docs),
  e AS (SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(w) * n_docs) // n_all))) AS gain FROM tf JOIN wt USING (term) JOIN d USING (r), a),
  s AS (SELECT number, r, CAST(sum(times * gain) AS BIGINT) AS score FROM qt JOIN e USING (term) GROUP BY ALL),
  o AS (SELECT number, doc_id, score, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN q USING (number) WHERE rank <= {ranked_search.TOP}
"""

ORACLES = {"op11_importance_resampling": RESAMPLING, "op12_license_scan": LICENSES, "op13_ranked_search": RANKED, "op7_chat_format": CHAT, "op9_decontaminate": DECONTAMINATE, "op10_line_dedup": LINES}
