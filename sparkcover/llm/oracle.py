"""DuckDB SQL of the corpus queries that SQL can express, written from their contracts."""

from __future__ import annotations

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w
  FROM documents
),
windows AS (
  SELECT rid, doc_id, i, w[i:i + 12] AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
),
least_ids AS (SELECT g, min(doc_id) AS least_id FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p
  FROM windows JOIN least_ids USING (g) WHERE least_id < doc_id
),
places AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body
  FROM places ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

_BENCH_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE {_BENCH_WORDS} END AS w
  FROM documents
),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS m
  FROM (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0
),
patterns AS (
  SELECT DISTINCT item, m, w[i:i + m - 1] AS g FROM (SELECT item, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM items)
),
hits AS (
  SELECT rid, i, p.m, item
  FROM (SELECT rid, m, i, w[i:i + m - 1] AS g FROM (
          SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM items))) x
  JOIN patterns p ON x.m = p.m AND x.g = p.g
),
words_hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit h USING (rid) LEFT JOIN found f USING (rid)
"""

# CRC-32 of a decimal number, bit by bit: each byte enters with the first of its eight shifts
_CRC32 = r"""xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, flatten([[ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR ch IN string_split(CAST(c AS VARCHAR), '')])),
  lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)))"""

PREFIX_TRIE = rf"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT c, c - c % 20 AS base, {_CRC32} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
src AS (
  SELECT v.c, 0 AS part, t.pos, t.role, t.text FROM convs v JOIN t ON t.c = v.base AND t.pos <= v.h
  UNION ALL
  SELECT v.c, 1, t.pos, t.role, t.text FROM convs v JOIN t ON t.c = v.c AND t.pos > v.h
),
numbered AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d FROM src
),
seqs AS (SELECT c, list(md5(role || chr(1) || text) ORDER BY d) AS turns, count(*) AS size FROM numbered GROUP BY c),
members AS (
  SELECT c, 0 AS d, CAST([] AS VARCHAR[]) AS prefix, NULL AS prefix_up, 0 AS words, coalesce(size, 0) = 0 AS ends
  FROM convs LEFT JOIN seqs USING (c)
  UNION ALL
  SELECT n.c, n.d, s.turns[1:n.d], s.turns[1:n.d - 1], len(regexp_extract_all(n.text, '[^\x20\x09-\x0D]+')), n.d = s.size
  FROM numbered n JOIN seqs s USING (c)
),
nodes AS (
  SELECT d, prefix, min(c) AS conv_id, any_value(prefix_up) AS prefix_up, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY d, prefix
),
children AS (SELECT d - 1 AS d, prefix_up AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
subtrees AS (
  SELECT a.d, a.prefix, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved,
         count(*) FILTER (ch.n IS NULL) AS leaves
  FROM nodes b JOIN members m ON m.c = b.conv_id AND m.d <= b.d JOIN nodes a ON a.d = m.d AND a.prefix = m.prefix
  LEFT JOIN children ch ON ch.d = b.d AND ch.prefix = b.prefix
  GROUP BY a.d, a.prefix
)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, x.n_convs,
       CAST(coalesce(ch.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       s.saved AS saved_tokens, x.ends_sha256
FROM nodes x JOIN subtrees s ON s.d = x.d AND s.prefix = x.prefix
LEFT JOIN children ch ON ch.d = x.d AND ch.prefix = x.prefix
LEFT JOIN nodes up ON up.d = x.d - 1 AND up.prefix = x.prefix_up
"""

_TERMS = _BENCH_WORDS  # the same words: letters A-Z and a-z, digits, everything beyond ASCII

RANKED_SEARCH = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL
),
lens AS (SELECT rid, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, sum(n) AS all_terms FROM lens),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY rid, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term
),
q AS (
  SELECT qid, item_id, term, count(*) AS qtf
  FROM (SELECT qid, item_id, unnest({_TERMS}) AS term FROM (
          SELECT row_number() OVER () AS qid, * FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)))
  GROUP BY ALL
),
scored AS (
  SELECT q.qid, q.item_id, lens.rid, lens.doc_id,
         CAST(sum(q.qtf * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * lens.n * n_docs) // all_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN lens USING (rid), total
  GROUP BY ALL
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
