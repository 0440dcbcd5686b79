"""DuckDB SQL for the queries of this subpackage that SQL can express.

Both state the result from its definition: the license scan word by word with
``lead``, the repeated passages window by window.  The others rest on models,
tokenizers, random rounding or hash functions that DuckDB doesn't offer.
"""

from __future__ import annotations

# Templates of the license scan, spelled out here: label, words, whether of the base.
_TEMPLATES = """
  (0, 'mit', 'mit license', true),
  (1, 'apache', 'apache license', true),
  (2, 'gpl', 'general public license', true),
  (3, 'cc-by-nc', 'licensed under cc by nc 4 0', false),
  (4, 'cc-by-sa', 'licensed under cc by sa 4 0', false),
  (5, 'cc-by', 'licensed under cc by 4 0', false),
  (6, 'cc-by', 'this work is licensed under a creative commons attribution 4 0 international license', false),
  (7, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software and '
          || 'associated documentation files to deal in the software without restriction', false),
  (8, 'apache', 'you may not use this file except in compliance with the license you may obtain a copy of the '
          || 'license at http www apache org licenses license 2 0', false),
  (9, 'gpl', 'this program is free software you can redistribute it and or modify it under the terms of the gnu '
          || 'general public license as published by the free software foundation', false),
  (10, 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted '
          || 'provided that the following conditions are met', false),
  (11, 'mpl', 'this source code form is subject to the terms of the mozilla public license v 2 0', false),
  (12, 'all-rights-reserved', 'all rights reserved no part of this publication may be reproduced', false)
"""

_LICENSE = r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
templates AS (
  SELECT tid, label, base, string_split(phrase, ' ') AS t_words, len(t_words) AS n,
         CASE WHEN n <= 4 THEN 2 ELSE 4 END AS k, CASE WHEN n <= 4 THEN 0 ELSE n // 10 END AS slack,
         CASE WHEN n <= 4 THEN 1.0 ELSE 0.6 END AS share
  FROM (VALUES """ + _TEMPLATES + r""") v(tid, label, phrase, base)),
grams AS (
  SELECT tid, k, t_pos, array_to_string(t_words[t_pos + 1:t_pos + k], ' ') AS gram
  FROM (SELECT *, unnest(range(n - k + 1)) AS t_pos FROM templates)),
words AS (
  SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM texts),
ahead AS (
  SELECT rid, pos, word || ' ' || lead(word, 1) OVER o AS two,
         two || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS four
  FROM words WINDOW o AS (PARTITION BY rid ORDER BY pos)),
hits AS (
  SELECT rid, tid, t_pos, pos - t_pos AS diagonal FROM ahead JOIN grams ON k = 2 AND gram = two
  UNION ALL
  SELECT rid, tid, t_pos, pos - t_pos AS diagonal FROM ahead JOIN grams ON k = 4 AND gram = four),
marked AS (
  SELECT h.*, CASE WHEN diagonal - lag(diagonal) OVER o <= slack THEN 0 ELSE 1 END AS apart
  FROM hits h JOIN templates USING (tid) WINDOW o AS (PARTITION BY rid, tid ORDER BY diagonal, t_pos)),
clustered AS (
  SELECT *, sum(apart) OVER (PARTITION BY rid, tid ORDER BY diagonal, t_pos) AS cluster FROM marked),
spans AS (
  SELECT rid, tid, label, base, min(diagonal + t_pos) AS first, max(diagonal + t_pos + k) - min(diagonal + t_pos) AS length,
         CAST(count(DISTINCT t_pos) AS DOUBLE) / (n - k + 1) AS coverage,
         coverage >= share AND length <= n + 2 * slack AS verified
  FROM clustered JOIN templates USING (tid)
  GROUP BY rid, tid, label, base, cluster, n, k, slack, share)
SELECT doc_id, CAST(len(any_value(words)) AS BIGINT) AS n_words,
       count(*) FILTER (verified AND base) AS n_base,
       CAST(min(first) FILTER (verified AND base) AS BIGINT) AS first_word,
       CAST(max(first) FILTER (verified AND base) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified AND base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified), '') AS labels,
       coalesce(max(coverage), 0.0) AS score
FROM texts LEFT JOIN spans USING (rid)
GROUP BY rid, doc_id
"""

# Bytes as pairs of hex digits; texts are cut into blocks of 1000 windows so that no long string is scanned per window.
_REPEATS = r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS digits, length(digits) // 2 AS n
  FROM documents),
blocks AS (
  SELECT rid, doc_id, n, first, substr(digits, 2 * first + 1, 2 * (1000 + 49)) AS part
  FROM (SELECT *, unnest(range(0, n - 49, 1000)) AS first FROM texts WHERE n >= 50)),
windows AS (
  SELECT rid, doc_id, first + i AS pos, substr(part, 2 * i + 1, 100) AS bytes
  FROM (SELECT *, unnest(range(0, least(1000, n - 49 - first))) AS i FROM blocks)),
least_ids AS (
  SELECT bytes, min(doc_id) AS least FROM windows GROUP BY bytes HAVING min(doc_id) < max(doc_id)),
starts AS (
  SELECT rid, pos FROM windows JOIN least_ids USING (bytes) WHERE least < doc_id),
marked AS (
  SELECT *, CASE WHEN pos - lag(pos) OVER o <= 50 THEN 0 ELSE 1 END AS fresh
  FROM starts WINDOW o AS (PARTITION BY rid ORDER BY pos)),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY pos) AS run FROM marked),
runs AS (
  SELECT rid, min(pos) AS a, max(pos) + 50 AS b FROM numbered GROUP BY rid, run),
-- what is kept: the bytes between one run and the next, with an empty run at the end of each text
edges AS (
  SELECT rid, a, b FROM runs UNION ALL SELECT rid, n, n FROM texts),
kept AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a, b), 0) AS since FROM edges),
joined AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) FILTER (b > a) AS n_spans,
         string_agg(substr(digits, 2 * since + 1, 2 * (a - since)), '' ORDER BY a, b) AS rest
  FROM kept JOIN texts USING (rid) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(rest)) AS kept_sha256
FROM texts JOIN joined USING (rid)
"""

# Keys: ends stripped, A-Z lower-cased; every row is a document.
_LINES = r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM texts),
keyed AS MATERIALIZED (
  SELECT rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
marked AS (
  SELECT k.rid, k.pos, k.line, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked JOIN texts USING (rid) GROUP BY rid, doc_id
"""

# CRC-32 of the decimal id bit by bit; nodes are prefixes by the hash of all their turns; subtrees by the members' paths.
_TRIE = r"""
WITH RECURSIVE ids AS MATERIALIZED (
  SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, i, r) AS (
  SELECT c, s, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT c, s, i + 1,
         xor(mixed // 2, CASE WHEN mixed % 2 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT *, xor(r, CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT) ELSE 0 END) AS mixed
        FROM crc WHERE i < 8 * length(s))),
shares AS (
  SELECT c, c - c % 20 AS base, xor(r, CAST(4294967295 AS BIGINT)) % 4 AS h FROM crc WHERE i = 8 * length(s)),
turns AS MATERIALIZED (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rank
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT s.c, t.rank AS pos, t.role, t.text FROM shares s JOIN turns t ON t.c = s.base AND t.rank <= s.h),
n_heads AS (SELECT c, count(*) AS n FROM heads GROUP BY c),
rebuilt AS (
  SELECT * FROM heads
  UNION ALL
  SELECT s.c, coalesce(n, 0) + t.rank - s.h, t.role, t.text
  FROM shares s JOIN turns t ON t.c = s.c AND t.rank > s.h LEFT JOIN n_heads n ON n.c = s.c),
hashed AS (
  SELECT c, pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, sha256(length(role) || ':' || role || text) AS turn
  FROM rebuilt),
paths AS MATERIALIZED (
  SELECT c, pos, words, sha256(string_agg(turn, '') OVER (PARTITION BY c ORDER BY pos)) AS node FROM hashed
  UNION ALL
  SELECT c, 0, 0, 'root' FROM ids),
ends AS (SELECT c, max_by(node, pos) AS node FROM paths GROUP BY c),
end_lists AS (SELECT node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ids FROM ends GROUP BY node),
nodes AS MATERIALIZED (
  SELECT node, pos AS depth, count(*) AS n_convs, min(c) AS conv_id, min(words) AS words FROM paths GROUP BY node, pos),
above AS MATERIALIZED (
  SELECT n.node, p.node AS parent FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.pos = n.depth - 1),
children AS (SELECT parent AS node, count(*) AS n_children FROM above GROUP BY parent),
valued AS (
  SELECT n.node, n.conv_id, n.depth, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved
  FROM nodes n LEFT JOIN children USING (node)),
totals AS (
  SELECT p.node, sum(v.leaf) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM valued v JOIN paths p ON p.c = v.conv_id AND p.pos <= v.depth GROUP BY p.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ids, sha256('')) AS ends_sha256
FROM nodes n JOIN totals USING (node) LEFT JOIN children USING (node) LEFT JOIN above a USING (node)
LEFT JOIN nodes u ON u.node = a.parent LEFT JOIN end_lists e ON e.node = n.node
"""

_RANKED = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
terms AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
counted AS MATERIALIZED (SELECT rid, doc_id, term, count(*) AS tf FROM terms GROUP BY rid, doc_id, term),
docs AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY rid),
whole AS (SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM docs),
norms AS (SELECT rid, 25 + (75 * n * N_docs) // L AS m FROM docs, whole),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(N_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counted, whole GROUP BY term),
items AS (
  SELECT row_number() OVER () AS iid, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM benchmark),
asked AS (
  SELECT iid, item_id, term, count(*) AS times
  FROM (SELECT iid, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items)
  GROUP BY iid, item_id, term),
scored AS (
  SELECT iid, item_id, c.rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN counted c USING (term) JOIN weights USING (term) JOIN norms USING (rid)
  GROUP BY iid, item_id, c.rid, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op1_license_scan": _LICENSE, "op7_suffix_dedup": _REPEATS, "op11_line_dedup": _LINES,
                              "op12_prefix_trie": _TRIE, "op13_lexical_search": _RANKED}
