"""DuckDB SQL of the queries that SQL can express, written from their
definitions: every 50-byte string, every pair of sets, every test."""

from __future__ import annotations

from ratecraft.llm import quality_rules as qr

SQL: dict[str, str] = {}

SQL["op1_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
  w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s
        FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
  f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
  hit AS (SELECT w.r, w.p FROM w JOIN f USING (s) WHERE f.least < w.doc_id OR (w.doc_id IS NULL AND f.least IS NOT NULL)),
  step AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM hit),
  run AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY r ORDER BY p) AS k FROM step),
  span AS (SELECT r, min(p) AS a, max(p) + 50 AS z FROM run GROUP BY r, k),
  gap AS (SELECT s.*, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM span s),
  cut AS (SELECT g.r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS upto,
                 string_agg(substr(d.h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
          FROM gap g JOIN d USING (r) GROUP BY g.r)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * upto + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)"""


def _rule(name: str, cutoff: str) -> str:
    top, bottom, high, _ = qr.RULES[name]
    return f"coalesce({bottom} > 0 AND {top} / {bottom} {'>' if high > 0 else '<'} {cutoff}, FALSE)"


_JOINT = [" OR ".join(_rule(r, str(qr.path(r)[i])) for r in qr.RULES) for i in range(qr.STEPS)]
_CUTS = ", ".join(f"([{', '.join(map(str, qr.path(r)))}]::DOUBLE[])[step + 1] AS cut_{r}" for r in qr.RULES)

SQL["op2_quality_rules"] = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS x FROM documents),
  v AS (SELECT *, [w for w in regexp_split_to_array(x, '[\x20\x09-\x0D]+') if w <> ''] AS w,
               [l for l in string_split(x, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] AS l FROM t),
  win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
          FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM v WHERE len(w) >= 3)),
  rep AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS j
          FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
  rw AS (SELECT r, sum(least(3, i - coalesce(j, -3))) AS n FROM rep GROUP BY r),
  m AS (SELECT v.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(len(x) - len(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words FROM v LEFT JOIN rw USING (r)),
  b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
  good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
  held AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
  tests AS ({" UNION ALL ".join(
      f"SELECT stratum, {i} AS step, count(*) AS n, count(*) FILTER ({joint}) AS k FROM held GROUP BY stratum"
      for i, joint in enumerate(_JOINT))}),
  p AS (SELECT *, CASE WHEN k >= n * {qr.RISK} THEN 1 ELSE list_sum(
          [exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({qr.RISK}) + (n - j) * ln(1 - {qr.RISK}))
           for j in range(0, k + 1)]) END AS p FROM tests),
  last AS (SELECT stratum, coalesce(min(step) FILTER (p * (SELECT count(DISTINCT stratum) FROM held) > {qr.ERROR}), {qr.STEPS}) - 1 AS step
           FROM p GROUP BY stratum),
  cuts AS (SELECT stratum, {_CUTS} FROM last WHERE step >= 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(_rule(r, f"cut_{r}") for r in qr.RULES)}) AS kept
FROM b LEFT JOIN cuts USING (stratum)"""

SQL["op5_ngram_jaccard_join"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, [w for w in regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if w <> ''] AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
         UNION SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) IN (1, 2)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  sized AS (SELECT sh.*, n.n FROM sh JOIN n USING (doc_id)),
  link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id <> b.doc_id
             AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
           GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
            UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       (SELECT min(y) FROM reach WHERE x = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(
    f"substr('{_LETTERS}', (('0x' || substr(s, {5 * i + 1}, 5))::BIGINT >> {15 - 5 * j}) % 32 + 1, 1)"
    for i in range(8) for j in range(4))

SQL["op6_warc_archive"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
  o AS (SELECT html, max(page_id) AS owner FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p JOIN o ON p.html = o.html"""

SQL["op11_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
  v AS (SELECT *, [w for w in regexp_split_to_array(x, '[\x20\x09-\x0D]+') if w <> ''] AS w,
               min(doc_id) OVER (PARTITION BY x) AS least FROM t),
  f AS (SELECT part,
               CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
               + 4 * CAST(100 * (len(x) - len(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * len(x) AS INT)
               + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, FALSE) AS INT) AS mask,
               EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.doc_id AND l.quality = 1) AS good,
               EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.doc_id AND l.toxic = 1) AS toxic FROM v),
  m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
  letters AS (SELECT unnest(string_split('A B C D E', ' ')) AS l),
  orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
             WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
  steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS l FROM orders, (SELECT unnest(range(1, 6)) AS step)),
  bits AS (SELECT filter_order, CAST(step AS INTEGER) AS step, l, 1 << (instr('ABCDE', l) - 1) AS own,
                  coalesce(list_sum([1 << (instr('ABCDE', c) - 1) for c in string_split(substr(filter_order, 1, step - 1), '')
                                     if c <> '']), 0)::INT AS past FROM steps),
  r AS (SELECT part, filter_order, step, l,
               coalesce(sum(n) FILTER (mask & (own | past) = 0), 0) AS kept,
               coalesce(sum(n) FILTER (mask & own <> 0 AND mask & past = 0), 0) AS removed,
               coalesce(sum(n) FILTER (mask & own <> 0 AND mask & past <> 0), 0) AS redundant,
               coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
               coalesce(sum(good) FILTER (mask & own <> 0 AND mask & past = 0), 0) AS good_lost,
               coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & past = 0), 0) AS toxic_lost
        FROM m, bits GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM r"""
