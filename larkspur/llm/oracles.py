"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from larkspur.llm.quality_rules import BOILERPLATE, LINE_END, NAVIGATION_MARKS

_SPACE = r"[\x20\x09-\x0D]"
_SOLID = r"[^\x20\x09-\x0D]"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS three FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(3) AS r(k) GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
worded AS (SELECT doc_id, line, regexp_replace(line, '[\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]+', '', 'g') AS marks FROM split WHERE regexp_matches(line, '{_SOLID}')),
judged AS (SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '{_SPACE}+'), lambda w: w <> '')) AS n,
  length(marks) * 100 > length(line) * 20
  OR length(marks) - length(translate(marks, '{NAVIGATION_MARKS}', '')) >= 3
  OR (NOT regexp_matches(line, '^{_SPACE}*(?:{_SOLID}+{_SPACE}+){{3}}{_SOLID}') AND NOT regexp_matches(line, '{_quoted(LINE_END)}'))
  OR {" OR ".join(f"contains(lower(line), '{x}')" for x in BOILERPLATE)} AS fails FROM worded),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, coalesce(sum(n) FILTER (fails), 0) AS lost FROM judged GROUP BY doc_id),
counted AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_words
  FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= 50 * n_words AS kept, lost_words FROM counted
"""

_OP5 = """
WITH r AS (SELECT page_id, 'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'WARC-Record-ID: <urn:record:' || page_id
  || '>' || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e AS d FROM pages, (SELECT chr(13) || chr(10) AS e))
SELECT page_id, strlen(d)::BIGINT AS length, sha256(d) AS hash, strlen(d)::BIGINT AS other_length, sha256('~' || substr(d, 2)) AS other_hash
FROM r WHERE sha256(d)[:2] IN ('00', '7f')
"""

_OP10 = rf"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SOLID}+'))::BIGINT AS size,
  substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12) AS h FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::BIGINT AS weight, 3 * source_size AS cap FROM sized),
leveled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM ranked WINDOW w AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT min_by(level, (cap / weight, source IS NULL, source)) AS level FROM leveled WHERE cap > level * weight),
goal AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, free.level * weight), cap::DOUBLE) AS target FROM leveled, free),
plan0 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies, target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS rest, '' AS below, 'inf'::DOUBLE AS fits FROM goal),
{"".join(rf"""run{k} AS (SELECT p.source, h, size, sum(size) OVER (PARTITION BY p.source ORDER BY h) AS upto, rest FROM docs d JOIN plan{k - 1} p ON d.source IS NOT DISTINCT FROM p.source
  WHERE size > 0 AND rest > 0 AND h >= p.below AND size <= {'p.fits' if k == 1 else 'p.rest'}),
edge{k} AS (SELECT source, min(h) FILTER (upto > rest) AS h, max(upto) AS everything FROM run{k} GROUP BY source),
step{k} AS (SELECT e.source, e.h, e.everything, coalesce(sum(size) FILTER (r.h < e.h), 0) AS under, sum(size) FILTER (r.h = e.h) AS at_edge FROM edge{k} e JOIN run{k} r ON e.source IS NOT DISTINCT FROM r.source GROUP BY ALL),
plan{k} AS (SELECT p.source, source_size, target, copies, {'' if k == 1 else ', '.join(f'fits{j}, below{j}' for j in range(1, k)) + ', '}
  {"'inf'::DOUBLE" if k == 1 else 'p.rest'} AS fits{k}, p.fits,
  CASE WHEN p.rest <= 0 THEN p.below WHEN s.h IS NULL THEN 'g' {"WHEN s.at_edge - (p.rest - s.under) < p.rest - s.under THEN s.h || 'g'" if k == 3 else ''} ELSE s.h END AS below{k}, below{k} AS below,
  CASE WHEN p.rest <= 0 THEN p.rest WHEN s.h IS NULL THEN p.rest - coalesce(s.everything, 0) ELSE p.rest - s.under END AS rest
  FROM plan{k - 1} p LEFT JOIN step{k} s ON p.source IS NOT DISTINCT FROM s.source),
""" for k in (1, 2, 3))}
final AS (SELECT * FROM plan3)
SELECT doc_id, size, source_size, target, size * (copies + (((size <= fits1 AND h < below1) OR (size <= fits2 AND h < below2) OR (size <= fits3 AND h < below3))::BIGINT)) AS taken
FROM docs d JOIN final f ON d.source IS NOT DISTINCT FROM f.source
"""

#: Vectors of one length without repeated ids, as the given table has them.
_OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""

#: CRC-32 byte by byte over each distinct feature; an entry of the table is a byte after eight shifts.
_SHIFTED = "xor(t >> 1, CASE WHEN t & 1 = 1 THEN 3988292384 ELSE 0 END)"

_OP11 = rf"""
WITH crc AS (SELECT list(t ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda t, x: {_SHIFTED}) AS t FROM range(256) r(i))),
texts AS (SELECT true AS own, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
words AS MATERIALIZED (SELECT own, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM texts),
grams AS MATERIALIZED (SELECT own, row, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT own, row, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS k(n))),
hashed AS (SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(gram), 2), lambda i: 16 * instr('123456789ABCDEF', h[i]) + instr('123456789ABCDEF', h[i + 1]))),
  lambda a, b: xor(a >> 8, crcs[xor(a & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM grams)), crc),
features AS MATERIALIZED (SELECT own, row, bucket FROM grams JOIN hashed USING (gram)),
counts AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM features GROUP BY bucket),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, totals),
summed AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE own GROUP BY row),
scored AS (SELECT doc_id, len(ws) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM words LEFT JOIN summed USING (row) WHERE own),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST, weight DESC) AS place, count(*) FILTER (able) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""

#: (kind, pattern, group whose length counts, its least length)
_KINDS = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("prefixed", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza)([A-Za-z0-9_-]+)", 1, 16),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 1, 8),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]
_HITS = " UNION ALL ".join(f"SELECT row, {i} AS nr, regexp_extract_all(t, '{p}') AS found, regexp_extract_all(t, '{p}', {g}) AS part, string_split_regex(t, '{p}') AS gaps, {n} AS least FROM d" for i, (_, p, g, n) in enumerate(_KINDS))

#: A match's place is the length of what stands before it: the pieces between matches and the matches themselves.
_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
kinds AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k[0]}')" for i, k in enumerate(_KINDS))}) AS k(nr, kind)),
hits AS ({_HITS}),
placed AS (SELECT row, nr, least, part[i] AS part, len(found[i]) AS size, list_sum(list_transform(gaps[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: len(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM hits)),
spans AS (SELECT row, nr, start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM placed JOIN kinds USING (nr) WHERE len(part) >= least)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (nr = 0) AS n_assign, count(*) FILTER (nr = 1) AS n_access, count(*) FILTER (nr = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, nr) FILTER (nr < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, nr), '') AS spans
FROM d LEFT JOIN spans USING (row) GROUP BY row
"""

_ROUNDS = 10
_GAP = "list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_ASSIGNED = f"SELECT row, vec_id, v, min_by(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (SELECT row, vec_id, v, cluster, {_GAP} AS distance FROM kept, {{}}) GROUP BY ALL"
_ROUND = f"""a{{i}} AS MATERIALIZED ({_ASSIGNED.format('c{before}')}),
m{{i}} AS (SELECT cluster, list(m ORDER BY dim) AS c FROM (SELECT cluster, dim, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS dim FROM a{{i}}) GROUP BY ALL) GROUP BY cluster),
c{{i}} AS MATERIALIZED (SELECT cluster, coalesce(m{{i}}.c, c{{before}}.c) AS c FROM c{{before}} LEFT JOIN m{{i}} USING (cluster)),
"""

_OP13 = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT v, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept ORDER BY h, v LIMIT 8)),
{"".join(_ROUND.format(i=i, before=i - 1) for i in range(1, _ROUNDS + 1))}
last AS ({_ASSIGNED.format(f'c{_ROUNDS}')})
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN c{_ROUNDS} USING (cluster)
"""

ORACLES = {"op3_quality_rules": _OP3, "op4_topk": _OP4, "op5_warc_audit": _OP5, "op10_mixing": _OP10, "op11_resampling": _OP11, "op12_secret_scan": _OP12, "op13_clustering": _OP13}
