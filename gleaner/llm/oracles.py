"""DuckDB SQL of those queries whose results it can express."""

from __future__ import annotations

#: Every string of 400 bytes by its digest; hex digits stand for bytes, two each.
OP9 = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT r, i, md5(substring(h, 2 * i + 1, 800)) AS k
  FROM (SELECT r, h, unnest(range(length(h) // 2 - 399)) AS i FROM texts WHERE length(h) >= 800)),
repeated AS (
  SELECT r, i FROM strings JOIN (SELECT k FROM strings GROUP BY k HAVING count(*) > 1) USING (k)),
marked AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS begins FROM repeated),
runs AS (
  SELECT r, run, min(i) AS a, max(i) + 400 AS b
  FROM (SELECT r, i, sum(begins) OVER (PARTITION BY r ORDER BY i) AS run FROM marked) GROUP BY r, run),
gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS kept_from FROM runs),
cut AS (
  SELECT r, string_agg(substring(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS kept, max(b) AS last,
         sum(b - a) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)
"""

#: Targets by taking sources in order of how soon their stop is met; then slots, ranks and blocks as the operator has them.
OP10 = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(text, '')) AS h
  FROM documents),
sources AS (
  SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place
        FROM docs GROUP BY source)),
total AS (SELECT sum(source_size) * 1.5::DOUBLE AS wanted, sum(weight) AS weight FROM sources),
steps AS (
  SELECT k, (wanted - capped) / nullif(total.weight - capped_weight, 0) AS rate FROM total, (
    SELECT row_number() OVER w AS k, sum(cap) OVER w AS capped, sum(weight) OVER w AS capped_weight
    FROM sources WINDOW w AS (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT 0, 0.0, 0.0)),
ordered AS (SELECT row_number() OVER (ORDER BY cap / weight, place) AS n, cap, weight FROM sources),
rates AS (
  SELECT rate FROM steps LEFT JOIN ordered ON n = k + 1
  WHERE rate IS NOT NULL AND (n IS NULL OR cap > weight * rate) ORDER BY k LIMIT 1),
targets AS (SELECT s.*, least(cap, weight * rate) AS target FROM sources s, rates),
blocks AS (
  SELECT place, source_size, target, CAST(ceil(source_size / 128.0::DOUBLE) AS BIGINT) AS blocks FROM targets WHERE source_size > 0),
parts AS (
  SELECT *, sum(need) OVER (ORDER BY place) - need AS first, sum(need) OVER () AS slots
  FROM (SELECT place, blocks, least(CAST(ceil(target * blocks / source_size) AS BIGINT), blocks * 2) AS need FROM blocks)),
points AS (
  SELECT slot, CAST(floor(((slot % 1073741824) * 2654435769 % 4294967296) / 4294967296.0::DOUBLE * slots) AS BIGINT) AS at_
  FROM (SELECT slots, unnest(range(slots::BIGINT)) AS slot FROM (SELECT any_value(slots) AS slots FROM parts))),
ranked AS (
  SELECT place, blocks, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank
  FROM points JOIN parts ON at_ >= first AND at_ < first + need),
times AS (
  SELECT place, rank % blocks AS block, count(*) AS times FROM ranked WHERE rank // blocks < 2 GROUP BY 1, 2),
laid AS (
  SELECT r, doc_id, size, t.source_size, t.target, t.place,
         sum(size) OVER (PARTITION BY t.place ORDER BY md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR), h)), doc_id, h, r) - size AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
pieces AS (
  SELECT r, place, block, least(start + size, (block + 1) * 128) - greatest(start, block * 128) AS words
  FROM (SELECT *, unnest(range(CAST(start // 128 AS BIGINT), CAST((start + size - 1) // 128 + 1 AS BIGINT))) AS block FROM laid WHERE size > 0)),
taken AS (SELECT r, sum(words * times) AS taken FROM pieces JOIN times USING (place, block) GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM laid LEFT JOIN taken USING (r)
"""

#: Every query with every row, a component a row.
OP11 = """
WITH every AS (
  SELECT r, vec_id, unnest(generate_series(1, len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM (SELECT row_number() OVER () AS r, * FROM embeddings)),
parts AS (
  SELECT r, vec_id, d, CAST(floor(1024 * x) AS BIGINT) AS x FROM every
  WHERE r NOT IN (SELECT r FROM every WHERE x IS NULL OR NOT isfinite(x))),
scores AS (
  SELECT q.vec_id AS query_id, c.r, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.d = c.d AND q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
  GROUP BY q.r, q.vec_id, c.r, c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scores)
WHERE rank <= 10
"""

#: Every item with every document that shares a term with it.
OP13 = """
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
tfs AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM lowered GROUP BY r, term),
sizes AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY r),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
measures AS (SELECT r, 100 - 75 + ((75 * n * docs) // terms) AS m FROM sizes, totals),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, totals GROUP BY term, docs),
asked AS (
  SELECT i, any_value(item_id) AS item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark) GROUP BY i, term),
scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN measures USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""

ORACLES = {"op9_suffix_dedup": OP9, "op10_mixing": OP10, "op11_exact_search": OP11, "op13_ranked_search": OP13}
