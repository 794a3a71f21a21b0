"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import sharding

#: Words of a text: a list of maximal runs without white space.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_sharding() -> str:
    slots = ",".join(map(str, sharding.lookup_table()))
    return f"""
WITH t AS (SELECT string_split('{slots}', ',') AS slots),
d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SIZE} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(slots[slot + 1] AS INTEGER) AS shard FROM d, t"""


def op2_topk() -> str:
    return """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.v AS which, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, which ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


def mix_sql(docs: str) -> str:
    """CTEs that end in ``mixed``: the columns of ``docs`` with size, source_size, target and times. Each source is sorted whole, row by
    row: a row is taken if half of it at least comes before the target."""
    return f"""
sizes AS (SELECT *, CAST(len({WORDS}) AS BIGINT) AS size,
  (CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM {docs}),
by_source AS (SELECT source AS s, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST(CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w, 3 * source_size AS most FROM by_source),
levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS BIGINT) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS level
  FROM weighed WINDOW b AS (ORDER BY most / w, s ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT s, source_size, CASE WHEN most <= w * level THEN CAST(most AS DOUBLE) ELSE w * (SELECT max(level) FROM levels WHERE most > w * level) END AS target FROM levels),
classed AS (SELECT z.*, g.source_size, g.target, CASE WHEN size < 64 THEN 1 WHEN size < 256 THEN 2 ELSE 3 END AS dw FROM sizes z JOIN goals g ON z.source IS NOT DISTINCT FROM g.s),
n AS (SELECT source, any_value(target) AS target, CAST(coalesce(sum(size) FILTER (dw = 1), 0) AS BIGINT) AS s1, CAST(coalesce(sum(size) FILTER (dw = 2), 0) AS BIGINT) AS s2, CAST(coalesce(sum(size) FILTER (dw = 3), 0) AS BIGINT) AS s3 FROM classed GROUP BY source),
lv AS (SELECT *, CASE WHEN s1 + s2 + s3 > 0 THEN target / (3 * s3 + 2 * s2 + s1) ELSE 0 END AS v3, CASE WHEN s1 + s2 > 0 THEN (target - 3 * s3) / (2 * s2 + s1) ELSE 0 END AS v2, CASE WHEN s1 > 0 THEN (target - 3 * (s3 + s2)) / s1 ELSE 0 END AS v1 FROM n),
held AS (SELECT classed.*, CASE WHEN 3 * v3 < 3 THEN dw * v3 WHEN 2 * v2 < 3 THEN CASE WHEN dw = 3 THEN 3.0 ELSE dw * v2 END WHEN v1 < 3 THEN CASE WHEN dw > 1 THEN 3.0 ELSE v1 END ELSE 3.0 END AS c
  FROM classed JOIN lv ON classed.source IS NOT DISTINCT FROM lv.source),
keyed AS (SELECT *, CAST(floor(c) AS BIGINT) AS whole, target - sum(CAST(floor(c) AS BIGINT) * size) OVER (PARTITION BY source) AS rest,
  CASE WHEN c > floor(c) THEN (u / (1 - u)) / ((c - floor(c)) / (1 - (c - floor(c)))) END AS r FROM held),
ahead AS (SELECT *, coalesce(sum(CASE WHEN r IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY r NULLS LAST, coalesce(CAST(doc_id AS VARCHAR), ''), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM keyed),
mixed AS (SELECT *, whole + CASE WHEN r IS NOT NULL AND past + size / 2 <= rest THEN 1 ELSE 0 END AS times FROM ahead)"""


def op5_mixing() -> str:
    return f"WITH {mix_sql('documents')}\nSELECT doc_id, size, source_size, target, CAST(times * size AS BIGINT) AS taken FROM mixed"


def dedup_sql(docs: str) -> str:
    """CTEs that end in ``deduped``: the columns of ``docs`` with n_removed and new_text."""
    return f"""
split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs} WHERE text IS NOT NULL),
held AS (SELECT *, regexp_extract(line, '[^\\x20\\x09-\\x0D].*[^\\x20\\x09-\\x0D]|[^\\x20\\x09-\\x0D]', 0, 's') AS body FROM split WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
runs AS (SELECT doc_id, i AS i1, lead(i, 1) OVER d AS i2, lead(i, 2) OVER d AS i3, body || chr(10) || lead(body, 1) OVER d || chr(10) || lead(body, 2) OVER d AS w FROM held WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
placed AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i1) AS nth FROM runs WHERE w IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i1, i2, i3]) AS i FROM placed WHERE nth > 1),
rest AS (SELECT s.doc_id, count(g.i) AS n_removed, coalesce(string_agg(s.line, chr(10) ORDER BY s.i) FILTER (g.i IS NULL), '') AS new_text FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY s.doc_id),
deduped AS (SELECT d.*, coalesce(r.n_removed, 0) AS n_removed, r.new_text FROM {docs} d LEFT JOIN rest r ON d.doc_id = r.doc_id)"""


def op8_line_dedup() -> str:
    return f"WITH {dedup_sql('documents')}\nSELECT doc_id, CAST(n_removed AS BIGINT) AS n_removed, sha256(new_text) AS text_sha256 FROM deduped"


def op4_minhash() -> str:
    """All pairs that share a shingle, and components by reachability."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""


def op10_quality() -> str:
    """Thresholds from exact quartiles of sorted values, bin by bin: of the language and source, or where that has fewer than 50 documents
    of the language, or of all."""
    failed = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 7)),
again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id)),
good AS (SELECT * FROM c WHERE NOT ({failed})),
x AS (SELECT *, greatest(word_chars, 1) / greatest(n_words, 1) AS length, (n_symbols + 1) / (n_words + 1) AS symbols, (n_dup_lines + 1) / (n_lines + 1) AS dups FROM c),
b AS (SELECT *, floor(log2(length) * 32 + 1e-6) AS b0, floor(log2(symbols) * 32 + 1e-6) AS b1, floor(log2(dups) * 32 + 1e-6) AS b2 FROM x),
q AS (SELECT lang, source, grouping(lang) + grouping(source) AS level, count(*) AS n, quantile_disc(b0, 0.25) AS l0, quantile_disc(b0, 0.75) AS h0, quantile_disc(b1, 0.25) AS l1, quantile_disc(b1, 0.75) AS h1,
  quantile_disc(b2, 0.25) AS l2, quantile_disc(b2, 0.75) AS h2 FROM b WHERE NOT ({failed}) GROUP BY GROUPING SETS ((lang, source), (lang), ())),
t AS (SELECT *, l0 - 5 * greatest(2, h0 - l0) AS least0, h0 + 5 * greatest(2, h0 - l0) AS most0, h1 + 2 * greatest(32, h1 - l1) AS most1, h2 + 1.5 * greatest(32, h2 - l2) AS most2 FROM q),
p AS (SELECT f.lang, f.source, CASE WHEN f.n >= 50 THEN f WHEN l.n >= 50 THEN l ELSE a END AS t FROM t f JOIN t l ON f.level = 0 AND l.level = 1 AND f.lang IS NOT DISTINCT FROM l.lang JOIN t a ON a.level = 2),
c2 AS (SELECT b.*, NOT ({failed}) AND b0 BETWEEN t.least0 AND t.most0 AND b1 <= t.most1 AND b2 <= t.most2 AS good FROM b LEFT JOIN p ON b.lang IS NOT DISTINCT FROM p.lang AND b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, coalesce(good, false) AS kept FROM c2"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": op1_sharding(), "op2_topk": op2_topk(), "op4_minhash": op4_minhash(), "op5_mixing": op5_mixing(), "op8_line_dedup": op8_line_dedup(), "op10_quality": op10_quality()}
