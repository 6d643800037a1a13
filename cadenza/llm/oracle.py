"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from cadenza.llm.licenses import COVER, DRIFT, PHRASES, TEMPLATES, template_grams

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def grams_sql() -> str:
    """The grams of phrases and templates as VALUES."""
    rows = ", ".join(f"({tid}, '{label}', {exact}, {n}, {k}, {j}, '{gram}')" for tid, label, exact, n, k, j, gram in template_grams(PHRASES, TEMPLATES))
    return f"t(tid, label, exact, n, k, j, gram) AS (VALUES {rows})"


OP4 = rf"""
WITH {grams_sql()},
d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, x[1] - 1 AS i, x[2] || ' ' || x[3] AS two, x[2] || ' ' || x[3] || ' ' || x[4] || ' ' || x[5] AS four
  FROM (SELECT doc_id, unnest(list_zip(range(1, len(w) + 1), w, w[2:], w[3:], w[4:])) AS x FROM d)),
hits AS (SELECT doc_id, t.*, i FROM g JOIN t ON k = 2 AND two = gram UNION ALL SELECT doc_id, t.*, i FROM g JOIN t ON k = 4 AND four = gram),
votes AS (SELECT doc_id, tid, label, exact, n, k, i - j AS diag, list(DISTINCT j) AS js, min(i) AS lo, max(i) AS hi FROM hits GROUP BY ALL),
merged AS (SELECT * EXCLUDE (js), flatten(list(js) OVER v) AS js, min(lo) OVER v AS first, max(hi) OVER v + k - 1 AS last FROM votes WHERE NOT exact
  WINDOW v AS (PARTITION BY doc_id, tid ORDER BY diag RANGE BETWEEN CURRENT ROW AND {DRIFT} FOLLOWING)),
scored AS (SELECT *, len(list_distinct(flatten([js, list_transform(js, lambda j: j + 1), CASE WHEN k = 4 THEN list_transform(js, lambda j: j + 2) ELSE [] END,
  CASE WHEN k = 4 THEN list_transform(js, lambda j: j + 3) ELSE [] END]))) / n AS score FROM merged),
near AS (SELECT *, [score, first - last, -diag] AS rank FROM scored WHERE score >= {COVER}),
peaks AS (SELECT *, [score, n] AS value FROM (SELECT *, max(rank) OVER (PARTITION BY doc_id, tid ORDER BY diag RANGE BETWEEN {DRIFT} PRECEDING AND {DRIFT} FOLLOWING) AS top FROM near) WHERE rank = top),
best AS (SELECT *, max(value) OVER (PARTITION BY doc_id, first) AS at_first, max(value) OVER (PARTITION BY doc_id, last) AS at_last FROM peaks),
spans AS (SELECT doc_id, label, true AS exact, diag AS first, 1.0::DOUBLE AS score FROM votes WHERE exact AND len(js) = n - k + 1
  UNION ALL SELECT doc_id, label, false, NULL, score FROM best WHERE value >= at_first AND value >= at_last),
per AS (SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(first) AS first_word, max(first) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score, count(*) AS n_spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN per ON d.doc_id = per.doc_id
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {FOLDED} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""

# Base 32 of 160 bits: four times ten hexadecimal digits make eight digits of base 32.
OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       translate(array_to_string(list_transform([1, 11, 21, 31], lambda i: lpad(to_base(CAST(concat('0x', substr(hex, i, 10)) AS BIGINT), 32), 8, '0')), ''),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS valid
FROM f
"""

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS s
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
pos AS (SELECT a, c AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5),
neg AS (SELECT pos.a, p, ps, c, s, row_number() OVER (PARTITION BY pos.a, p ORDER BY s DESC, c) AS rank
  FROM pos JOIN s ON pos.a = s.a AND NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, c AS negative_id, ps AS positive_score, s AS negative_score FROM neg WHERE rank <= 10
"""

# The exact answer. Sums run from the first component on, as in the operator.
OP12 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY text) AS again FROM d),
m AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(again, false)] AS f FROM w),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, f),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, [instr('ABCDE', y) FOR y IN string_split(filter_order, '')] AS places FROM o, range(1, 6) r(step)),
e AS (SELECT part, filter_order, step, n, good, toxic, f, f[places[step]] AS own, list_contains(list_transform(places[1:step - 1], lambda p: f[p]), true) AS gone FROM c, s),
r AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE own AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE own AND len(list_filter(f, lambda y: y)) = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE own AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE own AND NOT gone), 0) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM r
"""

ORACLES: dict[str, str] = {"op4_license_scan": OP4, "op6_exact_dedup": OP6, "op8_warc": OP8, "op11_hard_negatives": OP11, "op12_nearest": OP12, "op13_filter_audit": OP13}
