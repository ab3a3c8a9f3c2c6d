"""DuckDB SQL of the operators' queries, where SQL can express their results."""

#: Windows of items against windows of documents; hits are the words that some window covers.
OP10 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
         regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
        FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT k, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT k, p, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
covered AS (
  SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS x FROM hits) GROUP BY k),
items AS (
  SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT k, item_id FROM hits) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN items USING (k)
"""

#: The tree in SQL: leaves, constants by place, templates, and what is dropped but for the first document.
OP3 = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS k FROM documents),
cut AS (SELECT doc_id, k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM d WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, k, pos, line, t, len(t) AS n,
         array_to_string(list_transform(t[1:3], lambda x: CASE WHEN contains(x, '#') THEN '<*>' ELSE x END), ' ') AS lead,
         array_to_string(t, ' ') AS shape
  FROM (SELECT *, list_filter(regexp_split_to_array(regexp_replace(line, '[0-9]+', '#', 'g'), '[ \t\r\f\x0B]+'), lambda x: x <> '') AS t FROM cut)
  WHERE doc_id IS NOT NULL AND len(t) >= 3),
leaves AS (SELECT n, lead FROM l GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
kinds AS (SELECT n, lead, shape, any_value(t) AS t, count(DISTINCT doc_id) AS docs FROM l JOIN leaves USING (n, lead) GROUP BY n, lead, shape),
e AS (SELECT n, lead, shape, docs, unnest(t) AS token, generate_subscripts(t, 1) AS place FROM kinds),
constants AS (SELECT n, lead, place, token FROM e GROUP BY ALL HAVING sum(docs) >= 10),
templates AS (
  SELECT n, lead, shape, string_agg(place || '=' || token, ' ' ORDER BY place) AS template
  FROM e JOIN constants USING (n, lead, place, token) GROUP BY n, lead, shape HAVING count(*) >= n * 0.7),
recurring AS (
  SELECT n, lead, template, min(doc_id) AS first_id FROM l JOIN templates USING (n, lead, shape)
  GROUP BY n, lead, template HAVING count(DISTINCT doc_id) >= 10),
gone AS (
  SELECT k, pos FROM l JOIN templates USING (n, lead, shape) JOIN recurring USING (n, lead, template) WHERE doc_id > first_id),
kept AS (
  SELECT k, count(*) AS n_lines, count(g.pos) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY c.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM cut c LEFT JOIN gone g USING (k, pos) GROUP BY k)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       sha256(kept) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes(rounds: int = 4) -> str:
    """Each round compares all parts with all entries, then takes means; squared distance * 256 + index has its minimum
    at the nearest entry, the lower index at ties."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE {_FINITE}),
parts AS MATERIALIZED (
  SELECT k, p, x, list_dot_product(x, x) AS xx
  FROM (SELECT k, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS p))),
firsts AS (SELECT k, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 256),
b0 AS MATERIALIZED (SELECT p, e, x AS c, xx AS cc FROM parts JOIN firsts USING (k)),"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT k, p, min(CAST(xx + cc - 2 * list_dot_product(x, c) AS BIGINT) * 256 + e) AS m FROM parts JOIN b{r} USING (p) GROUP BY k, p)""" + ("," if r < rounds else ""))
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT p, m % 256 AS e, i, floor(CAST(sum(CAST(y AS BIGINT)) AS DOUBLE) / count(*)) AS y
  FROM (SELECT p, m, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM parts JOIN a{r} USING (k, p)) GROUP BY p, m % 256, i),
n{r} AS (SELECT p, e, list(y ORDER BY i) AS c FROM m{r} GROUP BY p, e),
b{r + 1} AS MATERIALIZED (
  SELECT p, e, c, list_dot_product(c, c) AS cc
  FROM (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN n{r} n ON b.p = n.p AND b.e = n.e)),""")
    steps.append(f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i))
        FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM b{rounds})) AS codebooks_sha256
FROM kept JOIN (
  SELECT k, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY k) USING (k)
""")
    return "".join(steps)


#: All anchors against all rows.
OP12 = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS id, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""

#: All pairs of a label, and what links reach.
OP13 = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {_FINITE} AS fine FROM embeddings),
g AS MATERIALIZED (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE fine AND label IS NOT NULL AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT u AS vec_id, u AS root FROM links UNION SELECT w, root FROM reach JOIN links ON u = vec_id),
roots AS (SELECT vec_id, min(root) AS root FROM reach GROUP BY vec_id),
degrees AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM e LEFT JOIN roots USING (vec_id) LEFT JOIN degrees USING (vec_id)
"""

ORACLES = {
    "op3_line_dedup": OP3, "op10_decontamination": OP10, "op11_vector_codes": _codes(), "op12_hard_negatives": OP12, "op13_vector_near_duplicates": OP13,
}
