"""SQL counterparts (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from tidewire.llm.secret_scan import BASE, RULES, Rule

_WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
    cast('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 3) AS INTEGER) AS bucket FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(source_size) OVER before, 0) AS full_size, coalesce(sum(weight) OVER before, 0) AS full_weight FROM w
  WINDOW before AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, cast(total - 3 * full_size AS DOUBLE) / cast(weights - full_weight AS DOUBLE) AS level FROM f),
m AS (SELECT max(CASE WHEN level * weight <= 3 * source_size THEN level END) AS level FROM l),
t AS (SELECT source, source_size, least(m.level * weight, cast(3 * source_size AS DOUBLE)) AS target FROM l, m),
g AS (SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size * 1000000000000) AS HUGEINT) ELSE 0 END AS rate FROM t),
z AS (SELECT source, size, count(*) AS m FROM d GROUP BY source, size),
o AS (SELECT z.*, coalesce(sum(m) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    cast('0x' || substr(md5('mix-1:' || coalesce(source, '')), 1, 12) AS BIGINT) % 1000000000000 AS start FROM z),
k AS (SELECT d.*, row_number() OVER (PARTITION BY d.source, d.size ORDER BY bucket, doc_id NULLS FIRST) AS i FROM d),
p AS (SELECT k.doc_id, k.size, g.source_size, g.target, g.rate, o.start, cast(o.before + k.i AS HUGEINT) AS x
  FROM k JOIN o ON o.source IS NOT DISTINCT FROM k.source AND o.size = k.size
  JOIN g ON g.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
  cast(size * ((x * rate + start) // 1000000000000 - ((x - 1) * rate + start) // 1000000000000) AS BIGINT) AS taken FROM p
"""


def _spans(rank: int, rule: Rule) -> str:
    """Spans of one rule: ends are sums of the lengths of gaps and matches so far."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT rid, e - length(x) AS s, e, {rank} AS rank, '{rule.kind}' AS kind FROM (
    SELECT rid, unnest(f) AS x, unnest(list_transform(range(1, len(f) + 1), lambda i: list_sum(n[1:i]))) AS e FROM (
      SELECT rid, f, list_transform(range(1, len(f) + 1), lambda i: length(f[i]) + length(g[i])) AS n FROM (
        SELECT rid, regexp_extract_all(text, '{pattern}', 0) AS f, string_split_regex(text, '{pattern}') AS g FROM t)))
  WHERE length(regexp_extract(x, '{pattern}', {rule.group})) >= {rule.least}"""


_DIGEST = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank){}, '')"
SECRETS = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({" UNION ALL ".join(_spans(i, rule) for i, rule in enumerate(RULES))})
SELECT t.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{rule.kind}') AS n_{rule.kind}" for rule in BASE)},
  sha256({_DIGEST.format(f" FILTER (WHERE rank < {len(BASE)})")}) AS base_sha256, {_DIGEST.format("")} AS spans
FROM t LEFT JOIN p ON p.rid = t.rid GROUP BY t.rid, t.doc_id
"""

CONTAMINATION = """
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
    FROM documents
), b AS (
    SELECT item_id, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
    FROM benchmark
), tests AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS string
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM tests
), found AS (
    SELECT r, i, size, item_id
    FROM (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS string
          FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)) JOIN tests USING (size, string)
), hits AS (
    SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r
), items AS (
    SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

COLLOCATIONS = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
grams AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM p, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size
), f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
over AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE size = 3),
kept AS (
    SELECT * FROM c WHERE NOT EXISTS (
        SELECT 1 FROM over o WHERE o.lang = c.lang AND o.phrase = c.phrase AND 100 * o.a >= 50 * c.a)
), cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r,
           CAST((1000000 * CAST(cuts.a AS HUGEINT) * cuts.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN n USING (lang) QUALIFY rank <= 2000
"""
