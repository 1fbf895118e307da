"""DuckDB SQL for the queries that SQL can express, written from the rules and not from the plans."""

from __future__ import annotations

from cartlens.llm.licenses import BASE, LEAST_SCORE, LOWER, TEMPLATES, UPPER, key_places
from cartlens.llm.licenses import WORD as LICENSE_WORD


OP1 = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents
),
s AS (
  SELECT source, sum(size) AS source_size, sum(size * (size * 1000 // (size + 256))) AS preferred FROM d GROUP BY source
),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s
),
o AS (
  SELECT *, 2 * source_size AS cap, sum(2 * source_size) OVER filled AS caps_upto,
         sum(weight) OVER () - sum(weight) OVER filled + weight AS weights_left,
         (sum(source_size) OVER ()) * 3 // 2 AS total
  FROM w
  WINDOW filled AS (
    ORDER BY source_size * 2 / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
  )
),
f AS (SELECT *, cap * weights_left <= weight * (total - (caps_upto - cap)) AS is_full FROM o),
l AS (
  SELECT (max(total) - coalesce(sum(CASE WHEN is_full THEN cap END), 0))::DOUBLE AS words,
         sum(CASE WHEN NOT is_full THEN weight END)::DOUBLE AS weights
  FROM f
),
t AS (
  SELECT source, source_size::BIGINT AS source_size, preferred,
         CASE WHEN is_full THEN cap::DOUBLE ELSE weight::DOUBLE * l.words / l.weights END AS target
  FROM f CROSS JOIN l
),
e AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CASE WHEN t.source_size > 0 THEN t.preferred::DOUBLE / t.source_size ELSE 0 END AS mean,
         (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
x AS (
  SELECT *, round(rate + least(rate, 2 - rate) * ((size * 1000 // (size + 256)) - mean) / 1000, 9) AS expected, u / (1 - u) AS odds
  FROM e
),
y AS (SELECT *, floor(expected)::BIGINT AS sure, expected - floor(expected) AS p FROM x),
z AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN odds * (1 - p) / (odds * (1 - p) + p) END AS place,
         target - sum(sure * size) OVER (PARTITION BY source) AS remaining
  FROM y
),
q AS (
  SELECT source, place, doc_id, size, remaining, sum(size) AS words
  FROM z WHERE place IS NOT NULL GROUP BY source, place, doc_id, size, remaining
),
r AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto FROM q
),
c AS (
  SELECT source, place, doc_id, size FROM r
  WHERE upto <= remaining OR (upto - words < remaining AND upto - remaining <= remaining - (upto - words))
)
SELECT z.doc_id, z.size::BIGINT AS size, z.source_size, z.target,
       (CASE WHEN z.size > 0 THEN z.sure + (c.place IS NOT NULL)::BIGINT ELSE 0 END * z.size)::BIGINT AS taken
FROM z LEFT JOIN c
  ON z.source IS NOT DISTINCT FROM c.source AND z.place = c.place AND z.doc_id IS NOT DISTINCT FROM c.doc_id AND z.size = c.size
"""

# A digest of each row, trees by language and one over them, level by level; proofs and folds step by step.
OP12 = r"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT row_number() OVER () AS row, *,
         sha256(concat(i, s, l, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), t)) AS leaf,
         sha256(concat(i, s, l, coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-'), t)) AS altered,
  FROM (
    SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS i,
           coalesce(strlen(source) || ':' || source, '-') AS s, coalesce(strlen(lang) || ':' || lang, '-') AS l,
           coalesce(strlen(text) || ':' || text, '-') AS t
    FROM documents
  )
),
placed AS MATERIALIZED (
  SELECT row, doc_id, n_chars, coalesce('=' || lang, '') AS tree, leaf, altered,
         -- CRC-32 of the decimal digits, bit by bit (-1: one shift).
         xor(list_reduce([4294967295] || flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')]),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS crc,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaf
),
low AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM low WHERE n > 1 GROUP BY tree, level + 1, place // 2, (n + 1) // 2
),
tops AS MATERIALIZED (
  SELECT tree, digest, level, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
),
high AS (
  SELECT 0 AS level, place, n, digest FROM tops
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM high WHERE n > 1 GROUP BY level + 1, place // 2, (n + 1) // 2
),
-- Each row's way up: its node on every level below the top of its own tree and then of the last one.
siblings AS MATERIALIZED (
  SELECT p.row, l.level, p.place >> l.level AS place, n.digest
  FROM placed p JOIN tops t USING (tree), LATERAL (SELECT unnest(range(t.level)) AS level) l
  LEFT JOIN low n ON n.tree = p.tree AND n.level = l.level AND n.place = xor(p.place >> l.level, 1)
  UNION ALL
  SELECT p.row, t.level + l.level, t.place >> l.level, n.digest
  FROM placed p JOIN tops t USING (tree), LATERAL (SELECT unnest(range((SELECT max(level) FROM high))) AS level) l
  LEFT JOIN high n ON n.level = l.level AND n.place = xor(t.place >> l.level, 1)
),
fold AS (
  SELECT row, 0 AS level, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN altered ELSE leaf END AS digest FROM placed
  UNION ALL
  SELECT f.row, f.level + 1, sha256(
    CASE WHEN s.digest IS NULL THEN f.digest WHEN s.place % 2 = 1 THEN s.digest || f.digest ELSE f.digest || s.digest END)
  FROM fold f JOIN siblings s ON s.row = f.row AND s.level = f.level
),
ends AS (SELECT row, max_by(digest, level) AS digest FROM fold GROUP BY row),
proofs AS (SELECT row, sha256(string_agg(digest, '' ORDER BY level)) AS digest FROM siblings WHERE digest IS NOT NULL GROUP BY row)
SELECT p.doc_id, p.leaf, t.digest AS subroot, r.digest AS root, coalesce(q.digest, sha256('')) AS proof_sha256,
       e.digest AS folded_root, e.digest = r.digest AS verified
FROM placed p JOIN tops t USING (tree) JOIN ends e USING (row) LEFT JOIN proofs q USING (row)
CROSS JOIN (SELECT digest FROM high WHERE n = 1) r
"""

OP11 = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
),
grams AS (
  SELECT lang, unnest(flatten([[words[i : i + n - 1] FOR i IN range(1, len(words) - n + 2)] FOR n IN [1, 2, 3, 4]])) AS gram FROM pieces
),
f AS MATERIALIZED (
  SELECT lang, gram, array_to_string(gram, ' ') AS phrase, len(gram) AS words, count(*) AS times FROM grams GROUP BY lang, gram HAVING count(*) >= 30
),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT c.lang, c.gram, c.phrase, c.times AS a, k, x.times AS l, y.times AS r,
         (2000000 * c.times::HUGEINT // (x.times::HUGEINT + y.times))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM f WHERE words > 1) c
  JOIN f x ON x.lang = c.lang AND x.gram = c.gram[1 : k]
  JOIN f y ON y.lang = c.lang AND y.gram = c.gram[k + 1 :]
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
contained AS (
  SELECT lang, gram, max(times) AS within FROM (
    SELECT lang, times, unnest(flatten([[gram[i : i + n - 1] FOR i IN range(1, words - n + 2)] FOR n IN range(2, words)])) AS gram
    FROM f WHERE words > 2
  ) GROUP BY lang, gram
),
ranked AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN contained USING (lang, gram)
  WHERE within IS NULL OR 100 * within::HUGEINT < 80 * a::HUGEINT
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _license_sql() -> str:
    """All alignments of all templates by joins, without probes."""
    postings = ", ".join(
        f"({t}, {place}, '{word}', {key_places(passage, key)[0] <= place <= key_places(passage, key)[1]})"
        for t, (_, passage, key) in enumerate(TEMPLATES) for place, word in enumerate(passage.split())
    )
    labels = ", ".join(f"({t}, '{label}', {len(key.split())})" for t, (label, _, key) in enumerate(TEMPLATES))
    base = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in BASE.items())
    return rf"""
WITH posting(template, place, word, is_key) AS (VALUES {postings}), named(template, label, key_words) AS (VALUES {labels}),
phrase(phrase, label, words) AS (VALUES {base}),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LICENSE_WORD}') AS words
  FROM documents
),
w AS MATERIALIZED (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS place FROM d),
hit AS MATERIALIZED (SELECT * FROM w WHERE word IN (SELECT word FROM posting)),
weight AS MATERIALIZED (
  SELECT p.word, round(1000 * ln(1 + ((SELECT count(*) FROM d) + 1) / (count(DISTINCT h.row) + 1)))::BIGINT AS weight
  FROM (SELECT DISTINCT word FROM posting) p LEFT JOIN hit h USING (word) GROUP BY p.word
),
total AS (SELECT template, sum(weight) AS total FROM posting JOIN weight USING (word) GROUP BY template),
match AS (
  SELECT h.row, p.template, h.place - p.place AS first, sum(x.weight) AS scored, count(*) FILTER (WHERE p.is_key) AS key_words
  FROM hit h JOIN posting p USING (word) JOIN weight x USING (word) GROUP BY h.row, p.template, h.place - p.place
),
found AS (
  SELECT row, label, scored / total AS score FROM match JOIN total USING (template) JOIN named USING (template)
  WHERE match.key_words = named.key_words AND 100 * scored >= {LEAST_SCORE} * total
),
place AS (
  SELECT d.row, b.label, unnest([i - 1 FOR i IN range(1, len(d.words) + 1) IF array_to_string(d.words[i : i + b.words - 1], ' ') = b.phrase]) AS place
  FROM d JOIN phrase b ON list_contains(d.words, string_split(b.phrase, ' ')[1])
),
b AS (
  SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM place GROUP BY row
),
l AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT row, label FROM place UNION ALL SELECT row, label FROM found) GROUP BY row
),
s AS (SELECT row, max(score) AS score FROM found GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (row) LEFT JOIN l USING (row) LEFT JOIN s USING (row)
"""


OP13 = _license_sql()
