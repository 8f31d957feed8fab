"""DuckDB SQL of the operators that SQL can express."""

from .quality_rules import STOP_WORDS

_STOP = "['" + "','".join(sorted(set(STOP_WORDS.split()))) + "']"

OP10 = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(body, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines,
         [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] AS windows,
         len(list_filter(w, lambda x: list_contains({_STOP}, lower(x))))::BIGINT AS n_stop
  FROM t),
g AS (SELECT doc_id, unnest(windows) AS win, generate_subscripts(windows, 1) AS i FROM c),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
r AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM d) GROUP BY doc_id),
f AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, n_stop
  FROM c LEFT JOIN r ON r.doc_id = c.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND n_symbols <= 0.3::DOUBLE * n_words
        AND n_stop >= 0.02::DOUBLE * n_words AND n_dup_lines <= 0.5::DOUBLE * n_lines) AS kept
FROM b
"""

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
  FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS tok FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
      FROM e a JOIN e b ON a.tok = b.tok AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o WHERE 100 * k >= 80 * (n + m - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.y)::BIGINT AS component_id
FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.g
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS k, coalesce(text, '') AS body,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
p AS (
  SELECT *, md5('1|' || md5(coalesce(doc_id::VARCHAR, '-')) || md5(k) || body) AS print FROM w),
d AS (
  SELECT doc_id, source, k, size, md5(print || '|' || row_number() OVER (PARTITION BY print)::VARCHAR) AS tie FROM p),
s AS (SELECT source, k, sum(size)::BIGINT AS source_size FROM d GROUP BY 1, 2),
g AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, sum(source_size) OVER () * 1.5::DOUBLE AS wanted FROM s),
h AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM g),
i AS (
  SELECT *, row_number() OVER o AS nth,
         (wanted - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM h WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
t AS (
  SELECT k, source_size, round(least(weight * (SELECT arg_min(level, nth) FROM i WHERE level < ratio), 2.0::DOUBLE * source_size), 6) AS target FROM i),
t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM t),
t3 AS (SELECT *, CASE WHEN certain >= 2 THEN 0.0::DOUBLE ELSE target - certain * source_size END AS rest FROM t2),
z AS (SELECT k, size, count(*) AS docs FROM d WHERE size > 0 GROUP BY 1, 2),
c AS (
  SELECT z.k, size, rest,
         coalesce(sum(size * docs) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS above,
         (sum(size * docs) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS below,
         sum(docs * (size * sqrt(size::DOUBLE))) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS roots
  FROM z JOIN t3 ON z.k = t3.k WHERE rest > 0 WINDOW o AS (PARTITION BY z.k ORDER BY size DESC)),
b AS (
  SELECT k, size AS largest, (rest - above) / roots AS factor, floor(rest - above)::BIGINT AS room, (rest - above) / below AS mean
  FROM c WHERE (rest - above) / roots * sqrt(size::DOUBLE) < 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY size DESC) = 1),
f AS (SELECT t3.*, largest, factor, room, mean / (1 - mean) AS odds FROM t3 LEFT JOIN b ON b.k = t3.k),
u AS (
  SELECT d.*, f.* EXCLUDE (k), (('0x' || substr(tie, 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
         least(greatest(factor * sqrt(size::DOUBLE), 1e-12::DOUBLE), 1.0::DOUBLE - 1e-12::DOUBLE) AS chance
  FROM d JOIN f ON d.k = f.k),
v AS (SELECT *, (u / (1 - u)) / (chance / (1 - chance)) * odds AS rank FROM u WHERE size > 0 AND size <= largest AND room > 0),
x AS (
  SELECT doc_id, k, size, room, tie, least(rank / (1 + rank), 1.0::DOUBLE - 1e-12::DOUBLE) AS place FROM v),
y AS (
  SELECT *, sum(size) OVER (PARTITION BY k ORDER BY place, tie ROWS UNBOUNDED PRECEDING) AS upto, floor(place * 65536)::INT AS slice, length(bin(size)) AS class FROM x),
gap AS (
  SELECT k, (any_value(room) - coalesce(max(upto) FILTER (WHERE upto <= room), 0))::BIGINT AS gap, arg_min(tie, (place, tie)) FILTER (WHERE upto > room) AS next,
         arg_min(size, (place, tie)) FILTER (WHERE upto > room) AS next_size FROM y GROUP BY k),
near AS (
  SELECT y.k, upto > room AS added, slice, class, place, tie, size, CASE WHEN upto > room THEN gap ELSE next_size - gap END AS words
  FROM y JOIN gap ON y.k = gap.k WHERE size <= CASE WHEN upto > room THEN gap ELSE next_size - gap END),
one AS (
  SELECT *, CASE WHEN added THEN row_number() OVER (PARTITION BY k, added, class ORDER BY place, tie) ELSE row_number() OVER (PARTITION BY k, added, class ORDER BY place DESC, tie DESC) END AS nth
  FROM (SELECT * FROM near QUALIFY CASE WHEN added THEN row_number() OVER (PARTITION BY k, added, class, slice ORDER BY place, tie)
        ELSE row_number() OVER (PARTITION BY k, added, class, slice ORDER BY place DESC, tie DESC) END = 1)),
q AS (SELECT *, row_number() OVER (PARTITION BY k, added ORDER BY class DESC, nth) AS i FROM one WHERE nth <= 16),
a AS (
  SELECT DISTINCT k, added, 0::BIGINT AS i, words AS open, []::VARCHAR[] AS ties FROM q
  UNION ALL
  SELECT a.k, a.added, q.i, CASE WHEN q.size <= open THEN open - q.size ELSE open END, CASE WHEN q.size <= open THEN list_append(ties, q.tie) ELSE ties END
  FROM a JOIN q ON q.k = a.k AND q.added = a.added AND q.i = a.i + 1),
e AS (SELECT k, added, arg_max(open, i) AS open, arg_max(ties, i) AS ties FROM a GROUP BY 1, 2),
m AS (
  SELECT e.k, e.added, min((abs(open - q.size), q.tie)) AS best FROM e JOIN q ON q.k = e.k AND q.added = e.added AND NOT list_contains(ties, q.tie) GROUP BY 1, 2),
n AS (
  SELECT e.k, e.added, CASE WHEN best[1] < open THEN best[1] ELSE open END AS open, CASE WHEN best[1] < open THEN list_append(ties, best[2]) ELSE ties END AS ties
  FROM e LEFT JOIN m ON m.k = e.k AND m.added = e.added),
r AS (
  SELECT gap.k, next, coalesce(na.open, gap) AS below, coalesce(nd.open, next_size - gap) AS above, coalesce(na.ties, []::VARCHAR[]) AS more, coalesce(nd.ties, []::VARCHAR[]) AS less
  FROM gap LEFT JOIN n na ON na.k = gap.k AND na.added LEFT JOIN n nd ON nd.k = gap.k AND NOT nd.added),
j AS (
  SELECT y.tie FROM y JOIN r ON y.k = r.k
  WHERE CASE WHEN coalesce(above < below, false) THEN (upto <= room AND NOT list_contains(less, tie)) OR tie = next ELSE upto <= room OR list_contains(more, tie) END)
SELECT u.doc_id, u.size, u.source_size, u.target,
       (u.size * CASE WHEN u.size = 0 THEN 0 ELSE certain + CASE WHEN coalesce(u.size > largest, false) OR j.tie IS NOT NULL THEN 1 ELSE 0 END END)::BIGINT AS taken
FROM u LEFT JOIN j ON j.tie = u.tie
"""
