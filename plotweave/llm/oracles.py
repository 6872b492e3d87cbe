"""DuckDB SQL for the contract queries that SQL can express."""

from plotweave.llm.licence_texts import KNOWN
from plotweave.llm.licences import COPYRIGHT_LINES, NOT_WORD, RIGHTS, SPELLINGS

OP1 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT e.v, r.label FROM r JOIN e ON r.node = e.u),
c AS (SELECT node, min(label) AS label FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.label AS component_id, c.label = d.doc_id AS kept FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP2 = """
WITH c AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY turn, role, text) AS turns,
         string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
  FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns, chat FROM c
WHERE NOT EXISTS (
  SELECT 1 FROM c AS d
  WHERE (d.n_turns > c.n_turns AND list_slice(d.turns, 1, c.n_turns) = c.turns) OR (d.turns = c.turns AND d.conv_id < c.conv_id))
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
b AS (
  SELECT doc_id, source, t, w, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         list_transform(ls, lambda x: lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')))) AS lines
  FROM d),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8),
wn AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM wn, range(0, 8) AS r(k) WHERE n > 1 GROUP BY doc_id),
occ AS (SELECT doc_id, source, unnest(lines) AS line FROM b),
own AS (SELECT DISTINCT doc_id, source, line FROM occ),
sh AS (
  SELECT doc_id, line, md5(unnest(CASE WHEN len(f) > 0 THEN f ELSE [line] END)) AS s
  FROM (SELECT doc_id, line, regexp_extract_all(line, '(?:^| )([bdhlpt][^ ]* [^ ]+ [^ ]+)', 1) AS f FROM own)),
least_two AS (SELECT doc_id, line, s FROM (SELECT DISTINCT doc_id, line, s FROM sh) QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY s) <= 2),
pool AS (SELECT doc_id, list({'s': s, 'line': line} ORDER BY s, line) AS p FROM least_two GROUP BY doc_id),
other AS (SELECT source, line, list_transform(list_filter(p, lambda e: e.line <> own.line)[1:2], lambda e: e.s) AS rest FROM own JOIN pool USING (doc_id)),
lim AS (SELECT source, line FROM other GROUP BY source, line HAVING count(DISTINCT rest) > 20),
gone AS (SELECT doc_id, sum(len(regexp_extract_all(occ.line, '[^\x20\x09-\x0D]+'))) AS n FROM occ JOIN lim ON occ.line = lim.line AND occ.source IS NOT DISTINCT FROM lim.source GROUP BY doc_id),
f AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_words - coalesce(gone.n, 0) AS n_left_words
  FROM b LEFT JOIN rep ON rep.doc_id = b.doc_id LEFT JOIN gone ON gone.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_left_words >= 30 * n_words AS kept, n_left_words
FROM f
"""


def _canonical(sql: str) -> str:
    """The normalisation of licences.canonical as nested DuckDB calls."""
    sql = f"regexp_replace(lower(coalesce({sql}, '')), '{COPYRIGHT_LINES}', '', 'g')"
    sql = f"trim(regexp_replace(regexp_replace({sql}, '{RIGHTS}', ' ', 'g'), '{NOT_WORD}', ' ', 'g'))"
    for pattern, to in SPELLINGS:
        sql = f"regexp_replace({sql}, '{pattern}', '{to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}', 'g')"
    return sql


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP7 = f"""
WITH k AS (SELECT min(licence) AS licence, digest FROM (
  SELECT licence, sha256({_canonical('body')}) AS digest FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in KNOWN.items())}) AS v(licence, body)) GROUP BY digest),
d AS (SELECT doc_id, {_canonical('text')} AS c FROM documents)
SELECT d.doc_id, sha256(d.c) AS digest, length(d.c) AS n_canonical_chars, k.licence FROM d LEFT JOIN k ON k.digest = sha256(d.c)
"""

OP9 = r"""
WITH b AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) || '|mix') AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM b GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((rnk - 1) % 3 + 1)::INT]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lev
  FROM w WINDOW o AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT arg_min(lev, (cap / weight, rnk)) AS lev FROM l WHERE cap > lev * weight),
t AS (SELECT source, source_size, rnk, CASE WHEN cap <= l.lev * weight THEN cap ELSE weight * (SELECT lev FROM free) END AS target FROM l),
c AS (
  SELECT doc_id, size, h, source_size, rnk, target, sum(size) OVER (PARTITION BY rnk ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
q AS (SELECT doc_id, h, rnk, e, size, (cum + e * source_size) / target AS f FROM c, range(0, 2) AS r(e) WHERE target > 0 AND size > 0),
r AS (SELECT doc_id, h, rnk, sum(size) OVER (ORDER BY f, rnk, h, e ROWS UNBOUNDED PRECEDING) AS upto FROM q),
k AS (SELECT doc_id, h, rnk, count(*) AS copies FROM r WHERE upto <= (SELECT 1.5 * sum(size) FROM b) GROUP BY ALL)
SELECT c.doc_id, size::BIGINT AS size, source_size, target, size::BIGINT * coalesce(copies, 0) AS taken, coalesce(copies, 0)::INT AS copies
FROM c LEFT JOIN k ON c.h = k.h AND c.rnk = k.rnk AND c.doc_id IS NOT DISTINCT FROM k.doc_id
"""

OP10 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT w.doc_id, p, coalesce(p - lag(p) OVER o > 50, true) AS fresh FROM w JOIN f USING (s) WHERE m < w.doc_id WINDOW o AS (PARTITION BY w.doc_id ORDER BY p)),
g AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM r),
x AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, k),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM x),
k AS (
  SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head
  FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLES = {"op1_hyperminhash": OP1, "op10_difference_cover": OP10, "op2_chat_snapshots": OP2, "op5_line_frequency": OP5, "op7_licence_digests": OP7, "op9_fair_mix": OP9}
