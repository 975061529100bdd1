"""SQL (DuckDB) that says the same as operators 11 to 13: near words by what a deletion leaves, runs and links by all pairs that share a word or a shingle."""

from __future__ import annotations

#: SQL (DuckDB) for the crc32 of a string of at most two bytes a character.
CRC = """t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc32_of(text: str) -> str:
    bytes_ = f"list_transform(range(0, len(hex(encode({text}))), 2), lambda k: CAST('0x' || substr(hex(encode({text})), k + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP12 = f"""WITH {CRC}, d AS (SELECT doc_id, {WORDS} AS w, {crc32_of("CAST(doc_id AS STRING)")} AS h FROM documents, t),
  s AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM d), p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM s), q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p),
  x AS (SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM q)),
  e AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM x l JOIN x r ON r.doc_id = l.doc_id AND r.word = l.word AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
  f AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
  r AS (SELECT doc_id, start, length, min(q) AS period FROM f GROUP BY ALL),
  b AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-(length / period), start, period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY 1),
  k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY 1)
  SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
  FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11 = f"""WITH RECURSIVE {CRC}, d AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UP}', '{LOW}') AS run FROM documents),
  o AS (SELECT doc_id, run, count(*) AS n, doc_id || ':' || run AS named FROM d WHERE length(run) >= 7 GROUP BY ALL), h AS (SELECT run, n, {crc32_of("named")} AS h FROM o, t),
  w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n) AS n FROM h GROUP BY 1),
  v AS (SELECT word, CAST(n AS BIGINT) AS n FROM w WHERE length(word) >= 7 AND n >= 2),
  c AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM v)),
  p AS (SELECT x.word AS a, y.word AS b FROM c x JOIN c y ON x.k = y.k AND x.rest = y.rest AND x.word <> y.word UNION SELECT c.word, v.word FROM c JOIN v ON v.word = c.rest UNION SELECT v.word, c.word FROM c JOIN v ON v.word = c.rest),
  m AS (SELECT p.a AS word, count(*) AS n_near, arg_min(p.b, (-v.n, p.b)) AS best, max(v.n) AS best_n FROM p JOIN v ON v.word = p.b GROUP BY 1),
  f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN m USING (word)),
  r(word, root) AS (SELECT word, coalesce(form, word) FROM f UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
  SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f AS g ON g.word = r.root WHERE g.form IS NULL"""
OP13 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{UP}', '{LOW}')")} AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS g FROM d),
  z AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s), b AS (SELECT x.doc_id AS a, y.doc_id AS b FROM z x JOIN z y ON x.gram = y.gram AND x.doc_id <> y.doc_id AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 190 * count(*) >= 90 * (x.n + y.n)),
  r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, b.b FROM r JOIN b ON b.a = r.b)
  SELECT s.doc_id, len(s.g) AS n_shingles, least(s.doc_id, min(r.b)) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.g"""
