"""SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from .mixing import REPEATS, WEIGHTS
from .quality import CLASS_DISTANCE, COMMON_WORDS, LEAST_CHARS, LEAST_WORDS, WORD_DISTANCE

WORD = r"[^\x20\x09-\x0D]+"

MIX = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sno FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (sno - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS BIGINT) AS weight,
             source_size * {REPEATS} AS cap FROM s),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
              / CAST((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, sno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE)
                     ELSE (SELECT max(level) FROM l WHERE NOT cap <= level * weight) * weight END AS target FROM l),
q AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), cap) AS quota FROM t),
p AS (SELECT doc_id, size, source_size, target, quota,
             CAST(coalesce(sum(size) OVER (PARTITION BY sno ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - source_size))
            + greatest(0, least(size, quota - start - 2 * source_size)) AS BIGINT) AS taken
FROM p
"""

_BARE = r"regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')"
_CLASSES = (r"\p{Ll}", r"[#*$%&|<>]", r"\p{Lu}", r"\p{N}", r"[.,;:''\"()?!-]", r"[=_/\\+@~^{}\[\]]")
_COUNTS = ", ".join(f"len(regexp_extract_all(bare, '{c}'))" for c in _CLASSES)
_COMMON = ", ".join(f"len(list_filter(w, lambda x: x = '{c}'))" for c in COMMON_WORDS)


def _distance(name: str, column: str, least: str) -> str:
    """CTEs: share per bin, mean per language, and distance per document."""
    return f"""
{name}_bin AS (SELECT id, lang, {least} AS counts, unnest(range(1, len({column}) + 1)) AS k, unnest({column}) AS c, list_sum({column}) AS total FROM h),
{name}_share AS (SELECT id, lang, counts, k, CASE WHEN total > 0 THEN CAST(c AS DOUBLE) / total ELSE 0 END AS p FROM {name}_bin),
{name}_ref AS (SELECT lang, k, avg(p) AS r FROM {name}_share WHERE counts GROUP BY lang, k),
{name}_far AS (SELECT s.id, sqrt(greatest(0, sum(
    (CASE WHEN p > 0 THEN p * log2(p / ((p + r) / 2)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / ((p + r) / 2)) ELSE 0 END) / 2))) AS far
  FROM {name}_share s JOIN {name}_ref f ON s.lang IS NOT DISTINCT FROM f.lang AND s.k = f.k WHERE s.counts GROUP BY s.id)"""


QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents),
e AS (SELECT id, doc_id, lang, t, regexp_extract_all(t, '{WORD}') AS w, {_BARE} AS bare,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
h AS (SELECT *, len(w) AS n_words, length(bare) AS word_chars, list_append(cls, length(bare) - list_sum(cls)) AS class_bins,
             list_append(com, len(w) - list_sum(com)) AS word_bins
      FROM (SELECT *, [{_COUNTS}] AS cls, [{_COMMON}] AS com FROM e)),
g AS (SELECT id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM h WHERE len(w) >= 5)),
again AS (SELECT id, i FROM (SELECT *, count(*) OVER (PARTITION BY id, g) AS c FROM g) WHERE c > 1),
held AS (SELECT id, count(DISTINCT i + o) AS n FROM again, (SELECT unnest(range(0, 5)) AS o) GROUP BY id),
{_distance("cls", "class_bins", f"length(bare) >= {LEAST_CHARS}")},
{_distance("com", "word_bins", f"len(w) >= {LEAST_WORDS}")},
f AS (SELECT h.*, coalesce(held.n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(held.n, 0) > 20 * n_words AS base_failed
      FROM h LEFT JOIN held ON h.id = held.id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(cls[2] AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(a.far, 0) <= {CLASS_DISTANCE} AND coalesce(b.far, 0) <= {WORD_DISTANCE} AS kept
FROM f LEFT JOIN cls_far a ON f.id = a.id LEFT JOIN com_far b ON f.id = b.id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS k,
             first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN first END AS refers_to
FROM r
"""

SPELLING = r"""
WITH RECURSIVE polynomial AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS b FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]))) AS h FROM bytes, polynomial),
changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
holes AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM places),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.head || a.tail = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.head || a.tail = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN formed f ON c.next = f.word)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""
