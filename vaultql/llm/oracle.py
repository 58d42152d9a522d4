"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from .rules import BOILERPLATE, NAVIGATION, SENTENCE_END

_BLANK = r"[\x20\x09-\x0D]"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (_UP, _LOW)

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + 12], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
found AS (SELECT doc_id, item_id, n, k FROM places JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS k FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
classes AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM sets GROUP BY doc_id),
class_of AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM classes),
reps AS (SELECT sets.doc_id, s FROM sets JOIN class_of USING (doc_id) WHERE doc_id = class_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM reps a JOIN reps b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM class_of WHERE doc_id = class_id UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
low AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept, coalesce(class_id, d.doc_id) AS class_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN class_of USING (doc_id) LEFT JOIN low ON low.a = class_id
"""

REMOVE_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, k, md5(substr(x, 2 * k + 1, 100)) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS k FROM d)),
first_seen AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s),
gone AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM windows JOIN first_seen USING (s) WHERE doc_id > low),
runs AS (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM gone),
spans AS (SELECT doc_id, run, min(k) AS a, max(k) + 50 AS b FROM runs GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM spans),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

LINE_RULES = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS every,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
judged AS (
  SELECT *, list_filter(lines, lambda x: NOT (
    NOT regexp_matches(x, {_quoted(SENTENCE_END)})
    OR 100 * (length(x) - length(translate(x, '#*$%&|<>', ''))) > 30 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
    OR regexp_matches(translate(x, '{_UP}', '{_LOW}'), {_quoted(NAVIGATION)})
    OR regexp_matches(translate(x, '{_UP}', '{_LOW}'), {_quoted(BOILERPLATE)}))) AS ok FROM d),
windows AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 7], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
twice AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM twice) GROUP BY doc_id),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(ok) AS BIGINT) AS n_bad_lines,
    CAST(length(regexp_replace(array_to_string(ok, ''), '{_BLANK}', '', 'g')) AS BIGINT) AS kept_chars
  FROM judged LEFT JOIN repeated USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * kept_chars >= 50 * word_chars AS kept, n_lines, n_bad_lines, kept_chars
FROM counted
"""

REPEATED_WINDOWS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, k, md5(array_to_string(w[k : k + 34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d)),
twice AS (SELECT r, k FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM windows) WHERE c > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(k, k + 35)) AS p FROM twice)),
words AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: crc32 by bytes; its table comes from the polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda k: ascii(substr(s, k, 1)))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

PREFIX_TRIE = f"""
WITH RECURSIVE steps AS (SELECT n, n AS v, 0 AS k FROM (SELECT unnest(range(256)) AS n) UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE k = 8),
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, n, {_CRC} % 9 AS h FROM (SELECT c, CAST(c AS VARCHAR) AS s, count(*) AS n FROM own GROUP BY c), crc),
turns AS (
  SELECT convs.c, p AS d, r, x FROM convs JOIN own ON own.c = convs.c - convs.c % 5 AND p <= h
  UNION ALL SELECT own.c, p - a.h + least(a.h, coalesce(b.n, 0)), r, x FROM own JOIN convs a ON own.c = a.c AND p > a.h LEFT JOIN convs b ON b.c = a.c - a.c % 5),
lists AS (SELECT c, list(md5(r || chr(1) || x) ORDER BY d) AS l FROM turns GROUP BY c),
rows AS (
  SELECT c, d, array_to_string(l[1 : d], '') AS k, array_to_string(l[1 : d - 1], '') AS up, d = len(l) AS last FROM (SELECT c, l, unnest(range(1, len(l) + 1)) AS d FROM lists)
  UNION ALL SELECT c, 0, '', NULL, l IS NULL FROM convs LEFT JOIN lists USING (c)),
nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n, min(up) AS up, string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM rows GROUP BY k, d),
sized AS (SELECT nodes.*, octet_length(encode(coalesce(x, ''))) AS b FROM nodes LEFT JOIN turns ON turns.c = conv_id AND turns.d = nodes.d),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
sums AS (
  SELECT rows.k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((sized.n - 1) * b) AS saved
  FROM sized LEFT JOIN kids ON kids.k = sized.k JOIN rows ON rows.c = sized.conv_id AND rows.d <= sized.d GROUP BY rows.k)
SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, s.n AS n_convs, coalesce(kids.n, 0) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(s.ends, '')) AS ends_sha256
FROM sized s JOIN sums ON sums.k = s.k LEFT JOIN kids ON kids.k = s.k LEFT JOIN nodes p ON p.k = s.up
"""

ORACLE = {"op1_decontaminate": DECONTAMINATE, "op3_near_duplicates": NEAR_DUPLICATES, "op4_remove_repeats": REMOVE_REPEATS, "op6_line_rules": LINE_RULES, "op12_prefix_trie": PREFIX_TRIE, "op13_repeated_windows": REPEATED_WINDOWS}
