"""SQL that says in one statement what some of the registered queries compute."""

import re

from quotary.llm import fill_in_middle, filter_audit, license_scan, sharding

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_MARK_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEXT = "coalesce(text, '')"

SUBSTRING_DEDUP = f"""
WITH docs AS (SELECT doc_id, {_SPACE_WORDS.format(_TEXT)} AS ws FROM documents),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS run FROM docs, unnest(range(1, len(ws) - 11)) t(i)),
firsts AS (SELECT run, min(doc_id) AS least FROM runs GROUP BY run),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM runs JOIN firsts USING (run), range(13) r(k) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM docs),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS body FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_MARK_WORDS.format(_LOWER.format(_TEXT))} AS ws FROM documents),
items AS (SELECT row_number() OVER () AS rid, CAST(item_id AS VARCHAR) AS item, {_MARK_WORDS.format(_LOWER.format(_TEXT))} AS ws FROM benchmark),
phrases AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS run
  FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0),
runs AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS run
  FROM docs, (SELECT DISTINCT n FROM phrases), unnest(range(1, len(ws) - n + 2)) t(i)),
found AS (SELECT DISTINCT doc_id, n, i, item FROM runs JOIN phrases USING (n, run)),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, range(10) r(k) WHERE k < n GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id),
sized AS (SELECT rid, item, list_distinct(ws) AS terms, least(2 * len(ws), len(ws) + 15) AS span,
  greatest(ceil(0.7 * len(list_distinct(ws)) - 1e-9), least(len(list_distinct(ws)), 6)) AS needed FROM items WHERE item IS NOT NULL AND len(ws) > 0),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM docs),
places AS (SELECT doc_id, rid, w, pos FROM words JOIN (SELECT rid, unnest(terms) AS w FROM sized) USING (w)),
enough AS (SELECT doc_id, rid FROM places JOIN sized USING (rid) GROUP BY doc_id, rid, needed HAVING count(DISTINCT w) >= needed),
able AS (SELECT * FROM places SEMI JOIN enough USING (doc_id, rid)),
dense AS (SELECT a.doc_id, a.rid FROM able a JOIN sized s USING (rid) JOIN able b ON a.doc_id = b.doc_id AND a.rid = b.rid
  AND b.pos BETWEEN a.pos AND a.pos + s.span - 1 GROUP BY a.doc_id, a.rid, a.pos, s.needed HAVING count(DISTINCT b.w) >= s.needed),
near AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (
  SELECT DISTINCT d.doc_id, s.item FROM dense d JOIN sized s USING (rid)) x ANTI JOIN found f ON f.doc_id = x.doc_id AND f.item = x.item GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(named.names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near.n, 0) AS n_near_items, coalesce(near.names, '') AS near_items
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_SPACE_WORDS.format(_LOWER.format(_TEXT))} AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS run
  FROM docs, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _rows(pairs) -> str:
    return ", ".join(f"('{text}', '{label}')" for text, label in pairs)


def _words(text: str) -> str:
    """The words of a given text as a list literal."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_NOTICES = ", ".join(f"('{label}', {_words(n.text)}, [{', '.join(_words(k) for k in n.keys)}])" for label, own in license_scan.NOTICES.items() for n in own)

#: A paragraph ends where a stretch without words has two line ends. The phrases of a notice are looked for only in blocks that contain enough of it.
LICENSES = f"""
WITH docs AS (SELECT doc_id, {_LOWER.format(_TEXT)} AS body, {_MARK_WORDS.format(_LOWER.format(_TEXT))} AS ws FROM documents),
phrases AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {_rows(license_scan.PHRASES.items())}) v(phrase, label)),
words AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS pos FROM docs),
fours AS (SELECT doc_id, pos - 1 AS pos, a, lead(a, 1) OVER x AS b, lead(a, 2) OVER x AS c, lead(a, 3) OVER x AS d
  FROM words WINDOW x AS (PARTITION BY doc_id ORDER BY pos)),
places AS (SELECT doc_id, pos, label FROM fours JOIN phrases ON a = p[1] AND b = p[2] AND (len(p) < 3 OR c = p[3]) AND (len(p) < 4 OR d = p[4])),
notices AS (SELECT row_number() OVER () AS tid, label, list_distinct(t) AS t, len(t) AS reach, keys, ceil(0.8 * len(list_distinct(t)) - 1e-9) AS needed
  FROM (VALUES {_NOTICES}) v(label, t, keys)),
paras AS (SELECT doc_id, unnest(string_split_regex(body, '\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n')) AS para FROM docs),
blocks AS (SELECT row_number() OVER () AS bid, doc_id, {_MARK_WORDS.format('para')} AS b FROM paras),
tokens AS (SELECT DISTINCT bid, w FROM (SELECT bid, unnest(b) AS w FROM blocks) JOIN (SELECT DISTINCT unnest(t) AS w FROM notices) USING (w)),
contained AS (SELECT bid, tid FROM tokens JOIN (SELECT tid, needed, unnest(t) AS w FROM notices) USING (w) GROUP BY bid, tid, needed HAVING count(*) >= needed),
starts AS (SELECT bid, tid, b, t, reach, keys, p FROM contained JOIN blocks USING (bid) JOIN notices USING (tid), unnest(range(1, len(b) + 1)) x(p)
  WHERE b[p:p + len(keys[1]) - 1] = keys[1]),
around AS (SELECT *, b[greatest(p - reach, 1):p + len(keys[1]) + reach - 1] AS near FROM starts),
told AS (SELECT bid, tid, max(len(list_intersect(list_distinct(near), t))) AS n FROM around
  WHERE len(list_filter(keys[2:], lambda k: NOT contains(' ' || array_to_string(near, ' ') || ' ', ' ' || array_to_string(k, ' ') || ' '))) = 0 GROUP BY bid, tid),
judged AS (SELECT c.bid, b.doc_id, x.label, CASE WHEN t.n >= x.needed THEN t.n / CAST(len(x.t) AS DOUBLE) END AS share
  FROM contained c JOIN blocks b USING (bid) JOIN notices x USING (tid) LEFT JOIN told t USING (bid, tid)),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM places GROUP BY doc_id),
based AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id),
labelled AS (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM judged WHERE share IS NOT NULL),
every AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM labelled GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS score, count(DISTINCT bid) AS n_blocks FROM judged GROUP BY doc_id),
doubt AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS unconfirmed
  FROM (SELECT doc_id, label FROM judged WHERE share IS NULL EXCEPT SELECT doc_id, label FROM labelled) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score, coalesce(n_blocks, 0) AS n_blocks, coalesce(unconfirmed, '') AS unconfirmed
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN based USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN doubt USING (doc_id)
"""

ORACLE = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op3_sharding": sharding.ORACLE_SQL,
    "op6_decontamination": DECONTAMINATION,
    "op7_near_duplicates": NEAR_DUPLICATES,
    "op8_license_scan": LICENSES,
    "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
