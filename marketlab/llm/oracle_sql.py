"""DuckDB SQL of the operators whose results SQL can express: whole tables, whole texts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, word: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{word}')"


_BLANK, _ALNUM, _LETTER = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

#: Every 200-byte string is named by a 128-bit hash; bytes are handled as hex digits.
SUBSTRINGS = """
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, md5_number(substring(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(length(h) // 2 - 199)) AS i FROM b WHERE length(h) >= 400)),
rep AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
st AS (SELECT r, i FROM s SEMI JOIN rep USING (k)),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM st)),
sp AS (SELECT r, run, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY r, run),
ga AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM sp),
k AS (SELECT ga.r, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substring(any_value(h), 2 * max(z) + 1) AS rest FROM ga JOIN b ON b.r = ga.r GROUP BY ga.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM b LEFT JOIN k USING (r)
"""

#: Sets are compared in full; equal sets are folded before they meet.
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", _BLANK)} AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
d AS (SELECT r, doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS g, s FROM s),
f AS (SELECT g, min(doc_id) AS low, any_value(n) AS n, any_value(s) AS s FROM d WHERE n > 0 GROUP BY g),
x AS (SELECT g, n, md5_number(unnest(s)) AS h FROM f),
e AS (SELECT a, b FROM (SELECT p.g AS a, q.g AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS i FROM x p JOIN x q ON p.h = q.h AND p.g <> q.g AND 100 * p.n >= 75 * q.n AND 100 * q.n >= 75 * p.n GROUP BY 1, 2) WHERE 100 * i >= 75 * (na + nb - i)),
t(a, b) AS (SELECT g, g FROM f UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
c AS (SELECT t.a AS g, min(f.low) AS low FROM t JOIN f ON t.b = f.g GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id, doc_id = coalesce(low, doc_id) AS kept FROM d LEFT JOIN c ON c.g = d.g AND d.n > 0
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words("text", _ALNUM)} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
o AS (SELECT r, i, q.k, item_id FROM p JOIN q ON p.k = q.k AND p.s = q.s),
h AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM o) GROUP BY r),
m AS (SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM o) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)
"""

#: All sources of a language against all its kept terms; arithmetic in 128-bit whole numbers.
DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_words("text", _LETTER)} AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS c FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(c)::HUGEINT AS lc FROM t GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT lang, source, term, sum(c)::HUGEINT AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lc)::HUGEINT AS ln FROM k GROUP BY ALL),
n AS (SELECT g.lang, g.source, v.v, v.ln, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (n.n + n.v) AS p, 1 + 1000000000::HUGEINT * (k.lc + 1) // (n.ln + n.v) AS q
      FROM n JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""

ORACLES = {"op2_substring_dedup": SUBSTRINGS, "op3_near_dedup": NEAR_DUPLICATES, "op5_decontamination": DECONTAMINATION, "op12_source_divergence": DIVERGENCE}
