"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .license_scan import TEMPLATES
from .secrets_ledger import RULES

_METRIC_JOIN = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good,
           list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.good AND b.good
      WHERE CASE WHEN a.good AND b.good THEN list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95 ELSE false END),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


def _shard(shards: int) -> str:
    u = "(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '@' || CAST(s AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"
    return f"CAST(list_sort(list_transform(range(0, {shards}), lambda s: {{'score': 1.0::DOUBLE / -ln({u}), 'minus': -s}}), 'DESC')[1].minus * -1 AS INT)"


# crc32 runs over the bytes with the usual table, which is made from the polynomial
_SHARDING = f"""
WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS crc),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, list_transform(range(0, length(h) // 2), lambda i: CAST(('0x' || substr(h, i * 2 + 1, 2)) AS BIGINT)) AS bytes FROM d),
s AS (SELECT doc_id, CAST(len(bytes) + 8 AS BIGINT) AS size,
             xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32, {_shard(24)} AS shard, {_shard(25)} AS grown_shard FROM b, t)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard FROM s
"""


def _found(no: int) -> str:
    r = RULES[no]
    pattern = r.pattern.replace("'", "''")
    return f"""SELECT r, {no} AS kind_no, i, length(gaps[i]) AS gap, length(found[i]) AS len, length(held[i]) >= {r.least} AS ok FROM (
        SELECT r, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {r.group}) AS held FROM d WHERE regexp_matches(text, '{pattern}')), range(1, 1000000) n(i) WHERE i <= len(found)"""


_KINDS = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
_BASE = ", ".join(str(no) for no, r in enumerate(RULES) if r.base)
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), m AS ({' UNION ALL '.join(_found(no) for no in range(len(RULES)))}),
p AS (SELECT r, kind_no, len, ok, sum(gap + len) OVER (PARTITION BY r, kind_no ORDER BY i) AS stop FROM m),
s AS (SELECT r, kind_no, CAST(stop - len AS BIGINT) AS start, concat_ws(':', {_KINDS}[kind_no + 1], CAST(CAST(stop - len AS BIGINT) AS VARCHAR), CAST(CAST(stop AS BIGINT) AS VARCHAR)) AS span FROM p WHERE ok),
a AS (SELECT r, count(*) FILTER (WHERE kind_no = 0) AS n_assign, count(*) FILTER (WHERE kind_no = 1) AS n_access, count(*) FILTER (WHERE kind_no = 2) AS n_hex,
      string_agg(span, ',' ORDER BY start, kind_no) FILTER (WHERE kind_no IN ({_BASE})) AS base, string_agg(span, ',' ORDER BY start, kind_no) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""

_ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# rows are numbered; a document is a distinct pair of key and text, so repeated rows count once
_LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ' ', md5(text)) AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT r, doc, pos, line, translate(trim(line, {_ENDS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10),
n AS (SELECT r, count(*) AS n_lines, count(often.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN often USING (key) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN n USING (r)
"""



def _lloyd(parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 16) -> str:
    """Rounds over tables x (vec_id, p, v, q) of parts and b (p, e, c, q) of entries; all numbers are whole, so doubles hold them."""
    steps = [f"""
good AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
         WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM good),
x AS MATERIALIZED (SELECT r, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM d, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS c FROM x WHERE r <= {entries})"""]
    for i in range(rounds + 1):
        # the least of distance * entries + entry is the nearest entry, the first of equals
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT x.r, x.p, any_value(x.v) AS v, min(CAST(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.c) + list_inner_product(b.c, b.c) AS BIGINT) * {entries} + b.e) AS m FROM x JOIN b{i} b USING (p) GROUP BY x.r, x.p)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT p, m % {entries} AS e, generate_subscripts(v, 1) AS j, unnest(v) AS c FROM a{i}),
n{i} AS (SELECT p, e, list(f ORDER BY j) AS c FROM (SELECT p, e, j, floor(sum(c) / count(*)) AS f FROM m{i} GROUP BY p, e, j) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN n{i} n USING (p, e))""")
    return f"""WITH {','.join(steps)},
w AS (SELECT sha256(coalesce(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM d JOIN o USING (r), w"""


_GRAMS = ", ".join(f"({no}, {i}, '{' '.join(t.text.split()[i : i + 2])}')" for no, t in enumerate(TEMPLATES) for i in range(len(t.text.split()) - 1))
_KNOWN = ", ".join(f"({no}, '{t.label}', {t.share}, {str(t.base).lower()}, {len(t.text.split()) - 1})" for no, t in enumerate(TEMPLATES))
_LICENSES = rf"""
WITH t(tno, tpos, gram) AS (VALUES {_GRAMS}), k(tno, label, share, base, total) AS (VALUES {_KNOWN}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
u AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS pos FROM d),
g AS (SELECT r, pos, w || ' ' || lead(w) OVER (PARTITION BY r ORDER BY pos) AS gram FROM u),
h AS (SELECT r, tno, tpos, pos FROM g JOIN t USING (gram)),
n AS (SELECT r, tno, pos - tpos AS diagonal, count(*) AS votes, min(pos) AS first, max(pos) AS last, list(tpos) AS met FROM h GROUP BY r, tno, pos - tpos),
s AS (SELECT n.*, k.*, CASE WHEN share < 100 AND diagonal - lag(diagonal) OVER (PARTITION BY r, n.tno ORDER BY diagonal) <= 3 THEN 0 ELSE 1 END AS fresh
      FROM n JOIN k ON n.tno = k.tno WHERE votes >= CASE WHEN total > 8 THEN 2 ELSE 1 END),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY r, tno ORDER BY diagonal) AS span FROM s),
f AS (SELECT r, tno, label, base, first, len(list_distinct(flatten(met))) / total AS score FROM (
        SELECT r, tno, label, base, share, total, sum(votes) AS votes, min(first) AS first, max(last) AS last, list(met) AS met FROM m GROUP BY r, tno, label, base, share, total, span)
      WHERE len(list_distinct(flatten(met))) * 100 >= share * total AND votes * 2 >= last - first + 1),
a AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN a USING (r)
"""

ORACLES: dict[str, str] = {"op11_delta_lloyd": _lloyd(), "op12_diagonal_licenses": _LICENSES, "op1_metric_join": _METRIC_JOIN, "op5_secret_ledger": _SECRETS, "op7_line_dedup": _LINES, "op3_rendezvous_sharding": _SHARDING}
