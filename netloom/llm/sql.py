"""DuckDB SQL of the operators whose results SQL can express, written from their contracts.

The rest has none: op3 needs Unicode compatibility forms and xxhash, op4 stored files, op5 and op10 trained models, op6 look-around
patterns, op8 byte-pair merges. op9's crc32 is folded over the bytes of each text.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = f"""WITH d AS (SELECT row_number() OVER () r, doc_id, {WORDS.format("coalesce(text, '')")} w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 33)) s FROM d WHERE len(w) >= 35),
v AS (SELECT g.r, g.s, md5(array_to_string(list_slice(d.w, g.s, g.s + 34), ' ')) m FROM g JOIN d USING (r)),
c AS (SELECT r, s FROM v WHERE m IN (SELECT m FROM v GROUP BY m HAVING count(*) > 1)),
x AS (SELECT DISTINCT r, s + o p FROM c, (SELECT unnest(range(0, 35)) o)),
k AS (SELECT r, unnest(w) t, unnest(range(1, len(w) + 1)) p FROM d),
l AS (SELECT k.r, string_agg(k.t, ' ' ORDER BY k.p) kept, count(*) n FROM k ANTI JOIN x ON k.r = x.r AND k.p = x.p GROUP BY k.r)
SELECT d.doc_id, len(d.w)::BIGINT n_words, (len(d.w) - coalesce(l.n, 0))::BIGINT n_removed, sha256(coalesce(l.kept, '')) kept_sha256 FROM d LEFT JOIN l USING (r)"""


def op2(passes: int, seed: str = "mix") -> str:
    """Targets by repeated capping, then the passes over each source's Pareto order, then the last document."""
    u = f"(('0x' || substr(md5(concat_ws('|', '{seed}', doc_id, size)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    order = "rank, doc_id NULLS FIRST, size"
    steps, now = [], "e0"
    for k in range(passes):
        steps.append(f"""g{k} AS (SELECT sk, any_value(target) - any_value(base) * any_value(source_size) - sum(extra * size) gap FROM {now} GROUP BY sk),
e{k + 1} AS (SELECT * EXCLUDE (gap, fits) REPLACE (CASE WHEN fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY sk ORDER BY {order} ROWS UNBOUNDED PRECEDING) <= gap THEN 1 ELSE extra END AS extra) FROM (
SELECT e.*, g.gap, e.extra = 0 AND e.rank IS NOT NULL AND g.gap > 0 AND e.size <= g.gap fits FROM {now} e JOIN g{k} g USING (sk)))""")
        now = f"e{k + 1}"
    return f"""WITH RECURSIVE s AS (SELECT row_number() OVER () r, doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT size FROM documents),
p AS (SELECT source, sum(size)::BIGINT z, row_number() OVER (ORDER BY source NULLS LAST) sk FROM s GROUP BY source),
q AS (SELECT list(z ORDER BY sk) z, list(((sk - 1) % 3 + 1) ORDER BY sk) w, sum(z)::DOUBLE total FROM p),
f AS (SELECT 0 n, list_transform(z, lambda x: false) c FROM q UNION ALL
SELECT n + 1, list_transform(range(1, len(z) + 1), lambda i: c[i] OR (total - 3 * list_sum(list_transform(range(1, len(z) + 1), lambda j: CASE WHEN c[j] THEN z[j] ELSE 0 END))) * w[i]
/ list_sum(list_transform(range(1, len(z) + 1), lambda j: CASE WHEN c[j] THEN 0 ELSE w[j] END)) > 3.0::DOUBLE * z[i]) FROM f, q WHERE n < len(z) AND NOT list_bool_and(c)),
a AS (SELECT c FROM f ORDER BY n DESC LIMIT 1),
t AS (SELECT p.sk, p.source, p.z source_size, CASE WHEN c[sk] THEN 3.0::DOUBLE * p.z ELSE (total - 3 * list_sum(list_transform(range(1, len(q.z) + 1), lambda j: CASE WHEN c[j] THEN q.z[j] ELSE 0 END))) * q.w[sk]
/ list_sum(list_transform(range(1, len(q.z) + 1), lambda j: CASE WHEN c[j] THEN 0 ELSE q.w[j] END)) END::DOUBLE target FROM p, q, a),
b AS (SELECT s.r, s.doc_id, s.size, t.sk, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END rate FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
i AS (SELECT *, floor(rate + 1e-12::DOUBLE)::INT base, least(1::DOUBLE - 1e-9::DOUBLE, greatest(0::DOUBLE, rate - floor(rate + 1e-12::DOUBLE))) f, {u} u FROM b),
e0 AS (SELECT r, doc_id, size, sk, source_size, target, base, CASE WHEN f > 0 THEN u * (1 - f) / ((1 - u) * f) END rank, 0 extra FROM i),
{", ".join(steps)},
h AS (SELECT sk, any_value(target) - any_value(base) * any_value(source_size) - sum(extra * size) gap FROM {now} GROUP BY sk),
m AS (SELECT r FROM (SELECT r, row_number() OVER (PARTITION BY sk ORDER BY abs(size - gap), {order}) n FROM {now} JOIN h USING (sk) WHERE gap > 0 AND extra = 0 AND rank IS NOT NULL AND abs(size - gap) < gap) WHERE n = 1)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT taken, copies FROM (SELECT *, (base + CASE WHEN r IN (SELECT r FROM m) THEN 1 ELSE extra END)::INT copies FROM {now})"""


OP7 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () r, doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w FROM documents),
s AS (SELECT DISTINCT r, md5(array_to_string(list_slice(w, x, x + 2), ' ')) || least(len(w), 3) h FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) x FROM d WHERE len(w) > 0)),
n AS (SELECT d.r, d.doc_id, count(s.h) n FROM d LEFT JOIN s USING (r) GROUP BY ALL),
p AS (SELECT a.r ra, b.r rb, count(*) m FROM s a JOIN s b ON a.h = b.h AND a.r < b.r GROUP BY ALL),
l AS (SELECT ra, rb FROM p JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 100 * p.m >= 90 * (x.n + y.n - p.m)),
e AS (SELECT ra a, rb b FROM l UNION SELECT rb, ra FROM l),
c AS (SELECT r o, r FROM n UNION SELECT c.o, e.b FROM c JOIN e ON e.a = c.r)
SELECT n.doc_id, n.n::BIGINT n_shingles, m.component_id FROM n JOIN (SELECT c.o, min(n.doc_id) component_id FROM c JOIN n ON n.r = c.r GROUP BY c.o) m ON m.o = n.r"""

CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda v, s: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b) ORDER BY b) FROM range(256) t(b))"
OP9 = f"""WITH c AS MATERIALIZED (SELECT {CRC_TABLE} t),
d AS (SELECT doc_id, encode(coalesce(text, '')) z FROM documents),
y AS (SELECT doc_id, z, octet_length(z) + 1 size, list_transform(regexp_extract_all(hex(z), '..'), lambda x: ('0x' || x)::BIGINT) v FROM d),
k AS (SELECT doc_id, size::BIGINT size, xor(list_reduce(v, lambda a, x: xor(a >> 8, c.t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) text_crc32,
('0x' || substr(md5(z), 1, 15))::BIGINT h, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT g FROM y, c),
o AS (SELECT *, sum(size) OVER (ORDER BY h, g, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size before, sum(size) OVER (PARTITION BY h) own, sum(size) OVER () total FROM k),
m AS (SELECT *, least(7, floor((CASE WHEN own <= 0.02::DOUBLE * total / 8 THEN min(before) OVER (PARTITION BY h) + own / 2 ELSE before + size / 2 END) * 8 / total::DOUBLE))::INT shard FROM o)
SELECT doc_id, size, text_crc32::BIGINT text_crc32, 'bytes' law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, g, doc_id NULLS FIRST, size) - 1 slot, NULL::INT grown_shard FROM m"""
