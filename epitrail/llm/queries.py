"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from epitrail.llm import langid, linededup, mixing, neighbours, packing, periodic, quality, secrets, simhash, suffix, tokencount, trie, warc

QUERIES = {
    "op1_nearest_neighbours": neighbours.op1_nearest_neighbours,
    "op2_suffix_array_dedup": suffix.op2_suffix_array_dedup,
    "op3_fuzzy_line_dedup": linededup.op3_line_dedup,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_line_labelling": quality.op5_line_labelling,
    "op6_mixing_sources": mixing.op6_mixing_sources,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_separator_scan": tokencount.op8_separator_scan,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_language_id": langid.op10_language_id,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_warc_bundles": warc.op13_warc_bundles,
}
OP6_SQL = r"""
WITH m AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM m GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + n % 3]::DOUBLE AS weight FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM g)),
r AS (SELECT *, (source_size * 3)::DOUBLE AS most, (source_size * 3)::DOUBLE / weight AS r FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY r, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY r, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN r <= level THEN most ELSE weight * max(CASE WHEN r > level THEN level END) OVER () END AS target FROM l),
q AS (SELECT *, round(target)::BIGINT AS words FROM t),
d AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM m),
n AS (SELECT ceil(round(sum(target)) / 64)::BIGINT AS n_points, sum(target) AS total FROM t),
h AS (SELECT source, (words + 63) // 64 AS slots, target / total AS share, sum(target) OVER (ORDER BY source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) / total AS high,
    row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 AS last FROM q, n WHERE target > 0),
i AS (SELECT source, slots, coalesce(lag(high) OVER (ORDER BY source ASC NULLS LAST), 0.0) AS low, CASE WHEN last THEN 2.0 ELSE high END AS high FROM h),
x AS (SELECT id, (id + 0.5) * 0.6180339887498949::DOUBLE - floor((id + 0.5) * 0.6180339887498949::DOUBLE) AS x FROM (SELECT unnest(range(n_points)) AS id FROM n)),
y AS (SELECT source, slots, id AS place, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS rank FROM x JOIN i ON x >= low AND x < high),
k AS (SELECT i.source, i.slots, coalesce(c, 0) AS c FROM i LEFT JOIN (SELECT source, count(*) AS c FROM y GROUP BY source) AS o ON i.source IS NOT DISTINCT FROM o.source),
e AS (SELECT *, n_points + coalesce(sum(slots - c) OVER (ORDER BY source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
    FROM k, n WHERE c < slots),
s AS (SELECT source, rank, place FROM y WHERE rank < slots
    UNION ALL SELECT source, r AS rank, first + r - c AS place FROM (SELECT *, unnest(range(c, slots)) AS r FROM e)),
p AS (SELECT d.*, d.start + z.epoch * source_size AS lo, least(d.start + z.epoch * source_size + size, words) AS hi
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, (SELECT unnest(range(3)) AS epoch) AS z WHERE size > 0 AND d.start + z.epoch * source_size < words),
b AS (SELECT *, unnest(range((lo // 64)::BIGINT, ((hi - 1) // 64 + 1)::BIGINT)) AS slot FROM p),
a AS (SELECT b.source, b.start, b.doc_id, b.size, sum(least(hi, slot * 64 + 64) - greatest(lo, slot * 64)) AS taken, min(place) AS first_slot, count(*) AS n_slots
    FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source AND b.slot = s.rank GROUP BY ALL)
SELECT d.doc_id, d.size, q.source_size, q.target, coalesce(a.taken, 0)::BIGINT AS taken, a.first_slot::BIGINT AS first_slot, coalesce(a.n_slots, 0)::BIGINT AS n_slots
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
LEFT JOIN a ON a.source IS NOT DISTINCT FROM d.source AND a.start = d.start AND d.size > 0 AND a.size = d.size AND a.doc_id IS NOT DISTINCT FROM d.doc_id
"""

OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, (len(h) // 2)::BIGINT AS n_bytes FROM d),
w AS (SELECT doc_id, o, substr(h, 2 * o + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49)) AS o FROM n WHERE n_bytes >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, o, coalesce(o > lag(o) OVER (PARTITION BY doc_id ORDER BY o) + 50, TRUE) AS starts FROM w JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, o, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY o) AS span FROM r),
p AS (SELECT doc_id, span, min(o) AS a, max(o) + 50 AS b FROM g GROUP BY ALL),
k AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM p UNION ALL SELECT doc_id, 0, min(a) FROM p GROUP BY doc_id),
t AS (SELECT n.doc_id, string_agg(substr(h, 2 * k.a + 1, 2 * (coalesce(k.b, n_bytes) - k.a)), '' ORDER BY k.a) AS kept FROM n JOIN k USING (doc_id) GROUP BY n.doc_id),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id)
SELECT n.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN c ON c.doc_id = n.doc_id LEFT JOIN t ON t.doc_id = n.doc_id
"""

OP12_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda acc, c: xor(acc >> 8,
        list_reduce([xor(acc, c) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT), 4294967295) AS h FROM documents),
g AS (SELECT *, len(ws) AS n, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] END) ELSE ws END AS ws FROM a),
k AS (SELECT doc_id, n, i, md5(array_to_string(ws[i + 1:i + 16], ' ')) AS k FROM (SELECT *, unnest(range(n - 15)) AS i FROM w WHERE n >= 24)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
r AS (SELECT doc_id, q, min(i) AS start, max(i) + 16 + q - min(i) AS length FROM s GROUP BY doc_id, q, island HAVING max(i) + 16 + q - min(i) >= greatest(24, 3 * q)),
u AS (SELECT * FROM r WHERE NOT EXISTS (FROM r o WHERE o.doc_id = r.doc_id AND o.q < r.q AND r.q % o.q = 0 AND o.start <= r.start AND o.start + o.length >= r.start + r.length)),
d AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + q, start + length)) AS i FROM u) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_runs, arg_max({'s': start, 'n': length, 'q': q}, (length::DECIMAL(38,0) * 1000000000000 // q, -start, -q)) AS best,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM u GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, n AS n_words,
    sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(gone, i)), lambda i: ws[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM w LEFT JOIN t ON t.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id
"""

OP13_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT html, max(page_id) AS first, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> s) & 31)::INT, 1), '' ORDER BY i, s DESC) AS digest
    FROM (SELECT html, page_id, i, ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT AS v, unnest([15, 10, 5, 0]) AS s FROM (SELECT *, unnest(range(8)) AS i FROM p)) GROUP BY html, page_id),
b AS (SELECT html, max(first) AS first, any_value(digest) AS digest FROM g GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN b USING (html)
"""

OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n FROM conversations),
h AS (SELECT c, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda acc, x: xor(acc >> 8,
    list_reduce([xor(acc, x) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::BIGINT), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT c, count(*) AS b FROM t WHERE c % 20 = 0 GROUP BY c),
r AS (SELECT h.c, t.n + 1 AS depth, role, text FROM h JOIN t ON t.c = h.c - h.c % 20 WHERE t.n < h
    UNION ALL SELECT t.c, t.n - h + least(h, coalesce(b, 0)) + 1, role, text FROM t JOIN h ON h.c = t.c LEFT JOIN b ON b.c = t.c - t.c % 20 WHERE t.n >= h),
k AS (SELECT c, depth, len(regexp_extract_all(text, '[^ 	-
]+')) AS words,
    sha256(string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY depth)) AS key FROM r UNION ALL SELECT c, 0, 0, 'root' FROM h),
p AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY c) AS ends FROM k),
m AS (SELECT key, depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY key, depth),
d AS (SELECT parent AS key, count(*) AS n_children FROM m WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT a.key, sum((x.n_convs - 1) * x.words)::BIGINT AS saved_tokens, count(*) FILTER (NOT EXISTS (FROM d WHERE d.key = x.key)) AS n_leaves
    FROM m x JOIN k a ON a.c = x.conv_id AND a.depth <= x.depth GROUP BY a.key)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN s ON s.key = m.key LEFT JOIN d ON d.key = m.key LEFT JOIN m u ON u.key = m.parent
"""

ORACLE_SQL = {"op11_prefix_trie": OP11_SQL, "op13_warc_bundles": OP13_SQL, "op12_periodic_runs": OP12_SQL, "op2_suffix_array_dedup": OP2_SQL, "op6_mixing_sources": OP6_SQL}
