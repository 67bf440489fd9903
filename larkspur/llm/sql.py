"""What SQL for DuckDB can say of the queries of this package: whole tables, by definition rather than by method."""

from __future__ import annotations

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOW_WORDS = WORDS.format(LOWER.format("coalesce(text, '')"))
#: crc32 of a text of ASCII characters, byte by byte over its table t.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t"
CRC_OF = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform({0}, lambda x: {1}::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c // 256)))"
CRC_OF_ASCII = CRC_OF.format("string_split({0}, '')", "ascii(x)")
CRC = CRC_OF_ASCII.format("doc_id::VARCHAR")

#: Interpolated bigrams, by the recursion that the automaton's arcs and failure arcs amount to.
OP1 = f"""WITH crc AS ({CRC_TABLE}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({CRC} % 7 = 2, false) AS held_out, list_append(list_transform({LOW_WORDS}, lambda w: 'w' || w), 'END') AS words FROM documents, crc),
u AS (SELECT rid, held_out, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
k AS (SELECT *, lag(w, 1, 'END') OVER (PARTITION BY rid ORDER BY i) AS p FROM u),
c1 AS (SELECT w, count(*) AS n FROM k WHERE NOT held_out GROUP BY ALL), c2 AS (SELECT p, w, count(*) AS n FROM k WHERE NOT held_out GROUP BY ALL),
s AS (SELECT coalesce(sum(n), 0)::BIGINT AS n, count(*) AS v FROM c1),
j AS (SELECT k.rid, c1.n IS NOT NULL AS known, (coalesce(c1.n, 0) + 1)::DOUBLE / (s.n + s.v + 1) AS p1, h1.n AS h1, c2.n AS n2 FROM k CROSS JOIN s
  LEFT JOIN c1 ON c1.w = k.w LEFT JOIN c1 h1 ON h1.w = k.p LEFT JOIN c2 ON c2.p = k.p AND c2.w = k.w),
p2 AS (SELECT *, CASE WHEN h1 IS NULL THEN p1 ELSE (coalesce(n2, 0) + 8 * p1) / (h1 + 8) END AS p2 FROM j),
g AS (SELECT rid, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, round(sum(log10(p1)), 6) AS base_score, round(sum(log10(p2)), 6) AS score FROM p2 GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, s.n AS train_tokens, base_score, score FROM d JOIN g USING (rid) CROSS JOIN s"""

#: Windows of 200 bytes as hexadecimal digits.
OP3 = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT rid, h, unnest(range(n - 199)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY s) AS times FROM w) WHERE times > 1),
e AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
b AS (SELECT rid, min(i) AS a, max(i) + 200 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM e) GROUP BY rid, run),
v AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM b),
k AS (SELECT rid, sum(z - a)::BIGINT AS gone, count(*) AS spans, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM v JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""

#: BM25 (k1 1.2, b 0.75) of every document that shares a word with the query.
OP7 = f"""WITH d AS (SELECT doc_id, {LOW_WORDS} AS words FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS mean FROM d),
t AS (SELECT doc_id, w, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(words) AS w, len(words) AS len FROM d) GROUP BY doc_id, w),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
x AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(q.tf * ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.len / s.mean))), 6) AS score
  FROM t q JOIN f USING (w) JOIN t USING (w) CROSS JOIN s WHERE q.doc_id % 50 = 0 GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""

OP8 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(words[i:i + 12], ' ') AS s FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
h AS (SELECT rid, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id OR doc_id IS NULL AND first IS NOT NULL),
g AS (SELECT DISTINCT rid, i + unnest(range(13)) AS i FROM h),
u AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
k AS (SELECT u.rid, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY u.i) FILTER (g.i IS NULL) AS kept FROM u LEFT JOIN g ON g.rid = u.rid AND g.i = u.i GROUP BY u.rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""

PLAIN_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(LOWER.format("coalesce(text, '')"))
#: Windows as words joined by spaces, each item's own distinct ones.
OP11 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {PLAIN_WORDS} AS words FROM documents), b AS (SELECT item_id, {PLAIN_WORDS} AS words FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, unnest(list_transform(range(1, greatest(len(words) - 9, 1) + 1), lambda k: array_to_string(words[k:k + 9], ' '))) AS s FROM b WHERE len(words) > 0),
z AS (SELECT DISTINCT n FROM i),
w AS (SELECT rid, n, unnest(range(1, len(words) - n + 2)) AS k, words FROM d, z WHERE len(words) >= n),
m AS (SELECT rid, w.n, k, item_id FROM (SELECT rid, n, k, array_to_string(words[k:k + n - 1], ' ') AS s FROM w) w JOIN i USING (n, s)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM m) GROUP BY rid),
g AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN g USING (rid)"""

BYTES = "list_transform(range(octet_length({0})), lambda k: ('0x' || substr(hex({0}), 2 * k + 1, 2))::INT)"
#: Near words by what is left of them without each of their letters.
OP12 = f"""WITH RECURSIVE crc AS ({CRC_TABLE}),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
r AS (SELECT id, run, count(*) AS n, encode(id || ':' || run) AS b FROM d WHERE length(run) >= 6 GROUP BY ALL),
x AS (SELECT run, n, {CRC_OF.format(BYTES.format("b"), "x")} AS h FROM r, crc),
a AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM x),
v AS (SELECT word, sum(n)::BIGINT AS n FROM a WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
l AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
p AS (SELECT DISTINCT * FROM (SELECT p.word, q.word AS near, q.n AS m FROM l p JOIN l q ON p.rest = q.rest AND p.k = q.k AND p.word <> q.word
  UNION ALL SELECT l.word, v.word, v.n FROM l JOIN v ON l.rest = v.word UNION ALL SELECT v.word, l.word, l.n FROM l JOIN v ON l.rest = v.word)),
o AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN o.m >= 5 * v.n THEN o.m END AS form_n FROM v LEFT JOIN o USING (word)),
e AS (SELECT f.*, (SELECT min(near) FROM p WHERE p.word = f.word AND p.m = f.form_n) AS form FROM f),
c AS (SELECT word, word AS root, 0 AS step FROM e UNION ALL SELECT c.word, e.form, step + 1 FROM c JOIN e ON e.word = c.root WHERE e.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM e JOIN (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word) USING (word)"""

#: A snapshot of each user's events after each of the user's batches.
OP13 = f"""WITH crc AS ({CRC_TABLE}),
t AS (SELECT row_number() OVER () AS rid, conv_id, turn, {CRC_OF_ASCII.format("conv_id::VARCHAR")} AS c, {CRC_OF_ASCII.format("(conv_id::VARCHAR || ':' || turn::VARCHAR)")} AS h FROM conversations, crc WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
u AS (SELECT rid, h, h // 600 AS g, 2 * floor(conv_id / 8)::BIGINT + c % 2 AS user, (c // 2) % 7200 + 300 * turn + h % 600 AS s FROM t),
e AS (SELECT rid, h, user, s, floor(s / 1800)::BIGINT + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS batch FROM u),
b AS (SELECT DISTINCT user, batch FROM e),
w AS (SELECT e.rid, e.h, user, s, e.batch AS came, b.batch, s - lag(s) OVER (PARTITION BY user, b.batch ORDER BY s, e.rid) AS gap FROM e JOIN b USING (user) WHERE e.batch <= b.batch),
i AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > 240) OVER (PARTITION BY user, batch ORDER BY s, rid) AS id FROM w),
v AS (SELECT user, batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (came = batch) AS n_new, sum(h)::BIGINT AS h_sum FROM i GROUP BY user, batch, id HAVING n_new > 0),
x AS (SELECT p.user, p.batch, p.start_s, min(q.batch) AS by_batch FROM v p JOIN v q ON p.user = q.user AND q.batch > p.batch AND q.start_s <= p.start_s AND q.end_s >= p.end_s GROUP BY ALL),
y AS (SELECT x.*, v.start_s AS by_start FROM x JOIN v ON v.user = x.user AND v.batch = x.by_batch AND v.start_s <= x.start_s AND v.end_s >= x.start_s),
n AS (SELECT user, by_batch AS batch, by_start AS start_s, count(*) AS n_retracted FROM y GROUP BY ALL)
SELECT v.user, v.batch, v.start_s, v.end_s, n_events, n_new, coalesce(n_retracted, 0) AS n_retracted, h_sum, by_batch AS retracted_batch, by_start AS retracted_start_s
FROM v LEFT JOIN n ON n.user = v.user AND n.batch = v.batch AND n.start_s = v.start_s LEFT JOIN y ON y.user = v.user AND y.batch = v.batch AND y.start_s = v.start_s"""
