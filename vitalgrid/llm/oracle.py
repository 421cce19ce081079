"""SQL of the queries that SQL can express, for an engine that reads the same tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(0, 8)) AS p FROM twice) GROUP BY 1),
f AS (SELECT d.doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 30 * n_words AS failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS bad FROM m GROUP BY 1),
p AS (SELECT count(*) AS k, sum(n) AS n, sum(bad) / sum(n) AS mean, sum(n * (bad / n) * (bad / n)) / sum(n) AS sq FROM h),
q AS (SELECT mean, mean * (1 - mean) AS within, greatest(0, greatest(0, sq - mean * mean) - mean * (1 - mean) * k / n) AS between_ FROM p),
s AS (SELECT mean, least(greatest(CASE WHEN between_ > 0 AND within > between_ THEN within / between_ - 1 ELSE 100 END, 1), 1000) AS st FROM q)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND (h.bad + mean * st) / (h.n + st) < 0.5 AS kept
FROM m JOIN h ON m.source IS NOT DISTINCT FROM h.source, s"""

OP6 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) g ON g.x = d.doc_id"""

OP8 = rf"""WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, sum(size) AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY 1),
w AS (SELECT source, z, CAST(CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS wt, CAST(2 * z AS DOUBLE) AS cap, CAST(1.5 AS DOUBLE) * sum(z) OVER () AS total FROM s),
c AS (SELECT *, (total - (sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap)) * wt >= cap * sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM w),
t AS (SELECT source, CAST(z AS BIGINT) AS z, CASE WHEN capped THEN cap ELSE (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * wt / sum(wt) FILTER (NOT capped) OVER () END AS target FROM c),
r AS (SELECT d.*, z, target, CASE WHEN z > 0 THEN CAST(floor(target / z) AS BIGINT) ELSE 0 END AS copies, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z AS source_size, target, CAST(copies * size + greatest(0, least(size, CAST(round(target - copies * z) AS BIGINT) - before)) AS BIGINT) AS taken FROM r"""

OP10 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_matches(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE |\[/ROLE\]|\\[blij]') AS odd, length(regexp_replace(text, '[^\\<\[\]]', '', 'g')) AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(3 + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4 ELSE 14 + length(role) END + length(text) + CASE WHEN odd THEN marks ELSE 0 END) AS BIGINT) AS formatted_chars FROM e GROUP BY 1"""

OP11 = r"""WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS x FROM documents)),
u AS (SELECT d, w, count(*) AS n, hex(encode(d || ':' || w)) AS raw FROM r WHERE length(w) >= 7 GROUP BY 1, 2),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(raw), 2), lambda j: CAST(CAST('0x' || raw[j:j + 1] AS INTEGER) AS BIGINT))), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS h FROM u, t),
m AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
e AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
o AS (SELECT e.word AS a, v.word AS b FROM e JOIN v ON e.cut = v.word),
p AS (SELECT a, b FROM o UNION SELECT b, a FROM o UNION SELECT x.word, y.word FROM e x JOIN e y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word),
q AS (SELECT p.a AS word, count(*) AS n_near, max(v.n) AS most, min(struct_pack(less := -v.n, near := p.b)) AS best FROM p JOIN v ON v.word = p.b GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN best.near END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN q USING (word)),
g AS (SELECT word, word AS last, 0 AS step FROM f UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON f.word = g.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(last, step) AS root FROM g GROUP BY 1) k ON k.word = f.word"""

OP12 = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10"""

OP13 = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) r(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1),
u AS (SELECT lang, k, phrase, a, cut, array_to_string(s[1:cut], ' ') AS x, array_to_string(s[cut + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
z AS (SELECT u.lang, u.phrase, u.a, min(struct_pack(score := (CAST(2000000 AS HUGEINT) * u.a) // (CAST(l.f AS HUGEINT) + r.f), cut := cut, l := l.f, r := r.f)) AS b FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.x JOIN f r ON r.lang = u.lang AND r.phrase = u.y GROUP BY 1, 2, 3),
i AS (SELECT lang, array_to_string(s[i:j], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, k, a, s, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM c WHERE k > 2)) WHERE j - i + 1 < k GROUP BY 1, 2),
y AS (SELECT z.lang, z.phrase, z.a, b.l AS l, b.r AS r, b.score AS score, row_number() OVER (PARTITION BY z.lang ORDER BY b.score DESC, z.a DESC, z.phrase) AS rank FROM z LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * z.a)
SELECT y.lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM y JOIN t USING (lang) WHERE rank <= 2000"""

ORACLE = {"op4_quality": OP4, "op6_ngram_join": OP6, "op8_mixing": OP8, "op10_chat": OP10, "op11_spelling": OP11, "op12_maxscore": OP12, "op13_collocations": OP13}
