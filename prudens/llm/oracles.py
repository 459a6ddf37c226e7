"""DuckDB SQL for the operators that SQL can express; each reads the whole tables."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
#: Lower-cases A-Z only.
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

op4_suffix_dedup = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, i, md5_number(substring(x, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d)),
r AS (SELECT doc_id, i FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING count(*) > 1)),
m AS (SELECT doc_id, i, CASE WHEN i <= 200 + lag(i) OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m) GROUP BY doc_id, run),
c AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e FROM s GROUP BY doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       CASE WHEN c.doc_id IS NULL THEN sha256(unhex(x)) ELSE sha256(unhex(list_aggregate(list_transform(range(0, len(a) + 1),
           lambda k: substring(x, CASE WHEN k = 0 THEN 1 ELSE 2 * e[k] + 1 END, CASE WHEN k = len(a) THEN length(x) ELSE 2 * a[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE 2 * e[k] END)), 'string_agg', ''))) END AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)"""

_SHINGLES = f"""
SELECT {{id}}, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s, len(w) AS n_words
FROM (SELECT {{id}}, {_WORDS.format(_LOWER.format('text'))} AS w FROM {{table}})"""

op6_decontaminate = f"""
WITH d AS ({_SHINGLES.format(id='doc_id', table='documents')}),
b AS ({_SHINGLES.format(id='item_id', table='benchmark')}),
x AS (SELECT doc_id, unnest(s) AS g FROM d), y AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM b WHERE n_words >= 5)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_common, count(*)::DOUBLE / n AS containment
FROM x JOIN y USING (g) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n"""

op7_near_dup = f"""
WITH RECURSIVE d AS MATERIALIZED ({_SHINGLES.format(id='doc_id', table='documents')}),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
                       GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, len(s)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)"""

op8_substring_dedup = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
f AS (SELECT g, min(struct_pack(d := doc_id, i := i)) AS first FROM p GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM p JOIN f USING (g) WHERE first <> struct_pack(d := doc_id, i := i)),
k AS (SELECT doc_id, list(i) AS cut FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN cut IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(cut, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

op9_warc = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substring(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)"""

op11_exact_dedup = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

#: CRC-32 by its table, which a CTE builds from the polynomial; for strings of ASCII characters.
_CRC_TABLE = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"
_TURN_KEY = "md5(length({r})::VARCHAR || ':' || {r} || {x})"

op12_prefix_trie = f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, {_TURN_KEY.format(r='r', x='x')}) AS s FROM t GROUP BY c),
h AS (SELECT c, s, ({_CRC.format('c::VARCHAR')} % 6)::BIGINT AS h FROM own, crc),
b AS (SELECT h.c, list_concat(CASE WHEN o.c IS NULL OR h = 0 THEN [] ELSE o.s[1:h] END, h.s[h + 1:]) AS s FROM h LEFT JOIN own o ON o.c = h.c - h.c % 100),
p AS (SELECT c, len(s) AS n, d, s[1:d]::VARCHAR AS k, CASE WHEN d > 0 THEN s[1:d - 1]::VARCHAR END AS up, CASE WHEN d > 0 THEN length(s[d].x) ELSE 0 END AS size FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b)),
m AS (SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM m WHERE d > 0 GROUP BY ALL),
below AS (SELECT DISTINCT a.d, a.k, z.d AS bd, z.k AS bk FROM p a JOIN p z ON a.c = z.c AND z.d >= a.d),
sums AS (SELECT w.d, w.k, count(*) FILTER (kids.d IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.size)::BIGINT AS saved_tokens
         FROM below w JOIN m ON m.d = w.bd AND m.k = w.bk LEFT JOIN kids ON kids.d = w.bd AND kids.k = w.bk GROUP BY w.d, w.k)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN sums ON sums.d = m.d AND sums.k = m.k LEFT JOIN kids ON kids.d = m.d AND kids.k = m.k LEFT JOIN m q ON q.d = m.d - 1 AND q.k = m.up"""

_NEXT = {1: 3, 2: 3, 3: 4, 4: 3}  # states 1 to 4: nothing yet, after system, after user, after assistant
_TYPE = {3: "user", 4: "assistant"}
_DEAR = "struct_pack(c := 1000000::BIGINT, a := '', o := '')"


def _way(test: str, letter: str, cost: str, to: int, line: str) -> str:
    return f"CASE WHEN {test} THEN struct_pack(c := v[{to}].c + {cost}, a := '{letter}' || v[{to}].a, o := {line} || v[{to}].o) ELSE {_DEAR} END"


def _turn_ways(q: int) -> str:
    keep = {1: "WHEN 's' THEN 2 WHEN 'u' THEN 3", 2: "WHEN 'u' THEN 3", 3: "WHEN 'a' THEN 4", 4: "WHEN 'u' THEN 3"}[q]
    kept = [_way(f"fit AND e = '{part.split(chr(39))[1]}'", "K", "more", int(part[-1]), "chr(10) || role || ':' || text") for part in keep.replace(" WHEN", ";WHEN").split(";")]
    return "list_min([" + ", ".join([_way("true", "D", "2", q, "''"), *kept, _way("fit", "R", "more + 1", _NEXT[q], f"chr(10) || '{_TYPE[_NEXT[q]]}:' || text")]) + "])"


def _inserted(q: int) -> str:
    one, two = _NEXT[q], _NEXT[_NEXT[q]]
    lines = [f"chr(10) || '{_TYPE[k]}:'" for k in (one, two)]
    return f"list_min([v[{q}], {_way('true', 'I', '5', one, lines[0])}, {_way('true', 'II', '10', two, ' || '.join(lines))}])"


op13_structure_repair = f"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS cv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, ({_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20)::BIGINT AS kind FROM conversations, crc),
w AS (SELECT cv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY cv ORDER BY turn NULLS FIRST, {_TURN_KEY.format(r='role', x='text')}) AS i FROM w),
g AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed, row_number() OVER (PARTITION BY cv, role, text ORDER BY i) > 1 AS again, role[1:1] AS e FROM o),
f AS (SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN trimmed[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(e) OVER (PARTITION BY cv ORDER BY i) || e AS pair FROM g),
z AS (SELECT cv, i, role, text, e, fault NOT IN ('blank', 'duplicate') AS fit, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM f),
r AS (SELECT cv, count(*) AS i, [struct_pack(c := 0::BIGINT, a := '', o := ''), struct_pack(c := 10::BIGINT, a := 'II', o := chr(10) || 'user:' || chr(10) || 'assistant:'), struct_pack(c := 5::BIGINT, a := 'I', o := chr(10) || 'assistant:'), struct_pack(c := 0::BIGINT, a := '', o := '')] AS v FROM f GROUP BY cv
  UNION ALL
  SELECT cv, i - 1, [{', '.join(map(_inserted, _NEXT))}] FROM (SELECT r.cv, r.i, [{', '.join(map(_turn_ways, _NEXT))}] AS v FROM r JOIN z ON z.cv = r.cv AND z.i = r.i)),
n AS (SELECT cv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY cv)
SELECT nullif(cv, ' ')::BIGINT AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v[1].c, 0) AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(v[1].o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT cv FROM k) LEFT JOIN n USING (cv) LEFT JOIN (SELECT cv, v FROM r WHERE i = 0) USING (cv)"""

ORACLES = {k: v for k, v in list(globals().items()) if k.startswith("op")}
