"""The same results as SQL for DuckDB, where SQL can express them."""

_STOPS = """'the','of','and','to','in','that','is','with','be','it','for','on','are','as','by','this','from','at','was','or','an',
 'der','die','das','und','den','von','mit','ist','im','für','nicht','ein','eine','zu','des','sich','auf','le','la','les','de','et','en','un','une','que','du',
 'dans','est','pour','qui','par','au','sur','el','los','las','y','del','por','para','una','como','más','su','al','con'"""

_PARTS = [("assign", "secret", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, "length(g) >= 8"),
          ("access", "identifier", "AKIA[A-Z0-9]+", 0, "length(m) >= 16"), ("hex", "secret", "[0-9a-f]+", 0, "length(m) >= 32"),
          ("ident", "identifier", r"""(?i:(?:access_?key_?id|client_?id|username|user|login|account)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@+-]{3,})""", 0, "true"),
          ("phrase", "secret", r"""(?i:(?:pwd|pass|pin|auth|credentials?)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=!@#%-]{4,})""", 0, "true"),
          ("mixed", "secret", "[A-Za-z0-9+/_-]{20,}", 0, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"),
          ("endpoint", "endpoint", r"https?://[A-Za-z0-9.:/_-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}", 0, "true"),
          ("", "break", r"\n[\x20\t]*\n", 0, "true")]


def _placed(no: int, kind: str, role: str, regex: str, group: int, cond: str) -> str:
    before = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {no} AS no, '{kind}' AS kind, '{role}' AS role, s AS start, s + length(m) AS stop FROM (
        SELECT doc_id, ms[i] AS m, gs[i] AS g, {before.format('ps[1:i]')} + {before.format('ms[1:i - 1]')} AS s FROM (
            SELECT doc_id, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
                SELECT doc_id, regexp_extract_all(t, '{regex}') AS ms, regexp_extract_all(t, '{regex}', {group}) AS gs, string_split_regex(t, '{regex}') AS ps FROM d)))
    WHERE {cond}"""


def _beside(roles: str) -> str:
    return (f"EXISTS (SELECT 1 FROM parts y WHERE y.doc_id = x.doc_id AND y.scope = x.scope AND y.role IN ({roles}) "
            "AND greatest(y.start - x.stop, x.start - y.stop) BETWEEN 0 AND 400)")


_SECRETS = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 found AS MATERIALIZED ({' UNION ALL '.join(_placed(i, *p) for i, p in enumerate(_PARTS))}),
 breaks AS (SELECT doc_id, start FROM found WHERE role = 'break'),
 parts AS MATERIALIZED (SELECT f.*, (SELECT count(*) FROM breaks b WHERE b.doc_id = f.doc_id AND b.start <= f.start) AS scope FROM found f WHERE role <> 'break'),
 kept AS (SELECT * FROM parts x WHERE no < 3 OR (NOT EXISTS (SELECT 1 FROM parts y WHERE y.doc_id = x.doc_id AND y.no < 3 AND y.start < x.stop AND x.start < y.stop)
    AND CASE role WHEN 'identifier' THEN {_beside("'secret'")} WHEN 'secret' THEN {_beside("'identifier', 'endpoint'")}
        ELSE {_beside("'secret'")} AND {_beside("'identifier'")} END)),
 listed AS (SELECT doc_id, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (WHERE no < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (doc_id)"""

# CRC-32 of the UTF-8 bytes of a string, from its rule.
_CRC = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl)"""


def _crc(text: str) -> str:
    codes = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tbl[xor(c, b) % 256 + 1])), 4294967295)"


ORACLE = {"op1_secrets": _SECRETS, "op6_sharding": r"""
WITH RECURSIVE shards AS (SELECT i, printf('shard-%02d', i) AS shard, ('0x' || substr(md5(printf('shard-%02d', i)), 1, 15))::BIGINT % 4099 AS head,
        ('0x' || substr(md5(printf('shard-%02d', i)), 16, 15))::BIGINT % 4098 + 1 AS stride FROM range(16) t(i)),
 turns AS (SELECT 0 AS turn, list_transform(range(4099), lambda x: -1) AS owner
    UNION ALL
    SELECT turn + 1, list_concat(owner[:slot], [turn % 16], owner[slot + 2:])
    FROM (SELECT turn, owner, list_filter(list_transform(range(4099), lambda j: (head + j * stride) % 4099), lambda x: owner[x + 1] = -1)[1] AS slot
          FROM turns JOIN shards ON i = turn % 16 WHERE turn < 4099)),
 slots AS (SELECT unnest(range(4099)) AS slot, unnest(owner) AS i FROM turns WHERE turn = 4099)
SELECT doc_id, slot, shard FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 15))::BIGINT % 4099 AS slot
    FROM documents) JOIN slots USING (slot) JOIN shards USING (i)""",
          "op7_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
 w AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3),
 g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
 rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
 m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: lower(x) IN (STOPS))) AS n_stop,
        len(list_filter(ls, lambda l: regexp_matches(l, '^[ \t\n\x0B\f\r]*[-*•]'))) AS n_bullet,
        len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[ \t\n\x0B\f\r]*$'))) AS n_cut
    FROM d LEFT JOIN rep USING (doc_id)),
 f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= 3 * n_words AND n_stop >= 2
       AND 2 * n_dup_lines <= n_lines AND 10 * n_bullet <= 9 * n_lines AND 2 * n_cut <= n_lines AS kept FROM f""".replace("STOPS", _STOPS),
          "op8_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
 reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT r.x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x""",
          "op10_decontamination": r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w,
        generate_subscripts(regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1) AS i
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
 wins AS (SELECT DISTINCT item_id, array_to_string(ws[p:p + 12], ' ') AS win, least(13, len(ws)) AS n
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
 lens AS (SELECT DISTINCT n FROM wins),
 seqs AS (SELECT doc_id, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS s FROM d),
 cut AS (SELECT doc_id, i, n, array_to_string(string_split(s, ' ')[1:n], ' ') AS win FROM seqs, lens WHERE len(string_split(s, ' ')) >= n),
 occ AS (SELECT c.doc_id, c.i, c.n, wins.item_id FROM cut c JOIN wins ON wins.win = c.win AND wins.n = c.n),
 hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
 its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id),
 n AS (SELECT doc_id, count(*) AS n_words FROM d GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM documents x LEFT JOIN n USING (doc_id) LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)""",
          "op11_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
 f AS (SELECT t, min(page_id) AS low FROM p WHERE strlen(t) >= 100 GROUP BY t)
SELECT page_id, strlen(t) AS payload_bytes, sha256(t) AS payload_digest, CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN low < page_id THEN low END AS refers_to, true AS intact FROM p LEFT JOIN f USING (t)""",
          "op12_importance": rf"""
WITH {_CRC},
 d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
 dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
 hashed AS (SELECT w, {_crc('w')} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM q), crc_table),
 src AS (SELECT b, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY b), tgt AS (SELECT b, count(*) AS n FROM q JOIN hashed USING (w) GROUP BY b),
 alls AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM q) AS t_all),
 gain AS (SELECT x.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + 10000)))) AS g
    FROM (SELECT unnest(range(10000)) AS b) x LEFT JOIN src s USING (b) LEFT JOIN tgt t USING (b), alls),
 weighed AS (SELECT doc_id, sum(g) AS total FROM dw JOIN hashed USING (w) JOIN gain USING (b) GROUP BY doc_id),
 scored AS (SELECT doc_id, len(ws) AS n_features, coalesce(floor(total / len(ws)), 0)::BIGINT AS weight,
        coalesce(floor(total / len(ws)), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
    FROM d LEFT JOIN weighed USING (doc_id)),
 placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)""",
          "op13_prefix_trie": rf"""
WITH {_CRC},
 t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
 h AS (SELECT conv_id, ts, {_crc('conv_id::VARCHAR')} % 6 AS h FROM t, crc_table),
 r AS (SELECT h.conv_id, list_concat(t.ts[1:h], h.ts[h + 1:]) AS s FROM h LEFT JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100),
 m AS (SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM r)),
 n AS (SELECT p, d, min(conv_id) AS low, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS e FROM m GROUP BY p, d),
 k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL),
 u AS (SELECT p[1:a] AS p, a AS d, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS leaves, sum(own) AS saved
    FROM (SELECT n.p, unnest(range(n.d + 1)) AS a, k.k IS NULL AS leaf, CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * length(n.p[n.d].x) END AS own FROM n LEFT JOIN k ON k.d = n.d AND k.p = n.p) GROUP BY ALL)
SELECT n.low AS conv_id, n.d AS depth, up.low AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens,
       sha256(coalesce(n.e, '')) AS ends_sha256
FROM n JOIN u ON u.d = n.d AND u.p = n.p LEFT JOIN k ON k.d = n.d AND k.p = n.p LEFT JOIN n up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]"""}
