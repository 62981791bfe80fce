"""DuckDB SQL for the queries that SQL can express."""

#: What quotations.link_conversations does, of a table @MESSAGES@ (conv_id, turn, role, text).
LINK_QUOTATIONS = r"""
WITH RECURSIVE messages AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, text, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM @MESSAGES@),
marked AS (SELECT *, list_transform(ls, lambda l: {'depth': length(regexp_replace(regexp_extract(l, '^\s*(?:>\s?)+'), '[^>]', '', 'g')), 'text': regexp_replace(l, '^\s*(?:>\s?)+', '')}) AS lines FROM messages),
cleaned AS (SELECT *, list_max(list_transform(lines, lambda x: x.depth)) AS levels,
  CASE WHEN len(list_filter(lines, lambda x: x.depth > 0)) = 0 THEN coalesce(text, '') ELSE
    regexp_replace(regexp_replace(coalesce(array_to_string(list_transform(list_filter(lines, lambda x: x.depth = 0), lambda x: x.text), chr(10)), ''), '\n[ \t]*(?:\n[ \t]*)+\n?', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') END AS clean FROM marked),
each_ AS (SELECT row_number() OVER () AS id, conv_id, turn, lines FROM cleaned WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
flat AS (SELECT id, conv_id, turn, i, lines[i].depth AS depth, trim(regexp_replace(lower(lines[i].text), '\s+', ' ', 'g')) AS t FROM each_, range(1, len(lines) + 1) r(i)),
starts AS (SELECT *, CASE WHEN t = '' OR coalesce(lag(depth) OVER w <> depth OR lag(t) OVER w = '', true) THEN 1 ELSE 0 END AS s FROM flat WINDOW w AS (PARTITION BY id ORDER BY i)),
runs AS (SELECT *, sum(s) OVER (PARTITION BY id ORDER BY i) AS run FROM starts),
passages AS (SELECT DISTINCT conv_id, turn, depth, p FROM (
  SELECT conv_id, turn, depth, t AS p FROM runs WHERE t <> ''
  UNION ALL SELECT conv_id, turn, depth, string_agg(t, ' ' ORDER BY i) FROM runs WHERE t <> '' GROUP BY id, conv_id, turn, run, depth)),
found AS (SELECT q.conv_id, q.turn, q.depth, (SELECT max(o.turn) FROM passages o WHERE o.conv_id = q.conv_id AND o.p = q.p AND o.depth = 0 AND o.turn < q.turn) AS source FROM passages q WHERE q.depth > 0),
sources AS (SELECT conv_id, turn, depth, source, count(*) AS n FROM found WHERE source IS NOT NULL GROUP BY ALL),
replies AS (SELECT conv_id, turn, sum(n) AS n_linked, (max({'n': n, 's': source}) FILTER (depth = 1)).s AS reply_to FROM sources GROUP BY ALL),
quoted AS (SELECT conv_id, turn, count(*) AS n_quoted FROM found GROUP BY ALL),
up AS (SELECT conv_id, turn, reply_to AS root FROM replies WHERE reply_to IS NOT NULL
  UNION ALL SELECT up.conv_id, up.turn, r.reply_to FROM up JOIN replies r ON r.conv_id = up.conv_id AND r.turn = up.root AND r.reply_to IS NOT NULL),
roots AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY ALL),
every AS (SELECT c.*, r.reply_to, coalesce(x.root, c.turn) AS root_turn, coalesce(q.n_quoted, 0) AS n_quoted, coalesce(r.n_linked, 0) AS n_linked FROM cleaned c
  LEFT JOIN replies r USING (conv_id, turn) LEFT JOIN quoted q USING (conv_id, turn) LEFT JOIN roots x USING (conv_id, turn))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS LAST, turn NULLS LAST, role, coalesce(text, '')) AS position, turn, role, reply_to, root_turn,
  CAST(coalesce(levels, 0) AS BIGINT) AS quote_levels, CAST(n_quoted AS BIGINT) AS n_quoted, CAST(n_linked AS BIGINT) AS n_linked, clean AS text, '<|' || role || '|>' || chr(10) || clean || chr(10) || '<|end|>' || chr(10) AS formatted FROM every
"""

#: What quotations.drill does to the table conversations.
DRILLED = r"""first_ AS (SELECT conv_id, turn, min(l) AS l FROM (SELECT conv_id, turn, trim(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10))[1], ' ') AS l FROM conversations) WHERE l <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
signed AS (SELECT c.*, a.l AS l1, b.l AS l2, substr(md5(CAST(c.conv_id AS VARCHAR) || '|' || CAST(c.turn AS VARCHAR)), 1, 1) AS digit FROM conversations c
  LEFT JOIN first_ a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN first_ b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
quoted_ AS (SELECT *, CASE WHEN l2 IS NOT NULL AND digit < '4' THEN '>> ' || l2 || chr(10) ELSE '' END || CASE WHEN l1 IS NOT NULL AND digit < '8' THEN '> ' || l1 || chr(10) ELSE '' END AS quotes FROM signed),
drilled AS (SELECT conv_id, turn, role, CASE WHEN quotes = '' THEN text ELSE quotes || chr(10) || coalesce(text, '') END AS text FROM quoted_),
"""


def _bytes(v: str, n: int) -> str:
    """``n`` bytes of a number, the least first, in hexadecimal."""
    return " || ".join(f"printf('%02X', ({v} >> {8 * i}) & 255)" for i in range(n))


BMP_HEAD = " || ".join(["'424D'", *(_bytes(v, n) for v, n in (("(1078 + rows_ * 24)", 4), ("0", 4), ("1078", 4), ("40", 4), ("24", 4), ("rows_", 4), ("1", 2), ("8", 2), ("0", 4), ("(rows_ * 24)", 4), ("2835", 4), ("2835", 4), ("256", 4), ("0", 4)))])

ORACLES = {
    "op3_media": rf"""
WITH RECURSIVE padded AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
media AS (SELECT r, doc_id, length(h) // 2 AS n_bytes, CAST(greatest(1, ceil(length(h) / 1152.0)) AS BIGINT) AS units, units * 24 AS rows_, rpad(h, CAST(units * 1152 AS INTEGER), 'F') AS g, regexp_extract_all(g, '.{{48}}') AS l FROM padded),
palette AS (SELECT string_agg(printf('%02X%02X%02X00', i, i, i), '' ORDER BY i) AS p FROM range(256) t(i)),
stored AS (SELECT *, CASE WHEN units % 2 = 1 THEN hex(encode('P5' || chr(10) || '24 ' || rows_ || chr(10) || '255' || chr(10))) || g ELSE {BMP_HEAD} || p || array_to_string(list_reverse(l), '') END AS m FROM media, palette),
tiles AS (SELECT r, count(*) AS n_tiles, sha256(unhex(string_agg('934E554D505901007600' || hex(encode(rpad('{{''descr'': ''|u1'', ''fortran_order'': False, ''shape'': (' || least(256, rows_ - 256 * k) || ', 24), }}', 117, ' ') || chr(10))) || array_to_string(l[256 * k + 1:256 * k + 256], ''), '' ORDER BY k))) AS tiles_sha256
  FROM media, range((rows_ + 255) // 256) t(k) GROUP BY r),
bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc(r, t, k, c) AS (SELECT r, substr(g, length(g) - 63), 0, 4294967295 FROM media
  UNION ALL SELECT r, t, crc.k + 1, xor(bits.c, crc.c >> 8) FROM crc JOIN bits ON bits.k = 8 AND bits.i = xor(crc.c, CAST('0x' || substr(t, 2 * crc.k + 1, 2) AS BIGINT)) & 255 WHERE crc.k < 32),
lines AS (SELECT r, rows_, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS y FROM media),
across AS (SELECT x, j, least(9 * x + 9, 24 * j + 24) - greatest(9 * x, 24 * j) AS w FROM range(24) t(x), range(9) u(j) WHERE w > 0),
down AS (SELECT r, line, i, least(8 * y + 8, rows_ * (i + 1)) - greatest(8 * y, rows_ * i) AS v FROM lines, range(8) t(i) WHERE v > 0),
boxes AS (SELECT r, i, j, sum(v * w * CAST('0x' || substr(line, CAST(2 * x + 1 AS INTEGER), 2) AS BIGINT)) AS s FROM down, across GROUP BY ALL),
steps AS (SELECT r, i, j, lead(s) OVER (PARTITION BY r, i ORDER BY j) > s AS up FROM boxes),
signs AS (SELECT r, i, sum(CASE WHEN up THEN 128 >> j ELSE 0 END) AS b FROM steps WHERE j < 8 GROUP BY ALL),
features AS (SELECT r, string_agg(printf('%02x', CAST(b AS INTEGER)), '' ORDER BY i) AS feature FROM signs GROUP BY r)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, units * 576 AS payload_bytes, sha256(unhex(g)) AS payload_sha256, xor(c, 4294967295) AS tail_crc32, CAST(length(m) // 2 AS BIGINT) AS media_bytes, sha256(unhex(m)) AS media_sha256, feature, n_tiles, tiles_sha256
FROM stored JOIN tiles USING (r) JOIN features USING (r) JOIN crc USING (r) WHERE crc.k = 32
""",
    "op6_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM words),
rows_ AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM rows_ a JOIN rows_ b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * shared >= 85 * (len(x.s) + len(y.s) - shared)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT ends.b, reach.r FROM reach JOIN ends ON reach.a = ends.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM sets JOIN reach ON a = doc_id GROUP BY doc_id, len(s)
""",
    "op8_mixing": r"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM sizes) * (SELECT sum(n) FROM sizes)::DOUBLE / n AS rate FROM sizes),
parts AS (SELECT source, rate, greatest(1, ceil(rate / 256))::INT AS parts, rate / greatest(1, ceil(rate / 256))::INT AS mean FROM rates),
cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c, ceil(mean + 12 * sqrt(mean) + 30)::INT AS most FROM parts
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1), most FROM cdf WHERE k < most),
draws AS (SELECT d.doc_id, d.source, p.rate, i, ('0x' || substr(md5('0|' || d.doc_id || '|' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(1, p.parts + 1) r(i)),
hits AS (SELECT doc_id, any_value(rate) AS rate, count(*) FILTER (WHERE c <= u) AS n_copies FROM draws JOIN cdf ON cdf.source IS NOT DISTINCT FROM draws.source GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, h.rate, h.n_copies::INT AS n_copies, c::INT AS copy, md5('order|0|' || d.doc_id || '|' || c) AS shuffle_key
FROM documents d JOIN hits h USING (doc_id), range(1, h.n_copies + 1) r(c)
""",
    "op5_fixity": r"""
WITH named AS (SELECT page_id AS id, md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS m, coalesce(url, '') AS url, coalesce(html, '') AS html,
  substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS sign, chr(13) || chr(10) AS e FROM pages),
text_ AS (SELECT id, sign, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>' || e
  || 'WARC-Date: 1970-01-01T00:00:00Z' || e || 'WARC-Target-URI: ' || url || e || 'Content-Type: text/html' || e || 'Content-Length: ' || octet_length(encode(html)) || e || e || html || e || chr(13) AS body FROM named),
ours_ AS (SELECT id, sha256(encode(body || chr(10))) AS digest, octet_length(encode(body)) + 1 AS length FROM text_ WHERE sign NOT IN ('04', '05')),
theirs_ AS (SELECT id, sha256(encode(body || CASE WHEN sign IN ('00', '01') THEN '?' ELSE chr(10) END)) AS digest, octet_length(encode(body)) + 1 AS length FROM text_, range(CASE WHEN sign IN ('06', '07') THEN 2 ELSE 1 END) t(i) WHERE sign NOT IN ('02', '03')),
rows_ AS (SELECT 0 AS side, id, digest, length, count(*) AS copies FROM ours_ GROUP BY ALL UNION ALL SELECT 1, id, digest, length, count(*) FROM theirs_ GROUP BY ALL),
parted AS (SELECT *, id >> 8 AS file, CAST(('0x' || substr(digest, 1, 8))::BIGINT % CAST(ceil(count(*) OVER (PARTITION BY side, id >> 8) / 4096.0) AS BIGINT) AS INTEGER) AS part FROM rows_),
placed AS (SELECT *, CAST(sum(length * copies) OVER (PARTITION BY side, file, part ORDER BY id NULLS FIRST, digest) - length * copies AS BIGINT) AS record_offset FROM parted),
pair AS (SELECT id, digest, length, file, CAST(coalesce(max(copies) FILTER (side = 0), 0) AS BIGINT) AS copies, CAST(coalesce(max(copies) FILTER (side = 1), 0) AS BIGINT) AS their_copies, max(part) FILTER (side = 0) AS part,
  max(record_offset) FILTER (side = 0) AS record_offset, max(part) FILTER (side = 1) AS their_part, max(record_offset) FILTER (side = 1) AS their_offset FROM placed GROUP BY ALL),
flags AS (SELECT *, bool_or(copies > their_copies) OVER w AS short, bool_or(copies < their_copies) OVER w AS more, bool_or(copies <> their_copies) OVER (PARTITION BY id >> 4) AS descended FROM pair WINDOW w AS (PARTITION BY id))
SELECT id AS record_id, digest, CAST(length AS BIGINT) AS length, copies, their_copies, descended, file, part, record_offset, CASE WHEN short OR more THEN their_part END AS their_part, CASE WHEN short OR more THEN their_offset END AS their_offset,
  CASE WHEN copies > their_copies THEN CASE WHEN more THEN 'damaged' ELSE 'missing' END WHEN copies < their_copies THEN CASE WHEN short THEN 'altered' ELSE 'added' END ELSE 'ok' END AS status FROM flags
""",
    "op2_quotations": LINK_QUOTATIONS.replace("@MESSAGES@", "drilled").replace("WITH RECURSIVE ", "WITH RECURSIVE " + DRILLED, 1),
}
