"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_ESCAPED = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '>', '\g')"

CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(6 + length({_ESCAPED.format("role")}) + 1 + length({_ESCAPED.format("text")}) + 7) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

# Windows of at least 50 words forwards and backwards; lists of lines stand for their hashes.
LINES = """
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), numbered AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split
), counted AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM numbered
), summed AS (
  SELECT doc_id, pos, line, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, n FROM counted WHERE n > 0
), lines AS (
  SELECT doc_id, pos, line, CAST(upto AS BIGINT) AS upto, CAST(upto - n AS BIGINT) AS before FROM summed
), windows AS (
  SELECT doc_id, 0 AS kind, pos AS start, max(pos) OVER w AS fin, list(line) OVER w AS k, max(upto) OVER w - before AS size
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, 1, min(pos) OVER w, pos, list(line) OVER w, upto - min(before) OVER w
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), long AS (
  SELECT doc_id, kind, start, fin, k FROM windows WHERE size >= 50
), ranked AS (
  SELECT *, first_value(doc_id) OVER o AS d1, first_value(fin) OVER o AS f1
  FROM long WINDOW o AS (PARTITION BY kind, k ORDER BY doc_id, start, fin)
), later AS (
  SELECT DISTINCT doc_id, start, fin FROM ranked WHERE doc_id <> d1 OR start > f1
), reach AS (
  SELECT *, max(fin) OVER (PARTITION BY doc_id ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM later
), opened AS (
  SELECT *, sum(CASE WHEN r IS NULL OR start > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, fin) AS run FROM reach
), runs AS (
  SELECT doc_id, run, min(start) AS s, max(fin) AS e FROM opened GROUP BY doc_id, run
), listed AS (
  SELECT doc_id, string_agg(s || '-' || e, ',' ORDER BY s) AS runs, sum(e - s + 1) AS gone FROM runs GROUP BY doc_id
), left_over AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.pos) AS text
  FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = n.doc_id AND n.pos BETWEEN r.s AND r.e)
  GROUP BY n.doc_id
)
SELECT s.doc_id, CASE WHEN l.runs IS NULL THEN s.text ELSE coalesce(o.text, '') END AS text,
  CAST(coalesce(len(s.ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(l.gone, 0) AS INTEGER) AS deleted_lines,
  coalesce(l.runs, '') AS runs
FROM split s LEFT JOIN listed l ON s.doc_id = l.doc_id LEFT JOIN left_over o ON s.doc_id = o.doc_id
"""

# Every pair that shares a shingle, compared exactly; classes are what pairs connect.
NEAR = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), parts AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), shared AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS total, count(*) AS k
  FROM parts a JOIN parts b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
  SELECT x, y FROM shared WHERE 9 * k >= 4 * total
  UNION ALL SELECT a.doc_id, b.doc_id FROM sets a JOIN sets b ON a.doc_id <> b.doc_id WHERE len(a.s) = 0 AND len(b.s) = 0
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
), classes AS (
  SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id
), counted AS (
  SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x
)
SELECT c.doc_id, c.class_id, coalesce(n.n_links, 0) AS n_links FROM classes c LEFT JOIN counted n ON n.doc_id = c.doc_id
"""

# All quotients of every source (and shard) are ranked; the library compares the few that matter.
MIX = """
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('10:' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS draw
  FROM documents
), weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size, sum(size) * CAST(3 AS DOUBLE) AS cap, 1 + count(*) // 50000 AS h,
    row_number() OVER (ORDER BY source NULLS LAST) AS sid,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM base GROUP BY source
), levels AS (
  SELECT sid, cap / weight AS f,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed
), level AS (
  SELECT min_by((a - given) / rest, f) AS l
  FROM levels, (SELECT CAST(sum(size) AS BIGINT) AS a FROM weighed) WHERE f >= (a - given) / rest
), aimed AS (
  SELECT source, sid, h, size AS source_size, least(cap, l * weight) AS target FROM weighed, level
), total AS (
  SELECT a, greatest(1, least(64 + a // 262144, CAST(floor(least_target / 128) AS BIGINT))) AS b
  FROM (SELECT CAST(sum(source_size) AS BIGINT) AS a, coalesce(min(target) FILTER (WHERE target > 0), 0) AS least_target FROM aimed)
), seats AS (
  SELECT CAST(floor(a / b + 0.5) AS BIGINT) AS s FROM total
), quotients AS (
  SELECT sid, s, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, sid, k) AS r
  FROM (SELECT sid, target, s, unnest(range(s)) AS k FROM aimed, seats WHERE target > 0)
), won AS (
  SELECT sid, count(*) AS blocks FROM quotients WHERE r <= s GROUP BY sid
), placed AS (
  SELECT d.doc_id, d.size, d.draw, t.sid, t.target, t.source_size, CAST('0x' || substr(d.draw, 1, 7) AS BIGINT) % t.h AS shard
  FROM base d JOIN aimed t ON d.source IS NOT DISTINCT FROM t.source
), held AS (
  SELECT sid, shard, CAST(sum(size) AS BIGINT) AS held FROM placed GROUP BY sid, shard
), shares AS (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY held / (2 * k + 1) DESC, shard, k) AS r
  FROM (SELECT sid, shard, held, blocks, unnest(range(blocks)) AS k FROM held JOIN won USING (sid) WHERE held > 0)
), quotas AS (
  SELECT sid, shard, any_value(held) AS held, b,
    least(b * count(*) FILTER (WHERE r <= blocks), 3 * any_value(held)) AS quota
  FROM shares, total GROUP BY sid, shard, b
), dealt AS (
  SELECT sid, shard, held, quota // held AS whole, quota % held AS rest,
    b * (CAST('0x' || substr(md5('10:' || sid || ':' || shard), 1, 13) AS BIGINT) % CAST(ceil(held / b) AS BIGINT)) AS f
  FROM quotas
), lined AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY sid, shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM placed
)
SELECT l.doc_id, l.size, l.source_size, l.target,
  CAST(coalesce(whole * size + greatest(0, least(f + rest, held, start + size) - greatest(f, start))
    + greatest(0, least(f + rest - held, start + size) - start), 0) AS BIGINT) AS taken
FROM lined l LEFT JOIN dealt d ON d.sid = l.sid AND d.shard = l.shard
"""

# Every pair of sources over every kept term, one by one.
AUDIT = r"""
WITH base AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM base
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), groups AS (
  SELECT DISTINCT lang, source FROM base
), counts AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c
    ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM counts GROUP BY lang, source
), priced AS MATERIALIZED (
  SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000::HUGEINT * (c.n + 2) // (t.total + 2 * t.v) AS p
  FROM counts c JOIN totals t ON t.lang = c.lang AND t.source = c.source
), of_lang AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM kept
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM priced a JOIN priced b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), every_term AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - l.q) * (p.p - l.q) // (p.p + l.q))::BIGINT AS value
  FROM priced p JOIN of_lang l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q
)
SELECT lang, source, part, item, value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (FROM every_pair UNION ALL FROM every_term)
QUALIFY part = 'pair' OR rank <= 10
"""

# All scores of all anchors.
NEGATIVES = """
WITH base AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS MATERIALIZED (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, b.r AS br, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM base a JOIN base b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) AS no FROM scored WHERE label = al QUALIFY no <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.no ORDER BY n.score DESC, n.vec_id, n.br)::INTEGER AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.ar = p.ar AND n.label <> p.label AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

ORACLES: dict[str, str] = {
    "op5_near_join": NEAR,
    "op7_line_dedup": LINES,
    "op9_chat_turns": CHAT,
    "op10_mix_sources": MIX,
    "op11_source_audit": AUDIT,
    "op12_hard_negatives": NEGATIVES,
}
