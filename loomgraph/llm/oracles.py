"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality import CHAR_LEAST, CHAR_LIMIT, COMMON_WORDS, SYMBOLS, WORD_LEAST, WORD_LIMIT

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: CRC-32 bit by bit: a table of 256 remainders from the reversed polynomial, then a fold over the bytes.
SHARDS = """WITH RECURSIVE r AS (SELECT b::BIGINT AS b, b::BIGINT AS v, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM r WHERE k < 8),
  crc AS (SELECT list(v ORDER BY b) AS t FROM r WHERE k = 8),
  d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
  s AS (SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
  p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM s),
  q AS (SELECT *, least(15, ((2 * start + size) * 16) // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, NULL::INT AS grown_shard FROM q"""

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
  g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  t AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT e.b, t.r FROM t JOIN e ON e.a = t.v)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(r) AS c FROM t GROUP BY v) m ON m.v = documents.doc_id"""


def _quality() -> str:
    symbols = " + ".join(f"(strlen(text) - strlen(replace(text, '{c}', '')))" for c in SYMBOLS)
    without = lambda p: f"(length(text) - length(regexp_replace(text, '{p}', '', 'g')))"
    counts = ", ".join(f"((strlen(sp) - strlen(replace(sp, ' {w} ', ''))) // {len(w) + 2})::BIGINT" for w in COMMON_WORDS)
    js = "sqrt(greatest(0.0, list_sum(list_transform(list_zip({0}, {1}), lambda z: (CASE WHEN z[1] > 0 THEN z[1] / sp_{2} * log2(z[1] / sp_{2} / ((z[1] / sp_{2} + z[2] / sq_{2}) / 2)) ELSE 0.0 END + CASE WHEN z[2] > 0 THEN z[2] / sq_{2} * log2(z[2] / sq_{2} / ((z[1] / sp_{2} + z[2] / sq_{2}) / 2)) ELSE 0.0 END) / 2))))"
    return f"""WITH b AS (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
  x AS (SELECT *, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, ({symbols})::BIGINT AS n_symbols, lower(' ' || array_to_string(w, '  ') || ' ') AS sp, list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^[\\x20\\x09-\\x0D]*$')) AS l FROM b),
  g AS (SELECT doc_id, w[i::INT + 1] || ' ' || w[i::INT + 2] || ' ' || w[i::INT + 3] AS t, i FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM x WHERE len(w) >= 3)),
  o AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g),
  r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM o, range(3) u(k) WHERE c > 1 GROUP BY doc_id),
  f AS (SELECT x.doc_id, lang, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, [length(text) - word_chars, n_symbols, {without('[A-Z]')}, {without('[0-9]')}, {without('[.,;:!?' + "''" + '"()-]')}, strlen(text) - length(text)] AS c6, length(text) AS len, [{counts}] AS wc FROM x LEFT JOIN r USING (doc_id)),
  h AS (SELECT *, list_append(c6, greatest(0, len - c6[1] - c6[2] - c6[3] - c6[4] - c6[5])) AS ch, list_append(wc, n_words - list_sum(wc)::BIGINT) AS wh, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
  cr AS (SELECT lang, i, sum(ch[i]) AS v FROM h, range(1, 8) u(i) WHERE NOT base_failed GROUP BY ALL), wr AS (SELECT lang, i, sum(wh[i]) AS v FROM h, range(1, {len(COMMON_WORDS) + 2}) u(i) WHERE NOT base_failed GROUP BY ALL),
  ref AS (SELECT c.lang, c.q AS qc, w.q AS qw FROM (SELECT lang, list(v::DOUBLE ORDER BY i) AS q FROM cr GROUP BY lang) c JOIN (SELECT lang, list(v::DOUBLE ORDER BY i) AS q FROM wr GROUP BY lang) w ON c.lang IS NOT DISTINCT FROM w.lang),
  j AS (SELECT h.*, qc, qw, list_transform(ch, lambda v: v::DOUBLE) AS pc, list_transform(wh, lambda v: v::DOUBLE) AS pw, list_sum(ch)::DOUBLE AS sp_c, list_sum(qc) AS sq_c, list_sum(wh)::DOUBLE AS sp_w, list_sum(qw) AS sq_w FROM h LEFT JOIN ref ON h.lang IS NOT DISTINCT FROM ref.lang),
  k AS (SELECT *, CASE WHEN word_chars >= {CHAR_LEAST} AND sq_c > 0 THEN {js.format('pc', 'qc', 'c')} END AS dc, CASE WHEN n_words >= {WORD_LEAST} AND sq_w > 0 THEN {js.format('pw', 'qw', 'w')} END AS dw FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(dc, 0) <= {CHAR_LIMIT} AND coalesce(dw, 0) <= {WORD_LIMIT} AS kept, round(dc, 6) AS char_distance, round(dw, 6) AS word_distance FROM k"""


QUALITY = _quality()

_ESC = r"regexp_replace({0}, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g')"
_ROLE = _ESC.format(r"replace(replace(coalesce(role, ''), '\', '\\'), chr(10), '\n')")

CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  f AS (SELECT *, length('<|turn|>') + length({_ROLE}) + 1 + length({_ESC.format("text")}) + length('<|end|>') + 1 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM f GROUP BY conv_id"""

LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
  k AS (SELECT *, {_LOW.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
  o AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS dropped FROM k)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN dropped THEN 1 ELSE 0 END)::BIGINT AS n_dropped, sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256 FROM o GROUP BY doc_id"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)"
_INTEGERS = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"

NEGATIVES = f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_INTEGERS} AS q FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"""


def centroids(k: int, rounds: int, dims: int) -> str:
    """Plain rounds: all distances, the nearest centroid, floors of means."""
    sql = f"""WITH v AS MATERIALIZED (SELECT vec_id, {_INTEGERS} AS q FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), vec_id, q) - 1 AS INT) AS cluster, q AS c FROM v QUALIFY row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), vec_id, q) <= {k})"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT vec_id, q, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM
  (SELECT n, vec_id, q, cluster, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM (SELECT row_number() OVER () AS n, * FROM v) CROSS JOIN c{i}) GROUP BY n, vec_id, q)"""
        if i < rounds:
            sql += f""",
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(m ORDER BY i) AS m FROM
  (SELECT cluster, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(len(q))) AS i FROM a{i}) GROUP BY cluster, i)) GROUP BY cluster) USING (cluster))"""
    return sql + f"""
SELECT vec_id, cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
