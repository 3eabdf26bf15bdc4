"""SQL, in DuckDB's dialect, for the queries that SQL can express over whole tables."""

from __future__ import annotations

# Links between vectors of one label by the cosine in doubles, and what they reach.
_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT vec_id,
  coalesce(n, 0)::BIGINT AS n_links,
  least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = vec_id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = vec_id
"""

# What is read back from the formatted conversations, and their length by the template:
# per turn 4 + role + 2 + text + 9 code points, and one for each escaped character.
_CHAT = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok'
  FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(15 + length(role) + length(text)
      + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
      + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

# Distinct shingles of five words, all pairs of documents that share one, and what the
# links at 0.8 reach.
_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
    ELSE list_distinct([words[i:i+4] FOR i IN range(1, len(words) - 3)]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, hash(shingle) AS shingle FROM s),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM k x JOIN k y
  ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
  least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = doc_id
"""

# Words from 1 on, every window of 50 by its words, and the words that no window removes.
_REPEATS = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i+49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j
  FROM win JOIN (SELECT h, min(doc_id) AS low FROM win GROUP BY h) USING (h) WHERE low < doc_id),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text
  FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _codes() -> str:
    """Assignment and averaging written out round by round."""
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM v, range(4) t(p)),
book0 AS MATERIALIZED (
  SELECT p, e, v FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id, v) - 1 AS e FROM part)
  WHERE e < 256)"""
    ]
    for i in range(5):
        steps.append(
            f"""near{i} AS MATERIALIZED (
  SELECT vec_id, part.p, min({{'d': list_sum(list_transform(list_zip(part.v, b.v),
    lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, 'e': e}}) AS m
  FROM part JOIN book{i} b ON part.p = b.p GROUP BY vec_id, part.p)"""
        )
        if i < 4:
            steps.append(
                f"""mean{i} AS MATERIALIZED (
  SELECT p, e, list(x ORDER BY i) AS v FROM (
    SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (
      SELECT p, m.e AS e, unnest(part.v) AS x, generate_subscripts(part.v, 1) AS i
      FROM near{i} JOIN part USING (vec_id, p)) GROUP BY p, e, i) GROUP BY p, e),
book{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} n USING (p, e))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + """,
total AS (
  SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error
  FROM near4 GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(x, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (
    SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM book4))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM total JOIN v USING (vec_id), digest
"""
    )


# The draw of each shard by the md5 of key and shard, and slots by key. The CRC-32 of the
# bytes: one for each bit, by the table of what eight shifts make of a byte.
_SHARDS = r"""
WITH RECURSIVE step(b, i, c) AS (
  SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL SELECT b, i + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS crc FROM step WHERE i = 8),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 8 AS size FROM documents),
c AS (
  SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(
      range(1, strlen(text)::BIGINT + 1), lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::BIGINT)),
    lambda r, x: xor(r // 256, crc[(xor(r % 256, x)) + 1]))) AS text_crc32
  FROM d, crc),
draw AS (
  SELECT doc_id, s, -ln((('0x' || substr(md5('0:' || doc_id::VARCHAR || ':' || s::VARCHAR), 1, 12))::BIGINT + 0.5)
    / 281474976710656.0::DOUBLE) AS d FROM documents, range(25) t(s)),
won AS (
  SELECT doc_id, arg_min(s, d) FILTER (s < 24)::INT AS shard, arg_min(s, d)::INT AS grown_shard FROM draw GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM c JOIN won USING (doc_id)
"""

# Each source's target; its words in the order of a hash of the key, taken round and round.
_MIXED = r"""
WITH n AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    md5('0:' || doc_id::VARCHAR) AS draw FROM documents),
t AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM n GROUP BY source),
level AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM t WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)),
target AS (
  SELECT source, source_size, CASE WHEN 2.0::DOUBLE * source_size <= level * weight THEN 2.0::DOUBLE * source_size
    ELSE max(level) FILTER (2.0::DOUBLE * source_size > level * weight) OVER () * weight END AS target FROM level),
placed AS (
  SELECT n.*, source_size, target, least(round(target), 2 * source_size)::BIGINT AS words,
    coalesce(sum(size) OVER (PARTITION BY n.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
  FROM n JOIN target t ON t.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE words // greatest(source_size, 1) * size
    + greatest(0, least(size, words % greatest(source_size, 1) - begin)) END::BIGINT AS taken
FROM placed
"""

# A sketch: 32 bits of the md5 of each shingle of five words, a quarter of them or, of up
# to 64, all. A function of the text, used for each text and its edit.
_SKETCHES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(doc_id) OVER (ORDER BY doc_id) AS after,
    min(doc_id) OVER () AS first FROM documents),
e AS (
  SELECT d.doc_id, d.text, n.text AS next_text, left(d.text, length(d.text) - length(d.text) // 2) || left(n.text, length(d.text) // 2) AS edited
  FROM d JOIN d n ON n.doc_id = coalesce(d.after, d.first)),
t AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
w AS (SELECT doc_id, kind, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
h AS (
  SELECT doc_id, kind, list_distinct(CASE WHEN len(words) = 0 THEN []::BIGINT[] ELSE [
    ('0x' || substr(md5(array_to_string(words[i:i+4], ' ')), 1, 8))::BIGINT FOR i IN range(1, greatest(len(words) - 3, 2))] END) AS every FROM w),
k AS (
  SELECT doc_id, kind, list_sort(CASE WHEN len(every) <= 64 THEN every ELSE list_filter(every, lambda x: x < 1073741824) END) AS hashes FROM h),
s AS (
  SELECT e.*, o.hashes AS own, x.hashes AS edit, z.hashes AS next
  FROM e JOIN d USING (doc_id) JOIN k o ON o.doc_id = e.doc_id AND o.kind = 0 JOIN k x ON x.doc_id = e.doc_id AND x.kind = 1
    JOIN k z ON z.doc_id = coalesce(d.after, d.first) AND z.kind = 0),
p AS (
  SELECT *, CASE WHEN list_max(own) >= 1073741824 AND list_max(edit) >= 1073741824 THEN own ELSE list_filter(own, lambda x: x < 1073741824) END AS a,
    CASE WHEN list_max(own) >= 1073741824 AND list_max(next) >= 1073741824 THEN own ELSE list_filter(own, lambda x: x < 1073741824) END AS b FROM s)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  to_base64(unhex(array_to_string(list_transform(own, lambda x: printf('%08x', x)), ''))) AS fingerprint,
  to_base64(unhex(array_to_string(list_transform(edit, lambda x: printf('%08x', x)), ''))) AS edited_fingerprint,
  CASE WHEN len(a) > 0 THEN len(list_intersect(a, edit))::DOUBLE / len(a) ELSE (text = edited)::INT::DOUBLE END AS near_edited,
  CASE WHEN len(b) > 0 THEN len(list_intersect(b, next))::DOUBLE / len(b) ELSE (text = next_text)::INT::DOUBLE END AS near_next
FROM p
"""

ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": _VECTORS,
    "op6_ngram_jaccard_join": _JACCARD,
    "op5_rendezvous_sharding": _SHARDS,
    "op7_scaled_sketch": _SKETCHES,
    "op8_source_mixing": _MIXED,
    "op9_reply_trees": _CHAT,
    "op12_vector_codes": _codes(),
    "op13_substring_dedup": _REPEATS,
}
