"""The same results in DuckDB SQL, for the operators that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op2_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
item_start AS (
  SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s
  FROM item WHERE len(words) > 0),
item_window AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(words, s, least(s + 9, len(words))), ' ') AS w,
         least(10, len(words)) AS n
  FROM item_start),
length_of AS (SELECT DISTINCT n FROM item_window),
doc_start AS (
  SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s
  FROM doc, length_of WHERE len(words) >= n),
hit AS (
  SELECT doc_id, s, n, item_id
  FROM (SELECT doc_id, n, s, array_to_string(list_slice(words, s, s + n - 1), ' ') AS w FROM doc_start)
  JOIN item_window USING (w, n)),
word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit))
  GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLE["op4_mixing"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, source_size::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight
  FROM (SELECT source, sum(size) AS source_size FROM sized GROUP BY source)),
fill AS (
  SELECT 0 AS step, 0::HUGEINT AS filled, (SELECT sum(weight) FROM src)::HUGEINT AS w,
         (SELECT 3 * sum(source_size) FROM src)::HUGEINT AS goal
  UNION ALL
  SELECT step + 1, t.filled, t.w, goal
  FROM fill, LATERAL (
    SELECT coalesce(sum(CASE WHEN weight * (goal - fill.filled) >= 4 * source_size * fill.w
                             THEN 4 * source_size END), 0)::HUGEINT AS filled,
           coalesce(sum(CASE WHEN weight * (goal - fill.filled) < 4 * source_size * fill.w
                             THEN weight END), 0)::HUGEINT AS w
    FROM src) t
  WHERE step < 100 AND fill.w > 0),
level AS (SELECT filled, w, goal FROM fill ORDER BY step DESC LIMIT 1),
target AS (
  SELECT source, source_size,
         CASE WHEN w = 0 OR weight * (goal - filled) >= 4 * source_size * w
              THEN (2 * source_size)::DOUBLE
              ELSE (weight * (goal - filled))::DOUBLE / (2 * w)::DOUBLE END AS target
  FROM src, level)
SELECT doc_id, size, source_size, target,
       least(floor(CASE WHEN source_size > 0 THEN size::DOUBLE * target / source_size::DOUBLE ELSE 0.0::DOUBLE END
             + ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT
               / 281474976710656.0::DOUBLE)::BIGINT, 2 * size)::BIGINT AS taken
FROM sized JOIN target ON sized.source IS NOT DISTINCT FROM target.source
"""

ORACLE["op5_fingerprints"] = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
ringed AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC),
                     first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM doc),
edit AS (
  SELECT doc_id, n_chars, text, next_text,
         substr(text, 1, n_chars - n_chars // 3) || substr(next_text, 1, n_chars // 3) AS edited
  FROM ringed),
long AS (
  SELECT doc_id, 1 AS kind, text AS t FROM edit UNION ALL
  SELECT doc_id, 2, edited FROM edit UNION ALL SELECT doc_id, 3, next_text FROM edit),
tree AS (
  SELECT doc_id, kind, list_transform(string_split(t, chr(10) || chr(10)), lambda s, a:
    list_transform(string_split(s, chr(10)), lambda p, b:
      list_transform(
        CASE WHEN a = 1 AND b = 1 THEN list_concat(
          regexp_extract_all(substr(p, 1, 8), '[^\n]{1,2}'), regexp_extract_all(substr(p, 9, 56), '[^\n]{1,8}'),
          regexp_extract_all(substr(p, 65), '(?:[^ ]{1,8} *){1,8}| +'))
        ELSE regexp_extract_all(p, '(?:[^ ]{1,8} *){1,8}| +') END, lambda w: md5(w)))) AS nodes
  FROM long),
node AS (
  SELECT doc_id, kind,
    list_distinct(list_transform(flatten(flatten(nodes)), lambda w: left(w, 8))) AS leaves,
    sha256(array_to_string(list_transform(nodes, lambda s: md5(array_to_string(
      list_transform(s, lambda p: md5(array_to_string(p, ''))), ''))), ''))
    || '|' || array_to_string(list_transform(nodes, lambda s:
      left(md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), '')), 12)
      || '[' || array_to_string(list_transform(s, lambda p:
        left(md5(array_to_string(p, '')), 12) || '(' ||
        array_to_string(list_transform(p, lambda w: left(w, 8)), ',') || ')'), '') || ']'), '') AS fp
  FROM tree)
SELECT e.doc_id, n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint,
       b.fp AS edited_fingerprint,
       CASE WHEN len(a.leaves) + len(b.leaves) = 0 THEN 1.0::DOUBLE
            ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, b.leaves))
                 / (len(a.leaves) + len(b.leaves))::DOUBLE END AS near_edited,
       CASE WHEN len(a.leaves) + len(c.leaves) = 0 THEN 1.0::DOUBLE
            ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, c.leaves))
                 / (len(a.leaves) + len(c.leaves))::DOUBLE END AS near_next
FROM edit e JOIN node a ON a.doc_id = e.doc_id AND a.kind = 1
JOIN node b ON b.doc_id = e.doc_id AND b.kind = 2
JOIN node c ON c.doc_id = e.doc_id AND c.kind = 3
"""

ORACLE["op6_warc"] = r"""
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
held AS (
  SELECT payload_digest, max(page_id) AS holder FROM page WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN holder IS NULL OR page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder IS NULL OR page_id = holder THEN NULL ELSE holder END AS refers_to
FROM page LEFT JOIN held USING (payload_digest)
"""

ORACLE["op7_substring_dedup"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(list_slice(words, s, s + 49), ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM doc WHERE len(words) >= 50)),
seen AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY w) AS first_id FROM win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM seen WHERE first_id < doc_id),
kept AS (
  SELECT d.doc_id, string_agg(w, ' ' ORDER BY d.p) AS kept
  FROM (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM doc) d
  LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.p = g.p
  WHERE g.p IS NULL GROUP BY d.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE["op9_line_dedup"] = r"""
WITH line AS (
  SELECT doc_id, unnest(parts) AS l, unnest(range(1, len(parts) + 1)) AS p
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, trim(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM line),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE keeper IS NOT NULL AND doc_id <> keeper)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY p)
              FILTER (WHERE keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""

ORACLE["op11_spelling"] = r"""
WITH RECURSIVE run AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL),
keyed AS (
  SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS digits FROM run),
-- CRC-32 bit by bit, from the lowest bit of each byte.
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(
    list_prepend(4294967295::UBIGINT, flatten(list_transform(range(0, len(digits) // 2),
      lambda i: list_transform(range(0, 8), lambda b: ((('0x' || substr(digits, 2 * i + 1, 2))::UBIGINT >> b) & 1))))),
    lambda crc, bit: CASE WHEN xor(crc & 1, bit) = 1 THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END
  )) AS h
  FROM keyed),
word AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % 199 = 0
      THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
      ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (
  SELECT a.word AS word, b.word AS other, b.n AS n_other
  FROM less AS a JOIN less AS b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM less AS a JOIN word AS b ON a.d = b.word
  UNION
  SELECT b.word, a.word, a.n FROM less AS a JOIN word AS b ON a.d = b.word),
best AS (
  SELECT word, count(*) AS n_near, min_by(other, (-n_other, other)) AS other, max(n_other) AS n_other
  FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN n_other >= 5 * n THEN other END AS form,
         CASE WHEN n_other >= 5 * n THEN n_other END::BIGINT AS form_n
  FROM word LEFT JOIN best USING (word)),
path AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT path.word, formed.word, formed.form FROM path JOIN formed ON formed.word = path.next)
SELECT formed.word, formed.form, path.root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN path ON path.word = formed.word AND path.next IS NULL
"""

ORACLE["op12_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM piece),
phrase AS (
  SELECT lang, size, array_to_string(list_slice(words, s, s + size - 1), ' ') AS phrase
  FROM (
    SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS s
    FROM listed, (SELECT unnest([1, 2, 3]) AS size) WHERE len(words) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM phrase GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidate AS (
  SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w
  FROM f WHERE size > 1 AND n >= 10),
subsumed AS (
  SELECT DISTINCT s.lang, s.phrase
  FROM candidate AS s JOIN (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS part FROM candidate WHERE size = 3
    UNION ALL
    SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidate WHERE size = 3) AS longer
  ON longer.lang = s.lang AND longer.part = s.phrase AND 100 * longer.a >= 50 * s.a),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate)
  ANTI JOIN subsumed USING (lang, phrase)),
scored AS (
  SELECT cut.lang, cut.phrase, a, k, left_part.n AS l, right_part.n AS r,
         ((1000000::HUGEINT * a * a) // (left_part.n::HUGEINT * right_part.n))::BIGINT AS score
  FROM cut
  JOIN f AS left_part ON left_part.lang = cut.lang AND left_part.phrase = cut.first
  JOIN f AS right_part ON right_part.lang = cut.lang AND right_part.phrase = cut.rest),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, total.n, score
FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
JOIN total USING (lang) WHERE rank <= 2000
"""
