"""DuckDB SQL for the corpus queries that SQL can express, written on its own."""

from ledgerloom.llm.quality import STOP_WORDS

LLM_ORACLE: dict[str, str] = {}

LLM_ORACLE["op2_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY normal) AS group_size,
       row_number() OVER best = 1 AS kept,
       text_sha256
FROM t
WINDOW best AS (PARTITION BY normal ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

LLM_ORACLE["op3_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last,
         length(replace(role, '\', '\\')) + 1
         + length(replace(text, '\', '\\'))
         + (length(text) - length(replace(text, '<s>', ''))) // 3
         + (length(text) - length(replace(text, '</s>', ''))) // 4
         + (length(text) - length(replace(text, '[INST]', ''))) // 6
         + (length(text) - length(replace(text, '[/INST]', ''))) // 7
         + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS size
  FROM c),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM m)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR turn = last)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

LLM_ORACLE["op1_topk_search"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

LLM_ORACLE["op11_quality_rules"] = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, unnest(list_zip(w, w[2:], w[3:], range(1, len(w) + 1))) AS z FROM t),
g AS (
  SELECT doc_id, z[4] AS place, count(*) OVER (PARTITION BY doc_id, z[1], z[2], z[3]) AS found
  FROM p WHERE z[3] IS NOT NULL),
c AS (
  SELECT doc_id, count(DISTINCT place) AS n
  FROM (SELECT doc_id, unnest([place, place + 1, place + 2]) AS place FROM g WHERE found > 1) GROUP BY doc_id),
s AS (SELECT list_concat(list_concat(words, list_transform(words, lambda x: upper(x))),
                         list_transform(words, lambda x: upper(x[1]) || x[2:])) AS stop FROM (SELECT [{_STOP}] AS words)),
m AS (
  SELECT t.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines,
         length(regexp_replace(text, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS capitals,
         len(list_filter(w, lambda x: list_contains(stop, x))) AS stops,
         coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS all_chars,
         coalesce(list_sum(list_transform(list_distinct(l), lambda x: length(x))), 0)::BIGINT AS once_chars,
         len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•‣◦]'))) AS bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS ellipses
  FROM t LEFT JOIN c USING (doc_id), s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words BETWEEN 50 AND 10000000 AND n_repeat_words <= 0.5 * n_words
       AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND n_symbols <= 0.1 * n_words
       AND capitals <= 0.3 * letters AND letters >= 0.6 * word_chars AND stops >= 0.05 * n_words
       AND n_dup_lines <= 0.5 * n_lines AND all_chars - once_chars <= 0.2 * all_chars
       AND bullets <= 0.9 * n_lines AND ellipses <= 0.3 * n_lines AS kept
FROM m
"""

LLM_ORACLE["op13_conversation_trie"] = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n::BIGINT)) AS crc),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS at_turn
  FROM conversations WHERE conv_id IS NOT NULL),
talk AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY at_turn) AS turns,
         xor(4294967295::BIGINT, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
             lambda s, b: xor(crc[(xor(s, b) & 255) + 1], s >> 8), 4294967295::BIGINT)) % 6 AS h
  FROM own, tab GROUP BY conv_id, crc),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM talk c LEFT JOIN talk b ON b.conv_id = c.conv_id - c.conv_id % 100),
pre AS (
  SELECT conv_id, d AS depth, turns[1:d] AS node, len(turns) = d AS ends
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
node AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM pre GROUP BY node, depth),
kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM node n LEFT JOIN kids k ON k.node = n.node),
below AS (
  SELECT node[1:d] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum((n_convs - 1) * coalesce(length(node[depth].t), 0)) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_node) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_node n JOIN below b ON b.node = n.node
LEFT JOIN node p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
"""

LLM_ORACLE["op12_lexical_search"] = r"""
WITH b AS (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b)
  GROUP BY item_id, term),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
g AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
p AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, g GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id,
         sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total)))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
