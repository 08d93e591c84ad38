"""DuckDB SQL for the queries that SQL can express on whole tables."""

#: A-Z to lower case, and nothing else.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHAT = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('### : </turn>') + 1 + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:'))
           + length(text) + len(regexp_extract_all(text, '\\|###|</turn>')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

NEAR_JOIN = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (
    SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, y FROM r JOIN both_ways ON seen = x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

WARC = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM o
"""

DECONTAMINATE = rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
    SELECT item_id, w, least(13, len(w)) AS n
    FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (
    SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS words
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
dw AS (
    SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS words
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, n, k FROM dw JOIN iw USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

EXACT_DEDUP = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

#: crc32 of a decimal in ASCII, bit by bit; fixed values: its polynomial and its initial and last mask.
CRC32 = """xor(4294967295, list_reduce(
    list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, x: list_reduce(range(0, 8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, x)),
    4294967295::BIGINT))"""

PREFIX_TRIE = rf"""
WITH turns AS (
    SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
           len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM turns
), members AS (
    SELECT c, c - c % 20 AS base, {CRC32.format("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
    SELECT m.c, n.place, n.digest, n.words FROM members m JOIN numbered n ON n.c = m.base AND n.place < m.h
    UNION ALL
    SELECT m.c, n.place, n.digest, n.words FROM members m JOIN numbered n ON n.c = m.c AND n.place >= m.h
), prefixes AS (
    SELECT c, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, words FROM rebuilt
    WINDOW w AS (PARTITION BY c ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    UNION ALL
    SELECT c, 0, '', 0 FROM members
), lengths AS (
    SELECT c, max(depth) AS length FROM prefixes GROUP BY c
), nodes AS (
    SELECT path, any_value(depth) AS depth, min(p.c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
           string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (depth = length) AS ends, bool_and(depth = length) AS leaf
    FROM prefixes p JOIN lengths l ON p.c = l.c GROUP BY path
), below AS (
    -- every node passes what it holds to the prefixes of its smallest member
    SELECT p.path, sum(n.leaf::INT) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
    FROM nodes n JOIN prefixes p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.path
), children AS (
    SELECT left(path, (64 * (depth - 1))::BIGINT) AS parent, path FROM nodes WHERE depth > 0
)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(k.n, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.path = n.path
LEFT JOIN children own ON own.path = n.path
LEFT JOIN nodes up ON up.path = own.parent
LEFT JOIN (SELECT parent, count(*) AS n FROM children GROUP BY parent) k ON k.parent = n.path
"""

ORACLES = {
    "op2_chat_format": CHAT,
    "op6_ngram_jaccard_join": NEAR_JOIN,
    "op7_warc": WARC,
    "op9_decontaminate": DECONTAMINATE,
    "op10_exact_dedup": EXACT_DEDUP,
    "op11_prefix_trie": PREFIX_TRIE,
}
