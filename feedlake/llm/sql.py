"""DuckDB texts of the queries that SQL can express."""

#: With the template of chat.py: 12 + 1 + 11 characters a turn besides role and text, controls escaped by one backslash.
CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), plain AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM turns
), formatted AS (
    SELECT *, regexp_replace(regexp_replace(t,
        '(<)(\\*(?:\|endoftext\|>|\|im_start\|>|\|im_end\|>|<SYS>>|</SYS>>|/s>|s>))', '\1\\\2', 'g'),
        '(\[)(\\*(?:/INST\]|INST\]))', '\1\\\2', 'g') AS e FROM plain
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(e) + 24)::BIGINT AS formatted_chars
FROM formatted GROUP BY conv_id
"""

WARC = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), last AS (SELECT hex, max(page_id) AS last FROM p GROUP BY hex)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (('0b' || substr(unhex(hex)::BIT::VARCHAR, 1 + 5 * k::INT, 5))::INT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM p JOIN last USING (hex)
"""

SEARCH = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
     c AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS total FROM d WHERE len(words) > 0),
     i AS (SELECT q, item_id, unnest(list_distinct(words)) AS term FROM
             (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark)),
     w AS (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d),
     p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM i) GROUP BY ALL),
     f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
     s AS (SELECT q, item_id, r, doc_id, sum(
             floor(1000 * ln((2.0 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
           FROM i JOIN f USING (term) JOIN p USING (term) CROSS JOIN c GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM
  (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM s WHERE score > 0)
WHERE rank <= 50
"""
