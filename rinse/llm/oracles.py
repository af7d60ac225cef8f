"""SQL with the rows of the queries, where SQL can say what an operator does."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URL_FILTER = rf"""
WITH rules(rule_host, rule_path, says) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
           ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), parts AS (
    SELECT page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), fitting AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(says, length(rule_host || rule_path)) AS says
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM parts LEFT JOIN fitting USING (page_id)
"""

_BITS = "".join(f"{digit:04b}" for digit in range(16))
_FIVE = " + ".join(f"{16 >> bit} * substr(bits, 5 * i + {bit + 1}, 1)::int" for bit in range(5))

WARC = f"""
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS digest
    FROM pages
), spelled AS (
    SELECT *, array_to_string(list_transform(range(40), lambda i: substr('{_BITS}',
        4 * (strpos('0123456789abcdef', substr(digest, i + 1, 1)) - 1)::int + 1, 4)), '') AS bits
    FROM hashed
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM spelled
)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32),
        lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({_FIVE} + 1)::int, 1)), '') AS payload_digest,
    CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS MATERIALIZED (
    SELECT DISTINCT item_id, least(13, len(ws)) AS n,
        unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i:i + 12], ' '))) AS passage
    FROM items WHERE len(ws) > 0
), runs AS (
    SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS pos, ws FROM docs, (SELECT DISTINCT n FROM windows)
), hits AS MATERIALIZED (
    SELECT doc_id, pos, r.n, item_id
    FROM (SELECT doc_id, n, pos, array_to_string(ws[pos:pos + n - 1], ' ') AS passage FROM runs) r
    JOIN windows w ON w.n = r.n AND w.passage = r.passage
), covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
        SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM (SELECT DISTINCT doc_id, pos, n FROM hits)
    ) GROUP BY doc_id
), listed AS (
    SELECT doc_id, list_sort(list(DISTINCT item_id::varchar)) AS items FROM hits GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws
        ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle
    FROM docs WHERE len(ws) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
    SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
    WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)
), reached(a, b) AS (
    SELECT doc_id, doc_id FROM docs
    UNION SELECT r.a, l.b FROM reached r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b
), roots AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots LEFT JOIN sizes USING (doc_id)
"""

PREFERENCES = """
WITH turns AS (
    SELECT conv_id // 2 * 2 AS pair_id, conv_id % 2 = 0 AS chosen, turn, role, text,
        '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS rendered
    FROM conversations
), ends AS (
    SELECT pair_id, min(turn) FILTER (differ) AS ending FROM (
        SELECT pair_id, turn, count(*) < 2 OR min(rendered) <> max(rendered) AS differ FROM turns GROUP BY pair_id, turn
    ) GROUP BY pair_id
)
SELECT pair_id, CASE WHEN ending IS NULL OR turn < ending THEN 'prompt' WHEN chosen THEN 'chosen' ELSE 'rejected' END AS part,
    turn, rendered, coalesce(role = 'assistant' AND turn >= ending, false) AS trained
FROM turns JOIN ends USING (pair_id)
WHERE chosen OR ending IS NOT NULL AND turn >= ending
"""

PREFERENCE_PAIRS = """
WITH answers AS (
    SELECT conv_id, max(turn) AS ending, max_by(text, turn) AS answer
    FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), others AS (
    SELECT conv_id, ending, answer, coalesce(lag(answer) OVER (ORDER BY conv_id), max_by(answer, conv_id) OVER ()) AS other
    FROM answers
), turns AS (
    SELECT conv_id AS pair_id, turn, coalesce(turn >= ending AND answer <> other, false) AS completed,
        completed AND role = 'assistant' AS trained,
        '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS chosen,
        CASE WHEN turn = ending THEN '<|assistant|>' || chr(10) || other || chr(10) ELSE chosen END AS rejected
    FROM conversations LEFT JOIN others USING (conv_id)
), placed AS (
    SELECT *, sum(length(chosen)) OVER place AS chosen_end, sum(length(rejected)) OVER place AS rejected_end
    FROM turns WINDOW place AS (PARTITION BY pair_id, completed ORDER BY turn)
)
SELECT pair_id,
    coalesce(string_agg(chosen, '' ORDER BY turn) FILTER (NOT completed), '') AS prompt,
    coalesce(string_agg(chosen, '' ORDER BY turn) FILTER (completed), '') AS chosen,
    coalesce(list([chosen_end - length(chosen), chosen_end] ORDER BY turn) FILTER (trained), []) AS chosen_spans,
    coalesce(string_agg(rejected, '' ORDER BY turn) FILTER (completed), '') AS rejected,
    coalesce(list([rejected_end - length(rejected), rejected_end] ORDER BY turn) FILTER (trained), []) AS rejected_spans
FROM placed GROUP BY pair_id
"""


_LEAF = "[^.,;:!?]{0,10}[.,;:!?]|[^.,;:!?]{11,47}?(?:[.,;:!?]|[dehnst] )|[^.,;:!?]{1,48}"


def _tree(text: str) -> str:
    leaves = f"regexp_extract_all(line, '(?s){_LEAF}')"
    return f"list_transform(string_split({text}, chr(10)), lambda line: list_transform({leaves}, lambda x: sha256(x)))"


def _root(tree: str) -> str:
    paragraphs = f"list_transform({tree}, lambda x: sha256(array_to_string(x, ',')))"
    joined = f"regexp_replace(array_to_string({paragraphs}, ','), '([0-9a-f]{{63}}[0-3]),', '\\1;', 'g')"
    return f"sha256(array_to_string(list_transform(string_split({joined}, ';'), lambda x: sha256(x)), ','))"


def _leaves(tree: str) -> str:
    return f"list_transform(flatten({tree}), lambda x: x[1:8])"


def _in_order(leaves: str) -> str:
    """Distinct entries in the order in which they first occur."""
    return f"list_filter({leaves}, lambda x, i: list_position({leaves}, x) = i)"


MERKLE = f"""
WITH ordered AS (
    SELECT doc_id, coalesce(text, '') AS text,
        coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS following
    FROM documents
    WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), edits AS (
    SELECT *, left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) AS edited FROM ordered
), grown AS (
    SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_tree("text")} AS tree,
        {_tree("edited")} AS edited_tree, {_tree("following")} AS next_tree
    FROM edits
), hashed AS (
    SELECT doc_id, n_chars, edited_sha256, {_root("tree")} AS root, {_root("edited_tree")} AS edited_root,
        {_root("next_tree")} AS next_root, {_leaves("tree")} AS every, {_leaves("edited_tree")} AS edited_every,
        {_leaves("next_tree")} AS next_every
    FROM grown
), trees AS (
    SELECT *, {_in_order("every")} AS leaves, {_in_order("edited_every")} AS edited_leaves,
        list_distinct(next_every) AS next_leaves
    FROM hashed
)
SELECT doc_id, n_chars, edited_sha256, root || ':' || array_to_string(leaves, ',') AS fingerprint,
    edited_root || ':' || array_to_string(edited_leaves, ',') AS edited_fingerprint,
    CASE WHEN root = edited_root THEN 1.0::double
        ELSE 2.0::double * len(list_intersect(leaves, edited_leaves)) / (len(leaves) + len(edited_leaves) + 2) END AS near_edited,
    CASE WHEN root = next_root THEN 1.0::double
        ELSE 2.0::double * len(list_intersect(leaves, next_leaves)) / (len(leaves) + len(next_leaves) + 2) END AS near_next
FROM trees
"""

MERKLE_EDITS = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS old, unnest(string_split(replace(text, 'en ', 'EN '), chr(10))) AS text,
        unnest(range(length(text) - length(replace(text, chr(10), '')) + 1)) AS paragraph
    FROM documents WHERE text IS NOT NULL
)
SELECT doc_id, paragraph::INTEGER AS paragraph, text FROM lines
WHERE (doc_id, text) NOT IN (SELECT (doc_id, old) FROM lines)
"""

PREFIX_TRIE = r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS j,
         coalesce(role, '') AS r, coalesce(text, '') AS t
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, c - c % 5 AS base, count(*) AS own FROM turns GROUP BY c),
crcs AS (
  SELECT c, base, own, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM sizes),
rebuilt AS (
  SELECT s.c, t.j AS d, t.r, t.t FROM crcs s JOIN turns t ON t.c = s.base AND t.j <= s.h
  UNION ALL
  SELECT s.c, least(s.h, coalesce(b.own, 0)) + t.j - s.h, t.r, t.t
  FROM crcs s JOIN turns t ON t.c = s.c AND t.j > s.h LEFT JOIN sizes b ON b.c = s.base),
paths AS (
  SELECT c, d, octet_length(encode(t)) AS bytes,
         list(row(r, t)) OVER (PARTITION BY c ORDER BY d) AS seq FROM rebuilt
  UNION ALL SELECT c, 0, 0, [] FROM sizes),
lengths AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
nodes AS (
  SELECT p.d, p.seq, min(p.c) AS m, count(*) AS n_convs, any_value(p.bytes) AS bytes,
         sha256(coalesce(string_agg(CASE WHEN l.n = p.d THEN p.c::VARCHAR END, ',' ORDER BY p.c), '')) AS ends_sha256
  FROM paths p JOIN lengths l ON l.c = p.c GROUP BY p.d, p.seq),
children AS (SELECT d - 1 AS d, list_slice(seq, 1, d - 1) AS seq, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
above AS (
  SELECT list_slice(n.seq, 1, k) AS seq, k AS d, c.n IS NULL AS leaf, (n.n_convs - 1) * n.bytes AS saved
  FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.seq = n.seq, unnest(range(n.d + 1)) AS u(k)),
sums AS (SELECT d, seq, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY d, seq)
SELECT n.m AS conv_id, n.d AS depth, p.m AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.seq = n.seq
LEFT JOIN children c ON c.d = n.d AND c.seq = n.seq
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.seq = list_slice(n.seq, 1, n.d - 1)
"""

# the pages at hand keep their article in one element and escape few characters
MAIN_TEXT = r"""
WITH articles AS (
    SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1),
        '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS marked
    FROM pages
), decoded AS (
    SELECT page_id, url, regexp_replace(replace(replace(replace(replace(
        marked, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS decoded
    FROM articles
), spaced AS (
    SELECT page_id, url, trim(regexp_replace(decoded, '\s+', ' ', 'g')) AS text FROM decoded
)
SELECT page_id, url, text, length(text) AS n_chars FROM spaced
"""
