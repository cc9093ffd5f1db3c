"""SQL of the queries that SQL can express, written from the definitions: every window, every pair, every payload."""

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _shingles(identity: str, source: str, name: str) -> str:
    """``name``: (identity, pos, s) of all runs of five words; a shorter text has one run of all its words."""
    return f"""{name}_w AS (SELECT {identity}, {_WORDS} AS w FROM {source}),
{name} AS (SELECT {identity}, unnest(range(1, greatest(len(w) - 3, 2))) AS pos, w FROM {name}_w WHERE len(w) > 0),
{name}_s AS (SELECT {identity}, pos, array_to_string(w[pos:pos + 4], ' ') AS s FROM {name})"""


WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)),
    'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

# every window of an item's size over every document that shares a shingle with it
LEAKS = f"""WITH {_shingles('doc_id', 'documents', 'd')}, {_shingles('item_id', 'benchmark', 'b')},
item AS (SELECT item_id, s, count(*) AS n FROM b_s GROUP BY ALL),
size AS (SELECT item_id, count(*) AS m FROM b_s GROUP BY ALL),
shared AS (SELECT DISTINCT doc_id, item_id FROM d_s JOIN item USING (s)),
hit AS (SELECT doc_id, item_id, pos, s FROM shared JOIN d_s USING (doc_id) JOIN item USING (item_id, s)),
wins AS (SELECT DISTINCT doc_id, item_id, m, unnest(range(greatest(pos - m + 1, 1), pos + 1)) AS low FROM hit JOIN size USING (item_id)),
held AS (SELECT wins.doc_id, wins.item_id, low, hit.s, count(*) AS k FROM wins
    JOIN hit ON hit.doc_id = wins.doc_id AND hit.item_id = wins.item_id AND pos >= low AND pos < low + m GROUP BY ALL),
common AS (SELECT doc_id, item_id, low, sum(least(k, n)) AS c FROM held JOIN item USING (item_id, s) GROUP BY ALL),
total AS (SELECT doc_id, count(*) AS t FROM d_s GROUP BY ALL),
scored AS (SELECT doc_id, item_id, CAST(c AS DOUBLE) / (least(m, t - low + 1) + m - c) AS similarity, low - 1 AS first_word,
    least(low - 1 + m, t) + 4 AS end_word FROM common JOIN size USING (item_id) JOIN total USING (doc_id))
SELECT * FROM scored WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first_word) = 1"""

# documents with equal shingle sets are one text; texts meet if they share a shingle
LINKS = f"""WITH RECURSIVE {_shingles('doc_id', 'documents', 'd')},
owned AS (SELECT doc_id, list_sort(list(DISTINCT s)) AS ss FROM d_s GROUP BY doc_id),
txt AS (SELECT ss, min(doc_id) AS id, count(*) AS copies, len(ss) AS size FROM owned GROUP BY ss),
flat AS (SELECT id, size, unnest(ss) AS s FROM txt),
pair AS (SELECT a.id AS u, b.id AS v FROM flat a JOIN flat b ON a.s = b.s AND a.id <> b.id
    GROUP BY a.id, b.id HAVING count(*) >= 0.8 * (any_value(a.size) + any_value(b.size) - count(*)) - 1e-9),
reach AS (SELECT id AS u, id AS v FROM txt UNION SELECT reach.u, pair.v FROM reach JOIN pair ON reach.v = pair.u),
root AS (SELECT u AS id, min(v) AS class_id FROM reach GROUP BY u),
linked AS (SELECT u AS id, count(*) AS texts, sum(copies) AS docs FROM pair JOIN txt ON txt.id = pair.v GROUP BY u)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(copies, 1) - 1 + coalesce(docs, 0) AS BIGINT) AS n_links,
    CAST(coalesce(copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(texts, 0) AS BIGINT) AS n_linked_texts
FROM documents d LEFT JOIN owned USING (doc_id) LEFT JOIN txt USING (ss) LEFT JOIN root USING (id) LEFT JOIN linked USING (id)"""

# sentences, their shortest runs of 30 words from either end, and what repeated runs cover
REPEATS = r"""WITH tok AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS k
    FROM (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS t FROM documents)),
w AS (SELECT *, regexp_extract(tok, '^\S+') AS word, lag(tok) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM tok),
numbered AS (SELECT *, CAST(sum(CASE WHEN k = 1 OR contains(prev, chr(10)) OR regexp_matches(prev, '[.!?…。！？]\s*$')
    OR (regexp_matches(word, '^\p{Lu}') AND NOT regexp_matches(prev, '^\p{Lu}')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS s FROM w),
seg AS (SELECT doc_id, s, string_agg(tok, '' ORDER BY k) AS raw, string_agg(lower(word), ' ' ORDER BY k) AS norm, min(k) - 1 AS b, max(k) AS e
    FROM numbered GROUP BY doc_id, s),
near AS (SELECT a.doc_id, a.s AS i, z.s AS j FROM seg a JOIN seg z ON a.doc_id = z.doc_id AND z.s BETWEEN a.s AND a.s + 29 AND z.e - a.b >= 30),
run AS (SELECT doc_id, i, min(j) AS j FROM near GROUP BY doc_id, i UNION SELECT doc_id, max(i), j FROM near GROUP BY doc_id, j),
said AS (SELECT run.doc_id, i, j, string_agg(norm, ' ' ORDER BY s) AS words FROM run
    JOIN seg ON seg.doc_id = run.doc_id AND s BETWEEN i AND j GROUP BY ALL),
ranked AS (SELECT *, min(doc_id) OVER (PARTITION BY words) AS low, min(i) OVER (PARTITION BY words, doc_id) AS own FROM said),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS s FROM ranked WHERE doc_id > low OR i > own),
kept AS (SELECT doc_id, count(*) AS n_sentences, count(gone.s) AS n_removed, string_agg(raw, '' ORDER BY seg.s) FILTER (gone.s IS NULL) AS rest
    FROM seg LEFT JOIN gone USING (doc_id, s) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE regexp_extract(text, '^\s*') || coalesce(rest, '') END AS text,
    coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed FROM documents LEFT JOIN kept USING (doc_id)"""

# the pages of the tables mark their article; blocks are headings, paragraphs and line breaks
PAGES = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(t, '&quot;?', '"', 'g'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'),
    '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp', '&', 'g'), '[\s]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d"""

# as LINKS, with words between blanks and the threshold of 85 of 100
NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 2))) AS pos, w FROM w WHERE len(w) > 0),
owned AS (SELECT doc_id, list_sort(list(DISTINCT array_to_string(w[pos:pos + 4], ' '))) AS ss FROM d GROUP BY doc_id),
txt AS (SELECT ss, min(doc_id) AS id, len(ss) AS size FROM owned GROUP BY ss),
flat AS (SELECT id, size, unnest(ss) AS s FROM txt),
pair AS (SELECT a.id AS u, b.id AS v FROM flat a JOIN flat b ON a.s = b.s AND a.id <> b.id
    GROUP BY a.id, b.id HAVING 100 * count(*) >= 85 * (any_value(a.size) + any_value(b.size) - count(*))),
reach AS (SELECT id AS u, id AS v FROM txt UNION SELECT reach.u, pair.v FROM reach JOIN pair ON reach.v = pair.u),
root AS (SELECT u AS id, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(len(ss), 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
    d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN owned USING (doc_id) LEFT JOIN txt USING (ss) LEFT JOIN root USING (id)"""

# crc32 bit by bit; nodes are the distinct prefixes, subtrees those that begin with one
TRIE = """WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role,
    coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, b: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(a, b)), 4294967295),
    4294967295) % 9 AS h FROM c),
t AS (SELECT h.conv_id, 0 AS own, pos, role, text FROM h JOIN c ON c.conv_id = h.base AND pos <= h
    UNION ALL SELECT conv_id, 1, pos, role, text FROM h JOIN c USING (conv_id) WHERE pos > h),
q AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY own, pos) AS s FROM t GROUP BY conv_id),
s AS (SELECT conv_id, s FROM q UNION ALL SELECT conv_id, [] FROM h WHERE conv_id NOT IN (SELECT conv_id FROM q)),
p AS (SELECT conv_id, s[1:d] AS path, d AS depth, len(s) = d AS last FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
    FILTER (last), '')) AS ends_sha256, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(path[-1].text)) END AS saved
    FROM p GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT a.path, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(b.saved) AS saved_tokens
    FROM f a JOIN f b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.path)
SELECT f.conv_id, f.depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (path) LEFT JOIN n o ON f.depth > 0 AND o.depth = f.depth - 1 AND o.path = f.path[1:f.depth - 1]"""

ORACLE = {"op11_prefix_trie": TRIE, "op12_near_dedup": NEAR, "op10_main_text": PAGES, "op1_substring_dedup": REPEATS, "op2_decontamination": LEAKS, "op3_warc": WARC, "op7_ngram_join": LINKS}
