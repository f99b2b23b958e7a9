"""SQL with the same rows as the queries, for those that SQL can express at this size."""

from tallygrove.llm.license_scan import CONTAINMENT, NOTICES

LICENSE_VALUES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in sorted(NOTICES.items()))

OP3 = f"""
WITH template_words AS (
    SELECT license_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words
    FROM (VALUES {LICENSE_VALUES}) AS v(license_id, text)
), template_shingles AS (
    SELECT DISTINCT license_id, array_to_string(words[i:i + 4], ' ') AS shingle
    FROM (SELECT license_id, words, unnest(range(1, len(words) - 3)) AS i FROM template_words)
), templates AS (
    SELECT license_id, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS size
    FROM template_shingles GROUP BY license_id
), doc_words AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents
), doc_shingles AS (
    SELECT doc_id, i - 1 AS place, array_to_string(words[i:i + 4], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM doc_words)
), hits AS (
    SELECT doc_id, license_id, size, n, place - place % size AS spot, shingle
    FROM doc_shingles JOIN template_shingles USING (shingle) JOIN templates USING (license_id)
), in_windows AS (
    SELECT doc_id, license_id, n, spot, shingle FROM hits
    UNION ALL
    SELECT doc_id, license_id, n, spot - size, shingle FROM hits WHERE spot >= size
), shares AS (
    SELECT doc_id, license_id, spot, count(DISTINCT shingle) / n AS share
    FROM in_windows GROUP BY doc_id, license_id, n, spot
    HAVING count(DISTINCT shingle) / n >= {CONTAINMENT}
)
SELECT doc_id, license_id, max(share) AS containment,
       CAST(first(spot ORDER BY share DESC, spot) AS BIGINT) AS first_word, count(*) AS windows
FROM shares GROUP BY doc_id, license_id
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""
WITH texts AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM texts
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
    FROM lines
), repeated AS (
    SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT *, key IN (SELECT key FROM repeated) AS gone FROM keyed)
GROUP BY doc_id
"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7 = f"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM benchmark
), item_sizes AS (
    SELECT item_id, words, least(10, len(words)) AS size FROM item_words WHERE len(words) > 0
), item_windows AS (
    SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS shingle
    FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM item_sizes)
), sizes AS (
    SELECT DISTINCT size FROM item_sizes
), doc_windows AS (
    SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS shingle
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM doc_words, sizes)
), hits AS (
    SELECT doc_id, size, i, item_id FROM doc_windows JOIN item_windows USING (size, shingle)
), hit_words AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

CRC32 = """
xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)::BIGINT[]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))
"""

OP11 = f"""
WITH turns AS (
    SELECT conv_id, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS digest, length(text) AS n,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS place
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), wanted AS (
    SELECT conv_id, {CRC32} % 6 AS taken FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT w.conv_id, t.place, t.digest, t.n FROM wanted w JOIN turns t ON t.conv_id = w.conv_id - w.conv_id % 100 WHERE t.place <= w.taken
    UNION ALL
    SELECT w.conv_id, t.place, t.digest, t.n FROM wanted w JOIN turns t ON t.conv_id = w.conv_id WHERE t.place > w.taken
), prefixes AS (
    SELECT conv_id, n, row_number() OVER path AS depth, string_agg(digest, '') OVER path AS key,
           count(*) OVER (PARTITION BY conv_id) AS n_turns
    FROM rebuilt WINDOW path AS (PARTITION BY conv_id ORDER BY place)
    UNION ALL
    SELECT conv_id, 0, 0, '', (SELECT count(*) FROM rebuilt r WHERE r.conv_id = w.conv_id) FROM wanted w
), nodes AS (
    SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n_turns = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY key, depth
), counted AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children
    FROM nodes n LEFT JOIN (SELECT left(key, length(key) - 64) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL) c USING (key)
), sums AS (
    SELECT left(key, 64 * level) AS key, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(depth + 1)) AS level FROM counted) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN sums s USING (key) LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, length(n.key) - 64)
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0
), counts AS (
    SELECT doc, doc_id, n, term, count(*) AS tf
    FROM (SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, totals GROUP BY term, n_docs
), item_terms AS (
    SELECT DISTINCT item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
), scores AS (
    SELECT item_id, doc, doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM item_terms JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY ALL
), ranked AS (
    SELECT item_id, doc_id, score,
           CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES = {"op3_license_scan": OP3, "op5_line_dedup": OP5, "op7_decontamination": OP7, "op11_prefix_trie": OP11, "op13_lexical_search": OP13}
