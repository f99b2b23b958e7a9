"""Name to the SQL that gives the same rows on the same tables."""

PATH = "source || '/' || lang || '/' || doc_id || '.txt'"

# The SQL engine's regular expressions have no lookahead: a mark before the last blank of a
# run stands in for it. The mark itself is no piece.
_MARKED = r"regexp_replace({text}, '(\s+)(\s\S)', '\1' || chr(1) || '\2', 'g')"
_PATTERN = (
    r"'(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\r\n\p{L}\p{N}\x01]?\p{L}+|\p{N}{1,3}"
    r"| ?[^\s\p{L}\p{N}\x01]+[\r\n]*\x01?[\r\n]*|\s*\x01?[\r\n]+\x01?[\r\n]*|\s+\x01?'"
)


def piece_list(text):
    found = f"regexp_extract_all({_MARKED.format(text=text)}, {_PATTERN})"
    return f"list_filter({found}, lambda x: x <> chr(1))"


def piece_len(text):
    return f"len({piece_list(text)})::BIGINT"


FILES = f"""files AS (
  SELECT doc_id, {PATH} AS path, text AS content, {piece_len("text")} AS tokens FROM documents
)"""
PATHS = f"files AS (SELECT doc_id, source, lang, {PATH} AS path FROM documents)"
ADDRESS = r"regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"
WEB = f"""web AS (
  SELECT page_id AS seq, {ADDRESS} AS path, {piece_len("html")} AS tokens FROM pages
)"""
CHAT_PATH = "conv_id || '/' || turn || '-' || role || '.txt'"

LATEST_WEB = "files AS (SELECT path, max_by(tokens, seq) AS tokens FROM web GROUP BY path)"


def nodes(source):
    """All nodes (parts, tokens) over `source` (path, tokens), of which paths are unique."""
    return f"""
parts AS (SELECT string_split(path, '/') AS parts, tokens FROM {source}),
inner_nodes AS (
  SELECT DISTINCT parts[1:k] AS parts FROM parts, unnest(range(0, len(parts))) AS u(k)
),
leaves AS (SELECT * FROM parts WHERE parts NOT IN (SELECT parts FROM inner_nodes)),
nodes AS (
  SELECT parts[1:k] AS parts, sum(tokens)::BIGINT AS tokens
  FROM leaves, unnest(range(0, len(parts) + 1)) AS u(k) GROUP BY ALL
)"""


ROLLUP = """
SELECT array_to_string(parts, '/') AS path, coalesce(parts[-1], '') AS name,
  len(parts)::INTEGER AS depth, tokens
FROM nodes"""

LINES = """,
flagged AS (
  SELECT parts, tokens, lead(parts) OVER (PARTITION BY parts[1:len(parts)-1] ORDER BY parts) IS NULL AS is_last
  FROM nodes WHERE len(parts) > 0
),
indents AS (
  SELECT f.parts, string_agg(
    CASE WHEN a.parts[-1] = '' THEN '' WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY k) AS indent
  FROM flagged f, unnest(range(1, len(f.parts))) AS u(k) JOIN flagged a ON a.parts = f.parts[1:k]
  GROUP BY f.parts
)
SELECT array_to_string(f.parts, '/') AS path,
  coalesce(indent, '') || CASE WHEN is_last THEN '└── ' ELSE '├── ' END
  || f.parts[-1] || ' (' || tokens || ' tokens)' AS line
FROM flagged f LEFT JOIN indents i ON f.parts = i.parts WHERE f.parts[-1] <> ''"""

STORED = f"""stored AS (
  SELECT doc_id, path, 1000000 + doc_id AS tokens, 1000 + doc_id % 5 AS mtime, 1::BIGINT AS seq
  FROM files WHERE doc_id % 3 <> 0
), log AS (
  FROM stored UNION ALL
  SELECT doc_id, path, tokens + 1000000, 1001, 2 FROM stored WHERE tokens % 4 = 0
), latest AS (
  SELECT doc_id, path, max_by(tokens, seq) AS tokens, max_by(mtime, seq) AS mtime, max(seq) AS seq
  FROM log GROUP BY ALL
)"""

# The ignore files of the query, one rule a row: directory, its depth, line, re-include,
# directories only, and the regular expression of the path below that directory.
IGNORE = rf"""WITH {PATHS},
rules(base, kind, depth, line, neg, dironly, rx) AS (VALUES
  ('', 1, 0, 2, false, false, '(.*/)?[^/]*7\.txt'),
  ('', 1, 0, 3, true, false, '(.*/)?[^/]*77\.txt'),
  ('', 1, 0, 4, false, true, '(.*/)?fr'),
  ('', 1, 0, 5, false, false, 'src3'),
  ('', 1, 0, 7, false, false, 'src1[^/]/de/.+'),
  ('', 1, 0, 8, false, false, '(.*/)?es/[^/]*5\.txt'),
  ('src5', 1, 1, 1, false, false, '(.*/)?[^/]*\.txt'),
  ('src5', 1, 1, 2, true, true, '(.*/)?en'),
  ('src5', 1, 1, 3, true, false, 'en/[^/]*2\.txt'),
  ('src2', 1, 1, 1, false, false, 'en/[^/]*'),
  ('src2', 1, 1, 2, true, false, 'en/[^/]*[1-4]\.txt'),
  ('src4/en', 1, 2, 1, false, false, '[^/]*0\.txt'),
  ('src4/en', 1, 2, 2, true, false, '(.*/)?[^/]*00\.txt'),
  ('src6', 2, 1, 1, true, false, '(.*/)?[^/]*7\.txt'),
  ('src6', 2, 1, 2, false, false, '(.*/)?[^/]*8\.txt')
),
prefixes AS (
  SELECT path, array_to_string(string_split(path, '/')[1:k], '/') AS node, k < 3 AS is_dir
  FROM files, unnest([1, 2, 3]) AS u(k)
),
verdicts AS (
  SELECT path, node, max_by(neg, kind * 10000 + depth * 100 + line) AS kept
  FROM prefixes JOIN rules ON (base = '' OR starts_with(node, base || '/'))
    AND (is_dir OR NOT dironly)
    AND regexp_full_match(CASE WHEN base = '' THEN node ELSE node[len(base) + 2:] END, rx)
  GROUP BY path, node
)
SELECT path FROM files WHERE path NOT IN (SELECT path FROM verdicts WHERE NOT kept)"""

CONTEXTS = rf"""WITH {PATHS}
SELECT 'default' AS context, path FROM files
UNION ALL SELECT 'english', path FROM files
  WHERE lang = 'en' AND NOT regexp_full_match(path, 'src1./.*')
UNION ALL SELECT 'even', path FROM files
  WHERE doc_id % 2 = 0 AND NOT regexp_full_match(path, '.*[02]\.txt') AND source <> 'src1'"""

GLOB_INCLUDE = rf"""WITH {PATHS}
SELECT path FROM files WHERE (lang = 'en' AND doc_id % 10 = 1)
  OR regexp_full_match(path, 'src1./fr/.+')
  OR regexp_full_match(path, '(.*/)?[^d]./.*7\.txt')
  OR regexp_full_match(path, 'src[45]/de/.[0-4].*')"""

GLOB_IGNORE = f"""WITH {PATHS}
SELECT path FROM files WHERE lang <> 'fr' AND doc_id % 10 <> 9 AND source NOT IN ('src2', 'src3')"""

TOP = "SELECT path, tokens FROM files WHERE tokens > 0 ORDER BY tokens DESC, path LIMIT"

REPORT = f"""WITH {FILES},
shown AS ({TOP} 25),
sums AS (SELECT coalesce(sum(tokens), 0)::BIGINT AS total, coalesce(max(strlen(path)), 0) AS width FROM files),
rows AS (SELECT row_number() OVER (ORDER BY tokens DESC, path) AS n, path, tokens FROM shown),
lines AS (
  SELECT 0 AS line_no, '' AS line
  UNION ALL SELECT 1, 'Token Statistics:'
  UNION ALL SELECT 2, repeat('─', width + 20) FROM sums
  UNION ALL SELECT 2 + n, path || repeat(' ', width - strlen(path)) || ' │ '
    || lpad(tokens::VARCHAR, greatest(8, len(tokens::VARCHAR))::INTEGER, ' ') || ' tokens' FROM rows, sums
  UNION ALL SELECT 3 + (SELECT count(*) FROM rows), repeat('─', width + 20) FROM sums
  UNION ALL SELECT 4 + (SELECT count(*) FROM rows), 'Total tokens: ' || total FROM sums
)
SELECT line_no::INTEGER AS line_no, line FROM lines"""

# A byte string is its hex text here; a merge step joins the leftmost pair of lowest rank.
BPE = f"""WITH RECURSIVE words AS (
  SELECT DISTINCT hex(encode(replace(p, chr(1), ''))) AS h
  FROM (SELECT unnest({piece_list("text")}) AS p FROM benchmark)
),
vocab AS (
  SELECT lpad(to_hex(b), 2, '0') AS token, b::BIGINT AS rank FROM range(256) AS r(b)
  UNION ALL
  SELECT DISTINCT h[2 * i + 1 : 2 * (i + n)],
    CASE n WHEN 2 THEN 256 ELSE 65792 END + ('0x' || h[2 * i + 1 : 2 * (i + n)])::BIGINT
  FROM words, unnest([2, 3]) AS s(n), unnest(range(0, len(h) // 2 - n + 1)) AS u(i)
),
found AS (
  SELECT doc_id, hex(encode(replace(p, chr(1), ''))) AS h
  FROM (SELECT doc_id, unnest({piece_list("text")}) AS p FROM documents)
),
steps AS (
  SELECT h, list_transform(range(0, len(h) // 2), lambda i: h[2 * i + 1 : 2 * i + 2]) AS parts
  FROM (SELECT DISTINCT h FROM found) WHERE h NOT IN (SELECT token FROM vocab)
  UNION ALL
  SELECT h, list_concat(list_concat(parts[1:spot - 1], [parts[spot] || parts[spot + 1]]), parts[spot + 2:])
  FROM (
    SELECT h, any_value(parts) AS parts, arg_min(i, rank * 1000000 + i) AS spot
    FROM steps, unnest(range(1, len(parts))) AS u(i) JOIN vocab ON token = parts[i] || parts[i + 1]
    GROUP BY h
  )
),
each AS (
  SELECT h, min(len(parts)) AS n FROM steps GROUP BY h
)
SELECT {PATH} AS path, tokens FROM documents JOIN (
  SELECT doc_id, sum(coalesce(n, 1))::BIGINT AS tokens FROM found LEFT JOIN each USING (h) GROUP BY doc_id
) USING (doc_id)"""

SPECIAL = " + ".join([
    piece_len("text || '  '"), "1", piece_len("' ' || text"), "1",
])

BROKEN = f"""
SELECT {PATH} AS path,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 0 ELSE len(text) END::INTEGER AS n_chars,
  CASE WHEN doc_id % 7 = 0 THEN 'Invalid UTF-8' WHEN doc_id % 11 = 0 THEN 'Failed to read file' END AS error
FROM documents"""


def _scanned(where):
    folder = "CASE WHEN lang = 'de' THEN '.de' ELSE lang END"
    return f"""
SELECT source || '/' || {folder} || '/' || doc_id || '.txt' AS path,
  CASE WHEN doc_id % 7 = 0 THEN strlen(text) + 2 WHEN doc_id % 11 = 0 THEN 0 ELSE strlen(text) END AS length,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 0 ELSE {piece_len("text")} END AS tokens,
  CASE WHEN doc_id % 7 = 0 THEN 'Invalid UTF-8' END AS error
FROM documents WHERE {where}"""


ORACLES = {
    "piece_count": f"SELECT {PATH} AS path, {piece_len('text')} AS pieces FROM documents",
    "piece_count_web": f"WITH {WEB} SELECT seq, path, tokens AS pieces FROM web",
    "piece_count_chat": f"SELECT {CHAT_PATH} AS path, {piece_len('text')} AS pieces FROM conversations",
    "special_token_count": f"SELECT {PATH} AS path, {SPECIAL} AS pieces FROM documents",
    "blank_rows": f"""SELECT {PATH} AS path,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE len(text) END::INTEGER AS n_chars,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE {piece_len("text")} END AS tokens FROM documents""",
    "bpe_count": BPE,
    "bpe_count_joined": BPE,
    "budget_low": f"WITH {FILES} SELECT path, tokens FROM files WHERE tokens >= 600",
    "budget_high": f"WITH {FILES} SELECT path, tokens FROM files WHERE tokens BETWEEN 1 AND 300",
    "budget_both": f"WITH {FILES} SELECT path, tokens FROM files WHERE tokens BETWEEN 200 AND 1000",
    "glob_include": GLOB_INCLUDE,
    "glob_ignore": GLOB_IGNORE,
    "rule_precedence": f"""WITH {PATHS}
SELECT path FROM files WHERE lang = 'de' AND NOT regexp_full_match(path, 'src1./.*')""",
    "context_rules": CONTEXTS,
    "ignore_rules": IGNORE,
    "ignore_chains": f"""SELECT {PATH} AS path FROM documents d
WHERE doc_id % 10 = 0 OR NOT EXISTS (
  SELECT 1 FROM documents r WHERE r.source = d.source AND (
    (r.doc_id % 20 = 5 AND ends_with(d.doc_id::VARCHAR, right(r.doc_id::VARCHAR, 3)))
    OR (r.doc_id % 20 = 10 AND starts_with(d.doc_id || '.txt', left(r.doc_id::VARCHAR, 3)))
    OR (r.doc_id % 20 = 15 AND r.doc_id = d.doc_id)))""",
    "ignored_directories_not_listed": """WITH places AS (
  SELECT DISTINCT source, CASE WHEN lang = 'de' THEN '.de' ELSE lang END AS folder FROM documents WHERE source <> 'src4'
)
SELECT DISTINCT source AS path FROM places
UNION ALL SELECT source || '/' || folder FROM places
WHERE source <> 'src2' AND (source, folder) NOT IN (('src1', 'fr'), ('src3', 'en'))""",
    "token_top_n": f"WITH {FILES} {TOP} 10",
    "token_order": f"WITH {FILES} SELECT path, tokens FROM files WHERE tokens > 0 ORDER BY tokens DESC, path",
    "token_total": f"WITH {FILES} SELECT sum(tokens)::BIGINT AS total FROM files",
    "widest_path": f"WITH {WEB} SELECT max(strlen(path))::BIGINT AS width FROM web",
    "token_report_plain": REPORT,
    "token_report_json": f"""WITH {FILES}, shown AS ({TOP} 25)
SELECT to_json({{
  'results': (SELECT list({{'path': path, 'tokens': tokens}} ORDER BY tokens DESC, path) FROM shown),
  'total': (SELECT sum(tokens)::BIGINT FROM files)
}})::VARCHAR AS json""",
    "tree_rollup": f"WITH {FILES}, {nodes('files')} {ROLLUP}",
    "tree_rollup_web": f"WITH {WEB}, {LATEST_WEB}, {nodes('files')} {ROLLUP}",
    "tree_rollup_chat": f"""WITH files AS (
  SELECT {CHAT_PATH} AS path, {piece_len('text')} AS tokens FROM conversations
), {nodes('files')} {ROLLUP}""",
    "tree_last_children": f"""WITH {FILES}, {nodes('files')}
SELECT array_to_string(max(parts), '/') AS path FROM nodes WHERE len(parts) > 0
GROUP BY parts[1:len(parts) - 1]""",
    "tree_lines": f"WITH {FILES}, {nodes('files')} {LINES}",
    "tree_lines_web": f"WITH {WEB}, {LATEST_WEB}, {nodes('files')} {LINES}",
    "merge_blocks": f"""WITH {FILES}
SELECT path, 'File: ' || path || chr(10) || content AS block FROM files WHERE tokens > 0""",
    "merge_within_budget": f"""WITH {FILES}
SELECT path, 'File: ' || path || chr(10) || content AS block FROM files WHERE tokens BETWEEN 100 AND 400""",
    "merge_json": f"""WITH {FILES}
SELECT path, to_json({{'path': path, 'content': content, 'tokens': tokens}})::VARCHAR AS json
FROM files WHERE tokens > 0""",
    "relative_paths": f"""SELECT {PATH} AS path,
  CASE WHEN source = 'src1' THEN lang || '/' || doc_id || '.txt' ELSE {PATH} END AS inner
FROM documents""",
    "path_parts": f"""SELECT page_id AS seq, len(p) AS parts, p[1] AS first, p[-1] AS last
FROM (SELECT page_id, string_split('/' || {ADDRESS}, '/') AS p FROM pages)""",
    "version_times": """SELECT event_id,
  greatest(floor(epoch(ts - to_days((event_id % 40 * 1000)::INTEGER)))::BIGINT, 0) AS mtime FROM events""",
    "source_megabytes": """SELECT source, round(sum(strlen(text)) * 37 / 1048576.0::DOUBLE) AS mb
FROM documents GROUP BY source""",
    "report_cells": f"""SELECT seq, path || repeat(' ', (SELECT max(strlen({ADDRESS})) FROM pages) - strlen(path)) AS cell,
  lpad(n, greatest(8, len(n))::INTEGER, ' ') AS number
FROM (SELECT page_id AS seq, {ADDRESS} AS path, (10 ** (len({ADDRESS}) % 12))::BIGINT::VARCHAR AS n FROM pages)""",
    "decoded_bytes": BROKEN,
    "path_list_lookup": f"""WITH wanted AS (
  SELECT unnest([{PATH}, CASE WHEN doc_id % 2 = 0 THEN {PATH} ELSE {PATH} || '.bak ' END]) AS path
  FROM documents WHERE doc_id % 3 = 0
), files AS (SELECT {PATH} AS path, len(text)::INTEGER AS n_chars FROM documents)
SELECT path, n_chars, CASE WHEN n_chars IS NULL THEN 'Failed to read file' END AS error
FROM wanted LEFT JOIN files USING (path)""",
    "file_tree_scan": _scanned("true"),
    "visible_file_scan": _scanned("lang <> 'de' AND (doc_id % 7 = 0 OR doc_id % 11 <> 0)"),
    "store_hits": f"""WITH {PATHS}, {STORED}
SELECT path, tokens, mtime, seq FROM latest WHERE mtime >= 1000 + doc_id % 4""",
    "store_hits_exact": f"""WITH {PATHS}, {STORED}
SELECT path, tokens, mtime, seq FROM latest WHERE mtime = 1000 + doc_id % 4""",
    "store_bucketed_hits": f"""WITH {PATHS}, {STORED}
SELECT path, tokens, mtime, seq, len(text)::INTEGER AS n_chars
FROM latest JOIN documents USING (doc_id) WHERE mtime >= 1000 + doc_id % 4""",
    "store_misses": f"""WITH {PATHS}, {STORED}
SELECT path, 1000 + doc_id % 4 AS mtime, len(text)::INTEGER AS n_chars
FROM files JOIN documents USING (doc_id)
WHERE doc_id NOT IN (SELECT doc_id FROM latest WHERE mtime >= 1000 + doc_id % 4)""",
    "store_upsert_latest": f"WITH {PATHS}, {STORED} SELECT path, tokens, mtime, seq FROM latest",
    "store_info": f"""WITH {PATHS}, {STORED}
SELECT count(*) AS records, 0::BIGINT AS bytes_apart, 0::DOUBLE AS mb_apart, true AS filled FROM latest""",
    "store_null_paths": f"""WITH {PATHS}, {STORED}, one AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN path END AS path, tokens, mtime FROM log WHERE seq = 1
), kept AS (
  SELECT * FROM one WHERE path IS NOT NULL
  UNION ALL SELECT * FROM one WHERE path IS NULL AND tokens = (SELECT max(tokens) FROM one WHERE path IS NULL)
), asked AS (
  SELECT path, 1000 + doc_id % 4 AS mtime FROM files WHERE doc_id % 2 = 0
  UNION ALL SELECT DISTINCT NULL, 0 FROM files WHERE doc_id % 2 = 1
)
SELECT 'latest' AS kind, path, tokens FROM kept
UNION ALL SELECT 'hit', k.path, k.tokens FROM kept k JOIN asked a
  ON k.path IS NOT DISTINCT FROM a.path AND k.mtime >= a.mtime
UNION ALL SELECT 'miss', a.path, 0 FROM asked a WHERE NOT EXISTS (
  SELECT 1 FROM kept k WHERE k.path IS NOT DISTINCT FROM a.path AND k.mtime >= a.mtime)""",
    "single_file_scan": f"""WITH {FILES}
SELECT strlen(text) AS length, tokens, NULL::VARCHAR AS error FROM files JOIN documents USING (doc_id)
ORDER BY doc_id LIMIT 1""",
    "glob_validity": """SELECT DISTINCT source || '/' || ending AS pattern, valid
FROM documents, (VALUES ('*', true), ('[', false), ('{a,b', false), ('[!a]', true), ('**/*.txt', true),
  ('[b-a]', false), ('a]', true), ('{x,y}?', true)) AS v(ending, valid)""",
    "tree_listed_repeats": f"WITH {FILES}, {nodes('files')} {ROLLUP}",
    "store_compacted": f"WITH {PATHS}, {STORED} SELECT path, tokens, mtime, 2::BIGINT AS seq FROM latest",
    "store_cleared": f"""WITH {PATHS}, {STORED}
SELECT path, tokens, mtime, 1::BIGINT AS seq FROM log WHERE seq = 2""",
    "incremental_run": f"""WITH {FILES}, {STORED}, answers AS (
  SELECT f.doc_id, f.path, len(content)::INTEGER AS n_chars, coalesce(l.tokens, f.tokens) AS tokens
  FROM files f LEFT JOIN latest l ON l.doc_id = f.doc_id AND l.mtime >= 1000 + f.doc_id % 4
)
SELECT doc_id AS pos, path, tokens, n_chars FROM answers
UNION ALL SELECT -doc_id - 1, path, tokens, n_chars FROM answers WHERE doc_id % 5 = 0""",
    "incremental_rerun": f"""WITH {PATHS}, {STORED}
SELECT 3::BIGINT AS seq, count(*) AS measured FROM files
WHERE doc_id NOT IN (SELECT doc_id FROM latest WHERE mtime >= 1000 + doc_id % 4)
UNION ALL SELECT 4, 0""",
    "stream_incremental": f"""WITH {FILES}, {STORED}
SELECT f.path, coalesce(l.tokens, f.tokens) AS tokens, coalesce(l.mtime, 1000 + f.doc_id % 4) AS mtime
FROM files f LEFT JOIN latest l ON l.doc_id = f.doc_id AND l.mtime >= 1000 + f.doc_id % 4""",
}
