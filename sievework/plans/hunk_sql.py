"""DuckDB SQL of diffs, references, candidates and verdicts: the oracle of the pipeline's queries that need no call graph."""

from __future__ import annotations

_PATH = "CASE WHEN {0} = '/dev/null' THEN NULL ELSE regexp_replace({0}, '^([ab]/|\\./)', '') END"
_NORM = "array_to_string(list_filter(string_split(replace({}, chr(92), '/'), '/'), lambda x: x NOT IN ('', '.')), '/')"


def hunks(rows: str) -> str:
    """CTEs up to `hunk` (key, file_no, hunk_no, paths, ranges, texts) of rows (key, diff)."""
    w = "(PARTITION BY key ORDER BY i)"
    return f"""dd AS ({rows}),
d0 AS (SELECT key, unnest(string_split(replace(diff, chr(13) || chr(10), chr(10)), chr(10))) x, generate_subscripts(string_split(replace(diff, chr(13) || chr(10), chr(10)), chr(10)), 1) i FROM dd),
d1 AS (SELECT *, lead(x) OVER {w} nx, lag(x) OVER {w} px FROM d0),
d2 AS (SELECT *, coalesce(starts_with(x, '--- ') AND starts_with(nx, '+++ '), false) f, coalesce(starts_with(px, '--- ') AND starts_with(x, '+++ '), false) g, regexp_matches(x, '^@@ -\\d+(?:,\\d+)? \\+\\d+(?:,\\d+)? @@') h FROM d1),
d3 AS (SELECT *, sum(CAST(f AS INT)) OVER {w} - 1 file_no, sum(CAST(h AS INT)) OVER {w} hk FROM d2),
d4 AS (SELECT key, file_no, trim(split_part(substr(x, 5), chr(9), 1)) a, trim(split_part(substr(nx, 5), chr(9), 1)) b FROM d3 WHERE f),
hh AS (SELECT key, file_no, hk, row_number() OVER (PARTITION BY key, file_no ORDER BY hk) - 1 hunk_no, CAST(regexp_extract(x, '-(\\d+)', 1) AS INT) source_start, CAST(coalesce(nullif(regexp_extract(x, '^@@ -\\d+,(\\d+)', 1), ''), '1') AS INT) source_length,
  CAST(regexp_extract(x, '\\+(\\d+)', 1) AS INT) target_start, CAST(coalesce(nullif(regexp_extract(x, '\\+\\d+,(\\d+)', 1), ''), '1') AS INT) target_length FROM d3 WHERE h AND file_no >= 0),
bb AS (SELECT key, file_no, hk, i, left(x, 1) s, substr(x, 2) t FROM d3 WHERE NOT h AND NOT f AND NOT g AND left(x, 1) IN ('', ' ', '-', '+')),
b1 AS (SELECT bb.*, hunk_no, source_length n, target_length k, coalesce(sum(CAST(s <> '+' AS INT)) OVER p, 0) o, coalesce(sum(CAST(s <> '-' AS INT)) OVER p, 0) m FROM bb JOIN hh USING (key, file_no, hk) WINDOW p AS (PARTITION BY key, file_no, hk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b2 AS (SELECT key, file_no, hk, string_agg(t, chr(10) ORDER BY i) FILTER (s <> '+') source_text, string_agg(t, chr(10) ORDER BY i) FILTER (s <> '-') target_text FROM b1 WHERE o < n OR m < k GROUP BY ALL),
hunk AS (SELECT hh.key, hh.file_no, hunk_no, {_PATH.format('a')} source_path, {_PATH.format('b')} target_path, source_start, source_length, target_start, target_length, coalesce(source_text, '') source_text, coalesce(target_text, '') target_text
  FROM hh JOIN d4 USING (key, file_no) LEFT JOIN b2 USING (key, file_no, hk))"""


_DIFFS = "kd AS (SELECT vuln_id, patch_diff, max(knowledge_key) seq FROM vuln_knowledge WHERE vuln_id IS NOT NULL AND patch_diff IS NOT NULL GROUP BY ALL)"
_SIDE = "SELECT key.vuln_id vuln_id, '{role}' \"role\", {path} path, {s}_start start_line, {s}_start + {s}_length - 1 end_line, {s}_text content, (key.seq, file_no, hunk_no, {s}_text) o FROM hunk WHERE {s}_length > 0 AND {s}_path IS NOT NULL"
REFERENCES = f"""{_DIFFS}, {hunks("SELECT {'vuln_id': vuln_id, 'seq': seq} key, patch_diff diff FROM kd")},
sd AS ({_SIDE.format(role="vuln", s="source", path=_NORM.format("source_path"))} UNION ALL {_SIDE.format(role="fix", s="target", path=_NORM.format("target_path"))}),
ref AS (SELECT vuln_id, "role", path, start_line, end_line, arg_max(content, o) AS content FROM sd GROUP BY vuln_id, "role", path, start_line, end_line)"""

#: The record of a vulnerability, and the telling lines of both sides of its diffs.
_ONE = """one AS (SELECT vuln_id, string_agg(patch_diff, chr(10) ORDER BY seq, patch_diff) patch_diff FROM kd GROUP BY vuln_id),
pl AS (SELECT vuln_id, left(x, 1) s, regexp_replace(substr(x, 2), '^\\s+|\\s+$', '', 'g') t FROM (SELECT vuln_id, unnest(string_split(replace(patch_diff, chr(13) || chr(10), chr(10)), chr(10))) x FROM one) WHERE NOT starts_with(x, '---') AND NOT starts_with(x, '+++')),
po AS (SELECT DISTINCT vuln_id, t FROM pl WHERE s IN (' ', '-') AND length(t) >= 10),
pn AS (SELECT DISTINCT vuln_id, t FROM pl WHERE s = '+' AND length(t) >= 10 AND (vuln_id, t) NOT IN (SELECT (vuln_id, t) FROM po))"""

_CONTROL = "^(?:if|else|elif|for|while|switch|case|try|except|catch|return|raise|throw|break|continue)\\b"


def _sections(t: str, side: str, names: tuple[str, ...]) -> str:
    count = lambda where: f"(SELECT count(*) FROM {t} WHERE {t}.vuln_id = v.vuln_id{where})"
    return (
        f"{count('')} || ' {side} lines' AS {names[0]}, {count(f' AND regexp_matches(t, {chr(39)}{_CONTROL}{chr(39)})')} || ' {side} control statements' AS {names[1]}, "
        f"{count(f' AND regexp_matches(t, {chr(39)}[0-9A-Za-z_][ ]*[(]{chr(39)})')} || ' {side} calls' AS {names[2]}, {count('')} AS {names[3]}"
    )


def _spans(role: str) -> str:
    return f"coalesce((SELECT string_agg(s, chr(10) ORDER BY path, start_line, end_line) FROM (SELECT path || ':' || start_line || '-' || end_line s, * FROM ref WHERE ref.vuln_id = v.vuln_id AND \"role\" = '{role}' ORDER BY path, start_line, end_line LIMIT 3)), '') AS {role}_spans"


PATTERNS = f"""WITH {REFERENCES}, {_ONE} SELECT vuln_id, {_sections("po", "vulnerable", ("vuln_cause", "vuln_ctrlflow", "vuln_dataflow", "n_positive"))},
{_sections("pn", "added", ("fix_desc", "fix_ctrlflow", "fix_dataflow", "n_negative"))}, {_spans("vuln")}, {_spans("fix")} FROM (SELECT DISTINCT vuln_id FROM vuln_knowledge WHERE vuln_id IS NOT NULL) v"""

_ITEMS = "list_distinct(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || '::' || w[i + 1])))"
CANDIDATES = f"""{REFERENCES},
tb AS (SELECT DISTINCT tree_id, block_key, file_path, start_line, end_line, content, regexp_extract_all(content, '[A-Za-z0-9_]+') w FROM code_blocks WHERE content IS NOT NULL AND tree_id IN (SELECT tree_id FROM trees WHERE tree_role = 'target')),
tt AS (SELECT * FROM tb WHERE len(w) > 0), ti AS (SELECT block_key, unnest({_ITEMS}) item FROM tt), tn AS (SELECT block_key, count(*) n FROM ti GROUP BY ALL),
rr AS (SELECT *, row_number() OVER () r FROM (SELECT *, regexp_extract_all(content, '[A-Za-z0-9_]+') w FROM ref) WHERE len(w) > 0), ri AS (SELECT r, unnest({_ITEMS}) item FROM rr), rn AS (SELECT r, count(*) n FROM ri GROUP BY ALL),
jp AS (SELECT block_key, r, count(*) k FROM ti JOIN ri USING (item) GROUP BY ALL),
js AS (SELECT vuln_id, block_key, max(k / (tn.n + rn.n - k)) similarity FROM jp JOIN tn USING (block_key) JOIN rn USING (r) JOIN rr USING (r) WHERE k / (tn.n + rn.n - k) >= 0.6 GROUP BY ALL),
nm AS (SELECT DISTINCT vuln_id, regexp_extract(path, '[^/]*$') base FROM rr),
un AS (SELECT vuln_id, tree_id, block_key, similarity, 1 reason_no FROM js JOIN tt USING (block_key) UNION ALL SELECT vuln_id, tree_id, block_key, NULL, 2 FROM tt JOIN nm ON base = regexp_extract({_NORM.format('file_path')}, '[^/]*$')),
cand AS (SELECT vuln_id, tree_id, block_key, similarity, CASE reason_no WHEN 1 THEN 'similar' ELSE 'same name' END reason FROM un QUALIFY row_number() OVER (PARTITION BY vuln_id, tree_id, block_key ORDER BY reason_no, similarity DESC) = 1)"""

_COMPARE = """SELECT x.*, coalesce(a.n, 0) n_old, coalesce(b.n, 0) n_new, coalesce(c.k, 0) seen, coalesce(e.k, 0) mended FROM {cases} x
LEFT JOIN (SELECT vuln_id, count(*) n FROM po GROUP BY ALL) a USING (vuln_id) LEFT JOIN (SELECT vuln_id, count(*) n FROM pn GROUP BY ALL) b USING (vuln_id)
LEFT JOIN (SELECT vuln_id, tree_id, count(DISTINCT t) k FROM {lines} JOIN po USING (vuln_id, t) GROUP BY ALL) c USING (vuln_id, tree_id)
LEFT JOIN (SELECT vuln_id, tree_id, count(DISTINCT t) k FROM {lines} JOIN pn USING (vuln_id, t) GROUP BY ALL) e USING (vuln_id, tree_id)"""
_VERDICT = """n_old > 0 AND 2 * seen >= n_old AND (n_new = 0 OR 2 * mended < n_new) AS has_vuln,
CASE WHEN n_old = 0 THEN 0.5 ELSE CAST(format('{:.2f}', CASE WHEN 2 * seen >= n_old AND (n_new = 0 OR 2 * mended < n_new) THEN seen / n_old ELSE greatest(1 - seen / n_old, CASE WHEN n_new > 0 THEN mended / n_new ELSE 0 END) END) AS DOUBLE) END AS confidence,
CASE WHEN n_old = 0 THEN 'nothing to compare' ELSE seen || ' of ' || n_old || ' vulnerable and ' || mended || ' of ' || n_new || ' added lines found' END AS reason"""
_LINES = "regexp_replace(unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))), '^\\s+|\\s+$', '', 'g') t"

VERIFY = f"""WITH {CANDIDATES}, {_ONE},
sh AS (SELECT vuln_id, tree_id, content FROM cand JOIN tb USING (tree_id, block_key) QUALIFY row_number() OVER (PARTITION BY vuln_id, tree_id ORDER BY similarity DESC NULLS LAST, reason = 'same name', block_key) <= 60),
cs AS (SELECT vuln_id, tree_id, count(*) AS n_blocks FROM sh GROUP BY ALL), li AS (SELECT DISTINCT vuln_id, tree_id, {_LINES} FROM sh),
cp AS ({_COMPARE.format(cases="cs", lines="li")}) SELECT vuln_id, tree_id, n_blocks, {_VERDICT} FROM cp"""

_BASE = "regexp_extract(replace(file_path, chr(92), '/'), '[^/]*$')"
DECIDE = f"""WITH {CANDIDATES}, {_ONE},
im AS (SELECT DISTINCT vuln_id, unnest(regexp_extract_all(patch_diff, '[A-Za-z0-9_]+\\.java|[A-Za-z0-9_]+\\.py')) base FROM vuln_knowledge),
rk AS (SELECT c.vuln_id, c.tree_id, block_key, content, im.base IS NOT NULL important, row_number() OVER (PARTITION BY c.vuln_id, c.tree_id ORDER BY im.base IS NULL, {_BASE}, file_path, start_line, block_key) position
  FROM cand c JOIN tb USING (tree_id, block_key) LEFT JOIN im ON im.vuln_id = c.vuln_id AND im.base = {_BASE}),
ch AS (SELECT *, important AND position <= 80 chosen FROM rk), ci AS (SELECT *, chosen OR NOT bool_or(chosen) OVER (PARTITION BY vuln_id, tree_id) AND position <= 5 whole FROM ch),
sh AS (SELECT * FROM ci QUALIFY row_number() OVER (PARTITION BY vuln_id, tree_id ORDER BY whole DESC, position) <= 60),
cs AS (SELECT vuln_id, tree_id, count(*) AS n_shown, count(*) FILTER (whole) AS n_chosen FROM sh GROUP BY ALL), li AS (SELECT DISTINCT vuln_id, tree_id, {_LINES} FROM sh WHERE whole),
cp AS ({_COMPARE.format(cases="cs", lines="li")}) SELECT vuln_id, tree_id, n_shown, n_chosen, {_VERDICT} FROM cp"""
