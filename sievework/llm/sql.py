"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_ITEMS = """t AS (SELECT block_key, any_value(regexp_extract_all(content, '[A-Za-z0-9_]+')) w FROM code_blocks WHERE content IS NOT NULL GROUP BY block_key),
g AS (SELECT block_key, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) item FROM t WHERE len(w) >= 40)"""

_WORDS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: replace(lower(x), 'ß', 'ss'))"

SQL = {
    "p2_found": f"""WITH {_ITEMS}, n AS (SELECT block_key, count(*) n FROM g GROUP BY block_key),
p AS (SELECT a.block_key key_a, b.block_key key_b, count(*) k FROM g a JOIN g b ON a.item = b.item AND a.block_key < b.block_key GROUP BY ALL)
SELECT key_a, key_b FROM p JOIN n x ON x.block_key = key_a JOIN n y ON y.block_key = key_b WHERE k >= 0.6 * (x.n + y.n - k)""",
    "p7_found": f"""WITH d AS (SELECT doc_id, {_WORDS} w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} w FROM eval_items WHERE text IS NOT NULL),
gi AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) k FROM i WHERE len(w) >= 12)),
gd AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) k FROM d WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM gd JOIN gi USING (s)""",
}
