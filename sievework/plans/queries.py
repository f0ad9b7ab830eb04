"""The queries of the reference operators over a data directory, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.python import shorten, tolerant_json
from ..operators import dedup, graph, paths, rank, similarity, spans
from ..sources import braces, builders, diffs, facts, flows, segment
from ..sources.tables import materialize, table
from . import context, decide, hunk_sql, pipeline
from .judge import rule_judge

Q = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def blocks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "code_blocks", *columns)


def is_reference(key: Column) -> Column:
    return key % 50 == 0


def references(df: DataFrame) -> DataFrame:
    """The stated query set of searches: keys divisible by 50, searched in all rows."""
    return df.where(is_reference(F.col("block_key")))


@query("""WITH t AS (SELECT block_key, ingested_at, regexp_extract_all(content, '[A-Za-z0-9_]+') w FROM code_blocks WHERE content IS NOT NULL)
SELECT block_key, ingested_at, len(w) AS n_tokens, len(list_distinct(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || '::' || w[i + 1])))) AS n_items FROM t""")
def q_tokens_bigrams(spark, d):
    df = blocks(spark, d, "block_key", "ingested_at", "content").where("content IS NOT NULL").withColumn("w", c.tokens(F.col("content")))
    return df.select("block_key", "ingested_at", F.size("w").alias("n_tokens"), F.size(F.array_distinct(c.with_bigrams(F.col("w")))).alias("n_items"))


_GRAMS = """t AS (SELECT block_key, any_value(regexp_extract_all(content, '[A-Za-z0-9_]+')) w FROM code_blocks WHERE content IS NOT NULL GROUP BY block_key),
g AS (SELECT block_key, unnest(list_distinct(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || '::' || w[i + 1])))) item FROM t WHERE len(w) > 0)"""


@query(f"WITH {_GRAMS} SELECT block_key AS id, min(sha1(item)) AS min_key FROM g GROUP BY block_key")
def q_min_sha1(spark, d):
    df = blocks(spark, d, "block_key", "content").where("content IS NOT NULL").dropDuplicates(["block_key"])
    return df.select(F.col("block_key").alias("id"), c.least_sha1(c.grams(F.col("content"))).alias("min_key")).where("min_key IS NOT NULL")


@query(f"WITH {_GRAMS}, k AS (SELECT block_key, min(sha1(item)) k FROM g GROUP BY block_key) SELECT block_key AS id, k AS group_key, count(*) OVER (PARTITION BY k) AS n_group FROM k")
def q_shared_min(spark, d):
    return similarity.shared_min(blocks(spark, d, "block_key", "content"), "block_key", "content")


_PAIRS = f"""{_GRAMS}, n AS (SELECT block_key, count(*) n FROM g GROUP BY block_key),
p AS (SELECT a.block_key target, b.block_key ref, count(*) k FROM g a JOIN g b ON a.item = b.item AND b.block_key % 50 = 0 AND a.block_key <> b.block_key GROUP BY ALL),
s AS (SELECT target, ref, k / (x.n + y.n - k) s FROM p JOIN n x ON x.block_key = target JOIN n y ON y.block_key = ref WHERE k / (x.n + y.n - k) >= 0.6)"""


@query(f"WITH {_PAIRS} SELECT target, count(*) AS n_refs, round(max(s), 6) AS similarity FROM s GROUP BY target")
def q_exact_jaccard(spark, d):
    df = blocks(spark, d, "block_key", "content")
    return similarity.links(df, is_reference, "block_key", "content").select("target", "n_refs", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_PAIRS} SELECT target, ref, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY target ORDER BY s DESC, ref) = 1")
def q_best_reference(spark, d):
    df = blocks(spark, d, "block_key", "content")
    return similarity.links(df, is_reference, "block_key", "content").select("target", "ref", F.round("similarity", 6).alias("similarity"))


@query("SELECT DISTINCT block_key FROM code_blocks WHERE EXISTS (SELECT 1 FROM code_blocks WHERE block_key % 50 = 0)")
def q_as_shipped(spark, d):
    df = blocks(spark, d, "block_key")
    return similarity.as_shipped(df, references(df), "block_key")


@query(f"WITH {_PAIRS} SELECT target, ref, round(s, 6) AS similarity FROM s")
def q_minhash(spark, d):
    df = blocks(spark, d, "block_key", "content")
    return similarity.minhash(df, references(df), "block_key", "content").select("target", "ref", F.round("similarity", 6).alias("similarity"))


_EXT = " OR ".join(f"ends_with(file_path, '{e}')" for e in c.DEFAULT_EXTENSIONS)


@query(f"SELECT block_key, ingested_at, file_path FROM code_blocks WHERE {_EXT}")
def q_extension_scan(spark, d):
    return blocks(spark, d, "block_key", "ingested_at", "file_path").where(c.has_extension(F.col("file_path")))


_BASE = "regexp_extract(replace(file_path, chr(92), '/'), '[^/]*$')"


@query(f"""WITH r AS (SELECT DISTINCT {_BASE} b FROM code_blocks WHERE block_key % 50 = 0)
SELECT block_key, ingested_at FROM code_blocks WHERE {_BASE} IN (SELECT b FROM r WHERE b <> '')""")
def q_same_basename(spark, d):
    df = blocks(spark, d, "block_key", "ingested_at", "file_path")
    return paths.same_basename(df, references(df)).select("block_key", "ingested_at")


_NORM = "array_to_string(list_filter(string_split(replace({}, chr(92), '/'), '/'), lambda x: x NOT IN ('', '.')), '/')"


@query(f"""WITH h AS (SELECT unnest(regexp_extract_all(patch_diff, '(?m)^\\+\\+\\+ ([^\\t\\r\\n]+)', 1)) wanted FROM vuln_knowledge),
w AS (SELECT DISTINCT wanted, {_NORM.format("regexp_replace(wanted, '^([ab]/|(\\./)+)', '')")} norm FROM h WHERE wanted <> '/dev/null'),
f AS (SELECT DISTINCT {_NORM.format('file_path')} path FROM code_blocks),
n AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, count(*) OVER (PARTITION BY regexp_extract(path, '[^/]*$')) n FROM f WHERE path <> ''),
m AS (SELECT wanted, norm, regexp_extract(norm, '[^/]*$') base, path, name, n,
  len(list_filter(range(1, least(length(norm), length(path)) + 1), lambda k: right(lower(norm), k) = right(lower(path), k))) score
  FROM w JOIN n ON lower(regexp_extract(norm, '[^/]*$')) = lower(name)),
t AS (SELECT *, CASE WHEN norm = path THEN 1 WHEN base = name AND n = 1 THEN 2 WHEN base = name THEN 3 ELSE 4 END tier FROM m)
SELECT wanted, path, tier FROM t QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY tier, score DESC, length(path), path) = 1""")
def q_resolve_paths(spark, d):
    known = table(spark, d, "vuln_knowledge", "patch_diff").where("patch_diff IS NOT NULL")
    wanted = known.select(F.explode(F.regexp_extract_all("patch_diff", F.lit(r"(?m)^\+\+\+ ([^\t\r\n]+)"), F.lit(1))).alias("wanted")).where("wanted <> '/dev/null'")
    return paths.resolve(wanted, blocks(spark, d, "file_path").select(F.col("file_path").alias("path")))


@query(f"""WITH f AS (SELECT DISTINCT tree_id, {_NORM.format('file_path')} path FROM code_blocks WHERE file_path IS NOT NULL),
p AS (SELECT tree_id, path, string_split(path, '/') s FROM f WHERE path <> ''),
e AS (SELECT DISTINCT tree_id, array_to_string(s[1:k], '/') entry, 1 is_dir FROM (SELECT tree_id, s, unnest(range(1, len(s))) k FROM p) UNION ALL SELECT tree_id, path, 0 FROM p)
SELECT tree_id, entry, is_dir, len(string_split(entry, '/')) - 1 AS depth, row_number() OVER (PARTITION BY tree_id ORDER BY entry, is_dir DESC) AS position FROM e""")
def q_file_tree(spark, d):
    return paths.file_tree(blocks(spark, d, "tree_id", "file_path").withColumnRenamed("file_path", "path"), ["tree_id"])


@query("""SELECT block_key, ingested_at, array_to_string(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))[1:80], chr(10)) AS head FROM code_blocks WHERE content IS NOT NULL""")
def q_header_block(spark, d):
    df = blocks(spark, d, "block_key", "ingested_at", "content").where("content IS NOT NULL")
    return df.select("block_key", "ingested_at", c.line_slice(F.col("content"), F.lit(1), F.lit(segment.HEADER_LINES)).alias("head"))


@query("""WITH h AS (SELECT knowledge_key, ingested_at, unnest(regexp_extract_all(patch_diff, '(?m)^@@ -\\d+(?:,\\d+)? \\+\\d+(?:,\\d+)? @@')) h FROM vuln_knowledge)
SELECT knowledge_key, ingested_at, CAST(regexp_extract(h, '-(\\d+)', 1) AS INT) AS source_start, CAST(coalesce(nullif(regexp_extract(h, '-\\d+,(\\d+)', 1), ''), '1') AS INT) AS source_length,
CAST(regexp_extract(h, '\\+(\\d+)', 1) AS INT) AS target_start, CAST(coalesce(nullif(regexp_extract(h, '\\+\\d+,(\\d+)', 1), ''), '1') AS INT) AS target_length FROM h""")
def q_hunk_headers(spark, d):
    h = table(spark, d, "vuln_knowledge", "knowledge_key", "ingested_at", "patch_diff").where("patch_diff IS NOT NULL").select("knowledge_key", "ingested_at", F.explode(diffs.headers(F.col("patch_diff"))).alias("h"))
    number = lambda p, least=None: (F.regexp_extract("h", p, 1) if least is None else F.when(F.regexp_extract("h", p, 1) == "", least).otherwise(F.regexp_extract("h", p, 1))).cast("int")
    return h.select("knowledge_key", "ingested_at", number(r"-(\d+)").alias("source_start"), number(r"-\d+,(\d+)", "1").alias("source_length"), number(r"\+(\d+)").alias("target_start"), number(r"\+\d+,(\d+)", "1").alias("target_length"))


@query(f"WITH {hunk_sql.hunks('SELECT DISTINCT knowledge_key AS key, patch_diff diff FROM vuln_knowledge')} SELECT * FROM hunk")
def q_hunks(spark, d):
    known = table(spark, d, "vuln_knowledge", "knowledge_key", "patch_diff").distinct()
    return diffs.hunks(known, "knowledge_key", "patch_diff")


@query(f"WITH {hunk_sql.REFERENCES} SELECT * FROM ref")
def q_reference_blocks(spark, d):
    return pipeline.reference_blocks(table(spark, d, "vuln_knowledge"))


_RANGES = "SELECT l_orderkey, l_linenumber, l_partkey, datediff('day', DATE '1970-01-01', l_shipdate) s, datediff('day', DATE '1970-01-01', l_shipdate) + CAST(l_quantity AS INT) e, l_returnflag FROM lineitem"


def _line_ranges(spark, d):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_returnflag").select("l_orderkey", "l_linenumber", "l_partkey", day.alias("start_line"), (day + F.col("l_quantity").cast("int")).alias("end_line"), "l_returnflag")


@query(f"""WITH r AS ({_RANGES}) SELECT l_orderkey, l_linenumber, s AS start_line, e AS end_line FROM r a WHERE l_returnflag = 'A' AND EXISTS
(SELECT 1 FROM r b WHERE b.l_returnflag = 'R' AND b.l_partkey = a.l_partkey AND b.s <= a.e AND a.s <= b.e)""")
def q_overlap_semi(spark, d):
    r = _line_ranges(spark, d)
    return spans.overlapping(r.where("l_returnflag = 'A'"), r.where("l_returnflag = 'R'"), ["l_partkey"]).select("l_orderkey", "l_linenumber", "start_line", "end_line")


@query(f"""WITH r AS ({_RANGES}) SELECT a.l_orderkey AS point_order, a.l_linenumber AS point_line, b.l_orderkey AS block_order, b.l_linenumber AS block_line
FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND b.s <= a.s AND a.s <= b.e WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'
QUALIFY row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber, a.s, a.l_partkey ORDER BY b.s, b.e, b.l_orderkey, b.l_linenumber) = 1""")
def q_containment_first(spark, d):
    r = _line_ranges(spark, d)
    points = r.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("point_order"), F.col("l_linenumber").alias("point_line"), "l_partkey", F.col("start_line").alias("at"))
    points = points.withColumn("point", F.struct("point_order", "point_line", "at", "l_partkey"))
    b = r.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("block_order"), F.col("l_linenumber").alias("block_line"), "l_partkey", "start_line", "end_line")
    return spans.first_enclosing(points, b, ["l_partkey"], "at", "point", ["start_line", "end_line", "block_order", "block_line"]).select("point_order", "point_line", "block_order", "block_line")


def edges(spark, d):
    return table(spark, d, "call_edges", "tree_id", "src", "dst", "edge_kind")


_E = "e AS (SELECT DISTINCT tree_id, src, dst FROM call_edges WHERE src IS NOT NULL AND dst IS NOT NULL AND tree_id IS NOT NULL)"
_STARTS = "s AS (SELECT DISTINCT tree_id, src node FROM call_edges WHERE edge_kind = 'points_to' AND src IS NOT NULL AND tree_id IS NOT NULL)"


@query(f"""WITH {_E}, {_STARTS} SELECT tree_id, dst AS node FROM e JOIN s USING (tree_id) WHERE e.src = s.node UNION SELECT tree_id, src FROM e JOIN s USING (tree_id) WHERE e.dst = s.node""")
def q_neighbors(spark, d):
    e = edges(spark, d)
    starts = e.where("edge_kind = 'points_to' AND src IS NOT NULL").select("tree_id", F.col("src").alias("node")).distinct()
    return graph.one_hop(e, starts, ["tree_id"])


def _hits_sql(rounds: int, digits: int = 6) -> str:
    parts = ["w AS (SELECT tree_id, src, dst, CAST(count(*) AS DOUBLE) w FROM call_edges WHERE src IS NOT NULL AND dst IS NOT NULL AND tree_id IS NOT NULL GROUP BY ALL)", "n AS (SELECT tree_id, src node FROM w UNION SELECT tree_id, dst FROM w)", "s0 AS (SELECT tree_id, node, 1 / sqrt(count(*) OVER (PARTITION BY tree_id)) a, 1 / sqrt(count(*) OVER (PARTITION BY tree_id)) h FROM n)"]
    for k in range(rounds):
        parts += [
            f"a{k} AS (SELECT w.tree_id, dst node, sum(w * h) a FROM w JOIN s{k} ON w.tree_id = s{k}.tree_id AND src = node GROUP BY ALL)",
            f"h{k} AS (SELECT w.tree_id, src node, sum(w * a) h FROM w JOIN a{k} ON w.tree_id = a{k}.tree_id AND dst = node GROUP BY ALL)",
            f"u{k} AS (SELECT n.tree_id, n.node, coalesce(a, 0) a, coalesce(h, 0) h FROM n LEFT JOIN a{k} USING (tree_id, node) LEFT JOIN h{k} USING (tree_id, node))",
            f"s{k + 1} AS (SELECT tree_id, node, coalesce(a / nullif(sqrt(sum(a * a) OVER (PARTITION BY tree_id)), 0), 0) a, coalesce(h / nullif(sqrt(sum(h * h) OVER (PARTITION BY tree_id)), 0), 0) h FROM u{k})",
        ]
    return f"WITH {', '.join(parts)} SELECT tree_id, node, round(a, {digits}) AS authority, round(h, {digits}) AS hub FROM s{rounds}"


@query(_hits_sql(4))
def q_hits_four_rounds(spark, d):
    s = graph.hits(edges(spark, d).where("tree_id IS NOT NULL"), ["tree_id"], max_iter=4, fixed=True)
    return s.select("tree_id", "node", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


@query(f"""WITH s AS ({_hits_sql(8, 9)}) SELECT tree_id, node, rank, round(authority, 6) AS authority FROM
(SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY authority DESC, node) AS rank FROM s) WHERE rank <= 20""")
def q_hits_top_k(spark, d):
    """The 20 best nodes of each tree after eight rounds."""
    s = graph.hits(edges(spark, d), ["tree_id"], max_iter=8, fixed=True)
    return graph.top_k(s, ["tree_id"]).select("tree_id", "node", "rank", F.round("authority", 6).alias("authority"))


@query()
def q_hits(spark, d):
    """The scores of all nodes once they no longer move."""
    return graph.hits(edges(spark, d), ["tree_id"]).select("tree_id", "node", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


@query("""WITH o AS (SELECT DISTINCT tree_id, src, dst FROM call_edges WHERE edge_kind = 'call'), n AS (SELECT DISTINCT tree_id, src, dst FROM call_edges WHERE edge_kind = 'points_to')
SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def q_graph_diff(spark, d):
    e = edges(spark, d)
    return graph.difference(e.where("edge_kind = 'call'"), e.where("edge_kind = 'points_to'"), ["tree_id", "src", "dst"])


@query("""WITH n AS (SELECT DISTINCT tree_id, src node FROM call_edges WHERE src IS NOT NULL AND tree_id IS NOT NULL),
b AS (SELECT DISTINCT tree_id, dst qualname, regexp_extract(dst, '[^.:]*$') fn, md5(dst) blk FROM call_edges WHERE dst IS NOT NULL AND edge_kind = 'call' AND tree_id IS NOT NULL),
u AS (SELECT tree_id, fn, min(blk) blk FROM b GROUP BY ALL HAVING count(*) = 1)
SELECT n.tree_id, node, coalesce(b.blk, u.blk) AS block FROM n LEFT JOIN b ON n.tree_id = b.tree_id AND node = qualname LEFT JOIN u ON n.tree_id = u.tree_id AND regexp_extract(node, '[^.:]*$') = u.fn""")
def q_node_align(spark, d):
    e = edges(spark, d).where("tree_id IS NOT NULL")
    nodes = e.where("src IS NOT NULL").select("tree_id", F.col("src").alias("node")).distinct()
    b = e.where("dst IS NOT NULL AND edge_kind = 'call'").select("tree_id", F.col("dst").alias("qualname")).distinct().withColumn("func_name", F.regexp_extract("qualname", "[^.:]*$", 0)).withColumn("block", F.md5("qualname"))
    return graph.align(nodes, b, ["tree_id"])


@query("""WITH k AS (SELECT tree_id, src, dst FROM call_edges WHERE src <> '' AND NOT starts_with(src, '<builtin>') AND NOT starts_with(dst, '<builtin>') AND NOT contains(src, '<RETURN>') AND NOT contains(dst, '<RETURN>') AND dst NOT IN ('<str>', '<int>')),
s AS (SELECT tree_id, array_to_string(list_filter(string_split(src, '.'), lambda x: NOT regexp_matches(x, '<(if|els|while|list|dict)')), '.') src, array_to_string(list_filter(string_split(dst, '.'), lambda x: NOT regexp_matches(x, '<(if|els|while|list|dict)')), '.') dst FROM k),
i AS (SELECT tree_id, nullif(regexp_replace(src, '(^|\\.)<[^.]*>.*$', ''), '') src, nullif(regexp_replace(dst, '(^|\\.)<[^.]*>.*$', ''), '') dst FROM s)
SELECT DISTINCT tree_id, src, dst FROM i WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst""")
def q_clean_edges(spark, d):
    return graph.clean_edges(edges(spark, d), ["tree_id"])


@query(f"WITH {_E} SELECT tree_id, src, count(*) AS n_dst, string_agg(dst, ',' ORDER BY dst) AS dsts FROM e GROUP BY ALL")
def q_adjacency(spark, d):
    return graph.adjacency(edges(spark, d).where("tree_id IS NOT NULL"), ["tree_id"])


@query("SELECT block_key, file_path, kind, name, start_line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at, block_key) n FROM code_blocks) WHERE n = 1")
def q_first_wins(spark, d):
    return dedup.first_wins(blocks(spark, d, "id", "block_key", "file_path", "kind", "name", "start_line", "ingested_at"), ["id"], [F.col("ingested_at"), F.col("block_key")]).select("block_key", "file_path", "kind", "name", "start_line")


@query("SELECT vuln_id, arg_max(prediction_id, prediction_id) AS last_id, arg_max(tree_id, prediction_id) AS tree_id, min(prediction_id) AS position FROM predictions GROUP BY vuln_id")
def q_last_wins(spark, d):
    p = table(spark, d, "predictions", "vuln_id", "prediction_id", "tree_id").withColumn("last_id", F.col("prediction_id"))
    return dedup.last_wins(p, ["vuln_id"], "prediction_id").select("vuln_id", "last_id", "tree_id", "position")


@query(f"SELECT tree_id, path, start_line, block_key FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, path, start_line, end_line ORDER BY ingested_at, block_key) n FROM (SELECT *, {_NORM.format('file_path')} path FROM code_blocks)) WHERE n = 1")
def q_dedup_span(spark, d):
    df = blocks(spark, d, "tree_id", "file_path", "start_line", "end_line", "block_key", "ingested_at").withColumn("path", c.norm_path(F.col("file_path")))
    return dedup.first_wins(df, ["tree_id", "path", "start_line", "end_line"], [F.col("ingested_at"), F.col("block_key")]).select("tree_id", "path", "start_line", "block_key")


@query("""WITH x AS (SELECT id, file_path, name FROM code_blocks WHERE block_key % 50 = 0)
SELECT block_key, ingested_at FROM code_blocks c WHERE id NOT IN (SELECT id FROM x WHERE id IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM x WHERE x.name IS NOT NULL AND x.file_path = c.file_path AND x.name = c.name)""")
def q_not_selected(spark, d):
    df = blocks(spark, d, "id", "file_path", "name", "block_key", "ingested_at").withColumnRenamed("file_path", "path")
    return dedup.not_selected(df, references(df)).select("block_key", "ingested_at")


@query("SELECT DISTINCT vuln_id, unnest(regexp_extract_all(patch_diff, '[A-Za-z0-9_]+\\.java|[A-Za-z0-9_]+\\.py')) AS name FROM vuln_knowledge")
def q_important_names(spark, d):
    return rank.important_names(table(spark, d, "vuln_knowledge", "vuln_id", "patch_diff"))


@query(f"""WITH b AS (SELECT DISTINCT tree_id, block_key, file_path, start_line, {_BASE} base FROM code_blocks), i AS (SELECT DISTINCT unnest(regexp_extract_all(patch_diff, '[A-Za-z0-9_]+\\.java|[A-Za-z0-9_]+\\.py')) AS name FROM vuln_knowledge),
p AS (SELECT b.*, CASE WHEN base IN (SELECT name FROM i) THEN 0 ELSE 1 END priority FROM b)
SELECT tree_id, block_key, priority, row_number() OVER (PARTITION BY tree_id ORDER BY priority, base, file_path, start_line, block_key) AS position FROM p QUALIFY position <= 80""")
def q_priority_listing(spark, d):
    names = rank.important_names(table(spark, d, "vuln_knowledge", "vuln_id", "patch_diff"))
    df = blocks(spark, d, "tree_id", "block_key", "file_path", "start_line").distinct()
    return rank.listing(df, names, ["tree_id"], 80).select("tree_id", "block_key", "priority", "position")


_NEEDLES = {"uses_eval": "eval(", "uses_memcpy": "memcpy(", "has_todo": "TODO"}


@query(f"SELECT tree_id, {', '.join(f'coalesce(bool_or(contains(content, {chr(39)}{n}{chr(39)})), false) AS {k}' for k, n in _NEEDLES.items())} FROM code_blocks GROUP BY tree_id")
def q_signals(spark, d):
    return rank.signals(blocks(spark, d, "tree_id", "content"), "content", _NEEDLES, ["tree_id"])


_VERDICTS = """l AS (SELECT {key}, list_filter(string_split(replace(coalesce({text}, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x) <> '') k FROM {table}),
v AS (SELECT {key}, k, regexp_extract(' ' || coalesce(k[2], '') || ' ', '[^0-9.]([01](?:\\.[0-9]+)?)[^0-9%]', 1) c FROM l)
SELECT {key}, coalesce(starts_with(upper(trim(k[1])), 'Y'), false) AS has_vuln, CASE WHEN len(k) = 0 THEN 0.0 WHEN c = '' THEN 0.5 ELSE least(greatest(CAST(c AS DOUBLE), 0.0), 1.0) END AS confidence,
len(k) AS n_lines, md5(array_to_string(CASE WHEN len(k) > 2 THEN k[3:] ELSE k END, chr(10))) AS reason_md5 FROM v"""


def _verdicts(df: DataFrame, key: str, text: str) -> DataFrame:
    ink = F.filter(c.lines(F.coalesce(text, F.lit(""))), lambda x: F.trim(x) != "")
    return df.withColumn("v", c.verdict(F.col(text))).select(key, "v.has_vuln", "v.confidence", F.size(ink).alias("n_lines"), F.md5("v.reason").alias("reason_md5"))


@query("WITH " + _VERDICTS.format(key="prediction_id", text="raw_reasoning", table="predictions"))
def q_verdict_parse(spark, d):
    return _verdicts(table(spark, d, "predictions", "prediction_id", "raw_reasoning"), "prediction_id", "raw_reasoning")


@query("WITH " + _VERDICTS.format(key="doc_id", text="text", table="documents"))
def q_verdict_documents(spark, d):
    """Documents read as answers: many are, with YES or NO and a confidence."""
    return _verdicts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def q_json_props(spark, d):
    return table(spark, d, "events", "event_id", "props").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k IS NOT NULL")


@query("""SELECT doc_id, len(b) AS n_bullets, md5(array_to_string(b, chr(10))) AS bullets_md5 FROM (SELECT doc_id,
list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(ltrim(trim(x), '-• ' || chr(9)))), lambda x: x <> '') b FROM documents WHERE text IS NOT NULL)""")
def q_bullets(spark, d):
    b = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", c.bullets(F.col("text")).alias("b"))
    return b.select("doc_id", F.size("b").alias("n_bullets"), F.md5(F.array_join("b", "\n")).alias("bullets_md5"))


_ANSWER = "'[CAUSE] ' || coalesce(desc_text, '') || chr(10) || '[FIX]' || chr(10) || coalesce(vuln_proj_root, '') || ' [TESTS]'"


@query(f"""WITH r AS (SELECT knowledge_key, ingested_at, {_ANSWER} raw FROM vuln_knowledge),
s AS (SELECT *, {", ".join(f"trim(regexp_extract(raw, '(?s){chr(92)}[{t}{chr(92)}](.*?)(?:{chr(92)}[[A-Z_]+{chr(92)}]|{chr(92)}z)', 1), chr(32) || chr(9) || chr(10) || chr(13)) {t.lower()}" for t in ("CAUSE", "FIX", "TESTS", "NONE"))} FROM r)
SELECT knowledge_key, ingested_at, {", ".join(f"CASE WHEN {t} = '' THEN 'N/A' ELSE {t} END AS {t}" for t in ("cause", "fix", "tests", "none"))} FROM s""")
def q_tagged(spark, d):
    """The sections of tagged answers about the records; one is empty, one is not there."""
    k = table(spark, d, "vuln_knowledge", "knowledge_key", "ingested_at", "desc_text", "vuln_proj_root")
    raw = F.concat(F.lit("[CAUSE] "), F.coalesce("desc_text", F.lit("")), F.lit("\n[FIX]\n"), F.coalesce("vuln_proj_root", F.lit("")), F.lit(" [TESTS]"))
    return k.select("knowledge_key", "ingested_at", *[c.tagged(raw, t).alias(t.lower()) for t in ("CAUSE", "FIX", "TESTS", "NONE")])


@query("SELECT knowledge_key, ingested_at, 'anon:' || left(sha256(coalesce(desc_text, '') || coalesce(patch_diff, '')), 16) AS cache_key FROM vuln_knowledge")
def q_cache_key(spark, d):
    return table(spark, d, "vuln_knowledge", "knowledge_key", "ingested_at", "desc_text", "patch_diff").select("knowledge_key", "ingested_at", c.cache_key(F.col("desc_text"), F.col("patch_diff")).alias("cache_key"))


@query()
def q_shorten(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", shorten(F.col("text"), F.lit(160)).alias("snippet"))


@query()
def q_tolerant_json(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tolerant_json(F.col("text")).alias("json")).where("json IS NOT NULL")


@query("""SELECT block_key, ingested_at, coalesce(nullif(regexp_extract(array_to_string(string_split(replace(coalesce(content, ''), chr(13) || chr(10), chr(10)), chr(10))[1:5], chr(10)), '\\b(def|function|public|private|static)\\s+([A-Za-z0-9_]+)', 2), ''), 'unknown') AS symbol FROM code_blocks""")
def q_symbol_name(spark, d):
    return blocks(spark, d, "block_key", "ingested_at", "content").select("block_key", "ingested_at", c.symbol_name(F.col("content")).alias("symbol"))


@query(f"""WITH p AS (SELECT DISTINCT block_key, file_path, regexp_replace(regexp_replace({_NORM.format('file_path')}, '\\.py$', ''), '(^|/)__init__$', '') m FROM code_blocks WHERE ends_with(file_path, '.py'))
SELECT block_key, CASE WHEN m = '' THEN 'module' ELSE replace(m, '/', '.') END AS module FROM p""")
def q_module_name(spark, d):
    return blocks(spark, d, "block_key", "file_path").where(F.col("file_path").endswith(".py")).distinct().select("block_key", c.module_name(F.col("file_path")).alias("module"))


@query()
def q_segments(spark, d):
    files = blocks(spark, d, "tree_id", "file_path", "content", "kind").where("kind = 'file'").drop("kind").distinct()
    return segment.blocks(files)


@query()
def q_facts(spark, d):
    return facts.facts(blocks(spark, d, "tree_id", "file_path", "content", "kind").where("kind = 'file'").drop("kind").distinct())


@query()
def q_call_edges(spark, d):
    return facts.call_edges(q_facts(spark, d))


#: Ids of trees that are broadcast (about 10 MB); more are joined by sorting.
FEW_TREES = 250_000


def _targets(spark, d):
    """Blocks of target trees, equal rows of a key included; the texts are not shuffled to find them."""
    trees = table(spark, d, "trees", "tree_id", "tree_role").where("tree_role = 'target'").select("tree_id")
    trees = F.broadcast(trees) if trees.count() <= FEW_TREES else trees
    return blocks(spark, d, "tree_id", "block_key", "file_path", "content").where("content IS NOT NULL").join(trees, "tree_id", "left_semi")


def _code(spark, d):
    own = blocks(spark, d, "tree_id", "block_key", "file_path", "start_line", "kind", "name", "content")
    return context.Code(table(spark, d, "trees", "tree_id", "proj_root"), own, edges(spark, d))


@query()
def q_candidates(spark, d):
    code = _code(spark, d)
    nodes = context.nodes(code)
    return pipeline.candidates(pipeline.reference_blocks(table(spark, d, "vuln_knowledge"), code, nodes), _targets(spark, d), code=code, nodes=nodes)


@query()
def q_verify(spark, d):
    return pipeline.verify(table(spark, d, "vuln_knowledge"), _targets(spark, d), code=_code(spark, d))


@query()
def q_brace_facts(spark, d):
    return braces.facts(blocks(spark, d, "tree_id", "file_path", "content", "kind").where("kind = 'file'").drop("kind").distinct())


@query()
def q_brace_call_edges(spark, d):
    """Calls of C, C++ and Java by symbol, across files."""
    return braces.symbol_edges(q_brace_facts(spark, d))


def _files(spark, d) -> DataFrame:
    return blocks(spark, d, "tree_id", "file_path", "content", "kind").where("kind = 'file'").drop("kind").distinct()


@query()
def q_flow_edges(spark, d):
    """Calls of Python files by names and by the flow of values."""
    return flows.resolved_edges(_files(spark, d))


@query()
def q_graph_blocks(spark, d):
    """The functions of Python files as blocks of graph nodes."""
    return builders.builder_of("python").blocks(_files(spark, d))


_RANGED = """WITH b AS (SELECT DISTINCT tree_id, block_key, {norm} path, coalesce(kind, '') kind, name, start_line,
start_line + greatest(len(string_split(replace(coalesce(content, ''), chr(13) || chr(10), chr(10)), chr(10))) - CAST(ends_with(coalesce(content, ''), chr(10)) AS INT), 1) - 1 end_line FROM code_blocks)""".format(norm=_NORM.format("file_path"))
def _ranged(spark, d):
    df = blocks(spark, d, "tree_id", "block_key", "file_path", "start_line", "kind", "name", "content")
    return context.ranged(df).withColumn("kind", F.coalesce("kind", F.lit("")))


@query(f"""{_RANGED} SELECT block_key, path, start_line, end_line FROM b x WHERE tree_id IS NOT NULL AND path IS NOT NULL
AND EXISTS (SELECT 1 FROM b y WHERE y.block_key % 50 = 0 AND y.tree_id = x.tree_id AND y.path = x.path AND y.start_line - 40 <= x.end_line AND x.start_line <= y.end_line + 40)""")
def q_overlap_blocks(spark, d):
    """Blocks whose lines come within 40 of a reference block of their file."""
    b = _ranged(spark, d).where("tree_id IS NOT NULL").drop("kind", "name")
    refs = b.where(is_reference(F.col("block_key"))).withColumn("start_line", F.col("start_line") - 40).withColumn("end_line", F.col("end_line") + 40)
    return spans.overlapping(b, refs, ["tree_id", "path"]).select("block_key", "path", "start_line", "end_line")


@query(f"""{_RANGED} SELECT x.block_key AS block_key, y.block_key AS whole_key, y.start_line AS start_line, y.end_line AS end_line FROM b x JOIN b y ON y.tree_id = x.tree_id AND y.path = x.path AND y.start_line <= x.start_line AND x.start_line <= y.end_line
WHERE y.kind <> 'file' QUALIFY row_number() OVER (PARTITION BY x.block_key ORDER BY y.end_line - y.start_line DESC, y.start_line, y.block_key) = 1""")
def q_containment_blocks(spark, d):
    """The outermost block that holds the first line of each block."""
    b = _ranged(spark, d).where("tree_id IS NOT NULL")
    points = b.select("tree_id", "path", "block_key", F.col("start_line").alias("at"))
    held = b.where("kind <> 'file'").select("tree_id", "path", F.col("block_key").alias("whole_key"), "start_line", "end_line", (F.col("start_line") - F.col("end_line")).alias("size"))
    return spans.first_enclosing(points, held, ["tree_id", "path"], "at", "block_key", ["size", "start_line", "whole_key"]).select("block_key", "whole_key", "start_line", "end_line")


@query(f"""WITH f AS (SELECT DISTINCT tree_id, file_path, content, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) t FROM code_blocks WHERE kind = 'file' AND file_path IS NOT NULL AND content IS NOT NULL)
SELECT tree_id, file_path, len(string_split(t, chr(10))) AS end_line, md5(t) AS content_md5 FROM f WHERE NOT ends_with(file_path, '.py') AND NOT ends_with(file_path, '.java')""")
def q_whole_file_blocks(spark, d):
    """The blocks of files that no segmenter knows: the whole file each."""
    other = _files(spark, d).where(~F.col("file_path").endswith(".py") & ~F.col("file_path").endswith(".java"))
    return segment.blocks(other).where("kind = 'file' AND seq = 0 AND start_line = 1").select("tree_id", "file_path", "end_line", F.md5("content").alias("content_md5"))


@query("""WITH d AS (SELECT tree_id, dst node FROM call_edges WHERE dst IS NOT NULL AND tree_id IS NOT NULL UNION SELECT tree_id, src FROM call_edges WHERE src IS NOT NULL AND tree_id IS NOT NULL),
n AS (SELECT * FROM d UNION SELECT tree_id, node || '.__init__' FROM d WHERE regexp_matches(regexp_extract(node, '[^.]*$'), '^[A-Z]'))
SELECT tree_id, regexp_replace(node, '\.__init__$', '') AS src, node AS dst FROM n WHERE ends_with(node, '.__init__') AND (tree_id, regexp_replace(node, '\.__init__$', '')) IN (SELECT (tree_id, node) FROM n)""")
def q_constructor_links(spark, d):
    """Constructor links of the nodes named like classes, each given an __init__."""
    e = edges(spark, d).where("tree_id IS NOT NULL")
    nodes = e.select("tree_id", F.col("src").alias("node")).union(e.select("tree_id", "dst")).where("node IS NOT NULL").distinct()
    made = nodes.where(F.regexp_extract("node", "[^.]*$", 0).rlike("^[A-Z]")).select("tree_id", F.concat("node", F.lit(".__init__")).alias("node"))
    return graph.constructor_links(nodes.unionByName(made).distinct(), ["tree_id"])


@query()
def q_brace_blocks(spark, d):
    return braces.blocks(blocks(spark, d, "tree_id", "file_path", "content", "kind").where("kind = 'file'").drop("kind").distinct())


@query()
def q_crop(spark, d):
    known = pipeline.reference_blocks(table(spark, d, "vuln_knowledge")).withColumn("block", F.struct("vuln_id", "role", "path", "start_line", "end_line"))
    files = blocks(spark, d, "tree_id", "file_path", "content", "kind").where("kind = 'file'").drop("kind").distinct()
    segments = segment.blocks(files).withColumn("path", c.norm_path(F.col("file_path"))).drop("tree_id", "file_path")
    return spans.crop(known, segments, ["path"], "block")


@query(hunk_sql.PATTERNS)
def q_patterns(spark, d):
    known = table(spark, d, "vuln_knowledge", "knowledge_key", "vuln_id", "desc_text", "patch_diff")
    p = decide.patterns(pipeline.one_each(known), pipeline.reference_blocks(known), rule_judge)
    texts = [n for n in decide.SECTIONS if not n.endswith("tests")]
    return p.select("vuln_id", *texts, F.size("positive_tests").cast("long").alias("n_positive"), F.size("negative_tests").cast("long").alias("n_negative"), *[F.array_join(f"{s}_spans", "\n").alias(f"{s}_spans") for s in ("vuln", "fix")])


@query(f"WITH {hunk_sql.CANDIDATES} SELECT vuln_id, tree_id, block_key, reason, round(similarity, 6) AS similarity FROM cand")
def q_candidates_direct(spark, d):
    """Candidates by similarity and name alone."""
    c = pipeline.candidates(pipeline.reference_blocks(table(spark, d, "vuln_knowledge")), _targets(spark, d))
    return c.select("vuln_id", "tree_id", "block_key", "reason", F.round("similarity", 6).alias("similarity"))


@query(hunk_sql.VERIFY)
def q_verify_direct(spark, d):
    """Verdicts on the candidates by similarity and name alone."""
    return pipeline.verify(table(spark, d, "vuln_knowledge"), _targets(spark, d))


@query(hunk_sql.DECIDE)
def q_decide_direct(spark, d):
    """The two-step decision, with the extracted patterns in its prompt, on the candidates by similarity and name alone."""
    known = table(spark, d, "vuln_knowledge")
    one, refs = pipeline.one_each(known), materialize(pipeline.reference_blocks(known), "references")
    chosen = pipeline.candidates(refs, _targets(spark, d)).select("vuln_id", "tree_id", "block_key")
    places = blocks(spark, d, "block_key", "file_path", "start_line", "end_line", "content").dropDuplicates(["block_key"])
    return decide.decide(one, chosen.join(places, "block_key"), rank.important_names(known), rule_judge, rule_judge, patterns=decide.patterns(one, refs, rule_judge))


@query()
def q_decide(spark, d):
    """The two-step decision on all candidates, shown as whole functions."""
    known = table(spark, d, "vuln_knowledge")
    code = _code(spark, d)
    nodes = context.nodes(code)
    refs = pipeline.reference_blocks(known, code, nodes)
    chosen = pipeline.candidates(refs, _targets(spark, d), code=code, nodes=nodes).select("vuln_id", "tree_id", "block_key")
    one = pipeline.one_each(known)
    shown, texts = context.shown_apart(materialize(chosen, "chosen"), code)
    return decide.decide(one, shown, rank.important_names(known), rule_judge, rule_judge, patterns=decide.patterns(one, refs, rule_judge), texts=texts)
