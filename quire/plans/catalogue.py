"""The registered queries of the container engine: each operator on the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.functions.properties import property_class
from quire.model import FORMAT_COMPATIBLE, FORMAT_EMPTY, FORMAT_HIGH, FORMAT_KNOWN_EMPTY, FORMAT_NONE, PACKAGE_BODY, PACKAGE_TITLE, RECOGNISED_KEYS, RENDERED_KEYS, SEGMENTS
from quire.operators import blocks as bl
from quire.operators import identity, oplog, ordered, render, sets, trees
from quire.plans import adapters, outputs
from quire.plans.analysis import Analysis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(name: str):
    return F.col(name).cast("long").alias(name)


# ---- copies, gaps, runs


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def dedup_by_content_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return sets.count_copies(docs, "content_hash", "doc_id").withColumnRenamed("first", "first_doc")


@query("""
SELECT conv_id, role, turn, row_number() OVER w = 1 AS kept, row_number() OVER w > 1 AS duplicate, sha256(text) <> first_value(sha256(text)) OVER w AS conflict
FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)""")
def conflict_detection(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("digest", F.sha2("text", 256))
    return ordered.mark_copies(turns, ["conv_id", "role"], ["turn"], "digest").select("conv_id", "role", "turn", "kept", "duplicate", "conflict")


def _line_chunks(docs: DataFrame, size: int = 3) -> DataFrame:
    """Documents as chunks of some lines each, every chunk twice."""
    lines = F.split("text", "\n")
    total, no = F.size(lines).cast("long"), F.lit(None).cast("long")
    starts = F.explode(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(size)))
    c = docs.select(F.col("doc_id").cast("string").alias("file_id"), "text", total.alias("total_segment_count"), starts.alias("at"))
    part = F.slice(F.split("text", "\n"), F.col("at") + 1, size)
    segments = F.transform(part, adapters.text_segment)
    c = c.select("file_id", F.col("at").cast("long").alias("payload_offset"), F.col("at").cast("long").alias("start_index"), F.size(part).cast("long").alias("segment_count"), no.alias("length_chars"), F.length("text").cast("long").alias("total_length_chars"), "total_segment_count", F.lit(1).cast("long").alias("sequence_number"), F.sha2(F.array_join(part, "\n"), 256).alias("sha256"), segments.cast(SEGMENTS).alias("segments"))
    c = c.withColumn("location", F.lit(None).cast("struct<member_index:int,blob_path:string,channel_id:string,handle_name:string,parent_channel:string,component_package:string>")).withColumn("member_file_offset", F.lit(0).cast("long"))
    return c.withColumn("member_index", F.explode(F.array(F.lit(0), F.lit(1))))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST((n + 2) // 3 AS BIGINT) AS chunks, CAST((n + 2) // 3 AS BIGINT) AS duplicate_copies, true AS complete, CAST(n AS BIGINT) AS segments, sha256(replace(text, chr(10), '')) AS text_sha256
FROM (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents)""")
def chunk_reassembly(spark, sf_dir):
    t = trees.assemble(_line_chunks(table(spark, sf_dir, "documents")))
    return t.select("file_id", _long("chunks"), _long("duplicate_copies"), "complete", F.size("segments").cast("long").alias("segments"), F.sha2(trees.plain_text(F.col("segments")), 256).alias("text_sha256"))


@query("""
SELECT conv_id, turn, lag(turn + 1, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS expected, turn <> lag(turn + 1, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS gap
FROM conversations WHERE turn <> 2""")
def chunk_gap(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("turn <> 2").select("conv_id", "turn", F.lit(1).cast("long").alias("size"))
    return ordered.mark_gaps(turns, ["conv_id"], "turn", "size").select("conv_id", "turn", _long("expected"), "gap")


@query("SELECT doc_id, CAST(k - 1 AS BIGINT) AS pos, ls[k] AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)")
def segment_explode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return sets.parts_of(docs, "doc_id", "lines").select("doc_id", _long("pos"), "part")


@query("""
SELECT conv_id, turn, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run
FROM conversations""")
def block_segmentation(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return ordered.number_runs(turns, ["conv_id"], "turn", F.col("role") == "assistant").select("conv_id", "turn", _long("run"))


@query("""
SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island
FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL THEN 0 ELSE 1 END AS new FROM events)""")
def inline_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return ordered.number_islands(events, ["user_id"], "at", F.col("event_type")).select("event_id", "user_id", _long("island"))


def _listed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") != "system").alias("item"), (F.col("turn") % 3 == 2).alias("empty"), F.floor(F.col("turn") / 4).cast("string").alias("list_id"))


_LISTED_SQL = "SELECT conv_id, turn, role <> 'system' AS item, turn % 3 = 2 AS empty, turn // 4 AS list_id FROM conversations"


@query(f"""
WITH l AS ({_LISTED_SQL}), r AS (SELECT * FROM l WHERE NOT (item AND empty)),
n AS (SELECT *, CASE WHEN item AND lag(item) OVER w AND list_id = lag(list_id) OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS "group" FROM n""")
def list_runs_markdown(spark, sf_dir):
    rows = _listed(spark, sf_dir)
    return render.list_groups(rows, "conv_id", "turn", F.col("item"), F.col("empty"), F.col("list_id")).select("conv_id", "turn", _long("group"))


@query(f"""
WITH l AS ({_LISTED_SQL}), r AS (SELECT *, item AND NOT empty AS shown FROM l),
n AS (SELECT *, CASE WHEN shown AND lag(shown) OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS "group" FROM n""")
def list_runs_text(spark, sf_dir):
    rows = _listed(spark, sf_dir)
    return render.list_groups(rows, "conv_id", "turn", F.col("item"), F.col("empty"), None).select("conv_id", "turn", _long("group"))


# ---- lookups


@query("""
WITH r AS (SELECT doc_id, k AS line_no, sum(length(ls[k]) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(ls[k]) - 1 AS start, length(ls[k]) AS len
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)),
p AS (SELECT *, row_number() OVER () AS k FROM (SELECT doc_id, unnest([0, 0, n_chars // 3, n_chars // 2, n_chars, n_chars + 5]) AS pos FROM documents))
SELECT p.doc_id, CAST(p.pos AS BIGINT) AS pos, min(line_no) AS line_no FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND p.pos >= r.start AND p.pos < r.start + r.len GROUP BY p.doc_id, p.pos, p.k""")
def interval_locate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    points = docs.select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), F.floor(n / 3), F.floor(n / 2), n, n + 5)).alias("pos"))
    lines = F.split("text", "\n")
    sizes = F.transform(lines, lambda x: F.length(x).cast("long"))
    ends = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda k: k.cast("long"))
    ranges = docs.select("doc_id", F.posexplode(F.arrays_zip(sizes.alias("len"), ends.alias("line_no"))).alias("i", "x")).select("doc_id", "x.len", "x.line_no")
    from pyspark.sql import Window

    ranges = ranges.withColumn("start", F.sum(F.col("len") + 1).over(Window.partitionBy("doc_id").orderBy("line_no")) - F.col("len") - 1)
    return ordered.locate(points, ranges, ["doc_id"], "pos", "start", "len", "line_no").select("doc_id", "pos", "line_no")


@query("SELECT r_regionkey, r_name, (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey LIMIT 1) AS n_name FROM region")
def channel_package_lookup(spark, sf_dir):
    first = ordered.first_by(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name", "n_nationkey")
    region = table(spark, sf_dir, "region")
    return region.join(first.withColumnRenamed("n_regionkey", "r_regionkey"), "r_regionkey", "left").select("r_regionkey", "r_name", "n_name")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def role_semi(spark, sf_dir):
    return sets.having(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def role_anti(spark, sf_dir):
    return sets.having(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"], present=False)


@query(f"""
SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'body' WHEN 2 THEN 'title' WHEN 3 THEN 'body' WHEN 4 THEN 'embedded-component' END AS role,
       CASE n_nationkey % 6 WHEN 0 THEN 'HeaderComponentHandle' WHEN 1 THEN 'CanvasComponentHandle' WHEN 2 THEN '{PACKAGE_TITLE}' WHEN 3 THEN '{PACKAGE_BODY}' WHEN 4 THEN '/' || n_name END AS evidence
FROM nation""")
def structural_role(spark, sf_dir):
    k = F.col("n_nationkey") % 6
    location = F.struct(
        F.when(k == 0, "HeaderComponentHandle").when(k == 1, "CanvasComponentHandle").when(k == 2, "AnotherHandle").alias("handle_name"),
        F.when(k == 2, PACKAGE_TITLE).when(k.isin(0, 3), PACKAGE_BODY).when(k == 4, "Table").alias("component_package"),
        F.when(k != 5, F.concat(F.lit("/"), "n_name")).alias("blob_path"),
    )
    r = trees.structural_role(location)
    return table(spark, sf_dir, "nation").select("n_nationkey", r["role"].alias("role"), r["value"].alias("evidence"))


def _turns_as_trees(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "text", F.col("role").alias("speaker"), F.length("text").cast("long").alias("text_len"), F.lit(1).alias("text_segments"), (F.col("role") == "system").alias("has_list_reference"), F.lit(None).cast("string").alias("role"))


_ROLES_SQL = """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1 THEN 'body-candidate' WHEN length(text) <= 200 AND role <> 'system' THEN 'title-candidate' ELSE 'auxiliary' END AS kind FROM conversations"""


@query(f"SELECT conv_id, turn, kind AS role FROM ({_ROLES_SQL})")
def heuristic_roles(spark, sf_dir):
    return trees.heuristic_roles(_turns_as_trees(spark, sf_dir), "conv_id", order="turn").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS text_len FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1")
def body_argmax(spark, sf_dir):
    roles = trees.heuristic_roles(_turns_as_trees(spark, sf_dir), "conv_id", order="turn")
    return trees.pick_body(roles, "conv_id", order="turn").select("conv_id", "turn", "text_len")


@query(f"""
WITH r AS ({_ROLES_SQL}), c AS (SELECT conv_id, turn, text, role = 'user' AS bare, sha256(text) AS h FROM r WHERE kind = 'title-candidate'),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (bare) AS b FROM c GROUP BY conv_id),
p AS (SELECT c.*, n.n, n.b FROM c JOIN n ON n.conv_id = c.conv_id WHERE n.b = 0 OR c.bare OR n.n = 1)
SELECT conv_id, CASE WHEN min(n) = 1 OR min(b) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, arg_min(text, h) AS title,
       CASE WHEN min(n) = 1 THEN NULL WHEN min(b) = 1 THEN NULL ELSE count(*) END AS candidates FROM p GROUP BY conv_id""")
def title_selection(spark, sf_dir):
    rows = trees.heuristic_roles(_turns_as_trees(spark, sf_dir), "conv_id", order="turn")
    rows = rows.select("conv_id", "turn", "role", "text", (F.col("speaker") == "user").alias("bare"), F.sha2("text", 256).alias("digest"), F.lit("heuristic").alias("evidence"))
    got = bl.select_title(rows, "conv_id", "role", "turn", "text", "digest", "bare", "evidence")
    return got.select("conv_id", "outcome", "title", F.when(F.col("candidates").isNotNull(), F.size("candidates").cast("long")).alias("candidates"))


# ---- aggregates


@query(f"""
WITH c AS (SELECT source, count(*) AS members, count(*) FILTER (lang = 'en') AS payloads, count(*) FILTER (n_chars > 5000 AND lang = 'es') AS chunks, count(*) FILTER (lang = 'de') > 7 AS known FROM documents GROUP BY source)
SELECT source, CASE WHEN payloads = 0 THEN '{FORMAT_NONE}' WHEN chunks > 0 AND known THEN '{FORMAT_HIGH}' WHEN chunks > 0 THEN '{FORMAT_COMPATIBLE}' WHEN known THEN '{FORMAT_KNOWN_EMPTY}' ELSE '{FORMAT_EMPTY}' END AS format,
       CASE WHEN payloads = 0 THEN 'none' WHEN chunks > 0 AND known THEN 'high' WHEN chunks > 0 OR known THEN 'moderate' ELSE 'low' END AS confidence FROM c""")
def assessment(spark, sf_dir):
    count = lambda test: F.count(F.when(F.expr(test), 1))
    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("members"), count("lang = 'en'").alias("payloads"), count("n_chars > 5000 AND lang = 'es'").alias("chunks"), (count("lang = 'de'") > 7).alias("known"))
    return c.select("source", identity.assess(F.col("members"), F.col("payloads"), F.col("chunks"), F.col("known")).alias("a")).select("source", "a.*")


@query("SELECT lang, string_agg(source, ',' ORDER BY source) AS components, count(*) AS n FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def component_identity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.col("lang").alias("version"))
    got = identity.components(docs, "lang", "source", "version")
    return got.select("lang", F.array_join(F.transform("components", lambda c: c["name"]), ",").alias("components"), F.size("components").cast("long").alias("n"))


@query(f"""
SELECT c_custkey, key, CASE WHEN key IN ({", ".join(f"'{k}'" for k in RENDERED_KEYS)}) THEN 'rendered' WHEN key IN ({", ".join(f"'{k}'" for k in RECOGNISED_KEYS)}) OR starts_with(key, 'list!itemFormat-') OR starts_with(key, 'list!list-') OR (starts_with(key, '@') AND length(key) > 1) THEN 'recognised' ELSE 'unknown' END AS class
FROM (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'format!bold' WHEN 1 THEN 'markerId' WHEN 2 THEN '@' || c_mktsegment WHEN 3 THEN '@' WHEN 4 THEN 'list!itemFormat-' || c_nationkey WHEN 5 THEN 'nodeType' WHEN 6 THEN 'list!list-' || c_name ELSE c_mktsegment END AS key FROM customer)""")
def property_classes(spark, sf_dir):
    k = F.col("c_custkey") % 8
    key = F.when(k == 0, "format!bold").when(k == 1, "markerId").when(k == 2, F.concat(F.lit("@"), "c_mktsegment")).when(k == 3, "@").when(k == 4, F.concat(F.lit("list!itemFormat-"), F.col("c_nationkey").cast("string"))).when(k == 5, "nodeType").when(k == 6, F.concat(F.lit("list!list-"), "c_name")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key")).withColumn("class", property_class(F.col("key")))


@query("SELECT event_type, k AS key, 'unknown' AS class, count(*) AS occurrences FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2")
def property_usage(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return identity.property_usage(keys, "event_type", "key").select("event_type", "key", "class", "occurrences")


_KIND_SQL = "CASE event_type WHEN 'click' THEN 'insert' WHEN 'view' THEN 'remove' WHEN 'purchase' THEN 'annotate' ELSE 'unknown' END"


def _kinds():
    e = F.col("event_type")
    return F.when(e == "click", "insert").when(e == "view", "remove").when(e == "purchase", "annotate").otherwise("unknown").alias("kind")


@query(f"""
SELECT user_id, count(*) AS records, count(*) FILTER (k = 'insert') AS inserts, count(*) FILTER (k = 'remove') AS removes, count(*) FILTER (k = 'annotate') AS annotates, count(*) FILTER (k = 'unknown') AS unknown
FROM (SELECT user_id, {_KIND_SQL} AS k FROM events) GROUP BY user_id""")
def operation_counts(spark, sf_dir):
    return oplog.counts(table(spark, sf_dir, "events").select("user_id", _kinds()), "user_id")


@query("""
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY inserts DESC, address) AS rank
FROM (SELECT user_id, user_id || '/' || (event_id % 3) AS address, count(*) AS inserts FROM events WHERE event_type = 'click' GROUP BY 1, 2)""")
def addresses_by_inserts(spark, sf_dir):
    ops = table(spark, sf_dir, "events").select("user_id", _kinds(), fx.address(F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")).alias("address"))
    return oplog.inserts_by_address(ops, "user_id").select("user_id", "address", "inserts", _long("rank"))


@query("SELECT conv_id, role, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def delta_dedup(spark, sf_dir):
    return ordered.first_occurrences(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn"]).select("conv_id", "role", "turn")


@query("""
SELECT conv_id, bool_and(coalesce(turn = before + 1, false)) AS follows FROM (SELECT conv_id, turn, lag(turn, 1, -1) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations) GROUP BY conv_id""")
def follows_snapshot(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("turn", 1, -1).over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("before", before)
    return oplog.follows_snapshot(rows, "conv_id", "before", "turn")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN (CASE WHEN l_returnflag = 'R' THEN true ELSE l_quantity = 10 * floor(l_quantity / 10) END) ELSE false END AS whole FROM lineitem")
def self_contained(spark, sf_dir):
    li, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    total = F.when(F.col("l_returnflag") != "R", F.floor(q / 10) * 10)
    count = F.when(F.col("l_linestatus") == "O", q.cast("long"))
    return li.select("l_orderkey", "l_linenumber", trees.is_self_contained(F.col("l_linenumber") - 1, count, total, q.cast("long")).alias("whole"))


# ---- scalar functions


@query("SELECT doc_id, replace(left(text, 80), chr(10), ' ') AS preview FROM documents")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.preview(F.col("text")).alias("preview"))


@query("SELECT conv_id, turn, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS units FROM conversations")
def utf16_length(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fx.utf16_length(F.col("text")).alias("units"))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(t, '([\\*_`\[\]])', '\\\1', 'g'), '^([#>+-])', '\\\1') AS escaped FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def markdown_escape(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", fx.escape_markdown(title).alias("escaped"))


@query(r"SELECT c_custkey, CASE WHEN trim(t) = '' THEN t ELSE regexp_extract(t, '^ *') || '**' || trim(t) || '**' || regexp_extract(t, ' *$') END AS bold FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  ' || c_name WHEN 1 THEN c_name || ' ' WHEN 2 THEN '   ' ELSE ' ' || c_mktsegment || '  ' END AS t FROM customer)")
def emphasis(spark, sf_dir):
    k = F.col("c_custkey") % 4
    t = F.when(k == 0, F.concat(F.lit("  "), "c_name")).when(k == 1, F.concat("c_name", F.lit(" "))).when(k == 2, "   ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")))
    return table(spark, sf_dir, "customer").select("c_custkey", fx.emphasise(t, "**").alias("bold"))


@query("SELECT page_id, replace(replace(url || ' (' || page_id || ')', ' ', '%20'), ')', '%29') AS target FROM pages")
def link_target(spark, sf_dir):
    url = F.concat("url", F.lit(" ("), F.col("page_id").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "pages").select("page_id", fx.escape_target(url).alias("target"))


@query("""
SELECT page_id, array_to_string(list_filter(list_transform(range(1, len(p)), lambda i: CASE WHEN p[i] = 'en' THEN p[i + 1] END), lambda x: x IS NOT NULL), ',') AS segments
FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)""")
def path_segments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(fx.path_segments(F.col("url"), "en"), ",").alias("segments"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size BETWEEN 1 AND 6 THEN p_size END AS level FROM part")
def heading_level(spark, sf_dir):
    style = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Heading  "), F.col("p_size").cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("heading "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", fx.heading_level(style).alias("level"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) END AS depth, CASE WHEN p_size % 3 < 2 THEN p_brand || ';x' END AS list_id FROM part")
def list_reference(spark, sf_dir):
    k, n, brand = F.col("p_size") % 3, F.col("p_size").cast("string"), F.concat("p_brand", F.lit(";x"))
    ref = F.when(k == 0, F.concat(n, F.lit(";"), brand)).when(k == 1, F.concat(F.lit(" "), n, F.lit(";"), brand)).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", fx.list_depth(ref).alias("depth"), fx.list_id(ref).alias("list_id"))


@query("SELECT c_custkey, key FROM (SELECT c_custkey, unnest(['attribution', '@' || c_mktsegment, '@', c_mktsegment]) AS key FROM customer) WHERE NOT (key = 'attribution' OR (starts_with(key, '@') AND length(key) > 1))")
def personal_data_filter(spark, sf_dir):
    keys = F.array(F.lit("attribution"), F.concat(F.lit("@"), "c_mktsegment"), F.lit("@"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(keys).alias("key")).where(~fx.is_personal(F.col("key")))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS shown FROM (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY doc_id")
def empty_block_filter(spark, sf_dir):
    lines = F.split(F.replace("text", F.lit(". "), F.lit(".\n\n")), "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(lines).alias("line"))
    return rows.where(~bl.is_empty(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("shown"))


# ---- operations


def _turn_ops(spark, sf_dir, removes: bool) -> DataFrame:
    """Each turn inserted at the front; with removes, the first character of each goes again before the next comes."""
    turns = table(spark, sf_dir, "conversations").where(F.length("text") > 0)
    none = F.lit(None).cast(SEGMENTS)
    insert = F.struct((F.col("turn") * 2).alias("op_ordinal"), F.lit("insert").alias("kind"), F.lit(0).cast("long").alias("pos1"), F.lit(None).cast("long").alias("pos2"), F.array(adapters.text_segment(F.col("text"))).alias("segments"))
    remove = F.struct((F.col("turn") * 2 + 1).alias("op_ordinal"), F.lit("remove").alias("kind"), F.lit(0).cast("long").alias("pos1"), F.lit(1).cast("long").alias("pos2"), none.alias("segments"))
    ops = turns.select("conv_id", F.explode(F.array(insert, remove) if removes else F.array(insert)).alias("o")).select("conv_id", "o.*")
    logs = oplog.log_of(ops, "conv_id").withColumn("base", F.array().cast(SEGMENTS))
    return oplog.replay(logs, "conv_id").select("conv_id", trees.plain_text(F.col("segments")).alias("text"), "applied", "skipped")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn DESC) AS text, count(*) AS applied, CAST(0 AS BIGINT) AS skipped FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def replay_inserts(spark, sf_dir):
    return _turn_ops(spark, sf_dir, False)


@query("SELECT conv_id, string_agg(substr(text, 2), '' ORDER BY turn DESC) AS text, 2 * count(*) AS applied, CAST(0 AS BIGINT) AS skipped FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def replay_removes(spark, sf_dir):
    return _turn_ops(spark, sf_dir, True)


@query("""
SELECT conv_id, CASE WHEN s > 0 OR u = 0 THEN 'snapshot' WHEN a > 2 THEN 'snapshot-plus-operations' ELSE 'operations' END AS content_source
FROM (SELECT conv_id, count(*) FILTER (role = 'system') AS s, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)""")
def content_source(spark, sf_dir):
    count = lambda r: F.count(F.when(F.col("role") == r, 1))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(count("system").alias("s"), count("user").alias("u"), count("assistant").alias("a"))
    return c.select("conv_id", bl.content_source(F.col("s"), F.col("u") > 0, F.col("a") > 2).alias("content_source"))


# ---- rendering


_ESCAPED = r"regexp_replace(regexp_replace(line, '([\\*_`\[\]])', '\\\1', 'g'), '^([#>+-])', '\\\1')"


def _document_blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "text", "source")
    titles = docs.select("file_id", F.when(F.col("source") != "src1", F.col("source")).alias("title"))
    return bl.blocks(docs.select("file_id", adapters.paragraphs(F.col("text")).alias("segments"))), titles


@query(rf"""
SELECT file_id, CASE WHEN source <> 'src1' THEN '# ' || source || chr(10) ELSE '' END || CASE WHEN source <> 'src1' AND body <> '' THEN chr(10) ELSE '' END || CASE WHEN body = '' THEN '' ELSE body || chr(10) END AS rendered
FROM (SELECT CAST(doc_id AS VARCHAR) AS file_id, source, coalesce(string_agg({_ESCAPED}, chr(10) || chr(10) ORDER BY k) FILTER (line <> ''), '') AS body
      FROM (SELECT doc_id, source, k, ls[k] AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)) GROUP BY doc_id, source)""")
def markdown_render(spark, sf_dir):
    return render.markdown(*_document_blocks(spark, sf_dir))


@query("""
SELECT file_id, CASE WHEN source <> 'src1' THEN source || chr(10) ELSE '' END || CASE WHEN source <> 'src1' AND body <> '' THEN chr(10) ELSE '' END || CASE WHEN body = '' THEN '' ELSE body || chr(10) END AS rendered
FROM (SELECT CAST(doc_id AS VARCHAR) AS file_id, source, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY k) FILTER (line <> ''), '') AS body
      FROM (SELECT doc_id, source, k, ls[k] AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)) GROUP BY doc_id, source)""")
def text_render(spark, sf_dir):
    return render.plain(*_document_blocks(spark, sf_dir))


# ---- whole containers


_MARKDOWN_SQL = rf"""
SELECT CAST(doc_id AS VARCHAR) AS file_id, coalesce(string_agg({_ESCAPED}, chr(10) || chr(10) ORDER BY k) FILTER (line <> ''), '') AS body
FROM (SELECT doc_id, k, ls[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)) GROUP BY doc_id"""


def _plain(spark, sf_dir, **options) -> Analysis:
    return Analysis(adapters.encoded(table(spark, sf_dir, "documents"), "doc_id", ["text"], adapters.plain_container), **options)


def _framed(spark, sf_dir, **options) -> Analysis:
    return Analysis(adapters.encoded(table(spark, sf_dir, "documents"), "doc_id", ["source", "text"], adapters.framed_container), **options)


def _logged(spark, sf_dir, **options) -> Analysis:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    return Analysis(adapters.encoded(turns, "conv_id", ["turns"], adapters.logged_container), **options)


@query(f"SELECT file_id, CASE WHEN body = '' THEN '' ELSE body || chr(10) END AS rendered FROM ({_MARKDOWN_SQL})")
def container_roundtrip(spark, sf_dir):
    """Documents into containers with a copied chunk and back to Markdown, without framing: roles are heuristic."""
    return _plain(spark, sf_dir).rendered("markdown")


@query(f"SELECT d.file_id, '# ' || s.source || chr(10) || CASE WHEN body = '' THEN '' ELSE chr(10) || body || chr(10) END AS rendered FROM ({_MARKDOWN_SQL}) d JOIN (SELECT CAST(doc_id AS VARCHAR) AS file_id, source FROM documents) s ON s.file_id = d.file_id")
def envelope_roundtrip(spark, sf_dir):
    """Documents into framed containers and back: title and body are found by handle and package."""
    return _framed(spark, sf_dir).rendered("markdown")


@query("SELECT CAST(conv_id AS VARCHAR) AS file_id, substr(string_agg(text, '' ORDER BY turn), 2) || chr(10) AS rendered FROM conversations GROUP BY conv_id")
def oplog_roundtrip(spark, sf_dir):
    """Conversations into operation logs and back: the body is replayed."""
    return _logged(spark, sf_dir).rendered("text")


@query("SELECT CAST(conv_id AS VARCHAR) AS file_id, 'operations' AS content_source, count(*) + 1 AS applied, CAST(0 AS BIGINT) AS skipped, true AS confirmed FROM conversations GROUP BY conv_id")
def oplog_replay_summary(spark, sf_dir):
    d = _logged(spark, sf_dir).documents
    return d.select("file_id", "content_source", "applied", "skipped", "confirmed")


@query("SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(0 AS BIGINT) AS rejected, CAST(3 AS BIGINT) AS members, CAST(3 AS BIGINT) AS payloads, CAST(2 AS BIGINT) AS chunks, 'high' AS confidence, CAST(1 AS BIGINT) AS trees, CAST(1 AS BIGINT) AS duplicates, CAST(2 * len(string_split(text, chr(10))) AS BIGINT) AS segments FROM documents")
def inspect_summary(spark, sf_dir):
    """Counts of the inspect report of each container."""
    r = outputs.reports(_plain(spark, sf_dir))
    at = lambda path: F.get_json_object("rendered", path)
    names = {"rejected": "$.gzip_candidates_rejected", "members": "$.gzip_members_inflated", "payloads": "$.json_payloads", "chunks": "$.merge_tree_chunk_candidates", "trees": "$.merge_trees", "duplicates": "$.duplicate_copies_collapsed", "segments": "$.trees[0].assembled_segments"}
    return r.select("file_id", at("$.format.confidence").alias("confidence"), *[at(p).cast("long").alias(n) for n, p in names.items()])


@query("""
SELECT CAST(doc_id AS VARCHAR) AS file_id, source AS title, 'resolved' AS outcome, CAST(len(string_split(text, chr(10))) AS BIGINT) AS paragraphs, string_split(text, chr(10))[1] AS first_line, CAST(3 AS BIGINT) AS merge_trees, 'snapshot' AS content_source FROM documents""")
def json_roundtrip(spark, sf_dir):
    """Facts of the JSON document of each framed container."""
    r = outputs.json_documents(_framed(spark, sf_dir))
    at = lambda path: F.get_json_object("rendered", path)
    blocks = F.size(F.from_json(at("$.blocks"), "array<string>")).cast("long")
    return r.select("file_id", at("$.title").alias("title"), at("$.metadata.title_selection.outcome").alias("outcome"), blocks.alias("paragraphs"), F.coalesce(at("$.blocks[0].content[0].text"), F.lit("")).alias("first_line"), at("$.metadata.merge_trees").cast("long").alias("merge_trees"), at("$.metadata.content_source").alias("content_source"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS file_id, unnest(['member-000.raw', 'member-001.raw', 'member-002.raw', 'member-000-fragment-000.json', 'member-001-fragment-000.json', 'member-002-fragment-000.json']) AS name FROM documents""")
def payload_dump(spark, sf_dir):
    return outputs.dump(_plain(spark, sf_dir, with_data=True, with_values=True)).select("file_id", "name")


@query("""
SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(stage AS INTEGER) AS stage, code FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (1, 'body_rebuilt_from_operations')) x(stage, code)""")
def warnings_union(spark, sf_dir):
    """Diagnostics of both stages of the logged containers."""
    return outputs.diagnostics(_logged(spark, sf_dir)).select("file_id", "stage", "code")


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS file_id, role, value FROM documents, (VALUES ('title', '{PACKAGE_TITLE}'), ('body', 'CanvasComponentHandle'), ('embedded-component', '/.app/.channels/C/content')) x(role, value)""")
def framed_roles(spark, sf_dir):
    """Role and evidence of each tree of the framed containers."""
    return _framed(spark, sf_dir).trees.select("file_id", "role", F.col("role_evidence.value").alias("value"))


