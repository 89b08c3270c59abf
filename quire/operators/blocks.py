"""Segments to blocks and inlines, and the choice of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.model import MARKER_ID, NODE_TYPE, TITLE_BARE, TITLE_BY_HANDLE, TITLE_BY_PACKAGE, TITLE_SOLE
from quire.operators.ordered import number_islands, number_runs
from quire.operators.trees import plain_text

INLINES = "array<struct<text:string,bold:boolean,italic:boolean,link:string>>"


def block_of(style: Column, list_ref: Column, node_type: Column) -> Column:
    """(kind, level, depth, list_id, node_type) by the marker that closes a run: heading, list item, embedded or paragraph."""
    level = fx.heading_level(style)
    is_list, embedded = level.isNull() & fx.is_list(list_ref), F.coalesce(node_type != "Paragraph", F.lit(False))
    kind = F.when(level.isNotNull(), "heading").when(is_list, "list-item").when(embedded, "embedded").otherwise("paragraph")
    return F.struct(
        kind.alias("kind"), level.alias("level"), F.when(is_list, F.coalesce(fx.list_depth(list_ref), F.lit(0).cast("long"))).alias("depth"),
        F.when(is_list, fx.list_id(list_ref)).alias("list_id"), F.when(kind == "embedded", node_type).alias("node_type"),
    )


def blocks(bodies: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, block_index, kind, level, depth, list_id, node_type, inlines, plain, props, raw) of rows (key, segments).

    A marker closes the run of texts before it; an unknown segment is a block of its own and closes nothing; texts after
    the last marker are a block. Neighbouring texts of one run and one style make one inline; empty ones go, but part.
    """
    seg = bodies.select(key, F.posexplode("segments").alias("idx", "s")).select(key, "idx", "s.*").repartition(key)
    seg = number_runs(seg, [key], "idx", F.col("kind") == "marker")
    seg = seg.withColumns({"bold": F.coalesce("bold", F.lit(False)), "italic": F.coalesce("italic", F.lit(False))})
    seg = number_islands(seg, [key, "run", "kind"], "idx", F.struct("bold", "italic", "link"))
    pieces = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("t"))))
    parts = seg.where("kind != 'unknown'").groupBy(key, "run", "kind", "island").agg(
        F.min("idx").alias("idx"), F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("text"),
        *[F.first(c).alias(c) for c in ("bold", "italic", "link")], *[F.min_by(c, "idx").alias(c) for c in ("style", "list_ref", "node_type", "props")],
    )
    is_text, is_marker = F.col("kind") == "text", F.col("kind") == "marker"
    closed = parts.groupBy(key, "run").agg(
        F.array_sort(F.collect_list(F.when(is_text & (F.col("text") != ""), F.struct("idx", "text", "bold", "italic", "link")))).alias("found"),
        F.max(F.when(is_marker, F.struct("idx", "style", "list_ref", "node_type", "props"))).alias("m"),
    )
    inlines = F.transform("found", lambda x: F.struct(x["text"].alias("text"), x["bold"].alias("bold"), x["italic"].alias("italic"), x["link"].alias("link")))
    own = closed.select(key, F.coalesce(F.col("m.idx"), F.lit(2147483647)).alias("at"), block_of(F.col("m.style"), F.col("m.list_ref"), F.col("m.node_type")).alias("b"), inlines.alias("inlines"), F.coalesce("m.props", F.lit("{}")).alias("props"))
    own = own.select(key, "at", "b.*", "inlines", "props", F.lit(None).cast("string").alias("raw"))
    unknown = seg.where("kind = 'unknown'").select(key, F.col("idx").alias("at"), F.lit("unknown").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("depth", "long"), ("list_id", "string"), ("node_type", "string"))], F.array().cast(INLINES).alias("inlines"), F.lit(None).cast("string").alias("props"), "raw")
    out = own.unionByName(unknown)
    index = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return out.withColumn("block_index", index).drop("at").withColumn("plain", plain_inlines(F.col("inlines")))


def plain_inlines(inlines: Column) -> Column:
    return F.array_join(F.transform(inlines, lambda x: x["text"]), "")


def is_empty(plain: Column) -> Column:
    """A block without text; white space counts as text."""
    return F.length(plain) == 0


def is_bare(segments: Column) -> Column:
    """Nothing about the tree's properties says more than a plain title."""
    text_keys, marker_keys = [F.lit("attribution")], [F.lit(x) for x in (MARKER_ID, NODE_TYPE, "attribution")]

    def plain(s: Column) -> Column:
        return F.when(s["kind"] == "text", F.size(F.array_except(s["keys"], F.array(*text_keys))) == 0).when(s["kind"] == "marker", F.size(F.array_except(s["keys"], F.array(*marker_keys))) == 0).otherwise(False)

    return F.forall(segments, plain)


def title_text(segments: Column) -> Column:
    return fx.unicode_trim(plain_text(segments))


def select_title(trees: DataFrame, by: str = "file_id", role: str = "role", order: str = "tree_index", text: str = "text", digest: str = "content_hash", bare: str = "bare", evidence: str = "evidence_kind") -> DataFrame:
    """(key, outcome, title, rule, candidates): of the trees of each key.

    The first title tree; else the sole candidate; else the sole bare one; else the one of least hash among the bare ones,
    or all if none is bare, with all of that pool listed in tree order. No row for a key without either.
    """
    is_title, is_candidate = F.col(role) == "title", F.col(role) == "title-candidate"
    entry = F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(digest).alias("h"), F.col(bare).alias("b"))
    got = trees.where(is_title | is_candidate).groupBy(by).agg(
        F.min(F.when(is_title, F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(evidence).alias("e")))).alias("sure"),
        F.array_sort(F.collect_list(F.when(is_candidate, entry))).alias("all"),
    )
    some = F.filter("all", lambda x: x["b"])
    got = got.withColumn("pool", F.when(F.size(some) > 0, some).otherwise(F.col("all")))
    least = F.array_min(F.transform("pool", lambda x: F.struct(x["h"].alias("h"), x["o"].alias("o"), x["t"].alias("t"))))
    sure, sole, only = F.col("sure").isNotNull(), F.size("all") == 1, F.size(some) == 1
    rule = F.when(sure, F.when(F.col("sure.e") == "fluid-handle", TITLE_BY_HANDLE).otherwise(TITLE_BY_PACKAGE)).when(sole, TITLE_SOLE).when(only, TITLE_BARE)
    title = F.when(sure, F.col("sure.t")).when(sole, F.get("all", F.lit(0))["t"]).when(only, F.get("pool", F.lit(0))["t"]).otherwise(least["t"])
    return got.select(by, F.when(rule.isNotNull(), "resolved").otherwise("ambiguous").alias("outcome"), title.alias("title"), rule.alias("rule"), F.when(rule.isNull(), F.transform("pool", lambda x: x["t"])).alias("candidates"))


def content_source(snapshot_texts: Column, replayed: Column, seeded: Column) -> Column:
    """snapshot, operations or snapshot-plus-operations: the log counts only where the snapshot's body holds no text."""
    by_log = (F.coalesce(snapshot_texts, F.lit(0)) == 0) & F.coalesce(replayed, F.lit(False))
    return F.when(by_log & F.coalesce(seeded, F.lit(False)), "snapshot-plus-operations").when(by_log, "operations").otherwise("snapshot")
