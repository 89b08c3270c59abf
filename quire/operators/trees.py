"""Chunks to merge trees: grouping, de-duplication, ordered assembly, evidence and roles.

Everything is keyed by file_id. trees() deals the chunks out by file once; the windows and groups after it keep that
partitioning, so there is one shuffle however many steps follow. A file's chunks are bounded by the decoder's limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.model import ADD_TITLE, BODY_RULE, HANDLE_BODY, HANDLE_TITLE, MAX_TITLE_CHARS, PACKAGE_BODY, PACKAGE_TITLE, TITLE_RULE, UNCLASSIFIED_RULE
from quire.operators.ordered import mark_copies


def members_of(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("member_index").isNotNull())


def payloads_of(decoded: DataFrame) -> DataFrame:
    """(file_id, member_index, member_file_offset, ordinal within the member, start, end, anchor, ..., chunk)."""
    rows = members_of(decoded).select("file_id", "member_index", F.col("file_offset").alias("member_file_offset"), F.posexplode("payloads").alias("ordinal", "p"))
    return rows.select("file_id", "member_index", "member_file_offset", "ordinal", "p.*")


def chunks_of(decoded: DataFrame) -> DataFrame:
    """One row per chunk, with the place that the framing gives it (J1 to J4, within its member's own index)."""
    m = members_of(decoded).select("file_id", "member_index", F.col("file_offset").alias("member_file_offset"), "envelope", F.explode("payloads").alias("p")).where("p.chunk IS NOT NULL")
    return m.withColumn("location", location_in(F.col("envelope"), F.col("member_index"), F.col("p.start"))).select("file_id", "member_index", "member_file_offset", "p.chunk.*", "location")


def location_in(envelope: Column, member_index: Column, offset: Column) -> Column:
    """Where an offset lies, by a member's own index: the first blob by id that holds it, its path, channel, package and handle.

    The index travels with the member, so no join is needed; operators.ordered.locate does the same between tables.
    """
    blob = F.get(F.filter(envelope["blobs"], lambda b: (offset >= b["start"]) & (offset < b["start"] + b["len"])), F.lit(0))
    segments = fx.path_segments(blob["path"])
    channel = F.get(segments, F.lit(0))
    package = F.get(F.filter(envelope["channels"], lambda c: c["channel_id"] == channel), F.lit(0))["package"]
    handle = F.get(F.filter(envelope["handles"], lambda h: F.regexp_replace(h["url"], "^/+", "") == channel), F.lit(0))["name"]
    parent = F.when(F.size(segments) > 1, channel)
    found = F.struct(member_index.alias("member_index"), blob["path"].alias("blob_path"), channel.alias("channel_id"), handle.alias("handle_name"), parent.alias("parent_channel"), package.alias("component_package"))
    return F.when(blob["path"].isNotNull(), found)


def is_self_contained(start: Column, count: Column, total: Column, actual: Column) -> Column:
    """The chunk is the whole tree: it starts at 0 and its count, stated or actual, is the total; without a total it is."""
    return (start == 0) & F.coalesce(F.coalesce(count, actual.cast("long")) == total, F.lit(True))


def group_key(start: Column, count: Column, total: Column, actual: Column, sha256: Column, length: Column, sequence: Column) -> Column:
    """What the chunks of one tree share: their hash if they are whole, else the three counters (nulls are equal). Ordered: whole ones first."""
    own = is_self_contained(start, count, total, actual)
    return F.struct(
        F.when(own, 0).otherwise(1).alias("split"),
        F.when(own, sha256).alias("sha256"),
        F.when(~own, total).alias("total_segment_count"),
        F.when(~own, length).alias("total_length_chars"),
        F.when(~own, sequence).alias("sequence_number"),
    )


def content_hash(digests: Column) -> Column:
    """SHA-256 over the raw bytes of hex digests."""
    return F.sha2(F.unhex(F.array_join(digests, "")), 256)


def evidence_of(segments: Column) -> Column:
    """What the segments of a tree show about its role and formatting."""
    known = F.filter(segments, lambda s: s["kind"] != "unknown")

    def count(kind: str) -> Column:
        return F.size(F.filter(segments, lambda s: s["kind"] == kind)).cast("long")

    def distinct(name: str) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.transform(known, lambda s: s[name]), lambda x: x.isNotNull())))

    def some(test) -> Column:
        return F.exists(known, lambda s: F.coalesce(test(s), F.lit(False)))

    return F.struct(
        count("text").alias("text_segments"), count("marker").alias("marker_segments"), count("unknown").alias("unknown_segments"),
        some(lambda s: s["placeholder"] == ADD_TITLE).alias("has_add_title_marker"), some(lambda s: s["bold"]).alias("has_bold"), some(lambda s: s["italic"]).alias("has_italic"),
        some(lambda s: fx.is_list(s["list_ref"])).alias("has_list_reference"), some(lambda s: s["link"].isNotNull()).alias("has_hyperlink"), some(lambda s: s["attributed"]).alias("has_attribution"),
        distinct("style").alias("style_references"), distinct("node_type").alias("node_types"), fx.preview(plain_text(segments)).alias("text_preview"),
    )


def plain_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["kind"] == "text"), lambda s: s["text"]), "")


def assemble(chunks: DataFrame) -> DataFrame:
    """One row per tree (without roles): key, segments in order, sources, copies, completeness, hash, evidence, location and warnings."""
    c = chunks.repartition("file_id")
    actual = F.size("segments").cast("long")
    c = c.withColumn("group_key", group_key(F.col("start_index"), F.col("segment_count"), F.col("total_segment_count"), actual, F.col("sha256"), F.col("total_length_chars"), F.col("sequence_number")))
    place, source = ["file_id", "group_key", "start_index"], ["member_index", "member_file_offset", "payload_offset"]
    c = mark_copies(c, place, source, "sha256")
    first_sha = F.first("sha256").over(Window.partitionBy(*place).orderBy(*source))
    c = c.withColumn("_same", F.when(F.col("sha256") == first_sha, F.col("location")))
    all_copies = Window.partitionBy(*place).orderBy(*source).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.withColumn("location", F.first("_same", ignorenulls=True).over(all_copies))
    at = F.struct(*source)
    kept = F.when(F.col("kept"), F.struct("start_index", "sha256", "location", "segments", "segment_count"))
    t = c.groupBy("file_id", "group_key").agg(
        F.min_by(F.struct("total_segment_count", "total_length_chars", "sequence_number"), F.struct("start_index", *source)).alias("key"),
        F.array_sort(F.collect_list(F.struct("start_index", at.alias("source")))).alias("sources"),
        F.array_sort(F.collect_list(kept)).alias("kept"),
        F.array_sort(F.collect_list(F.when(F.col("conflict"), F.struct("start_index", *source)))).alias("conflicts"),
        F.count(F.when(F.col("duplicate"), 1)).alias("duplicate_copies"),
    )
    t = t.withColumn("sources", F.transform("sources", lambda x: x["source"])).withColumn("segments", F.flatten(F.transform("kept", lambda k: k["segments"])))
    starts = F.transform("kept", lambda k: k["start_index"])
    expected = F.transform(F.col("kept"), lambda k, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(starts, i - 1) + F.size(F.get(F.col("kept"), i - 1)["segments"])))
    gaps = F.filter(F.zip_with(starts, expected, lambda s, e: F.struct(e.alias("expected"), s.alias("found"))), lambda g: g["expected"] != g["found"])
    t = t.withColumn("gaps", gaps).withColumn("complete", (F.size("gaps") == 0) & F.coalesce(F.col("key.total_segment_count") == F.size("segments"), F.lit(True)))
    t = t.withColumn("content_hash", content_hash(F.transform("kept", lambda k: k["sha256"]))).withColumn("evidence", evidence_of(F.col("segments")))
    t = t.withColumn("location", F.get(F.filter(F.transform("kept", lambda k: k["location"]), lambda x: x.isNotNull()), F.lit(0)))
    return t.withColumn("warnings", _tree_warnings()).withColumn("chunks", F.size("kept")).drop("kept", "conflicts", "gaps")


def _tree_warnings() -> Column:
    """Conflicts, then gaps, then incompleteness, as (code, message)."""
    number = F.coalesce(F.col("key.sequence_number").cast("string"), F.lit("none"))
    conflict = F.transform("conflicts", lambda x: F.struct(F.lit("chunk_conflict").alias("code"), F.concat(F.lit("a second, different chunk for segment "), x["start_index"].cast("string"), F.lit(" of tree number "), number, F.lit(" was left out; it came from member "), x["member_index"].cast("string")).alias("message")))
    gap = F.transform("gaps", lambda g: F.struct(F.lit("chunk_gap").alias("code"), F.concat(F.lit("tree number "), number, F.lit(": segment "), g["expected"].cast("string"), F.lit(" is due, but the next chunk starts at "), g["found"].cast("string")).alias("message")))
    message = F.concat(F.lit("tree number "), number, F.lit(" is not whole: "), F.size("segments").cast("string"), F.lit(" segment(s) found, "), F.coalesce(F.col("key.total_segment_count").cast("string"), F.lit("unknown")), F.lit(" stated"))
    short = F.when(~F.col("complete"), F.array(F.struct(F.lit("tree_incomplete").alias("code"), message.alias("message")))).otherwise(F.array().cast("array<struct<code:string,message:string>>"))
    return F.concat(conflict, gap, short)


def structural_role(location: Column) -> Column:
    """(role, kind, value) by the framing: the handle, then the package, else an embedded component; null without a place."""

    def role(name: str, kind: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("role"), F.lit(kind).alias("kind"), value.alias("value"))

    handle, package = location["handle_name"], location["component_package"]
    by_path = F.when(location["blob_path"].isNotNull(), role("embedded-component", "channel-path", location["blob_path"]))
    return (
        F.when(handle == HANDLE_TITLE, role("title", "fluid-handle", handle))
        .when(handle == HANDLE_BODY, role("body", "fluid-handle", handle))
        .when(package == PACKAGE_TITLE, role("title", "component-package", package))
        .when(package == PACKAGE_BODY, role("body", "component-package", package))
        .otherwise(by_path)
    )


def heuristic_roles(trees: DataFrame, by: str = "file_id", role: str = "role", order: str = "tree_index", length: str = "text_len", texts: str = "text_segments", lists: str = "has_list_reference") -> DataFrame:
    """Replaces role where a file has no `body`: the longest unconfirmed tree with text is the body candidate (the earliest of equal ones), other short ones without a list are title candidates. Adds rule."""
    file = Window.partitionBy(by)
    confirmed = F.coalesce(F.col(role).isin("title", "body"), F.lit(False))
    open_text = (F.col(texts) > 0) & ~confirmed
    best = F.max(F.when(open_text, F.struct(F.col(length).alias("n"), (-F.col(order)).alias("i")))).over(file)
    has_body = F.max(F.coalesce(F.col(role) == "body", F.lit(False))).over(file)
    title = open_text & (F.col(length) <= MAX_TITLE_CHARS) & ~F.col(lists)
    out = trees.withColumns({"_best": best, "_body": has_body})
    is_best = open_text & (F.col("_best.i") == -F.col(order))
    return out.withColumns({
        "rule": F.when(~F.col("_body") & is_best, BODY_RULE).when(~F.col("_body") & title, TITLE_RULE),
        role: F.when(~F.col("_body") & is_best, "body-candidate").when(~F.col("_body") & title, "title-candidate").otherwise(F.coalesce(F.col(role), F.lit("auxiliary"))),
    }).drop("_best", "_body")


def trees(chunks: DataFrame) -> DataFrame:
    """Assembled trees in their order (longest first, then first source) with role and role_evidence."""
    t = assemble(chunks).withColumn("text_len", F.coalesce("key.total_length_chars", F.lit(0)).cast("long"))
    order = Window.partitionBy("file_id").orderBy(F.desc("text_len"), F.element_at("sources", 1), "group_key")
    t = t.withColumn("tree_index", F.row_number().over(order) - 1).withColumn("framing", structural_role(F.col("location")))
    t = t.withColumns({"role": F.col("framing.role"), "text_segments": F.col("evidence.text_segments"), "has_list_reference": F.col("evidence.has_list_reference")})
    t = heuristic_roles(t)
    evidence = F.when(F.col("rule").isNotNull(), F.struct(F.lit("heuristic").alias("kind"), F.col("rule").alias("value")))
    evidence = evidence.when(F.col("framing").isNotNull(), F.struct(F.col("framing.kind").alias("kind"), F.col("framing.value").alias("value")))
    evidence = evidence.otherwise(F.struct(F.lit("heuristic").alias("kind"), F.lit(UNCLASSIFIED_RULE).alias("value")))
    return t.withColumn("role_evidence", evidence).drop("framing", "rule")


def pick_body(rows: DataFrame, by: str = "file_id", role: str = "role", order: str = "tree_index") -> DataFrame:
    """The first body of each file, else the first body candidate."""
    w = Window.partitionBy(by).orderBy(F.col(role) != "body", order)
    return rows.where(F.col(role).isin("body", "body-candidate")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
