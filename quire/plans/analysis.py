"""Analysis: what the containers of a table hold, as a set of DataFrames built on demand."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.model import KNOWN_COMPONENTS, SEGMENTS, Limits
from quire.operators import blocks as bl
from quire.operators import identity, oplog, render, trees
from quire.sources import containers

_WARNING = "array<struct<code:string,message:string,member_index:int,file_offset:bigint,rejected:boolean>>"


def _warnings(*items: tuple[Column, str, Column]) -> Column:
    """Warnings without a place: (condition, code, message)."""
    rows = [F.when(condition, F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(None).cast("int").alias("member_index"), F.lit(None).cast("long").alias("file_offset"), F.lit(False).alias("rejected"))) for condition, code, message in items]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


class Analysis:
    """Consumers (documents, reports, dumps) share one decode, so that they cannot disagree.

    files has (file_id, content) and may have extension. What several results share is kept on disk by Spark: call release()
    when done. Files without content are in `input_errors`, not in the rest.
    """

    def __init__(self, files: DataFrame, limits: Limits = Limits(), discovery: str = "fragment", with_data: bool = False, with_values: bool = False):
        self.files, self.input_errors = containers.split_empty(files)
        self._args = (limits, discovery, with_data, with_values)
        self._held: list[DataFrame] = []

    @classmethod
    def of_paths(cls, spark: SparkSession, *paths: str, glob: str | None = None, **options) -> Analysis:
        return cls(containers.read(spark, *paths, glob=glob), **options)

    def _kept(self, df: DataFrame) -> DataFrame:
        """Kept on the executors' disks, as several results are drawn from it; a lost block is computed again."""
        out = df.persist(StorageLevel.DISK_ONLY)
        self._held.append(out)
        return out

    @cached_property
    def decoded(self) -> DataFrame:
        return self._kept(containers.decode(self.files, *self._args))

    def release(self) -> None:
        """Drops what is kept."""
        while self._held:
            self._held.pop().unpersist()

    # ---- scan

    @cached_property
    def scans(self) -> DataFrame:
        """(file_id, file_size, signatures, failed, scan_warnings): one row per file."""
        return self.decoded.where("member_index IS NULL").select("file_id", "file_size", F.col("candidates").alias("signatures"), "failed", F.col("warnings").alias("scan_warnings"))

    @cached_property
    def members(self) -> DataFrame:
        chunks = F.size(F.filter("payloads", lambda p: p["chunk"].isNotNull())).cast("long")
        status = F.struct(F.col("envelope.outcome").alias("outcome"), F.col("envelope.reason").alias("reason"), F.col("envelope.paths").alias("blob_paths"), F.size("envelope.channels").alias("channels"))
        return trees.members_of(self.decoded).select("file_id", "member_index", "file_offset", "compressed_len", "data_len", "utf8", "truncated", "partial", "sha256", F.size("payloads").cast("long").alias("json_payloads"), chunks.alias("merge_tree_chunks"), status.alias("envelope"), "data")

    @cached_property
    def failed_candidates(self) -> DataFrame:
        return self.scans.select("file_id", F.explode("failed").alias("f")).select("file_id", "f.*")

    @cached_property
    def payloads(self) -> DataFrame:
        return trees.payloads_of(self.decoded)

    @cached_property
    def chunks(self) -> DataFrame:
        return trees.chunks_of(self.decoded)

    @cached_property
    def envelopes(self) -> DataFrame:
        return trees.members_of(self.decoded).where("envelope.outcome = 'decoded'").select("file_id", "member_index", "envelope.*")

    def _index(self, name: str) -> DataFrame:
        return self.envelopes.select("file_id", "member_index", F.explode(name).alias("x")).select("file_id", "member_index", "x.*")

    @property
    def blobs(self) -> DataFrame:
        return self._index("blobs")

    @property
    def channels(self) -> DataFrame:
        return self._index("channels")

    @property
    def handles(self) -> DataFrame:
        return self._index("handles")

    # ---- trees and operations

    @cached_property
    def trees(self) -> DataFrame:
        return self._kept(trees.trees(self.chunks))

    @cached_property
    def deltas(self) -> DataFrame:
        return oplog.deltas_of(self.decoded)

    @cached_property
    def ops(self) -> DataFrame:
        return self._kept(oplog.operations(self.deltas))

    @cached_property
    def inserts(self) -> DataFrame:
        return oplog.inserts_by_address(self.ops)

    @cached_property
    def follows(self) -> DataFrame:
        return oplog.follows_snapshot(self.envelopes, "file_id", "snapshot_seq", "first_delta_seq")

    # ---- identity

    @cached_property
    def components(self) -> DataFrame:
        return identity.components(self.payloads.where("has_package").select("file_id", F.col("package_name").alias("name"), F.col("package_version").alias("version")))

    @cached_property
    def payloads_by_anchor(self) -> DataFrame:
        return identity.payload_counts(self.payloads)

    @cached_property
    def properties(self) -> DataFrame:
        keys = self.trees.select("file_id", F.explode("segments").alias("s")).select("file_id", F.explode("s.keys").alias("key"))
        return identity.property_usage(keys)

    @cached_property
    def assessment(self) -> DataFrame:
        """(file_id, file_size, signatures, rejected, members, payloads, chunks, bytes, components, format, confidence)."""
        m = self.members.groupBy("file_id").agg(F.count("*").alias("members"), F.sum("json_payloads").alias("payloads"), F.sum("merge_tree_chunks").alias("chunks"), F.sum("data_len").alias("bytes"))
        out = self.scans.select("file_id", "file_size", "signatures", F.size("failed").cast("long").alias("rejected")).join(m, "file_id", "left").na.fill(0, ["members", "payloads", "chunks", "bytes"])
        out = out.join(self.components, "file_id", "left").withColumn("components", F.coalesce("components", F.array().cast("array<struct<name:string,version:string>>")))
        known = identity.is_known(F.transform("components", lambda c: c["name"]))
        return out.withColumn("known", known).withColumn("a", identity.assess(F.col("members"), F.col("payloads"), F.col("chunks"), F.col("known"))).select("*", "a.*").drop("a")

    @cached_property
    def warnings(self) -> DataFrame:
        """(file_id, warnings): of the analysis, in order: scan, rejected, members, trees, identity, properties."""
        by_member = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("member_index", "warnings"))), lambda x: x["warnings"]))
        members = trees.members_of(self.decoded).groupBy("file_id").agg(by_member.alias("w_members"))
        flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("group_key", "warnings"))), lambda x: x["warnings"]))
        of_trees = self.trees.groupBy("file_id").agg(flat.alias("w"))
        of_trees = of_trees.select("file_id", F.transform("w", lambda x: F.struct(x["code"].alias("code"), x["message"].alias("message"), F.lit(None).cast("int").alias("member_index"), F.lit(None).cast("long").alias("file_offset"), F.lit(False).alias("rejected"))).alias("w_trees"))
        unknown = self.properties.where("class = 'unknown'").groupBy("file_id").agg(F.array_sort(F.collect_list("key")).alias("unknown"))
        out = self.scans.join(members, "file_id", "left").join(of_trees, "file_id", "left").join(self.assessment.select("file_id", "known"), "file_id", "left").join(unknown, "file_id", "left")
        own = _warnings(
            (~F.col("known"), "component_identity_missing", F.lit("none of the known components is named: " + ", ".join(KNOWN_COMPONENTS))),
            (F.col("unknown").isNotNull(), "unknown_properties", F.concat(F.size("unknown").cast("string"), F.lit(" property name(s) without a known meaning, kept as they are: "), F.array_join("unknown", ", "))),
        )
        empty = F.array().cast(_WARNING)
        return out.select("file_id", F.concat("scan_warnings", F.coalesce("w_members", empty), F.coalesce("w_trees", empty), own).alias("warnings"))

    # ---- documents

    @cached_property
    def has_logs(self) -> bool:
        """Whether any file holds operations; without, the plan of documents is spared the replay. Reads the decoded table."""
        return not self.envelopes.where(F.size("deltas") > 0).isEmpty()

    @cached_property
    def bodies(self) -> DataFrame:
        return trees.pick_body(self.trees).select("file_id", F.col("segments").alias("body_segments"), "text_segments", "content_hash")

    @cached_property
    def replays(self) -> DataFrame:
        """Of files whose snapshot holds no body text and whose log has inserts: the target, and what its replay gave."""
        empty = self.scans.select("file_id").join(self.bodies.where("text_segments > 0"), "file_id", "left_anti")
        ops = self.ops.join(empty, "file_id", "left_semi")
        ranked = oplog.inserts_by_address(ops)
        channel = ops.groupBy("file_id", "address").agg(F.min_by("channel", "op_ordinal").alias("channel"))
        ranked = ranked.join(channel, ["file_id", "address"], "left").join(oplog.channel_packages(self.decoded), ["file_id", "channel"], "left")
        target = oplog.choose_target(ranked)
        seed = self.trees.where("location.channel_id IS NOT NULL").select("file_id", F.col("location.channel_id").alias("channel"), "tree_index", "segments").groupBy("file_id", "channel").agg(F.min_by("segments", "tree_index").alias("seed"))
        target = target.join(self.follows, "file_id", "left").join(seed, ["file_id", "channel"], "left")
        base = F.when(F.coalesce("follows", F.lit(False)), F.coalesce("seed", F.array().cast(SEGMENTS))).otherwise(F.array().cast(SEGMENTS))
        target = target.withColumn("base", base).withColumn("seeded", F.size("base") > 0).drop("seed")
        logs = ops.join(target.select("file_id", "address"), ["file_id", "address"], "left_semi")
        logs = oplog.log_of(logs).join(target.select("file_id", "base"), "file_id")
        got = oplog.replay(logs).withColumnRenamed("warnings", "replay_warnings")
        out = target.drop("base").join(got, "file_id")
        return out.withColumn("accepted", fx.unicode_trim(trees.plain_text(F.col("segments"))) != "")

    @cached_property
    def documents(self) -> DataFrame:
        """One row per file: segments, content source, title selection, and the warnings of reconstruction."""
        cols = ["file_id", "address", "channel", "package", "confirmed", "n_addresses", "seeded", "segments", "applied", "skipped", "replay_warnings", "accepted"]
        d = self.scans.select("file_id").join(self.bodies, "file_id", "left")
        if self.has_logs:
            d = d.join(self.replays.select(*cols).withColumnRenamed("segments", "replayed"), "file_id", "left")
        else:
            kinds = {"address": "string", "channel": "string", "package": "string", "confirmed": "boolean", "n_addresses": "long", "seeded": "boolean", "replayed": SEGMENTS, "applied": "long", "skipped": "long", "replay_warnings": "array<string>", "accepted": "boolean"}
            d = d.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
        d = d.withColumn("content_source", bl.content_source(F.col("text_segments"), F.col("accepted"), F.col("seeded")))
        by_log = F.col("content_source") != "snapshot"
        d = d.withColumn("segments", F.when(by_log, F.col("replayed")).otherwise(F.coalesce("body_segments", F.array().cast(SEGMENTS))))
        t = self.trees.select("file_id", "role", "tree_index", "content_hash", F.col("role_evidence.kind").alias("evidence_kind"), bl.title_text(F.col("segments")).alias("text"), bl.is_bare(F.col("segments")).alias("bare"))
        d = d.join(bl.select_title(t), "file_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("none")))
        none = F.array().cast(_WARNING)
        of_replay = F.transform(F.coalesce("replay_warnings", F.array().cast("array<string>")), lambda m: F.struct(F.lit("operation_position_out_of_range").alias("code"), m.alias("message"), F.lit(None).cast("int").alias("member_index"), F.lit(None).cast("long").alias("file_offset"), F.lit(False).alias("rejected")))
        tried = F.col("address").isNotNull()
        before = _warnings(
            (tried & ~F.col("confirmed"), "operation_target_unconfirmed", F.concat(F.lit("no framing names the body's channel; of all addresses, the one with most inserts was replayed: "), F.col("address"))),
            (tried & (F.col("n_addresses") > 1), "operations_span_several_channels", F.concat(F.lit("inserts go to "), F.col("n_addresses").cast("string"), F.lit(" addresses, of which this one was replayed: "), F.col("address"))),
        )
        after = _warnings(
            (by_log, "body_rebuilt_from_operations", F.concat(F.lit("body text comes from the operation log: "), F.col("applied").cast("string"), F.lit(" operation(s) gave "), F.size("segments").cast("string"), F.lit(" segment(s)"), F.when(F.col("seeded"), ", starting from the snapshot's").otherwise(""))),
            (~by_log & F.col("content_hash").isNull(), "no_body_tree", F.lit("neither a tree of the snapshot nor the operation log gives a body")),
        )
        unknown = F.transform(F.filter("segments", lambda s: s["kind"] == "unknown"), lambda s: F.struct(F.lit("unknown_segment").alias("code"), F.lit("this segment is of no known kind; it is kept as raw JSON").alias("message"), F.lit(None).cast("int").alias("member_index"), F.lit(None).cast("long").alias("file_offset"), F.lit(False).alias("rejected")))
        last = _warnings((F.col("outcome") == "ambiguous", "title_ambiguous", F.concat(F.size("candidates").cast("string"), F.lit(" trees qualify as title; the least content hash decided for: "), F.coalesce("title", F.lit("")))))
        return self._kept(d.withColumn("warnings", F.concat(F.coalesce(before, none), of_replay, after, unknown, last)))

    @cached_property
    def blocks(self) -> DataFrame:
        return bl.blocks(self.documents.select("file_id", "segments"))

    @cached_property
    def recognised(self) -> DataFrame:
        """Documents of files with some structure; the others are in errors."""
        return self.documents.join(self.assessment.where("confidence != 'none'").select("file_id"), "file_id", "left_semi")

    @cached_property
    def errors(self) -> DataFrame:
        """(file_id, error): files that are empty or no containers."""
        a = self.assessment.where("confidence = 'none'")
        inflated = F.concat(F.col("members").cast("string"), F.lit(" member(s) were inflated, without any payload in them"))
        nothing = F.concat(F.lit("not a container: "), F.col("signatures").cast("string"), F.lit(" signature(s) in "), F.col("file_size").cast("string"), F.lit(" byte(s), and no member behind any"))
        return a.select("file_id", F.when(F.col("members") == 0, nothing).otherwise(inflated).alias("error")).unionByName(self.input_errors)

    def rendered(self, form: str = "markdown") -> DataFrame:
        """(file_id, rendered) of every recognised file, as markdown or text."""
        titles = self.recognised.select("file_id", "title")
        blocks = self.blocks.join(titles.select("file_id"), "file_id", "left_semi")
        return (render.markdown if form == "markdown" else render.plain)(blocks, titles)

    @cached_property
    def emptiness(self) -> DataFrame:
        """(file_id, note) of recognised files with neither title nor visible block: which kind of empty they are."""
        seen = self.blocks.where(~bl.is_empty(F.col("plain"))).select("file_id").distinct()
        t = self.trees.groupBy("file_id").agg(F.count("*").alias("n_trees"), F.count(F.when(F.col("text_segments") > 0, 1)).alias("n_text"))
        n = oplog.counts(self.ops).select("file_id", "inserts")
        d = self.recognised.where("title IS NULL").join(seen, "file_id", "left_anti").join(t, "file_id", "left").join(n, "file_id", "left").na.fill(0, ["n_trees", "n_text", "inserts"])
        count = lambda c: F.col(c).cast("string")
        note = (
            F.when(F.col("n_trees") == 0, "there is no tree in this container, so it has no document")
            .when((F.col("n_text") == 0) & (F.col("inserts") == 0), F.concat(F.lit("an empty page: structure alone in "), count("n_trees"), F.lit(" tree(s), and no insert in the log")))
            .when(F.col("n_text") > 0, F.concat(F.lit("text only in embedded components, which are not rendered: "), count("n_text"), F.lit(" tree(s)")))
            .otherwise(F.concat(F.lit("nothing visible in "), count("n_trees"), F.lit(" tree(s) and "), F.size("segments").cast("string"), F.lit(" replayed segment(s)")))
        )
        return d.select("file_id", note.alias("note"))
