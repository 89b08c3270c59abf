"""Containers through Spark: trees, roles, titles, blocks, rendering, operations, outputs, command line."""

import json

import pytest
from pyspark.sql import functions as F

from quire import cli
from quire.kernels import writer
from quire.kernels.segments import segment
from quire.model import KNOWN_COMPONENTS, PACKAGE_BODY, PACKAGE_TITLE, SEGMENTS, Limits
from quire.operators import blocks as bl
from quire.operators import render
from quire.plans import outputs
from quire.plans.analysis import Analysis

P = {"marker": {"refType": 1}, "props": {"nodeType": "Paragraph"}}


def item(depth, name):
    return {"marker": {}, "props": {"list!reference": f"{depth};list!list-{name}"}}


def heading(n):
    return {"marker": {}, "props": {"style!reference": f"Heading {n}"}}


def text(t, **props):
    return {"text": t, "props": {{"bold": "format!bold", "italic": "format!italic", "link": "hyperlink!url"}.get(k, k): v for k, v in props.items()}}


DOCUMENTS = {
    "nested": ([text("outer one"), item(0, "a0"), "inner one", item(1, "a0"), "outer two", item(0, "a0")], None, "- outer one\n    - inner one\n- outer two\n", "- outer one\n    - inner one\n- outer two\n"),
    "two lists": (["first", item(0, "a0"), "second", item(0, "b0")], None, "- first\n\n- second\n", "- first\n- second\n"),
    "empty item": (["a", item(0, "x"), item(0, "x"), "b", item(0, "x")], None, "- a\n- b\n", "- a\n\n- b\n"),
    "empty block ends a list": (["a", item(0, "x"), P, "b", item(0, "x")], None, "- a\n\n- b\n", "- a\n\n- b\n"),
    "title": (["body", P], "Minutes 3-1", "# Minutes 3-1\n\nbody\n", "Minutes 3-1\n\nbody\n"),
    "heading below a title": (["Section", heading(1), "deep", heading(6)], "Doc", "# Doc\n\n## Section\n\n###### deep\n", "Doc\n\nSection\n\ndeep\n"),
    "heading without a title": (["Section", heading(1)], None, "# Section\n", "Section\n"),
    "empty title moves headings": (["Section", heading(1)], "", "## Section\n", "Section\n"),
    "bold lead": ([text("Lead-in: ", bold=True), "rest", P], None, "**Lead-in:** rest\n", "Lead-in: rest\n"),
    "style": ([text("x", bold=True, italic=True, link="http://a b/)"), text(" y", italic=True), P], None, "[***x***](http://a%20b/%29) *y*\n", "x y\n"),
    "escapes": (["a * b _ c [d] `e` \\", P], None, "a \\* b \\_ c \\[d\\] \\`e\\` \\\\\n", "a * b _ c [d] `e` \\\n"),
    "escape at a run's start": (["# not a heading", P, "a", text("- b", bold=True), P], None, "\\# not a heading\n\na**\\- b**\n", "# not a heading\n\na- b\n"),
    "empty paragraphs": ([P, P, "real", P], None, "real\n", "real\n"),
    "text list": ([text("Lead-in: ", bold=True), "rest", item(1, "a0")], "Title", "# Title\n\n    - **Lead-in:** rest\n", "Title\n\n    - Lead-in: rest\n"),
    "nothing": ([], None, "", ""),
    "tail and unknown": (["a", {"odd": 1}, "b"], None, "ab\n", "ab\n"),
    "embedded": (["card", {"marker": {}, "props": {"nodeType": "Table"}}], None, "card\n", "card\n"),
    "blank bold": ([text("  ", bold=True), P], None, "  \n", "  \n"),
}


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(name, [segment(s) for s in segs], title) for name, (segs, title, _, _) in DOCUMENTS.items()]
    schema = f"file_id string, segments {SEGMENTS.simpleString()}, title string"
    df = spark.createDataFrame(rows, schema)
    return bl.blocks(df.select("file_id", "segments")), df.select("file_id", "title")


def test_markdown(documents):
    got = {r["file_id"]: r["rendered"] for r in render.markdown(*documents).collect()}
    assert got == {name: x[2] for name, x in DOCUMENTS.items()}


def test_text(documents):
    got = {r["file_id"]: r["rendered"] for r in render.plain(*documents).collect()}
    assert got == {name: x[3] for name, x in DOCUMENTS.items()}


def test_blocks(documents):
    rows = {}
    for b in documents[0].orderBy("file_id", "block_index").collect():
        rows.setdefault(b["file_id"], []).append(b)
    assert [(b["kind"], b["depth"], b["list_id"]) for b in rows["nested"]] == [("list-item", 0, "list!list-a0"), ("list-item", 1, "list!list-a0"), ("list-item", 0, "list!list-a0")]
    assert [b["kind"] for b in rows["tail and unknown"]] == ["unknown", "paragraph"]
    assert [(b["kind"], b["node_type"]) for b in rows["embedded"]] == [("embedded", "Table")]
    assert [b["level"] for b in rows["heading below a title"]] == [1, 6]
    assert [len(b["inlines"]) for b in rows["bold lead"]] == [2]


def page(body, **more):
    return writer.container(writer.chunk(body, **more), writer.package(KNOWN_COMPONENTS[0], "1"))


def two_part(first=(0, ["aa", "bb"]), second=(2, ["cc", "dd"]), total=4):
    return [writer.chunk(s, start=at, total=total, chars=8) for at, s in (first, second)]


FILES = {
    "copies": writer.container(*[writer.chunk(["abc", "de"])] * 2),
    "counters collide": writer.container(writer.chunk(["Cell A"]), writer.chunk(["Cell B"])),
    "split": writer.container(*reversed(two_part())),
    "gap": writer.container(*two_part(second=(4, ["cc", "dd"]), total=6)),
    "conflict": writer.container(*two_part(), writer.chunk(["xx", "yy"], start=2, total=4, chars=8)),
    "roles": page(["a" * 300, P]) + writer.member(writer.chunk(["A title", P], sequence=2)),
    "marker only": page([P]),
    "evidence": page([text("b", bold=True), text("i", italic=True, link="u"), heading(1), "x", item(0, "q"), text("who", attribution={"id": 1}), {"marker": {}, "props": {"placeholder!attributeText": "placeholder!addTitle", "new!key": 1}}]),
    "framed": writer.container(writer.summary({"T": (PACKAGE_TITLE, writer.chunk([" My title ", P])), "E": ("Other", writer.chunk(["body", P], sequence=2)), "C": ("Table", writer.chunk(["cell", P], sequence=3))}, {"CanvasComponentHandle": "/E"})),
    "log": writer.container(writer.summary({"E": (PACKAGE_BODY, writer.chunk([P, P]))}, None, 7, 8, [writer.delta("E", writer.insert(1, "from the log")), writer.delta("E", writer.insert(1, "from the log")), writer.delta("Z", writer.insert(0, "z"))]), writer.package(KNOWN_COMPONENTS[1])),
    "log unconfirmed": writer.container(writer.summary({"E": ("Other", None)}, None, 7, 9, [writer.delta("q", writer.insert(5, "late"))]), b'{"segmentTexts":[]}'),
    "ambiguous": writer.container(writer.chunk(["x" * 300]), writer.chunk(["One"], sequence=2), writer.chunk(["Two"], sequence=3)),
    "bare": writer.container(writer.chunk(["x" * 300]), writer.chunk([text("Bold", bold=True)], sequence=2), writer.chunk(["Plain"], sequence=3)),
    "unknown segment": page(["a", {"odd": {"attribution": 1, "k": 2}}, P]),
    "no document": writer.container(writer.package("other")),
    "known, no document": writer.container(writer.package(KNOWN_COMPONENTS[1])),
    "plain text": b"just some text",
    "no json": writer.container(b"plain words, deflated"),
    "broken framing": writer.container(b"\x33\x0e\x09treeNodes\x7f" + writer.chunk(["still read"])),
    "cut": writer.container(writer.chunk(["ok"])) + b"\x1f\x8b\x08\x00junk",
    "empty": b"",
}


@pytest.fixture(scope="module")
def analysis(spark):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "file_id string, content binary").repartition(4)
    a = Analysis(files, with_data=True, with_values=True)
    yield a
    a.release()


@pytest.fixture(scope="module")
def trees(analysis):
    rows = {}
    for t in analysis.trees.orderBy("file_id", "tree_index").collect():
        rows.setdefault(t["file_id"], []).append(t)
    return rows


@pytest.fixture(scope="module")
def codes(analysis):
    rows = {}
    for w in outputs.diagnostics(analysis).orderBy("file_id", "stage", "ordinal").collect():
        rows.setdefault(w["file_id"], []).append(w["code"])
    return rows


def joined(tree):
    return "".join(s["text"] for s in tree["segments"] if s["kind"] == "text")


def test_copies_collapse(trees):
    (t,) = trees["copies"]
    assert (joined(t), t["duplicate_copies"], len(t["sources"]), t["complete"]) == ("abcde", 1, 2, True)


def test_counters_do_not_identify(trees, codes):
    assert sorted(joined(t) for t in trees["counters collide"]) == ["Cell A", "Cell B"]
    assert "chunk_conflict" not in codes["counters collide"]


def test_split_tree(trees, codes):
    (t,) = trees["split"]
    assert (joined(t), t["chunks"], t["complete"]) == ("aabbccdd", 2, True)
    (t,) = trees["gap"]
    assert not t["complete"] and [c for c in codes["gap"] if c.startswith(("chunk", "tree"))] == ["chunk_gap", "tree_incomplete"]
    (t,) = trees["conflict"]
    assert joined(t) == "aabbccdd" and "chunk_conflict" in codes["conflict"]


def test_heuristic_roles_and_titles(trees, analysis):
    assert [t["role"] for t in trees["roles"]] == ["body-candidate", "title-candidate"]
    assert [t["role"] for t in trees["marker only"]] == ["auxiliary"]
    got = {r["file_id"]: (r["outcome"], r["title"]) for r in analysis.documents.collect()}
    assert got["roles"] == ("resolved", "A title") and got["bare"] == ("resolved", "Plain") and got["framed"] == ("resolved", "My title")
    assert got["ambiguous"][0] == "ambiguous" and got["ambiguous"][1] in ("One", "Two") and got["marker only"] == ("none", None)


def test_evidence(trees, analysis):
    e = trees["evidence"][0]["evidence"]
    assert (e["has_bold"], e["has_italic"], e["has_list_reference"], e["has_hyperlink"], e["has_attribution"], e["has_add_title_marker"]) == (True,) * 6
    assert (e["text_segments"], e["marker_segments"], e["style_references"]) == (4, 3, ["Heading 1"])
    usage = {r["key"]: r["class"] for r in analysis.properties.where("file_id = 'evidence'").collect()}
    assert usage["new!key"] == "unknown" and usage["attribution"] == "recognised" and usage["format!bold"] == "rendered"


def test_framed_roles(trees):
    got = {joined(t).strip(): (t["role"], t["role_evidence"]["kind"], t["location"]["channel_id"]) for t in trees["framed"]}
    assert got == {"My title": ("title", "component-package", "T"), "body": ("body", "fluid-handle", "E"), "cell": ("embedded-component", "channel-path", "C")}


def test_operation_log(analysis, codes):
    d = {r["file_id"]: r for r in analysis.documents.collect()}
    assert (d["log"]["content_source"], d["log"]["applied"], d["log"]["seeded"]) == ("snapshot-plus-operations", 1, True)
    assert [c for c in codes["log"] if "operation" in c] == ["operations_span_several_channels", "body_rebuilt_from_operations"]
    assert d["log unconfirmed"]["content_source"] == "operations"
    assert [c for c in codes["log unconfirmed"] if "operation" in c] == ["operation_target_unconfirmed", "operation_position_out_of_range", "body_rebuilt_from_operations"]


def test_warning_codes(codes):
    assert "component_identity_missing" in codes["copies"] and "component_identity_missing" not in codes["marker only"]
    assert "unknown_properties" in codes["evidence"] and "unknown_segment" in codes["unknown segment"]
    assert "title_ambiguous" in codes["ambiguous"] and "no_body_tree" in codes["no document"]
    assert "envelope_unreadable" in codes["broken framing"] and "gzip_candidate_rejected" in codes["cut"]


def test_assessment_and_errors(analysis):
    got = {r["file_id"]: r["confidence"] for r in analysis.assessment.collect()}
    assert (got["roles"], got["copies"], got["no document"], got["known, no document"], got["plain text"], got["no json"]) == ("high", "moderate", "low", "moderate", "none", "none")
    errors = {r["file_id"]: r["error"] for r in analysis.errors.collect()}
    assert set(errors) == {"plain text", "no json", "empty"} and errors["plain text"] != errors["no json"]


def test_rendered(analysis):
    got = {r["file_id"]: r["rendered"] for r in analysis.rendered("markdown").collect()}
    assert got["framed"] == "# My title\n\nbody\n" and got["log"] == "from the log\n" and got["broken framing"] == "still read\n"
    assert got["marker only"] == "" and "plain text" not in got
    assert all(x == "" or x.endswith("\n") for x in got.values())
    notes = {r["file_id"]: r["note"] for r in analysis.emptiness.collect()}
    assert "an empty page" in notes["marker only"] and "no tree" in notes["no document"]


def test_json_documents_leave_out_personal_data(analysis):
    got = {r["file_id"]: json.loads(r["rendered"]) for r in outputs.json_documents(analysis).collect()}
    assert list(got["framed"]) == ["metadata", "title", "blocks", "source", "warnings"]
    assert got["unknown segment"]["blocks"][0] == {"kind": "unknown", "raw": {"odd": {"k": 2}}}
    full = {r["file_id"]: r["rendered"] for r in outputs.json_documents(analysis, include_attribution=True).collect()}
    assert '"attribution": 1' in full["unknown segment"]
    assert got["cut"]["warnings"][0]["member_index"] == 18446744073709551615


def test_reports(analysis):
    got = {r["file_id"]: json.loads(r["rendered"]) for r in outputs.reports(analysis).collect()}
    assert set(got) == set(FILES) - {"empty"}
    assert got["log"]["operations"]["counts"]["inserts"] == 2 and got["log"]["operations"]["replayed_body_segments"] == 3
    assert got["copies"]["payloads_by_anchor"] == {"chunkStartSegmentIndex": 2}
    assert got["broken framing"]["members"][0]["envelope"]["outcome"] == "unreadable"
    text_form = {r["file_id"]: r["rendered"] for r in outputs.reports(analysis, "text", verbose=True).collect()}
    assert "Confidence:      High" in text_form["roles"] and "INCOMPLETE" in text_form["gap"] and text_form["split"].count("source: member") == 2


def test_invariants(analysis, trees):
    by_file = {r["file_id"]: r for r in analysis.assessment.collect()}
    assert all(r["signatures"] == r["members"] + r["rejected"] for r in by_file.values())
    for own in trees.values():
        assert len({t["content_hash"] for t in own}) == len(own)


def test_dump(analysis):
    names = {r["name"]: bytes(r["content"]) for r in outputs.dump(analysis).where("file_id = 'copies'").collect()}
    assert set(names) == {"member-000.raw", "member-001.raw", "member-000-fragment-000.json", "member-001-fragment-000.json"}
    assert json.loads(names["member-000-fragment-000.json"]) == json.loads(names["member-000.raw"])


def test_envelope_discovery_and_limits(spark):
    files = spark.createDataFrame([("framed", bytearray(FILES["framed"])), ("big", bytearray(writer.container(b"x" * 5000)))], "file_id string, content binary")
    a = Analysis(files, Limits(member_bytes=1000), discovery="envelope")
    assert {r["truncated"] for r in a.members.where("file_id = 'big'").collect()} == {True}
    a = Analysis(files, discovery="envelope")
    assert a.trees.where("file_id = 'framed'").count() == 3
    assert {r["anchor"] for r in a.payloads.collect()} == {"envelope-blob"}


def test_index_tables(analysis):
    assert {r["channel_id"]: r["package"] for r in analysis.channels.where("file_id = 'framed'").collect()} == {"T": PACKAGE_TITLE, "E": "Other", "C": "Table"}
    assert analysis.blobs.where("file_id = 'framed' AND path = '/.app/.channels/E/content'").count() == 1
    assert analysis.handles.where("file_id = 'framed'").first()["url"] == "/E"


def test_no_files(spark):
    a = Analysis(spark.createDataFrame([], "file_id string, content binary"))
    assert a.rendered().count() == 0 and a.errors.count() == 0 and outputs.reports(a).count() == 0


@pytest.mark.parametrize(("name", "args", "status"), [("framed", ["extract"], 0), ("framed", ["extract", "--format", "json"], 0), ("plain text", ["extract"], 1), ("plain text", ["inspect"], 0), ("empty", ["inspect"], 1)])
def test_command_line(spark, tmp_path, capsys, name, args, status):
    path = tmp_path / "page.loop"
    path.write_bytes(FILES[name])
    assert cli.main([args[0], str(path), *args[1:]], spark) == status
    out, err = capsys.readouterr()
    if args == ["extract"] and not status:
        assert out == "# My title\n\nbody\n"
    if args[-1] == "json":
        assert json.loads(out)["title"] == "My title"
    if status:
        assert "error" in err and not out
    assert cli.main(["extract", str(tmp_path / "missing")], spark) == 1


def test_command_line_writes_and_dumps(spark, tmp_path, capsys):
    path = tmp_path / "page.bin"
    path.write_bytes(FILES["split"])
    assert cli.main(["extract", str(path), "-o", str(tmp_path / "out.md"), "--include-attribution"], spark) == 0
    assert (tmp_path / "out.md").read_text() == "aabbccdd\n"
    assert cli.main(["inspect", str(path), "--dump-payloads", str(tmp_path / "dump"), "--format", "json", "-v"], spark) == 0
    out, err = capsys.readouterr()
    assert "--include-attribution changes nothing" in err and "4 payload file(s)" in err
    assert json.loads(out)["merge_trees"] == 1 and len(list((tmp_path / "dump").iterdir())) == 4


def test_stream_agrees_with_batch(spark, tmp_path):
    from quire.streaming import containers as stream

    source = tmp_path / "in"
    source.mkdir()
    for name in ("framed", "log", "split"):
        (source / f"{name}.loop").write_bytes(FILES[name])
    q = stream.render_stream(stream.read_stream(spark, str(source), max_files=2), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = {r["file_id"].split("/")[-1]: r["rendered"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["file_id"].split("/")[-1]: r["rendered"] for r in Analysis.of_paths(spark, str(source), glob="*.{loop,fluid}").rendered().collect()}
    assert got == want and len(got) == 3


def test_paths(spark):
    from quire.sources.containers import extension, plain_path

    df = spark.createDataFrame([("file:/a/B.Loop",), ("file:///x/y.tar.GZ",), ("hdfs://n/p/none",)], "path string")
    got = [tuple(r) for r in df.select(plain_path(F.col("path")), extension(F.col("path"))).collect()]
    assert got == [("/a/B.Loop", "loop"), ("/x/y.tar.GZ", "gz"), ("hdfs://n/p/none", "")]
