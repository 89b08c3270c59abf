"""JSON documents and inspect reports out of collected rows; the order of keys is part of the format."""

from __future__ import annotations

import json
from typing import Any

from quire.kernels import strictjson
from quire.model import ATTRIBUTION, NO_MEMBER, TITLE_REASON


def is_personal(key: str) -> bool:
    return key == ATTRIBUTION or (key[:1] == "@" and len(key) > 1)


def redact(value: Any) -> Any:
    """Without personal keys at any depth."""
    if isinstance(value, dict):
        return {k: redact(v) for k, v in value.items() if not is_personal(k)}
    return [redact(v) for v in value] if isinstance(value, list) else value


def redact_props(props: dict[str, Any]) -> dict[str, Any]:
    """Without personal keys at the top."""
    return {k: v for k, v in props.items() if not is_personal(k)}


def present(**fields: Any) -> dict[str, Any]:
    """The fields that are not None."""
    return {k: v for k, v in fields.items() if v is not None}


def inline(x: dict[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {"kind": "text", "text": x["text"]}
    for kind in ("italic", "bold"):
        if x[kind]:
            out = {"kind": kind, "content": [out]}
    return out if x["link"] is None else {"kind": "link", "content": [out], "target": x["link"]}


def block(b: dict[str, Any], include_attribution: bool) -> dict[str, Any]:
    if b["kind"] == "unknown":
        raw = json.loads(b["raw"])
        return {"kind": "unknown", "raw": raw if include_attribution else redact(raw)}
    content = [inline(x) for x in b["inlines"]]
    props = json.loads(b["props"])
    props = props if include_attribution else redact_props(props)
    out = {"kind": b["kind"]} | present(**{k: b[k] for k in ("level", "depth", "list_id", "node_type")})
    if content or b["kind"] != "embedded":
        out["content"] = content
    return out | ({"props": props} if props else {})


def warning(w: dict[str, Any]) -> dict[str, Any]:
    member = NO_MEMBER if w["rejected"] else w["member_index"]
    return {"code": w["code"], "message": w["message"]} | present(member_index=member, file_offset=w["file_offset"])


def title_selection(d: dict[str, Any]) -> dict[str, Any]:
    if d["outcome"] == "resolved":
        return {"outcome": "resolved", "title": d["title"], "rule": d["rule"]}
    if d["outcome"] == "ambiguous":
        return {"outcome": "ambiguous", "chosen": d["title"], "candidates": d["candidates"], "reason": TITLE_REASON}
    return {"outcome": "none"}


def replay_summary(d: dict[str, Any]) -> dict[str, Any] | None:
    if d["content_source"] == "snapshot":
        return None
    return {"address": d["address"], "seeded_from_snapshot": d["seeded"], "channel": d["channel"], "component_package": d["package"], "operations_applied": d["applied"], "operations_skipped": d["skipped"], "segments": len(d["segments"])}


def properties(rows: list[dict[str, Any]]) -> dict[str, Any]:
    return {r["key"]: {"class": r["class"], "occurrences": r["occurrences"]} for r in sorted(rows or [], key=lambda r: r["key"])}


def document(d: dict[str, Any], include_attribution: bool = False) -> str:
    metadata = {
        "source_path": d["file_id"], "file_size": d["file_size"], "format": d["format"], "components": [dict(c) for c in d["components"]], "content_source": d["content_source"],
        "title_selection": title_selection(d), "body_tree_hash": d["content_hash"], "body_segment_count": len(d["segments"]), "merge_trees": len(d["trees"] or []),
    } | present(replay=replay_summary(d))
    summaries = [
        {"role": t["role"], "content_hash": t["content_hash"], "segments": t["assembled_segments"], "total_length_chars": t["key"]["total_length_chars"], "sequence_number": t["key"]["sequence_number"], "complete": t["complete"], "copies_found": len(t["sources"]), "text_preview": t["evidence"]["text_preview"]}
        for t in sorted(d["trees"] or [], key=lambda t: t["tree_index"])
    ]
    source = {"gzip_members": d["members"], "gzip_candidates_rejected": d["rejected"], "json_payloads": d["payloads"], "merge_tree_chunks": d["chunks"], "trees": summaries, "properties": properties(d["properties"])}
    blocks = [block(b, include_attribution) for b in sorted(d["blocks"] or [], key=lambda b: b["block_index"])]
    warnings = [warning(w) for w in [*(d["analysis_warnings"] or []), *(d["warnings"] or [])]]
    return strictjson.pretty({"metadata": metadata} | present(title=d["title"]) | {"blocks": blocks, "source": source, "warnings": warnings})


_EVIDENCE_FIELD = {"component-package": "package", "fluid-handle": "handle", "channel-path": "path", "heuristic": "rule"}


def report(r: dict[str, Any]) -> dict[str, Any]:
    """The inspect report of one file."""
    trees = sorted(r["trees"] or [], key=lambda t: t["tree_index"])
    roles = [t["role"] for t in trees]
    counts = r["op_counts"] or dict.fromkeys(("records", "inserts", "removes", "annotates", "unknown"), 0)
    by_log = r["content_source"] != "snapshot"
    members = []
    for m in sorted(r["member_rows"] or [], key=lambda m: m["index"]):
        status = {"outcome": "decoded", "blob_paths": m["envelope"]["blob_paths"], "channels": m["envelope"]["channels"]} if m["envelope"]["outcome"] == "decoded" else {"outcome": "unreadable", "reason": m["envelope"]["reason"]}
        members.append({k: m[k] for k in ("index", "file_offset", "compressed_len", "decompressed_len", "is_utf8", "truncated", "partial", "sha256", "json_payloads", "merge_tree_chunks")} | {"envelope": status})
    return {
        "path": r["file_id"], "extension": r["extension"], "file_size": r["file_size"],
        "format": {"format": r["format"], "components": [dict(c) for c in r["components"]], "confidence": r["confidence"]},
        "gzip_candidates": r["signatures"], "gzip_members_inflated": r["members"], "gzip_candidates_rejected": r["rejected"], "decompressed_bytes": r["bytes"], "members": members,
        "rejected_candidates": [dict(f) for f in r["failed"]], "json_payloads": r["payloads"], "payloads_by_anchor": {a["anchor"].strip('"'): a["n"] for a in sorted(r["anchors"] or [], key=lambda a: a["anchor"])},
        "merge_tree_chunk_candidates": r["chunks"], "merge_trees": len(trees), "title_trees": roles.count("title"), "body_trees": roles.count("body"), "embedded_component_trees": roles.count("embedded-component"),
        "title_candidates": roles.count("title-candidate"), "body_candidates": roles.count("body-candidate"), "auxiliary_trees": roles.count("auxiliary"),
        "structurally_classified": any(x in ("title", "body", "embedded-component") for x in roles), "duplicate_copies_collapsed": sum(t["duplicate_copies"] for t in trees),
        "trees": [
            {"key": dict(t["key"]), "role": t["role"], "role_evidence": {"kind": t["role_evidence"]["kind"], _EVIDENCE_FIELD[t["role_evidence"]["kind"]]: t["role_evidence"]["value"]}}
            | present(location=t["location"])
            | {"content_hash": t["content_hash"], "assembled_segments": t["assembled_segments"], "chunks": t["chunks"], "complete": t["complete"], "copies_found": len(t["sources"]), "duplicate_copies_collapsed": t["duplicate_copies"], "sources": [dict(s) for s in t["sources"]], "evidence": dict(t["evidence"])}
            for t in trees
        ],
        "properties": properties(r["properties"]),
        "operations": {
            "counts": {k: counts[k] for k in ("records", "inserts", "removes", "annotates", "unknown")}, "follows_snapshot": bool(r["follows"]), "inserts_by_address": [[a["address"], a["inserts"]] for a in sorted(r["inserts"] or [], key=lambda a: a["rank"])],
            "snapshot_body_segments": r["snapshot_body_segments"], "replayed_body_segments": len(r["segments"]) if by_log else 0, "selected_content_source": r["content_source"],
        },
        "warnings": [warning(w) for w in r["analysis_warnings"] or []],
    }


def _camel(name: str) -> str:
    return "".join(x.capitalize() for x in name.split("-"))


def _option(value: Any) -> str:
    return "None" if value is None else f"Some({value})"


def _yes(value: bool) -> str:
    return str(bool(value)).lower()


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def report_text(r: dict[str, Any], verbose: bool = False) -> str:
    """The report laid out for a person."""
    out: list[str] = []

    def section(head: str | None, rows: list[tuple[str, Any]], width: int) -> None:
        out.extend([head] if head else [])
        out.extend(f"{label:<{width}}{value}" for label, value in rows)

    names = [("Component:", f"{c['name']} (version {c['version'] or 'unknown'})") for c in r["format"]["components"]] or [("Component:", "unknown")]
    section(None, [("File:", r["path"]), ("Size:", f"{r['file_size']} bytes"), ("Format:", r["format"]["format"]), *names, ("Confidence:", _camel(r["format"]["confidence"]))], 17)
    out.append("")
    section("Gzip members", [("  signatures found:", r["gzip_candidates"]), ("  inflated:", r["gzip_members_inflated"]), ("  rejected:", r["gzip_candidates_rejected"]), ("  decompressed bytes:", r["decompressed_bytes"])], 25)
    out.append("")
    section("Embedded payloads", [("  JSON payloads:", r["json_payloads"])], 25)
    out.extend(f"    via {a:<24} {n}" for a, n in r["payloads_by_anchor"].items())
    framed = r["structurally_classified"]
    rows = [("  merge-tree chunks:", r["merge_tree_chunk_candidates"]), ("  merge trees assembled:", r["merge_trees"]), ("  classified by:", "container framing" if framed else "content heuristics")]
    if framed:
        rows += [("    title:", r["title_trees"]), ("    body:", r["body_trees"]), ("    embedded components:", r["embedded_component_trees"])]
    if r["body_candidates"] + r["title_candidates"]:
        rows += [("    body candidates:", r["body_candidates"]), ("    title candidates:", r["title_candidates"])]
    section(None, [*rows, ("    auxiliary:", r["auxiliary_trees"])], 25)
    out += [f"  duplicate copies collapsed: {r['duplicate_copies_collapsed']}", "", "Merge trees"]
    for t in r["trees"]:
        key, e = t["key"], t["evidence"]
        out.append(f"  [{_camel(t['role'])}] seq {_option(key['sequence_number'])}  segments {t['assembled_segments']}/{_option(key['total_segment_count'])}  chars {_option(key['total_length_chars'])}  chunks {t['chunks']}  copies {t['copies_found']}{'' if t['complete'] else '  INCOMPLETE'}")
        flags = "  ".join(f"{label} {_yes(e[name])}" for label, name in (("bold", "has_bold"), ("italic", "has_italic"), ("lists", "has_list_reference"), ("links", "has_hyperlink")))
        out.append(f"      text {e['text_segments']}  markers {e['marker_segments']}  unknown {e['unknown_segments']}  {flags}")
        out.extend(f"      {label}: {', '.join(e[name])}" for label, name in (("styles", "style_references"), ("node types", "node_types")) if e[name])
        place = t.get("location")
        if place:
            if place["channel_id"]:
                more = "".join(f"  {label}: {place[name]}" for label, name in (("component", "component_package"), ("handle", "handle_name")) if place[name])
                out.append(f"      channel: {place['channel_id']}{more}")
            if place["blob_path"]:
                out.append(f"      blob path: {place['blob_path']}")
        if e["text_preview"]:
            out.append(f"      preview: {_quoted(e['text_preview'])}")
        if verbose:
            out.extend(f"      source: member {s['member_index']} at file offset {s['member_file_offset']}, payload offset {s['payload_offset']}" for s in t["sources"])
    out += ["", "Properties encountered"]
    out.extend(f"  {key:<40} {_camel(p['class'])} x{p['occurrences']}" for key, p in r["properties"].items())
    out.append("")
    if verbose:
        out.append("Members")
        for m in r["members"]:
            packed = "?" if m["compressed_len"] is None else m["compressed_len"]
            out.append(f"  {m['index']:>3}  offset {m['file_offset']:>9}  compressed {packed:>9}  decompressed {m['decompressed_len']:>9}  utf8 {_yes(m['is_utf8']):<5}  json {m['json_payloads']:>3}  chunks {m['merge_tree_chunks']:>3}")
        out.append("")
    ops = r["operations"]
    section("Operations", [("  records:", ops["counts"]["records"]), ("    inserts:", ops["counts"]["inserts"]), ("    removes:", ops["counts"]["removes"]), ("    annotates:", ops["counts"]["annotates"]), ("  begin after snapshot:", "yes" if ops["follows_snapshot"] else "not established")], 25)
    out.extend(f"    {address}: {n} insert(s)" for address, n in ops["inserts_by_address"])
    out += [f"  snapshot body segments: {ops['snapshot_body_segments']}", f"  replayed body segments: {ops['replayed_body_segments']}", f"  selected content source: {_camel(ops['selected_content_source'])}", "", f"Warnings ({len(r['warnings'])})"]
    for w in r["warnings"]:
        where = f" at file offset {w['file_offset']}" if "file_offset" in w else ""
        out.append(f"  [{w['code']}]{where}{':' if where else ''} {w['message']}")
    return "\n".join(out) + "\n"
