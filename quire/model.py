"""Fixed values, limits and schemas of the container engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values of the format.
SIGNATURE = b"\x1f\x8b\x08"
ANCHORS = ('"chunkStartSegmentIndex"', '"segmentTexts"', '"headerMetadata"', '"orderedChunkMetadata"', '"chunkSegmentCount"', '"package"')
MAX_DEPTH = 256
JSON_DEPTH = 128
KNOWN_COMPONENTS = ("@fluidx/loop-page-container", "@ms/office-fluid-container")
PACKAGE_TITLE = "LoopPageTitleSingleton"
PACKAGE_BODY = "LoopCanvasComponentSingleton"
HANDLE_TITLE = "HeaderComponentHandle"
HANDLE_BODY = "CanvasComponentHandle"
HANDLE_TYPE = "__fluid_handle__"
MAX_TITLE_CHARS = 200
PREVIEW_CHARS = 80
INSERT, REMOVE, ANNOTATE = 0, 1, 2

# Fixed property keys.
BOLD = "format!bold"
ITALIC = "format!italic"
STYLE = "style!reference"
LIST = "list!reference"
LINK = "hyperlink!url"
NODE_TYPE = "nodeType"
MARKER_ID = "markerId"
ATTRIBUTION = "attribution"
PLACEHOLDER = "placeholder!attributeText"
ADD_TITLE = "placeholder!addTitle"
RENDERED_KEYS = (BOLD, ITALIC, STYLE, LIST, LINK, NODE_TYPE)
RECOGNISED_KEYS = (
    MARKER_ID, ATTRIBUTION, PLACEHOLDER, "list!id", "paragraph!textAlignment", "paragraph!writingMode", "proofing!spellingError", "proofing!grammarError",
    "content!locale", "content!detectedLocale", "component!display", "component!height", "component!width", "component!mimeType", "component!routerInput",
    "component!url", "component!urlTitle", "tab!indentCountLeft", "tab!indentCountRight", "aria!role",
)
RECOGNISED_PREFIXES = ("list!itemFormat-", "list!list-")

# Fixed texts of the output.
BODY_RULE = "the longest tree in the file that carries text"
TITLE_RULE = "short, carries text, and has no list structure"
UNCLASSIFIED_RULE = "not yet classified"
TITLE_BY_PACKAGE = "the container framing places this tree under the page title component"
TITLE_BY_HANDLE = "the container framing points the page header handle at this tree's channel"
TITLE_BARE = "the only title candidate whose text carries no formatting and whose closing marker carries only markerId and nodeType"
TITLE_SOLE = "the only title candidate in the file"
TITLE_REASON = "several trees are structurally indistinguishable from the title"
FORMAT_HIGH = "Microsoft Loop / Fluid snapshot (probable)"
FORMAT_COMPATIBLE = "Fluid-compatible snapshot"
FORMAT_KNOWN_EMPTY = "Microsoft Loop container, no document content found"
FORMAT_EMPTY = "Fluid-compatible container, no document content found"
FORMAT_NONE = "Unrecognised: no Fluid snapshot structure found"
#: The member index that a rejected candidate carries in JSON reports.
NO_MEMBER = 18446744073709551615
#: Deepest list nesting that is indented; a crafted depth could otherwise exhaust memory.
MAX_INDENT = 64


@dataclass(frozen=True)
class Limits:
    """Bounds of decoding one file."""

    member_bytes: int = 64 << 20
    total_bytes: int = 512 << 20
    lookback: int = 1 << 20
    braces: int = 64
    object_bytes: int = 32 << 20
    payloads: int = 4096


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
STRINGS = T.ArrayType(S)
#: kind is text, marker or unknown; the property columns are strictly typed: null where a property has another type.
SEGMENT = _struct(kind=S, text=S, ref_type=L, props=S, raw=S, keys=STRINGS, bold=B, italic=B, link=S, style=S, list_ref=S, node_type=S, placeholder=S, attributed=B)
SEGMENTS = T.ArrayType(SEGMENT)
LOCATION = _struct(member_index=I, blob_path=S, channel_id=S, handle_name=S, parent_channel=S, component_package=S)
CHUNK = _struct(
    payload_offset=L, start_index=L, segment_count=L, length_chars=L, total_length_chars=L, total_segment_count=L, sequence_number=L, sha256=S, segments=SEGMENTS
)
PAYLOAD = _struct(start=L, end=L, anchor=S, value=S, package_name=S, package_version=S, has_package=B, chunk=CHUNK)
ENVELOPE = _struct(
    outcome=S,
    reason=S,
    blobs=T.ArrayType(_struct(blob_id=S, path=S, start=L, len=L)),
    paths=L,
    channels=T.ArrayType(_struct(channel_id=S, package=S)),
    handles=T.ArrayType(_struct(name=S, url=S)),
    deltas=STRINGS,
    snapshot_seq=L,
    first_delta_seq=L,
)
WARNING = _struct(code=S, message=S, member_index=I, file_offset=L, rejected=B)
#: One row per inflated member, and one row (member_index null) per file with what concerns the file as a whole.
DECODED = _struct(
    file_id=S, member_index=I, file_offset=L, compressed_len=L, data=T.BinaryType(), data_len=L, utf8=B, truncated=B, partial=B, sha256=S, envelope=ENVELOPE, payloads=T.ArrayType(PAYLOAD),
    file_size=L, candidates=L, failed=T.ArrayType(_struct(file_offset=L, error=S)), warnings=T.ArrayType(WARNING),
)
OPERATION = _struct(op_ordinal=L, channel=S, data_structure=S, kind=S, pos1=L, pos2=L, segments=SEGMENTS, props=S)
