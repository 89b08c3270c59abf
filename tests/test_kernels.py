"""The byte decoders: signatures and inflation, fragments, framing, chunks, operations."""

import gzip
import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.kernels import envelope, fragments, inflate, oplog, segments, strictjson, writer
from quire.model import SIGNATURE, Limits
from quire.plans import adapters


# ---- inflate


def test_member_between_junk():
    got = inflate.scan(b"\x00\x01 before" + writer.member(b"hello loop") + b"after it")
    assert [(m.file_offset, m.data) for m in got.members] == [(9, b"hello loop")]
    assert not got.failed


def test_members_end_to_end_and_compressed_length():
    parts = [writer.member(x) for x in (b"one", b"two", b"three")]
    got = inflate.scan(b"".join(parts))
    assert [m.data for m in got.members] == [b"one", b"two", b"three"]
    assert [m.compressed_len for m in got.members] == [len(p) for p in parts]
    assert [m.index for m in got.members] == [0, 1, 2]


def test_false_positives():
    got = inflate.scan(b"\x00\x1f\x8b\x08\x99\x99\x99\x99" + writer.member(b"real"))
    assert (len(got.members), [at for at, _ in got.failed], len(got.candidates)) == (1, [1], 2)
    got = inflate.scan(b"\x1f\x8b\x08\xff\x1f\x8b\x08\x00")
    assert (len(got.members), len(got.failed)) == (0, 2)


def test_member_cap_also_at_the_exact_size():
    for size in (10_000, 1_000):
        got = inflate.scan(writer.member(b"x" * size), Limits(member_bytes=1000))
        assert len(got.members[0].data) == 1000 and got.members[0].truncated
        assert [w["code"] for w in got.warnings] == ["member_truncated"]


def test_total_budget():
    got = inflate.scan(b"".join(writer.member(bytes([65 + i]) * 4000) for i in range(5)), Limits(total_bytes=5000))
    assert len(got.members) == 2 and len(got.candidates) == 3
    assert got.warnings[-1]["code"] == "decompression_budget_exhausted"


def test_cut_member_and_checksum():
    data = random.Random(1).randbytes(50_000)
    got = inflate.scan(writer.member(data)[:-200])
    assert len(got.members) + len(got.failed) == 1
    if got.members:
        assert got.members[0].partial and data.startswith(got.members[0].data)
    broken = bytearray(writer.member(b"some text"))
    broken[-6] ^= 1
    got = inflate.scan(bytes(broken))
    assert got.members[0].partial and got.members[0].data == b"some text"


def test_empty_member_is_rejected():
    got = inflate.scan(gzip.compress(b""))
    assert got.failed[0][1] == "no output"


def stray(seed):
    """A text in whose container the signature stood by chance within compressed bytes."""
    rng = random.Random(seed)
    return " ".join(f"{rng.getrandbits(40):x}" for _ in range(120))


def accepted(content, members):
    got = inflate.scan(content)
    return (len(got.candidates), len(got.members), got.failed, got.warnings) == (members, members, [], [])


def test_members_hold_no_stray_signature():
    text = stray(62517)
    assert SIGNATURE in gzip.compress(writer.chunk(writer.paragraphs(text)), 6)[1:]
    assert accepted(adapters.plain_container(text), 3)


def test_logged_members_hold_no_stray_signature():
    content = adapters.logged_container([stray(88119)])
    assert accepted(content, 3)


@pytest.mark.parametrize("turns, text", [(["😀 a", "b"], " ab"), (["", "😀", "b"], "b"), ([None, "ab", None], "b"), (["ab", "😀"], "b😀")])
def test_logged_conversations_lose_their_first_character(turns, text):
    """Whole, if it takes two units; turns without a text insert nothing."""
    page = inflate.scan(adapters.logged_container(turns)).members[0].data
    got = oplog.replay([], oplog.operations(envelope.read(page).deltas))
    assert "".join(s["text"] for s in got.segments) == text and not got.warnings


def test_padding_where_the_length_is_the_signature():
    size, head = int.from_bytes(SIGNATURE, "little"), b'{"segmentTexts":["hi"],"a":"'
    payload = head + b"x" * (size - len(head) - 2) + b'"}'
    content = writer.container(payload, payload)
    assert accepted(content, 2)
    found = [fragments.Fragments().discover(m.data) for m in inflate.scan(content).members]
    assert [[(p.start, p.end) for p in ps] for ps in found] == [[(0, size)]] * 2


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=5), st.binary(max_size=20))
def test_every_signature_is_accounted_for(parts, junk):
    got = inflate.scan(junk + b"".join(map(writer.member, parts)))
    assert len(got.candidates) == len(got.members) + len(got.failed)


# ---- strict JSON


@pytest.mark.parametrize("bad", ["NaN", "[Infinity]", '"\\ud800"', "1e999", "[1,]", "{}x", "[" * 200 + "]" * 200, b'"\xff"'])
def test_strict_json_rejects(bad):
    with pytest.raises(ValueError):
        strictjson.loads(bad)


def test_strict_json_accepts():
    assert strictjson.loads(' {"b":1,"a":"\\ud83d\\ude00"} ') == {"b": 1, "a": "😀"}
    assert strictjson.loads("[" * 128 + "]" * 128)


# ---- fragments


CHUNK = b'{"chunkStartSegmentIndex":0,"chunkSegmentCount":1,"segmentTexts":["hi"]}'


@pytest.mark.parametrize("text", [b'{"a":"brace } and { in it","b":2}', b'{"a":"he said \\"}\\" and stopped","b":2}', b'{"a":{"b":{}}}', b'{\t"a"\n:\r1}'])
def test_match_object_takes_all(text):
    assert fragments.match_object(text, 0, 1 << 20) == len(text)


@pytest.mark.parametrize(("text", "budget"), [(b'{"a":1', 100), (b'{"a":"\x01"}', 100), (b'{\x02"a":1}', 100), (b'{"a":1}', 3), (b'["a"]', 100), (b'{"a', 100)])
def test_match_object_takes_none(text, budget):
    assert fragments.match_object(text, 0, budget) is None


def test_chunk_between_binary():
    found = fragments.Fragments().discover(bytes.fromhex("33140103b3ff") + CHUNK + bytes.fromhex("0042fe"))
    assert [(p.start, p.end) for p in found] == [(6, 6 + len(CHUNK))]
    assert found[0].anchor == '"chunkStartSegmentIndex"'


def test_smallest_enclosing_object():
    found = fragments.Fragments().discover(b'{"outer":' + CHUNK + b',"other":1}')
    assert [p.value["segmentTexts"] for p in found] == [["hi"]]


def test_several_anchors_and_malformed():
    data = CHUNK[:-1] + b',"headerMetadata":{"orderedChunkMetadata":[{"id":"header"}]}}'
    assert 1 <= len(fragments.Fragments().discover(data)) <= 2
    assert fragments.Fragments().discover(b'{"segmentTexts":[unquoted]}') == []
    assert fragments.Fragments().discover(b'\xff\xfe{"package":{"name":"x"}}\xff')[0].value == {"package": {"name": "x"}}


def test_payload_limit_and_custom_anchor():
    data = b"".join(b'{"package":%d}' % i for i in range(5))
    assert len(fragments.Fragments(limits=Limits(payloads=3)).discover(data)) == 3
    assert fragments.Fragments(('"k"',)).discover(b'xx{"k":1}')[0].value == {"k": 1}


# ---- framing


def test_scalars():
    assert envelope.parse(b"\x31\x01\x03\xff\x05\x01\x02\x07\x01\x00\x00\x00\x0b\x0c\x0d\x0e\x01a\x32") == [0, 255, 513, 1, True, False, None, "a"]


def test_interning_late_definition_and_undefined():
    assert envelope.parse(b"\x31" + writer.define(7, "seven") + b"\x11\x07\x11\x09\x32") == ["seven", ""]
    assert envelope.parse(b"\x33" + b"\x0e\x01k" + b"\x01" + writer.define(300, "late") + b"\x34").get("k") == 0
    assert envelope.parse(writer.define(300, "wide") + b"\x12\x2c\x01") == "wide"


def test_blob_range_and_trailing_bytes():
    data = b"\x21\x03abc" + b"trailing"
    assert envelope.parse(data) == envelope.Blob(2, 3)


def test_first_of_equal_keys():
    assert envelope.parse(b"\x33\x0e\x01k\x03\x01\x0e\x01k\x03\x02\x34").get("k") == 1


@pytest.mark.parametrize("bad", [b"\x7f", b"\x33\x0e\x01k", b"\x0e\xffabc", b"\x31" * 5000, b""])
def test_framing_errors(bad):
    with pytest.raises(envelope.EnvelopeError):
        envelope.parse(bad)


def test_sample_index():
    content = b'{"segmentTexts":["hello"]}'
    data = writer.summary({"E": ("LoopCanvasComponentSingleton", content)}, {"CanvasComponentHandle": "/E"}, 7, 8, ["{}", "x"])
    index = envelope.read(data)
    assert index.paths["E-content"] == "/.app/.channels/E/content"
    assert len(index.blobs) == 3 and index.channels == {"E": "LoopCanvasComponentSingleton"} and index.handles == {"CanvasComponentHandle": "/E"}
    assert (index.snapshot_seq, index.first_delta_seq, index.deltas) == (7, 8, ["{}", "x"])
    blob = index.blobs["E-content"]
    assert data[blob.start : blob.start + blob.len] == content
    assert [p.value for p in fragments.EnvelopeBlobs().discover(data)][1] == {"segmentTexts": ["hello"]}


def test_not_an_envelope():
    for value in ({"a": 1}, {"snapshot": {"x": 1}}, [1]):
        with pytest.raises(envelope.EnvelopeError, match="not an envelope"):
            envelope.read(writer.frame(value))


json_like = st.recursive(st.none() | st.booleans() | st.integers(0, 2**32 - 1) | st.text(max_size=300), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


@settings(max_examples=100, deadline=None)
@given(json_like)
def test_framing_round_trip(value):
    def plain(x):
        return {k: plain(v) for k, v in x} if isinstance(x, envelope.Pairs) else [plain(v) for v in x] if isinstance(x, list) else x

    assert plain(envelope.parse(writer.frame(value))) == value


# ---- chunks and segments


def test_segment_shapes():
    assert segments.segment("bare")["text"] == "bare"
    s = segments.segment({"text": "t", "props": {"format!bold": True, "format!italic": "true", "z": 1, "a": 2}})
    assert (s["kind"], s["bold"], s["italic"], s["keys"]) == ("text", True, None, ["format!bold", "format!italic", "z", "a"])
    assert segments.segment({"marker": {"refType": 1}, "props": 3})["ref_type"] == 1
    for other in ({"x": 1}, 5, None, [1]):
        assert segments.segment(other)["kind"] == "unknown"


@pytest.mark.parametrize("change", [{"chunkSegmentCount": "1"}, {"chunkSegmentCount": -1}, {"chunkStartSegmentIndex": None}, {"totalSegmentCount": 1.5}, {"totalLengthChars": True}, {"segmentTexts": None}, {"segmentTexts": "x"}])
def test_wrong_counters_drop_the_chunk(change):
    assert segments.chunk(json.loads(CHUNK) | change) is None


def test_chunk_defaults():
    got = segments.chunk({"segmentTexts": [], "chunkSequenceNumber": -3, "chunkSegmentCount": None})
    assert (got["start_index"], got["sequence_number"], got["segment_count"]) == (0, -3, None)


# ---- operations


def text_of(parts):
    return "".join(s["text"] for s in parts if s["kind"] == "text")


def ops(*raw):
    return oplog.operations([writer.delta("chan-1", x) for x in raw])


def test_nested_insert_and_malformed():
    got = oplog.operations(["not json", writer.delta("chan-1", writer.insert(0, "x")), "{}", "[1"])
    assert [(o["channel"], o["data_structure"], o["kind"], o["pos1"]) for o in got] == [("chan-1", "text", "insert", 0)]


def test_group_and_incomplete_operations():
    group = {"type": 3, "ops": [writer.insert(0, "a"), writer.remove(0, 1), {"type": 2, "pos1": 0, "pos2": 1, "props": {"b": 1}}, {"type": 1, "pos1": 0}, {"type": 0}]}
    assert [o["kind"] for o in ops(group)] == ["insert", "remove", "annotate"]


@pytest.mark.parametrize(("raw", "text", "applied", "skipped"), [
    ([writer.insert(0, "world"), writer.insert(0, "hello "), writer.insert(11, "!")], "hello world!", 3, 0),
    ([writer.insert(0, "abcd"), writer.insert(2, "XY")], "abXYcd", 2, 0),
    ([writer.insert(0, "abcdef"), writer.remove(1, 3)], "adef", 2, 0),
    ([writer.insert(0, "abc"), writer.insert(3, "def"), writer.remove(2, 4)], "abef", 3, 0),
    ([writer.insert(9, "late")], "late", 0, 1),
    ([writer.insert(0, "a"), {"type": 2, "pos1": 0, "pos2": 1, "props": {}}], "a", 1, 1),
    ([writer.insert(0, "a😀b"), writer.insert(3, "X")], "a😀Xb", 2, 0),
    ([writer.insert(0, "😀"), writer.insert(1, "X")], "😀X", 1, 1),
    ([writer.insert(0, "abc"), writer.remove(2, 1), writer.remove(1, 9)], "abc", 1, 2),
])
def test_replay(raw, text, applied, skipped):
    r = oplog.replay([], ops(*raw))
    assert (text_of(r.segments), r.applied, r.skipped) == (text, applied, skipped)


def test_replay_on_markers():
    marker = segments.segment({"marker": {"refType": 1}})
    r = oplog.replay([marker, marker], ops(writer.insert(1, "mid")))
    assert [s["kind"] for s in r.segments] == ["marker", "text", "marker"] and r.skipped == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 30), st.integers(0, 8), st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=5)), max_size=12))
def test_replay_against_a_plain_string(steps):
    text, raw = "", []
    for insert, at, n, new in steps:
        units = text.encode("utf-16-le")
        if insert:
            raw.append(writer.insert(at, new))
            ok = 2 * at <= len(units) and _splits(units, 2 * at)
            text = (units[: 2 * at] + new.encode("utf-16-le") + units[2 * at :]).decode("utf-16-le") if ok else text + new
        else:
            raw.append(writer.remove(at, at + n))
            if n and 2 * (at + n) <= len(units) and _splits(units, 2 * at) and _splits(units, 2 * (at + n)):
                text = (units[: 2 * at] + units[2 * (at + n) :]).decode("utf-16-le")
    assert text_of(oplog.replay([], ops(*raw)).segments) == text


def _splits(units, at):
    return at >= len(units) or not 0xDC <= units[at + 1] < 0xE0


def naive_replay(text, ops):
    """The text as UTF-16 units after ops, and how many were done."""
    units, done = list(memoryview(text.encode("utf-16-le")).cast("H")), 0
    fits = lambda p: p <= len(units) and not (p < len(units) and 0xDC00 <= units[p] < 0xE000)
    for op in ops:
        if op["kind"] == "insert":
            new = [u for s in op["segments"] for u in memoryview(s["text"].encode("utf-16-le")).cast("H")]
            at = op["pos1"] if fits(op["pos1"]) else len(units)
            done += fits(op["pos1"])
            units[at:at] = new
        elif op["kind"] == "remove" and op["pos1"] < op["pos2"] and fits(op["pos1"]) and fits(op["pos2"]):
            del units[op["pos1"] : op["pos2"]]
            done += 1
    return b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le"), done


def _text(t):
    return {"kind": "text", "text": t}


@pytest.mark.parametrize("seed", range(6))
def test_replay_is_that_of_the_naive_text(seed, monkeypatch):
    monkeypatch.setattr(oplog.Rope, "BLOCK", 3)
    rng = random.Random(seed)
    ops, size = [], 8
    for _ in range(300):
        if rng.random() < 0.6:
            t = "".join(rng.choice("ab\u00e9\U0001f600") for _ in range(rng.randrange(4)))
            ops.append({"kind": "insert", "pos1": rng.randrange(size + 3), "segments": [_text(t), _text("z")]})
            size += len(t) + 1
        else:
            a = rng.randrange(size)
            ops.append({"kind": rng.choice(["remove", "remove", "annotate"]), "pos1": a, "pos2": a + rng.randrange(5), "segments": None})
    got, want = oplog.replay([_text("base"), _text("text")], ops), naive_replay("basetext", ops)
    assert "".join(s["text"] for s in got.segments) == want[0]
    assert got.applied == want[1] and got.applied + got.skipped == len(ops)


def test_many_operations_replay_in_seconds():
    rng, n = random.Random(1), 100_000
    ops = [{"kind": "insert", "pos1": rng.randrange(i + 1), "segments": [_text("x")]} for i in range(n)]
    began = time.perf_counter()
    assert sum(len(s["text"]) for s in oplog.replay([], ops).segments) == n
    assert time.perf_counter() - began < 30
