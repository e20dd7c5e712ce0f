from __future__ import annotations

import random
import struct
from datetime import datetime, timezone

import pytest

from postroom.functions import cfb, dims, mapi, message, mime, pst, rtf
from postroom.sources import synthetic as make


#: A permutation that stands for the table of encoded stores.
SUBSTITUTION = bytes((0x47 + 77 * k) % 256 for k in range(256))

# -- dictionaries and values


def test_dictionaries():
    assert (len(dims.TAGS), len(dims.NAMED), len(dims.SETS)) == (197, 78, 16)
    assert dims.TAGS[0x0037] == ("pr_subject", "pt_tstring") and dims.TAG_CODES["pr_smtp_address"] == 0x39FE
    assert dims.symbol(0x0037) == "pr_subject" and dims.symbol("x") is None and dims.symbol(0x0037, dims.PS_PUBLIC_STRINGS) is None
    assert dims.key_text(0x0037) == "pr_subject" and dims.key_text(0x7ABC) == "7abc" and dims.key_text("k", dims.PS_PUBLIC_STRINGS) == '"k"@ps_public_strings'
    assert dims.key_text(0x0999, bytes(16)) == "0999@unknown"
    g = "{0A1B2C3D-4E5F-6071-8293-A4B5C6D7E8F9}"
    assert dims.guid_text(dims.guid_bytes(g)) == g and dims.guid_bytes(g)[:4].hex() == "3d2c1b0a"
    with pytest.raises(ValueError):
        dims.guid_bytes("1-2-3-4-5")
    assert dims.kind_label(0x101F) == "pt_mv_unicode" and dims.kind_label(0x03) == "pt_long" and dims.kind_label(0x99) == "unknown"
    assert dims.media_type("A.PDF") == "application/pdf" and dims.media_type("none") == dims.media_type(".pdf") == "application/octet-stream"


def test_published_tags():
    assert not {c for c, _, _ in dims.PUBLISHED} & set(dims.TAGS)
    try:
        dims.use(dims.PUBLISHED)
        assert len(dims.TAGS) == 281 and [dims.key_text(c) for c in (0x0001, 0x3A2D, 0x6000)] == ["pr_acknowledgement_mode", "pr_telex_number", "pr_recipient_trackstatus"]
        assert all(k in ("pt_binary", "pt_boolean", "pt_long", "pt_object", "pt_systime", "pt_tstring") for _, k in dims.TAGS.values())
    finally:
        dims.use()


def test_more_tags_and_a_substitution():
    more = dims.entries("0001 acknowledgement_mode long\n0037 topic tstring")
    try:
        dims.use(more, SUBSTITUTION)
        assert dims.symbol(1) == "pr_acknowledgement_mode" and dims.symbol(0x0037) == "pr_topic" and dims.TAG_CODES["pr_topic"] == 0x37 and len(dims.TAGS) == 198
        assert pst.decrypt(b"\0", 1) == b"\x47" and pst.decrypt(b"\0", 0) == b"\0" == pst.decrypt(b"\0", 7)
        with pytest.raises(ValueError):
            dims.use((), b"short")
    finally:
        dims.use()
    assert dims.symbol(1) is None and dims.symbol(0x0037) == "pr_subject" and pst.decrypt(b"\0", 1) == b"\0"


@pytest.mark.parametrize(
    ("code", "raw", "want"),
    [
        (0x02, b"\xff\xff", 65535), (0x03, b"\xff\xff\xff\xff", -1), (0x0A, b"\xff\xff\xff\xff", 2**32 - 1), (0x05, struct.pack("<d", 1.5), 1.5), (0x06, struct.pack("<q", 12345), 1.2345),
        (0x0B, b"\x01\x00\x09", True), (0x0B, b"\0\0", False), (0x14, struct.pack("<q", -7), -7), (0x1E, b"ab\0\0", b"ab"), (0x1F, "é\0".encode("utf-16-le"), "é"), (0x1F, b"a\0b", "a"),
        (0x102, b"\0\1", b"\0\1"), (0x03, b"\1", b"\1"), (0x40, bytes(8), bytes(8)), (0x48, dims.PS_MAPI, "{00020328-0000-0000-C000-000000000046}"), (0x77, b"q", b"q"),
        (0x40, struct.pack("<Q", 116444736000000010), datetime(1970, 1, 1, 0, 0, 0, 1, tzinfo=timezone.utc)),
    ],
)
def test_values(code, raw, want):
    assert mapi.decode_value(code, raw) == want


def test_wide_text_modes():
    odd = b"a\0b"
    assert mapi.utf16(odd, "stream") == odd and mapi.utf16(odd, "value") == "a"
    lone = b"a\0\x00\xd8"
    assert mapi.utf16(lone, "value") == lone and mapi.utf16(lone, "prefix") == "a" and mapi.lpwstr(lone) is None


def test_stream_names():
    assert mapi.stream_name("__substg1.0_0037001F") == (0x37, 0x1F, None)
    assert mapi.stream_name("__substg1.0_8001101f-0000000A") == (0x8001, 0x101F, 10)
    assert mapi.stream_name("__substg1.0_0037001") is None and mapi.stream_name("__properties_version1.0") is None


def test_named_map():
    text = "Keyword".encode("utf-16-le")
    entries = struct.pack("<IIII", 0x8005, 2 << 1, 0, 1 << 1 | 1) + struct.pack("<II", 99, 1)
    got = mapi.named_map(dims.SETS["psetid_address"], entries, struct.pack("<I", len(text)) + text)
    assert got == {0x8000: (0x8005, dims.SETS["psetid_address"]), 0x8001: ("Keyword", dims.PS_PUBLIC_STRINGS), 0x8002: (99, dims.PS_MAPI)}
    assert mapi.resolve(0x8000, got)[0] == 0x8005 and mapi.resolve(0x9000, got) == (0x9000, dims.PS_MAPI)


def test_lookups():
    sub = dims.TAG_CODES["pr_subfolders"]
    p = mapi.Properties({(sub, dims.PS_MAPI): False, (0x5909, dims.PS_MAPI): "high", (0x39FE, dims.PS_MAPI): "low", (0x0037, dims.PS_MAPI): b"s"})
    assert p.get("pr_subfolders") is None and p.get(sub) is None and p.get(sub, dims.PS_MAPI) is False
    assert p.get("pr_smtp_address") == "low" and p.text("pr_subject") == "s" and p.symbolic()["pr_subject"] == b"s"


# -- RTF


def test_decompression():
    raw = b"{\\rtf1 Some text that is longer than one group of flags}"
    assert rtf.decompress(make.packed_rtf(raw)) == raw
    assert rtf.decompress(struct.pack("<4I", 0, 4, rtf.PLAIN, 0) + b"abcdef") == b"abcd"
    # "{\rtf1" is in the seed at 0: one reference of 6 bytes, then a literal, then the end mark.
    body = bytes([0b00000101]) + struct.pack(">H", 0 << 4 | 4) + b"X" + struct.pack(">H", (207 + 7) << 4)
    assert rtf.decompress(struct.pack("<4I", 0, 99, rtf.PACKED, 0) + body) == b"{\\rtf1X"
    for bad in (b"", struct.pack("<4I", 0, 0, 1, 0)):
        with pytest.raises(rtf.RtfError):
            rtf.decompress(bad)


def test_html_in_rtf():
    src = rb"{\rtf1\fromhtml1 {\*\htmltag64 <p>}Hi\'e9\par {\*\mhtmltag84 x}{\*\htmltag84 skipped}\htmlrtf hidden\htmlrtf0 a\{b\}\tab c{\*\htmltag72 </p>}}"
    assert rtf.to_html(src) == b"<p>Hi\xe9\r\nxa{b}\tc</p>"
    assert rtf.to_html(rb"{\rtf1 plain}") is None and rtf.to_html(rb"{\fromhtml1 no tags}") is None


def test_text_in_rtf():
    src = rb"{\rtf1\ansi{\*\gen {x} y;}Hello\par World\pard\endash\emdash \{ok\} \\ \'41\bullet}"
    assert rtf.to_text(src) == b"Hello\nWorld--{ok} \\ A*"  # a dash behind a control word is taken for its sign
    assert rtf.to_text(rb"{\*\open never closed") == b"\\*never closed"


# -- compound files and messages

BIG = bytes(range(256)) * 40


def test_compound_file_roundtrip():
    tree = {"small": b"abc", "empty": b"", "big": BIG, "dir": {"inner": b"x" * 70, "deeper": {"leaf": b"y"}}}
    f = cfb.CompoundFile(make.compound_file(tree))
    paths = {d.path: f.read(d) for d in f.walk() if d.type == "stream"}
    assert paths == {"/small": b"abc", "/empty": b"", "/big": BIG, "/dir/inner": b"x" * 70, "/dir/deeper/leaf": b"y"}
    assert f.find(f.root, "SMALL").name == "small" and f.find(f.root, "none") is None and f.read_name(f.root, "big") == BIG
    assert f.header.sector_size == 512 and cfb.sector_offset(3, 512) == 2048
    with pytest.raises(cfb.CfbError):
        f.must_find(f.root, "none")


def test_header_checks():
    good = bytearray(make.compound_file({"a": b"1"}))
    for at, value in ((0, 0), (28, 0), (26, 9), (30, 1), (32, 1), (56, 1)):
        bad = bytearray(good)
        bad[at] = value
        with pytest.raises(cfb.CfbError):
            cfb.parse_header(bytes(bad))
    with pytest.raises(cfb.CfbError):
        cfb.parse_header(b"short")


def test_chains():
    assert cfb.chain([1, 2, cfb.END], 0) == [0, 1, 2] and cfb.chain([1, 0], 0) == [0, 1] and cfb.chain([], cfb.END) == [] and cfb.chain([9], 0) == [0, 9]


def sample(**more) -> bytes:
    inner = make.message_tree({0x0037: "Inner", 0x1000: "inner body"}, [{0x3001: "Deep", 0x39FE: "deep@x.org"}])
    props = {0x0037: "Grüße", 0x0C1A: "Ann", 0x0C1E: "smtp", 0x0C1F: "ann@x.org", 0x1000: "Käse", 0x1013: b"<p>hi</p>", 0x0017: 2, 0x0036: 3, 0x0E06: datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc), 0x1035: "<id@x>"}
    return make.msg_file(
        props | more.pop("props", {}),
        [{0x3001: "Bob", 0x39FE: "bob@x.org", 0x0C15: 1}, {0x3001: "Cy", 0x3003: "cy@x.org", 0x0C15: 2}, {0x39FE: "me@x.org", 0x0C15: 0}],
        [{0x3707: "a.pdf", 0x3701: b"PDF" * 50}, {0x3704: "pic.png", 0x3701: b"PNG", 0x3712: "cid1"}, {0x3001: "fwd", 0x3705: 5, "msg": inner}],
        **more,
    )


def test_message():
    m = message.read_message(sample())
    assert m.properties.text("pr_subject") == "Grüße" and not m.warnings
    assert [(r.name, r.email, r.type) for r in m.recipients] == [("Bob", "bob@x.org", "to"), ("Cy", "cy@x.org", "cc"), (None, "me@x.org", "orig")]
    assert [a.filename for a in m.attachments] == ["a.pdf", "pic.png", "attachment"] and [a.inline for a in m.attachments] == [False, True, False]
    assert m.attachments[2].embedded.properties.text("pr_subject") == "Inner" and str(m.attachments[2].embedded.recipients[0]) == '"Deep" <deep@x.org>'
    assert m.properties.body() == "Käse" and m.properties.body_html() == "<p>hi</p>"


def test_message_to_mime():
    eml = message.to_eml(message.read_message(sample()), "seed")
    assert eml == message.to_eml(message.read_message(sample()), "seed")
    m = mime.parse(eml)
    assert [n for n, _ in m.headers] == ["From", "To", "Cc", "Subject", "Date", "Message-ID", "MIME-Version", "Importance", "X-Priority", "Sensitivity", "Content-Type"]
    assert m.get("from") == '"Ann" <ann@x.org>' and m.get("date") == "Tue, 02 Jan 2024 03:04:05 +0000" and m.get("subject") == "Grüße" and m.get("x-priority") == "1"
    assert [p.content_type for p in m.parts] == ["multipart/related", "application/pdf", "message/rfc822"]
    assert [p.content_type for p in m.parts[0].parts] == ["multipart/alternative", "image/png"] and m.parts[0].parts[1].get("content-id") == "<cid1>"
    import email
    from email import policy

    theirs = email.message_from_string(eml, policy=policy.default)
    assert [p.get_content_type() for p in theirs.walk()][:4] == ["multipart/mixed", "multipart/related", "multipart/alternative", "text/plain"]


def test_bodies_fall_back():
    html = rb"{\rtf1\fromhtml1 {\*\htmltag64 <b>}x{\*\htmltag64 </b>}}"
    read = lambda p: message.read_message(make.msg_file(p)).properties
    assert read({0x1009: make.packed_rtf(html)}).body() == "<b>x</b>" == read({0x1009: make.packed_rtf(html)}).body_html()
    assert read({0x1009: make.packed_rtf(rb"{\rtf1 words}")}).body() == "words" and read({0x1009: b"bad"}).body() is None
    assert read({0x1013: b"caf\xe9"}).body_html() == "café"
    plain = mime.parse(message.to_eml(message.read_message(make.msg_file({0x0037: "s"}))))
    assert plain.content_type == "text/plain" and plain.body == "" and plain.get("content-transfer-encoding") == "7bit"


def test_multi_values_and_names():
    names = {"__substg1.0_00020102": dims.SETS["psetid_address"], "__substg1.0_00030102": struct.pack("<II", 0x8005, 2 << 1), "__substg1.0_00040102": b""}
    m = message.read_message(make.msg_file({0x3A20: ["b", "a"], 0x8000: "filed"}, names=names))
    assert m.properties.get(0x3A20) == ["b", "a"] and m.properties.get("file_under") == "filed"


def test_damage_becomes_warnings():
    rng = random.Random(2)
    good = sample()
    for _ in range(150):
        raw = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            raw[rng.randrange(512, len(raw))] ^= 0x5A
        try:
            message.to_eml(message.read_message(bytes(raw)))
        except ValueError:
            pass
    bad = message.read_message(make.msg_file({0x0037: "x", 0x0039: float("nan")}))
    assert [w[0] for w in bad.warnings] == ["property_parse_failed"] and bad.properties.values == {}


# -- stores

ITEMS = [(0x21, 0, {0x3001: "Top", 0x3602: 3}), (0x42, 0x21, {0x3001: "Inbox", dims.TAG_CODES["pr_subfolders"]: True}), (0x64, 0x42, {0x001A: "IPM.Note", 0x0037: "Hello"}), (0x84, 0x42, {0x001A: "IPM.Task.x"}), (0x99, 0x777, {0x0037: "lost"})]


@pytest.mark.parametrize("table", [None, SUBSTITUTION])
def test_store(table, monkeypatch):
    monkeypatch.setattr(dims, "SUBSTITUTION", table)
    s = pst.open_store(make.store_file(ITEMS, table))
    assert (s.version, s.encryption, s.warnings) == ("pst97", int(table is not None), [])
    seen = [(k, d, pst.item_type(p := pst.properties(s, k)), pst.display_name(p)) for k, d in pst.walk(s)]
    assert seen == [(0x21, 0, "folder", "Top"), (0x42, 1, "folder", "Inbox"), (0x64, 2, "message", "Hello"), (0x84, 2, "task", "")]


def test_store_damage():
    for raw, why in ((b"", "header_too_short"), (b"x" * 600, "invalid_magic"), (b"!BDN" + bytes(600), "unknown_index_type")):
        with pytest.raises(pst.PstError, match=why):
            pst.parse_header(raw)
    good = bytearray(make.store_file(ITEMS))
    loop = bytearray(good)
    struct.pack_into("<I", loop, 1024 + 4, 1024)
    assert {w[0] for w in pst.open_store(bytes(loop)).warnings} >= {"pst_branch_loop_detected"}
    gone = bytearray(good)
    struct.pack_into("<I", gone, 0xA0, 1 << 30)
    assert [w[0] for w in pst.open_store(bytes(gone)).warnings] == ["pst_index_parse_failed"]
    own = pst.open_store(make.store_file([(0x21, 0x21, {0x3001: "me"})]))
    assert [k for k, _ in pst.walk(own)] == [0x21]
    rng = random.Random(3)
    for _ in range(150):
        raw = bytearray(good)
        for _ in range(4):
            raw[rng.randrange(11, len(raw))] ^= 0x5A
        s = pst.open_store(bytes(raw))
        for k, _ in pst.walk(s):
            pst.properties(s, k)


def test_store_without_its_substitution():
    s = pst.open_store(make.store_file(ITEMS, SUBSTITUTION))
    assert [w[0] for w in s.warnings] == ["pst_substitution_missing"] and [k for k, _ in pst.walk(s)] == [0x21, 0x42, 0x64, 0x84]
    assert pst.properties(s, 0x64).values == {}
