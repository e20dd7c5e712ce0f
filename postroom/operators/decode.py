"""Tables from files: each decoder turns a file's bytes into rows, Arrow batch by Arrow batch.

A decoder reads one file at a time and holds nothing but that file; Arrow batches, in and
out, are bounded by rows and bytes. In permissive mode a
file that can't be read gives no rows, and a row of ``warnings`` with code ``parse_error``;
with ``strict_errors`` it fails the task.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import cfb, dims, mapi, message, mime, pst
from ..session import ARROW_BYTES, ARROW_ROWS, arrow_batches

Rows = Iterator[tuple]
SLICE = 1 << 20

SCHEMAS = {
    "cfb_header": "major int, minor int, sector_size int, mini_size int, cutoff bigint, dir_start bigint, fat_sectors bigint, mini_fat_start bigint, difat_sectors bigint",
    "cfb_dirents": "sid int, parent_sid int, child_ord int, path string, name string, type string, color string, left_sid bigint, right_sid bigint, child_sid bigint, clsid binary, state_bits bigint, create_time binary, modify_time binary, start_sector bigint, size bigint",
    "cfb_streams": "sid int, parent_sid int, path string, name string, content binary",
    "cfb_fat": "sector bigint, next bigint",
    "named_map": "pseudo_code int, code bigint, code_str string, guid binary, name string",
    "props": "obj_path string, obj_kind string, code bigint, code_str string, guid binary, sym string, ptype int, is_mv boolean, kind string, i bigint, d double, b boolean, s string, bin binary, ts timestamp, arr array<string>",
    "messages": "obj_path string, subject string, sender_name string, sender_email string, body string, body_html string, message_class string, display_to string, display_cc string, display_bcc string, importance int, sensitivity int, message_flags bigint, created timestamp, modified timestamp, delivered timestamp, submitted timestamp, n_recipients int, n_attachments int",
    "recipients": "obj_path string, ord int, name string, email string, type string, address string",
    "attachments": "obj_path string, ord int, filename string, mime_type string, size bigint, data binary, content_id string, location string, disposition string, method int, rendering_position bigint, extension string, is_inline boolean, embedded boolean",
    "mime_parts": "part_path array<int>, ord int, headers array<struct<name:string,value:string>>, content_type string, params map<string,string>, body string, preamble string, epilogue string, multipart boolean, n_parts int",
    "eml": "eml string",
    "pst_header": "version string, encryption int, index_root bigint, descriptor_root bigint",
    "pst_index": "id bigint, offset bigint, size int, u1 int",
    "pst_descriptors": "desc_id bigint, idx_id bigint, idx2_id bigint, parent_desc_id bigint, ord int",
    "pst_id2": "owner_desc_id bigint, id2 bigint, idx_id bigint",
    "pst_items": "desc_id bigint, parent_id bigint, depth int, ord int, type string, display_name string, subject string, message_class string, n_children int",
    "warnings": "ord int, code string, severity string, message string, context string, recoverable boolean",
}


def _long(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v if v is None or _is_unicode(v) else v.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


def _is_unicode(text: str) -> bool:
    """Whether no surrogate is in it, looked at in slices: a long text is not copied whole."""
    try:
        return text.isascii() or all(text[k : k + SLICE].encode() for k in range(0, len(text), SLICE))
    except UnicodeEncodeError:
        return False


def value_columns(v) -> tuple:
    """(kind, i, d, b, s, bin, ts, arr): a value in the column of its kind."""
    i = d = b = s = raw = ts = arr = None
    if isinstance(v, bool):
        kind, b = "b", v
    elif isinstance(v, int):
        kind, i = "i", _long(v)
    elif isinstance(v, float):
        kind, d = "d", v
    elif isinstance(v, str):
        kind, s = "s", _text(v)
    elif isinstance(v, bytes):
        kind, raw, s = "bin", v, _text(v)
    elif isinstance(v, datetime):
        kind, ts = "ts", v
    else:
        kind, arr = "arr", [x.hex() if isinstance(x, bytes) else x if isinstance(x, str) else json.dumps(x, default=str) for x in v]
    return kind, i, d, b, s, raw, ts, arr


def objects(msg: message.Message, path: str = "/") -> Iterator[tuple[str, str, mapi.Properties]]:
    yield path, "message", msg.properties
    for k, r in enumerate(msg.recipients):
        yield f"{path}r{k}", "recipient", r.properties
    for k, a in enumerate(msg.attachments):
        yield f"{path}a{k}", "attachment", a.properties
        if a.embedded is not None:
            yield from objects(a.embedded, f"{path}a{k}/")


def messages(msg: message.Message, path: str = "/") -> Iterator[tuple[str, message.Message]]:
    yield path, msg
    for k, a in enumerate(msg.attachments):
        if a.embedded is not None:
            yield from messages(a.embedded, f"{path}a{k}/")


def _msg_props(raw: bytes) -> Rows:
    for path, kind, p in objects(message.read_message(raw)):
        for (code, guid), v in p.values.items():
            ptype = p.kinds.get((code, guid), 0)
            number = isinstance(code, int)
            yield (path, kind, code if number else None, None if number else code, guid, dims.symbol(code, guid), ptype & 0x0FFF, bool(ptype & dims.MULTI), *value_columns(v))


def _when(v):
    return v if isinstance(v, datetime) else None


def _int(v):
    return v if isinstance(v, int) and not isinstance(v, bool) else None


def _msg_messages(raw: bytes) -> Rows:
    for path, m in messages(message.read_message(raw)):
        p = m.properties
        yield (
            path, *(_text(p.text(k)) for k in ("pr_subject", "pr_sender_name")), _text(message.sender(p)), _text(p.body()), _text(p.body_html()),
            *(_text(p.text(k)) for k in ("pr_message_class", "pr_display_to", "pr_display_cc", "pr_display_bcc")),
            *(_int(p.get(k)) for k in ("pr_importance", "pr_sensitivity", "pr_message_flags")),
            *(_when(p.get(k)) for k in ("pr_creation_time", "pr_last_modification_time", "pr_message_delivery_time", "pr_client_submit_time")),
            len(m.recipients), len(m.attachments),
        )


def _msg_recipients(raw: bytes) -> Rows:
    for path, m in messages(message.read_message(raw)):
        for k, r in enumerate(m.recipients):
            yield path, k, _text(r.name), _text(r.email), r.type, _text(str(r))


def _msg_attachments(raw: bytes) -> Rows:
    for path, m in messages(message.read_message(raw)):
        for k, a in enumerate(m.attachments):
            p, data = a.properties, a.data
            yield (
                path, k, _text(a.filename), _text(a.mime_type) or dims.media_type(a.filename), len(data or b""), data, _text(a.content_id), _text(a.location),
                _text(p.text("pr_attach_content_disposition")), _int(p.get("pr_attach_method")), _int(p.get("pr_rendering_position")), _text(p.text("pr_attach_extension")), a.inline, a.embedded is not None,
            )


def _cfb_header(raw: bytes) -> Rows:
    h = cfb.parse_header(raw)
    yield h.major, h.minor, h.sector_size, h.mini_size, h.cutoff, h.dir_start, h.fat_sectors, h.mini_fat_start, h.difat_sectors


def _cfb_dirents(raw: bytes) -> Rows:
    for d in cfb.CompoundFile(raw).walk():
        yield d.sid, d.parent, d.ord, d.path, d.name, d.type, d.color, d.left, d.right, d.child, d.clsid, d.state, d.created, d.modified, d.start, _long(d.size)


def _cfb_streams(raw: bytes) -> Rows:
    f = cfb.CompoundFile(raw)
    for d in f.walk():
        if d.type == "stream":
            yield d.sid, d.parent, d.path, d.name, f.read(d)


def _named(raw: bytes) -> Rows:
    for pseudo, (code, guid) in message.named_properties(raw).items():
        number = isinstance(code, int)
        yield pseudo, code if number else None, None if number else code, guid, dims.symbol(code, guid)


def _mime_rows(m: mime.Mime) -> Rows:
    for path, p in mime.walk(m):
        yield (
            list(path), path[-1] if path else 0, [(_text(n), _text(v)) for n, v in p.headers], _text(p.content_type), {_text(k): _text(v) for k, v in p.params.items()},
            _text(p.body), _text(p.preamble), _text(p.epilogue), p.multipart, len(p.parts),
        )


def _pst_items(raw: bytes) -> Rows:
    s = pst.open_store(raw)
    for n, (key, depth) in enumerate(pst.walk(s)):
        p = pst.properties(s, key)
        parent = s.descriptors[key][2]
        yield _long(key), parent, depth, n, pst.item_type(p), _text(pst.display_name(p)), _text(p.text("pr_subject")), _text(p.text("pr_message_class")), len(s.children.get(key, []))


def _pst_props(raw: bytes) -> Rows:
    s = pst.open_store(raw)
    for key, _ in pst.walk(s):
        p = pst.properties(s, key)
        for (code, guid), v in p.values.items():
            ptype = p.kinds.get((code, guid), 0)
            yield (str(key), "item", code, None, guid, dims.symbol(code, guid), ptype & 0x0FFF, bool(ptype & dims.MULTI), *value_columns(v))


def _pst_header(raw: bytes) -> Rows:
    version, enc, one, two = pst.parse_header(raw)
    yield version, enc, _long(one), _long(two)


def _pst_index(raw: bytes) -> Rows:
    for key, (offset, size, u1) in pst.open_store(raw).index.items():
        yield _long(key), _long(offset), size, u1


def _pst_descriptors(raw: bytes) -> Rows:
    for n, (key, (idx, idx2, parent)) in enumerate(pst.open_store(raw).descriptors.items()):
        yield _long(key), _long(idx), _long(idx2), parent, n


def _pst_id2(raw: bytes) -> Rows:
    s = pst.open_store(raw)
    for key, (_, idx2, _) in s.descriptors.items():
        for a, b in pst.associations(s, idx2).items():
            yield _long(key), _long(a), _long(b)


def _warned(read: Callable[[bytes], list]) -> Callable[[bytes], Rows]:
    def rows(raw: bytes) -> Rows:
        try:
            found = read(raw)
        except Exception as e:  # noqa: BLE001 - reported as a row, with the file's name beside it
            found = [mime.warning("parse_error", str(e) or type(e).__name__, None, "error", False)]
        for k, (code, severity, text, context, recoverable) in enumerate(found):
            yield k, code, severity, _text(text), _text(context), recoverable

    return rows


DECODERS: dict[tuple[str, str], Callable[[bytes], Rows]] = {
    ("msg", "cfb_header"): _cfb_header,
    ("msg", "cfb_dirents"): _cfb_dirents,
    ("msg", "cfb_streams"): _cfb_streams,
    ("msg", "cfb_fat"): lambda raw: enumerate(cfb.CompoundFile(raw).fat),
    ("msg", "named_map"): _named,
    ("msg", "props"): _msg_props,
    ("msg", "messages"): _msg_messages,
    ("msg", "recipients"): _msg_recipients,
    ("msg", "attachments"): _msg_attachments,
    ("msg", "mime_parts"): lambda raw: _mime_rows(message.to_mime(message.read_message(raw))),
    ("msg", "eml"): lambda raw: [(_text(message.to_eml(message.read_message(raw))),)],
    ("msg", "warnings"): _warned(lambda raw: message.read_message(raw).warnings),
    ("eml", "mime_parts"): lambda raw: _mime_rows(mime.parse(raw)),
    ("eml", "eml"): lambda raw: [(_text(mime.serialise(mime.parse(raw))),)],
    ("eml", "warnings"): _warned(lambda raw: mime.parse(raw).warnings),
    ("pst", "pst_header"): _pst_header,
    ("pst", "pst_index"): _pst_index,
    ("pst", "pst_descriptors"): _pst_descriptors,
    ("pst", "pst_id2"): _pst_id2,
    ("pst", "pst_items"): _pst_items,
    ("pst", "props"): _pst_props,
    ("pst", "warnings"): _warned(lambda raw: pst.open_store(raw).warnings),
}


def decoded(files: DataFrame, kind: str, table: str, strict_errors: bool = False, tags: Iterable[tuple[int, str, str]] = (), substitution: bytes | None = None) -> DataFrame:
    """Rows of ``table`` from ``files`` (file_id, content): file_id first, then the table's columns.

    ``tags`` (code, name, kind) join the built-in ones; ``substitution`` decodes encoded stores.
    """
    arrow_batches(files.sparkSession)
    decode = DECODERS[kind, table]
    id_kind = files.schema["file_id"].dataType
    schema = T.StructType([T.StructField("file_id", id_kind), *T.StructType.fromDDL(SCHEMAS[table]).fields])
    arrow = to_arrow_schema(schema)
    tags = list(tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims.use(tags, substitution)
        yield from packed(rows(batches), arrow)

    def rows(batches: Iterator[pa.RecordBatch]) -> Rows:
        for batch in batches:
            for file_id, content in zip(batch.column(0), batch.column(1), strict=True):
                found = read(content.as_py())
                while found:
                    yield file_id.as_py(), *found.pop()

    def read(raw: bytes | str | None) -> list[tuple]:
        """A file's rows, the last one first; mail is text already, other kinds take bytes."""
        if isinstance(raw, str) and kind != "eml":
            raw = raw.encode("utf-8", "surrogateescape")
        try:
            return list(decode(raw or b""))[::-1]
        except Exception:  # noqa: BLE001 - ``warnings`` says why
            if strict_errors:
                raise
            return []

    return files.select("file_id", "content").mapInArrow(run, schema)


def packed(rows: Rows, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``ARROW_ROWS``; one ends with the row that brings it to ``ARROW_BYTES``.

    No row is kept once its batch is made.
    """
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([_array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema.names)
        out.clear()
        return made

    for row in rows:
        out.append(row)
        size += _size(row)
        del row
        if len(out) >= ARROW_ROWS or size >= ARROW_BYTES:
            yield batch()
            size = 0
    if out:
        yield batch()


def _size(v) -> int:
    """Memory of all texts and bytes in a value: up to four bytes a sign."""
    if isinstance(v, str | bytes):
        return sys.getsizeof(v)
    if isinstance(v, dict):
        v = [*v.items()]
    return sum(map(_size, v)) if isinstance(v, list | tuple) else 0


def _array(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        names = [f.name for f in kind.value_type]
        values = [None if v is None else [dict(zip(names, x, strict=True)) for x in v] for v in values]
    if pa.types.is_map(kind):
        values = [None if v is None else list(v.items()) for v in values]
    return pa.array(values, kind)
