"""Typed property values: decoding of single values, inline records and named-property maps."""

from __future__ import annotations

import re
import struct
from datetime import datetime, timedelta, timezone

from . import dims

EPOCH_GAP = 11_644_473_600
#: Kinds whose value stands in the 8 bytes of an inline record.
FIXED = {0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x0A, 0x0B, 0x14, 0x40}
#: Fixed pattern: the name of a property stream.
_NAME = re.compile(r"^__substg1\.0_([0-9A-Fa-f]{4})([0-9A-Fa-f]{4})(?:-([0-9A-Fa-f]{8}))?$")
Key = tuple[int | str, bytes]


def strip_nul(raw: bytes) -> bytes:
    return raw.rstrip(b"\0")


def filetime(ticks: int) -> datetime | None:
    """UTC time of 100-nanosecond ticks since 1601; None for 0 and beyond year 9999."""
    if not ticks:
        return None
    try:
        return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=ticks // 10 - EPOCH_GAP * 1_000_000)
    except OverflowError:
        return None


def utf16(raw: bytes, mode: str = "value") -> str | bytes:
    """Text of UTF-16LE, trailing NULs off.

    What can't be decoded: ``stream`` gives the bytes back, ``value`` first drops an odd
    last byte, ``prefix`` keeps what an incomplete text has and else gives the bytes back.
    """
    body = raw[: len(raw) & ~1] if mode != "stream" else raw
    try:
        return body.decode("utf-16-le").rstrip("\0")
    except UnicodeDecodeError as e:
        if mode == "prefix" and e.reason == "unexpected end of data":
            return body[: e.start].decode("utf-16-le")
        return raw


def lpwstr(raw: bytes) -> str | None:
    """Text of a counted wide string; None where it is no UTF-16."""
    out = utf16(raw, "value")
    return out if isinstance(out, str) else None


_UNPACK = {0x02: "<H", 0x03: "<i", 0x04: "<f", 0x05: "<d", 0x06: "<q", 0x07: "<d", 0x0A: "<I", 0x14: "<q"}


def decode_value(code: int, raw: bytes):
    """A value of the property type; bytes of another length than the type's come back as they are."""
    base = code & 0x0FFF
    if base in _UNPACK:
        if len(raw) != struct.calcsize(_UNPACK[base]):
            return raw
        value = struct.unpack(_UNPACK[base], raw)[0]
        if base in (0x04, 0x05, 0x07) and value in (float("inf"), float("-inf")) or value != value:
            return raw
        return value / 10_000.0 if base == 0x06 else value
    if base == 0x0B:
        return struct.unpack_from("<H", raw)[0] != 0 if len(raw) >= 2 else raw
    if base == 0x1F:
        return utf16(raw)
    if base == 0x1E:
        return strip_nul(raw)
    if base == 0x40:
        at = filetime(struct.unpack("<Q", raw)[0]) if len(raw) == 8 else None
        return raw if at is None else at
    if base == 0x48:
        return dims.guid_text(raw) if len(raw) == 16 else raw
    return raw


def stream_value(code: int, raw: bytes):
    """A value kept in a stream of its own."""
    base = code & 0x0FFF
    if base == 0x1F:
        return utf16(raw, "stream")
    return decode_value(code, raw)


def stream_name(name: str) -> tuple[int, int, int | None] | None:
    """(code, type, index) that a property stream's name holds."""
    m = _NAME.match(name)
    return (int(m[1], 16), int(m[2], 16), int(m[3], 16) if m[3] else None) if m else None


def inline_records(raw: bytes, prefix: int) -> list[tuple[int, int, object]]:
    """(code, type, value) of the fixed-size records behind ``prefix`` bytes; a short tail is ignored."""
    out = []
    for at in range(prefix, len(raw) - 15, 16):
        kind, code = struct.unpack_from("<HH", raw, at)
        base = kind & 0x0FFF
        if base not in FIXED:
            continue
        slot = raw[at + 8 : at + 16]
        if base in _UNPACK:
            value = decode_value(base, slot[: struct.calcsize(_UNPACK[base])])
            if isinstance(value, bytes):
                raise ValueError(f"no number in property {code:04x}")
        else:
            value = decode_value(base, slot)
        out.append((code, kind, value))
    return out


def named_map(guids: bytes, entries: bytes, strings: bytes) -> dict[int, Key]:
    """Key of each pseudo code from the three streams of a named-property storage."""
    sets = {0: dims.PS_MAPI, 1: dims.PS_PUBLIC_STRINGS}
    sets |= {k // 16 + 2: guids[k : k + 16] for k in range(0, len(guids) - 15, 16)}
    out: dict[int, Key] = {}
    for at in range(0, len(entries) - 7, 8):
        where, flags = struct.unpack_from("<II", entries, at)
        code: int | str = where
        if flags & 1 and len(strings) >= where + 4:
            (size,) = struct.unpack_from("<I", strings, where)
            text = strings[where + 4 : where + 4 + size]
            if len(text) == size:
                try:
                    code = text.decode("utf-16-le")
                except UnicodeDecodeError:
                    code = where
        out[0x8000 + at // 8] = (code, sets.get(flags >> 1 & 0x7FFF, dims.PS_MAPI))
    return out


def resolve(code: int, names: dict[int, Key]) -> Key:
    return names.get(code, (code, dims.PS_MAPI)) if code >= 0x8000 else (code, dims.PS_MAPI)


class Properties:
    """Values by key, with lookups by name and code as readers of messages expect them."""

    def __init__(self, values: dict[Key, object] | None = None, kinds: dict[Key, int] | None = None):
        self.values = values or {}
        self.kinds = kinds or {}

    def _ordered(self):
        return sorted(self.values.items(), key=lambda x: (not isinstance(x[0][0], int), str(x[0][0]).rjust(12), x[0][1]))

    def get(self, key: str | int, guid: bytes | None = None):
        """By name or code: the first value of the lowest code that is neither null nor false; by code and set: exactly."""
        if guid is not None:
            return self.values.get((key, guid))
        hit = (lambda k: dims.symbol(*k) == key) if isinstance(key, str) else (lambda k: k[0] == key)
        return next((v for k, v in self._ordered() if hit(k) and v is not None and v is not False), None)

    def text(self, key: str) -> str | None:
        v = self.get(key)
        return v.decode("utf-8", "surrogateescape") if isinstance(v, bytes) else v if v is None or isinstance(v, str) else str(v)

    def symbolic(self) -> dict:
        return {dims.symbol(*k) or k: v for k, v in self._ordered()}

    def rtf(self) -> bytes | None:
        from . import rtf

        raw = self.get("pr_rtf_compressed")
        try:
            return rtf.decompress(raw) if isinstance(raw, bytes) else None
        except (ValueError, IndexError):
            return None

    def body_html(self) -> str | None:
        from . import rtf

        raw = self.get("pr_body_html")
        if raw is None and (packed := self.rtf()) is not None:
            raw = rtf.to_html(packed)
        if not isinstance(raw, bytes):
            return raw
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    def body(self) -> str | None:
        from . import rtf

        plain = self.text("pr_body")
        if plain is not None or (packed := self.rtf()) is None:
            return plain
        html = rtf.to_html(packed)
        return (html if html is not None else rtf.to_text(packed)).decode("utf-8", "surrogateescape")
