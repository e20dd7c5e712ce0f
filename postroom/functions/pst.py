"""Personal stores: header, page trees, property blocks and the item tree of one file."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from . import dims, mapi
from .mime import WARN, warning

ROOT, PAGE = 0x21, 512
#: Version byte -> (name, where the encryption byte, index root and descriptor root stand, width of an offset, least size).
LAYOUTS = {0x0E: ("pst97", 0x1CD, 0xA0, 0xA8, 4, 512), 0x17: ("pst2003", 0x201, 0xB8, 0xC0, 8, 514)}
CLASSES = (("ipm.note", "message"), ("ipm.post", "message"), ("ipm.appointment", "appointment"), ("ipm.contact", "contact"), ("ipm.task", "task"), ("ipm.stickynote", "note"), ("ipm.activity", "journal"))


class PstError(ValueError):
    pass


@dataclass
class Store:
    raw: bytes
    version: str
    encryption: int
    index_root: int
    descriptor_root: int
    index: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    descriptors: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    children: dict[int, list[int]] = field(default_factory=dict)
    warnings: list[WARN] = field(default_factory=list)


def parse_header(raw: bytes) -> tuple[str, int, int, int]:
    """(version, encryption, index root, descriptor root)."""
    if len(raw) < 512:
        raise PstError("header_too_short")
    if raw[:4] != b"!BDN":
        raise PstError("invalid_magic")
    if raw[10] not in LAYOUTS:
        raise PstError("unknown_index_type")
    name, enc, one, two, width, least = LAYOUTS[raw[10]]
    if len(raw) < least:
        raise PstError("header_too_short")
    number = lambda at: int.from_bytes(raw[at : at + width], "little")
    return name, raw[enc], number(one), number(two)


def _pages(raw: bytes, root: int, version: str, leaf: int, what: str, warnings: list[WARN]):
    """Leaf records in order, ``leaf`` bytes each; a page met before on its own path is reported and left out."""
    wide = version == "pst2003"
    branch = 24 if wide else 12
    stack = [(root, frozenset())]
    while stack:
        at, above = stack.pop()
        if at == 0:
            continue
        if at in above:
            warnings.append(warning("pst_branch_loop_detected", f"page tree of the {what} refers to itself", f"{what}_offset={at}"))
            continue
        page = raw[at : at + PAGE]
        if len(page) < PAGE:
            continue
        count, level = page[496], page[499]
        if level == 0:
            for k in range(min(count, PAGE // leaf)):
                yield page[k * leaf : (k + 1) * leaf]
            continue
        below = []
        for k in range(min(count, PAGE // branch)):
            entry = page[k * branch : (k + 1) * branch]
            below.append((struct.unpack_from("<QQ" if wide else "<II", entry)[1], above | {at}))
        stack += reversed(below)


def open_store(raw: bytes) -> Store:
    version, enc, one, two = parse_header(raw)
    s = Store(raw, version, enc, one, two)
    wide = version == "pst2003"
    for r in _pages(raw, one, version, 24 if wide else 12, "index", s.warnings):
        key, offset, size, u1 = struct.unpack_from("<QQHH" if wide else "<IIHH", r)
        s.index[key] = (offset, size, u1)
    for r in _pages(raw, two, version, 32 if wide else 16, "descriptor", s.warnings):
        key, idx, idx2, parent = struct.unpack_from("<QQQI" if wide else "<IIII", r)
        s.descriptors[key] = (idx, idx2, parent)
    if one and not s.index:
        s.warnings.append(warning("pst_index_parse_failed", "index tree is empty though its root is set", f"index_offset={one}"))
    if two and not s.descriptors:
        s.warnings.append(warning("pst_descriptor_parse_failed", "descriptor tree is empty though its root is set", f"descriptor_offset={two}"))
    if enc == 1 and dims.SUBSTITUTION is None:
        s.warnings.append(warning("pst_substitution_missing", "the store is encoded and no substitution was given; items have no properties"))
    for key, (_, _, parent) in s.descriptors.items():
        if parent and parent in s.descriptors:
            s.children.setdefault(parent, []).append(key)
    return s


def decrypt(raw: bytes, method: int) -> bytes:
    """Method 1 substitutes bytes by the table in use; 0 and unknown methods leave them, as does method 1 without a table."""
    return raw.translate(dims.SUBSTITUTION) if method == 1 and dims.SUBSTITUTION else raw


def block(s: Store, idx: int) -> bytes | None:
    """A block's bytes as they stand; empty where it lies outside the file, None without an index record."""
    if idx not in s.index:
        return None
    offset, size, _ = s.index[idx]
    return s.raw[offset : offset + size] if offset + size <= len(s.raw) else b""


def associations(s: Store, idx2: int) -> dict[int, int]:
    """Id within the object -> index id; records of 16 bytes where the size allows it, else of 8."""
    raw = decrypt(block(s, idx2) or b"", s.encryption) if idx2 else b""
    wide = len(raw) >= 16 and len(raw) % 16 == 0
    step, fmt = (16, "<QQ") if wide else (8, "<II")
    rows = (struct.unpack_from(fmt, raw, k) for k in range(0, len(raw) - step + 1, step))
    return {a: b for a, b in rows if a}


def properties(s: Store, desc: int) -> mapi.Properties:
    """Properties of an item: what its block says inline, and what it refers to by association."""
    idx, idx2, _ = s.descriptors[desc]
    raw = block(s, idx)
    if raw is None:
        return mapi.Properties()
    raw, links = decrypt(raw, s.encryption), associations(s, idx2)
    if len(raw) < 4 or raw[0] not in (0xBC, 0x7C):
        return mapi.Properties()
    (end,) = struct.unpack_from("<H", raw, 2)
    if end < 4 or end >= len(raw):
        return mapi.Properties()

    def far(at: int) -> bytes | None:
        if at == 0 or at < len(raw) or at not in links:
            return None
        found = block(s, links[at])
        return None if found is None else decrypt(found, s.encryption)

    values, kinds = {}, {}
    for k in range(4, end - 7, 8):
        kind, code, low = struct.unpack_from("<HHI", raw, k)
        base = kind & 0x0FFF
        if base == 0x02:
            value: object = low & 0xFFFF
        elif base == 0x03:
            value = struct.unpack_from("<i", raw, k + 4)[0]
        elif base == 0x0B:
            value = low & 0xFFFF != 0
        elif base in (0x1E, 0x1F, 0x40, 0x102):
            data = far(low)
            if data is None:
                continue
            if base == 0x1E:
                value = mapi.strip_nul(data)
            elif base == 0x1F:
                value = mapi.utf16(data, "prefix")
            elif base == 0x40:
                value = mapi.filetime(struct.unpack("<Q", data)[0]) if len(data) == 8 else None
            else:
                value = data
            if value is None:
                continue
        else:
            value = low
        values[code, dims.PS_MAPI], kinds[code, dims.PS_MAPI] = value, kind
    return mapi.Properties(values, kinds)


def item_type(props: mapi.Properties) -> str:
    known = props.text("pr_message_class")
    if known is None:
        return "folder" if props.get("pr_content_count") is not None or props.get("pr_subfolders") is not None else "message"
    return next((kind for start, kind in CLASSES if known.lower().startswith(start)), "message")


def display_name(props: mapi.Properties) -> str:
    return props.text("pr_display_name") or props.text("pr_subject") or ""


def walk(s: Store, start: int = ROOT):
    """(descriptor, depth) in pre-order; each descriptor once, so loops end."""
    stack, seen = [(start, 0)] if start in s.descriptors else [], set()
    while stack:
        key, depth = stack.pop()
        if key in seen:
            continue
        seen.add(key)
        yield key, depth
        stack += [(c, depth + 1) for c in reversed(s.children.get(key, []))]
