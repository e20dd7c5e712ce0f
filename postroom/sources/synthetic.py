"""Small writers of the binary containers: for tests, the bench and queries without mail files."""

from __future__ import annotations

import struct
from datetime import datetime, timezone

from ..functions.cfb import END, FREE, MAGIC, NONE
from ..functions.rtf import PACKED

Tree = dict[str, "bytes | Tree"]


def compound_file(tree: Tree) -> bytes:
    """A version-3 compound file; values are streams (bytes) or storages (dicts)."""
    rows: list[dict] = [{"name": "Root Entry", "type": 5, "child": NONE, "data": b""}]

    def add(children: Tree) -> int:
        """Siblings as a chain to the right; the first one's number."""
        first, last = NONE, None
        for name, value in children.items():
            sid = len(rows)
            rows.append({"name": name, "type": 1 if isinstance(value, dict) else 2, "child": NONE, "data": b"" if isinstance(value, dict) else value, "right": NONE})
            if last is None:
                first = sid
            else:
                rows[last]["right"] = sid
            last = sid
            if isinstance(value, dict):
                rows[sid]["child"] = add(value)
        return first

    rows[0]["child"] = add(tree)
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        n = -(-len(data) // 512)
        if not n:
            return END
        start = len(sectors)
        for k in range(n):
            sectors.append(data[512 * k : 512 * (k + 1)].ljust(512, b"\0"))
            fat.append(start + k + 1 if k < n - 1 else END)
        return start

    mini, mini_fat = b"", []
    for r in rows[1:]:
        data = r["data"]
        if r["type"] == 2 and len(data) < 4096:
            n = -(-len(data) // 64)
            r["start"] = len(mini_fat) if n else END
            mini_fat += [len(mini_fat) + k + 1 for k in range(n - 1)] + ([END] if n else [])
            mini += data.ljust(64 * n, b"\0")
        else:
            r["start"] = put(data) if r["type"] == 2 else 0
    rows[0]["start"], rows[0]["data"] = put(mini), mini
    mini_start = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat) + struct.pack("<I", FREE) * (-len(mini_fat) % 128)) if mini_fat else END
    out = b""
    for r in rows:
        name = r["name"].encode("utf-16-le") + b"\0\0"
        out += name.ljust(64, b"\0") + struct.pack("<HBBIII16sI8s8sIQ", len(name), r["type"], 1, NONE, r.get("right", NONE), r["child"], bytes(16), 0, bytes(8), bytes(8), r["start"], len(r["data"]))
    dir_start = put(out)
    n_fat = 1
    while (len(sectors) + n_fat) > 128 * n_fat:
        n_fat += 1
    places = list(range(len(sectors), len(sectors) + n_fat))
    fat += [0xFFFFFFFD] * n_fat
    fat += [FREE] * (128 * n_fat - len(fat))
    sectors += [struct.pack("<128I", *fat[128 * k : 128 * (k + 1)]) for k in range(n_fat)]
    head = struct.pack("<16sHHHHH6xIIIIIIIII", bytes(16), 62, 3, 0xFFFE, 9, 6, 0, n_fat, dir_start, 0, 4096, mini_start, -(-len(mini_fat) // 128), END, 0)
    return MAGIC + head + struct.pack("<109I", *(places + [FREE] * (109 - n_fat))) + b"".join(sectors)


def ticks(at: datetime) -> int:
    return round((at - datetime(1601, 1, 1, tzinfo=timezone.utc)).total_seconds() * 10_000_000)


def property_streams(props: dict[int, object], prefix: int) -> Tree:
    """Inline records and streams of values by code; the value's Python type picks the property type."""
    inline, out = b"", {}
    for code, v in props.items():
        if isinstance(v, bool):
            inline += struct.pack("<HHIQ", 0x0B, code, 6, int(v))
        elif isinstance(v, int):
            inline += struct.pack("<HHIiI", 0x03, code, 6, v, 0)
        elif isinstance(v, float):
            inline += struct.pack("<HHId", 0x05, code, 6, v)
        elif isinstance(v, datetime):
            inline += struct.pack("<HHIQ", 0x40, code, 6, ticks(v))
        elif isinstance(v, str):
            out[f"__substg1.0_{code:04X}001F"] = v.encode("utf-16-le")
        elif isinstance(v, list):
            for k, x in enumerate(v):
                out[f"__substg1.0_{code:04X}101F-{k:08X}"] = x.encode("utf-16-le")
        else:
            out[f"__substg1.0_{code:04X}0102"] = v
    return {"__properties_version1.0": bytes(prefix) + inline, **out}


def message_tree(props: dict[int, object], recipients: list[dict] = (), attachments: list[dict] = (), names: Tree | None = None) -> Tree:
    """Streams and storages of a message; an attachment's key ``"msg"`` holds an embedded message's tree."""
    out: Tree = {"__nameid_version1.0": names or {}} if names is not None else {}
    out |= property_streams(props, 32)
    for k, r in enumerate(recipients):
        out[f"__recip_version1.0_#{k:08X}"] = property_streams(r, 8)
    for k, a in enumerate(attachments):
        inner = a.get("msg")
        tree = property_streams({c: v for c, v in a.items() if c != "msg"}, 8)
        out[f"__attach_version1.0_#{k:08X}"] = tree | ({"__substg1.0_3701000D": inner} if inner is not None else {})
    return out


def msg_file(*args, **kwargs) -> bytes:
    return compound_file(message_tree(*args, **kwargs))


def packed_rtf(raw: bytes) -> bytes:
    """Compressed RTF of literals only; up to 3889 bytes, beyond which the end mark can't be told."""
    body = b"".join(b"\0" + raw[k : k + 8] for k in range(0, len(raw), 8))
    return struct.pack("<4I", len(body) + 12, len(raw), PACKED, 0) + body


def store_file(items: list[tuple[int, int, dict[int, object]]], substitution: bytes | None = None) -> bytes:
    """A small store of the older layout: (descriptor, parent, properties) with numbers and texts; encoded for a substitution if given."""
    hide = (lambda b: bytes(map(substitution.index, b))) if substitution else (lambda b: b)
    blocks: dict[int, bytes] = {}
    descriptors = []
    number = 4
    for desc, parent, props in items:
        records, links, extra = b"", b"", number + 2
        for k, (code, v) in enumerate(props.items()):
            if isinstance(v, bool):
                records += struct.pack("<HHI", 0x0B, code, int(v))
            elif isinstance(v, int):
                records += struct.pack("<HHi", 0x03, code, v)
            else:
                blocks[extra] = hide(v.encode("utf-16-le") if isinstance(v, str) else v)
                far = 100_000 + k
                records += struct.pack("<HHI", 0x1F if isinstance(v, str) else 0x102, code, far)
                links += struct.pack("<II", far, extra)
                extra += 1
        blocks[number] = hide(struct.pack("<BBH", 0xBC, 0xEC, 4 + len(records)) + records + b"\0\0")
        if links:
            links += struct.pack("<II", 0, 0) * ((len(links) // 8) % 2 == 0)  # an odd number of records keeps them 8 bytes wide
            blocks[number + 1] = hide(links)
        descriptors.append((desc, number, number + 1 if links else 0, parent))
        number = extra + 1
    pages_at = 1024
    index = list(blocks)
    leaf_i = [index[k : k + 40] for k in range(0, len(index), 40)]
    leaf_d = [descriptors[k : k + 30] for k in range(0, len(descriptors), 30)]
    n_pages = 2 + len(leaf_i) + len(leaf_d)
    at = pages_at + 512 * n_pages
    where = {}
    data = b""
    for n, raw in blocks.items():
        where[n] = at + len(data)
        data += raw
    page = lambda body, count, level: body.ljust(496, b"\0") + bytes([count, 40, 12, level]) + bytes(12)
    place = lambda k: pages_at + 512 * k
    out = page(b"".join(struct.pack("<III", p[0], place(2 + k), 0) for k, p in enumerate(leaf_i)), len(leaf_i), 1)
    out += page(b"".join(struct.pack("<III", p[0][0], place(2 + len(leaf_i) + k), 0) for k, p in enumerate(leaf_d)), len(leaf_d), 1)
    for p in leaf_i:
        out += page(b"".join(struct.pack("<IIHH", n, where[n], len(blocks[n]), 2) for n in p), len(p), 0)
    for p in leaf_d:
        out += page(b"".join(struct.pack("<IIII", d, i, i2, up) for d, i, i2, up in p), len(p), 0)
    head = bytearray(1024)
    head[:4], head[10], head[0x1CD] = b"!BDN", 0x0E, int(substitution is not None)
    struct.pack_into("<I", head, 0xA0, place(0))
    struct.pack_into("<I", head, 0xA8, place(1))
    return bytes(head) + out + data
