"""Compound files: header, allocation tables, directory tree and streams of one file."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
FREE, END, FATSECT, DIFSECT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
MOST_HOPS = 1_000_000
TYPES = {0: "empty", 1: "storage", 2: "stream", 3: "lockbytes", 4: "property", 5: "root"}
NONE = 0xFFFFFFFF


class CfbError(ValueError):
    pass


@dataclass
class Header:
    clsid: bytes
    minor: int
    major: int
    byte_order: int
    sector_shift: int
    mini_shift: int
    dir_sectors: int
    fat_sectors: int
    dir_start: int
    transaction: int
    cutoff: int
    mini_fat_start: int
    mini_fat_sectors: int
    difat_start: int
    difat_sectors: int
    difat: list[int]

    @property
    def sector_size(self) -> int:
        return 1 << self.sector_shift

    @property
    def mini_size(self) -> int:
        return 1 << self.mini_shift


def parse_header(raw: bytes) -> Header:
    if len(raw) < 512:
        raise CfbError("header too short")
    if raw[:8] != MAGIC:
        raise CfbError("invalid magic")
    f = struct.unpack_from("<16sHHHHH6xIIIIIIIII109I", raw, 8)
    h = Header(*f[:15], difat=[x for x in f[15:] if x not in (FREE, END)])
    for wrong, what in (
        (h.byte_order != 0xFFFE, "byte order"),
        (h.major not in (3, 4), "version"),
        (h.sector_shift not in (9, 12), "sector shift"),
        (h.mini_shift != 6, "mini sector shift"),
        (h.cutoff != 4096, "mini stream cutoff"),
    ):
        if wrong:
            raise CfbError(f"invalid {what}")
    return h


@dataclass
class Dirent:
    sid: int
    name: str
    type: str
    color: str
    left: int
    right: int
    child: int
    clsid: bytes
    state: int
    created: bytes
    modified: bytes
    start: int
    size: int
    parent: int | None = None
    ord: int = 0
    path: str = ""
    children: list[Dirent] = field(default_factory=list)


def parse_dirent(raw: bytes, sid: int) -> Dirent:
    n, kind, color, left, right, child, clsid, state, made, changed, start, size = struct.unpack_from("<HBBIII16sI8s8sIQ", raw, 64)
    name = raw[: max(0, min(n, 64))]
    try:
        text = name[: len(name) & ~1].decode("utf-16-le").rstrip("\0")
    except UnicodeDecodeError:
        text = ""
    return Dirent(sid, text, TYPES.get(kind, "empty"), "black" if color else "red", left, right, child, clsid, state, made, changed, start, size)


def sector_offset(n: int, size: int) -> int:
    return (n + 1) * size


def chain(table: list[int], start: int) -> list[int]:
    """Sectors from ``start`` on, to an end mark, a sector met before or one that isn't there."""
    out, seen = [], set()
    while start not in (FREE, END, FATSECT, DIFSECT) and start not in seen and len(out) < MOST_HOPS:
        out.append(start)
        seen.add(start)
        if start >= len(table):
            break
        start = table[start]
    return out


class CompoundFile:
    """One file in memory; ``dirents`` by sid, ``root`` with the tree below it."""

    def __init__(self, raw: bytes):
        self.raw, self.header = raw, parse_header(raw)
        h = self.header
        per = h.sector_size // 4
        places, at, seen = list(h.difat), h.difat_start, set()
        while at not in (FREE, END) and at not in seen and len(seen) < MOST_HOPS:
            seen.add(at)
            *more, at = self._numbers(at)
            places += [x for x in more if x not in (FREE, END)]
        self.fat = [x for s in places for x in self._numbers(s)]
        self.mini_fat = [x for s in chain(self.fat, h.mini_fat_start) for x in self._numbers(s)]
        assert per
        directory = self._stream(h.dir_start)
        rows = (parse_dirent(directory[k : k + 128], k // 128) for k in range(0, len(directory) - 127, 128))
        self.dirents = {d.sid: d for d in rows if d.type != "empty"}
        if 0 not in self.dirents:
            raise CfbError("no root entry")
        self.root = self.dirents[0]
        self._tree()
        self.mini = self._stream(self.root.start)[: self.root.size] if self.mini_fat else b""

    def _sector(self, n: int) -> bytes:
        at, size = sector_offset(n, self.header.sector_size), self.header.sector_size
        out = self.raw[at : at + size]
        if not out:
            raise CfbError(f"sector {n} is beyond the file")
        return out.ljust(size, b"\0")

    def _numbers(self, n: int) -> tuple[int, ...]:
        return struct.unpack(f"<{self.header.sector_size // 4}I", self._sector(n))

    def _stream(self, start: int) -> bytes:
        return b"".join(map(self._sector, chain(self.fat, start)))

    def _siblings(self, sid: int, seen: set[int]) -> list[Dirent]:
        """In order: left, self, right; an explicit stack, so no tree is too deep and no loop endless."""
        out, stack = [], []
        while stack or sid != NONE:
            while sid != NONE and sid in self.dirents and sid not in seen:
                seen.add(sid)
                stack.append(self.dirents[sid])
                sid = self.dirents[sid].left
            if not stack:
                break
            d = stack.pop()
            out.append(d)
            sid = d.right
        return out

    def _tree(self) -> None:
        seen, todo = {0}, [self.root]
        self.root.path = "/"
        while todo:
            d = todo.pop()
            d.children = self._siblings(d.child, seen) if d.child != NONE else []
            for k, c in enumerate(d.children):
                c.parent, c.ord = d.sid, k
                c.path = f"{d.path.rstrip('/')}/{c.name}"
            todo += d.children

    def find(self, parent: Dirent, name: str) -> Dirent | None:
        return next((c for c in parent.children if c.name.lower() == name.lower()), None)

    def must_find(self, parent: Dirent, name: str) -> Dirent:
        found = self.find(parent, name)
        if found is None:
            raise CfbError(f"no entry {name}")
        return found

    def read(self, d: Dirent) -> bytes:
        if d.size < self.header.cutoff and d.type != "root":
            step = self.header.mini_size
            out = b"".join(self.mini[n * step : (n + 1) * step] for n in chain(self.mini_fat, d.start))
            if len(out) < d.size:
                raise CfbError(f"stream {d.name} is short")
            return out[: d.size]
        return self._stream(d.start)[: d.size]

    def read_name(self, parent: Dirent, name: str) -> bytes | None:
        found = self.find(parent, name)
        return None if found is None else self.read(found)

    def walk(self, start: Dirent | None = None):
        """Entries in pre-order, children of storages and of the root."""
        stack = [start or self.root]
        while stack:
            d = stack.pop()
            yield d
            if d.type in ("root", "storage"):
                stack += reversed(d.children)
