"""RFC 5322 / MIME text: parse, look up, encode and serialise one message.

Texts are ``str``; bytes that are no UTF-8 travel as surrogate escapes, so nothing is lost
between parsing and serialising. Delimiters are found as substrings, parts keep the line
end before the next delimiter, and content is not transfer-decoded.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from dataclasses import dataclass, field, replace
from datetime import datetime

import regex

WARN = tuple[str, str, str, str | None, bool]  # code, severity, message, context, recoverable
LINE, QP_LINE, BASE64_LINE = 76, 75, 76
#: Fixed patterns: encoded words, and the white space between two.
_WORD = re.compile(r"=\?([^?]+)\?([bBqQ])\?([^?]*)\?=")
_GAP = re.compile(r"(=\?[^?]+\?[bBqQ]\?[^?]*\?=)\s+(?==\?[^?]+\?[bBqQ]\?[^?]*\?=)")
#: Graphemes, and runs of them: no rule looks to the left of a place where two of them part. Runs of plain signs are group 1.
_GRAPHEME, _RUN = regex.compile(r"\X"), regex.compile(r"([ -~]{1,4096}(?![^ -~]))|(?:(?![ -~]{2})\X){1,4096}+")


def warning(code: str, message: str, context: str | None = None, severity: str = "warn", recoverable: bool = True) -> WARN:
    return (code, severity, message, context, recoverable)


def format_warning(w: WARN | str) -> str:
    if isinstance(w, str):
        return w
    code, severity, message, context, _ = w
    return f"[{severity}:{code}] {context}: {message}" if context else f"[{severity}:{code}] {message}"


def as_text(raw: bytes | str) -> str:
    return raw if isinstance(raw, str) else raw.decode("utf-8", "surrogateescape")


def as_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


@dataclass
class Mime:
    headers: list[tuple[str, str]] = field(default_factory=list)
    body: str | None = None
    parts: list[Mime] = field(default_factory=list)
    content_type: str | None = None
    params: dict[str, str] = field(default_factory=dict)
    preamble: str | None = None
    epilogue: str | None = None
    warnings: list[WARN] = field(default_factory=list)

    def get(self, name: str) -> str | None:
        name = name.lower()
        return next((v for n, v in self.headers if n.lower() == name), None)

    def set(self, name: str, value: str) -> Mime:
        """With the first header of that name replaced, or one more."""
        at = next((k for k, (n, _) in enumerate(self.headers) if n.lower() == name.lower()), None)
        headers = [*self.headers, (name, value)] if at is None else [*self.headers[:at], (name, value), *self.headers[at + 1 :]]
        return replace(self, headers=headers)

    def add(self, name: str, value: str) -> Mime:
        return replace(self, headers=[*self.headers, (name, value)])

    @property
    def multipart(self) -> bool:
        return bool(self.content_type) and self.content_type.startswith("multipart/")


def split_value(value: str) -> tuple[str, dict[str, str]]:
    """Main value and parameters of a header; quotes don't protect semicolons, the last of equal names counts."""
    main, *rest = (x.strip() for x in value.split(";"))
    pairs = (x.split("=", 1) for x in rest if "=" in x)
    return main.lower(), {k.strip().lower(): v.strip().lstrip('"').rstrip('"') for k, v in pairs}


def _q_bytes(payload: str) -> bytes:
    raw = as_bytes(payload.replace("_", " "))
    return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)


def decode_words(value: str) -> str:
    """Encoded words to text; what can't be decoded stays."""
    while (shorter := _GAP.sub(r"\1", value)) != value:
        value = shorter

    def one(m: re.Match) -> str:
        charset, how, payload = m.groups()
        try:
            raw = _q_bytes(payload) if how in "qQ" else base64.b64decode(payload, validate=True)
        except (binascii.Error, ValueError):
            return m[0]
        return raw.decode("latin-1") if charset.strip().lower() in ("iso-8859-1", "latin1") else as_text(raw)

    return _WORD.sub(one, value)


def split_message(raw: str) -> tuple[str, str]:
    for gap in ("\r\n\r\n", "\n\n"):
        head, found, body = raw.partition(gap)
        if found:
            return head, body
    return raw, ""


def parse_headers(text: str) -> tuple[list[tuple[str, str]], list[WARN]]:
    headers: list[tuple[str, list[str]]] = []
    warnings: list[WARN] = []
    for line in re.split(r"\r?\n", text):
        if headers and line[:1] in (" ", "\t"):
            headers[-1][1].append(line.strip())
        elif ":" in line:
            name, value = line.split(":", 1)
            headers.append((name.strip(), [value.strip()]))
        elif line.strip():
            warnings.append(warning("malformed_header_line", "malformed header line ignored", line))
    return [(n, decode_words(" ".join(v))) for n, v in headers], warnings


def parse(raw: bytes | str) -> Mime:
    head, body = split_message(as_text(raw))
    headers, warnings = parse_headers(head)
    out = Mime(headers=headers, warnings=warnings)
    value = out.get("content-type")
    if value is not None:
        out.content_type, out.params = split_value(value)
    if not out.multipart:
        out.body = body
        return out
    boundary = out.params.get("boundary", "")
    if not boundary:
        out.body = body
        out.warnings.append(warning("multipart_missing_boundary", "no boundary in a multipart content type; the body is taken whole"))
        return out
    inner, closed, rest = body.partition(f"--{boundary}--")
    out.epilogue = rest.lstrip("\r\n") if closed and rest.startswith("\r\n") else rest if closed else None
    if out.epilogue is not None and rest.startswith("\r\n"):
        out.epilogue = rest
        while out.epilogue.startswith("\r\n"):
            out.epilogue = out.epilogue[2:]
    preamble, *texts = inner.split(f"--{boundary}")
    out.preamble = preamble.strip() or None
    texts = [t[2:] if t.startswith("\r\n") else t[1:] if t.startswith("\n") else t for t in texts]
    out.parts = [parse(t) for t in texts if t]
    for k, part in enumerate(out.parts):
        out.warnings += [(c, s, m, f"part[{k}]" + (f" {ctx}" if ctx else ""), r) for c, s, m, ctx, r in part.warnings]
    return out


def walk(mime: Mime, path: tuple[int, ...] = ()):
    """(path, part) of the message and all parts below it, outer ones first."""
    yield path, mime
    for k, part in enumerate(mime.parts):
        yield from walk(part, (*path, k))


def fold(name: str, value: str) -> str:
    """One header, folded where its line is longer than 76 graphemes."""
    runs, chars, out, at = _RUN.finditer(f"{name}: {value}"), [], [], 0

    def left() -> int:
        """Graphemes from ``at`` on: all that are left, or more than a line of them."""
        nonlocal chars, at
        while len(chars) - at <= LINE and (run := next(runs, None)):
            chars, at = [*chars[at:], *(run[1] or _GRAPHEME.findall(run[0]))], 0
        return len(chars) - at

    while left() > LINE:
        cut = next((k + (chars[at + k] == ",") for k in range(LINE - 1, -1, -1) if chars[at + k] in (" ", ",")), 0)
        out.append("".join(chars[at : at + (cut or LINE)]))
        at += cut or LINE
        while cut and left() and chars[at][0].isspace():  # a mark may stand on a space: the mark stays
            chars[at] = chars[at].lstrip()
            at += not chars[at]
    if left():
        out.append("".join(chars[at:]))
    return "\r\n ".join(out) + "\r\n"


def boundary_for(seed: str) -> str:
    """A boundary that depends on the seed alone."""
    return "----=_Part_" + hashlib.sha256(seed.encode("utf-8", "surrogateescape")).hexdigest()[:24]


def serialise(mime: Mime, seed: str = "") -> str:
    head = "".join(fold(n, v) for n, v in mime.headers) + "\r\n"
    if not mime.multipart:
        return head + (mime.body or "")
    value = mime.get("content-type")
    boundary = (split_value(value)[1] if value else {}).get("boundary") or boundary_for(seed or head)
    parts = "\r\n".join(f"--{boundary}\r\n" + serialise(p, f"{seed}/{k}") for k, p in enumerate(mime.parts))
    before = f"{mime.preamble}\r\n" if mime.preamble else ""
    return f"{head}{before}{parts}\r\n--{boundary}--\r\n{mime.epilogue or ''}"


def is_ascii(text: str | bytes) -> bool:
    return text.isascii()


def base64_lines(raw: bytes) -> str:
    flat = base64.b64encode(raw).decode()
    return "\r\n".join(flat[k : k + BASE64_LINE] for k in range(0, len(flat), BASE64_LINE))


def quoted_printable(raw: bytes) -> str:
    out, width = [], 0
    for c in raw:
        if c in b"\t \r\n" or (33 <= c <= 126 and c != 61):
            one = chr(c)
        else:
            one = f"={c:02X}"
        if width + len(one) >= QP_LINE and c not in b"\r\n":
            out.append("=\r\n")
            width = 0
        out.append(one)
        width = 0 if c == 10 else width + len(one)
    return "".join(out)


def encode_header(value: str) -> str:
    return value if value.isascii() else f"=?UTF-8?B?{base64.b64encode(as_bytes(value)).decode()}?="


def address(name: str | None, email: str | None) -> str | None:
    if not name:
        return f"<{email or ''}>"
    return name if email is None else f'"{name}" <{email}>'


def rfc2822(at: datetime) -> str:
    offset = at.utcoffset()
    minutes = int(offset.total_seconds() // 60) if offset is not None else 0
    sign, minutes = ("-", -minutes) if minutes < 0 else ("+", minutes)
    day = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")[at.weekday()]
    month = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")[at.month - 1]
    return f"{day}, {at.day:02d} {month} {at.year} {at.hour:02d}:{at.minute:02d}:{at.second:02d} {sign}{minutes // 60:02d}{minutes % 60:02d}"
