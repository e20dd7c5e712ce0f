"""Messages in compound files: properties, recipients, attachments, embedded messages, MIME."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from . import dims, mapi, mime
from .cfb import CompoundFile, Dirent
from .mapi import Properties

RECIPIENT_TYPES = {0: "orig", 1: "to", 2: "cc", 3: "bcc"}
SENSITIVITY = {1: "Personal", 2: "Private", 3: "Company-Confidential"}
IMPORTANCE = {0: ("low", "5"), 1: (None, "3"), 2: ("high", "1")}
PREAMBLE = "This is a multi-part message in MIME format."


@dataclass
class Recipient:
    properties: Properties

    @property
    def name(self) -> str | None:
        return self.properties.text("pr_transmittable_display_name") or self.properties.text("pr_display_name") or self.properties.text("pr_recipient_display_name")

    @property
    def email(self) -> str | None:
        return self.properties.text("pr_smtp_address") or self.properties.text("pr_org_email_addr") or self.properties.text("pr_email_address")

    @property
    def type(self) -> str:
        code = self.properties.get("pr_recipient_type")
        return RECIPIENT_TYPES.get(1 if code is None else code, "to")

    def __str__(self) -> str:
        return mime.address(self.name, self.email) or ""


@dataclass
class Attachment:
    properties: Properties
    embedded: Message | None = None

    @property
    def filename(self) -> str:
        return self.properties.text("pr_attach_long_filename") or self.properties.text("pr_attach_filename") or "attachment"

    @property
    def data(self) -> bytes | None:
        v = self.properties.get("pr_attach_data_bin")
        if v is None:
            v = self.properties.get(0x3701)
        return v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else None

    @property
    def mime_type(self) -> str | None:
        return self.properties.text("pr_attach_mime_tag")

    @property
    def content_id(self) -> str | None:
        return self.properties.text("pr_attach_content_id")

    @property
    def location(self) -> str | None:
        return self.properties.text("pr_attach_content_location")

    @property
    def inline(self) -> bool:
        return self.content_id is not None or self.location is not None


@dataclass
class Message:
    properties: Properties
    recipients: list[Recipient] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)
    warnings: list[mime.WARN] = field(default_factory=list)


def _properties(cf: CompoundFile, d: Dirent, names: dict[int, mapi.Key], prefix: int) -> Properties:
    """Inline records, over which values in streams of their own win."""
    values, kinds = {}, {}
    inline = cf.read_name(d, "__properties_version1.0")
    for code, kind, value in mapi.inline_records(inline, prefix) if inline is not None else ():
        values[key := mapi.resolve(code, names)] = value
        kinds[key] = kind
    many: dict[tuple[int, int], list[tuple[int, object]]] = {}
    for child in d.children:
        parsed = mapi.stream_name(child.name) if child.type == "stream" else None
        if parsed is None:
            continue
        code, kind, index = parsed
        if not kind & dims.MULTI:
            values[key := mapi.resolve(code, names)] = mapi.stream_value(kind, cf.read(child))
            kinds[key] = kind
        elif index is not None:
            many.setdefault((code, kind & 0x0FFF), []).append((index, mapi.stream_value(kind, cf.read(child))))
    for (code, base), got in many.items():
        values[key := mapi.resolve(code, names)] = [v for _, v in sorted(got, key=lambda x: x[0])]
        kinds[key] = base | dims.MULTI
    return Properties(values, kinds)


def _guarded(warnings: list, code: str, what: str, context: str | None, make, default):
    try:
        return make()
    except Exception as e:  # noqa: BLE001 - any damage to one object leaves the rest readable
        warnings.append(mime.warning(code, f"{what}: {e}", context))
        return default


def _load(cf: CompoundFile, d: Dirent, names: dict[int, mapi.Key], depth: int = 0) -> Message:
    out = Message(Properties())
    own = lambda x, prefix: _guarded(out.warnings, "property_parse_failed", "properties could not be read", x.name, lambda: _properties(cf, x, names, prefix), Properties())
    out.properties = own(d, 32)
    storages = sorted((c for c in d.children if c.type == "storage"), key=lambda c: c.name)
    for c in storages:
        if c.name.lower().startswith("__attach_version1.0_"):

            def attach(c=c):
                a = Attachment(own(c, 8))
                inner = cf.find(c, "__substg1.0_3701000D")
                if a.properties.get("pr_attach_method") == 5 and inner is not None and inner.type == "storage" and depth < 64:
                    a.embedded = _load(cf, inner, names, depth + 1)
                    out.warnings.extend(a.embedded.warnings)
                return a

            a = _guarded(out.warnings, "attachment_skipped", "attachment could not be read", c.name, attach, None)
            if a is not None:
                out.attachments.append(a)
    for c in storages:
        if c.name.lower().startswith("__recip_version1.0_"):
            out.recipients.append(Recipient(own(c, 8)))
    return out


def read_message(raw: bytes) -> Message:
    """The message of a compound file; damage inside becomes warnings, a broken container raises."""
    cf = CompoundFile(raw)
    early: list[mime.WARN] = []

    def named() -> dict[int, mapi.Key]:
        d = cf.find(cf.root, "__nameid_version1.0")
        if d is None:
            return {}
        return mapi.named_map(*(cf.read_name(d, f"__substg1.0_{n}0102") or b"" for n in ("0002", "0003", "0004")))

    names = _guarded(early, "nameid_parse_failed", "named properties could not be read", None, named, {})
    out = _load(cf, cf.root, names)
    out.warnings = early + out.warnings
    return out


def named_properties(raw: bytes) -> dict[int, mapi.Key]:
    cf = CompoundFile(raw)
    d = cf.find(cf.root, "__nameid_version1.0")
    return mapi.named_map(*(cf.read_name(d, f"__substg1.0_{n}0102") or b"" for n in ("0002", "0003", "0004"))) if d else {}


def sender(props: Properties) -> str | None:
    kind, email = props.text("pr_sender_addrtype"), props.text("pr_sender_email_address")
    if kind is not None and kind.upper() == "SMTP":
        return email
    return props.text("pr_sent_representing_smtp_address") or props.text("pr_sender_smtp_address") or email


def headers(msg: Message) -> list[tuple[str, str]]:
    p, by = msg.properties, {"to": [], "cc": [], "bcc": []}
    for r in msg.recipients:
        by.get(r.type, []).append(str(r))
    email, subject = sender(p), p.text("pr_subject")
    at = p.get("pr_message_delivery_time") or p.get("pr_client_submit_time")
    level, priority = IMPORTANCE.get(p.get("pr_importance"), (None, None))
    pairs = [
        ("From", mime.address(p.text("pr_sender_name"), email) if email else None),
        *((label, ", ".join(by[kind]) or None) for label, kind in (("To", "to"), ("Cc", "cc"), ("Bcc", "bcc"))),
        ("Subject", None if subject is None else mime.encode_header(subject)),
        ("Date", mime.rfc2822(at) if isinstance(at, datetime) else None),  # times that can't be read are left out
        ("Message-ID", p.text("pr_internet_message_id")),
        ("In-Reply-To", p.text("pr_in_reply_to_id")),
        ("References", p.text("pr_internet_references")),
        ("MIME-Version", "1.0"),
        ("Importance", level),
        ("X-Priority", priority),
        ("Sensitivity", SENSITIVITY.get(p.get("pr_sensitivity"))),
    ]
    return [(n, v) for n, v in pairs if v is not None]


def _multipart(kind: str, parts: list[mime.Mime], seed: str) -> mime.Mime:
    b = mime.boundary_for(seed)
    return mime.Mime([("Content-Type", f'multipart/{kind}; boundary="{b}"')], None, parts, f"multipart/{kind}", {"boundary": b}, PREAMBLE)


def _text_part(kind: str, text: str) -> mime.Mime:
    how = "7bit" if text.isascii() else "quoted-printable"
    body = text if how == "7bit" else mime.quoted_printable(mime.as_bytes(text))
    return mime.Mime([("Content-Type", f"text/{kind}; charset=utf-8"), ("Content-Transfer-Encoding", how)], body, content_type=f"text/{kind}")


def body_part(msg: Message, seed: str) -> mime.Mime:
    text, html = msg.properties.body(), msg.properties.body_html()
    if text is not None and html is not None:
        out = _multipart("alternative", [_text_part("plain", text), _text_part("html", html)], f"{seed}/alternative")
        out.preamble = None
        return out
    if html is not None:
        return _text_part("html", html)
    return _text_part("plain", text or "")


def attachment_part(a: Attachment, seed: str) -> mime.Mime:
    name = a.filename
    if a.embedded is not None:
        head = [("Content-Type", f'message/rfc822; name="{name}"'), ("Content-Disposition", f'attachment; filename="{name}"')]
        return mime.Mime(head, mime.serialise(to_mime(a.embedded, f"{seed}/embedded"), seed), content_type="message/rfc822")
    kind = a.mime_type or dims.media_type(name)
    head = [
        ("Content-Type", f'{kind}; name="{name}"'),
        ("Content-Disposition", f'{"inline" if a.inline else "attachment"}; filename="{name}"'),
        ("Content-Transfer-Encoding", "base64"),
    ]
    if (cid := a.content_id) is not None:
        head.append(("Content-ID", cid if cid.startswith("<") else f"<{cid}>"))
    if a.location is not None:
        head.append(("Content-Location", a.location))
    return mime.Mime(head, mime.base64_lines(a.data or b""), content_type=kind)


def to_mime(msg: Message, seed: str = "message") -> mime.Mime:
    """The message as MIME; boundaries depend on ``seed`` alone."""
    out = mime.Mime(headers(msg))
    inner = body_part(msg, seed)
    if not msg.attachments:
        out.headers = out.headers + inner.headers
        out.body, out.parts, out.content_type, out.params = inner.body, inner.parts, inner.content_type, inner.params
        return out
    encoding = inner.get("content-transfer-encoding")
    related = [attachment_part(a, f"{seed}/{k}") for k, a in enumerate(msg.attachments) if a.inline]
    regular = [attachment_part(a, f"{seed}/{k}") for k, a in enumerate(msg.attachments) if not a.inline]
    if related:
        inner = _multipart("related", [inner, *related], f"{seed}/related")
    mixed = _multipart("mixed", [inner, *regular], f"{seed}/mixed")
    out.headers = out.headers + mixed.headers
    if encoding is not None:  # what the body had stays on the outer message too
        out.headers = out.headers + [("Content-Transfer-Encoding", encoding)]
    out.parts, out.content_type, out.params = mixed.parts, mixed.content_type, mixed.params
    return out


def to_eml(msg: Message, seed: str = "message") -> str:
    return mime.serialise(to_mime(msg, seed), seed)
