"""Mail semantics as built-in column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

Name = Column | str


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- bytes


def le_uint(raw: Name, offset: int, size: int) -> Column:
    """Unsigned little-endian number of up to 7 bytes (8 bytes: the signed long of the same bits)."""
    out = F.lit(0).cast("long")
    for k in range(size):
        byte = F.conv(F.hex(F.substring(col(raw), offset + k + 1, 1)), 16, 10).cast("long")
        out = out.bitwiseOR(F.shiftleft(byte, 8 * k))
    return F.when(F.octet_length(col(raw)) >= offset + size, out)


def le_int32(raw: Name, offset: int = 0) -> Column:
    n = le_uint(raw, offset, 4)
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")


def le_hex(number: Name, size: int) -> Column:
    """Hex of a number's little-endian bytes."""
    h = F.lpad(F.hex(col(number).cast("long")), 16, "0")
    return F.concat(*(F.substring(h, 15 - 2 * k, 2) for k in range(size)))


def is_compound_file(content: Name) -> Column:
    return F.hex(F.substring(col(content), 1, 4)) == "D0CF11E0"


def is_store(content: Name) -> Column:
    return F.hex(F.substring(col(content), 1, 4)) == "2142444E"


def sector_offset(n: Name, size: Name) -> Column:
    return (col(n) + 1) * col(size)


def guid_text(raw: Name) -> Column:
    h = F.hex(col(raw))
    part = lambda *at: F.concat(*(F.substring(h, 2 * k + 1, 2) for k in at))
    text = F.concat(F.lit("{"), F.concat_ws("-", part(3, 2, 1, 0), part(5, 4), part(7, 6), part(8, 9), part(*range(10, 16))), F.lit("}"))
    return F.when(F.octet_length(col(raw)) == 16, text)


def guid_bytes(text: Name) -> Column:
    h = F.regexp_replace(col(text), "[{}-]", "")
    swap = lambda *at: F.concat(*(F.substring(h, 2 * k + 1, 2) for k in at))
    good = F.length(h) == 32
    return F.when(good, F.try_to_binary(F.concat(swap(3, 2, 1, 0, 5, 4, 7, 6), F.substring(h, 17, 16)), F.lit("hex")))


def filetime(ticks: Name) -> Column:
    """Timestamp of 100-nanosecond ticks since 1601; null for 0 and beyond year 9999."""
    t = col(ticks).cast("long")
    micros = (t - F.pmod(t, F.lit(10).cast("long"))).cast("decimal(20,0)") / F.lit(10)
    return F.when((t > 0) & (t < 2650467744000000000), F.timestamp_micros(micros.cast("long") - 11644473600000000))


# -- property types and keys


def base_type(code: Name) -> Column:
    return col(code).bitwiseAND(F.lit(0x0FFF))


def is_multi(code: Name) -> Column:
    return col(code).bitwiseAND(F.lit(dims.MULTI)) != 0


def type_name(code: Name) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ((k, v[3:]) for k, v in dims.KINDS.items()) for x in pair))
    base = F.try_element_at(table, base_type(code))
    return F.when(base.isNull(), "unknown").when(is_multi(code), F.concat(F.lit("pt_mv_"), base)).otherwise(F.concat(F.lit("pt_"), base))


def key_text(code: Name, name: Name, label: Name | None = None) -> Column:
    """Name, else four hex digits, with the property set's label if one is given."""
    h = F.lpad(F.lower(F.hex(col(code).cast("long"))), 4, "0")
    return F.coalesce(col(name), h if label is None else F.concat(h, F.lit("@"), col(label)))


def stream_key(name: Name) -> Column:
    """struct(code, type, index) of a property stream's name, null for other names."""
    pattern = r"^__substg1\.0_([0-9A-Fa-f]{4})([0-9A-Fa-f]{4})(?:-([0-9A-Fa-f]{8}))?$"
    part = lambda k: F.conv(F.nullif(F.regexp_extract(col(name), pattern, k), F.lit("")), 16, 10).cast("int")
    return F.when(col(name).rlike(pattern), F.struct(part(1).alias("code"), part(2).alias("type"), part(3).alias("index")))


# -- headers


def split_message(raw: Name) -> Column:
    """struct(head, body): at the first CRLFCRLF anywhere, else the first LFLF, else all head."""
    r = col(raw)
    at = lambda gap: F.instr(r, gap)
    cut = lambda gap: F.struct(F.substring(r, F.lit(1), at(gap) - 1).alias("head"), F.substring(r, at(gap) + len(gap), F.length(r)).alias("body"))
    return F.when(at("\r\n\r\n") > 0, cut("\r\n\r\n")).when(at("\n\n") > 0, cut("\n\n")).otherwise(F.struct(r.alias("head"), F.lit("").alias("body")))


def parse_headers(head: Name) -> Column:
    """array<struct<name,value>> of unfolded header lines; lines without a colon are left out."""
    flat = F.regexp_replace(col(head), r"[ \t]*\r?\n[ \t]+", " ")
    lines = F.filter(F.split(flat, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.transform(lines, lambda x: F.struct(trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("name"), trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))


def get_header(headers: Name, name: str) -> Column:
    return F.try_element_at(F.filter(col(headers), lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"]


def set_header(headers: Name, name: str, value: Name) -> Column:
    h = col(headers)
    new = F.struct(F.lit(name).alias("name"), col(value).alias("value"))
    same = lambda x: F.lower(x["name"]) == name.lower()
    first = F.array_position(F.transform(h, lambda x: same(x)), F.lit(True))
    swapped = F.transform(h, lambda x, k: F.when(k + 1 == first, new).otherwise(x))
    return F.when(first > 0, swapped).otherwise(F.concat(h, F.array(new)))


def add_header(headers: Name, name: str, value: Name) -> Column:
    return F.concat(col(headers), F.array(F.struct(F.lit(name).alias("name"), col(value).alias("value"))))


def main_value(value: Name) -> Column:
    return F.lower(F.trim(F.split_part(col(value), F.lit(";"), F.lit(1))))


def params(value: Name) -> Column:
    """Parameters of a header by lower-case name; of equal names the last counts (``mapKeyDedupPolicy`` LAST_WIN)."""
    rest = F.filter(F.slice(F.split(col(value), ";"), 2, 1 << 20), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(
        rest,
        lambda x: F.struct(
            F.lower(F.trim(F.split_part(x, F.lit("="), F.lit(1)))), F.regexp_replace(F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))), r'^"+|"+$', "")
        ),
    )
    return F.map_from_entries(pairs)


def is_multipart(content_type: Name) -> Column:
    return F.coalesce(F.startswith(col(content_type), F.lit("multipart/")), F.lit(False))


def split_parts(body: Name, boundary: Name) -> Column:
    """Texts of the parts of a multipart body, one level deep."""
    d = F.concat(F.lit("--"), col(boundary))
    inner = F.split_part(col(body), F.concat(d, F.lit("--")), F.lit(1))
    texts = F.slice(F.split(inner, F.concat(F.lit("\\Q"), d, F.lit("\\E"))), 2, 1 << 20)
    return F.filter(F.transform(texts, lambda t: F.regexp_replace(t, r"^\r?\n", "")), lambda t: t != "")


def is_ascii(text: Name) -> Column:
    return F.length(col(text)) == F.octet_length(col(text))


def transfer_encoding(text: Name) -> Column:
    return F.when(is_ascii(text), "7bit").otherwise("quoted-printable")


def base64_flat(raw: Name) -> Column:
    return F.replace(F.base64(col(raw)), F.lit("\r\n"), F.lit(""))


def base64_lines(raw: Name) -> Column:
    """Base64 in lines of 76 with CRLF between, whatever the session's chunking."""
    return F.regexp_replace(base64_flat(raw), "(.{76})(?!$)", "$1\r\n")


def encode_header(value: Name) -> Column:
    v = col(value)
    return F.when(is_ascii(v), v).otherwise(F.concat(F.lit("=?UTF-8?B?"), base64_flat(F.encode(v, "UTF-8")), F.lit("?=")))


def decode_base64_word(value: Name) -> Column:
    """A value that is one UTF-8 base64 word, decoded; anything else as it is. The general form is ``functions.mime.decode_words``."""
    payload = F.regexp_extract(col(value), r"^=\?(?i:UTF-8)\?[bB]\?([^?]*)\?=$", 1)
    good = (payload != "") & (F.length(payload) % 4 == 0)
    return F.when(good, F.coalesce(F.try_to_binary(payload, F.lit("base64")).cast("string"), col(value))).otherwise(col(value))


def quoted_printable_units(text: Name) -> Column:
    """Quoted-printable without soft line breaks: percent encoding with ``=`` for its sign, and what needn't be encoded put back."""
    out = F.replace(F.replace(F.url_encode(col(text)), F.lit("+"), F.lit(" ")), F.lit("%"), F.lit("="))
    for sign in "\t\r\n!\"#$%&'()+,/:;<>?@[\\]^`{|}~":
        out = F.replace(out, F.lit(f"={ord(sign):02X}"), F.lit(sign))
    return out


# -- messages


def address(name: Name, email: Name) -> Column:
    n, e = col(name), col(email)
    bare = F.concat(F.lit("<"), F.coalesce(e, F.lit("")), F.lit(">"))
    return F.when(n.isNull() | (n == ""), bare).when(e.isNull(), n).otherwise(F.concat(F.lit('"'), n, F.lit('" <'), e, F.lit(">")))


def recipient_type(code: Name) -> Column:
    return F.when(col(code) == 0, "orig").when(col(code) == 2, "cc").when(col(code) == 3, "bcc").otherwise("to")


def sender(addrtype: Name, email: Name, representing: Name, smtp: Name) -> Column:
    return F.when(F.upper(col(addrtype)) == "SMTP", col(email)).otherwise(F.coalesce(col(representing), col(smtp), col(email)))


def importance(code: Name) -> Column:
    return F.when(col(code) == 0, "low").when(col(code) == 1, "normal").when(col(code) == 2, "high")


def importance_header(code: Name) -> Column:
    return F.when(col(code) == 0, "low").when(col(code) == 2, "high")


def x_priority(code: Name) -> Column:
    return F.when(col(code) == 0, "5").when(col(code) == 1, "3").when(col(code) == 2, "1")


def sensitivity(code: Name) -> Column:
    return F.when(col(code) == 0, "none").when(col(code) == 1, "personal").when(col(code) == 2, "private").when(col(code) == 3, "confidential")


def sensitivity_header(code: Name) -> Column:
    return F.when(col(code) == 1, "Personal").when(col(code) == 2, "Private").when(col(code) == 3, "Company-Confidential")


def rfc2822(at: Name) -> Column:
    return F.date_format(col(at), "EEE, dd MMM yyyy HH:mm:ss Z")


def extension(filename: Name) -> Column:
    return F.lower(F.regexp_extract(col(filename), r"[^/]\.([^./]+)$", 1))


def media_type(filename: Name) -> Column:
    table = F.create_map(*(F.lit(x) for pair in dims.MEDIA.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension(filename)), F.lit(dims.DEFAULT_MEDIA))


def item_type(message_class: Name, content_count: Name, subfolders: Name) -> Column:
    c = F.lower(col(message_class))
    hint = col(content_count).isNotNull() | F.coalesce(col(subfolders), F.lit(False))
    out = F.when(c.isNull(), F.when(hint, "folder").otherwise("message"))
    for start, kind in (("ipm.appointment", "appointment"), ("ipm.contact", "contact"), ("ipm.task", "task"), ("ipm.stickynote", "note"), ("ipm.activity", "journal")):
        out = out.when(F.startswith(c, F.lit(start)), kind)
    return out.otherwise("message")


def display_name(name: Name, subject: Name) -> Column:
    return F.coalesce(col(name), col(subject), F.lit(""))


def boundary(seed: Name) -> Column:
    return F.concat(F.lit("----=_Part_"), F.substring(F.sha2(col(seed).cast("binary"), 256), 1, 24))


# -- warnings and metrics


def format_warning(code: Name, severity: Name, message: Name, context: Name) -> Column:
    tag = F.concat(F.lit("["), col(severity), F.lit(":"), col(code), F.lit("] "))
    return F.when(F.coalesce(col(context), F.lit("")) == "", F.concat(tag, col(message))).otherwise(F.concat(tag, col(context), F.lit(": "), col(message)))


def normal_text(text: Name) -> Column:
    """Without NULs, white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.replace(col(text), F.lit("\0"), F.lit("")), r"\s+", " "))


def preview(text: Name, n: int = 160) -> Column:
    return F.substring(normal_text(text), 1, n)


def within(a: Name, b: Name, least: int, share: float) -> Column:
    """Two lengths differ by no more than ``max(least, share of the first)``."""
    return F.abs(col(a) - col(b)) <= F.greatest(F.lit(least), F.floor(col(a) * share))
