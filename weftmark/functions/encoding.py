"""Character encodings: labels, byte-order marks, declarations in markup, decoding and encoding.

Tables come from Python's codecs, brought to the web's indexes where those differ."""

from __future__ import annotations

import codecs
import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftmark.functions.batches import scalar

DEFAULT = "windows-1252"

# ---- fixed values -------------------------------------------------------------------------------------------------
#: Encoding name: labels that no rule below gives (the rules: the name itself, cp/windows/x-cp numbers, ISO 8859 spellings).
#: Labels of each encoding.
ENCODING_LABELS: dict[str, str] = {
    "UTF-8": "unicode-1-1-utf-8 utf-8 utf8",
    "IBM866": "866 cp866 csibm866 ibm866",
    "ISO-8859-2": "csisolatin2 iso-8859-2 iso-ir-101 iso8859-2 iso88592 iso_8859-2 iso_8859-2:1987 l2 latin2",
    "ISO-8859-3": "csisolatin3 iso-8859-3 iso-ir-109 iso8859-3 iso88593 iso_8859-3 iso_8859-3:1988 l3 latin3",
    "ISO-8859-4": "csisolatin4 iso-8859-4 iso-ir-110 iso8859-4 iso88594 iso_8859-4 iso_8859-4:1988 l4 latin4",
    "ISO-8859-5": "csisolatincyrillic cyrillic iso-8859-5 iso-ir-144 iso8859-5 iso88595 iso_8859-5 iso_8859-5:1988",
    "ISO-8859-6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6 iso-8859-6-e iso-8859-6-i iso-ir-127 iso8859-6 iso88596 iso_8859-6 iso_8859-6:1987",
    "ISO-8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-8859-7 iso-ir-126 iso8859-7 iso88597 iso_8859-7 iso_8859-7:1987 sun_eu_greek",
    "ISO-8859-8": "csiso88598e csisolatinhebrew hebrew iso-8859-8 iso-8859-8-e iso-ir-138 iso8859-8 iso88598 iso_8859-8 iso_8859-8:1988 visual",
    "ISO-8859-8-I": "csiso88598i iso-8859-8-i logical",
    "ISO-8859-10": "csisolatin6 iso-8859-10 iso-ir-157 iso8859-10 iso885910 l6 latin6",
    "ISO-8859-13": "iso-8859-13 iso8859-13 iso885913",
    "ISO-8859-14": "iso-8859-14 iso8859-14 iso885914",
    "ISO-8859-15": "csisolatin9 iso-8859-15 iso8859-15 iso885915 iso_8859-15 l9",
    "ISO-8859-16": "iso-8859-16",
    "KOI8-R": "cskoi8r koi koi8 koi8-r koi8_r",
    "KOI8-U": "koi8-ru koi8-u",
    "macintosh": "csmacintosh mac macintosh x-mac-roman",
    "windows-874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "windows-1250": "cp1250 windows-1250 x-cp1250",
    "windows-1251": "cp1251 windows-1251 x-cp1251",
    "windows-1252": "ansi_x3.4-1968 ascii cp1252 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii windows-1252 x-cp1252",
    "windows-1253": "cp1253 windows-1253 x-cp1253",
    "windows-1254": "cp1254 csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5 windows-1254 x-cp1254",
    "windows-1255": "cp1255 windows-1255 x-cp1255",
    "windows-1256": "cp1256 windows-1256 x-cp1256",
    "windows-1257": "cp1257 windows-1257 x-cp1257",
    "windows-1258": "cp1258 windows-1258 x-cp1258",
    "x-mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "GBK": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "Big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "EUC-JP": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "ISO-2022-JP": "csiso2022jp iso-2022-jp",
    "Shift_JIS": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "EUC-KR": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "replacement": "csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr replacement",
    "UTF-16BE": "utf-16be",
    "UTF-16LE": "utf-16 utf-16le",
    "x-user-defined": "x-user-defined",
}
#: Bytes where the web's single-byte indexes differ from Python's tables.
_PATCHES = {
    "windows-1255": {0xCA: "ֺ"}, "x-mac-cyrillic": {0xA2: "Ґ", 0xB6: "ґ", 0xFF: "€"},
    "KOI8-U": {0xAE: "ў", 0xBE: "Ў"}, "ISO-8859-8-I": {},
}
_SINGLE = {
    "IBM866": "cp866", "KOI8-R": "koi8_r", "KOI8-U": "koi8_u", "macintosh": "mac_roman", "x-mac-cyrillic": "mac_cyrillic", "windows-874": "cp874",
    **{f"windows-125{k}": f"cp125{k}" for k in range(9)}, **{f"ISO-8859-{k}": f"iso8859_{k}" for k in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)},
}
_MULTI = {"GBK": "gb18030", "gb18030": "gb18030", "Big5": "big5hkscs", "EUC-JP": "euc_jp", "EUC-KR": "cp949", "Shift_JIS": "cp932", "ISO-2022-JP": "iso2022_jp", "UTF-8": "utf-8", "UTF-16BE": "utf-16-be", "UTF-16LE": "utf-16-le"}
#: What declared labels stand for in a prescan; others are passed on as they are.
_PRESCAN_ALIASES = {
    "unicodefffe": "UTF-8", "utf-16be": "UTF-8", "csunicode": "UTF-8", "iso-10646-ucs-2": "UTF-8", "ucs-2": "UTF-8", "unicode": "UTF-8", "unicodefeff": "UTF-8",
    "utf-16": "UTF-8", "utf-16le": "UTF-8", "x-user-defined": "windows-1252",
}
# ---------------------------------------------------------------------------------------------------------------------


LABELS: dict[str, str] = {label: name for name, labels in ENCODING_LABELS.items() for label in labels.split()}


def label_name(label: str) -> str | None:
    """Encoding of a label: trimmed of tab, LF, FF, CR and space, any case."""
    return LABELS.get(label.strip(" \t\n\f\r").lower())


def encoding_name(col: Column) -> Column:
    """Encoding of a label column as an expression: one literal map."""
    keys = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    clean = F.lower(F.regexp_replace(col, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", ""))
    return F.try_element_at(keys, clean)


def prescan_valid(col: Column) -> Column:
    """What a declared encoding may stand for: UTF-16 is UTF-8, x-user-defined is windows-1252, unknown the default."""
    name = encoding_name(col)
    return F.when(name.isin("UTF-16BE", "UTF-16LE"), "UTF-8").when(name == "x-user-defined", DEFAULT).otherwise(F.coalesce(name, F.lit(DEFAULT)))


def bom_sniff(data: Column) -> Column:
    """Encoding by byte-order mark, else DEFAULT; built-ins alone."""
    head = lambda n: F.hex(F.substring(data, 1, n))
    return F.when(head(3) == "EFBBBF", "UTF-8").when(head(2) == "FEFF", "UTF-16BE").when(head(2) == "FFFE", "UTF-16LE").otherwise("DEFAULT")


def strip_bom(data: Column) -> Column:
    n = F.when(F.hex(F.substring(data, 1, 3)) == "EFBBBF", 3).when(F.hex(F.substring(data, 1, 2)).isin("FEFF", "FFFE"), 2).otherwise(0)
    return F.substring(data, n + 1, F.octet_length(data))


_RAW_END = re.compile(rb">|\Z")
_COMMENT_END = re.compile(rb"(?<=--)>|\Z")
_TAG_NAME = re.compile(rb"[^\t\n\f\r >]*")
_NAME = re.compile(rb"[\t\n\f\r /]*+(?:(=)|([^\t\n\f\r />=][^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+(=))?+|(>|\Z))")
_VALUE = re.compile(rb"[\t\n\f\r ]*+(?:\"([^\"]*+)(\")?|'([^']*+)(')?|([^\t\n\f\r >][^\t\n\f\r >]*+)|(?=>|\Z))")
_CHARSET = re.compile(rb"charset[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"([^\"]*)\"|'([^']*)'|(?!\Z)([^\t\n\f\r ;]*))", re.I)
_CHARSET_SIGN = re.compile(rb"charset[\t\n\f\r ]*+=", re.I)


def _attributes(data: bytes, at: int) -> tuple[dict[bytes, bytes | None], int]:
    """Attributes of a tag from ``at`` on, first ones first, with None for no value, and the place behind the tag.
    What the end of the data cuts off is left out."""
    out: dict[bytes, bytes | None] = {}
    while True:
        m = _NAME.match(data, at)
        at = m.end()
        if m[4] is not None:
            return out, at
        name, value = (m[1] or m[2]).lower(), None
        if m[1] or m[3]:
            v = _VALUE.match(data, at)
            at = v.end()
            quoted = v[1] is not None or v[3] is not None
            if quoted and not (v[2] or v[4]):
                return out, at
            value = next((x for x in (v[1], v[3], v[5]) if x is not None), None)
            if not quoted and at == len(data):
                return out, at
        elif at == len(data):
            return out, at
        out.setdefault(name, value)


def _skip_tag(data: bytes, at: int) -> int:
    end = _TAG_NAME.match(data, at).end()
    return end + 1 if data[end : end + 1] in (b">", b"") else _attributes(data, end)[1]


def _content_charset(content: bytes) -> bytes | None:
    sign = _CHARSET_SIGN.search(content)
    m = sign and _CHARSET.match(content, sign.start())
    if not m or m[3] is not None and (b'"' in m[3] or b"'" in m[3]):
        return None
    return next(v for v in m.groups() if v is not None)


def _declared(attributes: dict[bytes, bytes | None]) -> list[bytes]:
    """Names that begin with charset or content count. Without a charset the last one needs the pragma."""
    out: list[bytes] = []
    direct = content = pragma = False
    for name, value in attributes.items():
        if value is None:
            continue
        if len(name) == 10:
            pragma = value.lower() == b"content-type" if name == b"http-equiv" else pragma
        elif name.startswith(b"content"):
            if not content and (found := _content_charset(value)) is not None:
                out.append(found)
                content, direct = True, False
        elif name.startswith(b"charset"):
            out.append(value)
            direct = True
    return out if direct or pragma and content else out[:-1]


def meta_entries(data: bytes) -> list[str]:
    """Encodings that meta tags declare, in order: charset=, or content= beside http-equiv=content-type."""
    out: list[str] = []
    at = 0
    while (at := data.find(b"<", at)) >= 0 and at + 1 < len(data):
        at += 1
        head = data[at : at + 1]
        if head == b"!":
            at = (_COMMENT_END if data.startswith(b"!--", at) else _RAW_END).search(data, at + 1).end()
        elif head == b"?":
            at = _RAW_END.search(data, at).end()
        elif head == b"/":
            if at + 4 > len(data):
                break
            at = _skip_tag(data, at + 1) if data[at + 1 : at + 2].isalpha() else _RAW_END.search(data, at + 1).end()
        elif head.isalpha():
            if at + 6 > len(data) or data[at : at + 4].lower() != b"meta":
                at = _skip_tag(data, at)
            elif data[at + 4 : at + 5] not in (b"/", b" ", b"\t", b"\n", b"\r", b"\f"):
                at = _skip_tag(data, at + 5)
            else:
                found, at = _attributes(data, at + 5)
                out += [x.decode("latin-1") for x in _declared(found)]
    return out


def prescan(data: bytes) -> str | None:
    """The declared name: UTF-16 signatures of <?x, else the first meta entry (raw, if it is no common alias)."""
    if data[:6] == b"<\0?\0x\0":
        return "UTF-16LE"
    if data[:6] == b"\0<\0?\0x":
        return "UTF-16BE"
    found = next(iter(meta_entries(data)), None)
    return None if found is None else _PRESCAN_ALIASES.get(found.lower(), found)


def determine(data: bytes) -> str:
    """BOM, else the first valid declaration, else the default."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xfe\xff", "UTF-16BE"), (b"\xff\xfe", "UTF-16LE")):
        if data.startswith(mark):
            return name
    for label in meta_entries(data):
        name = label_name(label)
        if name:
            return "UTF-8" if name.startswith("UTF-16") else DEFAULT if name == "x-user-defined" else name
    return DEFAULT


# ---- codecs -----------------------------------------------------------------------------------------------------------
@functools.cache
def single_byte(name: str) -> str:
    """The 256 characters of a single-byte encoding; U+FFFD where there is none."""
    base = {"ISO-8859-8-I": "ISO-8859-8"}.get(name, name)
    table = [chr(b) if b < 128 or name == "x-user-defined" and b < 128 else bytes([b]).decode(_SINGLE[base], "replace") for b in range(256)]
    for b in range(0x80, 0xA0):
        if table[b] == "�" and base.startswith("windows"):
            table[b] = chr(b)
    for b, c in _PATCHES.get(base, {}).items():
        table[b] = c
    return "".join(table)


@functools.cache
def _inverse(name: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(single_byte(name)))) if c != "�"}


def _resync(error: UnicodeError):
    """A malformed sequence is one U+FFFD; an ASCII byte in it is read again."""
    bad = error.object[error.start : error.end]
    if bad[0] == 0x80 and error.encoding == "gb18030":
        return "€", error.start + 1
    if len(bad) > 1 and bad[1] < 0x80:
        return "�", error.start + 1
    if len(bad) == 1 and bad[0] >= 0x81 and error.end < len(error.object) and error.object[error.end] >= 0x80 and error.encoding not in ("utf-8", "utf8"):
        return "�", error.end + 1
    return "�", error.end


codecs.register_error("weftmark-resync", _resync)


#: Single bytes for which only Python's table has characters.
_NO_SJIS = dict.fromkeys((0xF8F0, 0xF8F1, 0xF8F2, 0xF8F3), "\ufffd")


def decode(data: bytes, name: str) -> tuple[str, bool]:
    """Text, and whether the value ends inside a sequence."""
    if name == "replacement":
        return ("�" if data else ""), False
    if name == "x-user-defined":
        return "".join(chr(b if b < 128 else 0xF700 + b) for b in data), False
    if name not in _MULTI:
        return data.decode("latin-1").translate(single_byte(name)), False
    step = codecs.getincrementaldecoder(_MULTI[name])("weftmark-resync")
    text = step.decode(data)
    if name == "Shift_JIS":
        text = text.translate(_NO_SJIS)
    rest = step.getstate()[0]
    return text + ("�" if rest else ""), bool(rest)


def encode(text: str, name: str) -> bytes | None:
    """Bytes; None if a character has none in the encoding."""
    if name in ("UTF-8", "replacement"):
        return text.encode("utf-8", "replace")
    if name == "x-user-defined":
        return bytes(ord(c) if c < "\x80" else ord(c) - 0xF700 for c in text) if all(c < "\x80" or "" <= c <= "" for c in text) else None
    try:
        if name in _MULTI:
            return text.encode("gbk" if name == "GBK" and "€" not in text else _MULTI[name])
        table = _inverse(name)
        return bytes(table[c] for c in text)
    except (UnicodeEncodeError, KeyError):
        return None


_decode = scalar(lambda data, name: (lambda n: None if n is None else dict(zip(("text", "incomplete"), decode(bytes(data), n))))(label_name(name or "")), "struct<text:string,incomplete:boolean>")
_encode = scalar(lambda text, name: (lambda n: None if n is None else encode(text, n))(label_name(name or "")), "binary")
sniff_meta = scalar(lambda data: meta_entries(bytes(data)), "array<string>")
sniff_prescan = scalar(lambda data: prescan(bytes(data)), "string")
sniff_encoding = scalar(lambda data: determine(bytes(data)), "string")


def decode_bytes(data: Column, encoding: Column | str) -> Column:
    """struct(text, incomplete) of bytes in an encoding given by label; null for an unknown label."""
    return _decode(data, F.lit(encoding) if isinstance(encoding, str) else encoding)


def encode_text(text: Column, encoding: Column | str) -> Column:
    """Bytes of a text; null where a character has none, or for an unknown label."""
    return _encode(text, F.lit(encoding) if isinstance(encoding, str) else encoding)


#: Stands for a sequence that the end of the value cuts off.
DECODE_CONTINUE = 0x2FFFFF
_UTF8_UNIT = re.compile(
    rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
    rb"|((?:[\xc2-\xdf]|\xe0[\xa0-\xbf]?|[\xe1-\xec\xee\xef][\x80-\xbf]?|\xed[\x80-\x9f]?|\xf0(?:[\x90-\xbf][\x80-\xbf]?)?|[\xf1-\xf3][\x80-\xbf]{0,2}|\xf4(?:[\x80-\x8f][\x80-\xbf]?)?)\Z)"
    rb"|(\xe0[\xa0-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]|\xed[\x80-\x9f]|\xf0[\x90-\xbf][\x80-\xbf]?|[\xf1-\xf3][\x80-\xbf]{1,2}|\xf4[\x80-\x8f][\x80-\xbf]?|[\s\S])"
)


def utf8_code_points(data: bytes) -> list[int]:
    """Code points of UTF-8; U+FFFD for what is malformed, DECODE_CONTINUE for a sequence that the end cuts off."""
    return [DECODE_CONTINUE if m[1] else 0xFFFD if m[2] else ord(m[0].decode("utf-8")) for m in _UTF8_UNIT.finditer(data)]


def utf8_shape(data: bytes) -> list[int]:
    """Code points by the shape of lead bytes alone: overlong forms and surrogates pass. ValueError for a bad lead byte or a cut tail."""
    out, at = [], 0
    while at < len(data):
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 0
        if not size or at + size > len(data):
            raise ValueError("not UTF-8")
        point = lead if size == 1 else lead & (0x7F >> size)
        for b in data[at + 1 : at + size]:
            point = point << 6 | (b ^ (b & 0x80))
        out.append(point)
        at += size
    return out


def _shape_or_none(data: bytes) -> list[int] | None:
    try:
        return utf8_shape(bytes(data))
    except ValueError:
        return None


decode_utf8_points = scalar(lambda data: utf8_code_points(bytes(data)), "array<int>")
decode_utf8_shape = scalar(_shape_or_none, "array<int>")


def code_points(text: Column) -> Column:
    """Code points of a string, by built-ins."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))
