"""URLs: parse, resolve, serialise, set parts; query parameters.

Default behaviour keeps what the surveyed library does where it differs from the URL standard: of relative
references only ``//...`` and ``/...`` resolve, parsing keeps default ports and does not check their range, setters do."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftmark.functions import text as X
from weftmark.functions.batches import scalar

# ---- fixed values -------------------------------------------------------------------------------------------------
SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
FORBIDDEN_HOST = frozenset("\0\t\n\r #/:<>?@[\\]^|")
FORBIDDEN_DOMAIN = FORBIDDEN_HOST | frozenset(map(chr, range(0x20))) | {"%", "\x7f"}
QUERY_SET = frozenset(' "#<>')
SPECIAL_QUERY_SET = QUERY_SET | {"'"}
FRAGMENT_SET = frozenset(' "<>`')
PATH_SET = QUERY_SET | frozenset("?^`{}")
USERINFO_SET = PATH_SET | frozenset("/:;=@[\\]|")
# ---------------------------------------------------------------------------------------------------------------------
URL = "struct<scheme:string,username:string,password:string,host:string,port:int,path:string,query:string,fragment:string,has_authority:boolean,errors:array<string>>"
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_DRIVE = re.compile(r"[A-Za-z][:|]")


class Failed(ValueError):
    pass


def percent(s: str, keep_out: frozenset[str], encoding: str = "utf-8") -> str:
    out = []
    for c in s:
        if c in keep_out or c < " " or c > "~":
            try:
                raw = c.encode(encoding)
            except UnicodeEncodeError:
                out.append(f"%26%23{ord(c)}%3B" if encoding != "utf-8" else "%EF%BF%BD")
                continue
            # bytes of a character that are safe by themselves stay
            out.append("".join(chr(b) if " " <= chr(b) <= "~" and chr(b) not in keep_out else f"%{b:02X}" for b in raw))
        else:
            out.append(c)
    return "".join(out)


def _ipv4_number(part: str) -> int | None:
    base = 10
    if part[:2] in ("0x", "0X"):
        part, base = part[2:], 16
    elif len(part) > 1 and part[0] == "0":
        part, base = part[1:], 8
    digits = "0123456789abcdefABCDEF"[: {8: 8, 10: 10, 16: 22}[base]]
    if any(c not in digits for c in part):
        return None
    return int(part, base) if part else 0


def parse_ipv4(host: str) -> str | None:
    """Dotted form if the host ends in a number; None if it is a name. Raises where the number is no address."""
    parts = host.removesuffix(".").split(".")
    last = parts[-1]
    if not last or not (last.isascii() and last.isdigit() or last[:2].lower() == "0x" and _ipv4_number(last) is not None):
        return None
    numbers = [_ipv4_number(p) if p else None for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        raise Failed("IPv4")
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def parse_ipv6(text: str) -> str:
    head, sep, tail = text.partition("::")
    if "::" in tail or (sep and tail.startswith(":")):
        raise Failed("IPv6")

    def groups(s: str, last: bool) -> list[int]:
        out: list[int] = []
        for k, g in enumerate(parts := s.split(":") if s else []):
            if "." in g:
                quad = g.split(".")
                if not last or k < len(parts) - 1 or len(quad) != 4 or any(not re.fullmatch(r"0|[1-9][0-9]{0,2}", q) or int(q) > 255 for q in quad):
                    raise Failed("IPv6")
                a, b, c, d = map(int, quad)
                out += [a << 8 | b, c << 8 | d]
            elif re.fullmatch(r"[0-9A-Fa-f]{1,4}", g):
                out.append(int(g, 16))
            else:
                raise Failed("IPv6")
        return out

    a, b = groups(head, not sep), groups(tail, True)
    if not sep and len(a) != 8 or sep and len(a) + len(b) > 7:
        raise Failed("IPv6")
    all_ = a + [0] * (8 - len(a) - len(b)) + b
    best, at, run = 1, -1, 0
    for k, g in enumerate([*all_, 1]):
        if g:
            if run > best:
                best, at = run, k - run
            run = 0
        else:
            run += 1
    if at < 0:
        return "[" + ":".join(f"{g:x}" for g in all_) + "]"
    return "[" + ":".join(f"{g:x}" for g in all_[:at]) + "::" + ":".join(f"{g:x}" for g in all_[at + best :]) + "]"


def parse_host(host: str, special: bool) -> str:
    if host.startswith("["):
        if not host.endswith("]"):
            raise Failed("IPv6")
        return parse_ipv6(host[1:-1])
    if not special:
        if any(c in FORBIDDEN_HOST for c in host):
            raise Failed("host")
        return percent(host, frozenset())
    host = unquote_to_bytes(host).decode("utf-8", "replace")
    if not host.isascii() or "xn--" in host.lower():
        try:
            host = X.to_ascii(host, X.BIDI | X.JOINERS)
        except ValueError as e:
            raise Failed("domain") from e
    host = X.U.normalize("NFC", host).lower()
    if not host or any(c in FORBIDDEN_DOMAIN for c in host):
        raise Failed("host")
    return parse_ipv4(host) or host


def normal_path(path: str, special: bool, file: bool, keep_drive: bool = False) -> str:
    """Dot segments resolved (also written %2e); '' stays ''."""
    if special:
        path = path.replace("\\", "/")
    if not path:
        return "/" if special else ""
    out: list[str] = []
    parts = path.removeprefix("/").split("/")
    for k, part in enumerate(parts):
        dots = re.sub("%2e", ".", part, flags=re.I)
        last = k == len(parts) - 1
        if dots == "..":
            if out and not (keep_drive and file and len(out) == 1 and re.fullmatch("[A-Za-z]:", out[0])):
                out.pop()
            if last:
                out.append("")
        elif dots == ".":
            if last:
                out.append("")
        else:
            if file and not out and re.fullmatch(r"[A-Za-z][:|]", part):
                part = part[0] + ":"
            out.append(percent(part, PATH_SET))
    return "/" + "/".join(out)


def clean(text: str) -> tuple[str, list[str]]:
    errors = []
    s = text.strip("".join(map(chr, range(0x21))))
    if s != text:
        errors.append("leading-or-trailing-c0-control-or-space")
    t = s.translate({9: None, 10: None, 13: None})
    if t != s:
        errors.append("tab-or-newline")
    return t, errors


def parse(text: str, base: dict | None = None, encoding: str = "utf-8") -> dict:
    s, errors = clean(text)
    m = _SCHEME.match(s)
    if not m:
        if base is None or not s.startswith("/"):
            raise Failed("relative")
        if s.startswith("//"):
            s = base["scheme"] + ":" + s
            m = _SCHEME.match(s)
        else:
            return _build(base["scheme"], s, {k: base[k] for k in ("username", "password", "host", "port", "has_authority")}, encoding, errors)
    scheme, rest = m[1].lower(), s[m.end() :]
    special = scheme in SPECIAL
    none = {"username": "", "password": "", "host": None, "port": None, "has_authority": False}
    if special:
        slashed = re.match(r"[/\\]*", rest)[0]
        if slashed != "//":
            errors.append("special-scheme-missing-following-solidus")
        if "\\" in re.split(r"[?#]", rest, maxsplit=1)[0]:
            errors.append("invalid-reverse-solidus")
        if scheme == "file":
            return _file(rest, none, encoding, errors)
        rest = rest[len(slashed) :]
    elif rest.startswith("//"):
        rest = rest[2:]
    else:
        return _build(scheme, rest, none, encoding, errors)
    end = re.search(r"[/\\?#]" if special else r"[/?#]", rest)
    cut = end.start() if end else len(rest)
    return _build(scheme, rest[cut:], _authority(rest[:cut], special, errors), encoding, errors)


def _file(rest: str, none: dict, encoding: str, errors: list[str]) -> dict:
    host = ""
    if re.match(r"[/\\]{2}", rest):
        rest = rest[2:]
        cut = m.start() if (m := re.search(r"[/\\?#]", rest)) else len(rest)
        if not _DRIVE.fullmatch(rest[:cut]):
            host, rest = rest[:cut], rest[cut:]
    if re.match(r"[/\\]?[A-Za-z]%7[Cc]", rest):
        raise Failed("drive")
    host = parse_host(host, True) if host else ""
    return _build("file", "/" + rest if rest and rest[0] not in "/\\?#" else rest, none | {"host": "" if host == "localhost" else host, "has_authority": True}, encoding, errors)


def _authority(text: str, special: bool, errors: list[str]) -> dict:
    user = password = ""
    if "@" in text:
        credentials, _, text = text.rpartition("@")
        errors.append("invalid-credentials")
        user, _, password = credentials.partition(":")
    port = None
    if m := re.search(r":([0-9]+)$", text):
        port, text = int(m[1]), text[: m.start()]
    if not text and (special or user or port is not None):
        raise Failed("host")
    if text and not text.startswith("[") and ":" in text:
        raise Failed("port")
    return {"username": percent(user, USERINFO_SET), "password": percent(password, USERINFO_SET), "host": parse_host(text, special) if text else "", "port": port, "has_authority": True}


def _build(scheme: str, rest: str, authority: dict, encoding: str, errors: list[str]) -> dict:
    special = scheme in SPECIAL
    rest, hash_, fragment = rest.partition("#")
    path, mark, query = rest.partition("?")
    if authority["has_authority"] or path.startswith("/"):
        path = normal_path(path, special, scheme == "file")
    else:
        path = percent(path, frozenset())
    return {"scheme": scheme} | authority | {
        "path": path, "query": percent(query, SPECIAL_QUERY_SET if special else QUERY_SET, encoding if special else "utf-8") if mark else None,
        "fragment": percent(fragment, FRAGMENT_SET) if hash_ else None, "errors": errors,
    }


def serialize(u: dict) -> str:
    out = u["scheme"] + ":"
    if u["has_authority"]:
        out += "//"
        if u["username"] or u["password"]:
            out += u["username"] + (":" + u["password"] if u["password"] else "") + "@"
        out += u["host"] or ""
        if u["port"] is not None:
            out += f":{u['port']}"
    elif u["path"].startswith("//"):
        out += "/."
    return out + u["path"] + ("?" + u["query"] if u["query"] is not None else "") + ("#" + u["fragment"] if u["fragment"] is not None else "")


PARTS = ("href", "protocol", "username", "password", "host", "hostname", "port", "pathname", "search", "hash")


def set_part(u: dict, part: str, value: str) -> dict:
    """The record with one part set; unchanged where the setter is a silent no-op. Raises Failed where it refuses."""
    special, file = u["scheme"] in SPECIAL, u["scheme"] == "file"
    new = dict(u)
    bare = not u["host"] or file
    if part == "href":
        return parse(value)
    if part == "protocol":
        scheme = value.split(":")[0].lower()
        if not re.fullmatch(r"[a-z][a-z0-9+.-]*", scheme):
            raise Failed("scheme")
        if (scheme in SPECIAL) != special or (scheme == "file" and (u["username"] or u["password"] or u["port"] is not None)) or (file and not u["host"]):
            return u
        new["scheme"] = scheme
        if u["port"] is not None and SPECIAL.get(scheme) == u["port"]:
            new["port"] = None
    elif part in ("username", "password"):
        if not bare:
            new[part] = percent(value, USERINFO_SET)
    elif part in ("host", "hostname"):
        if not u["has_authority"] and not special:
            return u
        if any(c in value for c in "/?#@\\") or any(c <= " " for c in value):
            raise Failed("host")
        m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", value)
        if not m:
            raise Failed("host")
        if m[2] is not None and part == "hostname":
            if file:
                return u
            raise Failed("port")
        if m[2] and file:
            return u
        if not m[1] and special and not file:
            raise Failed("host")
        new["host"] = parse_host(m[1], special) if m[1] else ""
        if m[2]:
            new = _port(new, m[2])
    elif part == "port":
        if bare:
            return u
        if value == "":
            new["port"] = None
        else:
            m = re.match("[0-9]+", value)
            if not m:
                raise Failed("port")
            new = _port(new, m[0])
    elif part == "pathname":
        if not u["has_authority"] and not u["path"].startswith("/"):
            return u
        if special:
            value = value.replace("\\", "/")
        new["path"] = normal_path(value if value.startswith("/") else "/" + value, special, file, True).replace("?", "%3F").replace("#", "%23")
    elif part == "search":
        new["query"] = percent(value.removeprefix("?"), SPECIAL_QUERY_SET if special else QUERY_SET) if value else None
    elif part == "hash":
        new["fragment"] = percent(value.removeprefix("#"), FRAGMENT_SET) if value else None
    else:
        raise ValueError(f"no part {part}")
    return new


def _port(u: dict, digits: str) -> dict:
    if int(digits) > 65535:
        raise Failed("port")
    return u | {"port": None if SPECIAL.get(u["scheme"]) == int(digits) else int(digits)}


def _parsed(text: str, base: str | None = None, encoding: str = "utf-8") -> dict | None:
    try:
        return parse(text, parse(base) if base is not None else None, encoding)
    except Failed:
        return None


def _set(text: str, part: str, value: str | None) -> str | None:
    u = _parsed(text)
    if u is None or value is None:
        return None if u is None else serialize(u)
    try:
        return serialize(set_part(u, part, value))
    except Failed:
        return serialize(u)


_url_parse = scalar(_parsed, URL)
_url_resolve = scalar(lambda text, base: (lambda u: u and serialize(u))(_parsed(text, base)), "string")
url_set = scalar(_set, "string")
url_set.__doc__ = "url_set(url, part, value): href after a setter; unchanged where the setter refuses; null for a bad URL."


def url_parse(col: Column, base: Column | None = None, encoding: str = "utf-8") -> Column:
    """The URL's record; null where it does not parse."""
    return _url_parse(col, base if base is not None else F.lit(None).cast("string"), F.lit(encoding))


def url_resolve(col: Column, base: Column) -> Column:
    """href of a reference against a base."""
    return _url_resolve(col, base)


def url_text(u: Column) -> Column:
    """A record as text, with built-ins alone."""
    login = F.when((u["username"] != "") | (u["password"] != ""), F.concat(u["username"], F.when(u["password"] != "", F.concat(F.lit(":"), u["password"])).otherwise(""), F.lit("@"))).otherwise("")
    port = F.when(u["port"].isNotNull(), F.concat(F.lit(":"), u["port"].cast("string"))).otherwise("")
    authority = F.when(u["has_authority"], F.concat(F.lit("//"), login, F.coalesce(u["host"], F.lit("")), port)).when(u["path"].startswith("//"), "/.").otherwise("")
    tail = [F.when(u[k].isNotNull(), F.concat(F.lit(c), u[k])).otherwise("") for k, c in (("query", "?"), ("fragment", "#"))]
    return F.concat(u["scheme"], F.lit(":"), authority, u["path"], *tail)


def url_errors(u: Column, kind: str) -> Column:
    """How often a validation error of this kind occurred."""
    return F.size(F.filter(u["errors"], lambda e: e == kind))


# ---- query parameters: arrays of (name, value), by built-ins ------------------------------------------------------------
def _decode(c: Column) -> Column:
    plus = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(F.replace(F.replace(plus, F.lit(" "), F.lit("%20")), F.lit("+"), F.lit("%2B"))), plus)


def params(query: Column) -> Column:
    """Parameters of a query string in order; one leading ? is dropped, and an empty last part."""
    q = F.regexp_replace(query, r"^\?", "")
    parts = F.split(q, "&")
    parts = F.when(q == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    cut = lambda p: F.instr(p, "=")
    return F.transform(
        parts,
        lambda p: F.struct(
            _decode(F.when(F.contains(p, F.lit("=")), F.substring_index(p, "=", 1)).otherwise(p)).alias("name"),
            _decode(F.when(F.contains(p, F.lit("=")), F.substr(p, cut(p) + 1)).otherwise(F.lit(""))).alias("value"),
        ),
    )


def _pair(name, value) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))


def params_append(p: Column, name: str, value: str) -> Column:
    return F.array_append(p, _pair(name, value))


def params_delete(p: Column, name: str, value: str | None = None) -> Column:
    return F.filter(p, lambda x: ~((x["name"] == name) & (F.lit(True) if value is None else x["value"] == value)))


def params_get(p: Column, name: str) -> Column:
    return F.try_element_at(F.filter(p, lambda x: x["name"] == name), F.lit(1))["value"]


def params_get_all(p: Column, name: str) -> Column:
    return F.transform(F.filter(p, lambda x: x["name"] == name), lambda x: x["value"])


def params_has(p: Column, name: str, value: str | None = None) -> Column:
    return F.exists(p, lambda x: (x["name"] == name) & (F.lit(True) if value is None else x["value"] == value))


def params_count(p: Column) -> Column:
    return F.size(p)


def params_set(p: Column, name: str, value: str) -> Column:
    """The first parameter of the name gets the value, later ones go; appended if there is none."""
    at = F.array_position(F.transform(p, lambda x: x["name"]), name)
    kept = F.filter(p, lambda x, i: (x["name"] != name) | (i + 1 == at))
    return F.when(at == 0, params_append(p, name, value)).otherwise(F.transform(kept, lambda x: F.when(x["name"] == name, _pair(name, value)).otherwise(x)))


def params_sort(p: Column) -> Column:
    """By name in byte order, stable."""
    keyed = F.array_sort(F.transform(p, lambda x, i: F.struct(x["name"].alias("n"), i.alias("i"), x.alias("x"))))
    return F.transform(keyed, lambda k: k["x"])


def _form(c: Column) -> Column:
    # url_encode keeps * - . _ and writes a space as +, as form encoding does; only ~ differs between implementations
    return F.replace(F.url_encode(c), F.lit("~"), F.lit("%7E"))


def params_text(p: Column) -> Column:
    """Form encoding."""
    return F.array_join(F.transform(p, lambda x: F.concat(_form(x["name"]), F.lit("="), _form(x["value"]))), "&")
