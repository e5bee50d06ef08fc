"""Unicode normalisation, Punycode and IDNA over whole values. Data: Python's unicodedata (Unicode 15.1)."""

from __future__ import annotations

import re
import unicodedata as U

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftmark.functions.batches import scalar, series

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def normalize_unicode(col: Column, form: str = "NFC") -> Column:
    """Normal form of a string column; a null stays null. Every row goes through Python: Spark evaluates such functions for all rows."""
    if form not in FORMS:
        raise ValueError(f"no normal form {form}")
    return series(lambda s: U.normalize(form, s), "string")(col)


def combining_class(col: Column) -> Column:
    """Canonical combining class of the first code point."""
    return series(lambda s: U.combining(s[0]) if s else None, "int")(col)


def compose_pair(a: str, b: str) -> str | None:
    """The canonical composition of two code points, if there is one."""
    c = U.normalize("NFC", a + b)
    return c if len(c) == 1 and U.normalize("NFD", c) == U.normalize("NFD", a + b) else None


compose = scalar(compose_pair, "string")


# ---- Punycode (RFC 3492) ------------------------------------------------------------------------------------------------
_BASE, _TMIN, _TMAX, _SKEW, _DAMP, _BIAS, _FIRST, _MOST = 36, 1, 26, 38, 700, 72, 128, (1 << 32) - 1


class PunycodeError(ValueError):
    pass


def _adapt(delta: int, n: int, first: bool) -> int:
    delta = delta // _DAMP if first else delta // 2
    delta += delta // n
    k = 0
    while delta > (_BASE - _TMIN) * _TMAX // 2:
        delta //= _BASE - _TMIN
        k += _BASE
    return k + (_BASE - _TMIN + 1) * delta // (delta + _SKEW)


def _threshold(k: int, bias: int) -> int:
    return min(max(k - bias, _TMIN), _TMAX)


def punycode_encode(text: str) -> str:
    points = list(map(ord, text))
    out = [chr(c) for c in points if c < 128]
    done = basic = len(out)
    if basic:
        out.append("-")
    n, delta, bias = _FIRST, 0, _BIAS
    while done < len(points):
        m = min(c for c in points if c >= n)
        delta += (m - n) * (done + 1)
        n = m
        if delta > _MOST:
            raise PunycodeError("overflow")
        for c in points:
            delta += c < n
            if c == n:
                q, k = delta, _BASE
                while q >= (t := _threshold(k, bias)):
                    d = t + (q - t) % (_BASE - t)
                    out.append(chr(d + 97 if d < 26 else d + 22))
                    q = (q - t) // (_BASE - t)
                    k += _BASE
                out.append(chr(q + 97 if q < 26 else q + 22))
                bias = _adapt(delta, done + 1, done == basic)
                delta = 0
                done += 1
        delta += 1
        n += 1
    return "".join(out)


def punycode_decode(text: str) -> str:
    at = text.rfind("-")
    out = list(text[:at]) if at > 0 else []
    if any(ord(c) > 127 for c in text):
        raise PunycodeError("not basic")
    k0 = at + 1 if at > 0 else 0
    n, i, bias = _FIRST, 0, _BIAS
    while k0 < len(text):
        before, w, k = i, 1, _BASE
        while True:
            if k0 >= len(text):
                raise PunycodeError("short")
            c = text[k0]
            k0 += 1
            d = ord(c) - 22 if "0" <= c <= "9" else ord(c) - 97 if "a" <= c <= "z" else ord(c) - 65 if "A" <= c <= "Z" else 99
            if d >= _BASE:
                raise PunycodeError("digit")
            i += d * w
            if i > _MOST:
                raise PunycodeError("overflow")
            t = _threshold(k, bias)
            if d < t:
                break
            w *= _BASE - t
            k += _BASE
        bias = _adapt(i - before, len(out) + 1, before == 0)
        n += i // (len(out) + 1)
        i %= len(out) + 1
        if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
            raise PunycodeError("code point")
        out.insert(i, chr(n))
        i += 1
    return "".join(out)


def _or_none(fn):
    def one(*a):
        try:
            return fn(*a)
        except ValueError:
            return None

    return one


punycode_to_ascii = scalar(_or_none(punycode_encode), "string")
punycode_to_unicode = scalar(_or_none(punycode_decode), "string")
punycode_result = scalar(
    lambda s: (lambda out: {"value": out, "unchanged": out == s + "-" or out == s})(_or_none(punycode_encode)(s)), "struct<value:string,unchanged:boolean>"
)

# ---- IDNA (UTS 46 by property rules) --------------------------------------------------------------------------------------
STD3, HYPHENS, BIDI, JOINERS, TRANSITIONAL, DNS_LENGTH = 1, 2, 4, 8, 16, 32
_DEVIATIONS = {"ß": "ss", "ς": "σ", "‌": "", "‍": ""}
_IGNORED = re.compile("[­͏᠋-᠍᠏​⁠⁤︀-️﻿\U000e0100-\U000e01ef]")
_DOTS = re.compile("[.。．｡]")


class IdnaError(ValueError):
    pass


def idna_kind(c: str) -> str:
    """ignored, deviation, mapped, disallowed or valid, by the code point's properties."""
    if c in _DEVIATIONS:
        return "deviation"
    if c in "\ufffc\ufffd":  # what replaces something else names nothing
        return "disallowed"
    if _IGNORED.match(c):
        return "ignored"
    low = U.normalize("NFKC", U.normalize("NFKC", c).casefold())
    if low != c and not any(U.category(x) in ("Cn", "Co", "Cs", "Cc", "Zs", "Zl", "Zp") for x in low):
        return "mapped"
    return "disallowed" if U.category(c) in ("Cn", "Co", "Cs", "Cc", "Cf", "Zs", "Zl", "Zp") else "valid"


def idna_map(text: str, flags: int = STD3) -> str:
    out = []
    for c in text:
        kind = idna_kind(c)
        if kind == "disallowed":
            raise IdnaError(f"disallowed U+{ord(c):04X}")
        if kind == "deviation":
            out.append(_DEVIATIONS[c] if flags & TRANSITIONAL else c)
        elif kind == "mapped":
            out.append(U.normalize("NFKC", U.normalize("NFKC", c).casefold()))
        elif kind == "valid":
            out.append(c)
    return U.normalize("NFC", "".join(out))


def _check(label: str, flags: int) -> None:
    if U.normalize("NFC", label) != label:
        raise IdnaError("not normalised")
    if flags & HYPHENS and (label[2:4] == "--" or label[:1] == "-" or label[-1:] == "-"):
        raise IdnaError("hyphens")
    if label and U.category(label[0])[0] == "M":
        raise IdnaError("leading mark")
    for k, c in enumerate(label):
        if flags & STD3 and c.isascii() and not (c.isdigit() or c == "-" or "a" <= c <= "z"):
            raise IdnaError("not a host character")
        if c == "." or idna_kind(c) not in ("valid", "deviation"):
            raise IdnaError("invalid code point")
        if flags & JOINERS and c in "‌‍":
            before = label[k - 1] if k else ""
            virama = bool(before) and U.combining(before) == 9
            arabic = c == "‌" and bool(before) and U.bidirectional(before) in ("AL", "NSM") and k + 1 < len(label) and U.bidirectional(label[k + 1]) in ("AL", "NSM")
            if not virama and not arabic:
                raise IdnaError("joiner")


def _check_bidi(labels: list[str]) -> None:
    kinds = [[U.bidirectional(c) for c in label] for label in labels]
    if not any(k in ("R", "AL", "AN") for row in kinds for k in row):
        return
    for row in kinds:
        if not row:
            continue
        bare = [k for k in row if k != "NSM"]
        if row[0] in ("R", "AL"):
            ok = set(row) <= {"R", "AL", "AN", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and bare[-1] in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(row)
        else:
            ok = row[0] == "L" and set(row) <= {"L", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and bare[-1] in ("L", "EN")
        if not ok:
            raise IdnaError("bidi")


def _labels(text: str, flags: int) -> list[str]:
    out = []
    for label in _DOTS.split(idna_map(text, flags)):
        if label.startswith("xn--"):
            label = punycode_decode(label[4:])
            if not label or label.isascii():
                raise IdnaError("needless punycode")
            _check(label, flags & ~TRANSITIONAL)
        else:
            _check(label, flags)
        out.append(label)
    if flags & BIDI:
        _check_bidi(out)
    return out


def to_ascii(text: str, flags: int = STD3) -> str:
    labels = [label if label.isascii() else "xn--" + punycode_encode(label) for label in _labels(text, flags)]
    out = ".".join(labels)
    if flags & DNS_LENGTH:
        bare = out.removesuffix(".")
        if not 1 <= len(bare) <= 253 or any(not 1 <= len(x) <= 63 for x in bare.split(".")):
            raise IdnaError("length")
    return out


def to_unicode(text: str, flags: int = STD3) -> str:
    return ".".join(_labels(text, flags))


def idna_to_ascii(col: Column, flags: int = STD3) -> Column:
    """ASCII form of a domain; null where it has none."""
    return series(_or_none(lambda s: to_ascii(s, flags)), "string")(col)


def idna_to_unicode(col: Column, flags: int = STD3) -> Column:
    return series(_or_none(lambda s: to_unicode(s, flags)), "string")(col)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, nothing else; Spark's lower() is Unicode-aware."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
