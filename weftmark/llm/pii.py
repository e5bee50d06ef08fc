"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, URI schemes, plus signs, digits and identifier cues;
from each anchor a deterministic local parser expands to the span's boundaries and validates
it. Text between anchors is never looked at. One narrow pass, no shuffle.

Defined results: a null text is an empty one (no spans); empty texts give no spans; texts of
any length are read whole; equal rows give equal rows; extra columns are ignored. Spans are
code points, end exclusive, ordered by start, then by the order of ``KINDS``, then by end.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import bound_batches, per_text

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: user@host or user:password@host behind a scheme
_USERINFO = re.compile(r"://[^\s/?#@:]+(?::[^\s/?#@]*)?@(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9.-]+)(?::[0-9]+)?")
_SCHEME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
#: What may stand between a cue and its value.
_BEFORE = r"(?i:(?<=acct)\.)?(?:\x20?(?i:numbers?|no\.?|nr\.?|num\.?|id))?(?:(?<=\.)[\x20:#]{0,3}|[\x20:#]{1,3})"
_IBAN = re.compile(_BEFORE + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_SSN = re.compile(_BEFORE + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT_AT = re.compile(_BEFORE)
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,33}")
#: One to four capitals before a number; or one word with a letter and a digit, with four digits where a letter is small.
_LETTERED = re.compile(r"[A-Z]{1,4}[\x20-]?[0-9](?:[\x20-]?[0-9]){4,33}[A-Z]?(?![A-Za-z0-9])")
_MIXED = re.compile(r"(?=[0-9-]*[A-Za-z])(?:(?=[A-Z-]*[0-9])(?=[A-Z0-9-]+(?![A-Za-z0-9-]))|(?=(?:[A-Za-z-]*[0-9]){4}))[A-Za-z0-9](?:-?[A-Za-z0-9]){5,33}(?![A-Za-z0-9])")
#: Identifier cues and the parser that reads what follows.
CUES = {"iban": "iban", "ssn": "ssn", "social security number": "ssn", "account": "account", "acct": "account", "passport": "account"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("d", 1))
    for anchor in ("@", "+", "://"):
        found.add_word(anchor, (anchor, len(anchor)))
    for cue, parser in CUES.items():
        found.add_word(cue, (parser, len(cue)))
    found.make_automaton()
    return found


_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """The text in lower case, of equal length."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def account_at(text: str, at: int) -> tuple[int, int] | None:
    """The longest number, with letters or without, behind a cue that ends at ``at``."""
    if not (before := _ACCOUNT_AT.match(text, at)):
        return None
    start = before.end()
    return max((m.span() for p in (_NUMBER, _LETTERED, _MIXED) if (m := p.match(text, start))), default=None)


def finder():
    """A function from a text to its spans [(kind, start, end)], in order."""
    anchors = _automaton()

    def spans(text: str) -> list[tuple[str, int, int]]:
        out = []
        mail = quad = card = phone = 0  # where each kind's next match may begin
        last_digit = -2
        for end, (kind, width) in anchors.iter(lowered(text)):
            at = end - width + 1
            if kind == "d":
                if last_digit != at - 1 and at >= quad and (m := _QUAD.match(text, at)):
                    quad = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                        out.append(("ip", at, quad))
                last_digit = at
                if at >= card and (m := _DIGITS.match(text, at)):
                    card = m.end()
                    if card - at >= 14:
                        digits = _NOT_DIGIT.sub("", m[0])
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            out.append(("card", at, card))
            elif kind == "@":
                start = at
                while start > mail and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at)):
                    mail = m.end()
                    out.append(("email", start, mail))
            elif kind == "+":
                if at >= phone and (m := _PHONE.match(text, at)):
                    phone = m.end()
                    if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                        out.append(("phone", at, phone))
            elif kind == "://":
                if m := _USERINFO.match(text, at):
                    start = at
                    while start and text[start - 1] in _SCHEME_CHARS:
                        start -= 1
                    if start < at:
                        out.append(("address", start, m.end()))
            elif at and text[at - 1].isalnum():
                continue  # a cue inside a word is none
            elif kind == "iban":
                if m := _IBAN.match(text, end + 1):
                    value = m[1]  # the longest prefix with right check digits
                    while len(value) >= 15 and not iban_ok(value):
                        value = value[:-1]
                    if len(value) >= 15:
                        out.append(("account", m.start(1), m.start(1) + len(value)))
            elif kind == "ssn":
                if (m := _SSN.match(text, end + 1)) and m[1][:3] not in ("000", "666") and m[1][0] != "9":
                    out.append(("account", *m.span(1)))
            elif span := account_at(text, end + 1):
                out.append(("account", *span))
        out.sort(key=lambda s: (s[1], _RANK[s[0]], s[2]))
        return out

    return spans


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's spans as an array of structs."""

    def start():
        spans = finder()
        return lambda text: ([{"kind": k, "start": a, "end": b} for k, a, b in spans(text or "")],)

    return per_text(df, SPANS, start, id_col, text_col)


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the digest of the base spans and all spans as one string, for each row."""

    def start():
        spans = finder()

        def one(text: str | None) -> tuple:
            found = spans(text or "")
            base = [s for s in found if s[0] in BASE]
            return *(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)

        return one

    return per_text(df, DIGEST, start, id_col, text_col)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its first kind in brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact_pii(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with personal data replaced; its columns, their order and its rows stay. Null texts stay null.
    ``length_col``, where there is one, follows the new text."""
    if text_col not in df.columns:
        raise ValueError(f"no column {text_col}")
    bound_batches(df.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        spans = _shared_finder()
        return texts.map(lambda t: t if t is None else redact(t, spans(t)))

    out = df.withColumn(text_col, clean(F.col(text_col).cast("string")))
    if length_col and length_col in df.columns:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col), F.col(length_col)).cast(df.schema[length_col].dataType))
    return out


_held: list = []


def _shared_finder():
    if not _held:
        _held.append(finder())
    return _held[0]
