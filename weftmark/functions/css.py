"""CSS syntax: tokens, rules, declarations with typed values. One pattern-driven tokenizer, grammars as small matchers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions.batches import explode_rows, scalar

# ---- fixed values -------------------------------------------------------------------------------------------------
WIDE = frozenset("inherit initial revert unset".split())
LENGTH_UNITS = frozenset("cap ch cm em ex ic in lh mm pc pt px q rem rlh vb vh vi vmax vmin vw".split())
ANGLE_UNITS = frozenset("deg grad rad turn".split())
COLORS = frozenset(
    """aliceblue antiquewhite aqua aquamarine azure beige bisque black blanchedalmond blue blueviolet brown burlywood cadetblue chartreuse chocolate coral
    cornflowerblue cornsilk crimson cyan darkblue darkcyan darkgoldenrod darkgray darkgreen darkgrey darkkhaki darkmagenta darkolivegreen darkorange darkorchid
    darkred darksalmon darkseagreen darkslateblue darkslategray darkslategrey darkturquoise darkviolet deeppink deepskyblue dimgray dimgrey dodgerblue firebrick
    floralwhite forestgreen fuchsia gainsboro ghostwhite gold goldenrod gray green greenyellow grey honeydew hotpink indianred indigo ivory khaki lavender
    lavenderblush lawngreen lemonchiffon lightblue lightcoral lightcyan lightgoldenrodyellow lightgray lightgreen lightgrey lightpink lightsalmon lightseagreen
    lightskyblue lightslategray lightslategrey lightsteelblue lightyellow lime limegreen linen magenta maroon mediumaquamarine mediumblue mediumorchid mediumpurple
    mediumseagreen mediumslateblue mediumspringgreen mediumturquoise mediumvioletred midnightblue mintcream mistyrose moccasin navajowhite navy oldlace olive
    olivedrab orange orangered orchid palegoldenrod palegreen paleturquoise palevioletred papayawhip peachpuff peru pink plum powderblue purple rebeccapurple red
    rosybrown royalblue saddlebrown salmon sandybrown seagreen seashell sienna silver skyblue slateblue slategray slategrey snow springgreen steelblue tan teal
    thistle tomato turquoise violet wheat white whitesmoke yellow yellowgreen transparent currentcolor accentcolor accentcolortext activetext buttonborder
    buttonface buttontext canvas canvastext field fieldtext graytext highlight highlighttext linktext mark marktext selecteditem selecteditemtext visitedtext""".split()
)
#: System colours as they are written back.
SYSTEM_COLORS = {
    w.lower(): w
    for w in """Canvas CanvasText LinkText VisitedText ActiveText ButtonFace ButtonText ButtonBorder Field FieldText Highlight HighlightText SelectedItem
    SelectedItemText Mark MarkText GrayText AccentColor AccentColorText""".split()
}
_OVERFLOW = "auto clip hidden scroll visible"
KEYWORDS: dict[str, str] = {
    "align-content": "center flex-end flex-start space-around space-between stretch", "align-items": "baseline center flex-end flex-start stretch",
    "align-self": "auto baseline center flex-end flex-start stretch", "box-sizing": "border-box content-box",
    "clear": "block-end block-start bottom inline-end inline-start left none right top", "direction": "ltr rtl",
    "flex-direction": "column column-reverse row row-reverse", "flex-wrap": "nowrap wrap wrap-reverse", "hyphens": "auto manual none",
    "justify-content": "center flex-end flex-start space-around space-between", "line-break": "anywhere auto loose normal strict",
    "overflow-block": _OVERFLOW, "overflow-inline": _OVERFLOW, "overflow-x": _OVERFLOW, "overflow-y": _OVERFLOW, "overflow-wrap": "anywhere break-word normal",
    "position": "absolute fixed relative static sticky", "text-align": "center end justify justify-all left match-parent right start",
    "text-align-all": "center end justify left match-parent right start", "text-align-last": "auto center end justify left match-parent right start",
    "text-justify": "auto inter-character inter-word none", "text-orientation": "mixed sideways upright", "text-overflow": "clip ellipsis",
    "unicode-bidi": "bidi-override embed isolate isolate-override normal plaintext", "visibility": "collapse hidden visible",
    "white-space": "break-spaces normal nowrap pre pre-line pre-wrap", "word-break": "break-all break-word keep-all normal",
    "word-wrap": "anywhere break-word normal", "writing-mode": "horizontal-tb sideways-lr sideways-rl vertical-lr vertical-rl",
    "wrap-flow": "auto both clear end maximum minimum start", "wrap-through": "none wrap", "float-reference": "column inline page region",
    "baseline-source": "auto first last", "dominant-baseline": "alphabetic auto central hanging ideographic mathematical middle text-bottom text-top",
    "alignment-baseline": "alphabetic baseline central ideographic mathematical middle text-bottom text-top",
}
SHIFT = frozenset("bottom center sub super top".split())
ALIGNMENT = frozenset(KEYWORDS["alignment-baseline"].split())
FLOATS = frozenset("block-end block-start bottom inline-end inline-start left none right snap-block snap-inline top".split())
BORDER_WIDTHS = frozenset("medium thick thin".split())
BORDER_STYLES = frozenset("dashed dotted double groove hidden inset none outset ridge solid".split())
SIZES, MAX_SIZES = frozenset("auto max-content min-content".split()), frozenset("none max-content min-content".split())
BASIS = frozenset("auto content max-content min-content".split())
GENERIC_FAMILIES = frozenset("serif sans-serif cursive fantasy monospace system-ui emoji math fangsong ui-serif ui-sans-serif ui-monospace ui-rounded".split())
STRETCH = frozenset("condensed expanded extra-condensed extra-expanded normal semi-condensed semi-expanded ultra-condensed ultra-expanded".split())
FONT_SIZES = frozenset("large larger math medium small smaller x-large x-small xx-large xx-small xxx-large".split())
DECORATION_LINES = frozenset("blink line-through overline underline".split())
DECORATION_STYLES = frozenset("dashed dotted double solid wavy".split())
DISPLAY_SINGLE = frozenset(
    "block contents flex flow flow-root grid inherit initial inline inline-block inline-grid inline-table inline-flex list-item none revert ruby ruby-base ruby-base-container ruby-text ruby-text-container run-in table table-caption table-cell table-column table-column-group table-footer-group table-header-group table-row table-row-group unset".split()
)
# ---------------------------------------------------------------------------------------------------------------------

TOKENS = "array<struct<type:string,value:string,length:int>>"
DECLARATIONS = "array<struct<type:string,name:string,value:string,important:boolean>>"


@dataclass(frozen=True)
class Token:
    type: str
    value: str  # as written back: normal numbers, quoted strings, delimiters in place
    length: int  # in bytes of UTF-8
    unit: str = ""
    raw: str = ""
    name: str = ""  # what the token names, without delimiters


_ESC = r"\\(?:[0-9A-Fa-f]{1,6}(?:\r\n|[ \t\n\f\r])?|[^\n\f\r0-9A-Fa-f]|\Z)"
#: Code points above ASCII that names may hold, as the CSS syntax standard lists them.
_WIDE_NAME = "\xb7\xc0-\xd6\xd8-\xf6\xf8-\u037d\u037f-\u1fff\u200c\u200d\u203f\u2040\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U0010ffff"
_START = rf"(?:[A-Za-z_\x00{_WIDE_NAME}]|{_ESC})"
_PART = rf"(?:[A-Za-z0-9_\-\x00{_WIDE_NAME}]|{_ESC})"
_IDENT = rf"(?:--{_PART}*|-?{_START}{_PART}*)"
_NUMBER = r"(?>[+-]?(?:\d+\.\d+|\d+|\.\d+)(?:[eE][+-]?\d+)?)"
_INSIDE = r"\\(?:[0-9A-Fa-f]{1,6}(?:\r\n|[ \t\n\f\r])?|\r\n|[^0-9A-Fa-f]|\Z)"
_PATTERNS: list[tuple[str, re.Pattern]] = [
    (k, re.compile(p))
    for k, p in (
        ("comment", r"/\*([\s\S]*?)(?:\*/|\Z)"), ("whitespace", r"[ \t\n\f\r]+"), ("string", rf"\"((?>[^\"\\\n\f\r]|{_INSIDE})*)(\"|\Z)?|'((?>[^'\\\n\f\r]|{_INSIDE})*)('|\Z)?"),
        ("CDO", r"<!--"), ("CDC", r"-->"), ("hash", rf"#{_PART}+"), ("at-keyword", rf"@{_IDENT}"), ("percentage", rf"{_NUMBER}%"), ("dimension", rf"{_NUMBER}(?={_IDENT})"),
        ("number", _NUMBER), ("function", rf"{_IDENT}\("), ("ident", _IDENT),
    )
]
_SINGLE = {":": "colon", ";": "semicolon", ",": "comma", "(": "left-parenthesis", ")": "right-parenthesis", "[": "left-square-bracket", "]": "right-square-bracket", "{": "left-curly-bracket", "}": "right-curly-bracket"}
_UNIT = re.compile(_IDENT)
#: What follows "url(" when it is no function with a string; then either the end or something bad.
_URL_OPEN = re.compile(r"[ \t\n\f\r]*(?![\"' \t\n\f\r]|\Z)")
_URL_BODY = re.compile(rf"(?>[^\"'()\\\x01-\x20\x7f]|{_ESC})*")
_URL_END = re.compile(r"[ \t\n\f\r]*(?:\)|\Z)")
_URL_REST = re.compile(r"(?P<skip>[ \t\n\f\r]*|\\)(?P<rest>(?:[^)\\]|\\[\s\S]|\\\Z)*)\)?")
_UNICODE_RANGE = re.compile(r"[uU]\+(?:([0-9A-Fa-f]{0,5})(\?{1,6})|([0-9A-Fa-f]{1,6})(?:-([0-9A-Fa-f]{1,6}))?)")
_UNESC = re.compile(r"\\(?:([0-9A-Fa-f]{1,6})(?:\r\n|[ \t\n\f\r])?|(\r\n|[\n\f\r])|([\s\S])|\Z)")
_NEWLINE = re.compile(r"\r\n|[\r\f]")
#: Digits of a number that count.
MOST_DIGITS = 128


def unescape(s: str, at_end: str = "\ufffd") -> str:
    """``at_end`` stands for a backslash with nothing behind it."""

    def one(m):
        if m[1]:
            n = int(m[1], 16)
            return "\ufffd" if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)
        return m[3] or ("" if m[2] else at_end)

    return (_UNESC.sub(one, s) if "\\" in s else s).replace("\0", "\ufffd")


def number_text(raw: str) -> str:
    """A number's shortest text; exponents are written out from 1e-6 up to below 1e21."""
    mantissa, _, power = raw.lower().partition("e")
    whole, _, part = mantissa.lstrip("+-").partition(".")
    if len(whole) + len(part) > MOST_DIGITS:
        whole, part = whole[:MOST_DIGITS], part[: max(MOST_DIGITS - len(whole), 0)]
    x = float(f"{'-' if raw[0] == '-' else ''}{whole or 0}.{part or 0}e{power or 0}")
    if x in (float("inf"), float("-inf")):
        return ("-" if x < 0 else "") + "1.797693134862316e+308"
    if x and not 1e-6 <= abs(x) < 1e21:
        digits, _, power = format(Decimal(repr(x)).normalize(), "e").partition("e")
        return f"{digits}e{int(power):+d}"
    text = format(Decimal(repr(x)), "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def _url(css: str, at: int) -> tuple[str, str, int] | None:
    """Kind, value and end of the URL whose inside begins at ``at``; None if a string or nothing follows."""
    opened = _URL_OPEN.match(css, at)
    if not opened:
        return None
    body = _URL_BODY.match(css, opened.end())
    if end := _URL_END.match(css, body.end()):
        return "url", f"url({unescape(body[0])})", end.end()
    rest = _URL_REST.match(css, body.end())
    return "bad-url", f"url({unescape(body[0])}{rest['rest']})", rest.end()


def _unicode_range(m: re.Match) -> tuple[str, int]:
    """Value and length of a match of the range pattern; six digits and wildcards count together."""
    if m[2]:
        n = min(len(m[2]), 6 - len(m[1]))
        low = int(m[1] or "0", 16) << 4 * n
        return f"U+{low:X}-{low | (1 << 4 * n) - 1:X}", 2 + len(m[1]) + n
    low = int(m[3], 16)
    return f"U+{low:X}-{int(m[4], 16) if m[4] else low:X}", len(m[0])


def tokenize(css: str, unicode_range: bool = False) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(css):
        if unicode_range and (m := _UNICODE_RANGE.match(css, at)):
            value, size = _unicode_range(m)
            out.append(Token("unicode-range", value, size, raw=css[at : at + size]))
            at += size
            continue
        for kind, pattern in _PATTERNS:
            m = pattern.match(css, at)
            if not m:
                continue
            raw, end, unit, name = m[0], m.end(), "", ""
            value = raw
            if kind == "string":
                inside, closed = (m[1], m[2]) if m[1] is not None else (m[3], m[4])
                name = unescape(inside, "")
                value = _quoted(name)
                if closed is None:
                    kind = "bad-string"
            elif kind == "dimension":
                u = _UNIT.match(css, end)
                end, unit = u.end(), unescape(u[0])
                value = number_text(raw) + unit
            elif kind in ("number", "percentage"):
                value = number_text(raw.rstrip("%")) + ("%" if kind == "percentage" else "")
            elif kind == "function":
                name = unescape(raw[:-1])
                value = name + "("
                if name.lower() == "url" and (found := _url(css, end)):
                    kind, value, end = found
            elif kind in ("hash", "at-keyword"):
                name = unescape(raw[1:])
                value = raw[0] + name
            elif kind == "ident":
                value = name = unescape(raw)
            elif kind == "comment":
                value = "/*" + _NEWLINE.sub("\n", m[1]).replace("\0", "\ufffd") + "*/"
            elif kind == "whitespace":
                value = _NEWLINE.sub("\n", raw)
            out.append(Token(kind, value, _size(css[at:end]), unit, css[at:end], name))
            at = end
            break
        else:
            c = css[at]
            out.append(Token(_SINGLE.get(c, "delim"), c, _size(c), raw=c))
            at += 1
    return out


# ---- rules ------------------------------------------------------------------------------------------------------------
_OPEN = {"left-parenthesis": "right-parenthesis", "function": "right-parenthesis", "left-square-bracket": "right-square-bracket", "left-curly-bracket": "right-curly-bracket"}


def _block_end(t: list[Token], k: int) -> int:
    """The place behind what opens at k."""
    want = [_OPEN[t[k].type]]
    k += 1
    while k < len(t) and want:
        if t[k].type == want[-1]:
            want.pop()
        elif t[k].type in _OPEN:
            want.append(_OPEN[t[k].type])
        k += 1
    return k


def _source(t: list[Token]) -> str:
    return "".join(" " if x.type == "whitespace" else "" if x.type == "comment" else x.raw for x in t).strip()


def _blank(x: Token) -> bool:
    return x.type in ("whitespace", "comment")


def _trim(t: list[Token]) -> list[Token]:
    """The tokens without white space at the ends."""
    a, b = 0, len(t)
    while a < b and t[a].type == "whitespace":
        a += 1
    while a < b and t[b - 1].type == "whitespace":
        b -= 1
    return t[a:b]


def _text(t: list[Token]) -> str:
    return "".join(x.value for x in _trim(t) if x.type != "comment")


def parse_rules(css: str) -> list[dict]:
    """Flat rules in source order: rule_id, parent_rule_id (0: top), kind, name, prelude, declarations (source), ord."""
    out: list[dict] = []

    def rules(t: list[Token], parent: int, top: bool) -> list[Token]:
        k, loose, ord_ = 0, [], 0
        while k < len(t):
            x = t[k]
            if x.type in ("whitespace", "comment", "semicolon") or top and x.type in ("CDO", "CDC"):
                if loose and x.type == "semicolon":
                    loose.append(x)
                k += 1
                continue
            start = k
            name = x.name if x.type == "at-keyword" else None
            while k < len(t) and t[k].type not in ("left-curly-bracket", "semicolon"):
                k = _block_end(t, k) if t[k].type in _OPEN else k + 1
            block = k < len(t) and t[k].type == "left-curly-bracket"
            if not block and name is None:
                if not top:
                    loose += t[start:k]
                continue
            me = {"rule_id": len(out) + 1, "parent_rule_id": parent, "kind": "qualified-rule" if name is None else "at-rule", "name": name, "prelude": _source(t[start + (name is not None) : k]), "declarations": None, "ord": ord_}
            out.append(me)
            ord_ += 1
            if block:
                end = _block_end(t, k)
                body = t[k + 1 : end - 1 if end <= len(t) and t[end - 1].type == "right-curly-bracket" else end]
                me["declarations"] = "".join(y.raw for y in rules(body, me["rule_id"], False)).strip()
                k = end
            elif k < len(t):
                k += 1
        return loose

    rules(tokenize(css), 0, True)
    return out


RULES = "sheet_id long, rule_id int, parent_rule_id int, kind string, name string, prelude string, declarations string, ord int"


def css_rules(df: DataFrame, id_col: str, css_col: str) -> DataFrame:
    """Flat rule table of every stylesheet; rules nest through parent_rule_id."""
    return explode_rows(df.select(F.col(id_col).cast("long"), F.col(css_col).cast("string")), RULES, lambda i, css: [] if css is None else [(i, *r.values()) for r in parse_rules(css)])


_N_UNIT = re.compile(r"n(?:(-)(\d+)?)?", re.I)


class _NotAnB(ValueError):
    """Holds the token that does not fit; "" for the end."""


def _an_b(source: str) -> tuple[int, int]:
    t = [x for x in tokenize(source.strip()) if x.type != "comment"]
    k = 0

    def now() -> Token | None:
        return t[k] if k < len(t) else None

    def space() -> None:
        nonlocal k
        while k < len(t) and t[k].type == "whitespace":
            k += 1

    def whole(signed: bool | None) -> int:
        """An integer that must (or must not) carry its own sign."""
        nonlocal k
        x = now()
        if x is None or x.type != "number" or not re.fullmatch(r"[+-]?\d+", x.raw) or signed is not None and (x.raw[0] in "+-") != signed:
            raise _NotAnB(x.value if x is not None else "")
        k += 1
        return int(x.raw)

    x, sign = now(), 1
    if x is not None and x.type == "delim" and x.value in "+-":
        k += 1
        after = now()
        if x.value == "-" or after is None or after.type != "ident":
            raise _NotAnB(x.value if x.value == "-" else after.value if after is not None else "")
        x = after
        unit = x.value
    elif x is not None and x.type == "number":
        b = whole(None)
        if now() is not None:
            raise _NotAnB(source.strip())
        return 0, b
    elif x is not None and x.type == "ident":
        sign, unit = (-1, x.value[1:]) if x.value.startswith("-") else (1, x.value)
    elif x is not None and x.type == "dimension":
        unit = x.unit
    else:
        raise _NotAnB(x.value if x is not None else "")
    a = sign
    if x.type == "dimension":
        number = x.value[: len(x.value) - len(unit)]
        if not re.fullmatch(r"-?\d+", number):
            raise _NotAnB(x.value)
        a = int(number)
    m = _N_UNIT.fullmatch(unit)
    if not m:
        raise _NotAnB(x.value)
    k += 1
    if m[2]:
        b = -int(m[2])
    elif m[1]:
        space()
        b = -whole(False)
    else:
        space()
        x = now()
        if x is None:
            b = 0
        elif x.type == "delim" and x.value in "+-":
            k += 1
            space()
            b = whole(False) * (-1 if x.value == "-" else 1)
        else:
            b = whole(True)
    if now() is not None:
        raise _NotAnB(now().value)
    return a, b


def formula(source: str) -> tuple[int, int] | str:
    """The numbers of an An+B formula, or the token that does not fit ("" for the end)."""
    word = source.strip().lower()
    if word in ("odd", "even"):
        return 2, int(word == "odd")
    try:
        return _an_b(source)
    except _NotAnB as e:
        return str(e)


def an_plus_b(source: str) -> dict:
    """Normal text of an An+B formula, or the token that does not fit."""
    found = formula(source)
    if isinstance(found, str):
        return {"value": "", "errors": [f"Syntax error. An+B. Unexpected token: {found or source.strip()}"]}
    a, b = found
    if a == 2 and b in (0, 1):
        return {"value": ("even", "odd")[b], "errors": []}
    return {"value": {1: "+n", -1: "-n"}.get(a, f"{a}n") + (f"{b:+d}" if b else ""), "errors": []}


# ---- values -----------------------------------------------------------------------------------------------------------
class _Parts:
    """A value's tokens, read one component at a time. Between components stand comments and at most one stretch of white space;
    ``loose``: any number of them; ``apart``: and one at least."""

    def __init__(self, tokens: list[Token], loose: bool = False, apart: bool = False):
        self.t, self.k, self.loose, self.apart = tokens, 0, loose, apart

    def gap(self) -> None:
        """Step over one gap."""
        spaces = 0
        while self.k < len(self.t) and _blank(self.t[self.k]):
            spaces += self.t[self.k].type == "whitespace"
            if spaces > 1 and not self.loose:
                return
            self.k += 1

    @property
    def now(self) -> Token | None:
        if not self.k or not _blank(self.t[self.k - 1]):
            self.gap()
        if self.apart and 0 < self.k < len(self.t) and not _blank(self.t[self.k - 1]):
            return None
        return self.t[self.k] if self.k < len(self.t) else None

    def take(self, kind: str, value: str | None = None) -> Token | None:
        x = self.now
        if x is not None and x.type == kind and (value is None or x.value == value):
            self.k += 1
            return x
        return None

    def word(self, among) -> str | None:
        x = self.now
        if x is not None and x.type == "ident" and x.value.lower() in among:
            self.k += 1
            return x.value.lower()
        return None

    @property
    def done(self) -> bool:
        return all(map(_blank, self.t[self.k :]))


def _number(x: Token) -> float:
    return float(re.match(r"[+-]?[\d.]+(?:e[+-]?\d+)?", x.value)[0])


def dimension(p: _Parts, units=LENGTH_UNITS, zero: bool = True, percent: bool = False, number: bool = False, low: float | None = None) -> str | None:
    x = p.now
    if x is None or x.type not in ("dimension", "percentage", "number") or low is not None and _number(x) < low:
        return None
    if x.type == "dimension":
        unit = x.unit.lower()
        if unit not in units:
            return None
        text = x.value[: len(x.value) - len(x.unit)] + ("Q" if unit == "q" else unit)
    elif x.type == "percentage":
        text = x.value if percent else None
    else:
        text = x.value if number or zero and x.value == "0" else None
    if text is not None:
        p.k += 1
    return text


def integer(p: _Parts) -> str | None:
    x = p.now
    if x is None or x.type != "number" or not re.fullmatch(r"-?\d+", x.value) or not -(1 << 63) <= int(x.value) < 1 << 63:
        return None
    p.k += 1
    return x.value


#: Kinds that the three components of a colour function may have, beside "none"; in lists with commas where those are allowed.
_COMPONENTS: dict[str, tuple[tuple[str, ...], ...]] = {
    "rgb": (("number", "percentage"),) * 3, "hsl": (("number", "dimension"), ("percentage",), ("percentage",)),
    "lab": (("number", "percentage"),) * 3, "lch": (("number", "percentage"), ("number", "percentage"), ("number", "dimension")),
}
_COLOR_FUNCTIONS = {"rgb": "rgb", "rgba": "rgb", "hsl": "hsl", "hsla": "hsl", "hwb": "hsl", "lab": "lab", "oklab": "lab", "lch": "lch", "oklch": "lch"}


def color(p: _Parts) -> str | None:
    x = p.now
    if x is None:
        return None
    if x.type == "hash" and re.fullmatch(r"[0-9A-Fa-f]{3,4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8}", x.name):
        p.k += 1
        return x.value.lower()
    if x.type == "ident":
        w = p.word(COLORS)
        return SYSTEM_COLORS.get(w, w) if w else None
    if x.type != "function" or (family := _COLOR_FUNCTIONS.get(name := x.name.lower())) is None:
        return None
    p.k += 1

    def one(allowed: tuple[str, ...], none: bool) -> tuple[str, str] | None:
        y = p.now
        if none and p.word(("none",)):
            return "none", "none"
        if y is None or y.type not in allowed:
            return None
        text = dimension(p, ANGLE_UNITS if "dimension" in allowed else (), percent="percentage" in allowed, number=True)
        return None if text is None else (y.type, text)

    got: list[tuple[str, str]] = []
    commas = False
    for k, allowed in enumerate(_COMPONENTS[family]):
        if k == 1:
            commas = family in ("rgb", "hsl") and p.take("comma") is not None
        elif k and commas and not p.take("comma"):
            return None
        if commas and family == "rgb":
            allowed = (got[0][0],)  # all numbers or all percentages
        part = one(allowed, not commas)
        if part is None:
            return None
        got.append(part)
    kinds = [kind for kind, _ in got]
    if commas and kinds[0] == "none" or family == "rgb" and not commas and not _alike(kinds):
        return None
    alpha = ""
    if not p.take("right-parenthesis"):
        cut = p.take("comma") if commas else p.take("delim", "/")
        if cut is None and (commas or family != "hsl"):  # of these functions hue ones do without the slash
            return None
        part = one(("number", "percentage"), not commas)
        if part is None or not p.take("right-parenthesis"):
            return None
        alpha = (", " if commas else " / ") + part[1]
    return f"{name}({(', ' if commas else ' ').join(text for _, text in got)}{alpha})"


def _alike(kinds: list[str]) -> bool:
    """Numbers and percentages are not mixed; "none" goes with either."""
    return len({*kinds} - {"none"}) < 2


def _whole(fn: Callable[[_Parts], str | None]) -> Callable[[_Parts], str | None]:
    """A CSS-wide keyword alone, or what fn reads, to the end."""

    def grammar(p: _Parts) -> str | None:
        if (w := p.word(WIDE)) and p.done:
            return w
        p.k = 0
        out = fn(p)
        return out if out is not None and p.done else None

    return grammar


def _first(*options: Callable[[_Parts], str | None]) -> Callable[[_Parts], str | None]:
    def grammar(p: _Parts) -> str | None:
        for option in options:
            at = p.k
            if (out := option(p)) is not None:
                return out
            p.k = at
        return None

    return grammar


def _words(words) -> Callable[[_Parts], str | None]:
    words = frozenset(words.split() if isinstance(words, str) else words)
    return lambda p: p.word(words)


def _dim(**options) -> Callable[[_Parts], str | None]:
    return lambda p: dimension(p, **options)


def _any_order(*slots: Callable[[_Parts], str | None], least: int = 1) -> Callable[[_Parts], str | None]:
    """Each slot once at most, in any order; written in the order given."""

    def grammar(p: _Parts) -> str | None:
        got: list[str | None] = [None] * len(slots)
        while not p.done:
            for k, slot in enumerate(slots):
                at = p.k
                if got[k] is None and (out := slot(p)) is not None:
                    got[k] = out
                    break
                p.k = at
            else:
                return None
        found = [g for g in got if g is not None]
        return " ".join(found) if len(found) >= least else None

    return grammar


def _boxes(most: int, auto: bool) -> Callable[[_Parts], str | None]:
    words = WIDE | {"auto"} if auto else WIDE

    def grammar(p: _Parts) -> str | None:
        out: list[str] = []
        first = p.now
        if first is None or _blank(first):
            return None
        p.loose = p.apart = True  # strict in front of the first component only
        while not p.done and len(out) < most:
            raw = p.now
            if p.word(words) is None and (raw is None or dimension(p, percent=True) is None):
                return None
            out.append(raw.value)
        return " ".join(out) if out and p.done else None

    return grammar


def _flex(p: _Parts) -> str | None:
    p.t = [x for k, x in enumerate(p.t) if not all(map(_blank, p.t[: k + 1]))]
    p.loose = p.apart = True
    if w := p.word(WIDE | {"none"}):
        return w if p.done else None
    number = _dim(zero=False, number=True, units=())
    basis = _first(_words(BASIS), _dim(percent=True))
    shares: list[str] = []
    lead = None
    if p.now is not None and p.now.type != "number":
        if (lead := basis(p)) is None:
            return None
    while len(shares) < 2 and not p.done and (share := number(p)) is not None:
        shares.append(share)
    if lead is None and not p.done:
        lead = basis(p)
        if lead is None:  # a third number: the first is the basis after all
            if len(shares) < 2 or (share := number(p)) is None:
                return None
            lead, shares = shares[0], [shares[1], share]
    return " ".join([*shares, *([lead] if lead is not None else [])]) if p.done else None


def _flow(p: _Parts) -> str | None:
    direction, wrap = _words(KEYWORDS["flex-direction"]), _words(KEYWORDS["flex-wrap"])
    if p.now is None or p.now.type != "ident":
        return None
    p.loose = p.apart = True
    if first := p.word(WIDE):
        second = wrap(p)
        return (first if second is None else f"{first} {second}") if p.done else None
    return _any_order(direction, wrap)(p)


def _float(p: _Parts) -> str | None:
    x = p.now
    if x is None or x.type != "function":
        return p.word(FLOATS)
    name = x.name.lower()
    sides = {"snap-block": "end near start", "snap-inline": "left near right"}.get(name)
    if sides is None:
        return None
    p.k += 1
    p.loose = True
    length = dimension(p)
    side = p.word(sides.split()) if p.take("comma") else ""
    if length is None or side is None or not p.take("right-parenthesis"):
        return None
    return f"{name}({length}{', ' + side if side else ''})"


def _vertical(p: _Parts) -> str | None:
    """A kind, an alignment and a shift in any order; a kind lets alignment and shift be given again."""
    kind = alignment = shift = None
    seen: set[str] = set()
    while not p.done:
        if (w := p.word(ALIGNMENT)) is not None:
            alignment, what = w, "alignment"
        elif (w := _baseline(p)) is not None:
            shift, what = w, "shift"
        elif (w := p.word(WIDE | {"first", "last"})) is not None:
            kind, what = w, "kind"
        else:
            return None
        if what in seen:
            return None
        seen = {"kind"} if what == "kind" else seen | {what}
    return " ".join(w for w in (kind, alignment, shift) if w) or None


def _lines(p: _Parts) -> str | None:
    if p.word(("none",)):
        return "none"
    out: list[str] = []
    while w := p.word(DECORATION_LINES):
        if w in out:
            return None
        out.append(w)
    order = ("underline", "overline", "line-through", "blink")
    return " ".join(w for w in order if w in out) or None


def _combine(p: _Parts) -> str | None:
    w = p.word(("none", "all", "digits"))
    if w == "digits" and not p.done:
        n = integer(p)
        return f"digits {n}" if n in ("2", "4") else None
    return w


def _weight(p: _Parts) -> str | None:
    x = p.now
    if x is not None and x.type == "number" and 1 <= _number(x) <= 1000:
        p.k += 1
        return x.value
    return p.word(("bold", "bolder", "lighter", "normal"))


def _style(p: _Parts) -> str | None:
    w = p.word(("normal", "italic", "oblique"))
    if w == "oblique" and not p.done:
        x = p.now
        angle = dimension(p, ANGLE_UNITS, zero=False)
        return f"oblique {angle}" if angle is not None and -90 <= _number(x) <= 90 else None
    return w


#: Words that are written in small letters as families too: those of any property, and a few names of value kinds.
KNOWN_WORDS = frozenset(
    "_angle _integer _length _number _percentage all allow-end bold bolder capitalize color content each-line end first force-end full-size-kana full-width hanging hex hsl hsla hwb italic lab last lch lighter lowercase near normal oblique oklab oklch rgb rgba space-around start uppercase".split()
).union(*(words.split() for words in KEYWORDS.values()), WIDE, COLORS, SHIFT, ALIGNMENT, FLOATS - {"snap-inline"}, BORDER_WIDTHS, BORDER_STYLES, SIZES, BASIS, STRETCH, FONT_SIZES, DECORATION_LINES, DECORATION_STYLES, DISPLAY_SINGLE, GENERIC_FAMILIES)
#: Bytes that a family may hold without quotes, Latin-1 letters among them.
_BARE = frozenset([0x2D, *range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), 0xB7, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0xFF)])
_CONTROL = re.compile(r"[\n\t\r](?=([0-9A-Fa-f])?)")


def _family(p: _Parts) -> str | None:
    out = []
    while True:
        x = p.now
        if x is None or x.type not in ("ident", "string"):
            return None
        p.k += 1
        known = x.name.lower()
        if x.type == "ident" and known in KNOWN_WORDS:
            out.append(SYSTEM_COLORS.get(known, known))
        elif _BARE.issuperset(x.name.encode("utf-8", "surrogatepass")):
            out.append(x.name)
        else:
            out.append(_CONTROL.sub(lambda m: f"\\{ord(m[0]):02x}" + (" " if m[1] else ""), _quoted(x.name)))
        if p.now is None:
            return ", ".join(out)
        if not p.take("comma"):
            return None


def _display(p: _Parts) -> str | None:
    words = []
    if p.now is None or p.now.type != "ident":
        return None
    p.loose = True
    while not p.done:
        x = p.take("ident")
        if x is None:
            return None
        words.append(x.value.lower())
    if len(words) == 1:
        return words[0] if words[0] in DISPLAY_SINGLE else None
    outer = [w for w in words if w in ("block", "inline", "run-in")]
    inner = [w for w in words if w in ("flow", "flow-root", "table", "flex", "grid", "ruby")]
    item = [w for w in words if w == "list-item"]
    if len(outer) + len(inner) + len(item) != len(words) or max(map(len, (outer, inner, item))) > 1 or item and inner and inner[0] not in ("flow", "flow-root"):
        return None
    return " ".join(words)


def _decoration(p: _Parts) -> str | None:
    def lines(p: _Parts) -> str | None:
        if (out := _lines(p)) is not None:
            p.gap(), p.gap()
        return out

    return _any_order(lines, _words(DECORATION_STYLES), color)(p)


_length = _dim(percent=True)
_size_value = _dim(percent=True, low=0)
_border = _any_order(_first(_words(BORDER_WIDTHS), _dim(number=True)), _words(BORDER_STYLES), color)
_baseline = _first(_words(SHIFT), _length)
GRAMMARS: dict[str, Callable[[_Parts], str | None]] = {k: _whole(_words(v)) for k, v in KEYWORDS.items()}
for _names, _grammar in (
    ("width height min-width min-height", _whole(_first(_words(SIZES), _size_value))), ("max-width max-height", _whole(_first(_words(MAX_SIZES), _size_value))),
    ("margin", _boxes(4, True)), ("padding", _boxes(4, False)), ("margin-top margin-right margin-bottom margin-left", _boxes(1, True)),
    ("padding-top padding-right padding-bottom padding-left", _boxes(1, False)),
    ("top right bottom left inset-block-start inset-block-end inset-inline-start inset-inline-end", _boxes(1, True)),
    ("flex", _flex), ("flex-flow", _flow), ("flex-basis", _whole(_first(_words(BASIS), _length))), ("flex-grow flex-shrink", _whole(_dim(zero=False, number=True, low=0, units=()))),
    ("float", _whole(_float)), ("float-defer", _whole(_first(_words("last none"), integer))), ("float-offset", _whole(_length)),
    ("border border-top border-right border-bottom border-left", _whole(_border)),
    ("color background-color border-top-color border-right-color border-bottom-color border-left-color text-decoration-color", _whole(color)),
    ("vertical-align", _vertical), ("baseline-shift", _whole(_baseline)),
    ("text-decoration", _whole(_decoration)), ("text-decoration-line", _whole(_lines)), ("text-decoration-style", _whole(_words(DECORATION_STYLES))),
    ("text-transform", _whole(_first(lambda p: p.word(("none",)), _any_order(_words("capitalize lowercase uppercase"), _words("full-width"), _words("full-size-kana"))))),
    ("text-combine-upright", _whole(_combine)),
    ("text-indent", _whole(lambda p: (lambda v: v if v and re.match(r"[-\d.]", v) else None)(_any_order(_length, _words("hanging"), _words("each-line"))(p)))),
    ("hanging-punctuation", _whole(_first(lambda p: p.word(("none",)), _any_order(_words("first"), _words("force-end allow-end"), _words("last"))))),
    ("opacity", _whole(_dim(number=True, percent=True, units=()))), ("line-height", _whole(_first(_words("normal"), _dim(number=True, percent=True)))),
    ("tab-size", _whole(_dim(number=True))), ("letter-spacing word-spacing", _whole(_first(_words("normal"), _dim()))),
    ("order", _whole(integer)), ("z-index", _whole(_first(_words("auto"), integer))),
    ("font-weight", _whole(_weight)), ("font-stretch", _whole(_first(_words(STRETCH), _dim(units=(), zero=False, percent=True, low=0)))),
    ("font-style", _whole(_style)), ("font-size", _whole(_first(_words(FONT_SIZES), _size_value))), ("font-family", _family), ("display", _display),
):
    GRAMMARS |= dict.fromkeys(_names.split(), _grammar)


def declaration_value(name: str, tokens: list[Token]) -> str | None:
    """Canonical value of a known property; None if the value does not fit its grammar."""
    return GRAMMARS[name](_Parts(tokens))


def parse_declarations(css: str) -> list[dict]:
    """Every declaration of a list: property, custom (unknown name) or undef (no colon, or a value that does not fit)."""
    tokens, out, k = tokenize(css), [], 0
    while k < len(tokens):
        if _blank(tokens[k]) or tokens[k].type == "semicolon":
            k += 1
            continue
        start = k
        while k < len(tokens) and tokens[k].type != "semicolon":
            k = _block_end(tokens, k) if tokens[k].type in _OPEN else k + 1
        part = tokens[start:k]
        colon = next((i for i, t in enumerate(part[1:], 1) if not _blank(t)), 0)
        if part[0].type != "ident" or not colon or part[colon].type != "colon":
            out.append({"type": "undef", "name": "", "value": _text(part), "important": False})
            continue
        first = next((i for i, t in enumerate(part[colon + 1 :], colon + 1) if not _blank(t)), len(part))
        lead, value, important = part[colon + 1 : first], part[first:], False
        kept = _trim(value)
        if len(kept) >= 2 and kept[-1].type == "ident" and kept[-1].value.lower() == "important" and kept[-2].type == "delim" and kept[-2].value == "!":
            value, important = kept[:-2], True
            while value and _blank(value[-1]):
                value = value[:-1]
        name = part[0].value
        if name.lower() not in GRAMMARS:
            kind, text = "custom", _text(value)
        else:
            canonical = declaration_value(name.lower(), lead + value)
            kind, text = ("undef", _text(value)) if canonical is None else ("property", canonical)
        out.append({"type": kind, "name": name, "value": text, "important": important})
    return out


css_tokens = scalar(lambda css, ranges=False: [{"type": t.type, "value": t.value, "length": t.length} for t in tokenize(css, bool(ranges))], TOKENS)
css_declarations = scalar(parse_declarations, DECLARATIONS)
css_an_plus_b = scalar(an_plus_b, "struct<value:string,errors:array<string>>")


def token_rows(df: DataFrame, id_col: str, css_col: str) -> DataFrame:
    """One row a token, in order."""
    return df.select(F.col(id_col), F.posexplode(css_tokens(F.col(css_col))).alias("ord", "t")).select(id_col, "ord", "t.*")


def declared(col: Column, name: str) -> Column:
    """The last valid value of a property in a declaration list."""
    return F.element_at(F.filter(col, lambda d: (d["name"] == name) & (d["type"] == "property")), -1)["value"]
