"""CSS selectors: text to a checked tree, normalised text, and specificity. Runs on the driver, once a query."""

from __future__ import annotations

from dataclasses import dataclass, field

from weftmark.functions.css import Token, _block_end, an_plus_b, formula, tokenize

# ---- fixed values -------------------------------------------------------------------------------------------------
SIMPLE_PSEUDOS = frozenset(
    "active any-link blank checked disabled empty enabled first-child first-of-type focus hover last-child last-of-type link only-child only-of-type optional placeholder-shown read-only read-write required root".split()
)
UNSUPPORTED_PSEUDOS = frozenset(
    "current default focus-visible focus-within fullscreen future in-range indeterminate invalid local-link out-of-range past scope target target-within user-invalid valid visited warning".split()
)
UNSUPPORTED_FUNCTIONS = frozenset("dir lang nth-col nth-last-col".split())
UNSUPPORTED_ELEMENTS = frozenset("after backdrop before first-letter first-line grammar-error inactive-selection marker placeholder selection spelling-error target-text".split())
NTH = frozenset("nth-child nth-last-child nth-of-type nth-last-of-type".split())
LISTS = frozenset("not is where has current".split())
FOLDED_ATTRIBUTES = frozenset(
    "accept accept-charset align alink axis bgcolor charset checked clear codetype color compact declare defer dir direction disabled enctype face frame hreflang http-equiv lang language link media method multiple nohref noresize noshade nowrap readonly rel rev rules scope scrolling selected shape target text type valign valuetype vlink".split()
)
# ---------------------------------------------------------------------------------------------------------------------


class SelectorError(ValueError):
    """Holds what is wrong with a selector, in order."""

    def __init__(self, *messages: str):
        super().__init__("; ".join(messages))
        self.messages = list(messages)


@dataclass(frozen=True)
class Attribute:
    name: str
    op: str | None = None
    value: str = ""
    flag: str = ""


@dataclass(frozen=True)
class Pseudo:
    name: str
    a: int = 0
    b: int = 0
    inner: tuple["Complex", ...] | None = None
    text: str = ""
    flag: str = ""
    vendor: str = ""  # the name under which a contains extension was called


@dataclass(frozen=True)
class Compound:
    tag: str | None = None
    ids: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    attributes: tuple[Attribute, ...] = ()
    pseudos: tuple[Pseudo, ...] = ()
    never: bool = False  # namespaced names match nothing
    text: str = ""  # normalised, in the order in which it was written


@dataclass(frozen=True)
class Complex:
    parts: tuple[Compound, ...]
    combinators: tuple[str, ...] = ()
    relative: str = ""


@dataclass
class Parsed:
    value: str = ""
    errors: list[str] = field(default_factory=list)
    selectors: tuple[Complex, ...] = ()


_LIST_FUNCTIONS = {"is": True, "where": True, "has": True, "not": False, "current": False}  # name: whether bad branches are skipped
_EOF_FUNCTION = "Syntax error. Selectors. End Of File in pseudo function"
_EOF_ATTRIBUTE = "Syntax error. Selectors. End Of File in attribute selector"
_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _unexpected(token: Token | str | None) -> str:
    return f"Syntax error. Selectors. Unexpected token: {token.value if isinstance(token, Token) else token or 'END-OF-FILE'}"


def _unsupported(name: str) -> str:
    return f"Syntax error. Selectors. Not supported: {name}"


def _empty(name: str) -> str:
    return f"Syntax error. Selectors. Pseudo function can't be empty: {name}()"


def _stripped(t: list[Token]) -> list[Token]:
    a, b = 0, len(t)
    while a < b and t[a].type == "whitespace":
        a += 1
    while a < b and t[b - 1].type == "whitespace":
        b -= 1
    return t[a:b]


def _branches(t: list[Token]) -> list[list[Token]]:
    """A list's branches, at commas outside blocks."""
    out: list[list[Token]] = []
    start = k = 0
    while k < len(t):
        if t[k].type == "comma":
            out.append(_stripped(t[start:k]))
            start = k + 1
        k = _block_end(t, k) if t[k].type in ("function", "left-parenthesis", "left-square-bracket", "left-curly-bracket") else k + 1
    return [*out, _stripped(t[start:])]


def _open_end(t: list[Token]) -> bool:
    """Whether a branch ends with a combinator, outside blocks."""
    k = last = 0
    while k < len(t):
        last, k = k, _block_end(t, k) if t[k].type in ("function", "left-parenthesis", "left-square-bracket", "left-curly-bracket") else k + 1
    if last < len(t) - 1 or t[last].type != "delim":
        return False
    return t[last].value in (">", "+", "~") or t[last].value == "|" and len(t) > 1 and t[last - 1].value == "|"


class _Reader:
    """One branch's tokens. ``errors``: what was wrong with branches that were skipped inside it."""

    def __init__(self, tokens: list[Token]):
        self.t, self.k, self.errors = tokens, 0, []

    def fail(self, *messages: str):
        raise SelectorError(*self.errors, *(messages or (_unexpected(self.now),)))

    @property
    def now(self) -> Token | None:
        return self.t[self.k] if self.k < len(self.t) else None

    def at(self, kind: str, value: str | None = None, ahead: int = 0) -> bool:
        x = self.t[self.k + ahead] if self.k + ahead < len(self.t) else None
        return x is not None and x.type == kind and (value is None or x.value == value)

    def take(self, kind: str, value: str | None = None) -> Token | None:
        if self.at(kind, value):
            self.k += 1
            return self.t[self.k - 1]
        return None

    def space(self) -> bool:
        before = self.k
        while self.at("whitespace"):
            self.k += 1
        return self.k > before

    def combinator(self) -> str:
        if self.at("delim", "|") and self.at("delim", "|", 1):
            self.k += 2
            return "||"
        return next((c for c in ">+~" if self.take("delim", c)), "")

    def column(self) -> bool:
        return self.at("delim", "|") and self.at("delim", "|", 1)

    def name_at(self, ahead: int) -> bool:
        return self.at("ident", None, ahead) or self.at("delim", "*", ahead)


def _complex(r: _Reader, relative: bool) -> Complex:
    lead = ""
    if relative:
        lead = r.combinator() or " "
        r.space()
    parts, between = [_compound(r)], []
    while True:
        gap = r.space()
        if r.now is None:
            break
        comb = r.combinator()
        if not comb and not gap:
            r.fail()
        r.space()
        between.append(comb or " ")
        parts.append(_compound(r))
    return Complex(tuple(parts), tuple(between), lead)


def _type(r: _Reader) -> tuple[str | None, str, bool]:
    """Tag (None for any), its text, and whether a namespace was named."""
    text, never = "", False
    if r.name_at(0) and r.at("delim", "|", 1) and r.name_at(2) or r.at("delim", "|") and r.name_at(1):
        if not r.at("delim", "|"):
            text = r.now.value
            r.k += 1
        r.k += 1
        text, never = text + "|", True
    if not r.name_at(0):
        return None, "", False
    name = r.now.value
    r.k += 1
    return None if name == "*" else name.translate(_ASCII), text + name, never


def _simple(r: _Reader) -> tuple[str, object, str] | None:
    """Kind, content and text of one simple selector that is no type; None if there is none."""
    if x := r.take("hash"):
        return "id", x.name, x.value
    if r.take("delim", "."):
        x = r.take("ident") or r.fail()
        return "class", x.value, "." + x.value
    if r.take("left-square-bracket"):
        a = _attribute(r)
        return "attribute", a[0], a[1]
    if r.take("colon"):
        p = _pseudo(r)
        return "pseudo", p, _pseudo_text(p)
    return None


def _compound(r: _Reader, most: int | None = None) -> Compound:
    tag, text, never = _type(r)
    any_type = bool(text)
    found: dict[str, list] = {"id": [], "class": [], "attribute": [], "pseudo": []}
    n = int(any_type)
    while (most is None or n < most) and (one := _simple(r)) is not None:
        found[one[0]].append(one[1])
        text += one[2]
        n += 1
    if not n:
        r.fail()
    return Compound(tag, tuple(found["id"]), tuple(found["class"]), tuple(found["attribute"]), tuple(found["pseudo"]), never, text)


def _attribute(r: _Reader) -> tuple[Attribute, str]:
    r.space()
    prefix = ""
    if r.name_at(0) and r.at("delim", "|", 1) and r.at("ident", None, 2):
        prefix = r.now.value + "|"
        r.k += 2
    elif r.at("delim", "|") and r.at("ident", None, 1):
        prefix = "|"
        r.k += 1
    shown = (r.take("ident") or r.fail()).value
    name, shown = shown.translate(_ASCII), prefix + shown
    r.space()
    if not _closes_attribute(r):
        op = ""
        for c in "~|^$*":
            if r.take("delim", c):
                op = c
                break
        if not r.take("delim", "="):
            r.fail()
        r.space()
        value = r.take("ident") or r.take("string") or r.fail()
        r.space()
        flag = ""
        if not _closes_attribute(r):
            if r.at("ident") and r.now.value.lower() in ("i", "s"):
                flag = r.now.value.lower()
                r.k += 1
                r.space()
            if not flag or not _closes_attribute(r):
                r.fail()
        inner = value.name.replace('"', "\\000022")
        return Attribute(name, op + "=", value.name, flag), f'[{shown}{op}="{inner}"{flag}]'
    return Attribute(name), f"[{shown}]"


def _closes_attribute(r: _Reader) -> bool:
    if r.now is None:
        r.errors.append(_EOF_ATTRIBUTE)
        return True
    return r.take("right-square-bracket") is not None


def _pseudo(r: _Reader) -> Pseudo:
    if r.at("colon"):
        if not r.at("ident", None, 1):
            r.fail()
        name = r.t[r.k + 1].value
        r.fail(*([_unsupported(name)] if name.lower() in UNSUPPORTED_ELEMENTS else []), _unexpected(name))
    if x := r.take("ident"):
        name = x.value.lower()
        if name not in SIMPLE_PSEUDOS:
            r.fail(*([_unsupported(x.value)] if name in UNSUPPORTED_PSEUDOS else []), _unexpected(x))
        return Pseudo(name)
    if not r.at("function"):
        r.fail()
    x, start = r.now, r.k + 1
    name = x.name.lower()
    r.k = _block_end(r.t, r.k)
    closed = r.k > start and r.t[r.k - 1].type == "right-parenthesis" and _closed(r.t, start - 1, r.k)
    body = _stripped(r.t[start : r.k - closed])
    eof = [] if closed else [_EOF_FUNCTION]
    if name in NTH:
        return _nth(r, name, body, eof)
    if name.endswith("-contains") or name == "contains":
        return _contains(r, x.name, body, eof)
    if name not in _LIST_FUNCTIONS:
        r.fail(*([_unsupported(x.name)] if name in UNSUPPORTED_FUNCTIONS else []), _unexpected(x))
    if not body:
        r.fail(*([] if closed else [_unexpected(None)]), *eof, _empty(name))
    try:
        inner, errors = _list(body, name == "has", _LIST_FUNCTIONS[name])
    except SelectorError as e:
        r.fail(*e.messages, *eof, _empty(name))
    r.errors += [*errors, *eof]
    if not inner:
        r.fail(_empty(name))
    return Pseudo(name, inner=inner)


def _closed(t: list[Token], start: int, end: int) -> bool:
    """Whether the block from ``start`` to ``end`` ends by its own bracket."""
    return end < len(t) or _block_end([*t, Token("end", "", 0)], start) == end


def _nth(r: _Reader, name: str, body: list[Token], eof: list[str]) -> Pseudo:
    cut = next((k for k, x in enumerate(body) if x.type == "ident" and x.value.lower() == "of"), len(body))
    source = "".join(x.raw for x in body[:cut])
    ab = formula(source)
    if not isinstance(ab, tuple):
        r.fail(*([_unexpected(ab)] if ab else []), *eof, _empty(name))
    inner = None
    if cut < len(body):
        rest = _stripped(body[cut + 1 :])
        if not rest:
            r.fail(*eof, _empty(name))
        try:
            inner, errors = _list(rest, False, False)
        except SelectorError as e:
            r.fail(*e.messages, *eof, _empty(name))
        r.errors += errors
    r.errors += eof
    return Pseudo(name, *ab, inner, an_plus_b(source)["value"])


def _contains(r: _Reader, vendor: str, body: list[Token], eof: list[str]) -> Pseudo:
    inner = _Reader(body)
    what = inner.take("string") or inner.take("ident")
    flag = ""
    if what is not None:
        inner.space()
        if inner.at("ident") and inner.now.value.lower() == "i":
            flag = "i"
            inner.k += 1
            inner.space()
    if what is None or inner.now is not None:
        r.fail(_unexpected(inner.now), *eof)
    r.errors += eof
    return Pseudo("contains", text=what.name, flag=flag, vendor=vendor)


def _list(t: list[Token], relative: bool = False, forgiving: bool = False) -> tuple[tuple[Complex, ...], list[str]]:
    """The branches and what was skipped. Strict lists fail at their first bad branch; an empty one has no message of its own."""
    out, errors = [], []
    branches = _branches(t)
    for k, part in enumerate(branches):
        r = _Reader(part)
        try:
            if not part and not forgiving:
                raise SelectorError
            if part:
                out.append(_complex(r, relative))
                errors += r.errors
            elif k < len(branches) - 1:
                errors.append(_unexpected(","))
        except SelectorError as e:
            if not forgiving:
                raise
            errors += e.messages
    return tuple(out), errors


# ---- normalised text ----------------------------------------------------------------------------------------------------
def _pseudo_text(p: Pseudo) -> str:
    if p.name in NTH:
        of = f" of {list_text(p.inner)}" if p.inner is not None else ""
        return f":{p.name}({p.text}{of})"
    if p.name == "contains":
        return f':{p.vendor}("{p.text}"{" " + p.flag if p.flag else ""})'
    if p.name == "current":
        return ":current()"
    return f":{p.name}" + (f"({list_text(p.inner)})" if p.inner is not None else "")


def complex_text(c: Complex) -> str:
    out = c.relative.strip() + " " if c.relative.strip() else ""
    out += c.parts[0].text
    for comb, part in zip(c.combinators, c.parts[1:]):
        out += (" " if comb == " " else f" {comb} ") + part.text
    return out


def list_text(selectors: tuple[Complex, ...]) -> str:
    return ", ".join(map(complex_text, selectors))


#: Entry: (relative, what a branch may be, whether it is a list)
_SHAPES = {
    "parse": (False, "complex", True), "complex_list": (False, "complex", True), "relative_list": (True, "complex", True), "compound_list": (False, "compound", True), "simple_list": (False, "simple", True),
    "complex": (False, "complex", False), "compound": (False, "compound", False), "simple": (False, "simple", False), "relative": (True, "compound", False),
}


def _branch(part: list[Token], relative: bool, shape: str) -> tuple[Complex, list[str]]:
    r = _Reader(part)
    if shape == "complex":
        found = _complex(r, relative)
    else:
        lead = (r.combinator() or " ") if relative else ""
        r.space()
        found = Complex((_compound(r, 1 if shape == "simple" else None),), (), lead)
        r.space()
        if r.now is not None:
            r.fail()
    return found, r.errors


def parse(text: str, kind: str = "parse") -> Parsed:
    """Read a selector (list). ``errors`` says what is wrong; where a part could be left out or an end be added, ``value`` and
    ``selectors`` hold the rest, else they are empty. ``kind`` names the grammar's entry."""
    relative, shape, many = _SHAPES[kind]
    tokens = _stripped([x for x in tokenize(text) if x.type != "comment"])
    out, errors = [], []
    try:
        branches = _branches(tokens) if many else [tokens]
        for k, part in enumerate(branches):
            if not part or len(part) > 1 and _open_end(part):
                raise SelectorError(_unexpected("," if k < len(branches) - 1 else None))
            found, skipped = _branch(part, relative, shape)
            out.append(found)
            errors += skipped
        return Parsed(list_text(tuple(out)), errors, tuple(out))
    except SelectorError as e:
        return Parsed("", e.messages, ())


# ---- specificity ----------------------------------------------------------------------------------------------------------
def specificity(c: Complex) -> tuple[int, int, int]:
    a = b = t = 0
    for part in c.parts:
        a += len(part.ids)
        b += len(part.classes) + len(part.attributes)
        t += part.tag is not None
        for p in part.pseudos:
            if p.name == "where":
                continue
            if p.name in LISTS:
                x = max(map(specificity, p.inner), default=(0, 0, 0))
                a, b, t = a + x[0], b + x[1], t + x[2]
            else:
                b += 1
                if p.inner:
                    x = max(specificity(Complex(i.parts[:1])) for i in p.inner)
                    a, b, t = a + x[0], b + x[1], t + x[2]
    return a, b, t


def list_specificity(text: str) -> tuple[int, int, int] | None:
    """The largest over the list's branches; None for an invalid selector."""
    found = parse(text)
    return None if not found.selectors else max(map(specificity, found.selectors), default=(0, 0, 0))
