"""Selectors evaluated inside one document: for tables of selectors too many to compile into a plan each."""

from __future__ import annotations

from weftmark.functions import html as H
from weftmark.plans import selectors as S


class Tree:
    """Node rows of one document, with element sibling lists and memoised answers."""

    def __init__(self, rows: list[dict], quirks: bool):
        self.quirks = quirks
        self.rows = {r["node_id"]: r for r in rows}
        self.attrs = {k: {a["name"]: a["value"] for a in r["attrs"] or ()} for k, r in self.rows.items()}
        self.kids: dict[tuple, list[int]] = {}
        for k, r in sorted(self.rows.items()):
            self.kids.setdefault((r["root"], r["parent_id"]), []).append(k)
        self.elements = {key: [k for k in ids if self.rows[k]["kind"] == "element"] for key, ids in self.kids.items()}
        self.place = {k: n for ids in self.elements.values() for n, k in enumerate(ids)}
        self.memo: dict[tuple, bool] = {}
        self.alive: dict[int, S.Complex] = {}  # what the memo's keys stand for must not be collected

    def siblings(self, k: int) -> list[int]:
        r = self.rows[k]
        return self.elements[r["root"], r["parent_id"]]

    def children(self, k: int) -> list[int]:
        return self.kids.get((self.rows[k]["root"], k), [])

    def parent(self, k: int) -> int | None:
        return self.rows[k]["parent_id"] or None

    def find(self, c: S.Complex) -> list[int]:
        return [k for k, r in sorted(self.rows.items()) if r["kind"] == "element" and self.matches(k, c, len(c.parts) - 1)]

    def matches(self, k: int, c: S.Complex, at: int | None = None) -> bool:
        at = len(c.parts) - 1 if at is None else at
        self.alive[id(c)] = c
        key = (k, id(c), at)
        if key not in self.memo:
            self.memo[key] = self.compound(k, c.parts[at]) and (at == 0 or self.before(k, c, at))
        return self.memo[key]

    def before(self, k: int, c: S.Complex, at: int) -> bool:
        comb = c.combinators[at - 1]
        if comb in (" ", ">"):
            up = self.parent(k)
            while up is not None:
                if self.matches(up, c, at - 1):
                    return True
                if comb == ">":
                    return False
                up = self.parent(up)
            return False
        if comb not in ("+", "~"):
            return False
        n = self.place[k]
        near = self.siblings(k)[max(n - 1, 0) : n] if comb == "+" else self.siblings(k)[:n]
        return any(self.matches(s, c, at - 1) for s in near)

    def compound(self, k: int, c: S.Compound) -> bool:
        r, attrs = self.rows[k], self.attrs[k]
        if c.never or c.tag is not None and r["tag"] != c.tag:
            return False
        same = (lambda s: H.lower(s)) if self.quirks else (lambda s: s)
        if c.ids and ("id" not in attrs or any(same(attrs["id"]) != same(i) for i in c.ids)):
            return False
        if c.classes:
            held = {same(x) for x in attrs.get("class", "").replace("\t", " ").replace("\n", " ").replace("\f", " ").replace("\r", " ").split(" ")}
            if any(same(x) not in held for x in c.classes):
                return False
        return all(self.attribute(attrs, a) for a in c.attributes) and all(self.pseudo(k, p) for p in c.pseudos)

    @staticmethod
    def attribute(attrs: dict[str, str], a: S.Attribute) -> bool:
        v = attrs.get(a.name)
        if v is None or a.op is None:
            return v is not None
        x = a.value
        if a.flag == "i" or a.flag != "s" and a.name in S.FOLDED_ATTRIBUTES:
            v, x = H.lower(v), H.lower(x)
        if a.op == "=":
            return v == x
        if a.op == "|=":
            return v == x or bool(x) and v.startswith(x + "-")
        return bool(x) and {"~=": x in v.split(), "^=": v.startswith(x), "$=": v.endswith(x), "*=": x in v}[a.op]

    def nth(self, k: int, p: S.Pseudo) -> bool:
        some = self.siblings(k)
        if "of-type" in p.name:
            if p.inner is not None:
                return False
            some = [s for s in some if self.rows[s]["tag"] == self.rows[k]["tag"]]
        elif p.inner is not None:
            some = [s for s in some if any(self.matches(s, c) for c in p.inner)]
        if k not in some:
            return False
        n = (len(some) - some.index(k) if "last" in p.name else some.index(k) + 1) - p.b
        return n == 0 if p.a == 0 else n % abs(p.a) == 0 and (n >= 0) == (p.a > 0) or n == 0

    def reaches(self, k: int, c: S.Complex) -> bool:
        n = self.place[k]
        later = self.siblings(k)[n + 1 :]
        r = self.rows[k]
        near = {" ": range(k + 1, r["subtree_end"] + 1), ">": self.children(k), "+": later[:1], "~": later}.get(c.relative, ())
        rest = S.Complex(c.parts[1:], c.combinators[1:], c.combinators[0]) if len(c.parts) > 1 else None
        return any(x in self.rows and self.rows[x]["kind"] == "element" and self.compound(x, c.parts[0]) and (rest is None or self.reaches(x, rest)) for x in near)

    def disabled(self, k: int) -> bool:
        r = self.rows[k]
        if "disabled" not in self.attrs[k]:
            return False
        if r["tag"] in ("button", "input", "select", "textarea") or not r["is_known"]:
            return True
        up = self.parent(k)
        while up is not None:
            if self.rows[up]["tag"] == "fieldset" and self.rows[self.children(up)[0]]["tag"] != "legend":
                return True
            up = self.parent(up)
        return False

    def pseudo(self, k: int, p: S.Pseudo) -> bool:
        r, attrs, name = self.rows[k], self.attrs[k], p.name
        tag = r["tag"]
        if name in S.NTH:
            return self.nth(k, p)
        if name.endswith(("-child", "-of-type")):
            kind = name[name.index("-") + 1 :]
            ends = {"first": ("nth-",), "last": ("nth-last-",), "only": ("nth-", "nth-last-")}[name.split("-")[0]]
            return all(self.nth(k, S.Pseudo(e + kind, 0, 1)) for e in ends)
        if name == "not":
            return not any(self.matches(k, c) for c in p.inner)
        if name in ("is", "where", "current"):
            return any(self.matches(k, c) for c in p.inner)
        if name == "has":
            return any(self.reaches(k, c) for c in p.inner)
        below = [self.rows[x] for x in self.children(k)] if name in ("contains", "empty", "blank") else []
        if name == "contains":
            fold = H.lower if p.flag == "i" else str
            return any(x["kind"] == "text" and fold(p.text) in fold(x["data"]) for x in below)
        if name == "root":
            return r["root"] == "doc" and r["parent_id"] == 0 and self.place[k] == 0
        if name == "empty":
            return all(x["kind"] == "comment" for x in below)
        if name == "blank":
            return not any(x["kind"] == "element" or x["kind"] == "text" and x["data"].strip(H.WS) for x in below)
        if name == "checked":
            if tag == "input":
                return H.lower(attrs.get("type", "")) in ("checkbox", "radio") and "checked" in attrs
            return "selected" in attrs if tag == "option" else not r["is_known"] and "checked" in attrs
        if name in ("disabled", "enabled"):
            return self.disabled(k) == (name == "disabled")
        if name in ("read-write", "read-only"):
            return (tag in ("input", "textarea") and "readonly" not in attrs and not self.disabled(k)) == (name == "read-write")
        if name in ("required", "optional"):
            return tag in ("input", "select", "textarea") and ("required" in attrs) == (name == "required")
        if name == "placeholder-shown":
            return tag in ("input", "textarea") and "placeholder" in attrs
        if name in ("any-link", "link"):
            return tag in ("a", "area", "map" if name == "any-link" else "link") and "href" in attrs
        return name in attrs


class Reader:
    """Parsed selector lists of a task, memoised with a bound."""

    def __init__(self, most: int = 20_000):
        self.most, self.held = most, {}

    def __call__(self, text: str) -> S.Parsed:
        if text not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[text] = S.parse(text)
        return self.held[text]


def branches(rows: list[dict], quirks: bool, texts: list[str], read: Reader) -> list[tuple[int, str, int, int, int]]:
    """(node_id, selector, a, b, c) of every match, with the best branch's specificity."""
    tree, best = Tree(rows, quirks), {}
    for text in texts:
        for c in read(text).selectors:
            spec = S.specificity(c)
            for k in tree.find(c):
                best[k, text] = max(spec, best.get((k, text), spec))
    return [(k, text, *spec) for (k, text), spec in best.items()]
