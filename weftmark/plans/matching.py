"""Selectors compiled to Catalyst plans over the node table.

Every compound, combinator and pseudo-class becomes a boolean column; what looks at other nodes
is a window inside one document. In pre-order, a node is below a marked one exactly if the largest
subtree end among earlier marked nodes reaches it, so even descendant combinators need no join.
The whole selector therefore costs one shuffle by document, which all windows share, and a
parsed page is never read twice."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.plans import selectors as S

_UP, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WS = r"[\t\n\f\r ]+"


def fold(c: Column) -> Column:
    """ASCII letters in lower case, nothing else changed."""
    return F.translate(c, _UP, _DOWN)


class Compiler:
    """Adds columns to the node table; ``mark(selector)`` returns the boolean column's name."""

    def __init__(self, nodes: DataFrame):
        # one shuffle; every window below is keyed by the document first, so none shuffles again
        self.df = nodes.repartition("doc_id").withColumn("__el", F.col("kind") == "element")
        self.names = (f"__m{k}" for k in itertools.count())
        self.cache: dict[object, str] = {}
        self.order = Window.partitionBy("doc_id", "root").orderBy("node_id")
        self.siblings = Window.partitionBy("doc_id", "root", "parent_id", "__el").orderBy("sib_ix")
        self.family = Window.partitionBy("doc_id", "root", "parent_id", "__el")

    # -- building blocks
    def put(self, c: Column) -> str:
        name = next(self.names)
        self.df = self.df.withColumn(name, F.coalesce(c, F.lit(False)))
        return name

    def attr(self, name: str) -> Column:
        return F.try_element_at(F.filter("attrs", lambda a: a["name"] == name), F.lit(1))["value"]

    def has_attr(self, name: str) -> Column:
        return F.exists("attrs", lambda a: a["name"] == name)

    def of_parent(self, mark: str) -> Column:
        """The parent's mark, on each node: parents and children meet in windows keyed by the parent's id."""
        return self._families(F.max(F.when(F.col("__role") == 0, F.col(mark))), "child")

    def of_children(self, value: Column) -> Column:
        """True where some child has ``value``."""
        mark = self.put(value)
        return self._families(F.max(F.when(F.col("__role") == 1, F.col(mark))), "parent")

    def _families(self, agg: Column, take: str) -> Column:
        roles = F.array(F.struct(F.lit(0).alias("r"), F.col("node_id").alias("f")), F.struct(F.lit(1).alias("r"), F.col("parent_id").alias("f")))
        both = self.df.withColumn("__both", F.explode(roles)).withColumns({"__role": F.col("__both.r"), "__fam": F.col("__both.f")})
        name = next(self.names)
        window = Window.partitionBy("doc_id", "root", "__fam")
        self.df = both.withColumn(name, F.coalesce(agg.over(window), F.lit(False))).where(F.col("__role") == (1 if take == "child" else 0)).drop("__both", "__role", "__fam")
        return F.col(name)

    # -- selectors
    def mark(self, c: S.Complex) -> str:
        key = ("complex", c.parts, c.combinators)
        if key not in self.cache:
            m = self.compound(c.parts[0])
            for comb, part in zip(c.combinators, c.parts[1:]):
                if comb == " ":
                    above = F.max(F.when(F.col(m), F.col("subtree_end"))).over(self.order.rowsBetween(Window.unboundedPreceding, -1))
                    here = above >= F.col("node_id")
                elif comb == ">":
                    here = self.of_parent(m)
                elif comb == "+":
                    here = F.lag(m).over(self.siblings)
                elif comb == "~":
                    here = F.max(m).over(self.siblings.rowsBetween(Window.unboundedPreceding, -1))
                else:
                    here = F.lit(False)
                near = self.put(here)
                m = self.put(F.col(near) & F.col(self.compound(part)))
            self.cache[key] = m
        return self.cache[key]

    def any_of(self, selectors) -> Column:
        out = F.lit(False)
        for c in selectors:
            out = out | F.col(self.mark(c))
        return out

    def has(self, c: S.Complex) -> Column:
        """Nodes from which the relative selector reaches something; the rest of a longer one is asked of its first compound in turn."""
        here = F.col(self.compound(c.parts[0]))
        if len(c.parts) > 1:
            here = here & self.has(S.Complex(c.parts[1:], c.combinators[1:], c.combinators[0]))
        m = self.put(here)
        if c.relative == " ":
            return F.min(F.when(F.col(m), F.col("node_id"))).over(self.order.rowsBetween(1, Window.unboundedFollowing)) <= F.col("subtree_end")
        if c.relative == ">":
            return self.of_children(F.col(m))
        if c.relative == "+":
            return F.lead(m).over(self.siblings)
        if c.relative == "~":
            return F.max(m).over(self.siblings.rowsBetween(1, Window.unboundedFollowing))
        return F.lit(False)

    def compound(self, c: S.Compound) -> str:
        if c in self.cache:
            return self.cache[c]
        quirk = F.col("quirks")
        cheap = F.col("__el")
        if c.never:
            cheap = F.lit(False)
        if c.tag is not None:
            cheap = cheap & (F.col("tag") == c.tag)
        for i in c.ids:
            v = self.attr("id")
            cheap = cheap & F.when(quirk, fold(v) == fold(F.lit(i))).otherwise(v == i)
        for k in c.classes:
            v = self.attr("class")
            cheap = cheap & F.when(quirk, F.array_contains(F.split(fold(v), WS), k.translate(S._ASCII))).otherwise(F.array_contains(F.split(v, WS), k))
        for a in c.attributes:
            cheap = cheap & self.attribute(a)
        out = cheap
        for p in c.pseudos:
            out = out & self.pseudo(p)
        self.cache[c] = self.put(out)
        return self.cache[c]

    def attribute(self, a: S.Attribute) -> Column:
        if a.op is None:
            return self.has_attr(a.name)
        v, x = self.attr(a.name), F.lit(a.value)
        if a.flag == "i" or a.flag != "s" and a.name in S.FOLDED_ATTRIBUTES:
            v, x = fold(v), F.lit(a.value.translate(S._ASCII))
        if a.op == "=":
            return v == x
        if a.op == "|=":
            return (v == x) | v.startswith(F.concat(x, F.lit("-"))) if a.value else v == x
        if not a.value:
            return F.lit(False)
        if a.op == "~=":
            return F.array_contains(F.split(v, WS), x)
        return {"^=": v.startswith(x), "$=": v.endswith(x), "*=": v.contains(x)}[a.op]

    def index(self, p: S.Pseudo) -> Column:
        """The node's number among its siblings, as the pseudo-class counts."""
        last = "last" in p.name
        keys = ["doc_id", "root", "parent_id", "__el"] + (["tag"] if p.name.endswith("of-type") else [])
        order = F.desc("sib_ix") if last else F.asc("sib_ix")
        if p.inner is not None and not p.name.endswith("of-type"):
            m = self.put(self.any_of(p.inner))
            n = F.sum(F.col(m).cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
            return F.when(F.col(m), n)
        return F.row_number().over(Window.partitionBy(*keys).orderBy(order))

    def pseudo(self, p: S.Pseudo) -> Column:
        name = p.name
        control = F.col("tag").isin("button", "input", "select", "textarea") | ~F.col("is_known")
        field = F.col("tag").isin("input", "textarea")
        if name in S.NTH:
            if p.inner is not None and name.endswith("of-type"):
                return F.lit(False)
            n = F.col(self._keep(self.index(p)))
            if p.a == 0:
                return n == p.b
            return (F.pmod(n - p.b, F.lit(abs(p.a))) == 0) & ((n >= p.b) if p.a > 0 else (n <= p.b))
        simple = {
            "first-child": ("nth-child",), "last-child": ("nth-last-child",), "only-child": ("nth-child", "nth-last-child"),
            "first-of-type": ("nth-of-type",), "last-of-type": ("nth-last-of-type",), "only-of-type": ("nth-of-type", "nth-last-of-type"),
        }
        if name in simple:
            out = F.lit(True)
            for n in simple[name]:
                out = out & self.pseudo(S.Pseudo(n, 0, 1))
            return out
        if name == "not":
            inner = p.inner
            while len(inner) == 1 and _only_not(inner[0]) and _only_not(_only_not(inner[0])[0] if len(_only_not(inner[0])) == 1 else None):
                inner = _only_not(_only_not(inner[0])[0])  # :not(:not(:not(x))) is :not(x)
            return ~self.any_of(inner)
        if name in ("is", "where", "current"):
            return self.any_of(p.inner)
        if name == "has":
            out = F.lit(False)
            for c in p.inner:
                out = out | F.col(self.put(self.has(c)))
            return out
        if name == "contains":
            text, x = F.col("data"), F.lit(p.text)
            if p.flag == "i":
                text, x = fold(text), F.lit(p.text.translate(S._ASCII))
            return self.of_children((F.col("kind") == "text") & text.contains(x))
        if name == "root":
            return (F.col("root") == "doc") & (F.col("parent_id") == 0) & (F.col("elem_ix") == 1)
        if name == "empty":
            return ~self.of_children(F.col("kind") != "comment")
        if name == "blank":
            return ~self.of_children((F.col("kind") == "element") | (F.col("kind") == "text") & (F.regexp_replace("data", WS, "") != ""))
        if name == "checked":
            box = (F.col("tag") == "input") & fold(self.attr("type")).isin("checkbox", "radio") & self.has_attr("checked")
            return F.coalesce(box, F.lit(False)) | (F.col("tag") == "option") & self.has_attr("selected") | ~F.col("is_known") & self.has_attr("checked")
        if name in ("disabled", "enabled", "read-write", "read-only"):
            first = self.put((F.col("tag") == "legend") & (F.col("sib_ix") == 1))
            legend = self.of_children(F.col(first))
            bare = self.put((F.col("tag") == "fieldset") & ~legend)
            inside = F.max(F.when(F.col(bare), F.col("subtree_end"))).over(self.order.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("node_id")
            off = F.col(self.put(self.has_attr("disabled") & (control | F.coalesce(inside, F.lit(False)))))
            if name in ("disabled", "enabled"):
                return off if name == "disabled" else ~off
            write = field & ~self.has_attr("readonly") & ~off
            return write if name == "read-write" else ~write
        if name in ("required", "optional"):
            needs = self.has_attr("required")
            return F.col("tag").isin("input", "select", "textarea") & (needs if name == "required" else ~needs)
        if name == "placeholder-shown":
            return field & self.has_attr("placeholder")
        if name in ("any-link", "link"):
            return F.col("tag").isin("a", "area", "map" if name == "any-link" else "link") & self.has_attr("href")
        return self.has_attr(name)  # active, focus, hover: an attribute of that name

    def _keep(self, c: Column) -> str:
        name = next(self.names)
        self.df = self.df.withColumn(name, c)
        return name


def _only_not(c: S.Complex | None):
    """The list inside, if the selector is nothing but one :not()."""
    if c is None or len(c.parts) > 1:
        return None
    p = c.parts[0]
    return p.pseudos[0].inner if p == S.Compound(pseudos=p.pseudos) and len(p.pseudos) == 1 and p.pseudos[0].name == "not" else None


def find(nodes: DataFrame, selector: str, root: str | None = None, match_first: bool = False) -> DataFrame:
    """The nodes that match, with ``branch_no``: one row for each matching branch of the list (the first only, with
    ``match_first``). ``root``: 'doc' or 'head' to search from there. An invalid selector finds nothing.
    Ordered output is (doc_id, node_id, branch_no)."""
    parsed = S.parse(selector)
    compiler = Compiler(nodes if root is None else nodes.where(F.col("root") == root))
    marks = [compiler.mark(c) for c in parsed.selectors]
    branches = F.filter(F.array(*[F.when(F.col(m), F.lit(k)) for k, m in enumerate(marks)] or [F.lit(None).cast("int")]), lambda b: b.isNotNull())
    if match_first:
        branches = F.slice(branches, 1, 1)
    return compiler.df.select(*nodes.columns, F.explode(branches).alias("branch_no"))


def matches(nodes: DataFrame, selector: str, name: str = "matches") -> DataFrame:
    """The node table with a boolean column: whether the node matches any branch."""
    compiler = Compiler(nodes)
    hit = compiler.any_of(S.parse(selector).selectors)
    return compiler.df.select(*nodes.columns, hit.alias(name))
