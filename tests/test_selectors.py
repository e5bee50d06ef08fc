"""Compiled plans against a naive matcher over the tree."""

import pytest

from weftmark.functions import html as H
from weftmark.operators.nodes import html_nodes
from weftmark.plans import matching
from weftmark.plans import selectors as S

HTML = """<!DOCTYPE html><title>T</title><body><div class="A b" id=one><p lang=en>first <a href="/x">x</a></p><p lang=fr>two</p><span><p>three<b></b></p></span><!--c--></div>
<main><h2>a</h2><h2 class=z>b</h2><h2></h2><h2> </h2><h2 data-x="one two">c<i>d</i></h2></main><ul><li>1<li class=b>2<li>3<ul><li>4</ul></ul>
<form><fieldset disabled><input disabled type=checkbox checked></fieldset><input required placeholder=q><textarea readonly></textarea><x-y disabled checked></x-y></form></body>"""

SELECTORS = [
    "div p", "div > p", "p + p", "p ~ span", "h2:nth-child(2n+1)", "h2:last-child", ".A, .b", "p:has(> a)", "div:has(p a)", "h2:empty", "h2:blank", "p:not([lang])", "body > div", "[lang|=en]",
    "h2 ~ h2:nth-child(2 of h2)", "span:only-of-type", "div :is(a, span p)", "p:has(+ p)", "h2:has(~ .z)", "a:any-link", "main:has(h2 + h2.z)", "li li", "ul > li:nth-last-child(-n+2)", "*", "li:first-child, li",
    "[data-x~=two]", "[data-x^=one]", "[data-x$='two']", "[data-x*='e t']", "[LANG='EN']", "[data-x='ONE TWO' i]", ":not(:not(p))", "h2:nth-of-type(3)", "li:nth-last-of-type(1)", "div:has(> span > p b)", "p:not(div > p, span p)",
]


def flat():
    doc = H.parse(HTML)
    order = []

    def walk(n):
        for k in n.kids:
            order.append(k)
            walk(k)

    walk(doc.head)
    walk(doc.root)
    return doc, {id(n): i for i, n in enumerate(order, 1)}, order


def elements(n):
    return [k for k in n.parent.kids if k.kind == "element"]


def compound(n, c):
    if n.kind != "element" or c.never or c.tag not in (None, n.tag):
        return False
    classes = (n.get("class") or "").split()
    return all(n.get("id") == i for i in c.ids) and all(k in classes for k in c.classes) and all(attribute(n, a) for a in c.attributes) and all(pseudo(n, p) for p in c.pseudos)


def attribute(n, a):
    v = n.get(a.name)
    if v is None or a.op is None:
        return v is not None
    x = a.value
    if a.flag == "i" or a.flag != "s" and a.name in S.FOLDED_ATTRIBUTES:
        v, x = v.lower(), x.lower()
    return {"=": v == x, "~=": x in v.split(), "|=": v == x or v.startswith(x + "-"), "^=": v.startswith(x), "$=": v.endswith(x), "*=": x in v}[a.op]


def pseudo(n, p):
    sibs = elements(n)
    if p.name in S.NTH:
        if "of-type" in p.name:
            sibs = [s for s in sibs if s.tag == n.tag]
        elif p.inner:
            sibs = [s for s in sibs if any(matches(s, c) for c in p.inner)]
        if "last" in p.name:
            sibs = sibs[::-1]
        at = next((k for k, s in enumerate(sibs, 1) if s is n), None)
        return at is not None and any(p.a * k + p.b == at for k in range(100))
    if p.name in ("first-child", "last-child", "only-child", "only-of-type"):
        if p.name == "only-of-type":
            return sum(s.tag == n.tag for s in sibs) == 1
        return ("first" not in p.name and "only" not in p.name or sibs[0] is n) and ("last" not in p.name and "only" not in p.name or sibs[-1] is n)
    if p.name == "not":
        return not any(matches(n, c) for c in p.inner)
    if p.name == "is":
        return any(matches(n, c) for c in p.inner)
    if p.name == "empty":
        return not [k for k in n.kids if k.kind != "comment"]
    if p.name == "blank":
        return not [k for k in n.kids if k.kind == "element" or k.kind == "text" and k.data.strip()]
    if p.name == "any-link":
        return n.tag in ("a", "area", "map") and n.get("href") is not None
    if p.name == "has":
        return any(reaches(n, c.relative, c.parts, c.combinators) for c in p.inner)
    raise NotImplementedError(p.name)


def below(n):
    for k in n.kids:
        yield k
        yield from below(k)


def reaches(n, comb, parts, rest):
    sibs = elements(n)
    at = next(k for k, s in enumerate(sibs) if s is n)
    near = {" ": list(below(n)), ">": n.kids, "+": sibs[at + 1 : at + 2], "~": sibs[at + 1 :]}[comb]
    return any(compound(x, parts[0]) and (len(parts) == 1 or reaches(x, rest[0], parts[1:], rest[1:])) for x in near if x.kind == "element")


def matches(n, c):
    if not compound(n, c.parts[-1]):
        return False
    if len(c.parts) == 1:
        return True
    left = S.Complex(c.parts[:-1], c.combinators[:-1])
    comb = c.combinators[-1]
    if comb in (" ", ">"):
        up = n.parent
        while up is not None and up.kind == "element" and up.tag != "head":
            if matches(up, left):
                return True
            if comb == ">":
                return False
            up = up.parent
        return False
    sibs = elements(n)
    at = next(k for k, s in enumerate(sibs) if s is n)
    return any(matches(s, left) for s in (sibs[max(at - 1, 0) : at] if comb == "+" else sibs[:at]))


@pytest.fixture(scope="module")
def table(spark):
    return html_nodes(spark.createDataFrame([(1, HTML)], "page_id long, html string")).cache()


def test_plans_match_a_naive_matcher(table):
    doc, ids, order = flat()
    for text in SELECTORS:
        parsed = S.parse(text)
        assert not parsed.errors, text
        want = sorted((ids[id(n)], k) for n in order for k, c in enumerate(parsed.selectors) if n.kind == "element" and matches(n, c))
        got = sorted((r.node_id, r.branch_no) for r in matching.find(table, text).select("node_id", "branch_no").collect())
        assert got == want, text


def test_matching_in_place_equals_the_plans(table):
    """Both ways of evaluation agree, form states and all."""
    from weftmark.functions.match import Tree

    rows = [r.asDict(recursive=True) for r in table.collect()]
    tree = Tree(rows, False)
    more = [":disabled", ":enabled", ":checked", ":required", ":optional", ":placeholder-shown", ":read-write", "textarea:read-only", ":root > div", "a||b", "p:nth-child(-2n+3)", ":focus", "p:where(.x, [lang])"]
    plans = matching.Compiler(table)
    marks = {t: plans.any_of(S.parse(t).selectors) for t in SELECTORS + more}
    got = {t: set() for t in marks}
    for r in plans.df.select("node_id", *[c.alias(f"c{k}") for k, c in enumerate(marks.values())]).collect():
        for k, t in enumerate(marks):
            if r[f"c{k}"]:
                got[t].add(r.node_id)
    for t in marks:
        assert {k for c in S.parse(t).selectors for k in tree.find(c)} == got[t], t


def test_form_states(table):
    def tags(s):
        return [r.tag for r in matching.find(table, s).orderBy("node_id").collect()]

    assert tags(":disabled") == ["input", "x-y"] and tags("fieldset:enabled") == ["fieldset"]  # a fieldset disables what has the attribute itself
    assert tags(":checked") == ["input", "x-y"] and tags(":required") == ["input"] and tags(":placeholder-shown") == ["input"]
    assert tags(":read-write") == ["input"] and tags("textarea:read-only") == ["textarea"] and tags(":root") == ["body"]
    assert tags("title") == ["title"] and matching.find(table, "title", root="doc").count() == 0
    assert tags(".a") == [] and tags("a||b") == [] and tags("a::before") == []


def test_match_first_and_one_shuffle(table):
    assert matching.find(table, ".A, .b, div", match_first=True).where("tag = 'div'").count() == 1
    assert matching.find(table, ".A, .b, div").where("tag = 'div'").count() == 3
    plan = matching.find(table, "div > p + p ~ span:has(b):nth-child(2n of p, span)")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize(
    "text, value, spec",
    [
        ("div  >p.a#b[ x = 'y' i ]", 'div > p.a#b[x="y"i]', (1, 2, 2)), ("a:not(.b, #c)", "a:not(.b, #c)", (1, 0, 1)), ("li:nth-child(even)", "li:nth-child(even)", (0, 1, 1)),
        (":where(#a) b", ":where(#a) b", (0, 0, 1)), ("a::after", "", None), ("p >", "", None), ("a:is(b, :bad)", "a:is(b)", (0, 0, 2)), ("a:not(:visited)", "", None), ("\\31 a", "", None),
    ],
)
def test_parse(text, value, spec):
    if text.startswith("\\"):
        assert S.parse(text).selectors[0].parts[0].tag == "1a"
        return
    assert S.parse(text).value == value and S.list_specificity(text) == spec and bool(S.parse(text).selectors) == (value != "")


def test_entry_points():
    assert S.parse("> a", "relative").value == "> a" and S.parse("a b", "compound").errors and S.parse("a.b", "simple").errors and not S.parse("a.b, c", "compound_list").errors
