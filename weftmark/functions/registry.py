"""The functions for use in SQL text: ``register(spark)`` names Arrow functions and table functions in the session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftmark.functions import css, encoding, html, text, url
from weftmark.plans import selectors


def _guard(fn):
    """Null in, null out; a value that does not fit gives null, never an error."""

    def one(*values):
        if not values or values[0] is None:
            return None
        try:
            return fn(*values)
        except ValueError:
            return None

    return one


FUNCTIONS = {
    "wm_url_parse": (lambda s: url._parsed(s), url.URL), "wm_url_resolve": (lambda s, base: (lambda u: u and url.serialize(u))(url._parsed(s, base)), "string"),
    "wm_url_set": (url._set, "string"), "wm_css_declarations": (css.parse_declarations, css.DECLARATIONS),
    "wm_idna_to_ascii": (text.to_ascii, "string"), "wm_idna_to_unicode": (text.to_unicode, "string"), "wm_punycode_encode": (text.punycode_encode, "string"),
    "wm_punycode_decode": (text.punycode_decode, "string"), "wm_normalize": (lambda s, form: text.U.normalize(form, s), "string"),
    "wm_decode": (lambda data, name: (lambda n: n and encoding.decode(bytes(data), n)[0])(encoding.label_name(name)), "string"),
    "wm_sniff_encoding": (lambda data: encoding.determine(bytes(data)), "string"), "wm_serialize_html": (lambda s: html.serialize_document(html.parse(s)), "string"),
    "wm_selector_valid": (lambda s: bool(selectors.parse(s).selectors), "boolean"),
}
NODE_COLUMNS = "node_id int, parent_id int, root string, depth int, subtree_end int, sib_ix int, elem_ix int, kind string, ns string, tag string, is_known boolean, attrs array<struct<name:string,value:string>>, data string"


class HtmlNodes:
    def eval(self, source: str):
        if source is not None:
            yield from html.flatten(html.parse(source))


class CssRules:
    def eval(self, source: str):
        if source is not None:
            for r in css.parse_rules(source):
                yield tuple(r.values())


class CssTokens:
    def eval(self, source: str):
        if source is not None:
            for k, t in enumerate(css.tokenize(source)):
                yield k, t.type, t.value, t.length


TABLES = {
    "wm_html_nodes": (HtmlNodes, NODE_COLUMNS),
    "wm_css_rules": (CssRules, "rule_id int, parent_rule_id int, kind string, name string, prelude string, declarations string, ord int"),
    "wm_css_tokens": (CssTokens, "ord int, type string, value string, length int"),
}


def register(spark: SparkSession) -> None:
    for name, (fn, kind) in FUNCTIONS.items():
        spark.udf.register(name, F.udf(_guard(fn), kind, useArrow=True))
    for name, (handler, kind) in TABLES.items():
        spark.udtf.register(name, F.udtf(handler, returnType=kind))
