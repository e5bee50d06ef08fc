"""HTML as relational tables: one row a node, one row a document.

Parsing is a narrow Arrow map, so it scales with the input's partitions; the node table carries the
document's quirks flag, which selectors need, so that no later operator joins documents back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions import html as H
from weftmark.functions.batches import explode_rows, scalar

ATTRS = "array<struct<name:string,value:string>>"
NODES = (
    "doc_id long, quirks boolean, node_id int, parent_id int, root string, depth int, subtree_end int, sib_ix int, elem_ix int, "
    f"kind string, ns string, tag string, is_known boolean, attrs {ATTRS}, data string"
)
DOCS = f"doc_id long, quirks boolean, doctype struct<name:string,public_id:string,system_id:string>, html_attrs {ATTRS}, head_attrs {ATTRS}, body_tag string"


def _ids(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long"), *[F.col(c).cast("string") for c in cols])


def html_nodes(df: DataFrame, id_col: str = "page_id", html_col: str = "html", scripting: bool = False, unclosed: bool = True) -> DataFrame:
    """The nodes of every document; a null text gives none, an empty one a body. Without ``unclosed``, references in texts
    that no semicolon ends are not read."""

    def one(i, html):
        if html is None:
            return []
        doc = H.parse(html, scripting, unclosed)
        return [(i, doc.quirks, *row) for row in H.flatten(doc)]

    return explode_rows(_ids(df, id_col, html_col), NODES, one, 64)


def html_docs(df: DataFrame, id_col: str = "page_id", html_col: str = "html", scripting: bool = False) -> DataFrame:
    """One row a document: doctype, quirks mode, attributes of the shell, body or frameset."""

    def pairs(node):
        return [{"name": a, "value": v} for a, v in node.attrs]

    def one(i, html):
        if html is None:
            return []
        doc = H.parse(html, scripting)
        kind = dict(zip(("name", "public_id", "system_id"), doc.doctype)) if doc.doctype else None
        return [(i, doc.quirks, kind, pairs(doc.html), pairs(doc.head), doc.body.tag)]

    return explode_rows(_ids(df, id_col, html_col), DOCS, one, 64)


def fragment_nodes(df: DataFrame, id_col: str, html_col: str, context: str = "div", ns: str = "html") -> DataFrame:
    """The nodes of each text read as the content of a context element; ids start at 1, parents at 0."""

    def one(i, html):
        if html is None:
            return []
        doc = H.Document()
        doc.root = H.parse_fragment(html, context, ns)
        return [(i, False, *row) for row in H.flatten(doc)]

    return explode_rows(_ids(df, id_col, html_col), NODES, one, 64)


serialize_html = scalar(lambda html: H.serialize_document(H.parse(html)), "string")
serialize_html.__doc__ = "Parse a document and write it back: HTML in canonical form."
serialize_fragment = scalar(lambda html, context="div": H.serialize(H.parse_fragment(html, context), own=False), "string")
serialize_pretty = scalar(lambda html: H.serialize_pretty(H.parse(html).body), "string")


def attr(attrs: Column | str, name: str) -> Column:
    """Value of an attribute, null if absent."""
    attrs = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(1))["value"]


def escape_text(col: Column) -> Column:
    """Text as HTML, with built-ins alone."""
    for raw, entity in (("&", "&amp;"), ("\xa0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(raw), F.lit(entity))
    return col


def escape_attribute(col: Column) -> Column:
    return F.replace(escape_text(col), F.lit('"'), F.lit("&quot;"))


def node_html(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, html) of every element: its subtree written out, in one pass over each document's rows."""
    out = "doc_id long, node_id int, html string"
    rows = nodes.select("doc_id", "root", F.struct("node_id", "parent_id", "subtree_end", "kind", "ns", "tag", "attrs", "data").alias("n"))
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("n")).alias("ns"))  # one document, not a key of many

    def one(i, ns):
        by_id: dict[int, H.Node] = {}
        for n in ns:
            node = H.Node(n["kind"], n["tag"], n["ns"], [(a["name"], a["value"]) for a in n["attrs"] or ()], n["data"])
            by_id[n["node_id"]] = node
            if n["parent_id"] in by_id:
                by_id[n["parent_id"]].add(node)
        return [(i, k, H.serialize(node)) for k, node in by_id.items() if node.kind == "element"]

    return explode_rows(grouped, out, one, 16)


def text_content(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) of every element that has text below it: structural join of texts to ancestors by interval."""
    texts = nodes.where("kind = 'text'").select("doc_id", "root", F.col("node_id").alias("t"), "data")
    elements = nodes.where("kind = 'element'").select("doc_id", "root", "node_id", "subtree_end")
    both = elements.join(texts, ["doc_id", "root"]).where("t > node_id AND t <= subtree_end")
    joined = both.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("t", "data"))).alias("x"))
    return joined.select("doc_id", "node_id", F.array_join(F.col("x.data"), "").alias("text"))
