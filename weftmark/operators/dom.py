"""DOM lookups and edits over the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions import html as H
from weftmark.functions.batches import explode_rows
from weftmark.functions.text import ascii_lower
from weftmark.operators.nodes import ATTRS, NODES, attr

# ---- fixed values: legacy codes of DOM exceptions and their names -----------------------------------------------------
EXCEPTIONS: dict[int, str] = dict(
    enumerate(
        "IndexSizeError DOMStringSizeError HierarchyRequestError WrongDocumentError InvalidCharacterError NoDataAllowedError NoModificationAllowedError NotFoundError NotSupportedError InUseAttributeError InvalidStateError SyntaxError InvalidModificationError NamespaceError InvalidAccessError ValidationError TypeMismatchError SecurityError NetworkError AbortError URLMismatchError QuotaExceededError TimeoutError InvalidNodeTypeError DataCloneError EncodingError NotReadableError UnknownError ConstraintError DataError TransactionInactiveError ReadOnlyError VersionError OperationError NotAllowedError OptOutError".split(),
        1,
    )
)
NAMESPACES: dict[str, str] = {
    "html": "http://www.w3.org/1999/xhtml", "math": "http://www.w3.org/1998/Math/MathML", "svg": "http://www.w3.org/2000/svg",
    "xlink": "http://www.w3.org/1999/xlink", "xml": "http://www.w3.org/XML/1998/namespace", "xmlns": "http://www.w3.org/2000/xmlns/",
}
# ---------------------------------------------------------------------------------------------------------------------
CODES = {name: code for code, name in EXCEPTIONS.items()}
WS = r"[\t\n\f\r ]+"


def exception_name(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXCEPTIONS.items() for x in kv]), code)


def exception_code(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), name)


def namespace_uri(prefix: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in NAMESPACES.items() for x in kv]), prefix)


def namespace_prefix(uri: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in NAMESPACES.items() for x in reversed(kv)]), uri)


def by_id(nodes: DataFrame, value: str) -> DataFrame:
    """The first element of each document with this id, in pre-order."""
    hits = nodes.where((F.col("kind") == "element") & (attr("attrs", "id") == value))
    return hits.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in nodes.columns if c != "doc_id"]), "node_id").alias("n")).select("doc_id", "n.*")


def by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    """Elements by tag name, any case; * takes all."""
    elements = nodes.where("kind = 'element'")
    return elements if tag == "*" else elements.where(F.col("tag") == H.lower(tag))


def by_class(nodes: DataFrame, name: str) -> DataFrame:
    """Elements with a class; any case in quirks mode; an empty name finds none."""
    if not name:
        return nodes.limit(0)
    held = attr("attrs", "class")
    hit = F.when(F.col("quirks"), F.array_contains(F.split(ascii_lower(held), WS), H.lower(name))).otherwise(F.array_contains(F.split(held, WS), name))
    return nodes.where((F.col("kind") == "element") & hit)


def by_attribute(nodes: DataFrame, name: str, value: str, ignore_case: bool = False) -> DataFrame:
    held = attr("attrs", H.lower(name))
    return nodes.where((F.col("kind") == "element") & ((ascii_lower(held) == H.lower(value)) if ignore_case else (held == value)))


def child_nodes(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, children): ids of each node's children, in order."""
    kids = nodes.where("parent_id > 0").groupBy("doc_id", F.col("parent_id").alias("node_id"))
    return kids.agg(F.array_sort(F.collect_list(F.struct("sib_ix", F.col("node_id").alias("id")))).alias("k")).select("doc_id", "node_id", F.col("k.id").alias("children"))


# ---- attributes, as Column functions over attrs -------------------------------------------------------------------------
def set_attribute(attrs: Column, name: str, value: str) -> Column:
    name = H.lower(name)
    pair = F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))
    there = F.exists(attrs, lambda a: a["name"] == name)
    return F.when(there, F.transform(attrs, lambda a: F.when(a["name"] == name, pair).otherwise(a))).otherwise(F.array_append(attrs, pair))


def remove_attribute(attrs: Column, name: str) -> Column:
    return F.filter(attrs, lambda a: a["name"] != H.lower(name))


def has_attribute(attrs: Column, name: str) -> Column:
    return F.exists(attrs, lambda a: a["name"] == H.lower(name))


def clear_attributes(attrs: Column) -> Column:
    return F.slice(attrs, 1, 0)


# ---- edits ----------------------------------------------------------------------------------------------------------------
EDIT = f"struct<op:string,node:int,ref:int,kind:string,tag:string,attrs:{ATTRS},data:string>"
RESULT = NODES.replace("doc_id long, ", "doc_id long, errors array<string>, ", 1)


class _Refused(Exception):
    pass


def _check_insert(parent: H.Node, node: H.Node, document: H.Node) -> None:
    if parent.kind not in ("element", "document", "fragment"):
        raise _Refused("HierarchyRequestError")
    above = parent
    while above is not None:
        if above is node:
            raise _Refused("HierarchyRequestError")
        above = above.parent
    if node.kind == "document" or parent is document and (node.kind == "text" or node.kind == "element" and any(k.kind == "element" and k is not node for k in parent.kids)):
        raise _Refused("HierarchyRequestError")


def apply_edits(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Replay each document's edit log and number its nodes anew.

    ``edits``: doc_id, ord, and the fields of EDIT. Ops: append (node under ref), before / after (node beside ref), remove,
    replace (ref by node), clone (append a deep copy of node under ref), create (append a new node under ref),
    set_inner (children of ref parsed from data), set_attr / remove_attr (attrs of ref), set_text (data of ref).
    Node ids mean the numbers before the edits; created nodes count on from the document's last id. A refused edit
    changes nothing and adds its DOM error name to ``errors``. Only documents with edits are gathered, each for itself."""
    some = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *_FIELDS))).alias("edits"))
    rows = nodes.groupBy("doc_id").agg(F.first("quirks").alias("quirks"), F.array_sort(F.collect_list(F.struct("node_id", "parent_id", "root", "kind", "ns", "tag", "attrs", "data"))).alias("n"))

    def one(i, quirks, n, log):
        doc = H.Document()
        doc.root = H.Node("document")
        by_number: dict[int, H.Node] = {0: doc.root}
        for x in n:
            node = H.Node(x["kind"], x["tag"], x["ns"], [(a["name"], a["value"]) for a in x["attrs"] or ()], x["data"])
            by_number[x["node_id"]] = node
            (doc.head if x["root"] == "head" and not x["parent_id"] else by_number[x["parent_id"]]).add(node)
        errors, last = [], max(by_number)
        for e in log or ():
            try:
                last = _edit(e, by_number, doc, last)
            except _Refused as r:
                errors.append(str(r))
        return [(i, errors, quirks, *row) for row in H.flatten(doc)]

    return explode_rows(rows.join(some, "doc_id", "left"), RESULT, one, 16)


_FIELDS = ("op", "node", "ref", "kind", "tag", "attrs", "data")


def _edit(e: dict, nodes: dict[int, H.Node], doc: H.Document, last: int) -> int:
    def at(k):
        if k not in nodes:
            raise _Refused("NotFoundError")
        return nodes[k]

    op, ref = e["op"], at(e["ref"] if e["ref"] is not None else e["node"])
    if op in ("append", "before", "after", "replace", "clone", "create"):
        if op == "create":
            kind = e["kind"] or "element"
            node = H.Node(kind, e["tag"] and H.lower(e["tag"]), "html" if kind == "element" else None, [(a["name"], a["value"]) for a in e["attrs"] or ()], e["data"])
            last += 1
            nodes[last] = node
        elif op == "clone":
            node = _deep(at(e["node"]))
        else:
            node = at(e["node"])
        parent = ref if op in ("append", "clone", "create") else ref.parent
        if parent is None:
            raise _Refused("HierarchyRequestError")
        _check_insert(parent, node, doc.root)
        if op in ("append", "clone", "create"):
            parent.add(node)
        elif node is not ref:
            parent.add(node, ref)
            if op == "after":
                ref.after(node)
            elif op == "replace":
                ref.detach()
    elif op == "remove":
        if ref.parent is None:
            raise _Refused("NotFoundError")
        ref.detach()
    elif op == "set_inner":
        for kid in list(ref.kids):
            kid.detach()
        for kid in list(H.parse_fragment(e["data"] or "", ref.tag or "div", ref.ns or "html").kids):
            ref.add(kid)
    elif op == "set_attr":
        for a in e["attrs"] or ():
            name = H.lower(a["name"])
            old = next((p for p in ref.attrs if p[0] == name), None)
            if old:
                old[1] = a["value"]
            else:
                ref.attrs.append([name, a["value"]])
    elif op == "remove_attr":
        ref.attrs = [p for p in ref.attrs if p[0] not in {H.lower(a["name"]) for a in e["attrs"] or ()}]
    elif op == "set_text":
        ref.data = e["data"]
    else:
        raise _Refused("NotSupportedError")
    return last


def _deep(node: H.Node) -> H.Node:
    top = node.copy()
    todo = [(node, top)]
    while todo:
        old, new = todo.pop()
        for kid in old.kids:
            twin = kid.copy()
            new.add(twin)
            todo.append((kid, twin))
    return top
