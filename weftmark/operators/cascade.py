"""Computed style: rules of every sheet matched once per distinct selector, winners by one max_by per property."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.functions import match
from weftmark.functions.batches import explode_rows
from weftmark.functions.css import css_declarations, css_rules
from weftmark.operators.nodes import attr
from weftmark.plans import selectors as S
from weftmark.plans.matching import Compiler

#: Selectors of one plan, and most distinct selectors that are compiled into plans at all; with more, every document matches
#: its own sheets' selectors in its task, and no selector reaches the driver.
PER_PLAN, COMPILED = 32, 64


def style_sheets(nodes: DataFrame) -> DataFrame:
    """(doc_id, sheet_id, css) of the style elements, in document order; head comes first."""
    styles = nodes.where("tag = 'style' AND ns = 'html'").select("doc_id", F.col("node_id").alias("sheet_id"))
    texts = nodes.where("kind = 'text'").select("doc_id", F.col("parent_id").alias("sheet_id"), "node_id", "data")
    joined = styles.join(texts, ["doc_id", "sheet_id"]).groupBy("doc_id", "sheet_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "data"))).alias("t"))
    return joined.select("doc_id", "sheet_id", F.array_join("t.data", "").alias("css"))


def _rules(sheets: DataFrame) -> DataFrame:
    """Rules of each distinct sheet text: (css, selector, rule_ord, decl_ord, name, value, important). At-rules never apply."""
    texts = sheets.select("css").distinct().withColumn("text_id", F.xxhash64("css"))
    rules = css_rules(texts, "text_id", "css").where("kind = 'qualified-rule' AND parent_rule_id = 0 AND prelude <> ''")
    declared = rules.select(F.col("sheet_id").alias("text_id"), F.col("prelude").alias("selector"), F.col("rule_id").alias("rule_ord"), F.posexplode(css_declarations(F.col("declarations"))).alias("decl_ord", "d"))
    return declared.where("d.type <> 'undef' AND d.value <> ''").select("text_id", "selector", "rule_ord", "decl_ord", F.when(F.col("d.type") == "custom", F.col("d.name")).otherwise(F.lower("d.name")).alias("name"), F.col("d.value").alias("value"), F.col("d.important").alias("important"))


def matched_branches(nodes: DataFrame, selectors: list[str]) -> DataFrame:
    """(doc_id, node_id, selector, a, b, c): the specificity of the best branch that matches."""
    out = None
    for at in range(0, len(selectors), PER_PLAN):
        compiler = Compiler(nodes)
        hits = []
        for text in selectors[at : at + PER_PLAN]:
            parsed = S.parse(text)
            if not parsed.selectors:
                continue  # the whole list must be valid
            for branch in parsed.selectors:
                spec = F.struct(*[F.lit(x).alias(n) for n, x in zip("abc", S.specificity(branch))])
                hits.append(F.when(F.col(compiler.mark(branch)), F.struct(F.lit(text).alias("selector"), spec.alias("s"))))
        if hits:
            rows = compiler.df.select("doc_id", "node_id", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
            rows = rows.groupBy("doc_id", "node_id", "h.selector").agg(F.max("h.s").alias("s")).select("doc_id", "node_id", "selector", "s.*")
            out = rows if out is None else out.unionByName(rows)
    return out


def matched_in_place(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """Like ``matched_branches``, for (doc_id, selector) pairs: each document for itself, one shuffle by document."""
    texts = used.groupBy("doc_id").agg(F.collect_set("selector").alias("texts"))
    fields = ("node_id", "parent_id", "root", "subtree_end", "kind", "tag", "is_known", "attrs", "data")
    rows = nodes.groupBy("doc_id").agg(F.first("quirks").alias("quirks"), F.collect_list(F.struct(*fields)).alias("n"))
    read = match.Reader()
    return explode_rows(rows.join(texts, "doc_id"), "doc_id long, node_id int, selector string, a int, b int, c int", lambda i, quirks, n, texts: [(i, *b) for b in match.branches(n, quirks, texts, read)], 16)


def computed_style(nodes: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, style) of every element that some declaration reaches.

    ``sheets``: doc_id, sheet_id (source order), css; by default the documents' own style elements. Attach sheets by
    adding rows, remove them with an anti-join. Rank decides first (sheet, inline, important sheet, important inline),
    then specificity, then source order. Up to COMPILED distinct selectors become plans; more are matched in place."""
    sheets = style_sheets(nodes) if sheets is None else sheets
    rules = _rules(sheets)
    selectors = sorted(r[0] for r in rules.select("selector").distinct().limit(COMPILED + 1).collect())
    used = sheets.select("doc_id", "sheet_id", F.xxhash64("css").alias("text_id"))
    inline = nodes.where("kind = 'element'").select("doc_id", "node_id", attr("attrs", "style").alias("css")).where("css IS NOT NULL")
    inline = inline.select("doc_id", "node_id", F.posexplode(css_declarations(F.col("css"))).alias("decl_ord", "d")).where("d.type <> 'undef' AND d.value <> ''")
    zero = [F.lit(0).alias(n) for n in ("a", "b", "c", "sheet_id", "rule_ord")]
    wins = inline.select("doc_id", "node_id", F.when(F.col("d.type") == "custom", F.col("d.name")).otherwise(F.lower("d.name")).alias("name"), "d.value", "d.important", F.lit(1).alias("inline"), *zero, "decl_ord")
    if len(selectors) > COMPILED:
        branches = matched_in_place(nodes, used.join(rules, "text_id").select("doc_id", "selector").distinct())
    else:
        branches = matched_branches(nodes, selectors) if selectors else None
    if branches is not None:
        hits = branches.join(used, "doc_id").join(rules, ["text_id", "selector"])
        wins = wins.unionByName(hits.select("doc_id", "node_id", "name", "value", "important", F.lit(0).alias("inline"), "a", "b", "c", "sheet_id", "rule_ord", "decl_ord"))
    rank = F.struct((2 * F.col("important").cast("int") + F.col("inline")).alias("rank"), "a", "b", "c", "sheet_id", "rule_ord", "decl_ord")
    won = wins.groupBy("doc_id", "node_id", "name").agg(F.max_by(F.struct("value", "important"), rank).alias("w"))
    text = F.concat("name", F.lit(": "), "w.value", F.when(F.col("w.important"), " !important").otherwise(""))
    listed = won.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("name", text.alias("text")))).alias("all"))
    return listed.select("doc_id", "node_id", F.array_join("all.text", "; ").alias("style"))


def style_after_edits(nodes: DataFrame, edits: DataFrame, without_events: bool = False, sheets: DataFrame | None = None) -> DataFrame:
    """Computed style after an edit log. Styles follow the processed copy of a document: with ``without_events`` the edits do
    not reach it, and styles stay those of the nodes as parsed. ``sheets`` stay attached either way."""
    from weftmark.operators.dom import apply_edits

    return computed_style(nodes if without_events else apply_edits(nodes, edits).drop("errors"), sheets)
