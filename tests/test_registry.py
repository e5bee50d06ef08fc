from pyspark.sql import functions as F

from weftmark.functions import errors
from weftmark.functions.registry import register
from weftmark.operators import cascade, dom, nodes
from weftmark.sources import read_html_files, read_pages


def test_functions_in_sql(spark):
    register(spark)
    row = spark.sql("SELECT wm_url_parse('http://e.com/a').host AS h, wm_idna_to_ascii('ü.de') AS a, wm_punycode_decode('!') AS n, wm_normalize('é', 'NFC') AS c, wm_selector_valid('a::after') AS v, wm_decode(X'93FA', 'sjis') AS d").first()
    assert tuple(row) == ("e.com", "xn--tda.de", None, "é", False, "日")
    assert [r.tag for r in spark.sql("SELECT tag FROM wm_html_nodes('<p><b>x</b>') WHERE kind = 'element' ORDER BY node_id").collect()] == ["body", "p", "b"]
    joined = spark.sql("SELECT t.id, r.prelude FROM VALUES (1, 'a{b:c} d{}') AS t(id, css), LATERAL wm_css_rules(t.css) r ORDER BY r.rule_id")
    assert [tuple(r) for r in joined.collect()] == [(1, "a"), (1, "d")]


def test_error_texts(spark):
    got = spark.range(1).select(errors.tokenizer_error(F.lit(9)), errors.tree_error(F.lit(36)), errors.tree_error(F.lit(99))).first()
    assert tuple(got) == ("duplicate attribute", "select in scope", "unknown error") and (len(errors.TOKENIZER), len(errors.TREE)) == (49, 42)


def test_style_lifecycle(spark):
    n = nodes.html_nodes(spark.createDataFrame([(1, "<style>.k{color:red}</style><body><p class=k>a</p>")], "page_id long, html string"))
    at = [r.node_id for r in dom.by_tag(n, "p").collect()][0]
    log = spark.createDataFrame([(1, 1, "set_attr", None, at, None, None, [("class", "z")], None)], "doc_id long, ord int, op string, node int, ref int, kind string, tag string, attrs array<struct<name:string,value:string>>, data string")
    assert [r.style for r in cascade.style_after_edits(n, log, without_events=True).collect()] == ["color: red"]
    assert cascade.style_after_edits(n, log).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<meta charset=latin2><p>ą".encode("iso8859_2"))
    (tmp_path / "b.html").write_bytes(b"\xef\xbb\xbf<p>\xc4\x85")
    files = read_html_files(spark, str(tmp_path))
    assert sorted((r.encoding, r.html[-1]) for r in files.collect()) == [("ISO-8859-2", "ą"), ("UTF-8", "ą")]
    raw = files.select("page_id", F.encode("html", "UTF-8").alias("raw"))
    assert read_pages(raw.withColumn("raw", F.concat(F.unhex(F.lit("EFBBBF")), "raw")), "raw", "page_id").where("tag = 'p'").count() == 2
