import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from weftmark.functions import css, encoding, text, url
from weftmark.operators import cascade, dom, nodes
from weftmark.streaming import assemble_chunks, decode_chunks, first_seen, normalize_chunks, pages_per_window


def test_punycode_round_trip():
    draw = random.Random(1)
    for _ in range(300):
        s = "".join(chr(draw.choice((97, 0xFC, 0x451, 0x4E2D, 0x1F600)) + draw.randrange(20)) for _ in range(draw.randint(1, 20)))
        assert text.punycode_decode(text.punycode_encode(s)) == s == text.punycode_encode(s).encode().decode("punycode")
    assert text.punycode_decode(text.punycode_encode("ё" * 8192)) == "ё" * 8192
    with pytest.raises(ValueError):
        text.punycode_decode("99999999")


@pytest.mark.parametrize("host, flags, want", [("Bücher.DE", text.STD3, "xn--bcher-kva.de"), ("faß.de", text.STD3 | text.TRANSITIONAL, "fass.de"), ("a..b", text.DNS_LENGTH, None), ("-a", text.HYPHENS, None), ("אa", text.BIDI, None), ("a‍b", text.JOINERS, None), ("a_b", 0, "a_b"), ("a_b", text.STD3, None)])
def test_idna(host, flags, want):
    try:
        got = text.to_ascii(host, flags)
    except ValueError:
        got = None
    assert got == want


@pytest.mark.parametrize("host, want", [("127.1", "127.0.0.1"), ("0x7f000001", "127.0.0.1"), ("1.2.3.256", None), ("01.02.3.4.", "1.2.3.4"), ("1.2.3.4.5", None), ("a.b", "a.b"), ("[::1.2.3.4]", "[::102:304]"), ("[1:2::3:4:0:0]", "[1:2::3:4:0:0]"), ("[1::2::3]", None), ("[12345::]", None), ("%41", "a"), ("a%b", None)])
def test_hosts(host, want):
    try:
        got = url.parse_host(host, True)
    except url.Failed:
        got = None
    assert got == want


def test_url_columns(spark):
    rows = [("http://u:p@h:1/a?b#c",), ("no url",), (None,), ("foo:bar",)]
    df = spark.createDataFrame(rows, "u string").select("u", url.url_parse(F.col("u")).alias("r"))
    got = {r.u: (r.t, r.h) for r in df.select("u", url.url_text(F.col("r")).alias("t"), "r.host", F.col("r.host").alias("h")).collect()}
    assert got == {"http://u:p@h:1/a?b#c": ("http://u:p@h:1/a?b#c", "h"), "no url": (None, None), None: (None, None), "foo:bar": ("foo:bar", None)}


def test_single_byte_round_trips():
    for name in encoding._SINGLE:
        table = encoding.single_byte(name)
        known = bytes(b for b in range(256) if table[b] != "�")
        assert encoding.encode(encoding.decode(known, name)[0], name) == known, name
    assert encoding.single_byte("windows-1252")[0x81] == "\x81" and encoding.single_byte("ISO-8859-6")[0xA1] == "�"


@pytest.mark.parametrize("name, s", [("Shift_JIS", "日本ｱ"), ("EUC-JP", "日本"), ("EUC-KR", "한국"), ("Big5", "中文"), ("gb18030", "中😀"), ("GBK", "中€"), ("ISO-2022-JP", "日a"), ("UTF-16LE", "a😀")])
def test_multi_byte_round_trips(name, s):
    assert encoding.decode(encoding.encode(s, name), name) == (s, False)


def test_malformed_bytes():
    assert encoding.decode(b"\xe4\xbd", "UTF-8") == ("�", True) and encoding.decode(b"a\x81 b", "Shift_JIS") == ("a� b", False) and encoding.decode(b"\xff\x41", "UTF-8") == ("�A", False)
    assert encoding.encode("中", "KOI8-R") is None


@pytest.mark.parametrize("html, want", [(b"<meta charset=nope><meta charset=latin2>", "ISO-8859-2"), (b"<!-- <meta charset=koi8-r> --><meta a='>' charset=utf-16>", "UTF-8"), (b"<meta content='text/html; charset=big5'>", "windows-1252"), (b"<meta http-equiv=Content-Type content='text/html; charset=\"big5\"'>", "Big5"), (b"\xfe\xff<meta charset=big5>", "UTF-16BE"), (b"", "windows-1252"), (b"<meta charset=x-user-defined>", "windows-1252")])
def test_determine(html, want):
    assert encoding.determine(html) == want


@pytest.mark.parametrize(
    "source, kind, value",
    [
        ("width: -1px", "undef", "-1px"), ("width: 0", "property", "0"), ("height: 1Q", "property", "1Q"), ("margin: 1 2", "undef", "1 2"), ("margin: 1px 2% auto inherit", "property", "1px 2% auto inherit"),
        ("flex: 0 1 2", "property", "1 2 0"), ("flex: 1", "property", "1"), ("flex: auto 2", "property", "2 auto"), ("flex: none", "property", "none"), ("flex-flow: wrap row", "property", "row wrap"),
        ("color: rgb(1 2 3 / 50%)", "property", "rgb(1 2 3 / 50%)"), ("color: rgb(1, 2%, 3)", "undef", "rgb(1, 2%, 3)"), ("color: hsl(120DEG 1% 2%)", "property", "hsl(120deg 1% 2%)"), ("color: #ABCDE", "undef", "#ABCDE"),
        ("display: block flow list-item", "property", "block flow list-item"), ("display: block flex list-item", "undef", "block flex list-item"), ("text-decoration: red underline dotted", "property", "underline dotted red"),
        ("font-weight: 1001", "undef", "1001"), ("font-style: oblique 91deg", "undef", "oblique 91deg"), ("font-family: a b", "undef", "a b"), ("order: 1.5", "undef", "1.5"), ("order: +7", "property", "7"),
        ("text-combine-upright: digits 4", "property", "digits 4"), ("hanging-punctuation: last first", "property", "first last"), ("text-transform: full-width uppercase", "property", "uppercase full-width"),
        ("letter-spacing: 1%", "undef", "1%"), ("opacity: -0", "property", "0"), ("border: dotted 3 blue", "property", "3 dotted blue"), ("float: snap-inline(1px, start)", "undef", "snap-inline(1px, start)"),
    ],
)
def test_declarations(source, kind, value):
    d = css.parse_declarations(source)[0]
    assert (d["type"], d["value"]) == (kind, value)


def test_css_rules_nest():
    rules = css.parse_rules("@media x{a{b:c}} p, q > r { margin:0; & s {t:u} v:w } @import 'x'; z{}")
    assert [(r["rule_id"], r["parent_rule_id"], r["name"], r["prelude"]) for r in rules] == [(1, 0, "media", "x"), (2, 1, None, "a"), (3, 0, None, "p, q > r"), (4, 3, None, "& s"), (5, 0, "import", "'x'"), (6, 0, None, "z")]
    assert rules[2]["declarations"] == "margin:0;v:w" and css.number_text("1e400") == "1.797693134862316e+308" and css.number_text("-0.0") == "0"


@pytest.mark.parametrize("compiled", [64, 0])
def test_cascade(spark, monkeypatch, compiled):
    html = "<style>p{color:red;margin:0} #i{color:blue} p{margin:1px!important} @media x{p{color:green}} p:bad{order:1} .k, p{z-index:1}</style><body><p id=i style='color:lime;margin:2px'>a</p><p class=k>b</p>"
    n = nodes.html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    monkeypatch.setattr(cascade, "COMPILED", compiled)
    got = [r.style for r in cascade.computed_style(n).orderBy("node_id").collect()]
    assert got == ["color: lime; margin: 1px !important; z-index: 1", "color: red; margin: 1px !important; z-index: 1"]


def test_dom(spark):
    n = nodes.html_nodes(spark.createDataFrame([(1, "<!DOCTYPE html><p id=a class='X y'>1<p id=a>2<div>3</div>"), (2, "<p class=x>")], "page_id long, html string")).cache()
    assert [(r.doc_id, r.node_id) for r in dom.by_id(n, "a").collect()] == [(1, 2)]
    assert {r.doc_id for r in dom.by_class(n, "x").collect()} == {2} and dom.by_class(n, "").count() == 0  # the second page is in quirks mode
    assert dom.by_tag(n, "P").count() == 3 and dom.by_attribute(n, "CLASS", "x Y", True).count() == 1
    log = [(1, 1, "append", 4, 2, None, None, None, None), (1, 2, "append", 2, 4, None, None, None, None), (1, 3, "create", None, 6, "element", "B", [("t", "v")], None), (1, 4, "set_inner", None, 6, None, None, None, "x<i>y"), (1, 5, "remove", None, 99, None, None, None, None)]
    edits = spark.createDataFrame(log, "doc_id long, ord int, op string, node int, ref int, kind string, tag string, attrs array<struct<name:string,value:string>>, data string")
    after = dom.apply_edits(n, edits)
    html = {(r.doc_id, r.node_id): r.html for r in nodes.node_html(after.drop("errors")).collect()}
    assert html[1, 1] == '<body><p id="a" class="X y">1<p id="a">2</p></p><div>x<i>y</i></div></body>'
    assert after.where("doc_id = 1").first().errors == ["HierarchyRequestError", "NotFoundError"]


def test_streams(spark, tmp_path):
    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
        q.awaitTermination()
        return spark.table(name).collect()

    def feed(name, rows, schema):
        for k, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    chunks = feed("a", [[(1, 0, "<p>", False), (2, 0, "x", True)], [(1, 2, "c", True)], [(1, 1, "b", False), (3, 0, "never", False)]], "doc_id long, seq long, chunk string, last boolean")
    assert sorted(map(tuple, run(assemble_chunks(chunks), "a"))) == [(1, "<p>bc"), (2, "x")]
    raw = "日本😀".encode()
    parts = feed("b", [[(1, k, raw[k : k + 1], k == len(raw) - 1)] for k in range(4)] + [[(1, 4, raw[4:], True)]], "stream_id long, seq long, data binary, last boolean")
    assert "".join(r.text for r in sorted(run(decode_chunks(parts, "utf-8"), "b"), key=lambda r: r.seq)) == "日本😀"
    nfd = unicodedata.normalize("NFD", "éà한")
    parts = feed("c", [[(1, k, c, k == len(nfd) - 1)] for k, c in enumerate(nfd)], "stream_id long, seq long, chunk string, last boolean")
    assert "".join(r.text for r in sorted(run(normalize_chunks(parts), "c"), key=lambda r: r.seq)) == "éà한"


def test_windows(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 01:00:00', 'a'")
    assert sorted(r.n for r in pages_per_window(df).collect()) == [1, 2]
    assert first_seen(df, "event_type").count() == 1
