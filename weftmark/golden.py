"""Small tables of inputs and of what must come out of them, for the registered queries that read no driver table.

Plain values, written out by this engine after its behaviour had been held against published expectations for inputs of the
same kinds, and read through once. They guard against change; an independent oracle would be stronger evidence."""

from __future__ import annotations

#: source, whether ranges are read, place, type, value, bytes
TOKENS = (
    ('\t \n', False, 0, 'whitespace', '\t \n', 3),
    ('\r\n\x0c', False, 0, 'whitespace', '\n\n', 3),
    ('/* a', False, 0, 'comment', '/* a*/', 4),
    ('/**/x', False, 0, 'comment', '/**/', 4),
    ('/**/x', False, 1, 'ident', 'x', 1),
    ('#wy\\67 o', False, 0, 'hash', '#wygo', 8),
    ('#\\', False, 0, 'hash', '#�', 2),
    ('@\\6d edia', False, 0, 'at-keyword', '@media', 9),
    ('"a\'b\\"c"', False, 0, 'string', '"a\'b\\"c"', 8),
    ('\'x"y\'', False, 0, 'string', '"x\\"y"', 5),
    ('"a\nb', False, 0, 'bad-string', '"a"', 2),
    ('"a\nb', False, 1, 'whitespace', '\n', 1),
    ('"a\nb', False, 2, 'ident', 'b', 1),
    ('"\\41\r\nb"', False, 0, 'string', '"Ab"', 8),
    ('"a\\\nb"', False, 0, 'string', '"ab"', 6),
    ('url( /x )', False, 0, 'url', 'url(/x)', 9),
    ('\\75rl(/x)', False, 0, 'url', 'url(/x)', 9),
    ('UrL(/x', False, 0, 'url', 'url(/x)', 6),
    ("url('/x')", False, 0, 'function', 'url(', 4),
    ("url('/x')", False, 1, 'string', '"/x"', 4),
    ("url('/x')", False, 2, 'right-parenthesis', ')', 1),
    ('url(a b)', False, 0, 'bad-url', 'url(ab)', 8),
    ('url(a\\\n)', False, 0, 'bad-url', 'url(a\\\n)', 8),
    ('url(\t', False, 0, 'function', 'url(', 4),
    ('url(\t', False, 1, 'whitespace', '\t', 1),
    ('a(', False, 0, 'function', 'a(', 2),
    ('U+4??', True, 0, 'unicode-range', 'U+400-4FF', 5),
    ('1e21', False, 0, 'number', '1e+21', 4),
    ('1e-7', False, 0, 'number', '1e-7', 4),
    ('1e20', False, 0, 'number', '100000000000000000000', 4),
    ('.5em', False, 0, 'dimension', '0.5em', 4),
    ('+.0', False, 0, 'number', '0', 3),
    ('-0', False, 0, 'number', '0', 2),
    ('1.', False, 0, 'number', '1', 1),
    ('1.', False, 1, 'delim', '.', 1),
    ('12.50%', False, 0, 'percentage', '12.5%', 6),
    ('-3-2-d\\', False, 0, 'number', '-3', 2),
    ('-3-2-d\\', False, 1, 'dimension', '-2-d�', 5),
    ('--\\', False, 0, 'ident', '--�', 3),
    ('<!---->', False, 0, 'CDO', '<!--', 4),
    ('<!---->', False, 1, 'CDC', '-->', 3),
    ('×x', False, 0, 'delim', '×', 2),
    ('×x', False, 1, 'ident', 'x', 1),
    ('µ', False, 0, 'delim', 'µ', 2),
    ('é', False, 0, 'ident', 'é', 2),
    ('a\\', False, 0, 'ident', 'a�', 2),
)

#: declaration, type, name, value, important
DECLARATIONS = (
    ('width: /**/ 2px', 'undef', 'width', '2px', False),
    ('width: /**/  2px', 'undef', 'width', '2px', False),
    ('width: 2px /**/ ', 'property', 'width', '2px', False),
    ('WIDTH: 2Q', 'property', 'WIDTH', '2Q', False),
    ('height: -1px', 'undef', 'height', '-1px', False),
    ('height: min-content !important', 'property', 'height', 'min-content', True),
    ('color: buttontext', 'property', 'color', 'ButtonText', False),
    ('color: RED', 'property', 'color', 'red', False),
    ('color: #AbC', 'property', 'color', '#abc', False),
    ('color: #abcd1', 'undef', 'color', '#abcd1', False),
    ('color: rgb(1 2% 3)', 'undef', 'color', 'rgb(1 2% 3)', False),
    ('color: rgb(1% none 3%)', 'property', 'color', 'rgb(1% none 3%)', False),
    ('color: rgba(1, 2, 3, 50%)', 'property', 'color', 'rgba(1, 2, 3, 50%)', False),
    ('color: rgb(1, 2, none)', 'undef', 'color', 'rgb(1, 2, none)', False),
    ('color: hsl(10 20% 30% .5)', 'property', 'color', 'hsl(10 20% 30% / 0.5)', False),
    ('color: hsl(10 20 30)', 'undef', 'color', 'hsl(10 20 30)', False),
    ('color: hwb(1turn 2% 3%)', 'property', 'color', 'hwb(1turn 2% 3%)', False),
    ('color: lab(1 2 3 / none)', 'property', 'color', 'lab(1 2 3 / none)', False),
    ('color: lch(1 2 90deg)', 'property', 'color', 'lch(1 2 90deg)', False),
    ('color: rgb(1 2 3', 'undef', 'color', 'rgb(1 2 3', False),
    ('flex: 1 2 3', 'property', 'flex', '2 3 1', False),
    ('flex: -1', 'property', 'flex', '-1', False),
    ('flex: 0 auto', 'property', 'flex', '0 auto', False),
    ('flex: 2px 1', 'property', 'flex', '1 2px', False),
    ('flex: none 1', 'undef', 'flex', 'none 1', False),
    ('flex-basis: -10%', 'property', 'flex-basis', '-10%', False),
    ('flex-flow: unset row', 'undef', 'flex-flow', 'unset row', False),
    ('flex-flow: unset wrap', 'property', 'flex-flow', 'unset wrap', False),
    ('flex-flow: wrap row', 'property', 'flex-flow', 'row wrap', False),
    ('vertical-align: inherit baseline', 'property', 'vertical-align', 'inherit baseline', False),
    ('vertical-align: sub first super', 'property', 'vertical-align', 'first super', False),
    ('vertical-align: sub super', 'undef', 'vertical-align', 'sub super', False),
    ("font-family: SeRiF, 'a b', x1", 'property', 'font-family', 'serif, "a b", x1', False),
    ('font-family: é', 'property', 'font-family', '"é"', False),
    ('font-family: My Font', 'undef', 'font-family', 'My Font', False),
    ('font-family: "a\\"b"', 'property', 'font-family', '"a\\"b"', False),
    ('margin: 1px/**/auto', 'property', 'margin', '1px auto', False),
    ('margin: 1px 2px 3px 4px 5px', 'undef', 'margin', '1px 2px 3px 4px 5px', False),
    ('padding: auto', 'undef', 'padding', 'auto', False),
    ('padding: -1%', 'property', 'padding', '-1%', False),
    ('border: 3 dashed Canvas', 'property', 'border', '3 dashed Canvas', False),
    ('border: solid solid', 'undef', 'border', 'solid solid', False),
    ('text-decoration: underline /**/ solid', 'property', 'text-decoration', 'underline solid', False),
    ('text-decoration-line: underline /**/ blink', 'undef', 'text-decoration-line', 'underline  blink', False),
    ('text-decoration: overline underline', 'property', 'text-decoration', 'underline overline', False),
    ('text-indent: each-line 2em hanging', 'property', 'text-indent', '2em hanging each-line', False),
    ('text-transform: full-width uppercase', 'property', 'text-transform', 'uppercase full-width', False),
    ('text-combine-upright: digits 3', 'undef', 'text-combine-upright', 'digits 3', False),
    ('hanging-punctuation: last first', 'property', 'hanging-punctuation', 'first last', False),
    ('float: snap-block( 2px , near )', 'property', 'float', 'snap-block(2px, near)', False),
    ('float: snap-block(2px', 'undef', 'float', 'snap-block(2px', False),
    ('float-defer: 7', 'property', 'float-defer', '7', False),
    ('order: 1.0', 'property', 'order', '1', False),
    ('z-index: 9223372036854775808', 'undef', 'z-index', '9223372036854776000', False),
    ('opacity: 1e-7', 'property', 'opacity', '1e-7', False),
    ('line-height: 1.5', 'property', 'line-height', '1.5', False),
    ('font-weight: 1000', 'property', 'font-weight', '1000', False),
    ('font-weight: 1001', 'undef', 'font-weight', '1001', False),
    ('font-style: oblique 10deg', 'property', 'font-style', 'oblique 10deg', False),
    ('font-size: -1px', 'undef', 'font-size', '-1px', False),
    ('display: inline flex', 'property', 'display', 'inline flex', False),
    ('display: table-cell', 'property', 'display', 'table-cell', False),
    ('display: flex flex', 'undef', 'display', 'flex flex', False),
    ('position: /* c */fixed', 'property', 'position', 'fixed', False),
    ('white-space: Pre', 'property', 'white-space', 'pre', False),
    ('x-y: /**/ 1 2', 'custom', 'x-y', '1 2', False),
    ('1px: a', 'undef', '', '1px: a', False),
    ('a b', 'undef', '', 'a b', False),
    ('width: 1px ! important', 'undef', 'width', '1px ! important', False),
    ('letter-spacing: 0', 'property', 'letter-spacing', '0', False),
    ('tab-size: 4', 'property', 'tab-size', '4', False),
    ('baseline-shift: 5%', 'property', 'baseline-shift', '5%', False),
    ('wrap-flow: maximum', 'property', 'wrap-flow', 'maximum', False),
    ('visibility: inherit', 'property', 'visibility', 'inherit', False),
)

#: formula, normal text, errors
FORMULAS = (
    ('odd', 'odd', ''),
    ('EVEN', 'even', ''),
    (' 2n + 1 ', 'odd', ''),
    ('2n', 'even', ''),
    ('-2n-0', '-2n', ''),
    ('+n', '+n', ''),
    ('1n', '+n', ''),
    ('-1N+ 3', '-n+3', ''),
    ('0n+0', '0n', ''),
    ('+0n-7', '0n-7', ''),
    ('5', '0n+5', ''),
    ('-5', '0n-5', ''),
    ('+05', '0n+5', ''),
    ('n- 2', '+n-2', ''),
    ('n -2', '+n-2', ''),
    ('1n-+1', '', 'Syntax error. An+B. Unexpected token: 1'),
    ('1n--1', '', 'Syntax error. An+B. Unexpected token: 1n--1'),
    ('1n+-1', '', 'Syntax error. An+B. Unexpected token: -1'),
    ('1n++1', '', 'Syntax error. An+B. Unexpected token: 1'),
    ('1.5n', '', 'Syntax error. An+B. Unexpected token: 1.5n'),
    ('n+1.5', '', 'Syntax error. An+B. Unexpected token: 1.5'),
    ('1n-1%', '', 'Syntax error. An+B. Unexpected token: %'),
    ('+ n', '', 'Syntax error. An+B. Unexpected token:  '),
    ('- n', '', 'Syntax error. An+B. Unexpected token: -'),
    ('x', '', 'Syntax error. An+B. Unexpected token: x'),
    ('12n-12', '12n-12', ''),
)

#: selector, normal text, errors, specificity
SELECTORS = (
    ("DIV  >p.a#b[ x = 'y' i ]", 'DIV > p.a#b[x="y"i]', '', 1, 2, 2),
    ('*|a |b c|d', '*|a |b c|d', '', 0, 0, 3),
    ('a,b ~ c', 'a, b ~ c', '', 0, 0, 2),
    ('[q=\'a"b\']', '[q="a\\000022b"]', '', 0, 1, 0),
    ('[q', '[q]', 'Syntax error. Selectors. End Of File in attribute selector', 0, 1, 0),
    ('[q=r i', '[q="r"i]', 'Syntax error. Selectors. End Of File in attribute selector', 0, 1, 0),
    ('[q~ =r]', '', 'Syntax error. Selectors. Unexpected token:  ', None, None, None),
    ('[q=1]', '', 'Syntax error. Selectors. Unexpected token: 1', None, None, None),
    ('[q=r x]', '', 'Syntax error. Selectors. Unexpected token: x', None, None, None),
    ('.1', '', 'Syntax error. Selectors. Unexpected token: 0.1', None, None, None),
    (', a', '', 'Syntax error. Selectors. Unexpected token: ,', None, None, None),
    ('a,', '', 'Syntax error. Selectors. Unexpected token: END-OF-FILE', None, None, None),
    ('a >', '', 'Syntax error. Selectors. Unexpected token: END-OF-FILE', None, None, None),
    ('> a', '', 'Syntax error. Selectors. Unexpected token: >', None, None, None),
    ('a || b', 'a || b', '', 0, 0, 2),
    (':not()', '', "Syntax error. Selectors. Pseudo function can't be empty: not()", None, None, None),
    (':not(a,)', '', "Syntax error. Selectors. Pseudo function can't be empty: not()", None, None, None),
    (':not(a, b 1%)', '', "Syntax error. Selectors. Unexpected token: 1%|Syntax error. Selectors. Pseudo function can't be empty: not()", None, None, None),
    (':is(a, 1%, b):hover', ':is(a, b):hover', 'Syntax error. Selectors. Unexpected token: 1%', 0, 1, 1),
    (':where(:bad, c)', ':where(c)', 'Syntax error. Selectors. Unexpected token: bad', 0, 0, 0),
    (':has(, a)', ':has(a)', 'Syntax error. Selectors. Unexpected token: ,', 0, 0, 1),
    (':has(1%)', '', "Syntax error. Selectors. Unexpected token: 1%|Syntax error. Selectors. Pseudo function can't be empty: has()", None, None, None),
    (':has(div, :not(a', ':has(div, :not(a))', 'Syntax error. Selectors. End Of File in pseudo function|Syntax error. Selectors. End Of File in pseudo function', 0, 0, 1),
    (':current(a)', ':current()', '', 0, 0, 1),
    (':nth-child(2n+1)', ':nth-child(odd)', '', 0, 1, 0),
    (':nth-child(2N + 0 of a, b)', ':nth-child(even of a, b)', '', 0, 1, 1),
    (':nth-child(2n+)', '', "Syntax error. Selectors. Pseudo function can't be empty: nth-child()", None, None, None),
    (':nth-child(1%)', '', "Syntax error. Selectors. Unexpected token: 1%|Syntax error. Selectors. Pseudo function can't be empty: nth-child()", None, None, None),
    (':nth-child(2 of )', '', "Syntax error. Selectors. Pseudo function can't be empty: nth-child()", None, None, None),
    (':target', '', 'Syntax error. Selectors. Not supported: target|Syntax error. Selectors. Unexpected token: target', None, None, None),
    (':nope', '', 'Syntax error. Selectors. Unexpected token: nope', None, None, None),
    (':nope(x)', '', 'Syntax error. Selectors. Unexpected token: nope(', None, None, None),
    (':lang(en)', '', 'Syntax error. Selectors. Not supported: lang|Syntax error. Selectors. Unexpected token: lang(', None, None, None),
    ('::before', '', 'Syntax error. Selectors. Not supported: before|Syntax error. Selectors. Unexpected token: before', None, None, None),
    ('::nope', '', 'Syntax error. Selectors. Unexpected token: nope', None, None, None),
    ('::(', '', 'Syntax error. Selectors. Unexpected token: :', None, None, None),
    ('a:first-child::x', '', 'Syntax error. Selectors. Unexpected token: x', None, None, None),
    ('p:has(> a) b', 'p:has(> a) b', '', 0, 0, 3),
    ('\\31 a', '1a', '', 0, 0, 1),
    ('a b)', '', 'Syntax error. Selectors. Unexpected token: )', None, None, None),
)

#: page, declared labels, what a prescan takes, the final encoding
CHARSETS = (
    ('<meta charset=utf-8>', 'utf-8', 'utf-8', 'UTF-8'),
    ("<META CHARSET = 'latin1' >", 'latin1', 'latin1', 'windows-1252'),
    ('<meta charset=x-user-defined>', 'x-user-defined', 'windows-1252', 'windows-1252'),
    ('<meta charset=unicode>', 'unicode', 'UTF-8', 'windows-1252'),
    ('<meta charset>', '', None, 'windows-1252'),
    ('<meta charset=a charset=b>', 'a', 'a', 'windows-1252'),
    ("<meta http-equiv=content-type content='text/html; charset=koi8-r'>", 'koi8-r', 'koi8-r', 'KOI8-R'),
    ("<meta content='text/html; charset=koi8-r'>", '', None, 'windows-1252'),
    ('<meta http-equiv=content-type content="a; charset=\'b c\'">', 'b c', 'b c', 'windows-1252'),
    ('<meta http-equiv=content-type content=\'charset=b"c\'>', '', None, 'windows-1252'),
    ("<meta http-equiv=content-type content='charset=koi8-r' charset=gbk>", 'koi8-r|gbk', 'koi8-r', 'KOI8-R'),
    ('<meta charsetx=big5>', 'big5', 'big5', 'Big5'),
    ('<meta charset/=gbk>', '', None, 'windows-1252'),
    ('<!--><meta charset=gbk>', 'gbk', 'gbk', 'GBK'),
    ('<!-- <meta charset=gbk> --><meta charset=big5>', 'big5', 'big5', 'Big5'),
    ('<?x <meta charset=gbk>?><meta charset=big5>', 'big5', 'big5', 'Big5'),
    ("</p a='><meta charset=gbk>'><meta charset=big5>", 'big5', 'big5', 'Big5'),
    ("<p a='><meta charset=gbk>'><meta charset=big5>", 'big5', 'big5', 'Big5'),
    ('<metax charset=gbk>', '', None, 'windows-1252'),
    ("<meta charset='gbk", '', None, 'windows-1252'),
    ('<meta/charset=gbk>', 'gbk', 'gbk', 'GBK'),
    ('no tag', '', None, 'windows-1252'),
)

#: page, the document written back, whether it is in quirks mode
TREES = (
    ('<html><head></head><body><x><p><button></button></p></x></body></html>', '<html><head></head><body><x><p><button></button></p></x></body></html>', True),
    ('<a href=/w>1</a>', '<html><head></head><body><a href="/w">1</a></body></html>', True),
    ('<svg><a xlink:title>', '<html><head></head><body><svg><a xlink:title=""></a></svg></body></html>', True),
    ('<a target=x><div></a>', '<html><head></head><body><a target="x"></a><div><a target="x"></a></div></body></html>', True),
    ('<svg><a><foreignObject><div></a>', '<html><head></head><body><svg><a><foreignobject><div></div></foreignobject></a></svg></body></html>', True),
    ('<a><svg><foreignObject><div></a>', '<html><head></head><body><a><svg><foreignobject><div></div></foreignobject></svg></a></body></html>', True),
    ('<svg><use x:y=1 x:y=2>', '<html><head></head><body><svg><use x:y="1"></use></svg></body></html>', True),
    ('<!doctype html><div>x</div>', '<!DOCTYPE html><html><head></head><body><div>x</div></body></html>', False),
    ('<body><script>x < y > z</script>', '<html><head></head><body><script>x < y > z</script></body></html>', True),
    ('<table>a<tr><td>b', '<html><head></head><body>a<table><tbody><tr><td>b</td></tr></tbody></table></body></html>', True),
    ('<table><b>c</table>', '<html><head></head><body><b>c</b><table></table></body></html>', True),
    ('<p><b>Title<br><p>x</p>', '<html><head></head><body><p><b>Title<br></b></p><p>x</p></body></html>', True),
    ('<ul><li>1<li>2', '<html><head></head><body><ul><li>1</li><li>2</li></ul></body></html>', True),
    ('<select><option>a<option>b', '<html><head></head><body><select><option>a</option><option>b</option></select></body></html>', True),
    ('<h1>a<h2>b', '<html><head></head><body><h1>a</h1><h2>b</h2></body></html>', True),
    ('<p>a<div>b</p>c', '<html><head></head><body><p>a</p><div>b<p></p>c</div></body></html>', True),
    ('<img src=a><br/>x', '<html><head></head><body><img src="a"><br>x</body></html>', True),
    ('<textarea></b>&lt;</textarea>', '<html><head></head><body><textarea>&lt;/b&gt;&lt;</textarea></body></html>', True),
    ('<title>a<b></title>c', '<html><head><title>a&lt;b&gt;</title></head><body>c</body></html>', True),
    ('&copy;&notit;&#128;&#0;', '<html><head></head><body>©¬it;€�</body></html>', True),
    ("<div a=1 A=2 b='&amp;&quot;'>", '<html><head></head><body><div a="1" b="&amp;&quot;"></div></body></html>', True),
    ('<!-- c --><p>x<!-- d', '<!-- c --><html><head></head><body><p>x<!-- d--></p></body></html>', True),
    ('<x <y>', '<html><head></head><body><x <y=""></x></body></html>', True),
    ('text <tag', '<html><head></head><body>text </body></html>', True),
    ('<frameset><frame></frameset>', '<html><head></head><frameset><frame></frameset></html>', True),
    ('<p>1<table>2', '<html><head></head><body><p>12<table></table></p></body></html>', True),
)

#: The page of MATCHES.
PAGE = '<!doctype html><body><form id=f><fieldset id=fs disabled><div id=d1 disabled></div><input id=i1 type=checkbox checked disabled></fieldset><input id=i2 required placeholder=q><textarea id=t1 readonly></textarea><option id=o1 selected></option></form><a id=a1 href=x class="K q">abc</a><a id=a2>Abc</a><div id=e1></div><div id=e2><!--c--></div><div id=e3> </div><p id=p1 lang=en-GB focus></p><p id=p2 data-x="one two"></p><p id=p3></p></body>'

#: selector, ids of what it finds in PAGE, in order
MATCHES = (
    ('#a1', 'a1'),
    ('a:any-link', 'a1'),
    (':link', 'a1'),
    (':checked', 'i1 o1'),
    (':disabled', 'd1 i1'),
    ('input:enabled', 'i2'),
    (':required', 'i2'),
    (':optional', 'i1 t1'),
    (':placeholder-shown', 'i2'),
    (':read-write', 'i2'),
    ('textarea:read-only', 't1'),
    (':focus', 'p1'),
    ('div:empty', 'd1 e1 e2'),
    ('div:blank', 'd1 e1 e2 e3'),
    ('div:not(:empty)', 'e3'),
    ('.K', 'a1'),
    ('.k', ''),
    ('[class="K Q" i]', 'a1'),
    ('[lang|=en]', 'p1'),
    ('[data-x~=two]', 'p2'),
    ('[data-x$=wo]', 'p2'),
    ("[data-x*='e t']", 'p2'),
    ('[data-x^=one]', 'p2'),
    ('p:first-of-type', 'p1'),
    ('p:nth-last-of-type(1)', 'p3'),
    ('p:nth-child(odd of p)', 'p1 p3'),
    ('div + p', 'p1'),
    ('a ~ p', 'p1 p2 p3'),
    ('form > fieldset', 'fs'),
    ('body p:last-child', 'p3'),
    ('a:vendor-contains("abc")', 'a1'),
    ('a:vendor-contains(abc i)', 'a1 a2'),
    ('a || p', ''),
    ('p:current(p)', 'p1 p2 p3'),
    ('form:has(option)', 'f'),
    ('form:has(> option:checked)', 'f'),
    (':is(#p1, #p2)', 'p1 p2'),
    (':where(p):not([lang])', 'p2 p3'),
    ('p:only-of-type', ''),
    ('[id=f', 'f'),
    ('p:target', ''),
    ('fieldset :disabled', 'd1 i1'),
)

#: bytes in hexadecimal, code points, code points by shape (none: not readable)
POINTS = (
    ('61E282AC', '97,8364', '97,8364'),
    ('C3A9', '233', '233'),
    ('E282', '3145727', None),
    ('F09F92A9', '128169', '128169'),
    ('C080', '65533,65533', '0'),
    ('EDA080', '65533,65533,65533', '55296'),
    ('FF41', '65533,65', None),
    ('E228A1', '65533,40,65533', '10785'),
    ('F4908080', '65533,65533,65533,65533', '1114112'),
)
