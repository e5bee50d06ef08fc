"""Descriptions of HTML parse errors by number, as Column lookups. The parser itself reports none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: texts by number, from 0 ------------------------------------------------------------------------------
TOKENIZER = (
    "abrupt closing of empty comment",
    "abrupt doctype public identifier",
    "abrupt doctype system identifier",
    "absence of digits in numeric character reference",
    "cdata in html content",
    "character reference outside unicode range",
    "control character in input stream",
    "control character reference",
    "end tag with attributes",
    "duplicate attribute",
    "end tag with trailing solidus",
    "eof before tag name",
    "eof in cdata",
    "eof in comment",
    "eof in doctype",
    "eof in script html comment like text",
    "eof in tag",
    "incorrectly closed comment",
    "incorrectly opened comment",
    "invalid character sequence after doctype name",
    "invalid first character of tag name",
    "missing attribute value",
    "missing doctype name",
    "missing doctype public identifier",
    "missing doctype system identifier",
    "missing end tag name",
    "missing quote before doctype public identifier",
    "missing quote before doctype system identifier",
    "missing semicolon after character reference",
    "missing whitespace after doctype public keyword",
    "missing whitespace after doctype system keyword",
    "missing whitespace before doctype name",
    "missing whitespace between attributes",
    "missing whitespace between doctype public and system identifiers",
    "nested comment",
    "noncharacter character reference",
    "noncharacter in input stream",
    "non void html element start tag with trailing solidus",
    "null character reference",
    "surrogate character reference",
    "surrogate in input stream",
    "unexpected character after doctype system identifier",
    "unexpected character in attribute name",
    "unexpected character in unquoted attribute value",
    "unexpected equals sign before attribute name",
    "unexpected null character",
    "unexpected question mark instead of tag name",
    "unexpected solidus in tag",
    "unknown named character reference",
)
TREE = (
    "unexpected token",
    "unexpected closed token",
    "null character",
    "unexpected character token",
    "unexpected token in initial mode",
    "bad doctype token in initial mode",
    "doctype token in before html mode",
    "unexpected closed token in before html mode",
    "doctype token in before head mode",
    "unexpected closed token in before head mode",
    "doctype token in head mode",
    "non void html element start tag with trailing solidus",
    "head token in head mode",
    "unexpected closed token in head mode",
    "template closed token without opening in head mode",
    "template element is not current in head mode",
    "doctype token in head noscript mode",
    "doctype token after head mode",
    "head token after head mode",
    "doctype token in body mode",
    "bad ending open elements is wrong",
    "open elements is wrong",
    "unexpected element in open elements stack",
    "missing element in open elements stack",
    "no body element in scope",
    "missing element in scope",
    "unexpected element in scope",
    "unexpected element in active formatting stack",
    "unexpected end of file",
    "characters in table text",
    "doctype token in table mode",
    "doctype token in select mode",
    "doctype token after body mode",
    "doctype token in frameset mode",
    "doctype token after frameset mode",
    "doctype token foreign content mode",
    "select in scope",
    "fragment parsing select in context parse input",
    "fragment parsing select in context parse select",
    "hr parsing select option optgroup in scope",
    "option parsing option in scope",
    "optgroup parsing option optgroup in scope",
)
# ---------------------------------------------------------------------------------------------------------------------


def _text(number: Column, texts: tuple[str, ...]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, texts)), number), F.lit("unknown error"))


def tokenizer_error(number: Column) -> Column:
    return _text(number, TOKENIZER)


def tree_error(number: Column) -> Column:
    return _text(number, TREE)
