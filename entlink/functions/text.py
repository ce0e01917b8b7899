"""String and markup scalars: normalisation of text, anchors and link targets."""

from __future__ import annotations

import re
from functools import reduce
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The signs that part tokens. The first are dropped, the second are tokens of their own.
DROP = " \t\n\r\f\u2014/*`\"'()[]{},\u2018\u2019\u201c\u201d;?_\u00a0"
KEEP = ".!-:"
# Tags whose text stays when the tag goes; the second list may have attributes.
BARE_TAGS = ["big", "small", "code", "del", "math", "noinclude", "nowiki", "ref", "s", "sub", "sup", "tt", "u", "var"]
ATTRIBUTE_TAGS = ["abbr", "span"]

#: How Java and RE2 write the signs above in a class.
_IN_CLASS = {"\t": r"\t", "\n": r"\n", "\r": r"\r", "\f": r"\f"} | {c: "\\" + c for c in "()[]-"}
DROP_CLASS, KEEP_CLASS = ("".join(_IN_CLASS.get(c, c if c.isascii() else rf"\x{{{ord(c):04x}}}") for c in signs) for signs in (DROP, KEEP))

_XML_NAMES = {"lt": 60, "gt": 62, "amp": 38, "quot": 34, "apos": 39}
_REFERENCE = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")


def _resolved(text: str, names: dict[str, int]) -> str:
    """Named and numeric references of one pass, from left to right; what is none stays."""

    def sign(m: re.Match) -> str:
        code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else names.get(m[3])
        return m[0] if code is None or not 0 < code < 0x110000 or 0xD800 <= code < 0xE000 else chr(code)

    return _REFERENCE.sub(sign, text)


def unescaped(text: str | None) -> str | None:
    """References resolved four times: those of XML, twice those of HTML 4, those of XML. They need their semicolon."""
    for names in (_XML_NAMES, name2codepoint, name2codepoint, _XML_NAMES):
        if not text or "&" not in text:
            return text
        text = _resolved(text, names)
    return text


def _unescape(s: pd.Series) -> pd.Series:
    return s.map(unescaped)


def unescape(c: Column) -> Column:
    """HTML and XML references resolved, four times over. Only values that hold a reference go to Python."""
    resolve = F.pandas_udf(_unescape, StringType())
    return F.coalesce(resolve(F.when(F.contains(c, F.lit("&")) & c.rlike("&#?[A-Za-z0-9]+;"), c)), c)


def remove_tags(c: Column, tags: list[str]) -> Column:
    """Bare tags unwrapped, one pass per tag in order; a body with markup in it stays as it is."""
    return reduce(lambda x, t: F.regexp_replace(x, f"<{t}>([^<]*)</{t}>", "$1"), tags, c)


def remove_tags_with_attributes(c: Column, tags: list[str]) -> Column:
    """The same for tags with attributes."""
    return reduce(lambda x, t: F.regexp_replace(x, f"<{t}[^>]*>([^<]*)</{t}>", "$1"), tags, c)


def _untagged(c: Column) -> Column:
    c = F.regexp_replace(c, "<!--[^-]*-->", "")
    c = remove_tags_with_attributes(remove_tags(c, BARE_TAGS), ATTRIBUTE_TAGS)
    return F.replace(F.replace(c, F.lit("<br>"), F.lit(" ")), F.lit("<br />"), F.lit(" "))


def _plain(c: Column) -> Column:
    c = F.lower(c)
    return F.when(F.contains(c, F.lit("<")), _untagged(c)).otherwise(c)  # most texts need none of the passes over tags


def _spaced(c: Column, signs: str) -> Column:
    """One blank for each run of ``signs``, none at either end."""
    return F.trim(F.regexp_replace(c, f"[{signs}]+", " "))


def normalize(c: Column, entities: bool = True) -> Column:
    """Lower-case words parted by one blank; the signs of KEEP are words of their own.

    Markup in ``entities`` form is resolved first unless the caller knows that there is none.
    """
    c = _plain(unescape(c) if entities else c)
    return _spaced(F.regexp_replace(c, f"([{KEEP_CLASS}])", " $1 "), DROP_CLASS)


def normalize_no_delimiters(c: Column, entities: bool = True) -> Column:
    """As :func:`normalize`, without the signs of KEEP."""
    return _spaced(_plain(unescape(c) if entities else c), DROP_CLASS + KEEP_CLASS)


def capitalize_first(c: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def trim_controls(c: Column) -> Column:
    """Without blanks and control characters (up to U+0020) at either end."""
    return F.regexp_replace(c, r"^[\x01-\x20]+|[\x01-\x20]+$", "")


def process_target(c: Column, entities: bool = True) -> Column:
    """A link target as a title: no comments, no ref tags, blanks for underscores, first letter large, percent signs decoded where possible."""
    c = unescape(c) if entities else c
    c = remove_tags(F.regexp_replace(c, "<!--[^-]*-->", ""), ["ref"])
    c = capitalize_first(trim_controls(F.replace(c, F.lit("_"), F.lit(" "))))
    return trim_controls(F.when(F.contains(c, F.lit("%")), F.coalesce(F.try_url_decode(c), c)).otherwise(c))


def remove_hash(c: Column) -> Column:
    """The part before the first number sign."""
    return F.substring_index(c, "#", 1)


def is_list_page(title: Column) -> Column:
    """Titles of list pages; the second form has no blank after it."""
    return title.startswith("List of ") | title.startswith("list of")


def is_disambiguation(title: Column) -> Column:
    """Titles of disambiguation pages."""
    return title.contains("(disambiguation)")


def is_namespace(title: Column) -> Column:
    """Titles in a namespace (categories and the like)."""
    return title.contains(":")


def window_around(text: Column, offset: Column, length: Column, reach: int = 50) -> Column:
    """The text from ``reach`` characters before a span to ``reach`` after it; offset counts from 0."""
    begin = F.greatest(offset - reach, F.lit(0))
    return F.substr(text, (begin + 1).cast("int"), (offset + length + reach - begin).cast("int"))


def count_occurrences(part: Column, text: Column, true_count: bool = False) -> Column:
    """Whether ``part`` occurs (0 or 1), or how often with ``true_count``, without overlaps."""
    if not true_count:
        return (F.locate(part, text) > 0).cast("int") if isinstance(part, str) else F.contains(text, part).cast("int")
    return F.try_divide(F.length(text) - F.length(F.replace(text, part)), F.length(part)).cast("int")


def keyphraseness_pair(c: Column) -> tuple[Column, Column]:
    """Linked and total of ``(linked, total)``."""
    pattern = r"\((\d+),\s+(\d+)"
    return F.regexp_extract(c, pattern, 1).cast("int"), F.regexp_extract(c, pattern, 2).cast("int")
