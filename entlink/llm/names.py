"""Bringing freely typed names into a comparable form.

``undress`` removes what is not part of the name: encodings (HTML entities, percent signs, UTF-8 read
as Latin-1), invisible signs, look-alike letters of other scripts, letter case, accents, quotes and
brackets around it, link syntax before it and sections, parameters and remarks after it. ``words``
gives its words with abbreviations and ordinals written out. The tables below are rules of common
English usage, not of any one list.
"""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

#: Letters of other scripts that look like Latin ones (lower case).
LOOKALIKES = str.maketrans(
    {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
        "α": "a", "ε": "e", "ο": "o", "ρ": "p", "χ": "x", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "η": "n",
        "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d",
    }
)
#: Abbreviations and what they stand for.
SHORT = {
    "mt": "mount", "st": "saint", "riv": "river", "obs": "observatory", "rwy": "railway", "rly": "railway", "univ": "university",
    "mus": "museum", "symph": "symphony", "orch": "orchestra", "intl": "international", "penins": "peninsula", "pen": "peninsula",
    "co": "company", "btl": "battle", "sge": "siege", "cstl": "castle", "cath": "cathedral", "fc": "football club", "lighthse": "lighthouse", "capt": "captain",
}
ROMAN = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx"]
ORDINALS = ["", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth"]

_ESCAPED = re.compile(r"&(?:#\d+|#x[0-9a-f]+|[a-z]{2,8});", re.I)
_PERCENT = re.compile(r"%[0-9a-f]{2}", re.I)
_MISREAD = re.compile("[ÃãÅåÂâÄä][\u0080-¿‘’“”•–—˜™š›œžŸ€‚ƒ„…†‡ˆ‰Š‹ŒŽ]")
_MARKS = " \t\n\r.,;:!?\"'`*|=~<>“”„‘’‚«»‹›–—‐-_/"
_AHEAD = re.compile(r"^(?::?[a-z]{2,3}:(?=\S)|wiki/|w/|see\s+(?:also\s+)?|the\s+)")
_BEHIND = re.compile(r"(?:#.*|[?&](?:action|oldid|title|redirect)=.*|\s*\((?:page|article)\)|\s+(?:article|page)|,?\s+etc\.?|['’]s)$")
_AROUND = {"(": ")", "[": "]", "{": "}"}
_WORD = re.compile(r"[^\W_]+")


def _reread(m: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, read rightly; letter case of lead bytes may have been changed."""
    raw = bytearray()
    for k, c in enumerate(m):
        follows = k + 1 < len(m) and not (m[k + 1].isalnum() and m[k + 1].isascii())
        if c in "ãåâä" and follows:
            c = c.upper()
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return m
            raw.append(ord(c))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m


def fold(s: str) -> str:
    """Lower case without accents, compatibility forms, invisible signs and letters of look-alike scripts."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).casefold().translate(LOOKALIKES))
    return "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def undress(s: str) -> str:
    """The folded name without encodings, wrapping, link syntax and remarks."""
    for _ in range(3):
        if "&" in s and _ESCAPED.search(s):
            s = html.unescape(_ESCAPED.sub(lambda m: m[0].lower() if m[0][1:-1].lower() in ("nbsp", "amp", "quot", "lt", "gt", "apos") else m[0], s))
        if "%" in s and _PERCENT.search(s):
            s = unquote(s, errors="replace")
    if not s.isascii() and _MISREAD.search(s):
        s = _MISREAD.sub(lambda m: _reread(m[0]), s)
    s = fold(s).replace("_", " ").replace("⁄", "/")
    while True:
        before = s
        s = s.strip(_MARKS)
        if s and s[0] in _AROUND and s.endswith(_AROUND[s[0]]) and s.find(_AROUND[s[0]]) >= len(s.rstrip(_AROUND[s[0]])):
            s = s[1:-1]
        elif s and s[0] in _AROUND and _AROUND[s[0]] not in s:
            s = s[1:]
        s = _AHEAD.sub("", s)
        cut = _BEHIND.sub("", s)
        s = cut if cut.strip(_MARKS) else s
        if s == before:
            return s


def words(s: str) -> list[str]:
    """The words of an undressed name, abbreviations and ordinals written out."""
    found = _WORD.findall(s.replace("&", " and ").replace("+", " and "))
    out: list[str] = []
    for k, w in enumerate(found):
        last = out[-1] if out else ""
        if w == "house" and last == "light":
            out[-1] = "lighthouse"
        elif w == "c" and last == "f":
            out[-1:] = ["football", "club"]
        elif w in ORDINALS and last == "the":
            out[-1] = ROMAN[ORDINALS.index(w)]
        elif w.isdigit() and 0 < len(w) < 3 and 0 < int(w) < len(ROMAN) and k + 1 < len(found) and found[k + 1] == "of" and k:
            out.append(ROMAN[int(w)])
        elif w == "u" and k + 1 < len(found) and found[k + 1] == "of":
            out.append("university")
        elif w in SHORT:
            out.extend(SHORT[w].split())
        else:
            out.append(w)
    return out
