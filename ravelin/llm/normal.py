"""Evening out of text: markup, escapes, invisible characters and characters that print alike."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

#: Cyrillic and Greek letters that print like Latin ones (lower case).
ALIKE = dict(zip("асеоріјѕухһԁԛԝьвнкмтгαερονικτυχ", "aceopijsyxhdqwbbhkmtraeponiktux"))
#: Tags that break a line or a cell; all others print nothing between the letters beside them.
_BLOCK = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|th|table|h[1-6]|pre|blockquote|hr|section)\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.{0,400}?-->", re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtfv]))")
_LINK = re.compile(r"\]\([^()\s]{0,400}\)")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")


def _escaped(m: re.Match) -> str:
    return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " "


def unmarked(text: str) -> str:
    """``text`` without markup and with escapes resolved; block tags become spaces, inline tags vanish."""
    if "\\" in text:
        text = _ESCAPE.sub(_escaped, text).replace("\\", "")
    if "%" in text and _PERCENT.search(text):
        text = unquote(text, errors="replace")
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub(" ", text))
    if "](" in text:
        text = _LINK.sub(" ", text)
    return text


class _Letters(dict):
    """For str.translate: lower case, letters that print alike as Latin, marks and signs dropped."""

    def __init__(self, keep_signs: bool) -> None:
        self.keep_signs = keep_signs

    def __missing__(self, code: int):
        c = chr(code)
        kind = unicodedata.category(c)
        if c.isspace():
            out = "\n" if c == "\n" else " "
        elif kind in ("Cf", "Cc", "Mn", "Me", "Cn", "Co"):
            out = None
        elif kind[0] in "PS":
            out = c if self.keep_signs else None
        else:
            low = c.lower()
            out = ALIKE.get(low, low)
        self[code] = out
        return out


WORDS, SIGNS = _Letters(False), _Letters(True)


def plain(text: str, signs: bool = False) -> str:
    """``text`` in lower case, compatibility forms and look-alikes resolved, invisible characters gone.

    Without ``signs``, everything but letters, digits and white space is dropped.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.translate(SIGNS if signs else WORDS)
