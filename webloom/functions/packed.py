"""Grammar of several values packed into one string.

    field   <- outer* ( array / list ) outer* end
    array   <- '[' space* ( jstring ( space* ',' space* jstring )* )? space* ']'
    list    <- item? ( separator item? )*
    item    <- quoted / bracketed / bare
    quoted  <- '"' ( '""' / '\\\\' any / !'"' any )* '"' &( space* separator / space* end )
    bracketed <- '[' ( jstring / !']' any )* ']' &( space* separator / space* end )
    bare    <- ( !separator any )+

Alternatives are tried in this order, and the parser goes back when one fails: an opening quote
without a closing one before a separator or the end is an ordinary character of a bare value, flagged
``bad_quote``.  In a list of links a lone space separates as well, and ``,`` ``;`` ``|`` only do so
where a new value begins (after it comes a space, a quote, a scheme or the end).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

OK, BAD_QUOTE, BAD_BRACKET = "", "bad_quote", "bad_bracket"


class Value(NamedTuple):
    pos: int
    item: str
    error: str


# Separators of ordinary values; a slash only between spaces, as words may hold one.
_TEXT_SEP = re.compile(r"[ \u00a0]*(?:[,;|\n\r\t\u2022\u3001\uff0c\uff1b]|(?<=[ \u00a0])/(?=[ \u00a0]|$))")
_LINK_START = r'(?=[ \u00a0\n\r\t]|["\u201c\[]|[a-zA-Z][a-zA-Z0-9+.-]*:|//|www\.|[,;|]|$)'
_LINK_SEP = re.compile(r"[\n\r\t \u00a0]+(?:[,;|\u2022/](?=[ \u00a0\n\r\t]|$))?|[,;|\u2022]" + _LINK_START)
_SPACE = re.compile(r"[ \u00a0\n\r\t]*")
_QUOTED = re.compile(r'"((?:""|\\.|[^"\\])*)"', re.S)
_CURLY = re.compile("\u201c([^\u201d]*)\u201d", re.S)
_ARRAY = re.compile(r'\[\s*(?:"(?:\\.|[^"\\])*"(?:\s*,\s*"(?:\\.|[^"\\])*")*)?\s*,?\s*\]', re.S)
_JSTRING = re.compile(r'"((?:\\.|[^"\\])*)"', re.S)
_BRACKETED = re.compile(r'\[((?:"(?:\\.|[^"\\])*"|[^\]"])*)\]', re.S)
_MARKS = re.compile(r'""|\\(u[0-9a-fA-F]{4}|.)', re.S)
_JMARKS = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _plain(m: re.Match) -> str:
    mark = m.group(1)
    return '"' if mark is None else (mark if mark in '"\\/' or len(mark) == 1 else m.group(0))


def _jplain(m: re.Match) -> str:
    mark = m.group(1)
    if len(mark) > 1:
        return chr(int(mark[1:], 16))
    return _JMARKS.get(mark, mark)


_JESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)


class Packed:
    """Parser of one field; ``links`` chooses the separators."""

    def __init__(self, text: str, links: bool = False):
        self.text, self.sep, self.end = text, _LINK_SEP if links else _TEXT_SEP, len(text)

    def parse(self) -> Iterator[Value]:
        pos = 0
        for item, error in self._array() or self._list():
            item = item.strip(" \u00a0\t\r\n")
            if item:
                pos += 1
                yield Value(pos, item, error)

    def _array(self) -> list[tuple[str, str]] | None:
        body = self.text.strip()
        if _ARRAY.fullmatch(body):
            return [(_JESCAPE.sub(_jplain, m.group(1)), OK) for m in _JSTRING.finditer(body)] or [("", OK)]
        return None

    def _list(self) -> Iterator[tuple[str, str]]:
        at = 0
        while at < self.end:
            at = _SPACE.match(self.text, at).end()
            if at >= self.end:
                return
            if m := self.sep.match(self.text, at):
                at = m.end()
                continue
            at, found = self._quoted(at) or self._bracketed(at) or self._bare(at)
            yield from found

    def _closes(self, at: int) -> bool:
        """A separator or the end follows, spaces aside."""
        return at >= self.end or bool(self.sep.match(self.text, at)) or _SPACE.match(self.text, at).end() >= self.end

    def _quoted(self, at: int) -> tuple[int, list[tuple[str, str]]] | None:
        if m := _QUOTED.match(self.text, at):
            if self._closes(m.end()):
                return m.end(), [(_MARKS.sub(_plain, m.group(1)), OK)]
        elif m := _CURLY.match(self.text, at):
            if self._closes(m.end()):
                return m.end(), [(m.group(1), OK)]
        return None

    def _bracketed(self, at: int) -> tuple[int, list[tuple[str, str]]] | None:
        m = _BRACKETED.match(self.text, at)
        if not m or not self._closes(m.end()):
            return None
        if _ARRAY.fullmatch(m.group(0)):
            return m.end(), [(_JESCAPE.sub(_jplain, x.group(1)), OK) for x in _JSTRING.finditer(m.group(0))]
        return m.end(), [(m.group(0), OK)]

    def _bare(self, at: int) -> tuple[int, list[tuple[str, str]]]:
        m = self.sep.search(self.text, at + 1)
        stop = m.start() if m else self.end
        item = self.text[at:stop]
        return stop, [(item, BAD_QUOTE if item[0] == '"' or item.rstrip()[-1:] == '"' else BAD_BRACKET if item[0] == "[" else OK)]
