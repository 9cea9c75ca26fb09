"""The markup of a web page in one pass, whatever it looks like: each character is looked at a bounded number of times."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Elements whose content is no markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ENDS = {name: re.compile(f"</{name}(?![\\w-])[^>]*>?", re.I) for name in RAW}


def _tag_end(page: str, at: int) -> int:
    """Where the tag's '>' stands, past quoted values; -1 if quotes or the tag are never closed."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while page[before].isspace():
            before -= 1
        at = m.end()
        if page[before] == "=":
            at = page.find(m[0], at) + 1
            if not at:
                return -1
    return -1


def scan(page: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(what, name, inner, start, end) of each piece of markup; what lies between them is text.

    what: open (inner: attributes), close, comment (inner: its words), other. An open tag of ``RAW`` is followed by a
    piece raw (inner: its content) up to its end tag or the page's end. A '<' that begins no markup, or a tag that
    never ends, is text. Once a tag with its quotes doesn't end, quotes count for nothing in the rest of the page.
    """
    at, quotes = 0, True
    while (lt := page.find("<", at)) >= 0:
        sign = page[lt + 1 : lt + 2]
        if sign.isascii() and sign.isalpha():
            name = _NAME.match(page, lt + 1)
            begin = name.end()
            end = page.find(">", begin)
            if end < 0:
                return
            if quotes and (page.find('"', begin, end) >= 0 or page.find("'", begin, end) >= 0) and (closed := _tag_end(page, begin)) != end:
                quotes, end = closed >= 0, closed if closed >= 0 else end
            at = end + 1
            kind = name[0].lower()
            yield "open", kind, page[begin:end], lt, at
            if kind in RAW:
                close = _ENDS[kind].search(page, at)
                start, stop, at = at, *((close.start(), close.end()) if close else (len(page), len(page)))
                yield "raw", kind, page[start:stop], start, at
        elif page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            yield "comment", "", page[lt + 4 : end if end >= 0 else len(page)], lt, at
        elif sign == "/" and (name := _NAME.match(page, lt + 2)) or sign and sign in "/!?":
            at = page.find(">", lt) + 1
            if not at:
                return
            yield ("close", name[0].lower(), "", lt, at) if sign == "/" and name else ("other", "", "", lt, at)
        else:
            at = lt + 1
