"""Text leaves of an HTML body, by one scan of its tags.

A leaf is a stretch of text between block tags. It knows its tag, its region and whether it is one link. A region is
a child of the highest element that has several children, so a single wrapper around a page makes no difference.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

_HIDDEN = re.compile(r"<(script|noscript|style|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_CODE = re.compile(r"<(pre|code|kbd|samp|textarea)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>")
_HREF = re.compile(r"""href\s*=\s*["']?([^"'\s>]*)""", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_DESCRIPTION = re.compile(r"""<meta\b(?=[^>]*\bname\s*=\s*["']?description\b)[^>]*?\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.S | re.I)
_BODY = re.compile(r"<body\b[^>]*>", re.I)
#: Elements that don't end a stretch of text (fixed value).
INLINE = frozenset("a abbr b bdi bdo cite code del em font i ins kbd mark q s samp small span strong sub sup tt u var wbr img input button label time".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Leaf(NamedTuple):
    text: str
    tag: str
    region: int
    linked: int  # characters inside links
    href: str  # of the last link


def title_of(page: str) -> str:
    return unescape(m.group(1)).strip() if (m := _TITLE.search(page)) else ""


def description_of(page: str) -> str:
    return unescape(m.group(1) or m.group(2) or "").strip() if (m := _DESCRIPTION.search(page)) else ""


def leaves(page: str, code: bool = True) -> list[Leaf]:
    """The visible text of a page; without ``code``, samples of code are left out."""
    start = m.end() if (m := _BODY.search(page)) else 0
    body = _HIDDEN.sub("", page[start:])
    if not code:
        body = _CODE.sub(" ", body)
    found: list[tuple[str, str, int, int, str]] = []
    path: list[str] = []
    above: list[int] = [-1]  # the element that each element is in; 0 is the body
    depth: list[int] = [0]
    place: list[int] = [0]  # the elements that are open
    begun: list[int] = [0]  # of each of them, the last element that has begun in it, or itself
    text: list[str] = []
    linked, href, in_link, at = 0, "", False, 0
    block = "body"

    def flush() -> None:
        nonlocal linked, href
        if text:
            whole = "".join(text)
            if not whole.isspace():
                if "&" in whole:
                    whole = unescape(whole)
                found.append((whole, block, begun[-1], linked, href))
            text.clear()
        linked, href = 0, ""

    for m in _TAG.finditer(body):
        if m.start() > at:
            piece = body[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        closing, name, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if name == "a":
            in_link = not closing
            if in_link and (h := _HREF.search(attributes)):
                href = h.group(1)
            continue
        if name in INLINE:
            continue
        flush()
        if name in VOID:
            continue
        if not closing:
            begun[-1] = len(above)
            above.append(place[-1])
            depth.append(len(place))
            place.append(begun[-1])
            begun.append(begun[-1])
            path.append(name)
            block = name
        elif name in path:
            while path:
                place.pop()
                begun.pop()
                if path.pop() == name:
                    break
            block = path[-1] if path else "body"
    if at < len(body):
        text.append(body[at:])
    flush()
    if not found:
        return []
    top = found[0][2]  # the lowest element that holds all text
    for _, _, at, _, _ in found:
        while top != at:
            if depth[at] > depth[top]:
                at = above[at]
            else:
                top = above[top]
    names: dict[int, int] = {}
    child: dict[int, int] = {top: top}  # of an element, the child of the top that it is or lies in

    def region(at: int) -> int:
        way = []
        while at not in child and above[at] != top:
            way.append(at)
            at = above[at]
        out = child.setdefault(at, at)
        for x in way:
            child[x] = out
        return names.setdefault(out, len(names))

    return [Leaf(t, tag, region(at), k, h) for t, tag, at, k, h in found]
