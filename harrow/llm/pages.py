"""Web pages and page excerpts as sequences of leaf blocks.

A leaf block is the visible text of one line between two block-level tags: a line of several
elements (a minified page is one line) has several blocks, an element of several lines too.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements whose content is never visible text of the page.
HIDDEN = frozenset(("script", "style", "title", "head", "template", "svg", "iframe", "object"))
#: Elements that hold blocks; the innermost open one is a block's container.
CONTAINERS = frozenset(("nav", "main", "aside", "footer", "header", "section", "article", "div", "table", "ul", "ol", "form", "body", "td"))
#: Elements whose tags end a block.
_BLOCK_LEVEL = CONTAINERS - {"td"} | frozenset(("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "dt", "dd", "blockquote", "pre", "figcaption", "option", "legend"))
_VOID = frozenset(("meta", "br", "img", "hr", "input", "link", "base", "wbr", "source", "area", "col"))

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)>|<!--.*?-->|<![^>]*>")
_LEAF = re.compile(r"<(p|span|div|li|h[1-6])(?: class=\"([^\"<>]*)\")?>(?:<a [^<>]*>([^<]*)</a>|([^<]*))</\1>\s*$")
#: A line that is one tag of a container.
_ALONE = re.compile(r"<(/?)(" + "|".join(sorted(CONTAINERS - {"td"})) + r")(?: class=\"([^\"'<>]*)\")?>\s*$")
_CLASS = re.compile(r"\bclass\s*=\s*[\"']?([^\"'>]*)")
_LEFTOVER = re.compile(r"<[/!]?[a-zA-Z][^<>]*$")


@dataclass(slots=True)
class Block:
    """The visible text of a line, or of one block-level element in it; ``path`` names the innermost three containers."""

    line: int
    text: str
    tag: str
    linked: bool
    container: str
    classes: str
    depth: int
    fresh: bool
    path: str = ""


def plain_blocks(text: str) -> list[Block]:
    """The lines of a text without markup that have visible characters."""
    out = []
    for n, raw in enumerate(text.split("\n"), 1):
        t = " ".join(raw.split())
        if t:
            out.append(Block(n, t, "text", False, "text", "", 0, False, "text"))
    return out


def is_markup(text: str) -> bool:
    """Whether a body is HTML rather than plain text."""
    return "<" in text and re.search(r"<(?:!doctype|html|body|head|div|p|h[1-6]|li|span|table|section|nav|main|center|title)\b", text, re.I) is not None


def html_blocks(body: str) -> list[Block]:
    """The leaf blocks of an HTML page, with their markup surroundings.

    Blocks between ``<head>`` and ``</head>`` and in hidden elements have no visible text.
    ``noscript`` counts as an element of its own. Broken markup never fails: an end tag that
    closes nothing is passed over, and what is open at the end stays open.
    """
    out: list[Block] = []
    hidden = ""
    within: list[tuple[str, str]] = []  # the open containers: name, class
    inner, kind_here, depth, path = "", "", 0, ""
    leaf = ""
    fresh = True
    for n, raw in enumerate(body.split("\n"), 1):
        if hidden and f"</{hidden}" not in raw.lower():
            continue
        simple = _LEAF.match(raw) if not hidden else None
        if simple is not None:  # the commonest lines: one leaf with its text, or a linked list entry
            leaf = ""
            name, kind, link, text = simple.groups()
            text = link if text is None else text
            text = _visible(text)
            if text:
                out.append(Block(n, text, name + ("." if kind is not None and name == "div" else ""), link is not None, inner, kind_here, depth, fresh, path))
                fresh = False
            continue
        alone = _ALONE.match(raw) if not hidden else None
        if alone is not None:  # nothing to see, only the surroundings change
            ends, name, kind = alone.groups()
            if not ends:
                within.append((name, kind.strip() if kind else ""))
            elif name == leaf:
                leaf = ""
                continue
            else:
                i = next((i for i in reversed(range(len(within))) if within[i][0] == name), None)
                if i is not None:
                    del within[i:]
            inner, kind_here, depth, path = _surroundings(within)
            fresh = True
            continue
        parts: list[str] = []
        at = 0
        first = ""
        linked = False
        place: tuple[str, str, int, bool, str] | None = None
        carried = leaf
        if "<" in raw:
            for m in _TAG.finditer(raw):
                if not hidden and m.start() > at:
                    piece = raw[at : m.start()]
                    parts.append(piece)
                    if place is None and not piece.isspace():
                        place = (inner, kind_here, depth, fresh, path)
                        fresh = False
                at = m.end()
                name = m[2]
                if name is None:
                    continue
                name = name.lower()
                if place is not None and name in _BLOCK_LEVEL:  # a block-level tag behind visible text ends the block
                    text = _joined(parts)
                    if text:
                        out.append(Block(n, text, first or (f"in-{carried}" if carried else "bare"), linked, *place))
                    parts, first, linked, place = [], "", False, None
                    carried = "" if m[1] and name == leaf else leaf
                if hidden:
                    if m[1] and name == hidden:
                        hidden = ""
                    continue
                if m[1]:
                    if name == leaf:
                        leaf = ""
                    elif name in CONTAINERS:
                        i = next((i for i in reversed(range(len(within))) if within[i][0] == name), None)
                        if i is not None:
                            del within[i:]
                            inner, kind_here, depth, path = _surroundings(within)
                        fresh = True
                    continue
                if name in HIDDEN:
                    hidden = name
                    continue
                if name in _VOID:
                    continue
                if name == "a":
                    linked = True
                elif name in CONTAINERS:
                    found = _CLASS.search(m[3] or "")
                    kind = found[1].strip() if found else ("wide" if "width" in (m[3] or "") else "span" if "colspan" in (m[3] or "") else "")
                    # A container that is closed on its own line is a leaf, not a surrounding, unless others are opened in it.
                    if name != "body" and _closed_first(raw, at, name):
                        first = first or (name + ("." if found else ""))
                        leaf = name
                    else:
                        if name == "td":
                            while within and within[-1][0] == "td":
                                within.pop()
                        within.append((name, kind))
                        inner, kind_here, depth, path = _surroundings(within)
                        fresh = True
                elif name not in ("html", "b", "i", "em", "strong", "u", "small", "font"):
                    first = first or name
                    leaf = name
            if not hidden:
                rest = raw[at:]
                parts.append(_LEFTOVER.sub("", rest) if "<" in rest else rest)
        elif not hidden:
            parts.append(raw)
        if not parts:
            continue
        text = _joined(parts)
        if text:
            if place is None:
                place = (inner, kind_here, depth, fresh, path)
                fresh = False
            out.append(Block(n, text, first or (f"in-{carried}" if carried else "bare"), linked, *place))
    return out


def _joined(parts: list[str]) -> str:
    """Pieces of visible text as one, entities decoded and white space collapsed."""
    return _visible(parts[0] if len(parts) == 1 else " ".join(parts))


def _visible(text: str) -> str:
    """A text with entities decoded and white space collapsed."""
    if "&" in text:
        text = html.unescape(text)
    if text.isprintable() and "  " not in text and text[:1] != " " != text[-1:]:  # the only white space that is printable is the blank
        return text
    return " ".join(text.split())


def _surroundings(within: list[tuple[str, str]]) -> tuple[str, str, int, str]:
    """Name and class of the innermost container, the depth, and the path of the innermost three."""
    name, kind = within[-1] if within else ("", "")
    return name, kind, len(within), ">".join([w[0] for w in within[-3:]])


def _closed_first(raw: str, at: int, name: str) -> bool:
    """Whether the element ``name`` opened before ``at`` is closed on the line before another block-level element begins in it."""
    for m in _TAG.finditer(raw, at):
        inside = (m[2] or "").lower()
        if m[1] and inside == name:
            return True
        if not m[1] and inside in _BLOCK_LEVEL and inside != "p":
            return False
    return False


def blocks_of(body: str | None) -> list[Block]:
    """The blocks of a body, whether HTML or plain text; none for NULL and empty."""
    if not body:
        return []
    return html_blocks(body) if is_markup(body) else plain_blocks(body)
