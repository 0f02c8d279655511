"""Leaf blocks of a page: runs of text between the borders of block elements, each with the path of its elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: One piece of markup: comment, declaration or instruction, end tag, start tag. What matches none of them is text.
MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# HTML elements by their role in the markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: up to their end tag, or the end of the page if there is none.
RAW = frozenset("script style title textarea iframe noembed noframes".split())
#: The same, but skipped only if they are closed.
EMBEDDED = frozenset("template noscript object svg math canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends open elements of these names, up to one of the names after the bar.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}


@dataclass
class Node:
    """An open element: its name, the words of its class, id and role, and the element around it."""

    name: str
    words: tuple[str, ...]
    parent: Node | None
    depth: int
    mark: object = field(default=None, repr=False)


@dataclass
class Block:
    text: str
    node: Node
    linked: int  # characters inside links


def name_words(value: str) -> tuple[str, ...]:
    """Words of a class or id: cut at punctuation and inner capitals, in small letters."""
    return tuple(part.lower() for part in NAME_PART.findall(value))


def _words(rest: str) -> tuple[str, ...]:
    if "=" not in rest:
        return ()
    found = ATTRIBUTE.findall(rest)
    return tuple(word for _, *values in found for value in values if value for word in name_words(html.unescape(value)))


def _skip(name: str, page: str, start: int) -> int:
    """Where the content of an element without text of the page ends, end tag included."""
    found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, start)
    return found.end() if found else len(page) if name in RAW else start


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in order. White space inside a block is one space, at its ends none."""
    found: list[Block] = []
    top = Node("", (), None, 0)
    node, links, pieces, linked = top, 0, [], 0

    def close() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, node, min(linked, len(text))))
            pieces, linked = [], 0

    at = 0
    while at < len(page):
        match = MARKUP.search(page, at)
        text = page[at : match.start()] if match else page[at:]
        if text:
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            if links:
                linked += len(text)
        if not match:
            break
        at = match.end()
        if match["name"] is None:
            continue
        name = match["name"].lower()
        if match["end"]:
            if name == "a":
                links = 0
            elif name in BLOCK:
                close()
                links = 0
                opened = node
                while opened is not None and opened.name != name:
                    opened = opened.parent
                if opened is not None and opened.parent is not None:
                    node = opened.parent
            continue
        if name in RAW or name in EMBEDDED:
            at = _skip(name, page, at)
        elif name == "a":
            links = 1
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCK:
            close()
            links = 0
            if name in VOID:
                continue
            if node.name == "p":  # a paragraph holds no blocks
                node = node.parent
            ended, until = ENDS.get(name, ((), ()))
            open_one, to = node, None
            while ended and open_one.parent is not None and open_one.name not in until:
                to = open_one.parent if open_one.name in ended else to
                open_one = open_one.parent
            node = to or node
            node = Node(name, _words(match["rest"]), node, node.depth + 1)
    close()
    return found
