"""A light tree of the block elements of a page, with the text of its blocks."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr "
                   "math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
                   "msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page. Of the first, nothing but the own end tag is markup, and without one
#: they run to the end of the page; those of the third nest.
RAW = frozenset("script style iframe textarea title".split())
SILENT = RAW | frozenset("noscript template object svg canvas audio video select button annotation annotation-xml".split())
NESTING = frozenset("template object svg".split())
CLOSES_P = frozenset("address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these names, unless one of the second lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""[>"']""")
_DECLARED = re.compile(r"<[!?]")
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
#: Where a silent element without an end tag ends: at the next tag of a block.
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(CLOSES_P | set(ENDS) | {'body', 'html', 'tbody', 'tfoot', 'thead'}))})(?=[\s/>])", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Tree:
    """Nodes in page order, the root first; ``blocks`` are (node, text, characters inside links)."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    names: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    parents: list[int] = field(default_factory=lambda: [-1])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def name_parts(attributes: str) -> frozenset[str]:
    """Lower-cased words of the values of class, id and role."""
    parts: set[str] = set()
    for groups in _HINT.findall(attributes):
        parts.update(x.lower() for x in _NAME_PART.findall(" ".join(groups)))
    return frozenset(parts)


@dataclass
class Token:
    """A tag, or a comment or declaration, which has no name."""

    start: int
    end: int
    closing: bool = False
    name: str = ""
    attributes: str = ""


class Tokens:
    """Tags of a page one after another, in time near the length of the page however broken it is.

    A tag ends at the first ">" outside quotes; where a quote in it never ends, or no such ">" follows, at the first
    ">". Text that no ">" follows holds no tag. A comment or declaration that is not closed runs to the end.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.failed: set[int] = set()  # opening quotes from which on no ">" outside quotes was found

    def after(self, at: int) -> Token | None:
        page = self.page
        while True:
            if at > self.last:
                found = _DECLARED.search(page, at)
                start = found.start() if found else -1
            else:
                start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return Token(start, end + 3 if end >= 0 else len(page))
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start + 2)
                return Token(start, end + 1 if end >= 0 else len(page))
            name = _NAME.match(page, start + 1) if start < self.last else None
            if name:
                end = self._end(name.end())
                return Token(start, end, bool(name[1]), name[2].lower(), page[name.end():end - 1])
            at = start + 1

    def _end(self, at: int) -> int:
        """Behind the ">" of the tag whose name ends at ``at``; some ">" follows."""
        page, opened, here = self.page, [], at
        while mark := _MARK.search(page, here):
            here = mark.start()
            if mark[0] == ">":
                return here + 1
            if here in self.failed:
                break
            opened.append(here)
            here = page.find(mark[0], here + 1) + 1
            if not here:
                break
        self.failed.update(opened)
        return page.find(">", at) + 1


def silent_ends(page: str, at: int) -> dict[int, int]:
    """From the end of each silent element's start tag from ``at`` on, the place behind its own end tag, where it has one."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {name: [] for name in SILENT - RAW}
    tokens = Tokens(page)
    while token := tokens.after(at):
        at, name = token.end, token.name
        if name not in SILENT:
            continue
        empty = token.attributes.endswith("/")
        if name in RAW:
            if not token.closing and not (empty and opened["svg"]):
                end = _CLOSING[name].search(page, at)
                at = end.end() if end else len(page)
        elif token.closing:
            if opened[name]:
                ends[opened[name].pop()] = at
        elif not (empty and name == "svg"):
            if name not in NESTING:
                opened[name].clear()
            opened[name].append(at)
    return ends


class Stack:
    """Open elements as (node, tag), the root first, with the depths of each tag and of all blocks, so that looking an
    element up takes no walk. Inline elements share their block's node."""

    def __init__(self):
        self.items = [(0, "#root")]
        self.depths: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, node: int, tag: str) -> None:
        self.depths.setdefault(tag, []).append(len(self.items))
        if tag not in INLINE:
            self.blocks.append(len(self.items))
        self.items.append((node, tag))

    def top(self, *tags: str) -> int:
        """Depth of the innermost open element of ``tags``; 0 for none."""
        return max((self.depths[tag][-1] for tag in tags if self.depths.get(tag)), default=0)

    def cut(self, depth: int) -> None:
        """Close the elements from ``depth`` on."""
        for _, tag in reversed(self.items[depth:]):
            self.depths[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
        del self.items[depth:]


def parse(page: str) -> Tree:
    """The tree of a page. Comments, silent elements and markup give no text; character references are decoded and
    white space is one space inside a block. Unclosed and stray tags are taken as browsers would in the plain cases; a
    silent element without an end tag, other than the raw ones, ends at the next tag of a block. Takes time near the
    length of the page."""
    tree, stack, tokens = Tree(), Stack(), Tokens(page)
    pieces: list[str] = []
    linked = 0
    ends_of: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            tree.blocks.append((stack.items[-1][0], text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        if stack.blocks[-1] >= depth:
            flush()
        stack.cut(depth)

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if stack.top("a"):
            linked += len(text.strip())

    at = 0
    while token := tokens.after(at):
        if token.start > at:
            add(page[at:token.start])
        at, name, attributes = token.end, token.name, token.attributes
        if not name:
            continue
        if token.closing:
            depth = stack.top(name)
            # an end tag of an inline element does not reach out of its block
            if depth and not (name in INLINE and depth < stack.blocks[-1]):
                close(depth)
            continue
        if name in SILENT:
            pieces.append(" ")
            if name == "svg" and attributes.endswith("/"):
                continue
            if name in RAW:
                end = _CLOSING[name].search(page, at)
                at = end.end() if end else len(page)
                continue
            if ends_of is None:
                ends_of = silent_ends(page, token.start)
            if at in ends_of:
                at = ends_of[at]
            else:
                end = _BLOCK.search(page, at)
                at = end.start() if end else len(page)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                pieces.append(" ")
            continue
        if name in INLINE:
            if name in ("mtd", "mtr"):
                pieces.append(" ")
            if name == "a" and stack.top("a"):  # links do not nest
                close(stack.top("a"))
            if not attributes.endswith("/"):
                stack.push(stack.items[-1][0], name)
            continue
        flush()
        ends, limits = ENDS.get(name, (set(), set()))
        if name in CLOSES_P:
            ends, limits = ends | {"p"}, limits | {"table", "td", "th"}
        depth = stack.top(*ends)
        if depth > stack.top(*limits):
            close(depth)
        tree.tags.append(name)
        tree.names.append(name_parts(attributes) if attributes else frozenset())
        tree.parents.append(stack.items[-1][0])
        stack.push(len(tree.tags) - 1, name)
    add(page[at:])
    flush()
    return tree
