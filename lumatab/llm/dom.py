"""A lenient HTML reader that keeps block-level elements as nodes and the text blocks between their borders."""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Everything up to the end tag is no markup and no text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never shown as the page's: choices of forms, and templates.
SILENT = frozenset("template select datalist".split())
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
#: Opening one of these ends an open element of the second set, up to a border.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "option": {"option"}}
_BORDER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_P_BORDER = frozenset("table td th caption button object template html body".split())
_CELLS = frozenset(("table", "td", "th"))
#: End tags that reach past a cell or table, besides those of blocks.
_TABLE_PARTS = frozenset("table tr tbody thead tfoot body html".split())

_TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)"
)
_MAYBE_HIDDEN = re.compile("hidden|style", re.I)
#: One attribute after the other, so that nothing within a value is taken for a name.
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]++)))?+")
_NAMES = frozenset(("class", "id", "role", "itemprop"))


def attributes(rest: str) -> dict[str, str]:
    """The attributes of a start tag; of repeated ones the first counts, as in browsers."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(rest):
        found.setdefault(name.lower(), a or b or c)
    return found


def hidden(found: dict[str, str]) -> bool:
    """Whether an element with these attributes is not shown: by hidden, aria-hidden, or the display that its style ends with."""
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true":
        return True
    said = _DISPLAY.findall(_html.unescape(found.get("style", "")))
    return bool(said) and ([v for v, strong in said if strong] or [v for v, _ in said])[-1].lower() == "none"


@dataclass
class Page:
    """Nodes in page order; node 0 is the page itself. A block is the text between two block borders."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])  # class, id and role of a node
    mark: list[str] = field(default_factory=lambda: [""])  # of training pages
    tags: list[int] = field(default_factory=lambda: [0])  # elements that are no nodes, by node
    links: list[int] = field(default_factory=lambda: [0])  # characters in links, by node
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _embody(page: Page) -> None:
    """Moves text directly under the page into its body, as browsers do: the page's own, else its html element, else an implied node."""
    if all(node for node, _ in page.blocks):
        return
    top = [i for i in range(1, len(page.tag)) if page.parent[i] == 0 or page.tag[page.parent[i]] == "html"]
    body = next((i for name in ("body", "html") for i in top if page.tag[i] == name), 0)
    if not body:
        body = 1
        page.parent[1:] = [0, *(p + 1 if p else 1 for p in page.parent[1:])]
        page.blocks = [(node + 1 if node else 0, text) for node, text in page.blocks]
        for values, value in ((page.tag, "body"), (page.names, ""), (page.mark, ""), (page.tags, 0), (page.links, 0)):
            values.insert(1, value)
    page.blocks = [(node or body, text) for node, text in page.blocks]
    for counts in (page.tags, page.links):
        counts[body] += counts[0]
        counts[0] = 0


class _Open:
    """Open elements. Of each name, and of each kind of border, the depths are at hand, so no tag looks through the elements above it."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.at: dict[str, list[int]] = {}
        self.cells: list[int] = []
        self.paragraph_ends: list[int] = []
        self.silent: list[int] = []

    def push(self, name: str, node: int) -> None:
        depth = len(self.stack)
        self.stack.append((name, node))
        self.at.setdefault(name, []).append(depth)
        if name in _CELLS:
            self.cells.append(depth)
        if name in _P_BORDER:
            self.paragraph_ends.append(depth)

    def last(self, names) -> int:
        """The depth of the innermost open element of one of these names, or 0."""
        return max((depths[-1] for name in names if (depths := self.at.get(name))), default=0)

    def pop(self, depth: int) -> None:
        """Closes all elements from that depth on."""
        for name, _ in self.stack[depth:]:
            self.at[name].pop()
        del self.stack[depth:]
        for depths in (self.cells, self.paragraph_ends, self.silent):
            while depths and depths[-1] >= depth:
                depths.pop()


def read(source: str | None) -> Page:
    """The page, in time proportional to its length."""
    page = Page()
    text = source or ""
    opened = _Open()
    stack, silent = opened.stack, opened.silent
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            block = " ".join("".join(parts).split())
            if block:
                page.blocks.append((stack[-1][1], block))
            parts.clear()

    def say(piece: str) -> None:
        if silent or not piece:
            return
        if "&" in piece:
            piece = _html.unescape(piece)
        parts.append(piece)
        if opened.at.get("a"):
            page.links[stack[-1][1]] += len(piece.strip())

    def close(depth: int) -> None:
        if any(name in BLOCK for name, _ in stack[depth:]):
            flush()  # while its node is open
        opened.pop(depth)

    while at < len(text):
        m = _TOKEN.search(text, at)
        if m is None:
            say(text[at:])
            break
        say(text[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "br":
                parts.append(" ")
                continue
            depth = opened.last((name,))
            if depth and (name in BLOCK or name in _TABLE_PARTS or not opened.cells or depth >= opened.cells[-1]):
                close(depth)
            continue
        name = (m[2] or m[4] or "").lower()
        if not name:
            continue
        rest = m[3] if m[2] else m[5]
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}[^>]*>?", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if name in VOID and name != "hr":
            if name == "br":
                parts.append(" ")
            page.tags[stack[-1][1]] += 1
            continue
        if name in _ENDS:
            depth = opened.last(_ENDS[name])
            if depth > opened.last(_BORDER[name]):
                close(depth)
        found = attributes(rest) if rest and (name in BLOCK or _MAYBE_HIDDEN.search(rest)) else {}
        if name in BLOCK:
            depth = opened.last(("p",))
            if depth and (not opened.paragraph_ends or depth > opened.paragraph_ends[-1]):
                close(depth)
            flush()
            if name == "hr":
                continue
            page.tag.append(name)
            page.parent.append(stack[-1][1])
            page.names.append(" ".join(v for k, v in found.items() if k in _NAMES))
            page.mark.append(found.get("data-y", ""))
            page.tags.append(0)
            page.links.append(0)
            opened.push(name, len(page.tag) - 1)
        else:
            page.tags[stack[-1][1]] += 1
            if rest and rest.endswith("/") and name not in ("a", "b", "i", "span", "em", "strong"):
                continue
            opened.push(name, stack[-1][1])
        if name in SILENT or found and hidden(found):
            silent.append(len(stack) - 1)
    flush()
    _embody(page)
    return page
