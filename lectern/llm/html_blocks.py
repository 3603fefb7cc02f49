"""Leaf blocks of a web page: its visible text by block element, with what stands around it.

A page is read once from front to back: whatever is missing behind a place (a quote's end, an
end tag) is looked for once, and open elements are found by name, so the time grows with the
length of the page for any markup, however deep or broken.

An unclosed tag ends the page. A script, style, title or text area without an end tag hides
the rest of the page, as in browsers; other unseen elements without one hide nothing. A
self-closing unseen element, such as an empty drawing, ends at once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

# Names of HTML elements by the way they shape blocks.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title textarea noscript template iframe svg math canvas object audio video select datalist head".split())
RAW = frozenset("script style title textarea".split())
#: A start tag of the key closes an open element of the value above the given bounds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": (), "tbody": ("thead", "tbody"), "option": ("option",)}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",)}

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
_STEP = re.compile(r"[^>\"'=]*+([>\"'=]|\Z)")
_AFTER_EQUALS = re.compile(r"\s*+[\"']?")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|aria-label|aria-hidden|hidden|style)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+(?=[\s/>"']|$)""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_unseen_end: dict[str, re.Pattern] = {}


@dataclass
class Block:
    """One leaf block: raw text pieces, linked characters, and its ancestors' signs or their weight."""

    path: tuple[str, ...]
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    weight: float = 0.0

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


@dataclass
class _Element:
    name: str
    signs: tuple[str, ...]
    #: The signs of the nearest block element, itself included.
    own: tuple[str, ...]


@dataclass
class Tag:
    start: int
    end: int
    name: str
    closing: bool
    rest: str


def tags(page: str) -> Iterator[Tag]:
    """All tags, comments and declarations in order; the latter two have no name. ``send`` moves on to a later place."""
    at, gone = 0, set()

    def find(what: str, low: int) -> int:
        """The next place, looked for no more once there is none."""
        if what in gone:
            return -1
        found = page.find(what, low)
        if found < 0:
            gone.add(what)
        return found

    while True:
        got = _OPEN.search(page, at)
        if got is None:
            return
        name, low = (got[2] or "").lower(), got.end()
        if page.startswith("<!--", got.start()):
            stop = got.start() + 4
            if page.startswith(">", stop):
                end = stop + 1
            elif page.startswith("->", stop):
                end = stop + 2
            else:
                plain, bang = find("-->", stop), find("--!>", stop)
                end = min(x for x in (plain + 3 if plain >= 0 else len(page), bang + 4 if bang >= 0 else len(page)))
        elif not name:
            end = find(">", low) + 1 or len(page)
        else:
            end = low
            while True:
                step = _STEP.match(page, end)
                end = step.end()
                if step[1] == ">":
                    break
                if not step[1]:  # an unclosed tag ends the page
                    yield Tag(got.start(), len(page), "", False, "")
                    return
                if step[1] == "=":  # a value in quotes may hold anything
                    sign = _AFTER_EQUALS.match(page, end)
                    end = sign.end()
                    if sign[0][-1:] in ("'", '"') and sign[0]:
                        close = find(sign[0][-1], end)
                        end = close + 1 if close >= 0 else end
        moved = yield Tag(got.start(), end, name, bool(got[1]), page[low : end - 1] if name else "")
        at = moved if moved is not None else end


def signs(name: str, rest: str) -> tuple[str, ...]:
    """Features of one element: its name, and the words of its class, id and role."""
    out = [f"tag={name}"]
    for attribute, *values in _ATTRIBUTE.findall(rest) if rest.strip("/ \t\r\n") else ():
        key, value = attribute.lower(), next((v for v in values if v), "")
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("hidden")
        elif key in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                out.append("hidden")
        else:
            for token in _TOKEN.findall(html.unescape(value)):
                token = token.lower()
                out.append(f"word={token}")
                if len(token) > 4:
                    out.append(f"stem={token[:4]}")
            if key == "role":
                out.append(f"role={value.lower()}")
    return tuple(dict.fromkeys(out))


class _Open:
    """The open elements, found by name; and the signs that they have, each counted, with their summed weight."""

    def __init__(self, weigh: Callable[[str], float] | None):
        self.weigh = weigh
        self.stack = [_Element("#root", (), ())]
        self.at: dict[str, list[int]] = {}
        self.blocks = [0]
        self.count: dict[str, int] = {}
        self.total = 0.0
        self.links = 0

    def highest(self, names: tuple[str, ...]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def push(self, name: str, own: tuple[str, ...], extra: tuple[str, ...]) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.links += name == "a"
        self.stack.append(_Element(name, extra, own))
        for sign in extra:
            times = self.count.get(sign, 0)
            self.count[sign] = times + 1
            if not times and self.weigh:
                self.total += self.weigh(sign)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            gone = self.stack.pop()
            self.at[gone.name].pop()
            self.links -= gone.name == "a"
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            for sign in gone.signs:
                self.count[sign] -= 1
                if not self.count[sign]:
                    del self.count[sign]
                    if self.weigh:
                        self.total -= self.weigh(sign)

    def mark(self, block: Block) -> None:
        """Note on the block what stands around it: its signs' weight, or their names where there are no weights."""
        own = [f"own:{s}" for s in self.stack[-1].own]
        if self.weigh:
            block.weight = self.total + sum(map(self.weigh, own))
        else:
            block.path = (*self.count, *own)


def blocks(page: str, weigh: Callable[[str], float] | None = None) -> list[Block]:
    """The blocks of a page with any text, in page order.

    ``weigh`` gives a sign's weight; each block then has the sum in place of its path.
    """
    around, out, current, at, missing = _Open(weigh), [], Block(()), 0, set()

    def flush() -> None:
        nonlocal current
        if current.pieces and "".join(current.pieces).strip():
            out.append(current)
        current = Block(())

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece)
            if not current.pieces:
                around.mark(current)
            current.pieces.append(piece)
            if around.links:
                current.linked += len(piece.strip())

    reader, moved = tags(page), None
    while True:
        try:
            tag = reader.send(moved)
        except StopIteration:
            break
        text(page[at : tag.start])
        at, moved, name = tag.end, None, tag.name
        if not name:
            continue
        if name in UNSEEN and not tag.closing:
            if tag.rest.endswith("/") and name not in RAW:
                continue
            found = None
            if name not in missing:
                found = _unseen_end.setdefault(name, re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE)).search(page, at)
            if found:
                at = page.find(">", found.start()) + 1 or len(page)
            else:
                missing.add(name)
                if name in RAW:
                    at = len(page)
            moved = at
        elif name == "br":
            text(" ")
        elif tag.closing:
            if name in BLOCK:
                flush()
                around.pop_to(around.highest((name,)) or len(around.stack))
            elif (k := around.highest((name,))) > around.blocks[-1]:
                around.pop_to(k)
        elif name in BLOCK:
            flush()
            k = around.highest(CLOSES.get(name, ()))
            if k > around.highest(BOUNDS.get(name, ())):
                around.pop_to(k)
            if around.stack[around.blocks[-1]].name == "p":  # a paragraph ends where another block begins
                around.pop_to(around.blocks[-1])
            if name not in VOID:
                own = signs(name, tag.rest)
                around.push(name, own, own)
        elif name not in VOID and not tag.rest.endswith("/"):
            own = signs(name, tag.rest)
            around.push(name, around.stack[-1].own, tuple(s for s in own if not s.startswith("tag=") or name in ("button", "label")))
    text(page[at:])
    flush()
    return out
