"""A lenient reading of HTML into block elements and runs of text."""

from __future__ import annotations

import re
from html import unescape

_names = lambda text: frozenset(text.split())

# Elements by what they mean for blocks of text.
INLINE = _names(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr label img br picture source map area"
)
VOID = _names("area base br col embed hr img input link meta param source track wbr")
#: Elements whose text doesn't count. The first ones hold raw text, to the page's end if they aren't closed.
RAW = _names("script style textarea title")
SKIPPED = RAW | _names("noscript template svg math iframe object canvas audio video select datalist")
CLOSED_BY_BLOCK = _names("p")
#: An opening element of the key closes an open element of the values, up to a border.
CLOSES = {
    "li": _names("li"), "dt": _names("dt dd"), "dd": _names("dt dd"), "tr": _names("tr td th"), "td": _names("td th"),
    "th": _names("td th"), "option": _names("option"), "thead": _names("tr td th"), "tbody": _names("tr td th thead"),
}
BORDERS = _names("ul ol dl table article section div main aside nav header footer form body")

_TAG = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|!--(?:.*?-->|.*\Z)|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""",
    re.S,
)
#: Where text and inline elements that stand among blocks form paragraphs of their own.
LOOSE = _names("#root body")
#: Words of an inline element's attributes for which it is an element to be judged, not just markup.
TELLING = _names(
    "ad ads advert advertisement banner breadcrumb byline comment comments copyright hidden menu meta nav notice promo promoted related"
    " share sharing skip social sponsor sponsored tags"
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _ends(html: str, name: str) -> dict[int, int]:
    """Where elements of a kind end, by the end of the opening tag; those without an end are left out."""
    ends, open_ = {}, []
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(html):
        if not m[1]:
            open_.append(m.end())
        elif open_:
            ends[open_.pop()] = m.end()
    return ends


def _described(rest: str) -> tuple[tuple[str, ...], str]:
    """The words of class, id and role, and a training mark."""
    words, mark = (), ""
    for a in _ATTRIBUTE.finditer(rest):
        value = a[2] or a[3] or a[4] or ""
        if (kind := a[1].lower()) == "data-y":
            mark = value
        elif kind == "hidden" or kind == "style" and "display:none" in value.replace(" ", ""):
            words += ("hidden",)
        elif kind != "style":
            words += tuple(w.lower() for w in _WORD.findall(value))
    return words, mark


class Page:
    """Elements to be judged in page order (number 0 is the root) and runs of text.

    These are block elements, inline elements whose attributes tell something, and the paragraphs that
    loose text forms between the blocks of the root and the body. ``tag``, ``parent``, ``words`` (of class,
    id and role) and ``mark`` (training label or '') are by element; ``runs`` are (element, block
    number, text, in a link?).
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.words, self.mark = ["#root"], [-1], [()], [""]
        self.runs: list[tuple[int, int, str, bool]] = []
        stack, block, link = [0], 0, -1  # link: depth of the stack when the link began
        inline: list[tuple[str, int]] = []  # open inline elements, with their place in the stack or -1
        ends: dict[str, dict[int, int]] = {}
        at, end = 0, len(html)
        search = _TAG.search

        loose = ""  # the mark of loose text, after a colon in that of the body

        def push(tag: str, words: tuple[str, ...], mark: str) -> None:
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.words.append(words)
            self.mark.append(mark)
            stack.append(len(self.tag) - 1)

        while at < end:
            m = search(html, at)
            start = m.start() if m else end
            if start > at:
                text = html[at:start]
                if self.tag[stack[-1]] in LOOSE and not text.isspace():
                    push("#loose", (), loose)
                self.runs.append((stack[-1], block, unescape(text) if "&" in text else text, link >= 0))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if name in INLINE:
                if name == "br":
                    self.runs.append((stack[-1], block, " ", False))
                elif closing:
                    if name == "a":
                        link = -1
                    for k in range(len(inline) - 1, -1, -1):
                        if inline[k][0] == name:
                            if 0 <= (place := inline[k][1]) < len(stack):
                                del stack[place:]
                            del inline[k:]
                            break
                elif name not in VOID:
                    words, mark = _described(rest) if rest else ((), "")
                    if not TELLING.isdisjoint(words):
                        inline.append((name, len(stack)))
                        push(name, words, mark)
                    elif inline:  # only those inside a telling one have to be paired
                        inline.append((name, -1))
                    if name == "a":
                        link = len(stack)
                continue
            block += 1
            if not closing and name in SKIPPED:
                if name in RAW:
                    close = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                    at = close.end() if close else at if rest.endswith("/") else end
                else:
                    if name not in ends:
                        ends[name] = _ends(html, name)
                    at = ends[name].get(at, at)
                continue
            inline.clear()
            if self.tag[stack[-1]] in INLINE or self.tag[stack[-1]] == "#loose":
                # a block ends paragraphs of loose text, and inline elements that are open
                k = len(stack) - 1
                while self.tag[stack[k]] in INLINE:
                    k -= 1
                del stack[k if self.tag[stack[k]] == "#loose" else k + 1 :]
            if link > len(stack):
                link = -1
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        break
                    if name == "p" and self.tag[stack[k]] in BORDERS:
                        break
                if link > len(stack):
                    link = -1
                continue
            if name in VOID or name == "html":
                continue
            closes = CLOSES.get(name, CLOSED_BY_BLOCK)
            for k in range(len(stack) - 1, 0, -1):
                here = self.tag[stack[k]]
                if here in closes or here == "p":
                    del stack[k:]
                    if name not in CLOSES:
                        break
                elif here in BORDERS:
                    break
            if link > len(stack):
                link = -1
            words, mark = _described(rest) if rest else ((), "")
            if ":" in mark:
                mark, loose = mark.split(":")
            push(name, words, mark)

    def text(self, kept: list[bool]) -> str:
        """Runs of kept elements: white space becomes one space, blocks are joined by a line end."""
        blocks: list[list[str]] = []
        last = None
        for node, block, text, _ in self.runs:
            if kept[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        joined = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(b for b in joined if b)
