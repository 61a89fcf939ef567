"""Web pages written by rule, whose block elements say whether they belong to the article.

The attribute ``data-y`` is 1 on elements that hold article text and 0 on all others; on the body the
mark of its loose text follows after a colon. The rule varies what sites vary: semantic elements or plain divisions, naming, order, article
length, lists and tables in articles, and menus, headers, notices, adverts, sidebars,
forms, related links, footers and readers' comments inside or around the article.
"""

from __future__ import annotations

import random
from collections.abc import Iterator


#: Names that say nothing, and names of an article's parts that have words of other things in them.
NEUTRAL = "c x1 inner wrap row col block section part box-2 grid item"
HOSTILE = "share-price comment-free ad-hoc notice footer-note header-text widget-story promo-text related-law search-party bar-chart tags-game social-history privacy-law cookie-recipe"


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        letters = "aeiounrstlmdhc"
        return " ".join("".join(self.r.choices(letters, k=self.r.randint(1, 10))) for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 25) -> str:
        text = self.words(low, high).capitalize()
        if self.r.random() < 0.4:
            text = text.replace(" ", ", ", 1)
        return text + self.r.choice("....?!")

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def maybe(self, chance: float, text: str) -> str:
        return text if self.r.random() < chance else ""

    def box(self, tag: str, label: int | str, inside: str, names: str = "", close: bool = True) -> str:
        """An element; ``names`` are choices for class or id, of which none may be used."""
        attribute = ""
        if names and self.r.random() < 0.92:
            name = self.r.choice(names.split())
            if self.r.random() < 0.3:
                name += self.r.choice(("-1", "-top", " wide", "_x", " box"))
            attribute = f' {self.r.choice(("class", "class", "id"))}="{name}"'
        return f'<{tag}{attribute} data-y="{label}">{inside}' + (f"</{tag}>" if close else "")

    def links(self, label: int, low: int = 2, high: int = 9) -> str:
        each = [f'<a href="/x{i}">{self.words(1, 4)}</a>' for i in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return self.box("ul", label, "".join(self.box("li", label, a) for a in each))
        return " ".join(each) if self.r.random() < 0.5 else "".join(self.box("div", label, a) for a in each)

    def navigation(self) -> str:
        tag = self.r.choice(("nav", "nav", "div", "ul"))
        if tag == "ul":
            return self.box("ul", 0, "".join(self.box("li", 0, f'<a href="#">{self.words(1, 3)}</a>') for _ in range(5)), "menu nav navbar")
        return self.box(tag, 0, self.links(0), "menu nav navbar main-menu breadcrumbs navigation topbar")

    def header(self) -> str:
        inside = self.maybe(0.7, self.box(self.r.choice(("h1", "div", "p")), 0, f'<a href="/">{self.words(1, 4)}</a>'))
        inside += self.maybe(0.4, self.box("p", 0, self.sentence(2, 8))) + self.maybe(0.5, self.navigation())
        inside += self.maybe(0.2, self.form())
        return self.box(self.r.choice(("header", "header", "div")), 0, inside or self.words(1, 5), "header masthead site-header banner top")

    def notice(self) -> str:
        inside = self.box("p", 0, self.prose(1, 3)) if self.r.random() < 0.6 else self.prose(1, 2)
        inside += self.maybe(0.6, self.box("button", 0, self.words(1, 2)))
        return self.box(self.r.choice(("div", "div", "section", "aside")), 0, inside, "cookie-notice notice consent gdpr warning cookies privacy-notice")

    def advert(self) -> str:
        inside = self.sentence() if self.r.random() < 0.6 else self.box("p", 0, self.prose(1, 2))
        return self.box(self.r.choice(("div", "div", "aside", "section")), 0, inside + self.maybe(0.3, f'<a href="/ad">{self.words(1, 3)}</a>'), "ad ads advert sponsored promo ad-banner adsbygoogle promoted")

    def form(self) -> str:
        inside = self.box("p", 0, self.sentence(3, 12)) + '<input type="text" name="q">' + self.box("button", 0, self.words(1, 2))
        return self.box("form", 0, inside, "search newsletter subscribe login signup")

    def sidebar(self) -> str:
        inside = ""
        for _ in range(self.r.randint(1, 3)):
            part = self.maybe(0.7, self.box(self.r.choice(("h3", "h2", "h4")), 0, self.words(1, 4)))
            part += self.links(0) if self.r.random() < 0.5 else self.box("p", 0, self.prose(1, 3))
            inside += self.box("div", 0, part, "widget box recent") if self.r.random() < 0.6 else part
        return self.box(self.r.choice(("aside", "aside", "div")), 0, inside, "sidebar side widgets rail complementary")

    def related(self) -> str:
        return self.box(self.r.choice(("div", "section", "aside")), 0, self.box("h3", 0, self.words(1, 4)) + self.links(0), "related recommended more-links share social tags")

    def comments(self) -> str:
        inside = self.maybe(0.8, self.box(self.r.choice(("h2", "h3")), 0, self.words(1, 3)))
        for _ in range(self.r.randint(1, 6)):
            one = self.maybe(0.6, self.box(self.r.choice(("p", "div", "span")), 0, self.words(1, 3), "author meta"))
            one += "".join(self.box("p", 0, self.prose(1, 4)) for _ in range(self.r.randint(1, 3)))
            inside += self.box(self.r.choice(("div", "li", "article")), 0, one, "comment reply comment-body")
        inside += self.maybe(0.4, self.form())
        return self.box(self.r.choice(("section", "div", "ol")), 0, inside, "comments replies disqus comment-list respond discussion comments-area")

    def footer(self) -> str:
        inside = self.r.choice(("&copy; ", "© ", "Copyright ")) + self.words(1, 3) + self.maybe(0.5, " &middot; " + self.sentence())
        if self.r.random() < 0.4:
            inside = self.box("p", 0, inside) + self.maybe(0.5, self.links(0)) + self.maybe(0.3, self.box("p", 0, self.prose(1, 3)))
        return self.box(self.r.choice(("footer", "footer", "div")), 0, inside, "footer site-footer bottom contentinfo copyright page-footer")

    def hidden(self) -> str:
        how = self.r.choice(("hidden", 'style="display:none"', 'style="display: none"', 'class="hidden"'))
        tag = self.r.choice(("div", "p", "section"))
        return f'<{tag} {how} data-y="0">{self.prose(1, 3)}</{tag}>'

    def aside_words(self) -> str:
        """Inline words that aren't the article's."""
        names = "ad advert advertisement sponsored promo share share-links byline comment-count meta hidden notice tags copyright"
        how = f'class="{self.r.choice(names.split())}"' if self.r.random() < 0.8 else self.r.choice(("hidden", 'style="display:none"'))
        tag = self.r.choice(("span", "span", "small", "em", "a"))
        return f'<{tag} {how} data-y="0">{self.words(1, 9) if self.r.random() < 0.6 else self.sentence()}</{tag}>'

    def loose_article(self) -> str:
        """Paragraphs right in the body, with line breaks or blocks between them."""
        parts = []
        for _ in range(self.r.choice((1, 2, 4, 8, 14))):
            text = self.prose(1, self.r.choice((2, 4, 9)))
            if self.r.random() < 0.2:
                text = f"<b>{self.sentence()}</b> {text}"
            parts.append(text)
        gap = self.r.choice(("<br><br>", "<br><br>", "<hr>", "\n"))
        extra = self.maybe(0.3, self.advert())
        k = self.r.randint(0, len(parts))
        return self.maybe(0.7, self.box("h1", 1, self.words(1, 10))) + gap.join(parts[:k]) + extra + gap.join(parts[k:])

    def loose_words(self) -> str:
        """Words between the blocks that belong to none."""
        kind = self.r.random()
        if kind < 0.4:
            return f'<a href="#main">{self.words(1, 4)}</a> '
        return self.words(1, 5) if kind < 0.8 else " | ".join(f'<a href="/{i}">{self.words(1, 2)}</a>' for i in range(4))

    def article(self) -> str:
        loose = self.r.random() < 0.3  # paragraphs aren't closed
        parts = []
        size = self.r.choice((1, 1, 2, 3, 5, 8, 13, 25))
        for _ in range(size):
            kind = self.r.random()
            if kind < 0.78:
                text = self.prose(1, self.r.choice((1, 2, 4, 9)))
                text = text if self.r.random() < 0.7 else f"<b>{self.sentence()}<br>{text}" if loose else f"<b>{self.sentence()}</b> {text}"
                if self.r.random() < 0.15:
                    text += f' <a href="/l">{self.words(1, 5)}</a> {self.sentence()}'
                if self.r.random() < 0.08:
                    text = text + " " + self.aside_words() if self.r.random() < 0.6 else self.aside_words() + " " + text
                parts.append(self.box("p", 1, text, close=not loose))
            elif kind < 0.84:
                parts.append(self.box(self.r.choice(("h2", "h3")), 1, self.words(1, 8)))
            elif kind < 0.89:
                parts.append(self.box(self.r.choice(("ul", "ol")), 1, "".join(self.box("li", 1, self.prose(1, 2)) for _ in range(self.r.randint(2, 6)))))
            elif kind < 0.92:
                parts.append(self.box("blockquote", 1, self.box("p", 1, self.prose(1, 3)) if self.r.random() < 0.5 else self.prose(1, 3)))
            elif kind < 0.94:
                rows = "".join(self.box("tr", 1, "".join(self.box("td", 1, self.words(1, 4)) for _ in range(3))) for _ in range(self.r.randint(2, 5)))
                parts.append(self.box("table", 1, rows))
            elif kind < 0.96:
                parts.append(self.box(self.r.choice(("pre", "figure")), 1, self.words(3, 20)))
            else:
                parts.append(self.box("div", 1, self.prose(1, 3)))
        if self.r.random() < 0.08:  # names that speak against an article on parts of it
            k = self.r.randrange(len(parts))
            parts[k] = self.box(self.r.choice(("p", "p", "div", "h2", "blockquote")), 1, self.prose(1, self.r.choice((1, 4))), HOSTILE)
        if not loose and self.r.random() < 0.3:
            parts = self.sections(parts)
        for extra, chance in ((self.advert, 0.15), (self.form, 0.08), (self.related, 0.1), (self.notice, 0.06), (self.sidebar, 0.05), (self.hidden, 0.05)):
            if self.r.random() < chance:
                parts.insert(self.r.randint(0, len(parts)), extra())
        title = self.box(self.r.choice(("h1", "h1", "h1", "h2")), 1, self.words(1, 12)) if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.12:
            title = self.box("header", 1, title)
        return title + "".join(parts)

    def sections(self, parts: list[str]) -> list[str]:
        """The parts of an article dealt to sections, each mostly with a heading."""
        tag, names = self.r.choice(("div", "div", "section")), self.r.choice(("", "", NEUTRAL))
        out, k = [], 0
        while k < len(parts):
            size = self.r.choice((1, 1, 2, 3, 6))
            inside = "".join(parts[k : k + size])
            inside = self.maybe(0.8, self.box(self.r.choice(("h2", "h2", "h3")), 1, self.words(1, 6))) + inside
            if self.r.random() < 0.2:
                inside = self.box("div", 1, inside, names)
            out.append(self.box(tag, 1, inside, names))
            k += size
        return out

    def plain_page(self) -> str:
        """An article in divisions that no name tells from others, with little around it."""
        inside = "".join(self.box("p", 1, self.prose(1, 4)) for _ in range(self.r.choice((1, 1, 2, 2, 3, 5))))
        inside = self.maybe(0.8, self.box(self.r.choice(("h1", "h2", "h2", "h3")), 1, self.words(1, 8))) + inside
        if self.r.random() < 0.4:
            again = "".join(self.box("p", 1, self.prose(1, 4)) for _ in range(self.r.randint(1, 3)))
            inside = self.box("div", 1, inside) + self.box("div", 1, self.maybe(0.8, self.box("h2", 1, self.words(1, 6))) + again)
        for _ in range(self.r.choice((0, 1, 1, 2))):
            inside = self.box("div", 1, inside, self.r.choice(("", NEUTRAL)))
        before = self.maybe(0.3, self.notice()) + self.maybe(0.3, self.navigation()) + self.maybe(0.15, self.header())
        after = self.maybe(0.3, self.footer()) + self.maybe(0.15, self.comments()) + self.maybe(0.15, self.advert())
        body = before + inside + after
        return f'<html><body data-y="1:0">{body}</body></html>' if self.r.random() < 0.6 else body

    def fragment(self) -> str:
        """An article without a page around it."""
        tag, text = self.r.choice((("h1", self.words(1, 10)), ("p", self.prose(1, 4)), ("p", self.prose(1, 4))))
        first = self.box(tag, "1:1", text)
        rest = self.r.choice((self.loose_article, self.article, lambda: self.prose(1, 4), lambda: self.box("p", 1, self.prose(1, 4))))()
        return first + rest

    def page(self) -> str:
        if self.r.random() < 0.08:
            return self.fragment()
        if self.r.random() < 0.15:
            return self.plain_page()
        inside = self.article()
        if self.r.random() < 0.15:
            inside += self.comments()
        if self.r.random() < 0.1:
            inside += self.box("footer", 0, self.sentence(2, 10), "post-meta tags share")
        shell = self.r.random()
        if shell < 0.45:
            main = self.box("article", 1, inside, self.maybe(0.3, "post entry story article"))
        elif shell < 0.6:
            main = self.box("main", 1, self.box("article", 1, inside) if self.r.random() < 0.5 else inside, self.maybe(0.4, "main content"))
        elif shell < 0.93:
            main = self.box("div", 1, inside, "content main post entry-content article-body story text main-content post-body prose")
        else:
            main = inside
        bare = self.r.random() < 0.1
        if bare:
            main = self.loose_article()
        elif self.r.random() < 0.2:
            main = self.box("div", 1, main + self.maybe(0.5, self.sidebar()), "wrapper container page row layout")
        before = [x for x, c in ((self.header, 0.4), (self.navigation, 0.6), (self.notice, 0.25), (self.advert, 0.4)) if self.r.random() < c]
        after = [x for x, c in ((self.sidebar, 0.35), (self.related, 0.25), (self.comments, 0.25), (self.advert, 0.15), (self.form, 0.1), (self.notice, 0.15)) if self.r.random() < c]
        self.r.shuffle(before)
        self.r.shuffle(after)
        if self.r.random() < 0.12 and self.sidebar in after:
            after.remove(self.sidebar)
            before.append(self.sidebar)
        body = "".join(x() for x in before) + main + "".join(x() for x in after) + self.maybe(0.85, self.footer())
        if not bare:
            if self.r.random() < 0.15:
                body = self.box("div", 1, body, "wrapper container page site layout")
            body = self.maybe(0.15, self.loose_words()) + body + self.maybe(0.08, self.loose_words())
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var a='<p>';</script></head>"
        return f'<!DOCTYPE html><html>{head}<body data-y="1:{int(bare)}">{body}' + self.maybe(0.85, "</body></html>")


def labelled_pages(count: int) -> Iterator[str]:
    for i in range(count):
        yield Writer(1000 + i).page()
