"""Labelled pages to train the extractor on: seeded, of many layouts, every block marked as content (data-y=1) or not."""

from __future__ import annotations

import random

# Names that sites give to the parts of a page.
NAMES = {
    "nav": ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumbs", "topnav", "pagination"],
    "head": ["header", "masthead", "site-header", "topbar", "page-header", "branding"],
    "foot": ["footer", "site-footer", "colophon", "page-footer", "copyright", "bottom"],
    "side": ["sidebar", "side", "widget", "widget-area", "rail", "secondary"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner-ad", "adbox"],
    "notice": ["notice", "cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal"],
    "form": ["newsletter", "subscribe", "signup", "search", "login", "contact-form"],
    "comments": ["comments", "comment-list", "disqus", "responses", "replies", "discussion"],
    "share": ["share", "social", "sharing", "social-links"],
    "related": ["related", "recommended", "more-stories", "see-also", "trending"],
    "body": ["content", "article", "post", "entry", "entry-content", "article-body", "story", "main-content", "post-body", "text"],
}
# What the headings of such parts say.
TITLES = {
    "comments": ["Comments", "3 comments", "Responses", "Leave a reply", "Kommentare", "12 Kommentare", "Commentaires", "Comentarios", "Discussion"],
    "related": ["Related stories", "See also", "Read more", "More from the region", "You may also like", "Most read", "Weitere Artikel", "Mehr zum Thema", "À lire aussi", "Voir aussi", "Artículos relacionados"],
    "ad": ["Advertisement", "Sponsored", "Anzeige", "Werbung", "Publicité", "Publicidad"],
    "form": ["Newsletter", "Subscribe", "Sign up for our newsletter", "Newsletter abonnieren"],
    "share": ["Share this article", "Follow us", "Artikel teilen", "Partager"],
}
SYLLABLES = ["ka", "lo", "mi", "ter", "an", "ti", "on", "sch", "re", "qu", "el", "ves", "o", "ur", "ing", "da", "pe", "con", "ña", "é"]


class Page:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.plain = rng.random() < 0.25  # names that say nothing

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(3, 18).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self, low: int = 1, high: int = 7) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.15:
            out += f' <a href="#">{self.words(1, 4)}</a> {self.sentence()}'
        if self.r.random() < 0.15:
            out = f"<b>{self.words(1, 4)}</b> {out}"
        if self.r.random() < 0.02:
            out += self.r.choice([f' <em class="x{self.r.randint(1, 9)}">{self.words(1, 3)}</em> ', f' <span class="{self.r.choice(NAMES[self.r.choice(["ad", "share", "related"])])}" data-y="0">{self.words(1, 8)}</span> ']) + self.sentence()
        return out

    def tag(self, name: str, inner: str, y: int, kind: str | None = None) -> str:
        attribute = ""
        if kind and not (self.plain and name in ("div", "section", "ul", "p")):
            attribute = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(NAMES[kind])}"'
        elif self.r.random() < 0.3:
            attribute = f' class="x{self.r.randint(1, 99)}"'
        return f'<{name}{attribute} data-y="{y}">{inner}</{name}>'

    def part(self, kind: str, names: list[str], inner: str) -> str:
        name = self.r.choice(names)
        own = {"nav": "nav", "header": "head", "footer": "foot", "aside": "side", "form": "form"}.get(name) == kind
        return self.tag(name, inner, 0, None if own and self.r.random() < 0.5 else kind)

    def wrapped(self, inner: str, y: int) -> str:
        for _ in range(self.r.choice([0, 0, 0, 0, 1, 1, 2, 4])):
            inner = f'<div data-y="{y}">{inner}</div>'
        return inner

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(2, 9))]
        return self.tag("ul", "".join(f'<li data-y="0">{x}</li>' for x in items), 0) if self.r.random() < 0.6 else self.r.choice([" | ", " "]).join(items)

    def comments(self) -> str:
        one = lambda: self.r.choice(['<li class="comment" data-y="0">{}</li>', '<div class="comment" data-y="0">{}</div>', '<article class="comment" data-y="0">{}</article>']).format(f'<p data-y="0">{self.prose(1, 3)}</p>')
        inner = f'<h3 data-y="0">{self.words(1, 3)}</h3>' * self.r.randint(0, 1) + "".join(one() for _ in range(self.r.randint(1, 5)))
        return f'<{(n := self.r.choice(["div", "section", "ol"]))} {self.r.choice(["class", "id"])}="{self.r.choice(NAMES["comments"])}" data-y="0">{inner}</{n}>'

    def aside(self) -> str:
        kind = self.r.choice(["ad", "share", "related", "form", "ad", "side"])
        if kind == "form":
            return self.part("form", ["form", "form", "div"], f'<p data-y="0">{self.sentence()}</p><label data-y="0">{self.word()}</label><input><button data-y="0">{self.word()}</button>')
        if kind == "side":
            return self.part("side", ["aside", "aside", "div"], self.prose(1, 3) if self.r.random() < 0.5 else f'<h4 data-y="0">{self.words(1, 3)}</h4>{self.links()}')
        if kind == "ad":
            inner = self.r.choice([self.prose(1, 2), f'<p data-y="0">{self.prose(1, 2)}</p>', f'<a href="#">{self.words(2, 8)}</a>'])
            return f'<{(n := self.r.choice(["div", "div", "aside", "section", "p"]))} class="{self.r.choice(NAMES["ad"])}" data-y="0">{inner}</{n}>'
        return self.part(kind, ["div", "div", "aside", "section"], self.links())

    def titled(self) -> str:
        """A part without a name, told by its heading; a block of its own, or laid beside the rest."""
        kind = self.r.choice(["comments", "related", "comments", "related", "share", "form", "ad"])
        title = self.r.choice(TITLES[kind])
        level = self.r.choice(["h2", "h3", "h3", "h4", "p", "div"]) if kind != "ad" else self.r.choice(["p", "div", "h4"])
        head = f'<{level} data-y="0">{title}</{level}>'
        if kind == "comments":
            n = self.r.choice(["p", "div", "li"])
            rest = "".join(f'<{n} data-y="0">{self.prose(1, 3)}</{n}>' for _ in range(self.r.randint(1, 5)))
            rest = f'<ul data-y="0">{rest}</ul>' if n == "li" else rest
        elif kind in ("ad", "form"):
            rest = f'<p data-y="0">{self.prose(1, 2)}</p>'
        else:
            rest = f'<ul data-y="0">{"".join(self.item() for _ in range(self.r.randint(2, 6)))}</ul>' if self.r.random() < 0.7 else f'<p data-y="0">{self.links()}</p>'
        n = self.r.choice(["div", "section", "section", "aside", ""])
        return f'<{n} data-y="0">{head}{rest}</{n}>' if n else head + rest

    def item(self) -> str:
        return f'<li data-y="0"><a href="/{self.word()}">{self.words(2, 8)}</a></li>'

    def tabular(self, inner: str) -> str:
        """A page laid out by a table: menus and notes in cells beside the text's."""
        cell = lambda x, y: f'<td data-y="{y}">{x}</td>'
        beside = self.r.choice([self.links(), self.links(), f'<p data-y="0">{self.links()}</p>'])
        cells = [cell(beside, 0), cell(inner, 1)]
        self.r.shuffle(cells)
        top = f'<tr data-y="0">{cell(self.links(), 0)}</tr>' if self.r.random() < 0.4 else ""
        return f'<table data-y="1"><tbody data-y="1">{top}<tr data-y="1">{"".join(cells)}</tr></tbody></table>'

    def block(self) -> str:
        p = lambda low=1, high=7: f'<p data-y="1">{self.prose(low, high)}' + ("</p>" if self.r.random() < 0.9 else "")
        pick = self.r.random()
        if pick < 0.58:
            return p()
        if pick < 0.68:
            return f'<p data-y="1">{self.words(1, 3)}.</p>'
        if pick < 0.76:
            return f'<h{(n := self.r.randint(2, 4))} data-y="1">{self.words(1, 8)}</h{n}>'
        if pick < 0.83:
            return self.tag(self.r.choice(["ul", "ol"]), "".join(f'<li data-y="1">{self.prose(1, 2)}</li>' for _ in range(self.r.randint(2, 6))), 1)
        if pick < 0.87:
            return f'<blockquote data-y="1">{p(1, 3)}</blockquote>'
        if pick < 0.9:
            return f'<figure data-y="1"><img><figcaption data-y="1">{self.sentence()}</figcaption></figure>'
        if pick < 0.93:
            row = lambda: "<tr data-y='1'>" + "".join(f"<td data-y='1'>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>"
            return f'<table data-y="1"><tbody data-y="1">{row()}{row()}</tbody></table>'
        return f'<div data-y="1">{p()}{p()}</div>' if self.r.random() < 0.3 else f'<div data-y="1">{self.prose()}</div>'

    def article(self) -> str:
        if self.r.random() < 0.04:  # a text of a few words
            return self.tag(self.r.choice(["article", "article", "main"]), self.wrapped(self.r.choice(["{}", '<p data-y="1">{}</p>']).format(self.words(1, 6)), 1), 1)
        inner = f'<h1 data-y="1">{self.words(2, 10)}</h1>' if self.r.random() < 0.8 else ""
        if self.r.random() < 0.12:
            inner += self.r.choice([f'<p data-y="1">{self.words(1, 4)}</p>', self.words(1, 5)])
        for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 12]) if not inner or self.r.random() < 0.9 else 0):
            inner += self.block()
            if self.r.random() < 0.06:
                inner += self.aside()
        inner = self.wrapped(inner, 1)
        if self.r.random() < 0.12:
            inner += self.comments()
        elif self.r.random() < 0.12:
            inner += self.titled()
        shape = self.r.random()
        if shape < 0.35:
            return self.tag("article", inner, 1, "body" if self.r.random() < 0.3 else None)
        if shape < 0.5:
            return self.tag("main", inner, 1)
        if shape < 0.6:
            return self.tag("main", self.tag("article", inner, 1), 1)
        if shape < 0.9:
            return self.tag(self.r.choice(["div", "div", "section"]), self.tag("div", inner, 1, "body") if self.r.random() < 0.4 else inner, 1, "body")
        return inner

    def html(self) -> str:
        parts = []
        if self.r.random() < 0.2:
            parts.append(f'<div class="{self.r.choice(NAMES["notice"])}" data-y="0">{self.prose(1, 2)} <button data-y="0">{self.word()}</button></div>')
        if self.r.random() < 0.5:
            parts.append(self.part("head", ["header", "header", "div"], self.r.choice([f'<h1 data-y="0">{self.words(1, 4)}</h1>', f'<p data-y="0">{self.words(2, 8)}</p>', f'<a href="/">{self.words(1, 3)}</a>']) + (f'<nav data-y="0">{self.links()}</nav>' if self.r.random() < 0.4 else "")))
        if self.r.random() < 0.7:
            parts.append(self.part("nav", ["nav", "nav", "div", "ul"], self.links()))
        if self.r.random() < 0.4:
            parts.append(self.aside())
        parts = [self.wrapped(p, 0) for p in parts]
        parts.append(self.tabular(self.article()) if self.r.random() < 0.1 else self.article())
        if self.r.random() < 0.12:
            parts.append(self.titled())
        for chance, make in ((0.35, self.aside), (0.2, self.comments), (0.25, lambda: self.part("side", ["aside", "aside", "div"], self.links() if self.r.random() < 0.6 else f'<p data-y="0">{self.prose(1, 2)}</p>'))):
            if self.r.random() < chance:
                parts.append(make())
        if self.r.random() < 0.75:
            parts.append(self.part("foot", ["footer", "footer", "div"], self.r.choice([f"&copy; {self.words(1, 4)} &middot; {self.sentence()}", f'<p data-y="0">&copy; {self.r.randint(1999, 2030)} {self.words(1, 6)}</p>{self.links()}', self.prose(1, 2), f'<p data-y="0">{self.prose(1, 2)}</p>'])))
        inner = "".join(parts)
        if self.r.random() < 0.2:
            inner = f'<div class="{self.r.choice(["wrapper", "container", "page", "layout"])}" data-y="1">{inner}</div>'
        if self.r.random() < 0.15:
            return inner
        return f'<!DOCTYPE html><html data-y="1"><head data-y="0"><title>{self.words(1, 5)}</title></head><body data-y="1">{inner}</body></html>'


def labelled_pages(n: int, seed: int) -> list[str]:
    return [Page(random.Random(seed * 1_000_003 + k)).html() for k in range(n)]
