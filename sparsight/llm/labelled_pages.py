"""Labelled pages to train the page model from: composed layouts whose content elements carry a mark.

A page is a random composition of site furniture (menus, headers, footers, sidebars, notices, adverts, forms, link lists,
reader comments) around an article with headings, paragraphs, lists, quotes, tables and captions. Elements whose text is
the page's own content have the attribute data-main, which the parser reports and no feature sees.
"""

from __future__ import annotations

import random

MARK = "data-main"
_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo on er an en st ch".split()
#: Names that furniture and content go by in class and id attributes.
FURNITURE = {
    "menu": "nav menu navbar navigation topbar breadcrumb breadcrumbs pagination tabs toc",
    "header": "header masthead banner site-header branding logo topbar",
    "footer": "footer site-footer bottom copyright colophon legal",
    "aside": "sidebar aside widget widgets rail related trending recommended popular",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp banner-ad",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay paywall",
    "form": "newsletter subscribe signup login search form contact",
    "comments": "comments comment comment-list discussion responses reply replies disqus thread",
    "share": "share social sharing tools byline-tools tags meta follow",
}
CONTENT = "article content main post entry story body article-body post-content entry-content text page-content prose".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def prose(self, sentences: int) -> str:
        parts = []
        for _ in range(sentences):
            s = self.phrase(4, 16).capitalize()
            if self.rng.random() < 0.15:
                s += f' <a href="/{self.word()}">{self.phrase(1, 3)}</a> {self.word()}'
            if self.rng.random() < 0.15:
                s += f" <b>{self.word()}</b>"
            parts.append(s + self.rng.choices([".", "", "!!", "?", "***"], [12, 3, 1, 1, 1])[0])
        return " ".join(parts)

    def named(self, kind: str) -> str:
        name = self.rng.choice(FURNITURE[kind].split()) if kind in FURNITURE else self.rng.choice(CONTENT)
        return self.rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {self.word()}"', f' class="{self.word()}-{name}"'])

    def links(self, n: int) -> str:
        items = [f'<a href="/{self.word()}">{self.phrase(1, 4)}</a>' for _ in range(n)]
        shape = self.rng.random()
        if shape < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " ".join(items) if shape < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def box(self, kind: str, tag: str | None, inner: str) -> str:
        """inner in a telling tag, a named div, or both."""
        how = self.rng.random()
        name = self.named(kind) if not tag or how < 0.45 else ""
        use = tag if tag and how < 0.85 else "div" if self.rng.random() < 0.8 else "section"
        return f"<{use}{name or (self.named(kind) if use != tag else '')}>{inner}</{use}>"

    def furniture(self, kind: str) -> str:
        r = self.rng
        if kind == "menu":
            return self.box(kind, "nav", self.links(r.randint(2, 9)))
        if kind == "header":
            return self.box(kind, "header", r.choice([f"<h1>{self.phrase(1, 4)}</h1>", f"<p>{self.phrase(2, 8)}</p>", f"<div>{self.phrase(1, 3)}</div>"]) + (self.furniture("menu") if r.random() < 0.5 else ""))
        if kind == "footer":
            return self.box(kind, "footer", r.choice(["", "<p>"]) + f"&copy; {self.word()}.example &middot; {self.prose(r.randint(1, 3))}" + (self.links(3) if r.random() < 0.4 else ""))
        if kind == "aside":
            return self.box(kind, "aside", f"<h3>{self.phrase(1, 3)}</h3>" * r.randint(0, 1) + r.choice([self.links(r.randint(2, 6)), f"<p>{self.prose(r.randint(1, 3))}</p>", self.prose(r.randint(1, 3))]))
        if kind == "advert":
            return self.box(kind, None, r.choice([self.prose(1), f"<p>{self.prose(r.randint(1, 2))}</p>", f'<a href="/{self.word()}">{self.phrase(2, 8)}</a>', self.prose(2)]))
        if kind == "notice":
            return self.box(kind, None, r.choice(["", "<p>"]) + self.prose(r.randint(1, 3)) + r.choice(["", f"<button>{self.word()}</button>"]))
        if kind == "form":
            return f"<form{r.choice(['', self.named('form')])}>" + r.choice(["", f"<p>{self.prose(1)}</p>", f"<label>{self.phrase(1, 3)}</label>"]) + f'<input name="{self.word()}"><button>{self.word()}</button></form>'
        if kind == "comments":
            one = lambda: f"<{t}{r.choice(['', self.named('comments')])}><p>{self.prose(r.randint(1, 5))}</p></{t}>" if (t := r.choice(["li", "div", "article"])) else ""
            return f"<{(t := r.choice(['section', 'div', 'ol']))}{self.named('comments')}>" + f"<h3>{self.phrase(1, 3)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 5))) + f"</{t}>"
        return self.box("share", None, r.choice([self.links(r.randint(2, 4)), f"<span>{self.phrase(1, 4)}</span>"]))

    def content(self) -> str:
        r, m = self.rng, f" {MARK}"
        kind = r.choices(["p", "open", "h", "ul", "quote", "table", "figure", "div", "pre", "advert", "share"], [50, 8, 12, 6, 4, 3, 3, 6, 1, 4, 2])[0]
        if kind == "p":
            return f"<p{m}>{self.prose(r.randint(1, 7))}</p>"
        if kind == "open":
            return f"<p{m}><b>{self.prose(r.randint(1, 4))}<br>"
        if kind == "h":
            return f"<h{(n := r.randint(2, 4))}{m}>{self.phrase(1, 7)}</h{n}>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li{m}>{self.prose(1) if r.random() < 0.6 else self.phrase(1, 6)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind == "quote":
            return f"<blockquote><p{m}>{self.prose(r.randint(1, 3))}</p></blockquote>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td{m}>{self.phrase(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if kind == "figure":
            return f'<figure><img src="/{self.word()}.png"><figcaption{m}>{self.phrase(3, 9)}</figcaption></figure>'
        if kind == "div":
            return f"<div{m}>{self.prose(r.randint(1, 5))}</div>"
        if kind == "pre":
            return f"<pre{m}>{self.phrase(3, 20)}</pre>"
        return self.furniture(kind)

    def article(self) -> str:
        r = self.rng
        title = f"<h1 {MARK}>{self.phrase(1, 12)}</h1>" if r.random() < 0.9 else ""
        inner = title + "".join(self.content() for _ in range(r.randint(1, 9)))
        how = r.random()
        if how < 0.5:
            return f"<article{r.choice(['', self.named('content')])}>{inner}</article>"
        if how < 0.65:
            return f"<main>{inner}</main>"
        if how < 0.9:
            return f"<div{self.named('content')}>{inner}</div>"
        return f"<main><article>{inner}</article></main>"

    def page(self) -> str:
        r = self.rng
        few = lambda kinds, most: [self.furniture(r.choice(kinds)) for _ in range(r.randint(0, most))]
        above = few(["header", "menu", "notice", "advert", "form", "menu"], 3)
        below = few(["comments", "aside", "share", "advert", "form", "menu"], 3) + few(["footer", "footer", "notice"], 1)
        middle = self.article()
        if r.random() < 0.4:
            side = self.furniture("aside")
            middle = f"<div>{middle}{side}</div>" if r.random() < 0.7 else f"<div>{side}{middle}</div>"
        if r.random() < 0.3:
            middle = f'<div class="{self.word()}">{middle}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.phrase(1, 9)}</title></head><body>{''.join(above)}{middle}{''.join(below)}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    """n pages of the mark-up described above."""
    return [_Writer(random.Random(seed * 1_000_003 + i)).page() for i in range(n)]
