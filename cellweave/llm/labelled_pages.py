"""Labelled pages on which the extraction field of operator 7 is trained: rule-made, seeded, of many layouts.

Each page is HTML whose text blocks are marked: main text carries the attribute data-y="1", all else data-y="0".
Words are drawn from no language, so that only layout, tags, names and the shape of text can be learnt.
"""

from __future__ import annotations

import random

MAIN = ["article", "main", "section", 'div class="content"', 'div id="content"', 'div class="post-body"', 'div class="entry-content"', 'div class="article-body"', 'div class="story text"', 'div role="main"', "div", ""]
SIDE = {
    "menu": ["nav", 'div class="menu"', 'ul class="nav"', 'div id="navigation"', 'div class="navbar top-menu"', 'div role="navigation"', 'div class="breadcrumb"', 'div class="breadcrumbs"'],
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="site-header banner"', 'div role="banner"'],
    "aside": ["aside", 'div class="sidebar"', 'div id="sidebar-right"', 'div class="widget"', 'div class="related"', 'div class="related-posts"', 'section class="recommended"', 'div role="complementary"'],
    "notice": ['div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice"', 'div class="alert"', 'div class="gdpr consent"', 'div class="popup modal"', 'div class="subscribe"', 'div class="newsletter"', 'div class="disclaimer"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div id="ad-top"', 'div class="sponsored promo"', 'aside class="promo"', 'div class="banner-ad"'],
    "form": ["form", 'form class="search"', 'form id="login"', 'div class="search-form"'],
    "comments": ['div id="comments"', 'section class="comments"', 'ol class="comment-list"', 'div class="comment"', 'div class="reader-comments"', 'div id="disqus_thread"', 'div class="replies"', 'div class="discussion responses"'],
    "share": ['div class="share"', 'ul class="social"', 'div class="share-buttons"', 'div class="tags"', 'div class="meta byline"', 'div class="pagination pager"'],
    "footer": ["footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'div class="site-footer legal"', 'div role="contentinfo"'],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        w = ["".join(r.choice("abcdefghilmnoprstuvé") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))]
        if r.random() < 0.2 and len(w) > 4:
            w[r.randrange(len(w))] = str(r.randint(1, 99999))
        return " ".join(w)

    def prose(self, sentences: int) -> str:
        out = []
        for _ in range(sentences):
            s = self.words(3, 22).capitalize()
            if self.r.random() < 0.5:
                s = s.replace(" ", ", ", 1)
            out.append(s + self.r.choice("....?!"))
        return " ".join(out)

    def wrap(self, tag: str, body: str) -> str:
        return f"<{tag}>{body}</{tag.split()[0]}>" if tag else body

    def block(self, tag: str, text: str, y: int) -> str:
        return f'<{tag} data-y="{y}">{text}</{tag}>'

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(self.block(r.choice(["h1", "h1", "h2"]), self.words(1, 14).capitalize() + r.choice(["", "", "."]), 1))
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.68:
                text = self.prose(r.choice([1, 1, 2, 3, 6]))
                if r.random() < 0.15:
                    text = f'{text} <a href="/x">{self.words(1, 4)}</a> {self.words(2, 8)}.'
                if r.random() < 0.15:
                    text = f"<b>{text}<br>" if r.random() < 0.5 else f"<b>{text}</b>"
                out.append(self.block(r.choice(["p", "p", "p", "p", "div"]), text, 1))
            elif kind < 0.76:
                out.append(self.block(r.choice(["h2", "h3", "h4"]), self.words(1, 9).capitalize(), 1))
            elif kind < 0.86:
                tag = r.choice(["ul", "ol"])
                out.append(self.wrap(tag, "".join(self.block("li", self.words(1, 16) + r.choice(["", "."]), 1) for _ in range(r.randint(2, 5)))))
            elif kind < 0.92:
                out.append(self.wrap("blockquote", self.block("p", self.prose(2), 1)))
            elif kind < 0.96:
                out.append(self.block("pre", self.words(4, 30), 1))
            else:
                rows = "".join(self.wrap("tr", "".join(self.block("td", self.words(1, 4), 1) for _ in range(3))) for _ in range(3))
                out.append(self.wrap("table", rows))
        return "".join(out)

    def links(self) -> str:
        n = self.r.randint(2, 7)
        items = "".join(self.block("li", f'<a href="/{i}">{self.words(1, 3)}</a>', 0) for i in range(n))
        return self.wrap("ul", items) if self.r.random() < 0.7 else self.block("div", " | ".join(f'<a href="/{i}">{self.words(1, 2)}</a>' for i in range(n)), 0)

    def side(self, kind: str) -> str:
        r = self.r
        box = r.choice(SIDE[kind])
        if kind == "menu":
            body = self.links()
        elif kind == "header":
            body = self.block(r.choice(["div", "h1", "p", "span"]), self.words(1, 5), 0) + (self.links() if r.random() < 0.5 else "")
        elif kind == "aside":
            body = (self.block("h3", self.words(1, 3), 0) if r.random() < 0.6 else "") + (self.links() if r.random() < 0.6 else self.block("p", self.prose(r.randint(1, 3)), 0))
        elif kind == "form":
            body = self.block("label", self.words(1, 3), 0) + '<input name="q">' + (self.block("p", self.prose(1), 0) if r.random() < 0.5 else "")
        elif kind == "comments":
            body = (self.block("h3", self.words(1, 3), 0) if r.random() < 0.5 else "") + "".join(self.wrap(r.choice(['div class="comment"', "div", "li"]), self.block("p", self.prose(r.randint(1, 4)), 0)) for _ in range(r.randint(1, 4)))
        elif kind == "footer":
            body = self.block(r.choice(["p", "div"]), r.choice(["&copy; ", "© 2021 ", "", ""]) + self.words(1, 3) + r.choice([" &middot; ", ". ", " "]) + (self.prose(r.randint(1, 3)) if r.random() < 0.6 else ""), 0) + (self.links() if r.random() < 0.3 else "")
        else:
            body = self.block(r.choice(["p", "div", "span"]), self.prose(r.randint(1, 3)) if r.random() < 0.7 else self.words(1, 6), 0)
        if r.random() < 0.25:
            body = body.replace("<p data-y", "<div data-y").replace("</p>", "</div>")
        return self.wrap(box, body)

    def page(self) -> str:
        r = self.r
        before = [k for k, p in (("header", 0.5), ("menu", 0.8), ("notice", 0.3), ("ad", 0.4), ("form", 0.2)) if r.random() < p]
        after = [k for k, p in (("share", 0.3), ("comments", 0.4), ("aside", 0.4), ("form", 0.2), ("ad", 0.3), ("footer", 0.85), ("notice", 0.15)) if r.random() < p]
        r.shuffle(before)
        inside = self.main()
        for _ in range(r.choice([0, 0, 1, 2])):
            inside += self.side(r.choice(list(SIDE)))
        if r.random() < 0.25:
            inside = self.side(r.choice(list(SIDE))) + inside
        box = r.choice(MAIN)
        body = self.wrap(box, inside)
        if box and r.random() < 0.2:  # an end tag left out: what follows seems to stand inside
            body = body[: body.rindex("</")]
        text = "".join(self.side(k) for k in before) + body + "".join(self.side(k) for k in after)
        if r.random() < 0.4:
            text = self.wrap(r.choice(['div class="wrapper"', 'div id="page"', 'div class="container"', "div"]), text)
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{text}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
