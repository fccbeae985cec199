"""Labelled training pages: layouts of common kinds, filled with invented words, every block marked as main text or not.

Texts of both kinds come from the same word source and have all lengths, so what a model learns is mainly where
blocks stand; pages without telling names teach the difference of running text and lists of links.
"""

from __future__ import annotations

import random

# Names that sites use in classes and ids.
MAIN_NAMES = ("content main post entry story article text body article-body post-content entry-content story-text "
              "main-content page-content hentry prose blog-post news-item").split()
OTHER_NAMES = {
    "ad": "ad ads advert advertisement ad-slot sponsor sponsored promo promotion banner-ad adsense".split(),
    "side": "sidebar side widget rail aside related recommended popular trending more-stories newsletter subscribe".split(),
    "notice": "notice cookie cookie-notice consent gdpr alert cookies-banner privacy-notice message-bar popup modal".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar links site-nav main-menu pagination".split(),
    "header": "header masthead branding logo site-header top banner tagline".split(),
    "footer": "footer foot copyright legal colophon site-footer bottom".split(),
    "comment": "comment comments comment-list comment-body reply respond discussion disqus feedback user-comments reactions".split(),
    "form": "form search search-form login signup contact-form subscribe-form".split(),
    "share": "share social sharing share-buttons tags tag-list author-bio".split(),
}
_PARTS = "the and of er tion ing le en de ou re qui sch lich und ge que ado ción es ar th an is on at ed nd st ha".split()


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_PARTS) for _ in range(rng.randrange(1, 4)))


def _text(rng: random.Random, most: int = 60) -> str:
    count = min(most, rng.choice([1, 2, 4, rng.randrange(3, 12), rng.randrange(8, 60), rng.randrange(8, 90)]))
    words = [_word(rng) for _ in range(count)]
    kind = rng.random()
    if kind < 0.06:
        words = [w.upper() + "!!" for w in words]
    elif kind < 0.12:
        words = [w + rng.choice(["***", "%%%", "###", "$$$"]) for w in words]
    elif kind < 0.16:
        return " | ".join(words)
    text = " ".join(words)
    return (text[:1].upper() + text[1:] + rng.choice([".", ".", ".", "", "!", "?"])).strip()


class _Page:
    """Collects markup and, block by block, the text and whether it is main."""

    def __init__(self, rng: random.Random, named: float):
        self.rng, self.named, self.out, self.labels = rng, named, [], []

    def raw(self, markup: str) -> None:
        self.out.append(markup)

    def block(self, tag: str, text: str, main: bool, inner: str = "{}", attributes: str = "") -> None:
        self.out.append(f"<{tag}{attributes}>{inner.format(text)}</{tag}>")
        self.labels.append((text, main))

    def attribute(self, names: list[str]) -> str:
        if self.rng.random() > self.named:
            return ""
        return f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(names)}"'

    def links(self, count: int, item: str = "li") -> None:
        for _ in range(count):
            self.block(item, _text(self.rng, 9) if self.rng.random() < 0.2 else _word(self.rng), False, '<a href="/x">{}</a>')

    def other(self, kind: str) -> None:
        rng, names = self.rng, OTHER_NAMES[kind]
        plain = {"side": "aside", "menu": "nav", "header": "header", "footer": "footer", "form": "form", "comment": "section"}.get(kind, "div")
        semantic = kind in ("menu", "header", "footer", "form") and rng.random() < 0.6 or kind == "side" and rng.random() < 0.5
        tag = plain if semantic else rng.choice(["div", "div", "section", "ul"] if kind == "menu" else ["div", "div", "section"])
        self.raw(f"<{tag}{self.attribute(names) if semantic else f' class=\"{rng.choice(names)}\"'}>")
        if kind == "menu":
            if tag != "ul":
                self.raw("<ul>")
            self.links(rng.randrange(2, 8))
            if tag != "ul":
                self.raw("</ul>")
        elif kind == "form":
            for _ in range(rng.randrange(1, 4)):
                self.block(rng.choice(["p", "div"]), _text(rng, 9), False)
            self.block("button", _word(rng), False)
        elif kind == "comment":
            if rng.random() < 0.6:
                self.block(rng.choice(["h2", "h3"]), _text(rng, 6), False)
            for _ in range(rng.randrange(1, 5)):
                around = rng.choice(["div", "li", "article"])
                self.raw(f"<{around}{self.attribute(names)}>")
                self.block("p", _text(rng), False)
                self.raw(f"</{around}>")
        elif kind == "header":
            self.block(rng.choice(["h1", "div", "p", "h2"]), _text(rng, 8), False, rng.choice(["{}", '<a href="/">{}</a>']))
        elif kind == "footer":
            for _ in range(rng.randrange(1, 3)):
                self.block(rng.choice(["p", "div"]), rng.choice(["© ", "", ""]) + _text(rng), False)
        elif kind in ("side", "share") and rng.random() < 0.5:
            self.block("h3", _text(rng, 5), False)
            self.raw("<ul>")
            self.links(rng.randrange(1, 6))
            self.raw("</ul>")
        elif rng.random() < 0.5:
            text = _text(rng)
            self.raw(text)
            self.labels.append((text, False))
        else:
            for _ in range(rng.randrange(1, 3)):
                self.block("p", _text(rng), False, rng.choice(["{}", "{}", '<a href="/x">{}</a>']))
        self.raw(f"</{tag}>")

    def main(self) -> None:
        rng = self.rng
        semantic = rng.random()
        tag = "article" if semantic < 0.5 else "main" if semantic < 0.65 else rng.choice(["div", "section"])
        telling = tag in ("article", "main") or self.named > 0.5
        self.raw(f"<{tag}{self.attribute(MAIN_NAMES) if tag in ('article', 'main') else f' class=\"{rng.choice(MAIN_NAMES)}\"' if telling else ''}>")
        inner = rng.random() < 0.25
        if rng.random() < 0.8:
            self.block(rng.choice(["h1", "h1", "h2"]), _text(rng, 14), True)
        if inner:
            self.raw(f"<div{self.attribute(MAIN_NAMES)}>")
        for _ in range(rng.randrange(1, 14)):
            kind = rng.random()
            if kind < 0.72:
                self.block("p", _text(rng, 90), True, rng.choice(["{}", "{}", "{}", "<b>{}", "<em>{}</em>", '<a href="/x">{}</a>' if rng.random() < 0.2 else "{}"]))
            elif kind < 0.79:
                self.block(rng.choice(["h2", "h3"]), _text(rng, 8), True)
            elif kind < 0.85:
                self.raw("<ul>")
                for _ in range(rng.randrange(1, 5)):
                    self.block("li", _text(rng, 20), True)
                self.raw("</ul>")
            elif kind < 0.89:
                self.block("blockquote", _text(rng), True)
            elif kind < 0.92:
                self.raw("<table><tr>")
                for _ in range(rng.randrange(1, 5)):
                    self.block("td", _text(rng, 6), True)
                self.raw("</tr></table>")
            else:
                self.other(rng.choice(["ad", "ad", "side", "share", "notice", "form", "menu"]))
        if inner:
            self.raw("</div>")
        if rng.random() < 0.25:
            self.other("comment")
        if rng.random() < 0.15:
            self.other(rng.choice(["share", "footer"]))
        self.raw(f"</{tag}>")

    def build(self) -> str:
        rng = self.rng
        title = _text(rng, 10)
        self.raw(f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>")
        self.labels.append((title, False))
        for kind in ("notice", "header", "menu", "ad", "form", "side"):
            if rng.random() < {"menu": 0.8, "ad": 0.5, "header": 0.5}.get(kind, 0.25):
                self.other(kind)
        self.main()
        for kind in ("comment", "side", "ad", "share", "form", "menu", "notice", "footer"):
            if rng.random() < {"footer": 0.8, "comment": 0.35, "side": 0.4}.get(kind, 0.15):
                self.other(kind)
        self.raw("</body></html>")
        return "".join(self.out)


def labelled_pages(count: int = 900, seed: int = 42) -> list[tuple[str, list[tuple[str, bool]]]]:
    """(html, [(text of a block, is it main), ...]) in page order."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        page = _Page(rng, rng.choice([0.0, 0.5, 0.9, 0.9]))
        html = page.build()
        out.append((html, page.labels))
    return out
