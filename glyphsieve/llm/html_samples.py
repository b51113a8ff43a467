"""Made pages with known main texts: what ``html_extract`` learns from, and with other seeds is measured on."""

from __future__ import annotations

import random
from collections.abc import Iterator

_LETTERS = "etaoinshrdlucmfwypvbgkäéñß"


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng, self.text = rng, []

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        return " ".join("".join(rng.choices(_LETTERS, k=rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(5, 18).capitalize() + self.rng.choice("...?!") for _ in range(self.rng.randint(low, high)))

    def keep(self, tag: str, text: str, attrs: str = "") -> str:
        self.text.append(text)
        return f"<{tag}{attrs}>{text}</{tag}>"

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f"<li><a href=/{k}>{self.words(1, 4)}</a></li>" for k in range(n)) + "</ul>"

    def aside_of(self, kind: str, tag: str = "div") -> str:
        rng = self.rng
        inner = rng.choice([f"<p>{self.sentences(1, 4)}</p>", self.links(rng.randint(2, 8)), f"<h3>{self.words(1, 4)}</h3>{self.links(rng.randint(2, 5))}", self.sentences(1, 2), f"<p>{self.words(1, 6)}</p><p><a href=x>{self.words(1, 4)}</a></p>"])
        return f'<{tag} {rng.choice(["class", "id"])}="{kind}">{inner}</{tag}>'

    def advert(self) -> str:
        return self.aside_of(self.rng.choice(["ad", "ads top-ad", "advert", "sponsored", "promo box", "newsletter-signup", "share", "related", "cookie-notice"]), self.rng.choice(["div", "div", "section", "aside"]))

    def body(self) -> str:
        """What an article consists of, with an advert now and then."""
        rng, out = self.rng, []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.62:
                out.append(self.keep("p", self.sentences(1, 6)))
            elif kind < 0.68:
                out.append(self.keep("p", self.words(1, 6) + rng.choice(["", ".", ":"])))
            elif kind < 0.78:
                out.append(self.keep(rng.choice(["h2", "h3"]), self.words(1, 7)))
            elif kind < 0.86:
                out.append("<ul>" + "".join(self.keep("li", self.words(2, 14)) for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.9:
                out.append(self.keep("blockquote", self.sentences(1, 2)))
            elif kind < 0.93:
                out.append("<figure><img src=x>" + self.keep("figcaption", self.words(3, 10)) + "</figure>")
            elif kind < 0.96:
                out.append("<table><tr>" + "".join(self.keep("td", self.words(1, 3)) for _ in range(rng.randint(2, 6))) + "</tr></table>")
            else:
                out.append(self.advert())
        return "".join(out)

    def comments(self) -> str:
        tag = self.rng.choice(["div", "section", "ol"])
        each = "".join(f"<div class=comment><p>{self.words(1, 2)}</p><p>{self.sentences(1, 4)}</p></div>" for _ in range(self.rng.randint(1, 6)))
        return f'<{tag} {self.rng.choice(["class", "id"])}="{self.rng.choice(["comments", "comment-list", "disqus_thread", "replies"])}"><h3>{self.words(1, 2)}</h3>{each}</{tag}>'

    def page(self) -> str:
        rng = self.rng
        top = [f"<nav>{self.links(rng.randint(2, 9))}</nav>" if rng.random() < 0.6 else self.aside_of(rng.choice(["menu", "navbar", "main-nav navigation"]))]
        if rng.random() < 0.6:
            top.insert(0, rng.choice([f"<header><p>{self.words(1, 8)}</p></header>", f'<div class="header">{self.words(1, 5)}</div>', f"<header><h1>{self.words(1, 3)}</h1><p>{self.sentences(1, 1)}</p></header>"]))
        if rng.random() < 0.4:
            top.append(self.advert())
        if rng.random() < 0.3:
            top.append(f'<form action=x><p>{self.words(1, 3)}</p><label>{self.words(1, 4)}</label><input name=q></form>')
        if rng.random() < 0.15:
            top.append(f"<noscript><p>{self.sentences(1, 2)}</p></noscript>")
        if rng.random() < 0.15:
            top.append(f"<div style='display:none'><p>{self.sentences(1, 2)}</p></div>")
        title = self.keep("h1", self.words(2, 9))
        title = rng.choice([title, f"<header>{title}</header>", f'<div class="header">{title}</div>', f'<div class="entry-header">{title}</div>']) if rng.random() < 0.5 else title
        inner = title + (self.keep("p", self.words(2, 5)) if rng.random() < 0.3 else "") + self.body()
        if rng.random() < 0.15:
            inner = rng.choice([f"<nav>{self.links(3)}</nav>", f'<div class="breadcrumbs">{self.words(1, 6)}</div>']) + inner
        if rng.random() < 0.3:
            inner += rng.choice([f"<aside><p>{self.sentences(1, 3)}</p></aside>", self.aside_of("sidebar"), f"<footer><p>{self.words(2, 9)}</p></footer>", f"<footer><p>{self.sentences(1, 2)}</p></footer>", self.comments()])
        shell = rng.choice(["<article>{}</article>", "<article class='post'>{}</article>", "<main>{}</main>", "<main id=content><article>{}</article></main>", "<div class='content'>{}</div>", "<div id=main>{}</div>", "<div class='post entry'>{}</div>", "<div>{}</div>", "<section>{}</section>"])
        low = [self.comments()] if rng.random() < 0.35 else []
        if rng.random() < 0.5:
            low.append(rng.choice([f"<aside><h3>{self.words(1, 3)}</h3><p>{self.sentences(1, 3)}</p></aside>", self.aside_of("sidebar"), self.aside_of("widget sidebar-right")]))
        if rng.random() < 0.2:
            low.append(f"<form><p>{self.sentences(1, 1)}</p><p>{self.words(1, 3)}</p></form>")
        low.append(rng.choice([f"<footer>&copy; {self.words(1, 5)}</footer>", f"<footer><p>{self.sentences(1, 2)}</p>{self.links(3)}</footer>", f'<div id="footer"><p>{self.words(2, 9)}</p></div>']))
        wrap = rng.choice(["{}", "{}", "<div class='wrapper'>{}</div>", "<div id=page class='has-sidebar'>{}</div>", "<form action=x>{}</form>"])
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>" + wrap.format("".join(top) + shell.replace("{}", inner) + "".join(low)) + "</body></html>"


def pages(n: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """``(html, the blocks of its main text in order)``."""
    rng = random.Random(seed)
    for _ in range(n):
        maker = _Maker(rng)
        page = maker.page()
        yield page, maker.text
