"""Labelled pages for the page-extraction model: invented layouts with invented words.

Every page is a list of blocks, each written with its markup and marked as main
text or not; :func:`labelled_pages` returns html together with the texts of its
main blocks, in page order.
"""

from __future__ import annotations

import random
import re

# Words that sites use for what isn't the article, in a few languages.
NAV_WORDS = ["Home", "About", "Contact", "News", "Sport", "Login", "Start", "Über uns", "Kontakt", "Accueil", "Inicio", "Blog", "Shop", "Archive", "FAQ", "Help"]
NOTICES = ["We use cookies to improve your experience. Accept all or manage your choices.", "Diese Seite verwendet Cookies. Mehr erfahren.", "Ce site utilise des cookies.", "Este sitio usa cookies. Aceptar", "Please enable JavaScript to use this site.", "You have 3 free articles left this month.", "Your browser is out of date."]
PROMOS = ["Advertisement", "Sponsored content", "Anzeige", "Publicité", "Subscribe to our newsletter", "Sign up for free updates", "Get 20% off today", "Follow us on social media", "Share this article", "Tweet", "Read more", "Related stories", "Most popular", "Recommended for you", "You may also like"]
FOOTS = ["All rights reserved.", "Terms of use", "Privacy policy", "Impressum", "Mentions légales", "Aviso legal", "Powered by Sitemaker", "Back to top"]
UNTOLD = 0.3  # the share of pages whose names tell nothing
SYLLABLES = ["ka", "lo", "ri", "ment", "tor", "sel", "vi", "den", "ün", "sch", "que", "ção", "lla", "ster", "pra", "no", "té", "wer", "ing", "ou", "mas", "fel"]

_NAMES = re.compile(r' (class|id)="[^"]*"')
_TELLING = re.compile(r"<(/?)(?:nav|header|footer|aside|main|article|section)(?![a-z])")


class _Words:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.common = [self.word() for _ in range(40)]

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, n: int) -> list[str]:
        return [self.rng.choice(self.common) if self.rng.random() < 0.5 else self.word() for _ in range(n)]

    def sentence(self, low: int = 3, high: int = 18) -> str:
        w = self.words(self.rng.randint(low, high))
        text = " ".join(x + ("," if self.rng.random() < 0.06 else "") for x in w)
        return text[:1].upper() + text[1:] + self.rng.choice([".", ".", ".", "?", "!"])

    def paragraph(self) -> str:
        kind = self.rng.random()
        if kind < 0.12:
            return self.sentence(1, 3)
        if kind < 0.18:
            return " | ".join(self.words(self.rng.randint(4, 30)))
        if kind < 0.22:
            return " ".join(self.words(self.rng.randint(2, 40)))
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, 6)))


def _inline(rng: random.Random, text: str) -> str:
    words = text.replace("&", "&amp;").replace("<", "&lt;").split(" ")
    for _ in range(rng.randint(0, 2)):
        i = rng.randrange(len(words))
        tag = rng.choice(["b", "i", "em", "strong", "a", "span"])
        words[i] = f'<{tag}{" href=/x" if tag == "a" else ""}>{words[i]}</{tag}>'
    return " ".join(words)


def _untold(rng: random.Random, page: str) -> str:
    """The page with names that tell nothing, or none, and perhaps with plain elements in place of telling ones."""
    page = _NAMES.sub(lambda m: rng.choice(["", f' {m[1]}="{rng.choice(SYLLABLES)}{rng.choice(SYLLABLES)}"']), page)
    if rng.random() < 0.5:
        page = _TELLING.sub(lambda m: f"<{m[1]}div", page)
    return page


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """One page and the plain texts of its main blocks."""
    w, main, out = _Words(rng), [], []
    div = lambda inner, cls, tag="div": f'<{tag} {rng.choice(["class", "class", "id"])}="{cls}">{inner}</{tag}>'

    def keep(text: str, html: str) -> str:
        main.append(text)
        return html

    def links(n: int) -> str:
        items = [rng.choice([rng.choice(NAV_WORDS), *w.words(2)]) for _ in range(n)]
        shape = rng.random()
        if shape < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in items) + "</ul>"
        if shape < 0.85:
            return " | ".join(f'<a href="/{x}">{x}</a>' for x in items)
        return "".join(f'<div><a href="/{x}">{x}</a></div>' for x in items)

    def stray() -> str:
        """Prose that isn't the article's, as in adverts, teasers and footers."""
        return rng.choice([rng.choice(PROMOS), rng.choice(NOTICES), w.sentence(), w.sentence() + " " + w.sentence(), " ".join(w.words(3))])

    def junk() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return div(stray(), rng.choice(["ad", "ads", "advert", "banner-ad", "sponsored", "promo", "ad-slot"]))
        if kind == 1:
            return div(f"<p>{rng.choice(NOTICES)}</p><button>OK</button>", rng.choice(["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr-banner"]))
        if kind == 2:
            return div(f"<h3>{rng.choice(PROMOS)}</h3>{links(rng.randint(2, 6))}<p>{w.sentence()}</p>", rng.choice(["related", "sidebar", "widget", "popular", "recommended"]), rng.choice(["div", "aside", "section"]))
        if kind == 3:
            return f'<form action="/s"><label>{rng.choice(["Search", "Email", "Name"])}</label><input name="q"><select><option>A</option><option>B</option></select><p>{w.sentence()}</p><button>Send</button></form>'
        if kind == 4:
            return f"<script>var a=\"<p>{w.sentence()}</p>\"; if(1<2) f();</script>"
        if kind == 5:
            return div(links(rng.randint(2, 5)), rng.choice(["share", "social", "breadcrumb", "tags", "menu", "pagination"]))
        if kind == 6:
            return f"<!-- {w.sentence()} <p>x</p> --><style>p{{color:red}}</style>"
        if kind == 7:
            return f"<aside><p>{stray()}</p><p>{w.sentence()}</p></aside>"
        return f"<noscript>{rng.choice(NOTICES)}</noscript>"

    def comments() -> str:
        inner = "".join(f'<{t}><b>{w.word()}</b> <span>{rng.randint(1, 9)} h</span><p>{w.paragraph()}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] * rng.randint(1, 5))
        return div(f"<h3>{rng.choice(['Comments', 'Kommentare', 'Commentaires', 'Comentarios', 'Leave a reply'])}</h3>{inner}", rng.choice(["comments", "comment-list", "discussion", "disqus", "replies"]), rng.choice(["div", "section"]))

    def body() -> str:
        parts: list[str] = []
        title = w.paragraph()[: rng.randint(10, 70)]
        if rng.random() < 0.85:
            parts.append(keep(title, f"<h1>{_inline(rng, title)}</h1>"))
        for _ in range(rng.randint(1, 14)):
            kind, text = rng.random(), w.paragraph()
            if rng.random() < 0.05:  # articles say such things, too
                text = rng.choice([rng.choice(NOTICES), rng.choice(PROMOS), rng.choice(FOOTS)])
            if kind < 0.72:
                shape = rng.random()
                if shape < 0.55:
                    parts.append(keep(text, f"<p>{_inline(rng, text)}</p>"))
                elif shape < 0.75:
                    parts.append(keep(text, f"<p>{_inline(rng, text)}"))
                elif shape < 0.87:
                    parts.append(keep(text, f"<p><b>{_inline(rng, text)}<br>"))
                else:
                    parts.append(keep(text, f"<div>{_inline(rng, text)}</div>"))
            elif kind < 0.79:
                parts.append(keep(text[:40], f"<h2>{_inline(rng, text[:40])}</h2>"))
            elif kind < 0.85:
                linked = rng.choice([0.0, 0.0, 0.4])
                item = lambda x: f'<li><a href="/x">{x}</a></li>' if rng.random() < linked else f"<li>{_inline(rng, x)}</li>"  # noqa: B023, E731
                parts.append("<ul>" + "".join(keep(x, item(x)) for x in [w.sentence(1, 8) for _ in range(rng.randint(2, 5))]) + "</ul>")
            elif kind < 0.89:
                parts.append(f"<blockquote>{keep(text, f'<p>{_inline(rng, text)}</p>')}</blockquote>")
            elif kind < 0.92:
                parts.append("<table>" + "".join("<tr>" + "".join(keep(x, f"<td>{x}</td>") for x in w.words(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.97:
                parts.append(junk())
            else:
                parts.append(keep(text[:50], f"<figure><img src=x><figcaption>{_inline(rng, text[:50])}</figcaption></figure>"))
        if rng.random() < 0.15:  # what follows the text within its element
            parts.append(rng.choice([comments, junk])())
        return "".join(parts)

    page_title = w.sentence()
    out.append(f'{rng.choice(["<!DOCTYPE html>", ""])}<html><head><meta charset="utf-8"><title>{page_title}</title><style>a{{}}</style></head><body>')
    if rng.random() < 0.8:
        out.append(rng.choice([f"<nav>{links(rng.randint(3, 9))}</nav>", f"<header><a href=/>{w.word()}</a>{links(4)}</header>", div(links(6), rng.choice(["menu", "nav", "navbar", "header", "topbar"]))]))
    for _ in range(rng.randint(0, 3)):
        out.append(junk())
    inner = body()
    shape = rng.random()
    if shape < 0.5:
        inner = f"<article>{inner}</article>"
    elif shape < 0.65:
        inner = f"<main>{inner}</main>"
    elif shape < 0.95:
        inner = div(inner, rng.choice(["content", "post", "entry-content", "article-body", "story", "main", "post-body", "text"]))
    else:
        inner = f"<table><tr><td>{inner}</td></tr></table>"
    if rng.random() < 0.3:
        inner = f"<main>{inner}</main>" if "<main>" not in inner else inner
    out.append(inner)
    ends = rng.random() < 0.15  # nothing follows the article
    if rng.random() < 0.4 and not ends:
        out.append(comments())
    for _ in range(0 if ends else rng.randint(0, 3)):
        out.append(junk())
    if rng.random() < 0.85 and not ends:
        foot = f"{rng.choice(['&copy;', '©', 'Copyright'])} {w.word()}.example.org {rng.choice(['&middot;', '|', '-'])} {rng.choice([rng.choice(FOOTS), w.sentence(), w.sentence() + ' ' + w.sentence()])}"
        out.append(rng.choice([f"<footer>{foot}</footer>", f"<footer><p>{foot}</p>{links(3)}</footer>", div(foot, rng.choice(["footer", "foot", "bottom", "colophon"]))]))
    if rng.random() < 0.8:
        out.append("</body></html>")
    page = "".join(out)
    return _untold(rng, page) if rng.random() < UNTOLD else page, [" ".join(t.split()) for t in main]


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[str]]]:
    return [labelled_page(random.Random(f"{seed}:{i}")) for i in range(n)]
