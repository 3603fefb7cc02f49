"""Labelled training pages, made from a seed.

A page is a list of parts, each with its label; layouts, element names and class names vary,
so a model learns what menus, adverts or reader comments have in common over many sites. No
text of any input table is used.
"""

from __future__ import annotations

import random

#: Words that web sites use in the class or id of the parts of a page.
ARTICLE = "article post entry content story main-content article-body post-content entry-content story-body page-content text body-text maincontent article__body single-post blog-post".split()
NAVIGATION = "nav menu navbar navigation main-menu site-nav topnav breadcrumbs breadcrumb pagination pager tabs toc links submenu skip".split()
HEADER = "header site-header masthead topbar top-bar page-header banner branding logo site-title hero-header".split()
FOOTER = "footer site-footer page-footer bottom colophon copyright legal footer-links bottombar".split()
SIDEBAR = "sidebar side-bar rail widget widgets related related-posts recommended more-stories popular trending aside secondary right-column latest readnext".split()
NOTICE = "notice cookie cookie-banner cookies consent gdpr alert popup modal overlay disclaimer paywall announcement message toast warning privacy-notice".split()
ADVERT = "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion banner-ad ad-slot ad-container commercial affiliate dfp taboola outbrain".split()
FORM = "form newsletter subscribe signup sign-up search search-form login contact-form subscription mailing-list register poll".split()
COMMENTS = "comments comment commentlist comment-list responses discussion disqus reader-comments replies reply comment-section user-comments feedback".split()
EXTRAS = "share sharing social social-share byline meta post-meta author author-bio tags tag-list toolbar date published buttons rating print".split()
SYLLABLES = "an be co da el fi go ha in jo ka lu me no or pa qui re sa ti un ve wo ya ze ther ing tion st en er é ü ß ó ñ".split()
PHRASES = ("Read more", "Share this", "All rights reserved", "© 2024", "Leave a reply", "Sign in", "Subscribe", "Advertisement", "We use cookies", "Related", "Search", "Accept", "Home", "3 comments")


class Pages:
    """Draws pages; each is a list of (label, html) parts in page order."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.random
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        text = " ".join(w + (r.choice(",.;") if r.random() < 0.08 else "") for w in out).capitalize()
        if r.random() < 0.08:
            text += " " + r.choice(PHRASES)
        return text + ("." if r.random() < 0.8 else "")

    def attributes(self, names: list[str]) -> str:
        r = self.random
        name = r.choice(names)
        if r.random() < 0.25:
            name = r.choice([f"{name}-{r.choice(['wrap', 'inner', 'box', 'area', '1', 'container'])}", f"{r.choice(['site', 'page', 'js', 'c', 'l'])}-{name}", name.replace("-", "_"), name.title().replace("-", "")])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def paragraph(self) -> str:
        r = self.random
        text = self.words(1, 12) if r.random() < 0.3 else self.words(12, 90)
        if r.random() < 0.3:
            words = text.split()
            k = r.randrange(len(words))
            words[k] = f'<{(t := r.choice(["b", "i", "em", "strong", "a href=x", "span", "code"]))}>{words[k]}</{t.split()[0]}>'
            text = " ".join(words)
        return text

    def article(self) -> list[tuple[int, str]]:
        r = self.random
        out = [(1, f"<h1>{self.words(2, 10)}</h1>")] if r.random() < 0.8 else []
        tag = r.choice(["p", "p", "p", "p", "p", "div"])
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                out.append((1, f"<{tag}>{self.paragraph()}" + (f"</{tag}>" if tag == "div" or r.random() < 0.9 else "")))
            elif kind < 0.8:
                out.append((1, f"<h{r.randint(2, 4)}>{self.words(1, 8)}</h{2}>"))
            elif kind < 0.86:
                items = "".join(f"<li>{self.words(1, 15)}</li>" for _ in range(r.randint(1, 5)))
                out.append((1, f"<ul>{items}</ul>"))
            elif kind < 0.9:
                out.append((1, f"<blockquote><p>{self.paragraph()}</p></blockquote>"))
            elif kind < 0.93:
                out.append((1, f"<table><tr><th>{self.words(1, 3)}</th><td>{self.words(1, 4)}</td></tr></table>"))
            elif kind < 0.95:
                out.append((1, f"<figure><img src=x><figcaption>{self.words(2, 12)}</figcaption></figure>"))
            else:
                out.append((0, self.inner()))
        return out

    def inner(self) -> str:
        """A part that isn't the article's text but stands within it."""
        return self.random.choice([self.advert, self.form, self.sidebar, self.extras, self.notice])()

    def inside(self) -> str:
        """Filling of a box: a bare text, paragraphs, or links."""
        r, kind = self.random, self.random.random()
        if kind < 0.35:
            return self.words(1, 25) if r.random() < 0.8 else r.choice(PHRASES)
        if kind < 0.65:
            return "".join(f"<p>{self.words(2, 40)}</p>" for _ in range(r.randint(1, 3)))
        if kind < 0.8:
            return f"<h{r.randint(2, 4)}>{self.words(1, 5)}</h3>" + "".join(f"<p>{self.words(3, 30)}</p>" for _ in range(r.randint(1, 2)))
        return "<ul>" + "".join(f'<li><a href="/x">{self.words(1, 8)}</a></li>' for _ in range(r.randint(2, 7))) + "</ul>"

    def box(self, tags: list[str], names: list[str], inside: str, bare: float = 0.4) -> str:
        """An element that its name or its class tells apart."""
        tag = self.random.choice(tags)
        plain = tag not in ("div", "section", "p", "ul", "ol", "span")
        return f"<{tag}{'' if plain and self.random.random() < bare else self.attributes(names)}>{inside}</{tag}>"

    def navigation(self) -> str:
        items = "".join(f'<li><a href="/a">{self.words(1, 3)}</a></li>' for _ in range(self.random.randint(2, 9)))
        return self.box(["nav", "nav", "div", "menu"], NAVIGATION, self.random.choice([f"<ul>{items}</ul>", items.replace("<li>", " ").replace("</li>", " ")]))

    def header(self) -> str:
        return self.box(["header", "header", "div"], HEADER, self.random.choice([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 12)}</p>"]) + (self.navigation() if self.random.random() < 0.4 else ""))

    def footer(self) -> str:
        return self.box(["footer", "footer", "div"], FOOTER, self.random.choice([f"&copy; {self.words(1, 12)}", f"<p>&copy; 2024 {self.words(2, 14)}</p>", self.inside()]))

    def sidebar(self) -> str:
        return self.box(["aside", "aside", "div", "section"], SIDEBAR, self.inside())

    def notice(self) -> str:
        return self.box(["div", "div", "section", "dialog", "p"], NOTICE, self.random.choice([self.words(4, 40), f"<p>{self.words(4, 40)}</p><button>OK</button>"]))

    def advert(self) -> str:
        return self.box(["div", "div", "div", "section", "aside", "p"], ADVERT, self.random.choice([self.words(1, 20), self.inside()]))

    def form(self) -> str:
        inside = f'<label>{self.words(1, 4)}</label><input name="q"><button type=submit>{self.words(1, 2)}</button>'
        inside = (f"<p>{self.words(3, 20)}</p>" if self.random.random() < 0.5 else "") + inside
        return self.box(["form", "form", "div"], FORM, f"<form>{inside}</form>" if self.random.random() < 0.3 else inside, bare=0.5)

    def comments(self) -> str:
        r = self.random
        one = r.choice(["div", "li", "article"])
        said = "".join(f"<{one}{self.attributes(['comment', 'reply', 'comment-body', 'response'])}><p>{self.words(1, 50)}</p></{one}>" if r.random() < 0.7 else f"<p>{self.words(1, 50)}</p>" for _ in range(r.randint(1, 5)))
        return self.box(["section", "div", "div", "ol", "ul"], COMMENTS, (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.6 else "") + said)

    def extras(self) -> str:
        return self.box(["div", "div", "p", "ul", "section"], EXTRAS, self.random.choice([self.words(1, 8), f'<a href="x">{self.words(1, 2)}</a> <a href="y">{self.words(1, 2)}</a>']))

    def page(self) -> list[tuple[int, str]]:
        """Parts in order; opening and closing tags have label -1."""
        r = self.random
        parts: list[tuple[int, str]] = [(-1, "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>")]
        before = [f() for f in (self.header, self.navigation, self.notice, self.advert, self.form) if r.random() < 0.45]
        after = [f() for f in (self.comments, self.sidebar, self.advert, self.extras, self.form, self.notice, self.navigation) if r.random() < 0.4]
        r.shuffle(before)
        r.shuffle(after)
        wrap = r.choice(["", "", '<div class="wrapper">', '<div id="page"><div class="container">', "<main>"])
        holder = r.choice(["<article>", "<article>", "<article>", f"<article{self.attributes(ARTICLE)}>", "<main>", f"<div{self.attributes(ARTICLE)}>", f"<div{self.attributes(ARTICLE)}>", f"<section{self.attributes(ARTICLE)}>", '<div role="main">', "<main><article>", ""])
        late = [self.comments() if r.random() < 0.5 else self.extras()] if r.random() < 0.3 else []
        parts += [(0, x) for x in before] + [(-1, wrap + holder)] + self.article() + [(0, x) for x in late]
        parts.append((-1, "".join(f"</{t}>" for t in reversed([x.split()[0].strip("<>") for x in holder.split("><") if x]))))
        parts += [(0, x) for x in after]
        if r.random() < 0.8:
            parts.append((0, self.footer()))
        return [*parts, (-1, "</body></html>")]
