"""Labelled pages that the extraction of main text is trained on, made from a seed.

``data-label`` says of an element and all below it that it is content, other, or both (mixed). Frames, class
names and the order of parts vary, and so does how much they give away.
"""

from __future__ import annotations

import random
import re

# Words of class names and phrases that are common on web pages.
CONTENT = "content article post entry story main body text single blog page document prose markdown news".split()
PLAIN = "container wrapper wrap inner outer row col grid box block section site layout center left main-col".split()
MENUS = "nav menu navbar navigation breadcrumb breadcrumbs topbar tabs links pagination pager toc sitemap".split()
HEADERS = "header masthead site-header page-header top banner branding logo hero-nav".split()
FOOTERS = "footer site-footer page-footer bottom copyright legal credits colophon".split()
SIDES = "sidebar side aside widget widgets related recommended popular trending more rail teaser promo secondary".split()
NOTICES = "cookie cookies consent gdpr notice alert notification message warning popup modal overlay newsletter paywall disclaimer".split()
ADVERTS = "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored banner-ad ad-slot promo-box adbox".split()
FORMS = "form search login signup subscribe contact register newsletter-form search-form".split()
COMMENTS = "comment comments commentlist comment-list discussion replies reply responses respond disqus reader-comments thread".split()
SHARES = "share sharing social tags meta tools actions byline-tools author-bio".split()
PHRASES = {
    "nav": "Home|About|Contact|News|Blog|Shop|Products|Services|Login|Register|Archive|Topics|Next|Previous|Startseite|Über uns|Kontakt|Accueil|À propos|Inicio|Contacto",
    "header": "The daily site|Welcome to our site|Your source for news|My blog|Example Times",
    "footer": "© 2024 Example Inc. All rights reserved.|Copyright 2023 Example|Terms of use|Privacy policy|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by Example",
    "side": "Related articles|Most read|Popular posts|You may also like|More stories|Read next|Recent posts|Tags|Follow us",
    "notice": "We use cookies to improve your experience.|This site uses cookies.|Accept all|Accept cookies|Please enable JavaScript.|Subscribe to continue reading.|Wir verwenden Cookies.|Ce site utilise des cookies.|Usamos cookies.|Sign up for our newsletter|You have reached your limit.",
    "advert": "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Buy now!|Limited offer, shop today!|Click here for a special deal",
    "form": "Search|Your name|E-mail address|Password|Send|Submit|Log in|Subscribe|Leave a reply|Suchen|Rechercher",
    "comment": "Reply|3 comments|Leave a comment|says:|Report|Like|2 days ago|Great post, thanks for sharing!|I disagree.",
    "share": "Share|Tweet|Share on social media|Tags: one, two|Print|Bookmark|Filed under",
}
SYLLABLES = "an be ca de en fo ga he in jo ka le mo ne or pa qui re sa te un ver wa xo ya zu ä é ñ ung tion ment ing ly der la".split()


class Layouts:
    """Random pages of one seed."""

    def __init__(self, seed: int = 7) -> None:
        self._r = random.Random(seed)

    def word(self) -> str:
        return "".join(self._r.choices(SYLLABLES, k=self._r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        words = [self.word() for _ in range(self._r.randint(low, high))]
        return self._r.choice(("{}.", "{}.", "{}.", "{}!", "{}?", "{}", "{}, " + self.word() + ".")).format(" ".join(words).capitalize())

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self._r.randint(1, most)))

    def inline(self, text: str) -> str:
        if self._r.random() < 0.05:
            return f'<a href="/{self.word()}">{text}</a>'
        words = text.split(" ")
        for at in range(len(words)):
            if self._r.random() < 0.04:
                kind = self._r.choice(("b", "i", "em", "strong", "code", 'a href="/x"', 'span class="x"'))
                words[at] = f"<{kind}>{words[at]}</{kind.split()[0]}>"
        return " ".join(words) + self._r.choice(("", "", "", "<br>", "<br/>" + self.sentence()))

    def element(self, tag: str, inner: str, names: list[str] | None = None, label: str | None = None, sure: float = 0.85) -> str:
        """An element, mostly with one of the names as class or id."""
        given = ""
        if names and self._r.random() < sure:
            name = self._r.choice(names) + self._r.choice(("", "", "", "-1", "__inner", "-box", "Area", "-wrapper"))
            given = f' {self._r.choice(("class", "class", "id"))}="{name}"'
        mark = f' data-label="{label}"' if label else ""
        return f"<{tag}{given}{mark}>{inner}</{tag}>"

    def phrase(self, kind: str) -> str:
        return self._r.choice(PHRASES[kind].split("|"))

    def links(self, kind: str) -> str:
        items = [f'<a href="/{self.word()}">{self.phrase(kind) if self._r.random() < 0.5 else self.word()}</a>' for _ in range(self._r.randint(2, 9))]
        if self._r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item}</li>" for item in items) + "</ul>"
        return self._r.choice((" | ", " ", " · ")).join(items)

    def heading(self, text: str, names: list[str]) -> str:
        return self.element(self._r.choice(("h2", "h3", "h4")), text, [f"{name}-title" for name in names], sure=0.4)

    def content_blocks(self) -> list[str]:
        r, out = self._r, []
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if r.random() < 0.06:  # words of other parts turn up in content too
                out.append(f"<p>{self.phrase(r.choice(list(PHRASES)))}</p>")
            if kind < 0.62:
                out.append(r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", '<div class="paragraph">{}</div>', "<p><b>{}<br><p>" + self.prose() + "</p>")).format(self.inline(self.prose())))
            elif kind < 0.74:
                out.append("<h{0}>{1}</h{0}>".format(r.randint(2, 4), self.sentence(1, 7)))
            elif kind < 0.82:
                tag = r.choice(("ul", "ol"))
                out.append(f"<{tag}>" + "".join(f"<li>{self.inline(self.sentence(1, 12))}" + r.choice(("</li>", "")) for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif kind < 0.87:
                out.append(f"<blockquote><p>{self.prose(3)}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<pre><code>{self.word()}({self.word()})\n  {self.word()}</code></pre>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><th>{self.word()}</th><td>{self.word()}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f'<figure><img src="x.png"><figcaption>{self.sentence()}</figcaption></figure>')
            if r.random() < 0.08:
                out.append(self.other(r.choice(("advert", "share", "side", "form", "notice"))))
        return out

    def other(self, kind: str) -> str:
        """A part that is not content; some are prose that only names and places tell from it."""
        r = self._r
        prose = self.phrase(kind) + " " + self.prose(4) if r.random() < 0.5 else self.prose(4)
        short = self.phrase(kind)
        if kind == "nav":
            return self.element(r.choice(("nav", "nav", "div", "ul", "section")), self.links(kind), MENUS, "other")
        if kind == "header":
            inner = f'{r.choice(("<h1>{}</h1>", "<a href=/>{}</a>", "<p>{}</p>", "<div>{}</div>"))}'.format(short if r.random() < 0.5 else self.sentence(1, 8))
            return self.element(r.choice(("header", "header", "div")), inner + (self.links("nav") if r.random() < 0.5 else ""), HEADERS, "other")
        if kind == "footer":
            inner = r.choice((short, prose, f"<p>{short}</p>", self.links(kind) + f"<p>{short}</p>", f"&copy; {self.word()}.com &middot; {self.prose(2)}"))
            return self.element(r.choice(("footer", "footer", "div")), inner, FOOTERS, "other")
        if kind == "side":
            inner = self.heading(short, SIDES) + r.choice((self.links(kind), f"<p>{prose}</p>", "".join(f"<div><a href=/x>{self.sentence()}</a></div>" for _ in range(3))))
            return self.element(r.choice(("aside", "aside", "div", "section")), inner, SIDES, "other", 0.95)
        if kind == "notice":
            inner = r.choice((f"<p>{short} {r.choice((self.sentence(), ''))}</p><button>{self.phrase(kind)}</button>", prose, f"<p>{prose}</p>", short))
            return self.element(r.choice(("div", "div", "section", "aside", "p", "dialog")) if "<p" not in inner else "div", inner, NOTICES, "other", 0.95)
        if kind == "advert":
            inner = r.choice((prose, f"<p>{prose}</p>", f"<a href=/x>{short}</a>", f"<span>{short}</span>", self.prose(3)))
            return self.element(r.choice(("div", "div", "div", "section", "aside", "ins")), inner, ADVERTS, "other", 1.0)
        if kind == "form":
            inner = f"<label>{short}</label><input name=q><button>{self.phrase(kind)}</button>" + r.choice(("", f"<p>{self.prose(2)}</p>", "<textarea>x</textarea>"))
            return self.element("form", inner, FORMS, "other")
        if kind == "share":
            return self.element(r.choice(("div", "ul", "section")), self.links(kind), SHARES, "other", 0.95)
        items = []
        for _ in range(r.randint(1, 4)):
            body = r.choice((f"<p>{self.prose(4)}</p>", self.prose(4), f'<div class="comment-body"><p>{self.prose(3)}</p></div>'))
            items.append(self.element(r.choice(("li", "div", "article", "div")), r.choice(("", f"<b>{self.word()}</b> ", f"<h4>{self.word()} says:</h4>")) + body, COMMENTS))
        inner = r.choice(("", self.heading(self.phrase("comment"), COMMENTS))) + "".join(items)
        return self.element(r.choice(("section", "div", "div", "ol")), inner, COMMENTS, "other", 1.0)

    def page(self) -> str:
        r = self._r
        head = r.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>", "<h1 class=title>{}</h1>")).format(self.sentence(2, 12))
        blocks = [head] * (r.random() < 0.85) + self.content_blocks()
        if r.random() < 0.15:
            blocks += [self.other("footer"), self.other("share")]
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section", "td", "td", ""))
        if tag:
            body = self.element(tag, "".join(blocks), CONTENT, "content", 0.75 if tag in ("div", "section", "td") else 0.4)
        else:  # no element around the content; of two labels the second counts
            body = "".join(re.sub(r"^<(\w+)", r'<\1 data-label="content"', block) for block in blocks if "<br><p>" not in block)
        if tag and r.random() < 0.15:
            body = self.element("div", body, CONTENT, "content")
        if r.random() < 0.25:
            body += self.other("comment")
        if tag == "td":
            side = self.element("td", self.links("nav"), MENUS + SIDES, "other", 0.6) if r.random() < 0.7 else ""
            body = f'<table data-label="mixed"><tr>{side}{body}</tr></table>'
        before = [self.other(kind) for kind in ("header", "nav", "notice", "advert", "form") if r.random() < 0.5]
        after = [self.other(kind) for kind in ("side", "comment", "advert", "notice", "footer", "share") if r.random() < 0.45]
        r.shuffle(before)
        whole = "".join(before) + body + "".join(after)
        for _ in range(r.choice((0, 0, 1, 2))):
            whole = self.element(r.choice(("div", "div", "main", "form") if r.random() < 0.2 else ("div",)), whole, PLAIN, "mixed")
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{whole}</body></html>"


def labelled_pages(number: int, seed: int = 7) -> list[str]:
    """So many labelled pages; the same ones for the same seed."""
    layouts = Layouts(seed)
    return [layouts.page() for _ in range(number)]
