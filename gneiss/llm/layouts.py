"""Labelled pages to learn extraction from: random layouts whose elements say whether they hold main text.

An element with data-main="1" begins main text, one with data-main="0" something else; the others are as
their parents are. Layouts differ in tags, names, nesting, lengths and order, words are invented.
"""

from __future__ import annotations

import random

MAIN_NAMES = "content post post-content entry-content article articleBody article-body story main main-content body-text text page-content blog-post news-text prose".split()
OTHER_NAMES = (
    "ad ads adbox ad-slot adsense advert advertisement banner sponsor sponsored promo promotion nav navbar navigation menu topmenu breadcrumb breadcrumbs header masthead site-header footer site-footer "
    "copyright legal sidebar side-bar aside widget widgets related recommended more-stories share social sharing cookie cookies cookie-banner cookie-notice consent gdpr notice notification alert popup modal "
    "overlay newsletter subscribe signup login register search searchbox toolbar pagination pager tags tagcloud metadata byline disclaimer hidden skip comments comment comment-list reply respond disqus discussion "
    "feedback reader-comments user-comments"
).split()
WORDS_OF_NAMES = "col row box wrap inner outer left right top bottom main-wrap section block item unit grid area zone".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.sounds = ["".join(rng.choice("bcdfghklmnprstvwzçñß") + rng.choice("aeiouyéü") for _ in range(rng.randint(1, 3))) for _ in range(200)]

    def words(self, least: int, most: int) -> str:
        return " ".join(self.rng.choice(self.sounds) + self.rng.choice(["", "", "", "n", "s", "ter"]) for _ in range(self.rng.randint(least, most)))

    def sentence(self) -> str:
        rng = self.rng
        out = self.words(1, rng.choice([2, 6, 18]))
        if rng.random() < 0.4:
            out += ", " + self.words(1, 8)
        return out[:1].upper() + out[1:] + rng.choice([".", ".", ".", "!", "?", "&amp;", "%%%", ""])

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice([1, 1, 2, 3, 8, 20])))

    def attribute(self, names: list[str], chance: float) -> str:
        rng = self.rng
        if rng.random() > chance:
            return ""
        name = rng.choice(names)
        extra = rng.choice(WORDS_OF_NAMES + [f"{rng.choice('abcxyz')}{rng.randint(1, 999)}"])
        value = rng.choice([name, f"{name} {extra}", f"{name}-{rng.randint(1, 9)}", f"{extra} {name}", name.replace("-", "_"), name.title().replace("-", "")])
        return f' {rng.choice(["class", "class", "class", "id"])}="{value}"'

    def mark(self, tag: str, names: list[str], chance: float, inside: str, main: bool) -> str:
        return f'<{tag}{self.attribute(names, chance)} data-main="{int(main)}">{inside}</{tag}>'

    # --- what is not main text

    def links(self, least: int = 2) -> str:
        rng = self.rng
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(rng.randint(least, 9))]
        style = rng.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{i}{'</li>' if style < 0.5 else ''}" for i in items) + "</ul>"
        return rng.choice([" | ", " ", " &middot; "]).join(items)

    def menu(self) -> str:
        names = "nav navbar navigation menu topmenu breadcrumb breadcrumbs pagination pager".split()
        return self.mark("nav", names, 0.4, self.links(), False) if self.rng.random() < 0.5 else self.mark("div", names, 1, self.links(), False)

    def form(self) -> str:
        fields = "".join(self.rng.choice([f"<label>{self.words(1, 3)}</label><input name=q>", "<input type=text>", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>", f"<textarea>{self.words(0, 4)}</textarea>", f"<p>{self.sentence()}</p>"]) for _ in range(self.rng.randint(1, 4)))
        return self.mark("form", "newsletter subscribe signup login register search searchbox".split(), 0.5, f"{fields}<button>{self.words(1, 2)}</button>", False)

    def notice(self) -> str:
        names = "cookie cookies cookie-banner cookie-notice consent gdpr notice notification alert popup modal overlay disclaimer".split()
        inside = self.rng.choice([self.prose(), f"<p>{self.prose()}</p><button>{self.words(1, 2)}</button>", f"<p>{self.sentence()} <a href=#>{self.words(1, 2)}</a></p>"])
        tag = self.rng.choice(["div", "div", "section", "aside", "dialog", "p"])
        if self.rng.random() < 0.2 and tag == "div":
            return f'<div role="{self.rng.choice(["alert", "dialog", "alertdialog", "banner"])}" data-main="0">{inside}</div>'
        return self.mark(tag if tag != "p" or "<p>" not in inside else "div", names, 1, inside, False)

    def advert(self) -> str:
        names = "ad ads adbox ad-slot adsense advert advertisement banner sponsor sponsored promo promotion".split()
        inside = self.rng.choice([self.sentence(), self.prose(), f"<p>{self.prose()}</p>", f'<a href="/x">{self.sentence()}</a>', f"<h4>{self.words(1, 4)}</h4><p>{self.sentence()}</p>"])
        tag = self.rng.choice(["div", "div", "div", "aside", "section", "span", "p"])
        return self.mark(tag if not (tag in ("span", "p") and ("<p>" in inside or "<h4>" in inside)) else "div", names, 1, inside, False)

    def comments(self) -> str:
        each = "".join(
            self.rng.choice([f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.prose()}</p></div>', f"<li><p>{self.prose()}</p></li>", f"<p>{self.prose()}</p>", f'<article class="comment"><p>{self.prose()}</p></article>'])
            for _ in range(self.rng.randint(1, 6))
        )
        names = "comments comment comment-list reply respond disqus discussion feedback reader-comments user-comments".split()
        return self.mark(self.rng.choice(["div", "section", "ol", "aside"]), names, 1, (f"<h3>{self.words(1, 2)}</h3>" if self.rng.random() < 0.6 else "") + each, False)

    def sidebar(self) -> str:
        inside = "".join(self.rng.choice([f"<h3>{self.words(1, 3)}</h3>", self.links(), f"<p>{self.prose()}</p>", f"<ul><li>{self.sentence()}</li></ul>"]) for _ in range(self.rng.randint(1, 4)))
        names = "sidebar side-bar aside widget widgets related recommended more-stories share social tags tagcloud".split()
        return self.mark("aside", names, 0.4, inside, False) if self.rng.random() < 0.5 else self.mark("div", names, 1, inside, False)

    def head(self) -> str:
        inside = self.rng.choice([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 2)}</a>', f"<p>{self.sentence()}</p>", f"<h2>{self.words(1, 4)}</h2>" + self.links()])
        names = "header masthead site-header toolbar banner".split()
        return self.mark("header", names, 0.4, inside, False) if self.rng.random() < 0.6 else self.mark("div", names, 1, inside, False)

    def foot(self) -> str:
        inside = self.rng.choice([f"&copy; {self.words(1, 3)} &middot; {self.prose()}", f"<p>&copy; {self.prose()}</p>", self.links(), f"<small>{self.sentence()}</small>", f"<p>{self.prose()}</p>" * 2])
        names = "footer site-footer copyright legal disclaimer".split()
        return self.mark("footer", names, 0.3, inside, False) if self.rng.random() < 0.7 else self.mark("div", names, 1, inside, False)

    def other(self) -> str:
        return self.rng.choice([self.menu, self.form, self.notice, self.advert, self.comments, self.sidebar])()

    # --- main text

    def inline(self) -> str:
        rng, text = self.rng, self.prose()
        if rng.random() < 0.3:
            tag = rng.choice(["b", "i", "em", "strong", "span", "code", 'a href="/y"', "sup", "mark", "u"])
            text += f" <{tag}>{self.words(1, 4)}</{tag.split()[0]}> {self.sentence()}"
        return text

    def body(self) -> str:
        rng, out = self.rng, []
        plain = rng.random() < 0.15  # paragraphs by line breaks only
        for _ in range(rng.choice([1, 1, 2, 4, 8, 16])):
            kind = rng.random()
            if plain:
                out.append(self.inline() + "<br>" * rng.randint(1, 2))
            elif kind < 0.55:
                out.append(f"<p>{self.inline()}</p>")
            elif kind < 0.63:
                out.append(f"<p><b>{self.prose()}<br>")
            elif kind < 0.68:
                out.append(f"<p>{self.inline()}\n")
            elif kind < 0.75:
                out.append(f"<h{rng.randint(2, 4)}>{self.words(1, 6)}</h2>")
            elif kind < 0.8:
                out.append("<ul>" + "".join(f"<li>{self.inline()}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.84:
                out.append(f"<blockquote><p>{self.inline()}</p></blockquote>")
            elif kind < 0.88:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.9:
                out.append(f"<pre>{self.words(2, 9)}\n  {self.words(2, 9)}</pre>")
            elif kind < 0.93:
                out.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            elif kind < 0.96:
                out.append(f"<div><p>{self.inline()}</p><p>{self.inline()}</p></div>")
            else:
                out.append(f"<section><h3>{self.words(1, 5)}</h3><p>{self.inline()}</p></section>")
            if rng.random() < 0.1:
                out.append(rng.choice([self.advert, self.sidebar, self.form, self.notice])())
            if rng.random() < 0.03:
                out.append('<script>var t="</p>";</script>')
        return "".join(out)

    def main(self) -> str:
        rng = self.rng
        inside = (f"<h1>{self.sentence() if rng.random() < 0.7 else self.prose()}</h1>" if rng.random() < 0.8 else "") + self.body()
        while rng.random() < 0.25:
            inside += rng.choice([self.comments, self.form, self.sidebar, self.advert, self.notice])()
        style = rng.random()
        if style < 0.45:
            return self.mark("article", MAIN_NAMES, 0.3, inside, True)
        if style < 0.6:
            return self.mark("main", MAIN_NAMES, 0.3, inside, True)
        if style < 0.9:
            return self.mark("div", MAIN_NAMES, 1, inside, True)
        if style < 0.95:
            return self.mark("section", MAIN_NAMES, 0.8, inside, True)
        return f'<table><tr><td data-main="1">{inside}</td></tr></table>'

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.04:  # nothing but text
            return f'<html><head><title>{self.words(1, 5)}</title></head><body data-main="1">{self.body()}</body></html>'
        before = [make() for make, chance in ((self.head, 0.5), (self.menu, 0.7), (self.notice, 0.2), (self.advert, 0.4), (self.form, 0.1), (self.sidebar, 0.15)) if rng.random() < chance]
        after = [make() for make, chance in ((self.comments, 0.3), (self.sidebar, 0.3), (self.form, 0.15), (self.advert, 0.2), (self.notice, 0.15), (self.foot, 0.8)) if rng.random() < chance]
        if rng.random() < 0.3:
            rng.shuffle(before)
        core = self.main() if rng.random() < 0.98 else ""
        if rng.random() < 0.4:
            n = rng.randint(0, len(after))
            core = f"<{(tag := rng.choice(['div', 'main', 'section', 'div']))}{self.attribute(WORDS_OF_NAMES, 0.6)}>{core}{''.join(after[:n])}</{tag}>"
            after = after[n:]
        if rng.random() < 0.1:  # a fragment
            return rng.choice([core, "".join(before) + core, core + "".join(after), f"<body>{core}"])
        head = f'<head><meta charset="utf-8"><title>{self.sentence()}</title><style>p{{margin:0}}</style><script>track(1)</script></head>'
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- c -->{core}{''.join(after)}{'</body></html>' if rng.random() < 0.9 else ''}"


def labelled_pages(count: int = 600, seed: int = 1) -> list[str]:
    """`count` labelled pages; the same for the same seed."""
    rng = random.Random(seed)
    return [_Writer(random.Random(rng.random())).page() for _ in range(count)]
