"""Planted pages with labelled blocks, from which the classifier of html_text learns: made by rules from a seed, in three
styles of markup (elements that say what they hold, names that say it, and nothing that says it). Content is marked with MARK."""

from __future__ import annotations

import random

MARK = "\ue000"
#: Class names of boilerplate and of content in pages whose names say what they hold.
NAMES = {"menu": ("nav", "main-menu", "navbar"), "header": ("header", "masthead", "site-header"), "crumbs": ("breadcrumbs",), "sidebar": ("sidebar", "widget", "side-column"), "notice": ("cookie-notice", "notice", "newsletter-signup"), "advert": ("ad", "advert", "sponsored"), "form": ("login-form", "search-form"), "related": ("related", "recommended"), "comments": ("comments", "commentlist", "discussion"), "footer": ("footer", "site-footer", "legal"), "content": ("content", "post-body", "entry", "story")}
ELEMENTS = {"menu": "nav", "header": "header", "crumbs": "nav", "sidebar": "aside", "notice": "aside", "advert": "aside", "form": "form", "related": "aside", "comments": "section", "footer": "footer", "content": "article"}


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        syllables = [a + b for a in "bdfgklmnprstv" for b in "aeiou"]
        self.words = ["".join(self.rng.choices(syllables, k=self.rng.randrange(1, 5))) for _ in range(600)]

    def sentence(self, low: int, high: int) -> str:
        some = self.rng.choices(self.words, k=self.rng.randrange(low, high))
        if len(some) > 8 and self.rng.random() < 0.7:
            some[len(some) // 2] += ","
        return " ".join(some).capitalize() + self.rng.choice("....!?")

    def phrase(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.rng.choices(self.words, k=self.rng.randrange(low, high))).capitalize()

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{text}</a>'

    def linked(self, text: str, share: float) -> str:
        words = text.split(" ")
        n = round(len(words) * share)
        at = self.rng.randrange(len(words) - n + 1)
        return " ".join([*words[:at], self.link(" ".join(words[at : at + n])), *words[at + n :]]) if n else text

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link(self.phrase())}</li>" for _ in range(n)) + "</ul>"

    def article(self) -> str:
        """Blocks of the content, each with MARK before its first word."""
        rng, out = self.rng, [f"<h1>{MARK}{self.phrase(2, 9)}</h1>"]
        for _ in range(rng.randrange(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                text = " ".join(self.sentence(3, 22) for _ in range(rng.choice([1, 1, 2, 4, 6])))
                out.append(f"<p>{MARK}{self.linked(text, rng.choice([0, 0, 0, 0.1, 0.4]))}</p>")
            elif kind < 0.78:
                out.append(f"<h2>{MARK}{self.phrase(1, 7)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.phrase(1, 9)}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<p>{MARK}{self.phrase(1, 6)}</p>")
            elif kind < 0.95:
                out.append(f"<blockquote><p>{MARK}{self.sentence(4, 15)}</p></blockquote>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.phrase(1, 3)}</td><td>{rng.randrange(999)}</td></tr>" for _ in range(rng.randrange(2, 4))) + "</table>")
        return "".join(out)

    def part(self, kind: str) -> str:
        rng = self.rng
        if kind in ("menu", "related"):
            return (f"<h3>{self.phrase(1, 3)}</h3>" if kind == "related" else "") + self.links(rng.randrange(2, 8))
        if kind == "header":
            return f"<p>{self.link(self.phrase(1, 3))}</p><p>{self.phrase(1, 5)}</p>"
        if kind == "crumbs":
            return "<p>" + " &gt; ".join(self.link(self.phrase(1, 2)) for _ in range(rng.randrange(2, 5))) + "</p>"
        if kind == "sidebar":
            return f"<h3>{self.phrase(1, 3)}</h3>" + (f"<p>{self.sentence(3, 14)}</p>" if rng.random() < 0.5 else "") + self.links(rng.randrange(1, 5))
        if kind in ("notice", "advert"):
            return f"<p>{self.linked(self.sentence(3, 14), rng.choice([0, 0.2, 0.5]))}</p>"
        if kind == "form":
            return f"<p>{self.phrase(1, 5)}</p><input type=text><button>{self.phrase(1, 2)}</button>"
        if kind == "comments":
            return f"<h3>{self.phrase(1, 3)}</h3>" + "".join(f"<div><p>{self.phrase(1, 3)} {rng.randrange(1, 29)}.{rng.randrange(1, 13)}.2020</p><p>{self.sentence(3, 25)}</p></div>" for _ in range(rng.randrange(1, 5)))
        return f"<p>&copy; 20{rng.randrange(10, 30)} {self.phrase(1, 4)}</p>" + (f"<p>{' '.join(self.link(self.phrase(1, 2)) for _ in range(3))}</p>" if rng.random() < 0.6 else "")

    def boxed(self, kind: str, inner: str, style: str) -> str:
        if style == "weak" and kind != "form":
            return f'<div class="c{self.rng.randrange(90)}">{inner}</div>'
        if style == "elements" or kind == "form":
            name = f' class="{self.rng.choice(NAMES[kind])}"' if kind == "comments" else ""
            return f"<{ELEMENTS[kind]}{name}>{inner}</{ELEMENTS[kind]}>"
        return f'<div class="{self.rng.choice(NAMES[kind])}">{inner}</div>'

    def page(self, style: str) -> str:
        rng = self.rng
        rare = {"comments": 0.2, "sidebar": 0.4} if style == "weak" else {}
        some = lambda kinds: [self.boxed(k, self.part(k), style) for k in kinds if rng.random() < rare.get(k, 0.6)]
        article = self.article()
        if rng.random() < 0.3:  # an advert within the article
            at = article.find("<p>", len(article) // 2)
            article = article[:at] + self.boxed("advert", self.part("advert"), style if style != "weak" else "names") + article[at:] if at > 0 else article
        middle = self.boxed("content", article, style)
        if rng.random() < 0.3:
            middle = f"<div>{middle}</div>"
        return "<html><body>" + "".join([*some(("notice", "header", "menu", "crumbs", "advert")), middle, *some(("comments", "related", "sidebar", "form", "advert", "footer"))]) + "</body></html>"


def pages(n: int, seed: int, styles: tuple[str, ...] = ("elements", "names", "weak")) -> list[str]:
    maker = Maker(seed)
    return [maker.page(styles[i % len(styles)]) for i in range(n)]
