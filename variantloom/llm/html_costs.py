"""What it costs to call a text block of a web page content or boilerplate: a logistic model of block features.

The model is fitted here, on pages that are made up by seeded rules: articles in many layouts (semantic elements, named
and nameless containers, tables, pages wrapped in a form) among menus, notices, adverts, link lists, comments and
footers. The fit starts from, and is held to, prior weights that say what each feature means (Gaussian prior, Newton
steps), so that layouts which the made-up pages lack are judged by these.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np

_SENTENCE = re.compile(r"[.!?…](?:\s|$)")
_NOTICE = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b.*\b(?:accept|consent|agree)|\bprivacy policy\b|\bterms of (?:use|service)\b", re.IGNORECASE)
#: Features with the mean of their prior weight; a weight's prior deviation is SPREAD.
PRIOR = {
    "bias": 0.8, "speaks_for": 6.0, "speaks_against": -12.6, "p": 1.0, "h1": 1.5, "h2": 1.0, "h3": 0.7, "h4": 0.5, "quote": 1.0, "item": -0.2,
    "cell": -0.3, "length": 2.0, "sentences": 1.2, "linked": -5.0, "notice": -3.0, "commas": 0.0, "few_words": 0.0, "digits": 0.0, "ends_open": 0.0,
}
SPREAD = 0.7
_LEAF = {"p": "p", "h1": "h1", "h2": "h2", "h3": "h3", "h4": "h4", "blockquote": "quote", "pre": "quote", "figcaption": "quote", "li": "item", "dd": "item", "td": "cell"}
_AT = {k: i for i, k in enumerate(PRIOR)}


def features(leaf: str, speaks_for: float, speaks_against: float, text: str, linked: int) -> np.ndarray:
    """Features of a block in an element, with the strongest words for (up to 6) and against (down to -9) it around it."""
    x, n = np.zeros(len(PRIOR)), len(text)
    x[0], x[1], x[2] = 1.0, speaks_for / 6, -speaks_against / 9
    if leaf in _LEAF:
        x[_AT[_LEAF[leaf]]] = 1.0
    x[_AT["length"]] = min(n, 400) / 400
    x[_AT["sentences"]] = min(len(_SENTENCE.findall(text)), 3) / 3
    x[_AT["linked"]] = min(linked / max(n, 1), 1.0)
    x[_AT["notice"]] = n < 300 and _NOTICE.search(text) is not None
    x[_AT["commas"]] = min(text.count(",") / max(n, 1) * 50, 1.0)
    x[_AT["few_words"]] = text.count(" ") < 3
    x[_AT["digits"]] = sum(map(str.isdigit, text[:400])) / max(min(n, 400), 1)
    x[_AT["ends_open"]] = text[-1:] not in ".!?…:\"'”»)"
    return x


def fit(x: np.ndarray, y: np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights of the greatest posterior for features x and labels y (1: content)."""
    mean = np.array(list(PRIOR.values()))
    w = mean.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + (w - mean) / SPREAD**2
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / SPREAD**2, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


_WORDS = "time river house letter morning market engine garden winter question table window people water paper village music doctor answer harbour bridge valley summer teacher measure kitchen painter island mountain report".split()


class Maker:
    """Made-up pages, each with the texts of its content blocks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def sentence(self, lo: int = 5, hi: int = 18) -> str:
        w = self.r.choices(_WORDS, k=self.r.randint(lo, hi))
        return (" ".join(w)).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def phrase(self, lo: int = 1, hi: int = 4) -> str:
        return " ".join(self.r.choices(_WORDS, k=self.r.randint(lo, hi))).capitalize()

    def wrap(self, body: str, names: list[str], kinds: list[str]) -> str:
        kind, name = self.r.choice(kinds), self.r.choice(names)
        key = self.r.choice(["class", "id"])
        return f"<{kind} {key}={self.r.choice(['{}', '"{}"'])}>".format(name) + body + f"</{kind}>" if name else f"<{kind}>{body}</{kind}>"

    def article(self) -> tuple[str, list[str]]:
        r, out, texts = self.r, [], []

        def put(tag: str, text: str, markup: str = "") -> None:
            texts.append(text)
            out.append(f"<{tag}>{markup or text}</{tag}>")

        put(r.choice(["h1", "h1", "h2"]), self.phrase(2, 7))
        leaf = r.choice(["p", "p", "p", "div"])
        for _ in range(r.randint(2, 9)):
            kind = r.random()
            text = " ".join(self.sentence() for _ in range(r.randint(1, 6)))
            if kind < 0.08:
                put(r.choice(["h2", "h3", "h3", "h4"]), self.phrase(1, 5))
            elif kind < 0.14:
                put("blockquote", text)
            elif kind < 0.22:
                out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    put("li", self.sentence(3, 9))
                out.append("</ul>")
            elif kind < 0.3:
                put(leaf, self.sentence(1, 4))
            else:
                head, _, tail = text.partition(" ")
                put(leaf, text, f"<a href=/x>{head}</a> {tail}" if r.random() < 0.2 else text)
        return "".join(out), texts

    def links(self) -> str:
        one = [f"<a href='/{i}'>{self.phrase(1, 5)}</a>" for i in range(self.r.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in one) + "</ul>" if self.r.random() < 0.6 else " | ".join(one)

    def boiler(self) -> str:
        r = self.r
        none = ["", "", "c1", "box", "grid-4"]
        return r.choice([
            lambda: self.wrap(self.links(), [*none, "nav", "menu", "top-menu", "sidebar"], ["nav", "div", "div", "section"]),
            lambda: self.wrap(f"<h3>{self.phrase()}</h3>" + self.links(), [*none, "related", "widget"], ["aside", "div", "section"]),
            lambda: self.wrap(f"<p>© 20{r.randint(10, 29)} {self.phrase()}. All rights reserved.</p>", [*none, "footer"], ["footer", "div"]),
            lambda: self.wrap(f"<p>We use cookies. {self.sentence(3, 8)} Accept all to agree.</p>", ["cookie-notice", "consent", "c9"], ["div", "section"]),
            lambda: self.wrap("".join(f"<p>{self.phrase(1, 2)}: {self.sentence()} {self.sentence(2, 6)}</p>" for _ in range(r.randint(1, 4))), ["comments", "replies", "disqus_thread"], ["div", "section"]),
            lambda: self.wrap(f"<p>{self.sentence(2, 7)}</p>", ["ad", "advert", "promo", "banner", "newsletter"], ["div", "aside"]),
            lambda: self.wrap(f"<label>{self.phrase()}</label><input name=q>{self.phrase()}", ["search", "signup", ""], ["form"]),
        ])()

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        body, texts = self.article()
        body = self.wrap(body, ["", "", "c2", "content", "post", "story", "x7"], ["article", "main", "div", "div", "section", "td"])
        if body.startswith("<td"):
            body = f"<table><tr>{body}</tr></table>"
        before, after = "".join(self.boiler() for _ in range(r.randint(0, 3))), "".join(self.boiler() for _ in range(r.randint(1, 4)))
        whole = before + body + after
        for _ in range(r.randint(0, 3)):
            whole = f"<div class={r.choice(['wrap', 'page', 'layout', 'c0'])}>{whole}</div>"
        if r.random() < 0.1:
            whole = f"<form id=aspnetForm action=/>{whole}</form>"
        return f"<html><head><title>{self.phrase()}</title></head><body>{whole}</body></html>", texts


@lru_cache(maxsize=4)
def weights(pages: int = 400, seed: int = 1) -> tuple[float, ...]:
    """The fitted weights; made once on the driver, a second's work that no data changes."""
    from .html_text import block_features, blocks_of

    make, x, y = Maker(seed), [], []
    for _ in range(pages):
        html, texts = make.page()
        mine = set(texts)
        for b in blocks_of(html):
            x.append(block_features(b))
            y.append(float(b.text in mine))
    return tuple(fit(np.array(x), np.array(y)).tolist())
