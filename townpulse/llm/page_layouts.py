"""Labelled pages to learn from: texts of real pages laid out anew in many ways.

Which of a layout's blocks belong to the article is known because the layout puts them there.
"""

from __future__ import annotations

import numpy as np

from townpulse.llm.html_blocks import Block, names_of, path_features

Element = tuple[str, str]

# Fixed values: (element, attributes) that pages use for the article and for what surrounds it.
ARTICLES: list[Element] = [
    ("article", ""), ("article", 'class="post"'), ("main", ""), ("main", 'id="main"'),
    ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="article-body"'),
    ("div", 'class="entry-content"'), ("div", 'class="post-text"'), ("section", 'class="story"'),
    ("div", 'id="main-text"'), ("div", 'role="main"'), ("section", 'class="article"'), ("div", ""),
]
SURROUNDINGS: dict[str, list[Element]] = {
    "menu": [
        ("nav", ""), ("nav", 'class="navbar"'), ("ul", 'class="menu"'), ("div", 'class="nav"'),
        ("div", 'id="navigation"'), ("div", 'class="breadcrumbs"'), ("div", 'class="pagination"'),
        ("div", 'role="navigation"'), ("menu", ""), ("div", 'class="topbar"'), ("div", 'class="toc"'),
    ],
    "header": [
        ("header", ""), ("div", 'class="header"'), ("div", 'id="masthead"'), ("div", 'class="site-title"'),
        ("div", 'role="banner"'), ("header", 'class="site-header"'), ("div", 'class="logo"'),
    ],
    "footer": [
        ("footer", ""), ("div", 'class="footer"'), ("div", 'id="footer"'), ("div", 'class="copyright"'),
        ("div", 'class="legal"'), ("footer", 'class="site-footer"'), ("div", 'role="contentinfo"'),
    ],
    "side": [
        ("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="related"'),
        ("div", 'class="widget"'), ("section", 'class="recommended"'), ("div", 'class="share social"'),
        ("div", 'class="tags"'), ("div", 'role="complementary"'), ("aside", 'class="side"'),
        ("div", 'class="trending popular"'),
    ],
    "notice": [
        ("div", 'class="cookie-notice"'), ("div", 'class="notice"'), ("div", 'id="cookie-banner"'),
        ("div", 'class="alert"'), ("div", 'class="consent popup"'), ("div", 'role="alert"'),
        ("div", 'class="newsletter subscribe"'), ("dialog", ""), ("div", 'class="modal"'),
        ("p", 'class="notice"'), ("section", 'class="gdpr privacy"'), ("div", 'class="paywall"'),
    ],
    "advert": [
        ("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'),
        ("div", 'class="advertisement"'), ("aside", 'class="promo"'), ("div", 'class="sponsored"'),
        ("div", 'id="ad-slot"'), ("p", 'class="ad"'), ("section", 'class="sponsor"'), ("div", 'class="banner"'),
    ],
    "form": [
        ("form", ""), ("form", 'class="login"'), ("form", 'id="search"'), ("fieldset", ""),
        ("div", 'class="search-form"'), ("form", 'class="signup"'),
    ],
    "comments": [
        ("section", 'id="comments"'), ("div", 'class="comments"'), ("ol", 'class="comment-list"'),
        ("ul", 'class="comments"'), ("div", 'class="discussion"'), ("div", 'class="replies"'),
        ("div", 'id="comments"'), ("section", 'class="responses"'), ("div", 'class="reader-comments"'),
    ],
}
NEUTRAL: list[Element] = [
    ("div", ""), ("div", 'class="row"'), ("div", 'class="container"'), ("div", 'id="page"'), ("section", ""),
    ("div", 'class="wrapper"'), ("div", 'class="inner"'), ("div", 'class="col"'), ("div", 'class="block"'),
]
PARTS: list[Element] = [
    ("p", ""), ("p", ""), ("p", ""), ("p", ""), ("h2", ""), ("h3", ""), ("li", ""), ("blockquote", ""), ("pre", ""),
    ("td", ""), ("div", ""), ("figcaption", ""), ("dd", ""), ("th", ""),
]
ABOVE = {"li": "ul", "td": "table", "th": "table", "figcaption": "figure", "dd": "dl"}


class Layouts:
    """Random pages over the given texts of articles and of their surroundings."""

    def __init__(self, articles: list[str], surroundings: list[str], seed: int):
        self.random = np.random.default_rng(seed)
        self.articles = articles or ["Word word, word."]
        self.surroundings = surroundings or self.articles

    def chance(self, p: float) -> bool:
        return bool(self.random.random() < p)

    def pick(self, values: list):
        return values[int(self.random.integers(len(values)))]

    def words(self, texts: list[str], least: int, most: int) -> str:
        words = self.pick(texts).split()
        size = min(len(words), int(np.exp(self.random.uniform(np.log(least), np.log(most + 1)))))
        at = int(self.random.integers(len(words) - size + 1))
        return " ".join(words[at : at + max(1, size)])

    def page(self) -> tuple[list[Block], list[int]]:
        """Blocks and, for each, whether it belongs to the article."""
        blocks: list[Block] = []
        labels: list[int] = []

        def add(path: list[Element], label: int, text: str, link_share: float = 0.0) -> None:
            names = [names_of(*e) for e in path]
            blocks.append(Block(text, path_features(names), tuple(n[0] for n in names), link_share))
            labels.append(label)

        def surrounding(kind: str, path: list[Element]) -> None:
            box = [*path, self.pick(SURROUNDINGS[kind])]
            if self.chance(0.25):
                box.append(self.pick(NEUTRAL))
            if kind == "menu" or (kind in ("side", "footer") and self.chance(0.5)):
                if self.chance(0.3):
                    add([*box, ("h3", "")], 0, self.words(self.surroundings, 1, 4))
                listed = [] if box[-1][0] in ("ul", "menu") else [("ul", "")]
                for _ in range(int(self.random.integers(1, 9))):
                    add([*box, *listed, ("li", "")], 0, self.words(self.surroundings, 1, 8), 1.0)
            elif kind == "comments":
                for _ in range(int(self.random.integers(1, 7))):
                    leaf = self.pick(
                        [[("p", "")], [("li", "")], [("div", 'class="comment"')], [("article", ""), ("p", "")],
                         [("div", 'class="comment"'), ("p", "")], [("li", 'class="comment"'), ("div", 'class="text"')],
                         [("blockquote", "")]]
                    )
                    add([*box, *leaf], 0, self.words(self.articles, 2, 80))
            elif kind == "form":
                for _ in range(int(self.random.integers(1, 4))):
                    add([*box, self.pick([("label", ""), ("button", ""), ("p", ""), ("select", "")])], 0,
                        self.words(self.surroundings, 1, 6))
            else:
                for _ in range(int(self.random.integers(1, 4))):
                    leaf = self.pick([[], [("p", "")], [("h3", "")], [("div", "")]])
                    link = 1.0 if self.chance(0.2) else 0.0
                    add([*box, *leaf], 0, self.words(self.pick([self.surroundings, self.articles]), 1, 40), link)

        root: list[Element] = [("html", ""), ("body", "")]
        root += [self.pick(NEUTRAL) for _ in range(int(self.random.integers(0, 3)))]
        for kind in self.random.permutation(["header", "menu", "notice", "advert", "form", "side"]).tolist():
            if self.chance(0.45):
                surrounding(kind, root)
        outer = [*root, *([self.pick(NEUTRAL)] if self.chance(0.3) else [])]
        if self.chance(0.2):
            outer.append(("main", ""))
        inner = [*outer, self.pick(ARTICLES), *([self.pick(NEUTRAL)] if self.chance(0.2) else [])]
        if self.chance(0.8):
            add([*inner, ("h1", "")], 1, self.words(self.articles, 1, 14))
        for _ in range(int(np.exp(self.random.uniform(0, 3.2)))):
            part = self.pick(PARTS[:4] if self.chance(0.6) else PARTS)
            above = [(ABOVE[part[0]], "")] if part[0] in ABOVE else []
            if part[0] == "td" or part[0] == "th":
                above.append(("tr", ""))
            for _ in range(int(self.random.integers(1, 4)) if above else 1):
                link = float(self.random.random()) if self.chance(0.1) else 0.0
                add([*inner, *above, part], 1, self.words(self.articles, 1, 120), link)
            if self.chance(0.15):
                surrounding(self.pick(["advert", "side", "form", "notice", "advert", "menu"]), inner)
        if self.chance(0.35):
            surrounding("comments", self.pick([inner, outer, root]))
        for kind in self.random.permutation(["side", "footer", "notice", "advert", "menu", "form"]).tolist():
            if self.chance(0.7 if kind == "footer" else 0.3):
                surrounding(kind, self.pick([outer, root, root]))
        return blocks, labels
