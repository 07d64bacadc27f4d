"""Web pages as sequences of leaf blocks: text, the elements above it, and how much of it is links.

A block is the text between two borders of block elements; inline elements stay inside it. Elements
that a later tag ends by implication (p, li, td and such) are closed like in a browser, stray end tags
are ignored, and what scripts, styles, titles, comments and the like hold is no text. Runs of white space
(of Unicode, no-break spaces too) become one space.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

# Path features are numbers below this; a block's own element has numbers of its own.
PATH_FEATURES = 2048
# Elements above a block that count as its path.
PATH_DEPTH = 24

_ATTRIBUTES = r"""((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)"""
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(script|style|title|textarea|noscript|template|iframe|svg|math)\b"
    + _ATTRIBUTES
    + r">(?:.*?</\1\s*>|.*\Z)"
    + r"|<(/?)([a-z][a-z0-9:-]*+)"
    + _ATTRIBUTES
    + r">|<[!?/][^>]*+>",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav "
    "ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
BREAKS = frozenset(("br", "hr"))
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}


@dataclass
class Block:
    text: str
    features: tuple[int, ...]
    tags: tuple[str, ...]
    link_share: float


@functools.lru_cache(maxsize=8192)
def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The element's name and the words of its class, id and role."""
    found = [w for value in NAMES.findall(attributes) for w in re.findall(r"[a-z]+", value.lower())]
    return (tag, *("." + w for w in found))


@functools.lru_cache(maxsize=1 << 16)
def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_FEATURES


def path_features(path: list[tuple[str, ...]]) -> tuple[int, ...]:
    """Numbers of the names above a block, and once more of those of the nearest element."""
    near = path[-PATH_DEPTH:]
    above = [_feature(name) for names in near for name in names]
    return (*above, *(_feature("=" + name) for name in (near[-1] if near else ("",))))


def blocks_of(page: str | None) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                share = min(1.0, linked / max(1, sum(map(len, pieces))))
                out.append(Block(text, path_features(stack), tuple(names[0] for names in stack), share))
            pieces.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        pieces.append(piece)
        linked += len(piece) * in_link

    def close() -> None:
        open_tags[stack.pop()[0]] -= 1

    page, at = page or "", 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = (token[4] or "").lower()
        if tag == "a":
            in_link = not token[3]
        elif tag in BREAKS:
            add(" ")
        elif tag in BLOCKS:
            flush()
            if token[3]:
                if open_tags[tag]:
                    while stack[-1][0] != tag:
                        close()
                    close()
            else:
                ended = CLOSED_BY.get(tag, ())
                while stack and (stack[-1][0] in ended or stack[-1][0] == "p"):
                    close()
                stack.append(names_of(tag, token[5]))
                open_tags[tag] += 1
    add(page[at:])
    flush()
    return out
