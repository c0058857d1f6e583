"""Operator 4: main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. A block has features of its ancestors
(tags, words of class and id, role) and of its text (length, share inside links, punctuation, cue words, place
in the page). The field has two labels, article and other; it is fitted by gradient steps on the likelihood of
labelled pages, and Viterbi finds the best labelling of a page. The blocks labelled article are joined.

Labelled pages are of two kinds: pages that are made here from parts whose label is known (`labelled_pages`), and
at most `sample` pages of the table that mark their article with <article> or <main>, by the order of a hash of
their id. These bounds hold for the fit alone; all blocks of all pages are labelled. The fit cuts pages into stretches
of `stretch` blocks, so that one long page doesn't set the size of all.

Scripts, styles, the other elements whose content HTML takes as raw and never shows as text, comments and tags have
no text. Character references are decoded. White space inside a block becomes one space; a <br> counts as white
space. Quoted attribute values may hold any character.

Defined cases: null and empty pages, and pages without text blocks, give the empty text; tags that are cut off at
the end are dropped; tags that don't match are ignored; pages of any length and depth are read whole; an empty table
gives no rows; repeated rows are extracted alike, and rows that share an id by their own pages; of other columns none
is read.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, per_batch

RAW = "script style title textarea iframe noembed noframes template".split()
#: What follows a tag's name: quotes count only after an equals sign, and then hold any character.
_INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TOKEN = re.compile(rf"""<!--.*?(?:--!?>|\Z)|<({"|".join(RAW)})(?=[\s/>]){_INSIDE}>(?:.*?</\1(?=[\s/>])[^>]*(?:>|\Z)|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPLIT = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
LINK = "\x00"  # marks where links begin and end inside a block's raw text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these ends an open one of its group.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}

TAGS = "nav header footer aside article main form section ul ol li table blockquote figure figcaption pre h1 h2 h3 h4 h5 h6 p button label fieldset dialog address details dl select".split()
ROLES = "navigation banner contentinfo complementary search main article dialog alert".split()
#: Words of class and id, by what they hint at.
CUES = {
    "ad": "ad ads advert adverts advertisement advertising promo promotion promoted sponsor sponsored banner adsense dfp".split(),
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs toolbar tabs tab topbar pagination pager skip sitemap".split(),
    "head": "header masthead head top brand logo site".split(),
    "foot": "footer foot copyright legal bottom colophon credits imprint".split(),
    "side": "sidebar side aside widget widgets rail sidecol secondary".split(),
    "comment": "comment comments reply replies discussion discuss respond responses thread disqus reader feedback reviews".split(),
    "notice": "cookie cookies consent notice notices alert gdpr popup modal overlay warning message privacy banner".split(),
    "form": "form subscribe subscription newsletter signup login search register contact optin".split(),
    "share": "share sharing social follow twitter facebook tools print".split(),
    "related": "related recommended recommendations more popular trending latest teaser also".split(),
    "content": "content article post entry story main text body maincontent articlebody".split(),
}
CUE_OF = {}
for _name, _words in CUES.items():
    for _w in _words:
        CUE_OF.setdefault(_w, []).append(_name)
#: Words of a block's own text.
PHRASES = {
    "legal": re.compile(r"©|\(c\)|copyright|all rights reserved|terms of|privacy", re.I),
    "consent": re.compile(r"cookie|consent|we use|accept all", re.I),
    "join": re.compile(r"subscribe|sign up|newsletter|log ?in|sign in|e-?mail", re.I),
    "talk": re.compile(r"\breply\b|\bsays:|\bcomments?\b|\bposted by\b|upvote", re.I),
    "push": re.compile(r"advert|sponsor|\bbuy\b|% off|\bsale\b|click here|shop now", re.I),
    "more": re.compile(r"read more|related|see also|you may also|most read|share (this|on)|follow us", re.I),
}
NAMES = (
    [f"in:{t}" for t in TAGS] + [f"role:{r}" for r in ROLES] + [f"cue:{c}" for c in CUES] + [f"says:{p}" for p in PHRASES]
    + ["inner header", "inner footer", "outer header", "only other cues", "no landmark"]
    + [f"words:{i}" for i in range(7)] + [f"links:{i}" for i in range(4)]
    + ["ends a sentence", "comma", "bar or dot", "upper case", "digits", "first blocks", "last blocks", "one"]
)
PLACE = {name: i for i, name in enumerate(NAMES)}
OTHER_CUES = frozenset(PLACE[f"cue:{c}"] for c in CUES if c not in ("content", "head"))
#: Lower-case substrings of which any phrase has one: most blocks have none.
HINTS = (
    "©", "(c)", "copyright", "rights reserved", "terms of", "privacy", "cookie", "consent", "we use", "accept all", "subscribe", "sign", "newsletter", "log", "mail", "reply", "says:", "comment", "posted by", "upvote",
    "advert", "sponsor", "buy", "% off", "sale", "click here", "shop now", "read more", "related", "see also", "you may also", "most read", "share", "follow us",
)


@dataclass
class Block:
    text: str
    features: list[int]


class Ancestors:
    """The open elements, and the features that they give to the text inside."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.gives: list[tuple[int, ...]] = []
        self.open: dict[str, int] = {}
        self.held: dict[int, int] = {}  # feature -> open elements that give it
        self.depths: dict[str, list[int]] = {"landmark": [], "header": [], "footer": []}
        self.now: list[int] | None = None  # of features(), until an element with hints opens or closes

    def push(self, tag: str, gives: tuple[int, ...]) -> None:
        kind = "landmark" if tag in ("article", "main") else tag
        if kind in self.depths:
            self.depths[kind].append(len(self.tags))
        self.tags.append(tag)
        self.gives.append(gives)
        self.open[tag] = self.open.get(tag, 0) + 1
        for f in gives:
            self.held[f] = self.held.get(f, 0) + 1
        if gives:
            self.now = None

    def pop(self) -> str:
        tag, gives = self.tags.pop(), self.gives.pop()
        kind = "landmark" if tag in ("article", "main") else tag
        if kind in self.depths:
            self.depths[kind].pop()
        self.open[tag] -= 1
        for f in gives:
            if self.held[f] == 1:
                del self.held[f]
            else:
                self.held[f] -= 1
        if gives:
            self.now = None
        return tag

    def features(self) -> list[int]:
        if self.now is None:
            found = list(self.held)
            landmark = self.depths["landmark"]
            for side in ("header", "footer"):
                if depths := self.depths[side]:
                    inner = bool(landmark) and depths[0] > landmark[0]
                    if inner or side == "header":
                        found.append(PLACE[f"{'inner' if inner else 'outer'} {side}"])
            if not landmark:
                found.append(PLACE["no landmark"])
                if PLACE["cue:content"] not in self.held and not OTHER_CUES.isdisjoint(self.held):
                    found.append(PLACE["only other cues"])
            self.now = found
        return self.now


def decoded(run: str) -> str:
    """A run of text between tags, its character references decoded: none reaches over a tag."""
    run = run.replace(LINK, " ")
    return html.unescape(run) if "&" in run else run


def parse(page: str) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    out: list[Block] = []
    around = Ancestors()
    tags, open_count = around.tags, around.open
    parts: list[str] = []
    inside: list[int] | None = None  # features of the ancestors of a block's first text

    def flush() -> None:
        nonlocal parts, inside
        if inside is not None:
            pieces = "".join(parts).split(LINK)
            text = " ".join("".join(pieces).replace(LINK, "").split())
            if text:
                linked = sum(len(x.strip()) for x in pieces[1::2])
                out.append(Block(text, inside + text_features(text, linked)))
            inside = None
        parts = []

    at, in_link = 0, False
    for m in TOKEN.finditer(page):
        start = m.start()
        if start > at:
            text = page[at:start]
            if inside is None and not text.isspace():
                inside = around.features()
            parts.append(decoded(text))
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] is not None:
                parts.append(" ")
            continue
        tag, closing = tag.lower(), m[2] == "/"
        if tag in BLOCKS:
            if in_link:
                parts.append(LINK)
            flush()
            if in_link:
                parts.append(LINK)
            if closing:
                if open_count.get(tag):
                    while around.pop() != tag:
                        pass
            elif tag not in VOID:
                if tag != "li" and open_count.get("p"):
                    # a block ends an open paragraph, and what is open inside it
                    k = len(tags) - 1
                    while k >= 0 and tags[k] not in BLOCKS:
                        k -= 1
                    if k >= 0 and tags[k] == "p":
                        while len(tags) > k:
                            around.pop()
                if tag in ENDS and any(open_count.get(t) for t in ENDS[tag]):
                    k = len(tags) - 1
                    while k >= 0 and tags[k] not in ENDS[tag] and tags[k] not in SCOPES[tag]:
                        k -= 1
                    if k >= 0 and tags[k] in ENDS[tag]:
                        while len(tags) > k:
                            around.pop()
                around.push(tag, given(tag, m[4]))
        elif tag == "a":
            if in_link == closing:
                parts.append(LINK)
                in_link = not in_link
        elif tag == "br":
            parts.append(" ")
        elif closing:
            if open_count.get(tag):
                k = len(tags) - 1
                while k >= 0 and tags[k] != tag and tags[k] not in BLOCKS:
                    k -= 1
                if k >= 0 and tags[k] == tag:
                    while len(tags) > k:
                        around.pop()
        elif m[4] and tag not in VOID and ("class" in m[4] or "id" in m[4] or "role" in m[4]):
            # of inline elements only those with hints matter
            around.push(tag, given(tag, m[4]))
    if at < len(page):
        text = page[at:]
        if inside is None and not text.isspace():
            inside = around.features()
        parts.append(decoded(text))
    if in_link:
        parts.append(LINK)
    flush()
    n = len(out)
    for i, b in enumerate(out):
        if i < min(4, n / 8):
            b.features.append(PLACE["first blocks"])
        if n - i <= min(4, n / 8):
            b.features.append(PLACE["last blocks"])
    return out


@lru_cache(maxsize=20_000)
def given(tag: str, attributes: str) -> tuple[int, ...]:
    found = {PLACE[f"in:{tag}"]} if f"in:{tag}" in PLACE else set()
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role" and f"role:{value.lower()}" in PLACE:
                found.add(PLACE[f"role:{value.lower()}"])
            elif name in ("class", "id"):
                for w in SPLIT.findall(value):
                    found.update(PLACE[f"cue:{c}"] for c in CUE_OF.get(w.lower(), ()))
    return tuple(sorted(found))


_WORDS, _LINKS = [PLACE[f"words:{i}"] for i in range(7)], [PLACE[f"links:{i}"] for i in range(4)]
_ENDS, _COMMA, _BAR, _UPPER, _DIGITS, _ONE = (PLACE[x] for x in ("ends a sentence", "comma", "bar or dot", "upper case", "digits", "one"))
_SAYS = [(PLACE[f"says:{p}"], pattern) for p, pattern in PHRASES.items()]


def text_features(text: str, linked: int) -> list[int]:
    n = text.count(" ") + 1
    share = linked / len(text)
    found = [_ONE, _WORDS[bisect_left((2, 5, 10, 25, 60, 150), n)], _LINKS[bisect_left((0.0, 0.3, 0.7), share)]]
    lower = text.lower()
    if any(hint in lower for hint in HINTS):
        # one for every sixty words at least
        found += [place for place, pattern in _SAYS if 60 * sum(1 for _ in pattern.finditer(text)) >= n]
    if text[-1] in ".!?…\"'”»":
        found.append(_ENDS)
    if "," in text:
        found.append(_COMMA)
    if "|" in text or "·" in text or "»" in text:
        found.append(_BAR)
    if text.isupper():
        found.append(_UPPER)
    if n <= 10 and sum(c.isdigit() for c in text) * 4 > len(text):
        found.append(_DIGITS)
    return found


@dataclass(frozen=True)
class ChainModel:
    """State weights (features x 2) and transition weights (2 x 2); label 1 is article."""

    state: np.ndarray
    move: np.ndarray

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi. Ties go to label 0."""
        if not blocks:
            return []
        other, article = self.state[:, 0].tolist(), self.state[:, 1].tolist()
        scores = [(math.fsum(map(other.__getitem__, b.features)), math.fsum(map(article.__getitem__, b.features))) for b in blocks]
        (t00, t01), (t10, t11) = self.move.tolist()
        a, b = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            x, y, u, v = a + t00, b + t10, a + t01, b + t11
            back.append((y > x, v > u))
            a, b = max(x, y) + s0, max(u, v) + s1
        label = int(b > a)
        path = [label]
        for step in reversed(back):
            label = int(step[label])
            path.append(label)
        return path[::-1]

    def extract(self, page: str | None) -> str:
        blocks = parse(page) if page else []
        return "\n".join(b.text for b, label in zip(blocks, self.decode(blocks)) if label)


def fit_chain(pages: list[tuple[list[Block], list[int]]], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-4, stretch: int = 64) -> ChainModel:
    """Adam steps on the mean log-likelihood of labelled sequences, with forward-backward over padded arrays."""
    pages = [(blocks[i : i + stretch], labels[i : i + stretch]) for blocks, labels in pages for i in range(0, len(blocks), stretch)]
    state, move = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
    if not pages:
        return ChainModel(state, move)
    n, longest = len(pages), max(len(p[0]) for p in pages)
    # equal feature lists are one row of x
    rows: dict[tuple[int, ...], int] = {(): 0}
    kind, y, mask = np.zeros((n, longest), int), np.zeros((n, longest), int), np.zeros((n, longest))
    for i, (blocks, labels) in enumerate(pages):
        for t, (b, label) in enumerate(zip(blocks, labels)):
            kind[i, t] = rows.setdefault(tuple(sorted(b.features)), len(rows))
            y[i, t], mask[i, t] = label, 1
    x = np.zeros((len(rows), len(NAMES)))
    for own, k in rows.items():
        x[k, list(own)] = 1
    total = mask.sum()
    truth = np.eye(2)[y] * mask[..., None]
    pair = mask[:, 1:]
    true_moves = np.einsum("ita,itb,it->ab", np.eye(2)[y[:, :-1]], np.eye(2)[y[:, 1:]], pair)
    m, v = [0.0, 0.0], [0.0, 0.0]
    for step in range(1, rounds + 1):
        s = (x @ state)[kind]
        ahead, behind = np.zeros_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0]
        for t in range(1, longest):
            z = np.logaddexp(ahead[:, t - 1, 0, None] + move[0], ahead[:, t - 1, 1, None] + move[1]) + s[:, t]
            ahead[:, t] = np.where(mask[:, t, None] > 0, z, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = s[:, t + 1] + behind[:, t + 1]
            z = np.logaddexp(move[:, 0] + nxt[:, 0, None], move[:, 1] + nxt[:, 1, None])
            behind[:, t] = np.where(mask[:, t + 1, None] > 0, z, behind[:, t + 1])
        norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p = np.exp(ahead + behind - norm[:, None, None]) * mask[..., None]
        both = ahead[:, :-1, :, None] + move + (s + behind)[:, 1:, None, :] - norm[:, None, None, None]
        moves = (np.exp(np.minimum(both, 0)) * pair[..., None, None]).sum(axis=(0, 1))
        wrong = truth - p
        by_row = np.stack([np.bincount(kind.ravel(), wrong[..., label].ravel(), len(rows)) for label in (0, 1)], axis=1)
        grads = [x.T @ by_row / total - ridge * state, (true_moves - moves) / total - ridge * move]
        for k, (w, g) in enumerate(zip((state, move), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return ChainModel(state, move)


def landmark_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page by its own landmarks; None if it marks no article."""
    article = (PLACE["in:article"], PLACE["in:main"])
    other = {PLACE[f"in:{t}"] for t in ("nav", "aside", "form", "footer", "dialog")} | {PLACE[f"cue:{c}"] for c in ("ad", "menu", "side", "comment", "notice", "share", "related")}
    labels = [int(any(a in b.features for a in article) and not other & set(b.features)) for b in blocks]
    return labels if any(labels) else None


def labelled_pages(n: int = 500, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages made of parts of known label: (html, [(text of a block, label)]). Words are invented; parts, wrappers, order and hints vary."""
    r = random.Random(seed)
    syllables = "ba co di fe gu la mi no pe ra so tu ve xi zo än é ir os un".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def sentence(a: int = 4, b: int = 18) -> str:
        s = words(a, b).capitalize()
        return (s.replace(" ", ", ", 1) if r.random() < 0.4 else s) + r.choice("....!?")

    def prose(a: int = 1, b: int = 6) -> str:
        return " ".join(sentence() for _ in range(r.randint(a, b)))

    out = []
    for _ in range(n):
        blocks: list[tuple[str, int]] = []

        def put(text: str, label: int) -> str:
            blocks.append((" ".join(text.split()), label))
            return html.escape(text, quote=False)

        def name(*options: str) -> str:
            """A hint in a class or an id, or none."""
            if r.random() < 0.2:
                return ""
            return f' {r.choice(("class", "id"))}="{r.choice(options)}{r.choice(("", "-box", " x1", "_wrap"))}"'

        def links(label: int, k: int) -> str:
            return "".join(f'<li><a href="/{word()}">{put(words(1, 3), label)}</a></li>' for _ in range(k))

        def menu() -> str:
            w = r.choice(("nav", "nav", "div class='menu'", "div id='navbar'", "div role='navigation'"))
            return f"<{w}><ul>{links(0, r.randint(3, 9))}</ul></{w.split()[0]}>"

        def top() -> str:
            kind = r.choice(("header", "header", "div"))
            return f"<{kind}{name('header', 'masthead', 'site-header') if kind == 'div' else ''}><div>{put(words(1, 4).title(), 0)}</div><p>{put(words(2, 7), 0)}</p>{menu() if r.random() < 0.6 else ''}</{kind}>"

        def advert() -> str:
            hint = r.choice(("ad", "ads", "advert", "sponsored", "promo", "ad-banner"))
            return f'<{(t := r.choice(("div", "div", "aside")))} {r.choice(("class", "id"))}="{hint}">{put(prose(1, 3), 0)}</{t}>'

        def notice() -> str:
            hint = r.choice(("cookie-notice", "consent", "notice", "alert", "gdpr-banner", "cookie-banner"))
            t = r.choice(("div", "div", "section", "dialog"))
            return f'<{t} class="{hint}"><p>{put(r.choice(("We use cookies. ", "This site uses cookies. ", "")) + prose(1, 2), 0)}</p><button>{put("Accept", 0)}</button></{t}>'

        def side() -> str:
            t, hint = r.choice((("aside", ""), ("aside", ' class="sidebar"'), ("div", ' class="sidebar"'), ("div", ' id="sidebar"'), ("div", ' class="widget"')))
            return f"<{t}{hint}><h3>{put(words(1, 3).title(), 0)}</h3><ul>{links(0, r.randint(2, 6))}</ul>{'<p>' + put(prose(1, 2), 0) + '</p>' if r.random() < 0.6 else ''}</{t}>"

        def form() -> str:
            return f"<form{name('newsletter', 'subscribe', 'search')}><label>{put(words(1, 4), 0)}</label><input name=q>{'<p>' + put(prose(1, 1), 0) + '</p>' if r.random() < 0.5 else ''}<button>{put(words(1, 2), 0)}</button></form>"

        def comments() -> str:
            hint = r.choice(("comments", "comment-list", "reader-comments", "discussion", "replies"))
            t = r.choice(("section", "div", "div", "ol"))
            body = ""
            for _ in range(r.randint(1, 5)):
                who, say = put(words(1, 2) + r.choice((" says:", "", " wrote", "")), 0), put(prose(1, 4), 0)
                body += r.choice((f'<div class="comment"><b>{who}</b><p>{say}</p></div>', f"<li><div>{who}</div><p>{say}</p></li>", f'<article class="comment"><h4>{who}</h4><p>{say}</p></article>'))
            return f'<{t} {r.choice(("class", "id"))}="{hint}">{body}</{t}>'

        def related() -> str:
            return f'<{(t := r.choice(("div", "section", "aside")))} class="{r.choice(("related", "recommended", "more-stories", "popular", "trending"))}"><ul>{links(0, r.randint(2, 5))}</ul></{t}>'

        def share() -> str:
            return f'<div class="{r.choice(("share", "social", "share-bar", "sharing"))}"><a href="#">{put(words(1, 2), 0)}</a></div>'

        def bottom() -> str:
            kind = r.choice(("footer", "footer", "footer", 'div class="footer"', 'div id="footer"'))
            return f"<{kind}><p>{put(r.choice(('© ', '', 'Copyright ')) + words(1, 3) + r.choice((' · ', ' | ', ' ')) + prose(1, 3), 0)}</p></{kind.split()[0]}>"

        def body() -> str:
            got = []
            heading = f"<h1>{put(words(2, 12), 1)}</h1>"
            got.append(f"<header>{heading}</header>" if r.random() < 0.15 else heading)
            for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
                kind = r.random()
                if kind < 0.64:
                    text = put(prose(1, 7), 1)
                    got.append(r.choice((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<p><a href='/x'>{text[:0]}</a>{text}</p>")))
                elif kind < 0.72:
                    got.append(f"<h2>{put(words(1, 6), 1)}</h2>")
                elif kind < 0.8:
                    got.append("<ul>" + "".join(f"<li>{put(prose(1, 1) if r.random() < 0.6 else words(1, 5), 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
                elif kind < 0.84:
                    got.append(f"<blockquote><p>{put(prose(1, 2), 1)}</p></blockquote>")
                elif kind < 0.87:
                    got.append("<table>" + "".join(f"<tr><td>{put(words(1, 3), 1)}</td><td>{put(str(r.randint(1, 9999)), 1)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
                elif kind < 0.89:
                    got.append(f"<figure><img src=x><figcaption>{put(prose(1, 1), 1)}</figcaption></figure>")
                elif kind < 0.905:
                    got.append(f"<pre>{put(words(3, 12), 1)}</pre>")
                else:
                    got.append(r.choice((advert, advert, share, related, side, form))())
            if r.random() < 0.25:
                got.append(r.choice((share, related, form, comments))())
            return "".join(got)

        page = ["<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>"]
        for part, chance in ((notice, 0.3), (top, 0.5), (menu, 0.7), (advert, 0.4), (side, 0.2)):
            if r.random() < chance:
                page.append(part())
        wrap = r.choice(("article", "article", "article", "main", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div id="main"', 'section class="story"', "div"))
        page.append(f"<{wrap}>{body()}</{wrap.split()[0]}>")
        for part, chance in ((side, 0.3), (advert, 0.2), (related, 0.3), (share, 0.2), (comments, 0.35), (form, 0.3), (notice, 0.1), (bottom, 0.85)):
            if r.random() < chance:
                page.append(part())
        page.append("</body></html>")
        out.append(("".join(page), blocks))
    return out


def made_sequences(pages: list[tuple[str, list[tuple[str, int]]]]) -> list[tuple[list[Block], list[int]]]:
    """Blocks as parsed, with the labels of the parts they came from; a block that spans parts takes its first part's."""
    out = []
    for page, parts in pages:
        blocks, labels, at, offset = parse(page), [], 0, 0
        for b in blocks:
            labels.append(parts[at][1])
            left = len(b.text.replace(" ", ""))
            while left > 0 and at < len(parts):
                own = len(parts[at][0].replace(" ", "")) - offset
                if own <= left:
                    left, at, offset = left - own, at + 1, 0
                else:
                    offset, left = offset + left, 0
            at = min(at, len(parts) - 1) if b is not blocks[-1] else at
        out.append((blocks, labels))
    return out


@lru_cache(maxsize=4)
def made(n: int) -> list[tuple[list[Block], list[int]]]:
    """The made pages as sequences; once a process."""
    return made_sequences(labelled_pages(n))


def fit(pages: DataFrame, n_made: int = 500, sample: int = 200, rounds: int = 200) -> ChainModel:
    """The field, from `n_made` made pages and at most `sample` pages of the table."""
    some = pages.filter("html is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    ids = [r["page_id"] for r in hash_sample(some.select("page_id"), "page_id", sample).collect()]
    # a repeated id counts once, with its least page
    rows = some.filter(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            pages = [parse(page) for page in batch["html"].to_pylist()]
            # a page without an article teaches nothing
            return {"page_id": batch["page_id"], "features": [[b.features for b in blocks] for blocks in pages], "labels": [landmark_labels(blocks) for blocks in pages]}

        return work

    # parsed where they lie: features and labels of the sample's blocks come here, no page does
    known = per_batch(rows, "page_id long, features array<array<int>>, labels array<int>", make).filter("labels is not null").collect()
    sequences = list(made(n_made))
    for row in sorted(known, key=lambda r: r["page_id"]):
        sequences.append(([Block("", f) for f in row["features"]], row["labels"]))
    return fit_chain(sequences, rounds)


def extract(pages: DataFrame, model: ChainModel) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts, counts = [], []
            for page in batch["html"].to_pylist():
                blocks = parse(page) if page else []
                counts.append(len(blocks))
                texts.append("\n".join(b.text for b, label in zip(blocks, shared.value.decode(blocks)) if label))
            return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": counts}

        return work

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return per_batch(rows, "page_id long, url string, text string, n_chars long, n_blocks long", make)
