"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: text between two block-level tags or line breaks, with its open
ancestors. Each block has features of its ancestors (tags, families of class, id and role names)
and of its text (length, links, punctuation, marks). A chain of two labels, main text or not, is
fitted by conditional likelihood on labelled pages that `labelled_pages` writes from a seed (no
labelled page comes with the data), and decoded by Viterbi. Character references are decoded, white
space in a block becomes one space, kept blocks are joined by one line break in page order.

A null or empty page has an empty text. Repeated rows are extracted one by one; unclosed tags,
stray end tags and markup that breaks off are accepted. Scripts, styles, drawings and the like are left
out; custom elements named after them (`svg-icon`) and a drawing that closes itself are not such."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from encore.llm.common import per_value

_SKIPPED = r"<!--.*?(?:-->|\Z)|<(script|style|template|svg(?![^>]*/>)|iframe|object|noscript)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
#: A value without quotation marks may hold them; a mark that nothing closes is a name of its own.
_ATTRIBUTES = r"(?>\s+|/(?!>)|[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?![\"'])[^\s>]+))?|=|[\"'])*+"
_MARKUP = rf"<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:({_ATTRIBUTES})/?>|[^>]*(?:>|\Z))|([^<]+|<)"
_TOKEN = re.compile(rf"{_SKIPPED}|{_MARKUP}", re.S | re.I)
#: The same up to the last end of a marked section, so that an open one is looked for once.
_TOKEN_CDATA = re.compile(rf"{_SKIPPED}|<!\[CDATA\[.*?\]\]>|{_MARKUP}", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: HTML's block-level, void and inline formatting elements as used here.
BLOCKS = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_P = BLOCKS - {"br", "option", "optgroup", "button", "body", "html", "head", "title"}
#: Name fragments by family, as sites commonly use them.
FAMILIES = {
    "menu": "nav menu breadcrumb toolbar tabs pager pagination skip toc sitemap",
    "head": "header masthead topbar branding logo site-title",
    "foot": "footer colophon copyright legal bottom",
    "side": "sidebar aside widget rail related recommend trending popular latest more-stories",
    "ad": "ad ads advert advertisement adsense banner sponsor sponsored promo promoted promotion",
    "notice": "cookie consent notice gdpr alert popup modal overlay newsletter subscribe signup paywall disclaimer privacy toast",
    "comment": "comment comments disqus reply replies respond discussion reviews",
    "share": "share social sharing follow tags tagcloud",
    "form": "form search login contact poll",
    "main": "article content main post entry story body text hentry articlebody blog page-content",
    "meta": "byline author date meta caption credit",
}
_FAMILY = {name: family for family, names in FAMILIES.items() for name in names.split()}
#: Marks of what wraps a text.
_WRAPS = frozenset({"t:article", "t:main", "c:main"})
#: Marks of what stands beside a text, wherever it is nested.
_ASIDE = frozenset({f"c:{x}" for x in FAMILIES if x not in ("main", "meta")} | {"t:nav", "t:aside", "t:footer", "t:form", "t:button", "t:head", "t:menu", "t:dialog"})
#: Elements that an end of a paragraph or an item does not reach beyond.
_BORDERS = frozenset({"article", "main", "nav", "aside", "body", "table"})
_ITEMS = frozenset({"p", "li", "dd", "dt"})
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """A leaf block: its text, characters inside links, own tag, and its ancestors' marks."""

    text: str
    linked: int
    tag: str
    marks: frozenset[str]


def _families(attributes: str) -> frozenset[str]:
    found = set()
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            low = name.lower()
            for part in (low, *_SPLIT.split(name)):
                if family := _FAMILY.get(part.lower()):
                    found.add(family)
    return frozenset(found)


def _tokens(html: str) -> Iterator[re.Match]:
    at, sections = 0, html.rfind("]]>")
    while at < len(html):
        m = (_TOKEN_CDATA if at < sections else _TOKEN).match(html, at)
        yield m
        at = m.end()


class _Open:
    """The open block elements with the marks down to each. Each element is opened and closed once,
    and counts say what is open without a walk, so that a page takes time in proportion to it."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.count: Counter[str] = Counter()
        self.items: list[Counter[str]] = [Counter()]  # of paragraphs and items, since each border

    def marks(self) -> frozenset[str]:
        return self.stack[-1][1] if self.stack else frozenset()

    def tag(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def push(self, tag: str, attributes: str) -> None:
        above = self.marks()
        own = {f"t:{tag}"} | {f"c:{x}" for x in _families(attributes)} if attributes else {f"t:{tag}"}
        self.stack.append((tag, above if own <= above else above | own))
        self.count[tag] += 1
        if tag in _ITEMS:
            self.items[-1][tag] += 1
        if tag in _BORDERS:
            self.items.append(Counter())

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.count[tag] -= 1
        if tag in _BORDERS:
            self.items.pop()
        if tag in _ITEMS:
            self.items[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """Ends the innermost such element and what is open in it, if there is one."""
        ends = HEADINGS if tag in HEADINGS else {tag}
        if self.items[-1][tag] if tag in _ITEMS else any(self.count[t] for t in ends):
            while self.pop() not in ends:
                pass


def leaf_blocks(html: str) -> list[Block]:
    """The page's leaf blocks with text, in order."""
    at = _Open()
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), at.tag(), at.marks()))
            parts.clear()
        linked = 0

    for m in _tokens(html):
        if (text := m[5]) is not None:
            parts.append(text)
            linked += len(text) if in_link else 0
            continue
        if (tag := m[3]) is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m[2]
        elif tag in BLOCKS:
            flush()
            if m[2]:
                at.close(tag)
                continue
            if tag in ENDS_P:
                at.close("p")
            if tag in ("li", "dt", "dd", "option", "tr", "td", "th") and at.tag() == tag:
                at.pop()
            if tag not in VOID:
                at.push(tag, m[4] or "")
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of each block's features."""
    out, headed = [], False
    wrapped = any(b.marks & _WRAPS for b in blocks)
    for k, b in enumerate(blocks):
        n = len(b.text)
        links = b.linked / n
        headed = headed or b.tag == "h1"
        marks = b.marks
        inside = bool(marks & _WRAPS)
        own = ["bias", f"own:{b.tag}", *marks, f"len:{min(6, n.bit_length() // 2)}", f"link:{min(3, int(links * 4))}", f"inside:{inside}", f"inside:{inside}:{b.tag in HEADINGS}"]
        if b.text[-1] in ".!?…\"”:;。":
            own.append("ends")
        if b.text.count(",") + b.text.count(".") > 2:
            own.append("prose")
        if "©" in b.text[:3] or "copyright" in b.text[:40].lower():
            own.append("mark:c")
        if "|" in b.text or "·" in b.text or "»" in b.text:
            own.append("mark:bar")
        own.append(f"headed:{headed}")
        if marks & _ASIDE:
            own += ["aside", f"aside:{inside}"]
        if k == 0 or k == len(blocks) - 1:
            own.append(f"edge:{k == 0}")
        if not wrapped:  # a page that wraps nothing is judged by other signs
            low = bool(marks & _ASIDE)
            own += ["bare", f"bare:{b.tag}", f"bare:aside:{low}", f"bare:{low}:len:{min(4, n.bit_length() // 2)}", f"bare:link:{min(3, int(links * 4))}", f"bare:{low}:{b.text[-1] in '.!?…:;。'}", f"bare:headed:{headed}"]
        out.append(own)
    return out


class ChainField:
    """Two labels in a chain: weights of (feature, label) and of label pairs."""

    def __init__(self, names: list[str]):
        self.at = {f: k for k, f in enumerate(names)}
        self.w = np.zeros((len(names), 2))
        self.step = np.zeros((2, 2))
        self.start = np.zeros(2)

    def scores(self, blocks: list[Block]) -> list[tuple[float, float]]:
        own = self.w.tolist()
        at = self.at
        out = []
        for fs in features(blocks):
            a = b = 0.0
            for f in fs:
                if (k := at.get(f)) is not None:
                    x = own[k]
                    a += x[0]
                    b += x[1]
            out.append((a, b))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best labels (Viterbi)."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        scores = self.scores(blocks)
        a, b = scores[0][0] + float(self.start[0]), scores[0][1] + float(self.start[1])
        back = []
        for x, y in scores[1:]:
            to0, to1 = a + s00 < b + s10, a + s01 < b + s11
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00) + x, (b + s11 if to1 else a + s01) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[Block], list[int]]], steps: int = 160, l2: float = 1e-4) -> ChainField:
        """Maximises the conditional likelihood by gradient steps (Adam), all pages side by side."""
        n, t = len(pages), max(len(b) for b, _ in pages)
        mask = np.zeros((n, t), bool)
        gold = np.zeros((n, t), int)
        rows, cols = [], []
        for i, (blocks, labels) in enumerate(pages):
            mask[i, : len(blocks)] = True
            gold[i, : len(blocks)] = labels
            for j, fs in enumerate(features(blocks)):
                for f in fs:
                    if f in self.at:
                        rows.append(i * t + j)
                        cols.append(self.at[f])
        rows, cols = np.array(rows), np.array(cols)
        total = mask.sum()
        size = len(self.at)
        params = np.zeros(size * 2 + 6)
        m, v = np.zeros_like(params), np.zeros_like(params)
        one_hot = np.eye(2)[gold] * mask[..., None]
        pairs = np.einsum("nti,ntj->ij", one_hot[:, :-1], one_hot[:, 1:])
        lse = lambda x, axis: np.logaddexp.reduce(x, axis)
        for step in range(1, steps + 1):
            w, trans, start = params[: 2 * size].reshape(size, 2), params[2 * size : -2].reshape(2, 2), params[-2:]
            s = np.stack([np.bincount(rows, w[cols, y], n * t) for y in (0, 1)], 1).reshape(n, t, 2)
            alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            alpha[:, 0] = s[:, 0] + start
            for j in range(1, t):
                alpha[:, j] = np.where(mask[:, j, None], lse(alpha[:, j - 1, :, None] + trans, 1) + s[:, j], alpha[:, j - 1])
            z = lse(alpha[:, -1], 1)
            for j in range(t - 2, -1, -1):
                beta[:, j] = np.where(mask[:, j + 1, None], lse(trans + (s[:, j + 1] + beta[:, j + 1])[:, None, :], 2), 0)
            p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            both = np.exp(alpha[:, :-1, :, None] + trans + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            miss = (p - one_hot).reshape(n * t, 2)
            g = np.empty_like(params)
            g[: 2 * size] = np.stack([np.bincount(cols, miss[rows, y], size) for y in (0, 1)], 1).ravel()
            g[2 * size : -2] = (both.sum((0, 1)) - pairs).ravel()
            g[-2:] = (p[:, 0] - one_hot[:, 0]).sum(0)
            g = g / total + l2 * params
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            params -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.step, self.start = params[: 2 * size].reshape(size, 2), params[2 * size : -2].reshape(2, 2), params[-2:]
        return self


_MARK = ""  # begins every block of main text on a labelled page


def labelled_pages(count: int, seed: int) -> list[str]:
    """Invented pages of many layouts; main blocks begin with a private-use character."""
    rng = random.Random(seed)
    syllables = "an be co da el fi go hu in jo ka le mi no or pa qui ra se to un ve wa xi yo zu ñe é ü ß".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def phrase(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b))).capitalize()

    def prose() -> str:
        if rng.random() < 0.12:  # junk that is still the article's text
            return " ".join(word() + rng.choice(["%%%", "###", "***", " |", "!!"]) for _ in range(rng.randint(3, 60)))
        return " ".join(phrase(1, 14) + rng.choice(".....?!") for _ in range(rng.randint(1, 7)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{phrase(1, 2)}</a></li>' for _ in range(k))

    def named(tag: str, family: str, inner: str, chance: float = 0.8) -> str:
        attr = f' {rng.choice(["class", "id"])}="{rng.choice(FAMILIES[family].split())}{rng.choice(["", "-" + word(), " " + word()])}"' if rng.random() < chance else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def noise(inside: bool) -> str:
        kind = rng.choice(["ad", "ad", "notice", "share", "form", "side", "script"] if inside else ["ad", "ad", "notice", "side", "side", "form", "comment", "script", "share"])
        text = rng.choice([prose(), phrase(1, 6), phrase(2, 9) + "."])
        if kind == "ad":
            return rng.choice(["<!-- ad -->", ""]) + named("div", "ad", rng.choice([text, f"<p>{text}</p>"]), 1)
        if kind == "notice":
            return named(rng.choice(["div", "section", "aside"]), "notice", f"<p>{text}</p>" + rng.choice(["", f"<button>{phrase(1, 2)}</button>"]), 1)
        if kind == "share":
            return named("ul", "share", links(3), 1)
        if kind == "form":
            return f'<form action="/{word()}"><label>{phrase(1, 3)}</label><input name="q"><select><option>{word()}<option>{word()}</select><button>{phrase(1, 2)}</button>{rng.choice(["", f"<p>{text}</p>"])}</form>'
        if kind == "side":
            inner = rng.choice([f"<h3>{phrase(1, 4)}</h3><ul>{links(4)}</ul>", f"<p>{prose()}</p>", f"<h2>{phrase(1, 3)}</h2><p>{prose()}</p><p>{prose()}</p>"])
            return named("aside", "side", inner, 0.5) if rng.random() < 0.5 else named("div", "side", inner, 1)
        if kind == "comment":
            each = "".join(f'<{rng.choice(["li", "div", "article"])} class="comment"><b>{word()}</b><p>{prose()}</p>' for _ in range(rng.randint(1, 4)))
            return named(rng.choice(["section", "div", "ol"]), "comment", rng.choice(["", f"<h3>{phrase(1, 2)}</h3>"]) + each, 1)
        return f'<script>var t="</p>";{word()}();</script><style>p{{margin:0}}</style><noscript>{phrase(1, 5)}</noscript>'

    def body_block() -> str:
        text = _MARK + prose()
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{text}" + rng.choice(["</p>", "</p>", ""])
        if kind < 0.77:
            return f"<p><b>{text}<br><p>{_MARK}{prose()}</p>"
        if kind < 0.84:
            return f"<h{rng.randint(2, 4)}>{_MARK}{phrase(1, 8)}</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{_MARK}{phrase(2, 12)}{rng.choice(['', '.'])}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.97:
            return f"<table><tr><td>{_MARK}{phrase(1, 4)}</td><td>{_MARK}{phrase(1, 4)}</td></tr></table>"
        return f"<div>{_MARK}{prose()} <a href='/x'>{phrase(1, 3)}</a> {phrase(2, 6)}.</div>"

    def layout(content: str) -> str:
        """The content without any element or name that says it is the text."""
        plain = rng.choice(["page", "wrap", "container", "col-" + word(), "row", word(), "layout", "inner"])
        return rng.choice([
            content, content, f"<div>{content}</div>", f'<div class="{plain}"><div>{content}</div></div>', f"<section>{content}</section>",
            f'<table width=100%><tr><td class={plain}>{content}</td></tr></table>', f'<center><font size=2>{content}</font></center>', f'<div id={plain} data-x=it\'s>{content}</div>',
        ])

    pages = []
    for _ in range(count):
        title = phrase(1, 10)
        parts = [f"<!DOCTYPE html><html><head><title>{title}</title><meta charset=utf-8><style>p{{}}</style></head><body>"]
        if rng.random() < 0.5:
            parts.append(named("header", "head", f"<{rng.choice(['h1', 'div', 'p'])}>{phrase(1, 4)}</div>" + rng.choice(["", f"<p>{phrase(2, 9)}.</p>"]), 0.5))
        if rng.random() < 0.85:
            parts.append(named(rng.choice(["nav", "div", "nav"]), "menu", f"<ul>{links(rng.randint(3, 9))}</ul>", 1 if rng.random() < 0.5 else 0.3) if rng.random() < 0.9 else f"<nav>{phrase(1, 3)} | {phrase(1, 3)}</nav>")
        parts += [noise(False) for _ in range(rng.randint(0, 2))]
        inner = [f"<h1>{_MARK}{title}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 12)):
            inner.append(body_block())
            if rng.random() < 0.08:
                inner.append(noise(True))
        wrap = rng.random()
        content = "".join(inner)
        parts.append(layout(content) if rng.random() < 0.3 else f"<article>{content}</article>" if wrap < 0.5 else f"<main>{content}</main>" if wrap < 0.62 else named("div", "main", content, 1) if wrap < 0.85 else f"<main><article>{content}</article></main>")
        parts += [noise(False) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.9:
            text = rng.choice([f"&copy; {word()}.example &middot; {prose()}", f"<p>{phrase(2, 8)}.</p><ul>{links(3)}</ul>", prose(), f"<p>{prose()}</p>"])
            parts.append(named("footer", "foot", text, 0.3) if rng.random() < 0.8 else named("div", "foot", text, 1))
        parts.append(rng.choice(["</body></html>", ""]))
        pages.append("".join(parts))
    return pages


def labelled_blocks(html: str) -> tuple[list[Block], list[int]]:
    blocks = leaf_blocks(html)
    labels = [int(b.text.startswith(_MARK)) for b in blocks]
    return [Block(b.text.replace(_MARK, "") or ".", b.linked, b.tag, b.marks) for b in blocks], labels


@lru_cache(maxsize=2)
def fitted(pages: int = 700, seed: int = 11) -> ChainField:
    """The field fitted on `pages` labelled pages; the same for the same arguments."""
    data = [x for x in map(labelled_blocks, labelled_pages(pages, seed)) if x[0]]
    return ChainField(sorted({f for blocks, _ in data for fs in features(blocks) for f in fs})).fit(data)


def main_text(html: str, field: ChainField) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, keep in zip(blocks, field.decode(blocks), strict=True) if keep)


def extract_text(html: Column, field: ChainField | None = None) -> Column:
    """The main text of each page, empty if there is none."""
    field = field or fitted()

    def start():
        return lambda raw: main_text(raw.decode(), field) if raw else ""

    return per_value(start, "string", pa.string())(html)
