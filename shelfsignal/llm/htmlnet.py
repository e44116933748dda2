"""Main text of HTML pages: a recurrent labeller of blocks.

A page is cut into leaf blocks: runs of text between block-level tags, with
the path of open tags above them. Scripts, styles, templates, frames, comments
and the head are no text (``SILENT``); text in noscript, math, svg, object,
canvas, audio and video is text like any other. An unclosed paragraph or list
item ends where the next one begins; an end tag closes what is open inside it,
one without a start is ignored; a silent element closed by ``/>`` holds
nothing; a tag that never ends is dropped with what follows it. The cut takes
time in proportion to the page. A block becomes a vector: hashed names of tags,
classes and ids on its path, hashed words, share of text in links and so on. A bidirectional LSTM in numpy reads
the whole sequence of a page, and a logistic layer labels every block with
what it has seen on both sides. Blocks labelled as main text are joined in
page order.

The network is trained at each call, in one task and with a fixed seed, on ``PAGES`` pages
that a generator lays out in many ways (containers, sidebars, notices,
comments ...), where the label of a block is known by construction. The words
in them come from ``SAMPLE`` pages of the input of at most ``SAMPLE_CHARS``
characters, those of the smallest hash of page_id. These bounds hold for
learning only; every page is read whole.

Defined cases: null or empty html, or html without text, gives an empty text;
a null page_id or url passes; white space inside a block becomes one space;
character references are decoded as HTML 5 says; extra columns are left out.
"""

from __future__ import annotations

import html
import io
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, tune

PATH, WORDS, EXTRA, HIDDEN = 96, 16, 6, 20
WIDTH = PATH + WORDS + EXTRA
PAGES, SAMPLE, SAMPLE_CHARS, EPOCHS, BATCH, SEED = 1200, 200, 200_000, 10, 24, 5
#: Elements that break text into blocks, that have no end, whose content is no text, and that an own sibling ends.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template head title iframe".split())
ENDS = {"li": "li", "p": "p", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
_QUOTES = re.compile(r"[>\"']")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")


def _dim(word: str, width: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % width, 1.0 if h >> 31 else -1.0


@lru_cache(65536)
def _node(tag: str, attributes: str) -> tuple[str, ...]:
    """Names that stand for an element: its tag and the words in its class, id and role."""
    names = [tag]
    for m in _NAMES.finditer(attributes):
        spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()
        names += [f".{x}" for x in _SPLIT.split(spaced) if len(x) > 1]
    return tuple(names)


class Path:
    """The names of the elements open above a block; paths with a common begin share it, and a vector."""

    __slots__ = ("depth", "inner", "names", "parent", "sum")
    count = 0

    def __init__(self, parent: Path | None, names: tuple[str, ...], fresh: bool):
        self.parent, self.names, self.inner = parent, names, {}
        self.depth = parent.depth + 1 if parent else 0
        self.sum = parent.sum if parent else np.zeros(PATH, np.float32)
        if fresh:  # names that stand twice on a path count once
            self.sum = self.sum.copy()
            for name in names:
                at, sign = _dim(name, PATH)
                self.sum[at] += sign
        Path.count += 1

    def within(self, names: tuple[str, ...], fresh: bool) -> Path:
        found = self.inner.get(names)
        if found is None:
            found = self.inner[names] = Path(self, names, fresh)
        return found


@lru_cache(65536)
def _leaf(names: tuple[str, ...]) -> np.ndarray:
    """What the innermost element of a path adds to its vector."""
    v = np.zeros(PATH, np.float32)
    for name in names:
        at, sign = _dim("leaf " + name, PATH)
        v[at] += sign
    return v


_root = Path(None, (), False)


def root() -> Path:
    """The path of nothing; paths of earlier pages are forgotten when they are many."""
    global _root
    if Path.count > 65_536:
        _root, Path.count = Path(None, (), False), 0
    return _root


class _Words(dict):
    def __missing__(self, word: str) -> int:
        at = _dim(word, WORDS)[0]
        if len(self) < 200_000:
            self[word] = at
        return at


_words = _Words()


def tokens(page: str):
    """(text, None, None) and (None, tag, attributes) for start tags, (None, "/tag", None) for end tags, in one pass."""
    at, n, none_left = 0, len(page), set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], None, None
            return
        follows = page[lt + 1 : lt + 2]
        if not (follows.isascii() and follows.isalpha() or follows in ("/", "!", "?") and follows):
            yield page[at : lt + 1], None, None
            at = lt + 1
            continue
        if lt > at:
            yield page[at:lt], None, None
        m = _TAG.match(page, lt + 1)
        if m is None:  # a comment, or what counts as one
            long = page.startswith("<!--", lt)
            end = page.find("-->" if long else ">", lt + (4 if long else 2))
            if end < 0:
                return
            at = end + (3 if long else 1)
            continue
        end = m.end()
        while True:  # quotes count after an equals sign, where they close
            q = _QUOTES.search(page, end)
            if q is None:
                return
            end = q.end()
            if q[0] == ">":
                break
            if q[0] not in none_left and page[max(m.end(), q.start() - 64) : q.start()].rstrip()[-1:] == "=":
                close = page.find(q[0], end)
                if close < 0:
                    none_left.add(q[0])
                else:
                    end = close + 1
        tag, inner = m[2].lower(), page[m.end() : end - 1]
        at = end
        if m[1]:
            yield None, "/" + tag, None
            continue
        closed = inner[-1:] == "/" and tag in SILENT and (len(inner) == 1 or inner[-2] in " \t\r\n\f\"'")
        if tag in _RAW:
            if not closed:
                stop = _RAW[tag].search(page, at)
                if stop is None:
                    return
                at = stop.start()
                yield None, tag, inner
            continue
        if not closed:
            yield None, tag, inner


def blocks(page: str) -> list[tuple[str, Path, float]]:
    """(text, path of names, share of its characters in links) of every leaf block."""
    out, stack, paths, open_, named, parts, linked = [], [], [root()], Counter(), Counter(), [], 0
    own: list[int] = []  # places of block elements in the stack
    silent: list[int] = []  # and of silent ones

    def flush():
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            size = len(text)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, paths[-1], min(1.0, linked / max(1, size))))
        parts, linked = [], 0

    def close(least: int) -> None:
        """Close all elements from the place ``least`` of the stack on."""
        while len(stack) > least:
            tag = stack.pop()
            open_[tag] -= 1
            if tag in SILENT:
                silent.pop()
            if tag in BLOCKS:
                named[paths[-1].names] -= 1
                paths.pop()
                own.pop()

    for text, tag, attributes in tokens(page):
        if tag is None:
            if not silent:
                parts.append(text)
                if open_["a"]:
                    linked += len(text)
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if open_[tag] > 0:
                at = len(stack) - 1
                while stack[at] != tag:
                    at -= 1
                if own and own[-1] >= at:
                    flush()
                close(at)
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "body" and silent:
            close(silent[0])
        if tag in BLOCKS:
            flush()
            if own and (stack[own[-1]] == "p" or tag in ENDS and stack[own[-1]] in ENDS[tag].split()):
                close(own[-1])
            names = _node(tag, attributes)
            named[names] += 1
            paths.append(paths[-1].within(names, named[names] == 1))
            own.append(len(stack))
        if tag in SILENT:
            silent.append(len(stack))
        stack.append(tag)
        open_[tag] += 1
    flush()
    return out


def vectors(pages: list[list[tuple[str, Path, float]]]) -> list[np.ndarray]:
    """A vector for each block of each page."""
    sizes = [len(f) for f in pages]
    found = [b for f in pages for b in f]
    x = np.zeros((len(found), WIDTH), np.float32)
    if found:
        x[:, :PATH] = np.stack([b[1].sum for b in found]) + np.stack([_leaf(b[1].names) for b in found])
        words = [b[0].lower().split() for b in found]
        n = np.array([len(w) for w in words])
        dims = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        counts = np.bincount(np.repeat(np.arange(len(found)), n) * WORDS + dims, minlength=len(found) * WORDS).reshape(-1, WORDS)
        x[:, PATH : PATH + WORDS] = counts / np.maximum(1, np.sqrt((counts**2).sum(axis=1)))[:, None]
        stops = np.array([b[0].count(".") + b[0].count(",") for b in found])
        full = [b[0][-1] in ".!?" for b in found]
        x[:, PATH + WORDS :] = np.stack([np.log1p(n) / 3, [b[2] for b in found], np.minimum(1, stops / np.maximum(1, n)), full, [min(b[1].depth, 64) / 8 for b in found], np.ones(len(found))], axis=1)
    return np.split(x, np.cumsum(sizes)[:-1]) if sizes else []


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """A bidirectional LSTM with a logistic layer; parameters in one dictionary."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": init(WIDTH, 4 * HIDDEN), f"U{d}": init(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"V": init(2 * HIDDEN + WIDTH, 1), "v": np.zeros(1, np.float32)}

    def _read(self, x, mask, d, back: bool):
        """States of one direction over (steps, pages, WIDTH), and what the way back needs if there is one."""
        steps, n, _ = x.shape
        pre = x.reshape(steps * n, -1) @ self.p[f"W{d}"] + self.p[f"c{d}"]
        pre = pre.reshape(steps, n, -1)
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = pre[t] + h @ self.p[f"U{d}"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * u
            tanh = np.tanh(new)
            if back:
                kept.append((t, h, c, i, f, o, u, tanh, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return out, kept

    def forward(self, x, mask, back: bool = False):
        hf, kf = self._read(x, mask, "f", back)
        hb, kb = self._read(x, mask, "b", back)
        z = np.concatenate([hf, hb, x], axis=2)
        return _sigmoid((z @ self.p["V"])[:, :, 0] + self.p["v"]), z, kf, kb

    def gradients(self, x, mask, y):
        p, z, kf, kb = self.forward(x, mask, True)
        e = np.where(mask, p - y, 0) / mask.sum()
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["V"] = (z.reshape(-1, z.shape[2]).T @ e.reshape(-1, 1)).astype(np.float32)
        grad["v"] = e.sum().reshape(1)
        dz = e[:, :, None] * self.p["V"][:, 0]
        for d, kept, at in (("f", kf, 0), ("b", kb, HIDDEN)):
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            for t, h, c, i, f, o, u, tanh, m in reversed(kept):
                dh = dh + dz[t][:, at : at + HIDDEN]
                g = np.where(m, dh, 0)
                dnew = np.where(m, dc, 0) + g * o * (1 - tanh**2)
                dg = np.concatenate([dnew * u * i * (1 - i), dnew * c * f * (1 - f), g * tanh * o * (1 - o), dnew * i * (1 - u**2)], axis=1)
                dpre[t] = dg
                grad[f"U{d}"] += h.T @ dg
                dh, dc = np.where(m, dg @ self.p[f"U{d}"].T, dh), np.where(m, dnew * f, dc)
            flat = dpre.reshape(-1, 4 * HIDDEN)
            grad[f"W{d}"], grad[f"c{d}"] = x.reshape(-1, WIDTH).T @ flat, flat.sum(axis=0)
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> None:
        """Adam over batches of pages of like length, in an order of the seed's."""
        rng, step = np.random.default_rng(SEED), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i][1]))
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for b in rng.permutation(len(batches)):
                x, mask = padded([pages[i][0] for i in batches[b]])
                y = np.zeros(mask.shape, np.float32)
                for k, i in enumerate(batches[b]):
                    y[: len(pages[i][1]), k] = pages[i][1]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of main text for each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and j - i < 64 and (j - i + 1) * len(pages[order[j]]) <= 20_000:
                j += 1
            x, mask = padded([pages[k] for k in order[i:j]])
            p = self.forward(x, mask)[0]
            for n, k in enumerate(order[i:j]):
                out[k] = p[: len(pages[k]), n]
            i = j
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for k, v in enumerate(pages):
        x[: len(v), k], mask[: len(v), k] = v, True
    return x, mask


#: Names that pages give to the parts of a layout, and words that stand in them.
MAIN_NAMES = "content main-content post-content entry-content article-body article story post entry page-content body-text text single-post postBody articleText".split()
SIDE_NAMES = "sidebar side-bar widget related related-posts popular recent-posts toc trending recommended".split()
AD_NAMES = "ad ads advert advertisement banner sponsored promo promotion adsense ad-slot".split()
NOTICE_NAMES = "cookie cookie-notice cookie-banner notice alert popup modal consent gdpr newsletter subscribe message".split()
MENU_NAMES = "menu nav navbar navigation topbar breadcrumb breadcrumbs pagination pager tabs links toolbar".split()
TALK_NAMES = "comments comment comment-list comment-body responses reply replies discussion disqus respond".split()
FOOT_NAMES = "footer site-footer page-footer bottom copyright legal foot".split()
HEAD_NAMES = "header site-header masthead page-header top branding logo".split()
SHARE_NAMES = "share social social-links sharing tags meta author-box byline".split()
CHATTER = "home about contact login register search subscribe share tweet follow us read more next previous comments reply leave a comment cookie cookies we use accept privacy policy terms copyright all rights reserved newsletter sign up sponsored advertisement related posts popular tags".split()


class Layouts:
    """Pages laid out at random, each text marked as main text or not."""

    def __init__(self, words: list[str], seed: int = SEED):
        self.rng, self.words = np.random.default_rng(seed), words or [f"w{i}" for i in range(500)]

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def prose(self, low: int, high: int, chatter: float = 0.0) -> str:
        n = int(self.rng.integers(low, high + 1))
        out = [self.pick(CHATTER) if self.rng.random() < chatter else self.pick(self.words) for _ in range(n)]
        for i in range(int(self.rng.integers(4, 14)), n, int(self.rng.integers(5, 14))):
            out[i - 1] += self.pick([".", ",", "."])
        return html.escape(" ".join(out).capitalize() + self.pick([".", ".", "", "!"]), quote=False)

    def named(self, names: list[str], tags=("div", "div", "section")) -> tuple[str, str]:
        tag = self.pick(tags)
        return f'<{tag} {self.pick(["class", "class", "id"])}="{self.pick(names)}">', f"</{tag}>"

    def link_list(self, low=2, high=9, chatter=0.5):
        item = self.pick(["li", "li", "div", "span", "p"])
        inner = "".join(f'<{item}><a href="/x">{self.prose(1, 4, chatter)}</a></{item}>' for _ in range(int(self.rng.integers(low, high + 1))))
        return f"<ul>{inner}</ul>" if item == "li" else inner

    def short(self, chatter=0.4):
        return self.pick([lambda: f"<p>{self.prose(2, 25, chatter)}</p>", lambda: self.prose(1, 20, chatter), lambda: f"<h3>{self.prose(1, 4, chatter)}</h3>" + self.link_list(), self.link_list])()

    def boilerplate(self) -> str:
        kind = int(self.rng.integers(9))
        wrap = lambda pair, inner: pair[0] + inner + pair[1]
        if kind == 0:
            return wrap(("<nav>", "</nav>") if self.rng.random() < 0.5 else self.named(MENU_NAMES, ("div", "ul", "nav")), self.link_list())
        if kind == 1:
            return wrap(("<header>", "</header>") if self.rng.random() < 0.5 else self.named(HEAD_NAMES), self.pick(["<h1>{}</h1>", "<h2>{}</h2>", "<p>{}</p>", "{}"]).format(self.prose(1, 6, 0.2)) + self.pick(["", self.short()]))
        if kind == 2:
            return wrap(("<footer>", "</footer>") if self.rng.random() < 0.6 else self.named(FOOT_NAMES), self.pick(["&copy; ", "", "&copy; 2024 "]) + self.prose(1, 25, 0.3) + self.pick(["", self.link_list()]))
        if kind == 3:
            return wrap(("<aside>", "</aside>") if self.rng.random() < 0.5 else self.named(SIDE_NAMES), self.short() + self.pick(["", f"<p>{self.prose(5, 40)}</p>"]))
        if kind == 4:
            return wrap(self.named(AD_NAMES, ("div", "div", "p", "section", "aside")), self.pick([self.prose(1, 30), f"<p>{self.prose(3, 30, 0.1)}</p>"]))
        if kind == 5:
            return wrap(self.pick([("<noscript>", "</noscript>"), *(self.named(NOTICE_NAMES, ("div", "div", "p", "section")) for _ in range(5))]), self.short(0.5) + self.pick(["", f"<button>{self.prose(1, 2, 1)}</button>"]))
        if kind == 6:
            return wrap(("<form>", "</form>") if self.rng.random() < 0.7 else self.named(["search", "login-form", "form", "signup"]), f"<label>{self.prose(1, 4, 0.6)}</label><input><select><option>{self.prose(1, 2)}</option><option>{self.prose(1, 2)}</option></select><button>{self.prose(1, 2, 1)}</button>")
        if kind == 7:
            return wrap(self.named(TALK_NAMES, ("div", "section", "ol", "ul")), f"<h3>{self.prose(1, 3, 0.8)}</h3>" + "".join(wrap(self.named(TALK_NAMES, ("div", "li", "article")), f"<p>{self.prose(3, 60)}</p>") for _ in range(int(self.rng.integers(1, 5)))))
        return wrap(self.named(SHARE_NAMES), self.link_list(1, 5, 0.6))

    def paragraph(self) -> str:
        kind = int(self.rng.integers(15))
        text = self.prose(*self.pick([(1, 4), (3, 20), (10, 60), (20, 120)]))
        if kind == 0:
            return f"<h2>{self.prose(1, 9)}</h2>"
        if kind == 1:
            return f"<ul>{''.join(f'<li>{self.prose(2, 20)}' + self.pick(['</li>', '']) for _ in range(int(self.rng.integers(1, 6))))}</ul>"
        if kind == 2:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind == 3:
            return f"<table><tr><td>{self.prose(1, 5)}</td><td>{self.prose(1, 5)}</td></tr></table>"
        if kind == 4:
            return f"<figure><img src=x><figcaption>{self.prose(2, 12)}</figcaption></figure>"
        if kind == 5:
            return f"<p><b>{text}<br>"
        if kind == 6:
            return f"<div>{text}</div>"
        if kind == 7:
            return f"<pre>{text}</pre>"
        if kind == 9:
            return self.pick([f"<noscript><p>{text}</p></noscript>", f"<p>{self.prose(2, 9)} <math><mi>{self.prose(1, 3)}</mi></math> {self.prose(2, 20)}</p>", f"<object><p>{text}</p></object>", f"<div><p>{text}</p></div>"])
        if kind == 8:
            return f'<p>{self.prose(3, 20)} <a href="/y">{self.prose(1, 3)}</a> {self.prose(1, 20)}</p>'
        return f"<p>{text}</p>"

    def page(self) -> tuple[str, list[int]]:
        """A page, and its blocks' labels."""
        main = [f"<h1>{self.prose(1, 12)}</h1>"] if self.rng.random() < 0.8 else []
        main += [self.paragraph() for _ in range(int(self.rng.integers(*self.pick([(0, 4), (2, 15), (10, 60)]))))]
        if not main:
            main = [self.paragraph()]
        marked = [(1, m) for m in main]
        for _ in range(int(self.rng.integers(0, 3)) if self.rng.random() < 0.4 else 0):
            marked.insert(int(self.rng.integers(len(marked) + 1)), (0, self.boilerplate()))
        pairs = [("<article>", "</article>")] if self.rng.random() < 0.45 else [self.pick([("<main>", "</main>"), self.named(MAIN_NAMES, ("div", "div", "section", "article")), ('<div role="main">', "</div>")])]
        if self.rng.random() < 0.4:
            pairs.insert(0, self.pick([("<main>", "</main>"), ('<div class="container">', "</div>"), ('<div id="page">', "</div>"), self.named(["wrapper", "row", "site", "layout", "col"])]))
        parts = [(-1, "".join(a for a, _ in pairs)), *marked, (-1, "".join(z for _, z in reversed(pairs)))]
        before, after = ([(0, self.boilerplate()) for _ in range(int(self.rng.integers(0, 5)))] for _ in range(2))
        out, labels = ["<html><body>"], []
        for mark, part in [*before, *parts, *after]:
            if mark >= 0:
                labels += [mark] * len(blocks(part))
            out.append(part)
        return "".join([*out, "</body></html>"]), labels


def _trained(batches):
    """One row: the parameters of a network trained with the words of all rows."""
    some = sorted(h for batch in batches for h in batch.column("html").to_pylist())
    words = [w for h in some for text, _, _ in blocks(h) for w in text.split()]
    layouts, seen = Layouts(words), []
    while len(seen) < PAGES:
        page, labels = layouts.page()
        found = blocks(page)
        if found and len(found) == len(labels):
            seen.append((found, np.array(labels, np.float32)))
    rows = vectors([f for f, _ in seen])
    for x in rows:  # half of the pages without their words, so that these don't outweigh the layout
        x[:, PATH : PATH + WORDS] *= layouts.rng.random() < 0.5
    network = Network()
    network.train([*zip(rows, [y for _, y in seen], strict=True)])
    kept = io.BytesIO()
    np.savez(kept, **network.p)
    yield pa.RecordBatch.from_arrays([pa.array([kept.getvalue()], pa.binary())], names=["parameters"])


def learn(pages: DataFrame) -> Network:
    """A network trained, in one task, on laid-out pages with words of a bounded sample of ``pages`` (page_id, html)."""
    some = bounded_sample(pages.where(F.length("html") <= SAMPLE_CHARS).select("page_id", "html"), SAMPLE, "page_id")
    kept = some.select("html").repartition(1).mapInArrow(_trained, "parameters binary").first()["parameters"]
    network = Network()
    network.p = dict(np.load(io.BytesIO(bytes(kept))))
    return network


def _extracted(network: Network):
    def run(batches):
        for batch in batches:
            found = [blocks(t) if t else [] for t in batch.column("html").to_pylist()]
            marks = network.label(vectors(found))
            texts = ["\n".join(b[0] for b, p in zip(f, m, strict=True) if p >= 0.5) for f, m in zip(found, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, network: Network) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``."""
    tune(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(network), "page_id long, url string, text string, n_chars long")
