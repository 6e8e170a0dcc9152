"""Main-text extraction: a bidirectional LSTM labels every text block of a page.

A page becomes the sequence of its leaf blocks. Each block is a vector of its
tag path, its hashed words and a few measures; the network reads the sequence
both ways, so a block is judged in the context of the whole page. It is trained
on pages that ``synthetic_page`` invents, with known labels, and never on the input.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import _shared as S

#: Elements without content, elements whose content is never text, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript svg math iframe object canvas title head select textarea button".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: What may stand in a head without ending it, and what cannot stand in a button or a list of choices.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
NO_CONTROL = frozenset("p h1 h2 h3 h4 h5 h6 article section main header footer nav aside ul ol dl table form blockquote pre body".split())
CONTROLS = ("button", "select")
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
_RAW = frozenset("script style template noscript iframe textarea svg title".split())

#: A plain tag without any of the rarer forms; every other one is read attribute by attribute.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"'=]*)((?:\s+[^\s/<>\"'=]+(?:=\"[^\"<>]*\")?)*)\s*(/?)>")
_NAMED = re.compile(r"\s(?:class|id|role)=\"([^\"]*)\"", re.I)
_NAME, _SKIP, _ATTRIBUTE, _EQUALS, _VALUE = (re.compile(p) for p in (r"[^\s/>]+", r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
#: Innermost elements that a block's path keeps; those above would weigh under two in a million.
DEPTH = 256
_WORDS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}


@dataclass
class Block:
    """Text between two block-level tags, the elements around it and how much of it is links."""

    text: str
    path: tuple[str, ...]
    links: int


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, str]] = field(default_factory=list)  # name, name with class and id words
    names: Counter = field(default_factory=Counter)  # how often each name is on the stack
    depths: list[int] = field(default_factory=list)  # where on the stack block-level elements are
    parts: list[str] = field(default_factory=list)
    blank: bool = True  # no part has anything but white space
    path: tuple[str, ...] = ()
    links: int = 0
    unseen: int = 0
    anchors: int = 0

    def text(self, raw: str) -> None:
        if not raw:
            return
        if self.unseen:
            if self.stack[-1][0] != "head" or not raw.strip():
                return
            self.cut(len(self.stack) - 1)  # text begins the body
        found = entities.unescape(raw)
        if not found.strip():
            self.parts.append(found)
            return
        if self.blank:
            self.path = tuple(entry for name, entry in self.stack[-DEPTH:] if name not in INLINE)
            self.blank = False
        self.parts.append(found)
        if self.anchors:
            self.links += len(found)

    def flush(self) -> None:
        if self.parts:
            found = _SPACE.sub(" ", "".join(self.parts)).strip()
            if found:
                self.blocks.append(Block(found, self.path, self.links))
        self.parts, self.links, self.blank = [], 0, True

    def open(self, name: str, words: list[str], ends: bool = True) -> None:
        """``ends``: whether the page has a closing tag for it further on; unseen elements without one are passed over."""
        if self.unseen:
            if self.stack[-1][0] == "head" and name not in IN_HEAD:
                self.cut(len(self.stack) - 1)
            elif name in NO_CONTROL or name in CONTROLS:
                self.end_control()
        if name == "br":
            self.text(" ")
            self.parts.append(" ")
            return
        if name not in INLINE:
            self.flush()
        if name in VOID or name in UNSEEN and not ends:
            return
        if name not in INLINE:  # a new block ends an open paragraph, a list item or cell its like
            like = ("p",) if name not in ("li", "td", "th", "tr", "dt", "dd", "option") else ("p", name)
            if self.depths and self.stack[self.depths[-1]][0] in like:
                self.cut(self.depths[-1])
            self.depths.append(len(self.stack))
        self.names[name] += 1
        self.stack.append((name, name + "".join(f".{w}" for w in words)))
        self.unseen += name in UNSEEN
        self.anchors += name == "a"

    def end_control(self) -> None:
        """Ends an open button or list of choices, in which what comes next cannot stand."""
        if any(self.names[c] for c in CONTROLS):
            depth = len(self.stack) - 1
            while self.stack[depth][0] not in CONTROLS:
                depth -= 1
            self.cut(depth)

    def close(self, name: str) -> None:
        if name not in INLINE:
            self.flush()
        if self.names[name]:
            depth = len(self.stack) - 1
            while self.stack[depth][0] != name:
                depth -= 1
            self.cut(depth)

    def cut(self, depth: int) -> None:
        for name, _ in self.stack[depth:]:
            self.names[name] -= 1
            self.unseen -= name in UNSEEN
            self.anchors -= name == "a"
        del self.stack[depth:]
        while self.depths and self.depths[-1] >= depth:
            self.depths.pop()


def _markup(page: str, at: int) -> tuple[int, str, bool, list[str]] | None:
    """What stands at the ``<`` at ``at``: its end, the tag's lower-case name ("": a comment or the like),
    whether it closes, and its class, id and role words. None: a plain character.

    Tags follow the grammar of HTML: a quote opens a value only right after the
    equals sign; an unclosed quote ends with its tag, an unclosed tag or comment with the page.
    An end of -1: no tag ends any more, and the rest is text.
    """
    found = _PLAIN.match(page, at)
    if found:
        words = [w for v in _NAMED.findall(found[3]) for w in _WORDS.findall(v.lower())] if found[3] else []
        return found.end(), found[2].lower(), bool(found[1]), words
    if page.startswith("<!--", at):
        for empty in (">", "->"):
            if page.startswith(empty, at + 4):
                return at + 4 + len(empty), "", False, []
        return _after(page, "-->", at + 4), "", False, []
    closes = page.startswith("/", at + 1)
    first = page[at + 1 + closes : at + 2 + closes]
    if not (first.isascii() and first.isalpha()):
        return (_after(page, ">", at + 1), "", False, []) if closes or first in ("!", "?") and first else None
    place = _NAME.match(page, at + 1 + closes).end()
    name, words = page[at + 1 + closes : place].lower(), []
    while True:
        place = _SKIP.match(page, place).end()
        if place >= len(page):
            return (len(page) if ">" in page[at:] else -1), "", False, []
        if page[place] == ">":
            return place + 1, name, closes, words
        begin, place = place, _ATTRIBUTE.match(page, place).end()
        attribute, equals, value = page[begin:place].lower(), _EQUALS.match(page, place), ""
        if equals:
            place = equals.end()
            quote = page[place : place + 1]
            if quote and quote in "\"'":
                end = page.find(quote, place + 1)
                end = end if end >= 0 else page.find(">", place)
                if end < 0:
                    return -1, "", False, []
                value, place = page[place + 1 : end], end + (page[end] == quote)
            else:
                begin, place = place, _VALUE.match(page, place).end()
                value = page[begin:place]
        if attribute in ("class", "id", "role"):
            words += _WORDS.findall(value.lower())


def _after(page: str, mark: str, at: int) -> int:
    found = page.find(mark, at)
    return found + len(mark) if found >= 0 else len(page)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; entities decoded, white space collapsed. Time is linear in the page.

    End tags that a page may leave out are implied: of a head by whatever cannot
    stand in it, of a button or list of choices by blocks that cannot. Elements of
    which nothing is seen, but that never end, hide nothing.
    """
    reader, at, text = _Reader(), 0, 0
    last: dict[str, int] = {}

    def ends(name: str) -> bool:
        if name not in last:
            last[name] = max((m.start() for m in re.finditer(rf"</{name}(?=[\s/>])", page, re.I)), default=-1)
        return last[name] >= at

    while (at := page.find("<", at)) >= 0:
        found = _markup(page, at)
        if found is None:
            at += 1
            continue
        if found[0] < 0:
            break
        reader.text(page[text:at])
        at, name, closes, words = found
        if closes:
            reader.close(name)
        elif name in _RAW and page[at - 2] != "/" and (name not in ("svg", "noscript", "iframe", "template") or ends(name)):
            end = _END_OF[name].search(page, at)
            at = _after(page, ">", end.end()) if end else len(page)
        elif name:
            reader.open(name, words, name not in UNSEEN or name == "head" or ends(name))
        text = at
    reader.text(page[text:])
    reader.flush()
    return reader.blocks


# ------------------------------------------------------------ vectors

PATH, WORDS, MEASURES = 256, 32, 10
FEATURES = PATH + WORDS + MEASURES
_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed element names and class words, the inner elements counting more."""
    if path not in _PATHS:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        v = np.zeros(PATH, np.float32)
        for depth, entry in enumerate(reversed(path)):
            name, *words = entry.split(".")
            for token, size in ((name, 1.0), *((f".{w}", 1.5) for w in words)):
                v[zlib.crc32(token.encode()) % PATH] += size * 0.95**depth
        _PATHS[path] = v
    return _PATHS[path]


def vectors(found: list[Block]) -> np.ndarray:
    """One row for each block of a page."""
    out = np.zeros((len(found), FEATURES), np.float32)
    for k, b in enumerate(found):
        words = b.text.lower().split()
        hashed = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in words], minlength=WORDS)
        out[k, :PATH] = _path_vector(b.path)
        out[k, PATH : PATH + WORDS] = hashed / len(words) / 2
        n, leaf = len(b.text), b.path[-1].split(".")[0] if b.path else ""
        marks = sum(b.text.count(c) for c in ".,;:!?")
        out[k, PATH + WORDS :] = (
            np.log1p(n) / 5, np.log1p(len(words)) / 4, b.links / n, marks / len(words), b.text[-1] in ".!?",
            leaf in HEADINGS, leaf == "li", leaf == "p", k / len(found), 1.0,
        )
    return out


# ------------------------------------------------------------ network

HIDDEN = 20


class Network:
    """Two LSTMs over the blocks, one from either end, and a logistic output on both states."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {}
        for side in "fb":
            self.w[f"x{side}"] = (rng.standard_normal((FEATURES, 4 * HIDDEN)) / np.sqrt(FEATURES)).astype(np.float32)
            self.w[f"h{side}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
            self.w[f"c{side}"] = bias
        self.w["out"] = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.w["bias"] = np.zeros(1, np.float32)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray) -> dict:
        steps, n = mask.shape
        z = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        gates, cells, states = np.zeros_like(z), np.zeros((steps + 1, n, HIDDEN), np.float32), np.zeros((steps + 1, n, HIDDEN), np.float32)
        for t in range(steps):
            g = z[t] + states[t] @ self.w[f"h{side}"]
            g[:, : 3 * HIDDEN] = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            g[:, 3 * HIDDEN :] = np.tanh(g[:, 3 * HIDDEN :])
            i, f, o, c = (g[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            on = mask[t][:, None]
            cells[t + 1] = np.where(on, f * cells[t] + i * c, cells[t])
            states[t + 1] = np.where(on, o * np.tanh(cells[t + 1]), states[t])
            gates[t] = g
        return {"x": x, "mask": mask, "gates": gates, "cells": cells, "states": states}

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict, dict]:
        """Probabilities (step, page); padding only ever stands after a page's blocks."""
        a, b = self._run("f", x, mask), self._run("b", x[::-1], mask[::-1])
        h = np.concatenate((a["states"][1:], b["states"][1:][::-1]), 2)
        return 1 / (1 + np.exp(-(h @ self.w["out"] + self.w["bias"]))), a, b

    def _back(self, side: str, run: dict, d_states: np.ndarray) -> dict[str, np.ndarray]:
        steps, n = run["mask"].shape
        dz = np.zeros_like(run["gates"])
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            on = run["mask"][t][:, None]
            i, f, o, c = (run["gates"][t][:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            d = dh + d_states[t]
            tanh = np.tanh(run["cells"][t + 1])
            inner = dc + d * o * (1 - tanh**2)
            step = np.concatenate((inner * c * i * (1 - i), inner * run["cells"][t] * f * (1 - f), d * tanh * o * (1 - o), inner * i * (1 - c**2)), 1) * on
            dz[t] = step
            dh = np.where(on, step @ self.w[f"h{side}"].T, dh)
            dc = np.where(on, inner * f, dc)
        flat = dz.reshape(-1, 4 * HIDDEN)
        return {f"x{side}": run["x"].reshape(-1, FEATURES).T @ flat, f"h{side}": run["states"][:-1].reshape(-1, HIDDEN).T @ flat, f"c{side}": flat.sum(0)}

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, a, b = self.forward(x, mask)
        d = ((p - y) * mask / mask.sum()).astype(np.float32)
        h = np.concatenate((a["states"][1:], b["states"][1:][::-1]), 2)
        dh = d[:, :, None] * self.w["out"]
        out = {"out": np.einsum("tn,tnh->h", d, h), "bias": d.sum(keepdims=True)[0]}
        return out | self._back("f", a, dh[:, :, :HIDDEN]) | self._back("b", b, dh[::-1, :, HIDDEN:])

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each block of each page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if len(pages[k])]
        at = 0
        while at < len(order):
            some = order[at : at + max(1, min(256, 20_000 // len(pages[order[at]])))]
            while len(some) > 1 and len(pages[some[-1]]) * len(some) > 40_000:
                some = some[: len(some) // 2]
            x, mask = pad([pages[k] for k in some])
            p = self.forward(x, mask)[0]
            for n, k in enumerate(some):
                out[k] = p[: len(pages[k]), n]
            at += len(some)
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), FEATURES), np.float32), np.zeros((steps, len(pages)), bool)
    for n, p in enumerate(pages):
        x[: len(p), n], mask[: len(p), n] = p, True
    return x, mask


# ------------------------------------------------------------ training pages


MARK = "\ue000"


def synthetic_page(rng: random.Random) -> str:
    """An invented page; blocks of the main text begin with ``MARK``."""
    letters = list("aeiourstnlmdcpgbéüñ")
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 10)))
    some = rng.choice
    vocabulary = [word() for _ in range(150)]

    def prose(low: int, high: int) -> str:
        words = rng.choices(vocabulary, k=rng.randrange(low, high))
        out = [w.capitalize() if k == 0 or rng.random() < 0.05 else w for k, w in enumerate(words)]
        return " ".join(w + some([".", ".", ",", "!"]) if rng.random() < 0.12 else w for w in out) + some([".", ".", ".", "", "?"])

    def wrap(kinds: list[str], inside: str) -> str:
        kind = some(kinds)
        tag, _, name = kind.partition(".")
        if name and rng.random() < 0.25:
            name = f"{name} {word()}" if rng.random() < 0.5 else f"{name}-{some(['box', 'wrap', 'block', 'area', 'list'])}"
        attribute = f' {some(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attribute}>{inside}</{tag}>"

    def links(n: int) -> str:
        each = [f'<a href="/{word()}">{prose(1, 4)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if rng.random() < 0.6 else some([" ", " | ", "<br>"]).join(each)

    def extra() -> str:
        return some_of([
            lambda: wrap(["div.ad", "div.ads", "div.advert", "div.sponsored", "div.promo", "div.banner", "aside.advertisement"], some([prose(2, 40), f"<p>{prose(3, 30)}</p>"])),
            lambda: wrap(["aside", "aside.sidebar", "div.sidebar", "div.widget", "section.related", "div.recommended", "div.trending"], f"<h3>{prose(1, 4)}</h3>" + some([links(5), f"<p>{prose(5, 50)}</p>"])),
            lambda: wrap(["div.cookie", "div.notice", "div.consent", "div.alert", "div.gdpr", "div.warning", "div.popup", "p.notice"], some([prose(4, 40), f"<p>{prose(4, 40)}</p>"])),
            lambda: wrap(["form", "form.newsletter", "form.search", "form.login", "div.subscribe"], f"<p>{prose(2, 25)}</p><label>{prose(1, 3)}</label><input name=q><button>{word()}</button>"),
            lambda: wrap(["div.share", "div.social", "ul.tags", "div.breadcrumb", "div.pagination", "div.meta"], links(4)),
        ])

    def some_of(makers: list) -> str:
        return rng.choice(makers)()

    def comments() -> str:
        one = lambda: wrap(["div.comment", "li.comment", "article.comment", "div.reply"], f"<p>{prose(4, 60)}</p>" if rng.random() < 0.7 else prose(4, 60))
        return wrap(["section.comments", "div.comments", "div.discussion", "ol.commentlist", "div.responses"], f"<h3>{prose(1, 3)}</h3>" + "".join(one() for _ in range(rng.randrange(1, 6))))

    mark = MARK

    def main_part() -> str:
        r = rng.random()
        if r < 0.7:
            text = mark + prose(1 if rng.random() < 0.2 else 8, 90)
            if rng.random() < 0.15:
                text = f"<b>{text}</b>"
            if rng.random() < 0.1:
                text += "<br>"
            return f"<p>{text}" + ("</p>" if rng.random() < 0.85 else "")
        if r < 0.82:
            return f"<h{(n := rng.randrange(2, 4))}>{mark}{prose(2, 8)}</h{n}>"
        if r < 0.9:
            return "<ul>" + "".join(f"<li>{mark}{prose(2, 25)}</li>" for _ in range(rng.randrange(1, 6))) + "</ul>"
        if r < 0.95:
            return f"<blockquote>{mark}{prose(5, 40)}</blockquote>"
        return some([f"<pre>{mark}{prose(5, 30)}</pre>", f"<div>{mark}{prose(5, 60)}</div>", f"<table><tr><td>{mark}{prose(1, 5)}</td><td>{mark}{prose(1, 5)}</td></tr></table>"])

    parts = [f"<h1>{mark}{prose(2, 14)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.randrange(1, 16)):
        parts.append(main_part())
        if rng.random() < 0.06:
            parts.append(extra())
    article = wrap(["article", "article", "article", "article.post", "main", "main.content", "div.content", "div.entry", "div.post", "div.article", "div.main", "section.story", "div.text", "div"], "".join(parts))
    if rng.random() < 0.3:
        article = wrap(["main", "div.container", "div.wrapper", "div.page"], article)
    top = [extra() for _ in range(rng.randrange(0, 3))]
    if rng.random() < 0.85:
        top.insert(rng.randrange(len(top) + 1), wrap(["nav", "nav", "div.menu", "div.nav", "ul.navigation", "nav.menu"], links(rng.randrange(2, 9))))
    if rng.random() < 0.4:
        top.insert(0, wrap(["header", "div.header", "div.masthead", "header.site"], some([f"<h1>{prose(1, 4)}</h1>", f"<p>{prose(1, 9)}</p>", f"<a href='/'>{prose(1, 3)}</a>"])))
    bottom = [extra() for _ in range(rng.randrange(0, 3))]
    if rng.random() < 0.35:
        bottom.insert(0, comments())
    if rng.random() < 0.85:
        bottom.append(wrap(["footer", "footer", "div.footer", "footer.site", "div.copyright"], some([f"&copy; {prose(2, 20)}", f"<p>{prose(3, 30)}</p>", links(3), prose(3, 25)])))
    return f"<html><head><title>{prose(2, 6)}</title></head><body>{''.join(top)}{article}{''.join(bottom)}</body></html>"


#: Invented training pages and passes over them.
PAGES, EPOCHS, BATCH, RATE = 1200, 10, 32, 0.01
_TRAINED: list[Network] = []


def trained(pages: int = PAGES, seed: int = 11) -> Network:
    """The network, trained once in a process; the same seed gives the same weights."""
    if _TRAINED and (pages, seed) == (PAGES, 11):
        return _TRAINED[0]
    rng, invent, data = np.random.default_rng(seed), random.Random(seed), []
    for _ in range(pages):
        found = blocks(synthetic_page(invent))
        label = np.array([b.text.startswith(MARK) for b in found], np.float32)
        for b in found:
            b.text = b.text.lstrip(MARK) or "-"
        data.append((vectors(found), label))
    data = [d for d in data if len(d[1])]
    network = Network()
    first, second, step = {k: np.zeros_like(v) for k, v in network.w.items()}, {k: np.zeros_like(v) for k, v in network.w.items()}, 0
    for epoch in range(EPOCHS):
        order = sorted(rng.permutation(len(data)), key=lambda k: len(data[k][1]) // 8)
        groups = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for g in rng.permutation(len(groups)):
            x, mask = pad([data[k][0] for k in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for n, k in enumerate(groups[g]):
                y[: len(data[k][1]), n] = data[k][1]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for k, d in network.gradient(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                network.w[k] = (network.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    if (pages, seed) == (PAGES, 11):
        _TRAINED.append(network)
    return network


# ------------------------------------------------------------ operator


def main_texts(pages: list[str], network: Network) -> list[str]:
    """The main text of each page: its blocks labelled so, joined by an empty line."""
    found = [blocks(p) for p in pages]
    labels = network.label([vectors(b) if b else np.zeros((0, FEATURES), np.float32) for b in found])
    return ["\n\n".join(b.text for b, p in zip(bs, ps, strict=True) if p >= 0.5) for bs, ps in zip(found, labels, strict=True)]


def extract(pages: DataFrame, network: Network, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` (code points).

    Null or empty html gives the empty text. Every row is answered by itself, so
    repeated pages give repeated rows, an empty table none. Pages are read whole,
    however long or malformed. Columns may have any names; kept ones called ``text``
    or ``n_chars`` give way to the results.
    """
    keep, whole = [c for c in keep if c not in ("text", "n_chars")], "__html"
    while whole in keep:
        whole += "_"
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col("html").alias(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, whole):
                texts = main_texts([h or "" for h in part.column(whole).to_pylist()], network)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = source.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return source.mapInArrow(run, schema)


def op1_html(spark, sf_dir: str) -> DataFrame:
    return extract(S.read(spark, sf_dir, "pages"), trained(), ["page_id", "url"])
