"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks (text between block boundaries). Each block gets
hashed tag-path tokens (tags, classes, ids and roles of its ancestors), hashed
words and a few figures; a bidirectional LSTM in numpy reads the whole sequence
and decides for every block whether it is main text, so a block is judged in the
context of its document. The model is trained on generated pages whose layouts,
names and texts vary; nothing is learnt from the pages to be extracted.

Defined results: null and empty html, and pages without any main text, give an
empty text of 0 characters; damaged markup (missing end tags, cut references)
is read as far as it goes; repeated rows each get a row; extra columns are
ignored. Pages are read whole.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batches

PATH_SLOTS, WORD_SLOTS, PATH_SIZE, WORD_SIZE, FIGURES, HIDDEN = 4096, 4096, 20, 6, 7, 20
#: Blocks of a group of pages, padding counted, and steps whose gates are held at once: what bounds memory.
CELLS, RUN = 16_384, 1024
TRAIN_PAGES, EPOCHS, BATCH, RATE, SEED = 900, 8, 30, 0.01, 5

# Fixed values of HTML: elements by how they cut and nest text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object textarea math canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_COMMENT = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
_PLAIN = r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)"
MARK = re.compile(rf"""{_COMMENT}|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|{_PLAIN}""", re.S)
#: The marks once a quote of a tag was never closed: from there on quotes mean nothing.
LOOSE_MARK = re.compile(rf"{_COMMENT}|()()()(?!)|{_PLAIN}", re.S)
NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACES = re.compile(r"\s+")
WORDS = re.compile(r"\w+")


@dataclass(eq=False, slots=True)
class Place:
    """An element of a path: what it adds to the path of its parent.

    ``slots`` are the slots of its tag and names that no ancestor has, ``near``
    those of the path's last two tags; a path is a chain of places, so blocks
    share it and a page needs memory in proportion to its length.
    """

    parent: Place | None
    slots: tuple[int, ...]
    near: tuple[int, ...]
    level: int


@dataclass
class Block:
    path: Place
    text: str
    linked: int  # characters inside links
    depth: int


ROOT = Place(None, (), (), 0)


@lru_cache(maxsize=65536)
def _slot(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % PATH_SLOTS


@lru_cache(maxsize=65536)
def _word_slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for value in NAMES.findall(attributes):
        found += ["." + part.lower() for part in PARTS.findall(value)]
    return tuple(found)


class _Stack:
    """The open elements of a page; every step costs a constant time for each element opened."""

    def __init__(self):
        self.tags: list[str] = []
        self.places: list[Place] = []
        self.outer: list[int] = []  # indexes of the elements that are not inline
        self.open: dict[str, list[int]] = {}
        self.slots: set[int] = set()

    def top(self) -> Place:
        return self.places[-1] if self.places else ROOT

    def last(self, *tags: str) -> int:
        """The innermost open element with one of these tags, -1 without any."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def innermost(self) -> int:
        """The innermost open element that is not inline, -1 without any."""
        return self.outer[-1] if self.outer else -1

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        place = self.top()
        if tag not in INLINE or names:
            fresh = tuple(dict.fromkeys(x for x in map(_slot, ("<" + tag, *names)) if x not in self.slots))
            self.slots.update(fresh)
            place = Place(place, fresh, (*place.near[-1:], _slot("^<" + tag)), place.level + 1)
        self.open.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.outer.append(len(self.tags))
        self.tags.append(tag)
        self.places.append(place)

    def cut(self, size: int) -> None:
        """Closes all but the ``size`` outermost elements."""
        while len(self.tags) > size:
            tag, place = self.tags.pop(), self.places.pop()
            self.open[tag].pop()
            if self.outer and self.outer[-1] == len(self.tags):
                self.outer.pop()
            if place is not self.top():
                self.slots.difference_update(place.slots)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in page order; raw and head elements have none.

    A tag whose quotes never close ends at the next ``>``, and quotes mean
    nothing after it. Time and memory are linear in the length of the page.
    """
    page = page or ""
    out: list[Block] = []
    stack = _Stack()
    pieces: list[str] = []
    state = {"linked": 0, "path": None}
    endless: set[str] = set()  # raw elements that are not closed any more

    def flush() -> None:
        if pieces:
            text = SPACES.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append(Block(state["path"] or ROOT, text, state["linked"], len(stack.tags)))
            pieces.clear()
        state["linked"], state["path"] = 0, None

    def add(text: str) -> None:
        if not text:
            return
        if state["path"] is None and not text.isspace():
            state["path"] = stack.top()
        if stack.open.get("a"):
            state["linked"] += len(text)
        pieces.append(text)

    at, end, marks = 0, len(page), MARK
    while at < end:
        mark = marks.search(page, at)
        if mark is None:
            add(page[at:])
            break
        add(page[at : mark.start()])
        at = mark.end()
        if mark[5]:
            marks = LOOSE_MARK
        tag = (mark[2] or mark[5] or "").lower()
        if not tag:
            continue
        closing, attributes = mark[1] or mark[4], mark[3] or mark[6] or ""
        if closing:
            if tag not in INLINE:
                flush()
            k = stack.last(tag)
            if k >= 0 and (tag not in INLINE or k > stack.innermost()):
                stack.cut(k)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in RAW or tag == "title":
            if not attributes.endswith("/"):
                stop = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if stop is None:
                    endless.add(tag)
                at = stop.end() if stop else (end if tag in ("script", "style") else at)
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P and 0 <= stack.last("p") == stack.innermost():
            stack.cut(stack.last("p"))
        if tag in SIBLINGS:
            k = stack.last(tag, *next((pair for pair in (("dt", "dd"), ("td", "th")) if tag in pair), ()))
            if k > stack.last(*SIBLINGS[tag]):
                stack.cut(k)
        if tag not in VOID and not attributes.endswith("/"):
            stack.push(tag, _names(attributes))
    flush()
    return out


class Inputs:
    """What the model reads of some pages: their places, and words and figures of their blocks.

    Places stand by level, so that a path's sum is its parent's and its own.
    """

    def __init__(self, pages: list[list[Block]]):
        self.sizes = [len(p) for p in pages]
        every = [b for p in pages for b in p]
        found: dict[int, Place] = {}
        for b in every:
            place = b.path
            while place is not None and id(place) not in found:
                found[id(place)] = place
                place = place.parent
        places = sorted(found.values(), key=lambda x: x.level)
        row = {id(x): k for k, x in enumerate(places)}
        self.parent = np.array([row[id(x.parent)] if x.parent is not None else 0 for x in places], np.int64)
        self.levels = np.searchsorted([x.level for x in places], np.arange(places[-1].level + 2)).tolist() if places else []
        self.slots, self.slot_rows = self._flat([x.slots for x in places])
        self.place = np.array([row[id(b.path)] for b in every], np.int64)
        self.near, self.near_rows = self._flat([b.path.near for b in every])
        spoken = [list(map(_word_slot, WORDS.findall(b.text.lower()))) or [0] for b in every]
        self.counts = np.array([len(x) for x in spoken], np.int64)
        self.words, _ = self._flat(spoken)
        self.figures = np.array(
            [
                [np.log1p(len(b.text)) / 6, b.linked / max(1, len(b.text)), np.log1p(b.text.count(" ")) / 5, sum(map(b.text.count, ".,;!?")) / max(1, len(b.text)) * 10, k / max(1, len(p) - 1), min(b.depth, 50) / 10, 1.0]
                for p in pages
                for k, b in enumerate(p)
            ],
            np.float32,
        ).reshape(-1, FIGURES)

    @staticmethod
    def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((x for own in lists for x in own), np.int64, int(sizes.sum())), np.repeat(np.arange(len(lists)), sizes)

    def starts(self) -> np.ndarray:
        """The first block of every page, and the number of all."""
        return np.cumsum([0, *self.sizes])


class Model:
    """Embeddings, an LSTM in each direction and a logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        wide = PATH_SIZE + WORD_SIZE + FIGURES
        self.p = {"path": rng.normal(0, 0.1, (PATH_SLOTS, PATH_SIZE)), "word": rng.normal(0, 0.05, (WORD_SLOTS, WORD_SIZE))}
        for side in ("f", "b"):
            self.p["x" + side] = rng.normal(0, 0.2, (wide, 4 * HIDDEN))
            self.p["h" + side] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.p["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p |= {"o": rng.normal(0, 0.2, 2 * HIDDEN), "s": rng.normal(0, 0.1, wide), "z": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def embedded(self, inputs: Inputs) -> np.ndarray:
        """The input vector of every block."""
        sums = np.zeros((len(inputs.parent), PATH_SIZE), np.float32)
        np.add.at(sums, inputs.slot_rows, self.p["path"][inputs.slots])
        for low, high in zip(inputs.levels[1:], inputs.levels[2:], strict=False):
            sums[low:high] += sums[inputs.parent[low:high]]
        a = sums[inputs.place]
        np.add.at(a, inputs.near_rows, self.p["path"][inputs.near])
        b = np.add.reduceat(self.p["word"][inputs.words], np.cumsum(inputs.counts) - inputs.counts, axis=0) if len(inputs.words) else np.zeros((0, WORD_SIZE), np.float32)
        return np.concatenate([a, b / inputs.counts[:, None].astype(np.float32), inputs.figures], 1)

    def _spread(self, inputs: Inputs, dx: np.ndarray, grads: dict) -> None:
        """Adds the gradients of the embeddings from those of the input vectors."""
        np.add.at(grads["path"], inputs.near, dx[inputs.near_rows, :PATH_SIZE])
        sums = np.zeros((len(inputs.parent), PATH_SIZE), np.float32)
        np.add.at(sums, inputs.place, dx[:, :PATH_SIZE])
        for low, high in reversed(list(zip(inputs.levels[1:], inputs.levels[2:], strict=False))):
            np.add.at(sums, inputs.parent[low:high], sums[low:high])
        np.add.at(grads["path"], inputs.slots, sums[inputs.slot_rows])
        own = dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / inputs.counts[:, None]
        np.add.at(grads["word"], inputs.words, np.repeat(own, inputs.counts, axis=0))

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, HIDDEN); ``x`` is (T, B, wide), ``mask`` (T, B). Rows beyond a page's end hold state."""
        steps, width = x.shape[:2]
        gates_x, low = None, 0
        h = c = np.zeros((width, HIDDEN), np.float32)
        out = np.zeros((steps, width, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            if gates_x is None or not low <= t < low + RUN:
                low = t // RUN * RUN
                gates_x = x[low : low + RUN] @ self.p["x" + side] + self.p["c" + side]
            g = gates_x[t - low] + h @ self.p["h" + side]
            gate = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = np.split(gate, 3, 1)
            new = np.tanh(g[:, 3 * HIDDEN :])
            c2 = f * c + i * new
            tc = np.tanh(c2)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, new, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[t] = h
        return out

    def _back(self, x: np.ndarray, dh_out: np.ndarray, side: str, kept: list, grads: dict) -> np.ndarray:
        dx = np.zeros_like(x)
        dh = dc = np.zeros(dh_out.shape[1:], np.float32)
        for t, h, c, i, f, o, new, tc, m in reversed(kept):
            dh = dh + dh_out[t]
            inner = dh * m
            dc2 = dc * m + inner * o * (1 - tc * tc)
            dg = np.concatenate([dc2 * new * i * (1 - i), dc2 * c * f * (1 - f), inner * tc * o * (1 - o), dc2 * i * (1 - new * new)], 1)
            grads["x" + side] += x[t].T @ dg
            grads["h" + side] += h.T @ dg
            grads["c" + side] += dg.sum(0)
            dx[t] = dg @ self.p["x" + side].T
            dh = dg @ self.p["h" + side].T + dh * (1 - m)
            dc = dc2 * f + dc * (1 - m)
        return dx

    def _padded(self, inputs: Inputs) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors (T, B, wide) and mask (T, B) of pages side by side."""
        rows, starts = self.embedded(inputs), inputs.starts()
        x = np.zeros((max(inputs.sizes), len(inputs.sizes), rows.shape[1]), np.float32)
        mask = np.zeros(x.shape[:2], np.float32)
        for k, size in enumerate(inputs.sizes):
            x[:size, k], mask[:size, k] = rows[starts[k] : starts[k + 1]], 1
        return x, mask

    def _logits(self, x: np.ndarray, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
        return np.concatenate([hf, hb], 2) @ self.p["o"] + x @ self.p["s"] + self.p["z"][0]

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, whether each of its blocks is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool) for _ in pages]
        group: list[int] = []
        for k in sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k])):
            if group and len(pages[k]) * (len(group) + 1) > CELLS:
                self._label(pages, group, out)
                group = []
            group.append(k)
        if group:
            self._label(pages, group, out)
        return out

    def _label(self, pages: list[list[Block]], group: list[int], out: list[np.ndarray]) -> None:
        inputs = Inputs([pages[k] for k in group])
        x, mask = self._padded(inputs)
        logits = self._logits(x, self._run(x, mask, "f"), self._run(x, mask, "b"))
        for column, k in enumerate(group):
            out[k] = logits[: inputs.sizes[column], column] > 0

    def gradients(self, inputs: Inputs, x: np.ndarray, mask: np.ndarray, y: np.ndarray, drop: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of all blocks; ``drop`` is what the paths were multiplied by."""
        kept = {"f": [], "b": []}
        hf, hb = (self._run(x, mask, s, kept[s]) for s in ("f", "b"))
        logits = self._logits(x, hf, hb)
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y) * mask / mask.sum()
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        hidden = np.concatenate([hf, hb], 2)
        grads["o"] = np.tensordot(error, hidden, ([0, 1], [0, 1]))
        grads["s"] = np.tensordot(error, x, ([0, 1], [0, 1]))
        grads["z"][0] = error.sum()
        dh = error[:, :, None] * self.p["o"]
        dx = error[:, :, None] * self.p["s"]
        dx = dx + self._back(x, dh[:, :, :HIDDEN], "f", kept["f"], grads) + self._back(x, dh[:, :, HIDDEN:], "b", kept["b"], grads)
        dx[:, :, :PATH_SIZE] *= drop
        self._spread(inputs, np.concatenate([dx[:size, column] for column, size in enumerate(inputs.sizes)]), grads)
        return grads

    def train(self, pages: list, marks: list[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on the mean cross entropy of all blocks of a batch of pages."""
        rng = np.random.default_rng(seed)
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        count = 0
        for _ in range(epochs):
            # Pages of about one length share a batch, so little of it is padding.
            order = np.argsort([len(m) + 4 * rng.random() for m in marks])
            for low in BATCH * rng.permutation(-(-len(order) // BATCH)):
                group = order[low : low + BATCH]
                own = Inputs([pages[k] for k in group])
                x, mask = self._padded(own)
                drop = (rng.random((1, x.shape[1], PATH_SIZE)) > 0.1).astype(np.float32)
                x[:, :, :PATH_SIZE] *= drop
                y = np.zeros(x.shape[:2], np.float32)
                for column, k in enumerate(group):
                    y[: len(marks[k]), column] = marks[k]
                grads = self.gradients(own, x, mask, y, drop)
                count += 1
                for k, g in grads.items():
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.99 * two[k] + 0.01 * g * g
                    self.p[k] -= RATE * (one[k] / (1 - 0.9**count)) / (np.sqrt(two[k] / (1 - 0.99**count)) + 1e-7)


# What generated training pages are made of: names that sites give to parts of a page.
NAMED = {
    "menu": "nav menu navbar navigation topnav main-menu site-nav breadcrumb breadcrumbs tabs pagination pager toc links skip-links mega-menu sitemap",
    "head": "header site-header masthead banner top topbar logo branding page-header site-title tagline toolbar",
    "foot": "footer site-footer bottom copyright colophon legal foot page-footer credits imprint",
    "side": "sidebar side aside widget related recommended popular trending more-stories secondary rail right-column left-column rightbar teaser see-also tags tag-cloud recent-posts author-box read-next",
    "note": "cookie cookies cookie-banner consent notice gdpr alert popup modal overlay announcement privacy-notice warning message toast disclaimer paywall",
    "ad": "ad ads advert advertisement sponsored promo sponsor banner-ad ad-slot adsense promotion commercial adbox dfp partner",
    "form": "form search search-form newsletter subscribe signup login contact-form register poll survey newsletter-signup",
    "talk": "comments comment comment-list disqus discussion responses reply replies reader-comments comment-body user-comments respond thread guestbook reviews",
    "share": "share social sharing share-buttons follow social-links like-button meta byline print-link toolbar actions",
}
MAIN = "content post entry article article-body story post-content entry-content main main-content text body-text article-content page-content story-body prose blog-post news-article richtext single hentry articlebody"
SAYINGS = {
    "menu": "Home About Contact News Products Services Archive Shop Help Blog Login Next Previous",
    "head": "Welcome to our site | Daily News | Your source for everything | Sign in",
    "foot": "© All rights reserved | Privacy policy | Terms of use | Imprint | Copyright 2020",
    "side": "Related articles | Most read | You may also like | Recent posts | Categories | Popular",
    "note": "We use cookies to improve your experience | Accept all | This site uses cookies | Please accept our policy",
    "ad": "Advertisement | Sponsored | Buy now | Best offers | Click here | Special deal",
    "form": "Subscribe to our newsletter | Search | Your email | Send | Log in | Password",
    "talk": "Comments | Leave a reply | says: | Reply | Great post | Thanks for sharing | Report comment",
    "share": "Share on | Tweet | Like | Print | Email this | Follow us",
}


MAIN_MARK, OTHER_MARK = chr(0xE000), chr(0xE001)


def training_page(rng: np.random.Generator) -> str:
    """One generated page; text of main blocks begins with U+E000, all other with U+E001."""
    syllables = "an er in on th re st en or ti ion ca lo mu pe ri sa to ver um qua de le ß é ö ñ ing au ch".split()

    draw = random.Random(int(rng.integers(1 << 62)))
    pick = draw.choice

    def word() -> str:
        return "".join(draw.choices(syllables, k=draw.randrange(1, 4)))

    def prose(low: int, high: int) -> str:
        out = [word() for _ in range(rng.integers(low, high + 1))]
        out = [w + pick([".", ","]) if rng.random() < 0.12 else w for w in out]
        if rng.random() < 0.15:
            out = [w + pick(["***", "$$$", "%%%", "###"]) for w in out]
        elif rng.random() < 0.08:
            out = [w.upper() + "!!" for w in out]
        elif rng.random() < 0.08:
            out = [w + " |" for w in out]
        return " ".join(out).capitalize()

    def attribute(names: str) -> str:
        if rng.random() < 0.12:
            return ""
        name = pick(names.split())
        if rng.random() < 0.3:
            name = pick([f"{name} {word()}", f"{word()}-{name}", f"{name}-{rng.integers(9)}", f"{name}_{word()}"])
        return f' {pick(["class", "class", "id"])}="{name}"'

    def noise(kind: str, tag: str | None = None) -> str:
        own = {"menu": ["nav", "ul", "div"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div", "section"], "note": ["div", "section", "p"], "ad": ["div", "aside", "ins", "section"], "form": ["form", "div"], "talk": ["section", "div", "ol"], "share": ["div", "ul"]}[kind]
        tag = tag or pick(own)
        named = attribute(NAMED[kind]) if tag in ("div", "section", "p", "ul", "ol", "ins") else (attribute(NAMED[kind]) if rng.random() < 0.5 else "")
        if tag in ("div", "section", "p", "ul", "ol", "ins") and not named:
            named = f' class="{pick(NAMED[kind].split())}"'
        says = [s.strip() for s in SAYINGS[kind].split("|" if "|" in SAYINGS[kind] else " ")]
        if kind == "menu" or (kind in ("foot", "side", "share") and rng.random() < 0.4):
            items = "".join(f'<li><a href="/{word()}">{OTHER_MARK}{pick(says) if rng.random() < 0.4 else word()}</a></li>' for _ in range(rng.integers(2, 9)))
            inside = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind == "form":
            inside = f'<label>{OTHER_MARK}{pick(says)}</label><input name="q"><button>{OTHER_MARK}{pick(says)}</button>' + (f"<p>{OTHER_MARK}{prose(4, 20)}</p>" if rng.random() < 0.4 else "")
        elif kind == "talk":
            inside = f"<h3>{OTHER_MARK}{pick(says)}</h3>" * (rng.random() < 0.7)
            for _ in range(rng.integers(1, 6)):
                body = f"<p>{OTHER_MARK}{prose(3, 60)}</p>"
                inside += pick([body, f'<div class="{pick(["comment", "reply", "comment-body"])}"><b>{OTHER_MARK}{word()}</b>{body}</div>', f"<li>{body}</li>" if tag == "ol" else body])
        else:
            text = prose(3, 40) if rng.random() < 0.7 else pick(says)
            inside = pick([f"{OTHER_MARK}{text}", f"<p>{OTHER_MARK}{text}</p>", f"<h4>{OTHER_MARK}{pick(says)}</h4><p>{OTHER_MARK}{text}</p>", f"{OTHER_MARK}{pick(says)} &middot; {text}"])
            if tag == "p":
                inside = f"{OTHER_MARK}{text}"
        return f"<{tag}{named}>{inside}</{tag}>"

    def main_text() -> str:
        parts = []
        if rng.random() < 0.85:
            parts.append(f"<h1>{MAIN_MARK}{prose(2, 12)}</h1>")
        for _ in range(rng.integers(1, 14) if rng.random() < 0.9 else rng.integers(14, 40)):
            kind = rng.random()
            text = prose(1, 8) if rng.random() < 0.2 else prose(8, 120)
            if (odd := rng.random()) < 0.06:  # words of site parts occur in main text as well
                text = pick([s.strip() for s in pick(list(SAYINGS.values())).split("|")]) + pick(["", "."])
            elif odd < 0.14:
                text = prose(1, 2)
            if kind < 0.62:
                link = f' <a href="/{word()}">{word()}</a> {word()}' if rng.random() < 0.15 else ""
                parts.append(f"<p>{MAIN_MARK}{text}{link}" + "</p>" * (rng.random() < 0.93))
            elif kind < 0.72:
                parts.append(f"<p><b>{MAIN_MARK}{text}<br>")
            elif kind < 0.8:
                parts.append(f"<h{pick('23')}>{MAIN_MARK}{prose(1, 9)}</h2>".replace("</h2>", ""))
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{MAIN_MARK}{prose(2, 25)}</li>" for _ in range(rng.integers(1, 6))) + "</ul>")
            elif kind < 0.91:
                parts.append(f"<blockquote>{MAIN_MARK}{text}</blockquote>")
            elif kind < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{MAIN_MARK}{prose(1, 4)}</td><td>{MAIN_MARK}{prose(1, 4)}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            else:
                parts.append(f"<div>{MAIN_MARK}{text}</div>")
            if rng.random() < 0.04:
                parts.append(noise(pick(["ad", "share", "side", "form", "note"])))
        return "".join(parts)

    before = [noise(k) for k in ("note", "head", "menu", "ad", "form", "share", "side") if rng.random() < {"menu": 0.75, "head": 0.45}.get(k, 0.25)]
    if rng.random() < 0.3:
        before = [before[k] for k in rng.permutation(len(before))]
    after = [noise(k) for k in ("share", "side", "talk", "ad", "form", "note", "menu", "foot") if rng.random() < {"foot": 0.8, "talk": 0.35, "side": 0.35}.get(k, 0.15)]
    kind = rng.random()
    text = main_text()
    if kind < 0.5:
        inner = f"<article{attribute(MAIN) if rng.random() < 0.3 else ''}>{text}</article>"
        if rng.random() < 0.3:
            inner = f"<main>{inner}</main>"
    elif kind < 0.62:
        inner = f"<main{attribute(MAIN) if rng.random() < 0.3 else ''}>{text}</main>"
    elif kind < 0.94:
        inner = f"<{(tag := pick(['div', 'div', 'section', 'td']))}{attribute(MAIN)}>{text}</{tag}>"
        inner = f"<table><tr>{inner}</tr></table>" if tag == "td" else inner
    else:
        inner = text
    if rng.random() < 0.25:
        wrapper = pick(["container", "wrapper", "page", "site", "row", "wrap", "layout", "app", "root", "outer"])
        return f'<html><body><div class="{wrapper}">{"".join(before)}{inner}{"".join(after)}</div></body></html>'
    if rng.random() < 0.1 and not before:
        after = []
    return f"<html><head><title>{prose(2, 6)}</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>"


def marked(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a generated page without their marks, and which of them are main text."""
    own = blocks(page)
    marks = np.array([MAIN_MARK in b.text for b in own], np.float32)
    for b in own:
        b.text = b.text.replace(MAIN_MARK, "").replace(OTHER_MARK, "")
    return own, marks


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    made = [m for m in (marked(training_page(rng)) for _ in range(pages)) if len(m[0])]
    model = Model(seed)
    model.train([b for b, _ in made], [m for _, m in made])
    return model


def extract_texts(model: Model, pages: list[str | None]) -> list[str]:
    cut = [blocks(p) for p in pages]
    return [" ".join(b.text for b, keep in zip(own, kept, strict=True) if keep) for own, kept in zip(cut, model.label(cut), strict=True)]


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, 256):
            texts = extract_texts(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
