"""Main-text extraction: a bidirectional LSTM labels the blocks of a page.

A page is cut into blocks, the leaves of its element tree in page order. Each block becomes a
vector of its hashed tag path (names, classes, ids and roles of its ancestors), its hashed words
and a few sizes; an LSTM written in numpy reads the whole sequence of a page in both directions, so
that each block is labelled in the context of the whole document. Blocks labelled as main text are
joined in page order.

The model is trained here, from pages that ``training_pages`` invents with known labels: no page
of any corpus is used, and training is deterministic.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, WORD_DIM, SIZE_DIM = 128, 48, 10
DIM = PATH_DIM + WORD_DIM + SIZE_DIM
HIDDEN = 24
#: Bound on the invented pages that the model is fitted on.
TRAIN_PAGES = 2400
EPOCHS = 8
SEED = 11
#: Elements at either end of a path that describe a block; between them a path may be longer.
ENDS = 60

#: Fixed values of the HTML standard: elements that start a block of their own.
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "noscript", "ol",
    "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
))
#: Elements without an end tag.
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
))
#: Elements whose content is no text of the page.
SKIPPED = frozenset((
    "script", "style", "title", "textarea", "template", "iframe", "noframes", "noembed", "svg", "math", "object",
    "canvas", "audio", "video", "head", "noscript",
))
#: Those of them that end at their end tag alone, and else with the page.
RAW = frozenset((
    "script", "style", "title", "textarea", "iframe", "noframes", "noembed",
))
#: A start tag of the first ends an open element of the second, up to an element of the third.
_LIST, _TABLE = frozenset(["ul", "ol", "menu", "dir", "dl"]), frozenset(["table"])
CLOSES = {
    "li": (frozenset(["li"]), _LIST), "dt": (frozenset(["dt", "dd"]), _LIST), "dd": (frozenset(["dt", "dd"]), _LIST),
    "tr": (frozenset(["tr", "td", "th"]), _TABLE), "td": (frozenset(["td", "th"]), _TABLE | {"tr"}), "th": (frozenset(["td", "th"]), _TABLE | {"tr"}),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
#: A tag from behind its name to its end; quotes count where a value begins, and only if they are closed.
TAG = re.compile(r"""(?:[^>=]|=[ \t\n\f\r]*"[^"]*"|=[ \t\n\f\r]*'[^']*'|=)*+>""")
COMMENT_END = re.compile("--!?>")
MARKS = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKENS = re.compile(r"[a-z]+")
LARGE = bytes(range(65, 91))


class Block:
    __slots__ = ("path", "parts", "linked", "in_page")

    def __init__(self, path: tuple):
        self.path, self.parts, self.linked, self.in_page = path, [], 0, 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Open:
    """The open elements of a page."""

    def __init__(self):
        self.stack: list[tuple[str, tuple]] = []
        self.number: dict[str, int] = {}

    def push(self, name: str, marks: tuple) -> None:
        self.stack.append((name, marks))
        self.number[name] = self.number.get(name, 0) + 1

    def close(self, names: frozenset[str], border: frozenset[str] = frozenset()) -> bool:
        """Ends the innermost element of these names and all in it, unless one of ``border`` comes first."""
        if not any(self.number.get(n) for n in names):
            return False
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in border:
                return False
            if name in names:
                for gone, _ in self.stack[i:]:
                    self.number[gone] -= 1
                del self.stack[i:]
                return True
        return False

    def path(self) -> tuple:
        return tuple(self.stack) if len(self.stack) <= 2 * ENDS else (*self.stack[:ENDS], *self.stack[-ENDS:])


@lru_cache(64)
def _tags(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])", re.IGNORECASE | re.ASCII)


def _skipped_end(page: str, name: str, at: int) -> int:
    """Where the element of this name, of which the content begins at ``at``, ends; -1 if it never does.

    What holds no markup ends at its first end tag; others may hold elements of their own name.
    """
    depth = 1
    while tag := _tags(name).search(page, at):
        at = page.find(">", tag.end())
        if at < 0:
            break
        if tag[1]:
            depth -= 1
        elif name not in RAW and page[at - 1] != "/":
            depth += 1
        at += 1
        if not depth:
            return at
    return -1


def blocks(page: str) -> list[tuple[tuple, str, float]]:
    """``(path, text, share of linked characters)`` of each block with text, in page order.

    A path holds an entry per open element: its name and the words of its class, id, role and label; of
    a path of over ``2 * ENDS`` elements the outermost and innermost. All text is in some block but that
    of ``SKIPPED`` elements and comments; what looks like a tag and never ends is text.
    """
    found: list[Block] = []
    tree = _Open()
    current: Block | None = None
    links = at = 0
    endless: set[str] = set()

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            if text.isspace():
                return
            current = Block(tree.path())
            found.append(current)
        text = entities.unescape(text)
        current.parts.append(text)
        if links:
            current.linked += len(text)

    tags_end = page.rfind(">")
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            add(page[at:start])
        if start == len(page):
            break
        if page.startswith("<!--", start):
            end = COMMENT_END.search(page, start + 2)
            at = len(page) if end is None else end.end()
            continue
        match = NAME.match(page, start + 1)
        if match is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                at = len(page) if end < 0 else end + 1
            else:
                add("<")
                at = start + 1
            continue
        end = TAG.match(page, match.end()) if start < tags_end else None
        if end is None:
            add("<")
            at = start + 1
            continue
        name, closing, at = match[1].lower(), page[start + 1] == "/", end.end()
        inside = page[match.end() : at - 1]
        if closing:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCKS:
                current = None
                if tree.close(frozenset([name])):
                    links = 0
            continue
        if name in SKIPPED:
            if name == "head":
                continue  # its texts are skipped one by one; a page may forget to end it
            if name in RAW or not inside.endswith("/"):
                end = -1 if name in endless else _skipped_end(page, name, at)
                if end >= 0:
                    at = end
                else:
                    endless.add(name)
                    at = len(page) if name in RAW else at
            continue
        if name == "br":
            add(" ") if current is not None else None
        elif name == "a":
            links += 1
        elif name in BLOCKS:
            current = None
            if tree.stack and tree.stack[-1][0] == "p":
                tree.close(frozenset(["p"]))
                links = 0
            if name in CLOSES and tree.close(*CLOSES[name]):
                links = 0
            if name not in VOID:
                marks = []
                if inside.strip():
                    for m in MARKS.finditer(inside):
                        marks += TOKENS.findall((m[2] or m[3] or m[4] or "").lower())
                tree.push(name, tuple(marks))
    out = []
    for b in found:
        text = b.text()
        if text:
            out.append((b.path, text, b.linked / max(1, sum(map(len, b.parts)))))
    return out


def _crc(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass"))


@lru_cache(100_000)
def _slot(feature: str, dim: int) -> int:
    return _crc(feature) % dim


@lru_cache(20_000)
def _path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    for i, (name, marks) in enumerate(path):
        v[_slot("t:" + name, PATH_DIM)] = 1
        if i == len(path) - 1:
            v[_slot("leaf:" + name, PATH_DIM)] = 1
        for mark in marks:
            v[_slot("m:" + mark, PATH_DIM)] = 1
            for k in range(0, max(1, len(mark) - 3)):
                v[_slot("g:" + mark[k : k + 4], PATH_DIM)] += 0.25
    return np.minimum(v, 1)


def _vectors(page: list[tuple[tuple, str, float]]) -> np.ndarray:
    """Feature vectors of the blocks of a page, one row each."""
    out = np.zeros((len(page), DIM), np.float32)
    for i, (path, text, linked) in enumerate(page):
        row = out[i]
        row[:PATH_DIM] = _path_vector(path)
        words = text.lower().split()
        slots = np.fromiter((_slot("w:" + w, WORD_DIM) if len(w) <= 32 else _crc("w:" + w) % WORD_DIM for w in words), np.int64, len(words))
        row[PATH_DIM : PATH_DIM + WORD_DIM] = np.log1p(np.bincount(slots, minlength=WORD_DIM)) / (1 + np.log1p(len(words)))
        n, raw = len(text), text.encode("utf-8", "surrogatepass")
        row[-SIZE_DIM:] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, linked, i / len(page), min(1, len(page) / 100),
            (text.count(".") + text.count(",")) / (1 + len(words)), (len(raw) - len(raw.translate(None, LARGE))) / (1 + n),
            float(text[-1] in ".!?"), float(n < 30), min(len(path), 12) / 12,
        )
    return out


class Lstm:
    """A bidirectional LSTM with a logistic output per step, trained by backpropagation through time and Adam."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {f"{k}{d}": v for d in "fb" for k, v in (("x", scale(DIM, 4 * HIDDEN)), ("h", scale(HIDDEN, 4 * HIDDEN)), ("b", np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)))}
        self.w |= {"o": scale(2 * HIDDEN + DIM, 1), "c": np.zeros(1, np.float32)}

    @staticmethod
    def _sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """One direction over (steps, pages, features); masked steps leave the state as it is."""
        steps, pages, _ = x.shape
        gates = x.reshape(-1, DIM) @ self.w["x" + d] + self.w["b" + d]
        gates = gates.reshape(steps, pages, -1)
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = gates[t] + h @ self.w["h" + d]
            s = self._sigmoid(g[:, : 3 * HIDDEN])
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * u
            y = np.tanh(c2)
            h2 = o * y
            if keep:
                tape.append((t, h, c, i, f, o, u, y, m))
            h, c = np.where(m, h2, h), np.where(m, c2, c)
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tape_f = self._run(x, mask, "f", keep)
        b, tape_b = self._run(x, mask, "b", keep)
        both = np.concatenate((f, b, x), axis=2)
        return self._sigmoid((both @ self.w["o"])[:, :, 0] + self.w["c"]), both, (tape_f, tape_b)

    def _back(self, x, grad_h, tape, d, grads):
        pages = x.shape[1]
        dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        dg_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        for t, h, c, i, f, o, u, y, m in reversed(tape):
            dh = dh + grad_h[t]
            live, dlive = dh * m, dc * m
            dcy = dlive + live * o * (1 - y * y)
            dg = np.concatenate((dcy * u * i * (1 - i), dcy * c * f * (1 - f), live * y * o * (1 - o), dcy * i * (1 - u * u)), axis=1)
            grads["h" + d] += h.T @ dg
            dg_all[t] = dg
            dh = dg @ self.w["h" + d].T + dh * ~m
            dc = dcy * f + dc * ~m
        flat = dg_all.reshape(-1, 4 * HIDDEN)
        grads["x" + d] += x.reshape(-1, DIM).T @ flat
        grads["b" + d] += flat.sum(axis=0)

    def step(self, x, mask, target, adam, rate):
        p, both, (tape_f, tape_b) = self.forward(x, mask, True)
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        d = ((p - target) * mask / max(1, mask.sum()))[:, :, None].astype(np.float32)
        grads["o"] += both.reshape(-1, both.shape[2]).T @ d.reshape(-1, 1)
        grads["c"] += d.sum()
        g = d @ self.w["o"].T
        self._back(x, g[:, :, :HIDDEN], tape_f, "f", grads)
        self._back(x, g[:, :, HIDDEN : 2 * HIDDEN], tape_b, "b", grads)
        adam["n"] += 1
        for k, v in grads.items():
            a, b = adam.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
            a, b = 0.9 * a + 0.1 * v, 0.999 * b + 0.001 * v * v
            adam[k] = (a, b)
            self.w[k] -= (rate * (a / (1 - 0.9 ** adam["n"])) / (np.sqrt(b / (1 - 0.999 ** adam["n"])) + 1e-8)).astype(np.float32)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), DIM), np.float32), np.zeros((steps, len(pages)), bool)
    for j, v in enumerate(pages):
        x[: len(v), j], mask[: len(v), j] = v, True
    return x, mask


def label(model: Lstm, pages: list[np.ndarray], cells: int = 4096) -> list[np.ndarray]:
    """Probability of main text of each block; pages of like length are read together, ``cells`` steps at once."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * len(pages[order[j]]) <= cells:
            j += 1
        p, _, _ = model.forward(*_padded([pages[k] for k in order[i:j]]))
        for column, k in enumerate(order[i:j]):
            out[k] = p[: len(pages[k]), column]
        i = j
    return out


# Training pages. Words that say what a part of a page is; fixed values.
MENU = (
    "menu", "nav", "navigation", "navbar", "topnav", "breadcrumbs", "breadcrumb", "pagination", "pager", "tabs",
    "skip", "toc",
)
HEAD = (
    "header", "masthead", "banner", "topbar", "branding", "logo", "site-header",
)
FOOT = (
    "footer", "site-footer", "bottom", "colophon", "copyright", "legal",
)
SIDE = (
    "sidebar", "side", "related", "widget", "rail", "recommended", "popular", "trending", "more-links", "secondary",
    "tags",
)
NOTICE = (
    "cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "banner-message", "paywall",
    "dialog", "toast",
)
AD = (
    "ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "banner-ad", "adsense", "commercial",
    "teaser-ad",
)
FORM = (
    "search", "newsletter", "subscribe", "signup", "login", "form", "contact-form",
)
COMMENT = (
    "comments", "comment", "discussion", "replies", "reply", "responses", "disqus", "comment-list",
)
SHARE = (
    "share", "social", "sharing", "follow-us",
)
MAIN = (
    "content", "main", "article", "post", "entry", "story", "body", "text", "article-body", "post-content", "page",
    "main-content",
)
PHRASES = {
    "menu": (
        "Home", "About us", "Contact", "News", "Products", "Services", "Login", "Archive", "Next page", "Previous",
        "Shop", "Blog", "FAQ", "Start", "Kontakt", "Accueil", "Inicio",
    ),
    "notice": (
        "We use cookies to improve your experience.", "Accept all", "This site uses cookies.",
        "Please enable JavaScript.", "You have 3 free articles left.",
        "By continuing you agree to our privacy policy.",
    ),
    "foot": (
        "All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Copyright 2021", "© 2023",
        "Powered by", "Cookie settings",
    ),
    "form": (
        "Your name", "E-mail", "Subscribe", "Search", "Send", "Sign up for our newsletter", "Password", "Submit",
    ),
    "ad": (
        "Buy now", "Advertisement", "Sponsored", "Shop today and save", "Click here", "Special offer",
    ),
    "side": (
        "Related articles", "Most read", "Read more", "Tags", "Popular posts", "Follow us", "See also", "Newsletter",
    ),
    "comment": (
        "Reply", "Great post!", "Thanks for sharing", "I disagree with this", "Posted by", "2 hours ago",
        "Leave a comment", "3 comments",
    ),
    "share": (
        "Share", "Tweet", "Print", "E-mail this", "Like", "Pin it",
    ),
}


#: Words of which half of the invented pages are made, so that known words do not mark a block as one that is not main text.
COMMON = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "his", "they", "at",
    "be", "this", "have", "from", "or", "one", "had", "by", "word", "but", "not", "what", "all", "were", "we",
    "when", "your", "can", "said", "there", "use", "an", "each", "which", "she", "do", "how", "their", "if", "will",
    "up", "other", "about", "out", "many", "then", "them", "these", "so", "some", "her", "would", "make", "like",
    "him", "into", "time", "has", "look", "two", "more", "write", "go", "see", "number", "no", "way", "could",
    "people", "my", "than", "first", "water", "been", "call", "who", "oil", "its", "now", "find", "long", "down",
    "day", "did", "get", "come", "made", "may", "part", "hello", "world", "le", "la", "les", "des", "et", "est",
    "une", "pour", "dans", "que", "qui", "sur", "pas", "plus", "avec", "sont", "der", "die", "das", "und", "ist",
    "nicht", "ein", "eine", "mit", "auf", "für", "von", "sich", "auch", "el", "los", "las", "una", "por", "con",
    "para", "más", "como", "pero", "sus", "este",
)


class _Page:
    """Invents one page; ``labels`` follows the blocks in page order.

    ``named`` pages tell by classes and ids what their parts are. On others these are missing or mean
    nothing, and parts that are not main text are links or known phrases.
    """

    def __init__(self, rng: random.Random):
        self.r, self.labels, self.out = rng, [], []
        self.syllables = ["".join(rng.choices("aeiounrstlhdcmpgbvwkfyzqxéèüäößñçó", k=rng.randint(1, 4))) for _ in range(40)]
        self.named = rng.random() < 0.75
        self.common = rng.choice([0.0, 0.0, 0.5, 0.9])

    def words(self, n: int) -> str:
        r, out = self.r, []
        if r.random() < 0.01:  # one word over and over
            return " ".join([r.choice(self.syllables).capitalize()] * n * r.choice([1, 1, 20]))
        for _ in range(n):
            w = r.choice(COMMON) if r.random() < self.common else "".join(r.choices(self.syllables, k=r.randint(1, 4)))
            out.append(w + r.choices(["", ",", ".", "!", " &amp;", "###"], [80, 7, 9, 1, 1, 1])[0])
        text = (" | " if r.random() < 0.04 else " ").join(out).strip()
        return (text[:1].upper() + text[1:] + "." * (r.random() < 0.7)) or "A"

    def put(self, html: str) -> None:
        self.out.append(html)

    def leaf(self, tag: str, text: str, main: bool, attrs: str = "", end: bool = True) -> None:
        self.labels.append(main)
        self.put(f"<{tag}{attrs}>{text}" + f"</{tag}>" * end)

    def mark(self, names: list[str], p: float = 0.85) -> str:
        if not self.named:
            name = self.r.choice(["x", "a", "row", "col", "css-" + "".join(self.r.choices("abcdefgh0123456789", k=6)), "sc-" + "".join(self.r.choices("abcdefgh", k=5))])
            return self.r.choice(["", "", f' class="{name}"', f" class='{name}'"])
        if self.r.random() > p:
            return ""
        name = self.r.choice(names) + self.r.choice(["", "", "", "-wrap", "-inner", "_box", "-1", " block", " clearfix"])
        return f' {self.r.choice(["class", "class", "class", "id"])}="{name}"'

    def phrase(self, kind: str, p: float, n: int) -> str:
        """A phrase of its kind, or words on pages that name their parts."""
        return self.r.choice(PHRASES[kind]) if not self.named or self.r.random() < p else self.words(n)

    def junk(self, kind: str, n: int) -> list[str]:
        return [self.r.choice(PHRASES[kind]) if self.r.random() < 0.5 else self.words(self.r.randint(1, 6)) for _ in range(n)]

    def links(self, kind: str, n: int) -> None:
        self.put("<ul>")
        for x in self.junk(kind, n):
            self.leaf("li", f'<a href="/{self.r.randint(1, 999)}">{x}</a>', False)
        self.put("</ul>")

    def menu(self) -> None:
        tag = self.r.choice(["nav", "nav", "div", "header", "ul"])
        self.put(f"<{tag}{self.mark(MENU, 0.5 if tag == 'nav' else 1)}>")
        if self.r.random() < 0.8:
            self.links("menu", self.r.randint(2, 9))
        else:
            self.leaf("div", " | ".join(f'<a href="#">{x}</a>' for x in self.junk("menu", self.r.randint(2, 7))), False)
        self.put(f"</{tag}>")

    def head(self) -> None:
        tag = self.r.choice(["header", "header", "div"])
        self.put(f"<{tag}{self.mark(HEAD, 0.5 if tag == 'header' else 1)}>")
        self.leaf(self.r.choice(["h1", "div", "p"]) if self.r.random() < 0.6 else "p", self.words(self.r.randint(1, 8)), False)
        if self.r.random() < 0.5:
            self.leaf("p", self.words(self.r.randint(3, 10)), False)
        if self.r.random() < 0.4:
            self.menu()
        self.put(f"</{tag}>")

    def foot(self) -> None:
        tag = self.r.choice(["footer", "footer", "footer", "div"])
        self.put(f"<{tag}{self.mark(FOOT, 0.4 if tag == 'footer' else 1)}>")
        k = self.r.random()
        if k < 0.35:
            self.labels.append(False)
            self.put(f"&copy; {self.words(2)} &middot; {self.words(self.r.randint(2, 15))}")
        elif k < 0.7:
            self.leaf("p", "&copy; " + self.words(self.r.randint(2, 30)), False)
        else:
            self.links("foot", self.r.randint(2, 8))
            self.leaf("p", self.r.choice(PHRASES["foot"]), False)
        self.put(f"</{tag}>")

    def box(self, kind: str, names: list[str], tags: list[str]) -> None:
        """A part that is not main text: an advert, a notice, a form, a side column, comments."""
        tag = self.r.choice(tags)
        plain = {"aside": 0.5, "form": 0.4}.get(tag, 1)
        role = {"notice": ' role="dialog"', "form": ' role="search"', "side": ' role="complementary"'}.get(kind, "") if self.r.random() < 0.2 else ""
        self.put(f"<{tag}{self.mark(names, plain)}{role}>")
        if kind == "form":
            for x in self.junk("form", self.r.randint(1, 4)):
                self.leaf(self.r.choice(["p", "div", "legend"]), f'<label>{x}</label> <input name="x">', False)
            self.leaf("button", self.r.choice(PHRASES["form"]), False)
        elif kind == "comment":
            if self.r.random() < 0.6:
                self.leaf(self.r.choice(["h2", "h3"]), self.junk("comment", 1)[0], False)
            inner = self.r.choice(["li", "div", "article"])
            self.put("<ol>" if inner == "li" else "")
            for _ in range(self.r.randint(1, 7)):
                self.put(f"<{inner}{self.mark(['comment', 'comment-body', 'reply', 'response'], 0.6)}>")
                if self.r.random() < 0.6:
                    self.leaf("div", self.words(2), False, self.mark(["author", "meta", "by"], 0.7))
                for _ in range(self.r.randint(1, 2)):
                    self.leaf("p", self.r.choice(PHRASES["comment"]) if self.r.random() < 0.2 else self.words(self.r.randint(3, 60)), False)
                self.put(f"</{inner}>")
            self.put("</ol>" if inner == "li" else "")
        elif kind == "side" and self.r.random() < 0.7:
            if self.r.random() < 0.7:
                self.leaf(self.r.choice(["h2", "h3", "h4"]), self.junk("side", 1)[0], False)
            if self.r.random() < 0.7:
                self.links("side", self.r.randint(2, 8))
            else:
                for _ in range(self.r.randint(1, 3)):
                    self.leaf("p", self.phrase("side", 0, self.r.randint(5, 40)), False)
        elif self.r.random() < 0.5:
            self.labels.append(False)
            self.put(self.phrase(kind, 0.3, self.r.randint(2, 30)))
        else:
            for _ in range(self.r.randint(1, 3)):
                self.leaf(self.r.choice(["p", "div", "h4"]), self.phrase(kind, 0.4, self.r.randint(2, 30)), False)
        self.put(f"</{tag}>")

    def insert(self) -> None:
        k = self.r.random()
        if k < 0.45:
            self.box("ad", AD, ["div", "div", "aside", "section"])
        elif k < 0.65:
            self.box("side", SIDE, ["aside", "div"])
        elif k < 0.8:
            self.box("share", SHARE, ["div", "ul"])
        elif k < 0.9:
            self.box("form", FORM, ["form", "form", "div"])
        else:
            self.box("notice", NOTICE, ["div", "div", "section"])

    def main(self) -> None:
        r = self.r
        outer = r.choice(["article", "article", "article", "main", "div", "section"])
        self.put(f"<{outer}{self.mark(MAIN, 0.35 if outer in ('article', 'main') else 0.9)}>")
        if outer in ("main", "div") and r.random() < 0.3:
            self.put("<article>")
        inner_header = r.random() < 0.15
        self.put("<header>" * inner_header)
        if r.random() < 0.85:
            self.leaf("h1", self.words(r.randint(2, 12)), True)
        self.put("</header>" * inner_header)
        for _ in range(r.randint(1, 14) if r.random() < 0.9 else r.randint(15, 60)):
            k, n = r.random(), max(1, int(r.lognormvariate(3, 1.1)))
            if k < 0.6:
                self.leaf("p", self.words(n), True, end=r.random() < 0.8)
            elif k < 0.72:
                self.leaf("p", "<b>" + self.words(n) + r.choice(["<br>", "</b>", "<br/>", ""]), True, end=False)
            elif k < 0.78:
                self.leaf(r.choice(["h2", "h3"]), self.words(r.randint(1, 8)), True)
            elif k < 0.84:
                tag = r.choice(["ul", "ol"])
                self.put(f"<{tag}>")
                for _ in range(r.randint(1, 6)):
                    self.leaf("li", self.words(r.randint(1, 20)), True, end=r.random() < 0.8)
                self.put(f"</{tag}>")
            elif k < 0.87:
                self.put("<blockquote>")
                self.leaf("p", self.words(n), True)
                self.put("</blockquote>")
            elif k < 0.9:
                self.put("<table>")
                for _ in range(r.randint(1, 4)):
                    self.put("<tr>")
                    for _ in range(r.randint(1, 3)):
                        self.leaf("td", self.words(r.randint(1, 4)), True)
                    self.put("</tr>")
                self.put("</table>")
            elif k < 0.92:
                self.leaf("pre", self.words(n), True)
            elif k < 0.94:
                self.leaf("div", self.words(n), True)
            else:
                self.insert()
        self.put("<p></p>" * (r.random() < 0.1))
        self.put(f"</{outer}>")

    def note(self) -> None:
        """A line that its words alone tell from main text."""
        kind = self.r.choice(["notice", "notice", "foot", "foot", "form", "ad"])
        text = " ".join(self.r.sample(PHRASES[kind], self.r.randint(1, 2)))
        self.leaf(self.r.choice(["div", "p", "div", "footer" if kind == "foot" else "p"]), text, False, self.mark([]) if not self.named else "")

    def text(self) -> None:
        r = self.r
        if r.random() < 0.6:
            self.leaf(r.choice(["h1", "h1", "h2"]), self.words(r.randint(1, 9)), True)
        for _ in range(r.randint(1, 9)):
            if r.random() < 0.12:
                self.leaf(r.choice(["h2", "h3"]), self.words(r.randint(1, 6)), True)
            self.leaf(r.choice(["p", "p", "p", "p", "div", "blockquote"]), self.words(max(2, int(r.lognormvariate(3, 1)))), True, end=True)
            if r.random() < 0.12:
                self.listing()
        for _ in range(r.choice([0, 0, 1, 1, 2])):  # short last paragraphs
            words = self.words(r.randint(1, 3))
            self.leaf("p", words if r.random() < 0.5 else words.lower().rstrip("."), True)

    def listing(self) -> None:
        """Code, terms with their meanings, or a list in the text."""
        r, kind = self.r, self.r.choice(["pre", "dl", "ul", "ol"])
        if kind == "pre":
            self.leaf("pre", self.words(r.randint(1, 30)), True)
            return
        self.put(f"<{kind}>")
        for _ in range(r.randint(1, 5)):
            for tag in ("dt", "dd") if kind == "dl" else ("li",):
                self.leaf(tag, self.words(r.randint(1, 3 if tag == "dt" else 15)), True)
        self.put(f"</{kind}>")

    def manual(self) -> None:
        """Documentation: a table of contents beside the text in one wrapper, by name or by its links alone."""
        r = self.r
        self.put(f"<div{self.mark(['wrapper', 'container', 'layout', 'page', 'row'])}>")
        if r.random() < 0.85:
            tag = r.choice(["div", "div", "nav", "aside"])
            self.put(f"<{tag}{self.mark(['toc', 'contents', 'table-of-contents', 'sidebar', 'nav', 'docs-nav'])}>")
            self.links("menu", r.randint(2, 9))
            self.put(f"</{tag}>")
        self.put(f"<div{self.mark(['doc', 'docs', 'document', 'markdown-body', 'content', 'section', 'rst-content'])}>")
        for _ in range(r.randint(1, 4)):
            self.leaf(r.choice(["h1", "h2", "h2", "h3"]), self.words(r.randint(1, 4)), True)
            for _ in range(r.randint(0, 3)):
                self.leaf("p", self.words(max(1, int(r.lognormvariate(2.3, 1)))), True)
            if r.random() < 0.6:
                self.listing()
        self.put("</div></div>")

    def plain(self) -> None:
        """A page without named parts: bare paragraphs, wrappers that mean nothing, tables that lay out."""
        r = self.r
        shape = r.choice(["bare", "bare", "wrapped", "wrapped", "table", "semantic"])
        if r.random() < 0.15:
            self.note()
        if r.random() < 0.2:
            self.manual()
        elif shape == "table":
            self.put("<table><tr>")
            if r.random() < 0.6:
                self.leaf("td", "<br>".join(f'<a href="#">{x}</a>' for x in self.junk("menu", r.randint(2, 7))), False)
            else:
                self.put("<td>")
                self.links("menu", r.randint(2, 7))
                self.put("</td>")
            self.put("<td>")
            self.text()
            self.put("</td></tr></table>")
        else:
            if r.random() < 0.5:
                self.put("<nav>" if shape == "semantic" else f"<div{self.mark([])}>" if shape == "wrapped" else "")
                if r.random() < 0.7:
                    self.links("menu", r.randint(2, 7))
                else:
                    self.leaf("p", r.choice([" | ", " ", " &middot; "]).join(f'<a href="#">{x}</a>' for x in self.junk("menu", r.randint(2, 7))), False)
                self.put("</nav>" if shape == "semantic" else "</div>" if shape == "wrapped" else "")
            self.put({"bare": "", "wrapped": f"<div{self.mark([])}>" * 2, "semantic": "<main>"}[shape])
            self.text()
            self.put({"bare": "", "wrapped": "</div></div>", "semantic": "</main>"}[shape])
        if r.random() < 0.4:
            self.note()

    def build(self) -> tuple[str, list[bool]]:
        r = self.r
        if r.random() < 0.25:
            self.named = False
            head = r.choice(["", "<html><body>", "<!doctype html><title>" + self.words(3) + "</title>"])
            self.put(head)
            if r.random() < 0.2:
                self.leaf(r.choice(["p", "p", "div", "h1", "td"]), self.words(r.randint(1, 12)), True, self.mark([]))
            else:
                self.plain()
            return "".join(self.out), self.labels
        self.put("<!DOCTYPE html><html><head><meta charset=utf-8><title>" + self.words(4) + "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
        for f, p in ((self.head, 0.35 * self.named), (self.menu, 0.8)):
            if r.random() < p:
                f()
        for p in (0.35, 0.15):
            if r.random() < p:
                self.insert()
        if r.random() < 0.4:
            self.box("ad", AD, ["div"])
        self.manual() if r.random() < 0.1 else self.main()
        if r.random() < 0.25 and self.named:
            self.box("comment", COMMENT, ["section", "div"])
        for p in (0.3, 0.1):
            if r.random() < p:
                self.insert()
        if r.random() < 0.85:
            self.foot()
        self.put("</body></html>" * (r.random() < 0.9))
        return "".join(self.out), self.labels


def training_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    return [_Page(random.Random(seed * 1_000_003 + i)).build() for i in range(n)]


@lru_cache(1)
def trained(n: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Lstm:
    """The model, fitted on ``n`` invented pages."""
    data = []
    for page, labels in training_pages(n, seed):
        cut = blocks(page)
        if len(cut) == len(labels):
            data.append((_vectors(cut), np.array(labels, np.float32)))
    model, adam, rng = Lstm(seed), {"n": 0}, random.Random(seed)
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i: (len(data[i][1]) // 8, rng.random()))
        batches = [order[i : i + 16] for i in range(0, len(order), 16)]
        rng.shuffle(batches)
        for batch in batches:
            x, mask = _padded([data[i][0] for i in batch])
            target = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(batch):
                target[: len(data[i][1]), j] = data[i][1]
            model.step(x, mask, target, adam, 0.01 * (1 - epoch / (epochs + 1)))
    return model


def main_text(model: Lstm, pages: list[str]) -> list[str]:
    cut = [blocks(p) for p in pages]
    found = label(model, [_vectors(c) for c in cut])
    return ["\n".join(text for (_, text, _), p in zip(c, ps) if p >= 0.5) for c, ps in zip(cut, found)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per input row, without a shuffle.

    Null html is empty; a page without main text gives the empty text. White space inside a block
    becomes one space, ``<br>`` included; blocks are joined by a line feed. The model's weights, of
    fixed size, are sent to the workers.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained().w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lstm()
        model.w = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = main_text(model, [x or "" for x in part.column(2).to_pylist()])
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
