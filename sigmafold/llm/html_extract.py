"""Main text of web pages: a recurrent block labeller.

A bidirectional LSTM in numpy reads a page as its sequence of text blocks.  Each block is a vector of
its tag path and its hashed words; the network sees the whole page before it decides on any block.
It is trained here, on pages made from the grammar below.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmafold.llm.html_blocks import PATH_BUCKETS, WORD_BUCKETS, blocks, bucket
from sigmafold.llm.token_ids import slices

HIDDEN_UNITS = 16
FEATURES = PATH_BUCKETS + WORD_BUCKETS + 6
TRAINING_PAGES, EPOCHS, BATCH, RATE = 1200, 5, 48, 0.01
SEED = 11
#: Blocks that are labelled together: pages in a batch times the longest of them.  A page of more blocks goes through the network in parts.
BATCH_BLOCKS = 8192
#: Bytes of pages that are taken together.
GROUP_BYTES = 1 << 22


# --- blocks as vectors ---------------------------------------------------------------------------


def vectors(page: list[tuple[tuple[str, ...], str, int]], start: int = 0, stop: int | None = None):
    """One row of features per block, for the blocks ``start`` to ``stop`` of the page."""
    stop = len(page) if stop is None else min(stop, len(page))
    out = np.zeros((stop - start, FEATURES), np.float32)
    for i in range(start, stop):
        path, text, linked = page[i]
        row = out[i - start]
        for token in path:
            row[bucket(token, PATH_BUCKETS)] = 1.0
        words = text.lower().split()
        counts = np.bincount([bucket(w.strip(".,;:!?"), WORD_BUCKETS) for w in words], minlength=WORD_BUCKETS)
        row[PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = counts / np.sqrt((counts**2).sum())
        row[-6:] = (np.log1p(len(words)) / 4, np.log1p(len(text)) / 6, min(1.0, linked / len(text)), text[-1] in ".!?", i / len(page), i == 0)
    return out


def _rows(page, start: int = 0, stop: int | None = None):
    """Vectors of a page's blocks, which may be made already."""
    return page[start:stop] if isinstance(page, np.ndarray) else vectors(page, start, stop)


# --- the network ---------------------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x, mask, w, u, b, trace=None, state=None):
    """Hidden states (time, page, unit) of one direction; where mask is 0 the state stays.  ``state`` holds the cells before, and then after."""
    steps, pages, _ = x.shape
    h, c = state if state else (np.zeros((pages, HIDDEN_UNITS), np.float32) for _ in range(2))
    out = np.zeros((steps, pages, HIDDEN_UNITS), np.float32)
    given = x @ w + b
    n = HIDDEN_UNITS
    for t in range(steps):
        z = given[t] + h @ u
        i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n] + 1), _sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
        m = mask[t][:, None]
        new_c = f * c + i * g
        squashed = np.tanh(new_c)
        if trace is not None:
            trace.append((h, c, i, f, o, g, squashed, m))
        h, c = m * (o * squashed) + (1 - m) * h, m * new_c + (1 - m) * c
        out[t] = h
    if state is not None:
        state[:] = h, c
    return out


def _back(x, w, u, trace, d_out):
    """Gradients of w, u and b from those of the hidden states."""
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], np.float32)
    dh = np.zeros((x.shape[1], HIDDEN_UNITS), np.float32)
    dc = np.zeros_like(dh)
    for t in reversed(range(len(trace))):
        h, c, i, f, o, g, squashed, m = trace[t]
        dh = dh + d_out[t]
        d_new, d_cell = dh * m, dc * m + dh * m * o * (1 - squashed**2)
        dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), d_new * squashed * o * (1 - o), d_cell * i * (1 - g**2)], 1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dh = dz @ u.T + dh * (1 - m)
        dc = d_cell * f + dc * (1 - m)
    return dw, du, db


class BlockLabeller:
    """Weights of both directions and of the output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def matrix(rows, columns):
            return (rng.standard_normal((rows, columns)) / np.sqrt(rows)).astype(np.float32)

        n = HIDDEN_UNITS
        self.weights = [m for _ in range(2) for m in (matrix(FEATURES, 4 * n), matrix(n, 4 * n), np.zeros(4 * n, np.float32))]
        self.weights += [matrix(2 * n, 1), np.zeros(1, np.float32)]

    def logits(self, x, mask, traces=None):
        forward, backward = (None, None) if traces is None else traces
        a = _run(x, mask, *self.weights[:3], forward)
        b = _run(x[::-1], mask[::-1], *self.weights[3:6], backward)[::-1]
        both = np.concatenate([a, b], 2)
        return (both @ self.weights[6] + self.weights[7])[..., 0], both

    def step(self, x, mask, y):
        """Gradients of the mean cross-entropy over one batch."""
        traces = [], []
        z, both = self.logits(x, mask, traces)
        d = (_sigmoid(z) - y) * mask / mask.sum()
        flat = both.reshape(-1, both.shape[2])
        d_both = d[..., None] * self.weights[6][:, 0]
        n = HIDDEN_UNITS
        first = _back(x, self.weights[0], self.weights[1], traces[0], d_both[..., :n])
        second = _back(x[::-1], self.weights[3], self.weights[4], traces[1], d_both[::-1, :, n:])
        return [*first, *second, flat.T @ d.reshape(-1, 1), d.sum(keepdims=True)[0]]

    def label(self, pages: list) -> list:
        """For each page (a list of blocks, see ``vectors``), which of them are main text."""
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        out, at = [None] * len(pages), 0
        while at < len(order):
            if len(pages[order[at]]) > BATCH_BLOCKS:
                out[order[at]] = self._label_long(pages[order[at]])
                at += 1
                continue
            to = at + 1
            while to < len(order) and len(pages[order[to]]) * (to - at + 1) <= BATCH_BLOCKS:
                to += 1
            x, mask = _padded([_rows(pages[k]) for k in order[at:to]])
            z, _ = self.logits(x, mask)
            for j, k in enumerate(order[at:to]):
                out[k] = z[: len(pages[k]), j] > 0
            at = to
        return out

    def _label_long(self, page: list):
        """The same for one page in parts: each direction carries its cells on, so every block still sees the whole page."""
        n, parts = HIDDEN_UNITS, list(range(0, len(page), BATCH_BLOCKS))
        z = np.full(len(page), self.weights[7][0], np.float32)
        for side in (0, 1):
            state = []
            for at in reversed(parts) if side else parts:
                x = _rows(page, at, at + BATCH_BLOCKS)[:, None]
                x = x[::-1] if side else x
                h = _run(x, np.ones((len(x), 1), np.float32), *self.weights[3 * side : 3 * side + 3], state=state)[:, 0]
                z[at : at + len(x)] += (h[::-1] if side else h) @ self.weights[6][n * side : n * (side + 1), 0]
        return z > 0


def _padded(pages: list):
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), FEATURES), np.float32)
    mask = np.zeros((longest, len(pages)), np.float32)
    for j, page in enumerate(pages):
        x[: len(page), j] = page
        mask[: len(page), j] = 1
    return x, mask


# --- training pages ------------------------------------------------------------------------------

#: Words of page furniture in four languages, for the grammar alone.
_FURNITURE = (
    "home about contact login register search subscribe newsletter cookies accept privacy terms imprint copyright rights reserved share follow "
    "related reply comments sponsored advertisement menu next previous read more startseite kontakt anmelden datenschutz impressum suche accueil "
    "connexion rechercher mentions inicio contacto buscar aviso legal"
).split()
_MAIN_NAMES = ("content", "post", "entry", "article body", "story", "text", "main", "page")
_OUTSIDE = {
    "menu": (("nav", "div", "ul", "header"), ("nav", "menu", "navbar", "navigation", "topbar", "breadcrumb")),
    "header": (("header", "div"), ("header", "masthead", "branding", "top", "logo")),
    "footer": (("footer", "div"), ("footer", "bottom", "copyright", "legal")),
    "side": (("aside", "div"), ("sidebar", "side", "widget", "related", "recommended", "trending", "tags")),
    "notice": (("div", "section", "dialog", "aside"), ("notice", "cookie", "consent", "banner", "alert", "popup", "modal", "newsletter", "paywall")),
    "advert": (("div", "aside", "section", "ins"), ("ad", "ads", "advert", "promo", "sponsor", "sponsored", "banner ad")),
    "form": (("form", "div"), ("form", "search", "login", "signup", "subscribe")),
    "comments": (("section", "div", "ol", "ul"), ("comments", "comment", "replies", "discussion", "respond", "commentlist")),
    "share": (("div", "ul"), ("share", "social", "follow", "buttons")),
}
_SYLLABLES = "an ar be ca de el en er es fi ga he in is ka la le ma mi na ne on or pa que re ri sa se ta te ti to tion un ver vi wa zu".split()


class _Grammar:
    def __init__(self, rng):
        self.rng = rng

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def prose(self, low: int, high: int) -> str:
        words = ["".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 5)))) for _ in range(int(self.rng.integers(low, high)))]
        style = self.rng.random()
        if style < 0.1:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.2:
            words = [w + self.pick(("$$$", "###", "&amp;&amp;", "***")) for w in words]
        elif style < 0.25:
            words = " | ".join(words).split()
        return " ".join(words).capitalize() + self.pick((".", ".", ".", "!", "?", ""))

    def phrase(self) -> str:
        if self.rng.random() < 0.6:
            return " ".join(self.pick(_FURNITURE) for _ in range(int(self.rng.integers(1, 4)))).capitalize()
        return self.prose(1, 4)

    def wrap(self, tag: str, names: str, inner: str) -> str:
        attribute = f' {self.pick(("class", "id"))}="{names}"' if names else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def outside(self, kind: str) -> str:
        tags, names = _OUTSIDE[kind]
        tag = self.pick(tags)
        named = self.pick(names) if tag in ("div", "section", "ul", "ol", "ins") or self.rng.random() < 0.6 else ""
        if named and self.rng.random() < 0.3:
            named = f"{self.pick(('site', 'page', 'main', 'x', 'block'))}-{named}"
        items = range(int(self.rng.integers(1, 7)))
        if kind in ("menu", "share") or kind in ("side", "footer") and self.rng.random() < 0.5:
            links = [f'<a href="/{i}">{self.phrase()}</a>' for i in items]
            inner = "".join(f"<li>{x}</li>" for x in links) if self.rng.random() < 0.8 else " ".join(links)
            return self.wrap(tag, named, inner if tag in ("ul", "ol") or "<li>" not in inner else f"<ul>{inner}</ul>")
        if kind == "form":
            return self.wrap(tag, named, "".join(f"<label>{self.phrase()}</label><input name=x>" for _ in items) + f"<button>{self.phrase()}</button>")
        if kind == "comments":
            inner = "".join(self.wrap(self.pick(("div", "li", "article", "p")), self.pick(("comment", "reply", "comment body", "")), f"<b>{self.prose(1, 3)}</b><p>{self.prose(3, 40)}</p>") for _ in items)
            return self.wrap(tag, named or "comments", f"<h3>{self.phrase()}</h3>" + inner)
        body = self.prose(3, 30)
        if kind == "footer":
            body = f"&copy; {self.pick(('', '2019 '))}{self.phrase()} &middot; {body}"
        return self.wrap(tag, named, self.pick((body, f"<p>{body}</p>", f"<h3>{self.phrase()}</h3><p>{body}</p>", f"<h2>{self.phrase()}</h2>{body}")))

    def main(self) -> str:
        parts = [f"<h1>{self.prose(2, 10)}</h1>"] if self.rng.random() < 0.85 else []
        for _ in range(int(self.rng.integers(1, 14))):
            x = self.rng.random()
            body = self.prose(1, 60)
            if x < 0.6:
                parts.append(f"<p>{body}</p>")
            elif x < 0.7:
                parts.append(f"<p><b>{body}<br>")
            elif x < 0.78:
                parts.append(self.wrap(self.pick(("h2", "h3", "h4")), "", self.prose(1, 6)))
            elif x < 0.85:
                parts.append("<ul>" + "".join(f"<li>{self.prose(1, 14)}</li>" for _ in range(int(self.rng.integers(1, 5)))) + "</ul>")
            elif x < 0.89:
                parts.append(f"<blockquote>{body}</blockquote>")
            elif x < 0.92:
                parts.append(f"<table><tr><td>{self.prose(1, 5)}</td><td>{self.prose(1, 5)}</td></tr></table>")
            elif x < 0.95:
                parts.append(f'<p>{body} <a href="/y">{self.prose(1, 4)}</a></p>')
            else:
                parts.append(f"<div>{body}</div>")
        return "".join(parts)

    def page(self) -> list[tuple[str, bool]]:
        """Pieces of markup in page order, with whether their text is main text."""
        some = lambda kinds, p: [k for k in kinds if self.rng.random() < p]
        before = some(("menu", "header", "notice", "advert", "side", "form", "menu", "share"), 0.4)
        after = some(("side", "share", "comments", "advert", "form", "notice", "footer", "menu"), 0.4) + (["footer"] if self.rng.random() < 0.6 else [])
        self.rng.shuffle(before)
        inner = some(("advert", "share", "side", "notice", "form"), 0.08)
        x = self.rng.random()
        if x < 0.55:
            opening, closing = "<article>", "</article>"
        elif x < 0.7:
            opening, closing = "<main>", "</main>"
        elif x < 0.8:
            opening, closing = f'<article class="{self.pick(_MAIN_NAMES)}">', "</article>"
        else:
            opening, closing = f'<div {self.pick(("class", "id"))}="{self.pick(_MAIN_NAMES)}">', "</div>"
        if self.rng.random() < 0.15:
            closing = ""
            after = []
        pieces = [("<html><body>", False)] + [(self.outside(k), False) for k in before] + [(opening, True)]
        for k in [None, *inner]:
            if k:
                pieces.append((self.outside(k), False))
            pieces.append((self.main(), True))
        return pieces + [(closing, True)] + [(self.outside(k), False) for k in after]


def training_page(rng):
    """Block vectors and labels of one page of the grammar."""
    pieces = _Grammar(rng).page()
    # A mark in front of every text says what it is; it is taken off before the features are made.
    marked = "".join(re.sub(r">([^<]+)", lambda m, k=main: f">{'M' if k else 'N'}\x01{m[1]}", markup) for markup, main in pieces)
    page, labels = [], []
    for path, text, linked in blocks(marked):
        labels.append(text[0] == "M")
        clean = " ".join(re.sub(r"[MN]\x01", "", text).split())
        page.append((path, clean or "x", linked))
    return vectors(page), np.array(labels, np.float32)


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> BlockLabeller:
    """A labeller trained by Adam on ``pages`` pages of the grammar; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    data = [d for d in (training_page(rng) for _ in range(pages)) if len(d[0])]
    model = BlockLabeller(seed)
    first = [np.zeros_like(w) for w in model.weights]
    second = [np.zeros_like(w) for w in model.weights]
    count = 0
    for epoch in range(EPOCHS):
        order = sorted(rng.permutation(len(data)), key=lambda k: len(data[k][0]) // 8)
        starts = list(range(0, len(order), BATCH))
        rng.shuffle(starts)
        for at in starts:
            chosen = order[at : at + BATCH]
            x, mask = _padded([data[k][0] for k in chosen])
            y = np.zeros_like(mask)
            for j, k in enumerate(chosen):
                y[: len(data[k][1]), j] = data[k][1]
            # Words and path parts are left out at random, so that no single one decides.
            x = x * (rng.random(x.shape) > 0.1)
            count += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for i, g in enumerate(model.step(x.astype(np.float32), mask, y)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                model.weights[i] = model.weights[i] - rate * (first[i] / (1 - 0.9**count)) / (np.sqrt(second[i] / (1 - 0.99**count)) + 1e-7)
    model.weights = [np.asarray(w, np.float32) for w in model.weights]
    return model


# --- the operator --------------------------------------------------------------------------------


def extract(pages: list[str | None], model: BlockLabeller) -> list[str]:
    """Main texts: the blocks labelled so, in page order, joined by line breaks."""
    found = [blocks(p or "") for p in pages]
    labels = iter(model.label([b for b in found if b]))
    return ["\n".join(text for (_, text, _), main in zip(b, next(labels)) if main) if b else "" for b in found]


def extract_text(pages: DataFrame, model: BlockLabeller, group: int = 256) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null or empty pages, and pages without main text, have an empty text; rows that repeat are
    treated alike; an empty table gives an empty result; extra columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, 2, group, GROUP_BYTES):
            texts = extract(part.column(2).to_pylist(), model)
            columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url"), F.col("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages; null and empty pages give an empty text."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), train())
