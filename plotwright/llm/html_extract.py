"""Main text of HTML pages by a recurrent block labeller.

Each page is a sequence of leaf blocks. A bidirectional LSTM in numpy reads a vector per block
(hashed tag path, hashed words, lengths and link share) and labels each block as main text or not
with the whole page as context. It is trained here, on pages that a seeded generator writes in
many layouts with known labels; no page of the input is needed for training.
"""

from __future__ import annotations

import random
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches
from .html_blocks import WIDTH, Block, blocks, vectors

HIDDEN, PAGES, EPOCHS, BATCH, RATE, SEED = 24, 2400, 12, 32, 0.01, 12
#: Written pages besides whose elements have long lists of classes.
DRESSED = 600
#: Blocks that are labelled at once.
LABEL_BLOCKS = 20_000
SCHEMA = "page_id long, url string, text string, n_chars long"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction of an LSTM over padded sequences (steps, pages, width)."""

    def __init__(self, width: int, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.p = {"w": (rng.standard_normal((width, 4 * hidden)) * (1 / width) ** 0.5).astype(np.float32), "u": (rng.standard_normal((hidden, 4 * hidden)) * (1 / hidden) ** 0.5).astype(np.float32), "b": np.zeros(4 * hidden, np.float32)}
        self.p["b"][hidden : 2 * hidden] = 1

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        steps, n, _ = x.shape
        k = self.hidden
        h = c = np.zeros((n, k), np.float32)
        out, tape = np.zeros((steps, n, k), np.float32), []
        z_in = x @ self.p["w"] + self.p["b"]
        for t in range(steps):
            z = z_in[t] + h @ self.p["u"]
            s = _sigmoid(z[:, : 3 * k])
            g = np.tanh(z[:, 3 * k :])
            i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
            m = mask[t][:, None]
            c_new = np.where(m, f * c + i * g, c)
            tc = np.tanh(c_new)
            h_new = np.where(m, o * tc, h)
            if keep:
                tape.append((h, c, i, f, o, g, tc, m))
            h, c = h_new, c_new
            out[t] = h
        return out, tape

    def backward(self, x: np.ndarray, tape: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        grad = {n: np.zeros_like(v) for n, v in self.p.items()}
        dh = dc = np.zeros_like(tape[0][0])
        for t in range(len(tape) - 1, -1, -1):
            h, c, i, f, o, g, tc, m = tape[t]
            d = dh + d_out[t]
            dcn = dc + np.where(m, d * o * (1 - tc * tc), 0)
            dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), d * tc * o * (1 - o), dcn * i * (1 - g * g)], 1) * m
            grad["w"] += x[t].T @ dz
            grad["u"] += h.T @ dz
            grad["b"] += dz.sum(0)
            dh = dz @ self.p["u"].T + np.where(m, 0, d)
            dc = np.where(m, dcn * f, dcn)
        return grad


class Labeller:
    """A bidirectional LSTM with one output per block."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.ways = [Lstm(width, hidden, rng), Lstm(width, hidden, rng)]
        self.top = {"v": (rng.standard_normal(2 * hidden) * 0.1).astype(np.float32), "a": np.zeros(1, np.float32)}

    @staticmethod
    def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]), np.float32)
        mask = np.zeros(x.shape[:2], bool)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, True
        return x, mask

    def _logits(self, x, mask, keep=False):
        ahead, tape = self.ways[0].forward(x, mask, keep)
        back, tape_back = self.ways[1].forward(x[::-1], mask[::-1], keep)
        both = np.concatenate([ahead, back[::-1]], 2)
        return both @ self.top["v"] + self.top["a"], both, tape, tape_back

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The chance of each block to be main text. Pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            part, longest = [], 0
            while order and (not part or max(longest, len(pages[order[-1]])) * (len(part) + 1) <= LABEL_BLOCKS):
                part.append(order.pop())
                longest = max(longest, len(pages[part[-1]]))
            z = self._logits(*self._pad([pages[k] for k in part]))[0]
            for col, k in enumerate(part):
                out[k] = _sigmoid(z[: len(pages[k]), col])
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> None:
        """Adam on the mean log loss of the blocks."""
        params = [*self.ways[0].p.items(), *self.ways[1].p.items(), *self.top.items()]
        first, second, step = [np.zeros_like(v) for _, v in params], [np.zeros_like(v) for _, v in params], 0
        rng = np.random.default_rng(seed)
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                x, mask = self._pad([pages[k] for k in part])
                y = np.zeros(mask.shape, np.float32)
                for col, k in enumerate(part):
                    y[: len(labels[k]), col] = labels[k]
                z, both, tape, tape_back = self._logits(x, mask, True)
                d = (_sigmoid(z) - y) * mask / mask.sum()
                k = self.ways[0].hidden
                d_both = d[..., None] * self.top["v"]
                g0 = self.ways[0].backward(x, tape, d_both[..., :k])
                g1 = self.ways[1].backward(x[::-1], tape_back, d_both[::-1, :, k:])
                grads = [*g0.values(), *g1.values(), np.einsum("tn,tnk->k", d, both), d.sum(keepdims=False).reshape(1)]
                step += 1
                lr = rate * (1 - 0.97 * epoch / epochs)
                for (_, v), m1, m2, g in zip(params, first, second, grads, strict=True):
                    m1 += 0.1 * (g - m1)
                    m2 += 0.001 * (g * g - m2)
                    v -= lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)


# Names and phrases that page layouts use; fixed lists for the generator below.
SYLLABLES = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que ment tion eau eux lich sch ung ein ge ver ción ado os ar ez ll ñ é ö ü ß à ç 中 的 ов ка".split()
MENU = "Home About Contact News Blog Shop Login Sign in Register Search Archive Products Services Accueil Actualités Impressum Startseite Inicio Noticias Menu Sitemap Help FAQ".split()
BOILER = {
    "header": ["Welcome to our site", "Skip to content", "Your daily news", "Log in or create an account"],
    "footer": ["© 2021 All rights reserved.", "Privacy policy · Terms of use", "© {w} · {s}", "Contact us at the address below.", "Powered by {w}", "Mentions légales", "Datenschutz | Impressum"],
    "ad": ["{s}", "Advertisement", "Sponsored: {s}", "Buy now and save 20 %", "Anzeige", "Publicité"],
    "notice": ["We use cookies to improve your experience. {s}", "Accept all cookies", "This site uses cookies.", "Subscribe to continue reading. {s}", "Please enable JavaScript."],
    "sidebar": ["Related articles", "Most read", "{t}", "{s}", "Tags", "Recent posts", "Follow us", "Share this"],
    "comments": ["Comments (3)", "{w} says: {s}", "{s} {s}", "{s}", "Reply", "Leave a comment", "Posted by {w} 3 hours ago"],
    "form": ["Your e-mail address", "Subscribe to our newsletter", "Send", "Search this site", "Name", "Password"],
}
NAMES = {
    "header": ["header", "header.site-header", "div.header", "div.masthead", "div#top", "div.banner", "div.topbar"],
    "menu": ["nav", "nav.menu", "div.nav", "div.navigation", "ul.menu", "div.navbar", "div.breadcrumbs", "div#menu"],
    "footer": ["footer", "div.footer", "div#footer", "div.copyright", "footer.site-footer", "div.colophon"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "aside.ad", "div.sponsored", "div.promo", "ins.adsbygoogle", "section.ad"],
    "notice": ["div.cookie", "div.cookie-banner", "div.notice", "div.alert", "div.consent", "div.popup", "div.gdpr", "div.paywall", "aside.notice", "p.notice", "div.modal"],
    "sidebar": ["aside", "div.sidebar", "div#sidebar", "div.related", "div.widget", "aside.sidebar", "section.related", "div.share", "div.social", "div.tags"],
    "comments": ["div.comments", "section.comments", "div#comments", "ol.commentlist", "div.comment", "section#comments", "div.replies", "div.discussion"],
    "form": ["form", "form.search", "form.newsletter", "div.subscribe", "form.login"],
}
MAIN = ["article", "main", "div.content", "div#content", "div.post", "div.article-body", "div.entry-content", "section.article", "div.story", "article.post", "div.main", "div.text", "div"]
#: What grids and utility classes are named; they say nothing of the text.
UTILITY = "col row grid flex xs sm md lg xl px py mt mb pt pb text bg border rounded shadow max min auto items center between justify font bold gap is has js clearfix fluid w h u l hover focus active top left".split()


def _opened(name: str, before: str = "", after: str = "") -> tuple[str, str]:
    """Opening and closing tag of a name such as div.ad or div#top, its class between others."""
    tag = name.split(".")[0].split("#")[0]
    rest = name[len(tag) :]
    of_class = " ".join(x for x in (before, rest[1:] if rest.startswith(".") else "", after) if x)
    attr = (f' class="{of_class}"' if of_class else "") + (f' id="{rest[1:]}"' if rest.startswith("#") else "")
    return f"<{tag}{attr}>", f"</{tag}>"


def written_page(r: random.Random, dressed: bool = False) -> tuple[str, list[bool]]:
    """A page in some layout and, for each block that it will give, whether that is main text.

    A dressed page has long lists of classes, mostly before the one that tells something.
    """
    pool = r.sample(SYLLABLES, 14)
    # each site has made some up
    usable = UTILITY + ["".join(r.choices(string.ascii_lowercase, k=r.randint(1, 8))) for _ in range(30)] if dressed else []

    def classes() -> str:
        return " ".join("-".join([*r.choices(usable, k=r.randint(1, 2)), str(r.randint(1, 12))]) for _ in range(r.randint(1, 14)))

    def opened(name: str) -> tuple[str, str]:
        return _opened(name, classes(), classes() if r.random() < 0.3 else "") if dressed else _opened(name)

    def word() -> str:
        return "".join(r.choice(pool) for _ in range(r.randint(1, 4)))

    # some pages are noisy throughout: tables of words, capitals, signs, repeats
    styles = ["plain"] * 5 + ["bars", "capitals", "signs", "repeats"]
    usual = r.choice(styles)

    def sentence(low=4, high=22) -> str:
        words = [word() for _ in range(r.randint(low, high))]
        style = usual if r.random() < 0.93 else r.choice(styles)
        if style == "bars":
            return " | ".join(words)
        if style == "capitals":
            return "!! ".join(words).upper() + "!!"
        if style == "signs":
            return " ".join(w + r.choice(["###", "%%%", "$$$", "***", "&amp;"]) for w in words)
        if style == "repeats":
            words = [w for w in words for _ in range(r.randint(1, 7))]
        return " ".join(words).capitalize() + r.choice([".", ".", ".", "", "!"])

    def filled(text: str) -> str:
        return text.format(w=word(), s=sentence(2, 16), t=sentence(2, 6))

    out: list[str] = []
    want: list[bool] = []

    def block(text: str, main: bool, tag: str) -> None:
        if text.strip():
            out.append(f"<{tag}>{text}" + ("" if tag in ("p", "li") and r.random() < 0.2 else f"</{tag}>"))
            want.append(main)

    def inner(kind: str) -> None:
        a, z = opened(r.choice(NAMES[kind]))
        if r.random() < 0.15:
            a, z = "<div>" + a, z + "</div>"
        out.append(a)
        if kind == "menu":
            out.append("<ul>")
            for _ in range(r.randint(2, 9)):
                label = r.choice(MENU) if r.random() < 0.4 else word().capitalize()
                block(f'<a href="/{word()}">{label}</a>', False, "li")
            out.append("</ul>")
        elif kind == "ad" and r.random() < 0.5 and not z.startswith("</p"):
            out.append(filled("{s}"))
            want.append(False)
        else:
            for _ in range(r.randint(1, 7 if kind == "comments" else 4)):
                text = filled(r.choice(BOILER[kind])) if r.random() < 0.5 else sentence(1, 14)
                if kind == "form" and r.random() < 0.6:
                    text = f"<label>{text}</label> <input name=q>"
                elif kind in ("sidebar", "footer") and r.random() < 0.5:
                    text = f'<a href="#">{text}</a>'
                block(text, False, r.choice(["p", "div", "li", "h3"] if kind != "header" else ["p", "div"]))
        out.append(z)

    def body() -> None:
        a, z = opened(r.choice(MAIN))
        out.append(a)
        title = sentence(2, 10)
        if r.random() < 0.8:
            block(title, True, r.choice(["h1", "h1", "h2"]))
        for k in range(r.randint(1, 14)):
            if r.random() < 0.04:
                inner(r.choice(["ad", "sidebar", "notice", "form"]))
            elif r.random() < 0.12:
                block(sentence(2, 7), True, r.choice(["h2", "h3"]))
            elif r.random() < 0.08:
                out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    block(sentence(2, 12), True, "li")
                out.append("</ul>")
            else:
                text = " ".join(sentence(1, 20) for _ in range(r.randint(1, 6)))
                if r.random() < 0.2:
                    text = f'{text} <a href="/{word()}">{word()}</a> <b>{sentence(1, 5)}</b>'
                block(text, True, r.choice(["p"] * 8 + ["blockquote", "div", "pre"]))
        out.append(z)

    before = [k for k in ("notice", "header", "menu", "ad", "form") if r.random() < 0.45]
    after = [k for k in ("sidebar", "comments", "ad", "menu", "form", "notice", "footer") if r.random() < 0.45]
    r.shuffle(before)
    for k in before:
        inner(k)
    if r.random() < 0.15:
        inner("sidebar")
    wrap = r.random() < 0.3
    out.append("<div class=wrapper>" if wrap else "")
    body()
    for k in after:
        inner(k)
    out.append("</div>" if wrap else "")
    return f"<!DOCTYPE html><html><head><title>{word()}</title><script>var a='<p>';</script></head><body>{''.join(out)}</body></html>", want


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = SEED) -> Labeller:
    """The labeller, trained on `pages` written pages and DRESSED ones; the same on every machine."""
    r = random.Random(seed)
    x, y = [], []
    while len(x) < pages + DRESSED:
        page, want = written_page(r, len(x) >= pages)
        found = blocks(page)
        if len(found) == len(want):
            x.append(vectors(found))
            y.append(np.array(want, np.float32))
    model = Labeller(seed=seed)
    model.fit(x, y, seed=seed)
    return model


def main_texts(model: Labeller, pages: list[list[Block]]) -> list[str]:
    labels = model.label([vectors(p) if p else np.zeros((0, WIDTH), np.float32) for p in pages])
    return ["\n".join([b.text for b, s in zip(p, score, strict=True) if s >= 0.5]) for p, score in zip(pages, labels, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (blocks of main text, one a line) and n_chars of every row, whole pages.

    A null page counts as empty and gives an empty text; a null id or url stays null; repeated rows
    each give a row; other columns are not read; an empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    model = trained()

    def rows(batches):
        for b in batches:
            text = main_texts(model, [blocks(h or "") for h in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).mapInArrow(rows, SCHEMA)
