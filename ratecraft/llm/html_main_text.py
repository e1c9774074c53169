"""Main text of web pages, by a recurrent block labeller.

A page is read as its sequence of leaf blocks (``html_leaves``). Each block is a
vector: the sum of learned vectors of its path's tokens (tags, class and id
words, roles), the sum of learned vectors of its distinct hashed words, and statistics of
its text. A bidirectional LSTM (numpy) reads the whole sequence, so a block is
judged with all the others of its page in view, and a logistic output says
whether it belongs to the article. Blocks that do are joined in page order.

Training. No table labels blocks, so the labels are made by rule from a bounded
sample of about ``SAMPLE`` pages (distant supervision): a block under ``article`` or ``main`` and
under none of the ``KINDS`` of boilerplate is article text, one under such an
element is not, any other block is not trained on. Each page is also trained on
in ``DRESSED`` other dresses: its article blocks in another container (or none),
between menus, headers, footers, sidebars, notices, adverts, forms and comments
whose elements, class names and phrases come from ``KINDS`` and whose texts are
pieces of the page itself, so words alone don't give them away. The fit, over at
most ``SAMPLE * (1 + DRESSED)`` sequences of at most ``WINDOW`` blocks, runs on
the driver; the model (some 100,000 numbers) is broadcast.
Every block of every page is judged; the texts themselves are never cut.

Memory: pages are read in slices of about 1 MB or one longer page; sequences of
like length share a batch of at most ``CELLS`` blocks, or one longer sequence.

Defined results: null and empty pages, and pages without article blocks, give an
empty text of 0 characters; white space is what ``str.split`` cuts at; repeated
rows are judged one by one; a null id or address is passed through; an empty
table gives no rows, and pages without any labelled block leave the model
untrained, which keeps every block; other columns are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecraft.llm.common import hash_words, ship_by_value, text_slices
from ratecraft.llm.html_leaves import PATHS, Paths, bucket, leaves

#: Pages that are trained on, at most about, and extra dresses of each.
SAMPLE, DRESSED = 256, 3
#: Blocks of a training sequence, at most.
WINDOW = 96
WORDS = 4096
SIZE, HIDDEN = 16, 24
EPOCHS, BATCH, RATE = 8, 16, 0.01
SEED = 20_251_203
#: Blocks judged at once (unless one page has more).
CELLS = 1 << 14
STATS = 10
WIDTH = 2 * SIZE + STATS

# Kinds of boilerplate, each with tags, class or id words, and phrases.
KINDS = {
    "menu": (["nav", "ul", "div", "header"], ["menu", "nav", "navbar", "navigation", "breadcrumb", "topnav", "toc"],
             ["Home", "Contact", "About us", "Startseite", "Accueil", "Inicio", "News", "Login"]),
    "header": (["header", "div"], ["header", "masthead", "branding", "topbar", "logo"],
               ["Welcome", "Willkommen", "Bienvenue", "Bienvenido"]),
    "footer": (["footer", "div"], ["footer", "copyright", "bottom", "colophon", "legal"],
               ["© 2024", "All rights reserved", "Impressum", "Mentions légales", "Aviso legal", "Privacy policy"]),
    "sidebar": (["aside", "div", "section"], ["sidebar", "widget", "aside", "related", "popular", "trending", "more"],
                ["Related", "Most read", "Meistgelesen", "À lire aussi", "Más leídas"]),
    "notice": (["div", "p", "dialog", "section"], ["cookie", "notice", "consent", "gdpr", "alert", "banner", "popup"],
               ["We use cookies", "Wir verwenden Cookies", "Nous utilisons des cookies", "Usamos cookies", "Accept"]),
    "advert": (["div", "aside", "section"], ["ad", "ads", "advert", "sponsor", "promo", "advertisement", "banner"],
               ["Advertisement", "Anzeige", "Publicité", "Publicidad", "Sponsored"]),
    "form": (["form", "div", "fieldset"], ["form", "login", "search", "newsletter", "subscribe", "signup"],
             ["Your email", "Subscribe", "Password", "Suche", "S'abonner", "Suscribirse"]),
    "comments": (["section", "div", "ol", "article"], ["comments", "comment", "commentlist", "replies", "discussion",
                                                       "respond", "disqus"],
                 ["Reply", "3 comments", "Antworten", "Répondre", "Responder", "says:", "Leave a comment"]),
    "share": (["ul", "div"], ["share", "social", "sharing", "follow", "tags", "byline"],
              ["Share", "Tweet", "Teilen", "Partager", "Compartir"]),
}
CONTAINERS = [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "entry content"),
              ("div", "post body"), ("section", "article body"), ("div", "story"), ("div", "main"), ("div", "text"),
              ("div", ""), ("td", ""), ("", "")]
_BOILER_TAGS = ("nav", "footer", "aside", "form", "dialog", "fieldset")
_BOILER_WORDS = frozenset(w for _, words, _ in KINDS.values() for w in words) - {"more", "logo", "popular", "trending"}


def _by_rule(path, paths: Paths):
    """1: article text, 0: boilerplate, -1: unknown, by the elements around."""
    around = set().union(*paths.tokens[path]) if paths.tokens[path] else set()
    if any(bucket(t) in around for t in _BOILER_TAGS) or any(bucket("." + w) in around for w in _BOILER_WORDS):
        return 0
    return 1 if bucket("article") in around or bucket("main") in around else -1


# --- dresses -----------------------------------------------------------------

def _clean(text):
    return text.replace("&", "&amp;").replace("<", "&lt;")


def _boiler(rng, kind, words):
    """HTML of one boilerplate group."""
    tags, names, phrases = KINDS[kind]
    tag, name = tags[rng.integers(len(tags))], names[rng.integers(len(names))]
    # A plain element needs its name; one that says what it is may lack it.
    attribute = f' {"class" if rng.random() < 0.7 else "id"}="{name}"'
    if tag in ("nav", "footer", "aside", "form", "header") and rng.random() < 0.6:
        attribute = ""

    def piece(least, most):
        n = int(rng.integers(least, most))
        at = int(rng.integers(max(1, len(words) - n)))
        text = " ".join(words[at:at + n])
        return _clean(phrases[rng.integers(len(phrases))] if not text or rng.random() < 0.35 else text)

    if kind in ("menu", "share") or kind in ("footer", "sidebar") and rng.random() < 0.5:
        items = "".join(f'<li><a href="/x">{piece(1, 4)}</a></li>' for _ in range(rng.integers(1, 9)))
        inner = items if tag == "ul" else f"<ul>{items}</ul>"
    elif kind == "comments":
        each = "article" if rng.random() < 0.2 else "li" if tag == "ol" else "div"
        inner = "".join(f'<{each} class="comment"><p>{piece(1, 3)}</p><p>{piece(3, 60)}</p></{each}>'
                        for _ in range(rng.integers(1, 5)))
    elif kind == "form":
        inner = "".join(f"<p>{piece(1, 5)}</p>" for _ in range(rng.integers(1, 4)))
    else:
        wrap = ("<p>", "</p>") if tag != "p" and rng.random() < 0.5 else ("", "")
        inner = "".join(f"{wrap[0]}{piece(2, 25)}{wrap[1] or ' '}" for _ in range(rng.integers(1, 4)))
    return f"<{tag}{attribute}>{inner}</{tag}>"


def _dress(rng, texts):
    """(HTML, label) pieces of a made page around the article blocks ``texts``."""
    words = " ".join(texts).split()
    out = []

    def boilers(kinds, most):
        for _ in range(int(rng.integers(0, most + 1))):
            out.append((_boiler(rng, kinds[rng.integers(len(kinds))], words), 0))

    tag, name = CONTAINERS[rng.integers(len(CONTAINERS))]
    bare = rng.random() < 0.1
    if not bare:
        boilers(["menu", "header", "notice", "advert", "form", "sidebar"], 4)
    if rng.random() < 0.3:
        out.append(('<div class="page">', None))
    within = ""
    if tag:
        within = f' {"class" if rng.random() < 0.7 else "id"}="{name}"' if name else ""
        out.append((f"<{tag}{within}>" if tag != "td" else f"<table><tr><td{within}>", None))
    inside = not bare and rng.random() < 0.35
    for k, text in enumerate(texts):
        form = "h1" if k == 0 and rng.random() < 0.8 else \
            ["p", "p", "p", "p", "p", "h2", "li", "blockquote", "div", "pre", "td"][rng.integers(11)]
        opened = {"li": "<ul><li>", "td": "<table><tr><td>"}.get(form, f"<{form}>")
        closed = {"li": "</li></ul>", "td": "</td></tr></table>"}.get(form, f"</{form}>")
        if form == "p" and rng.random() < 0.2:
            opened, closed = "<p><b>", "<br>"
        if k == 0 and rng.random() < 0.15:
            opened, closed = f"<header>{opened}", f"{closed}</header>"
        out.append((f"{opened}{_clean(text)}{closed}", 1))
        if inside and rng.random() < 0.2:
            out.append((_boiler(rng, ["advert", "sidebar", "share", "form"][rng.integers(4)], words), 0))
    if inside and rng.random() < 0.4:
        boilers(["comments", "share", "footer"], 2)
    if tag:
        out.append((f"</{tag}>" if tag != "td" else "</td></tr></table>", None))
    if not bare:
        boilers(["comments", "sidebar", "share", "footer", "form", "advert"], 4)
        boilers(["footer", "notice", "menu"], 2)
    return out


def _made_page(rng, texts):
    """A made page and the labels of its blocks."""
    page, label = "<html><body>", []
    paths = Paths()
    for piece, kind in _dress(rng, texts):
        page += piece
        if kind is not None:
            label += [kind] * len(leaves(piece, paths))
    return page + "</body></html>", label


# --- features ----------------------------------------------------------------

def _stats(text, linked):
    n = len(text)
    words = text.count(" ") + 1
    ends = sum(text.count(c) for c in ".!?")
    return (1.0, np.log1p(words) / 5, np.log1p(n) / 7, linked / max(n, 1), min(1.0, 10 * ends / words),
            float(text[-1] in ".!?:…»\""), float(words < 4), float("©" in text), min(1.0, text.count(",") / words * 5),
            sum(c.isupper() for c in text[:200]) / min(n, 200))


class Blocks:
    """Features of a list of blocks: paths, distinct words by block, statistics."""

    def __init__(self, blocks, paths: Paths):
        raw = [t.encode("utf-8", "surrogatepass") for t, _, _ in blocks]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        h, _, woff = hash_words(np.frombuffer(b"".join(raw), np.uint8), off, lower=True)
        owner = np.repeat(np.arange(len(blocks)), np.diff(woff))
        each = np.unique(owner * WORDS + (h % np.uint64(WORDS)).astype(np.int64))  # the distinct words of a block
        self.word, self.off = (each % WORDS).astype(np.int32), np.searchsorted(each, np.arange(len(blocks) + 1) * WORDS)
        self.path = [paths.buckets(p) for _, p, _ in blocks]
        self.stat = np.array([_stats(t, linked) for t, _, linked in blocks]).reshape(len(blocks), STATS)


def _sums(table, ids, off):
    """Sums of the rows ``ids`` of ``table`` from each offset to the next, over
    the root of their number; some 100,000 rows at a time."""
    n = np.diff(off)
    out = np.zeros((len(n), table.shape[1]))
    owner = np.repeat(np.arange(len(n)), n)
    for lo in range(0, len(ids), 1 << 17):
        own = owner[lo:lo + (1 << 17)]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[at]] += np.add.reduceat(table[ids[lo:lo + (1 << 17)]], at, axis=0)
    return out / np.sqrt(np.maximum(n, 1))[:, None]


def _flat(lists):
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.array([i for x in lists for i in x], np.int32), off


def _vectors(model, blocks: Blocks):
    ids, off = _flat(blocks.path)
    return np.concatenate([_sums(model["path"], ids, off), _sums(model["word"], blocks.word, blocks.off), blocks.stat], axis=1)


# --- the network -------------------------------------------------------------

def _fresh(rng):
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = {"path": rng.normal(0, 0.3, (PATHS, SIZE)), "word": rng.normal(0, 0.1, (WORDS, SIZE)),
             "out": draw(2 * HIDDEN + WIDTH, 1)[:, 0], "bias": np.zeros(1)}
    for side in "fb":
        model["x" + side], model["h" + side] = draw(WIDTH, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
        model["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return model


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _lstm(x, wx, wh, b):
    """Hidden states (time, batch, HIDDEN), and what the gradient needs."""
    steps, n, _ = x.shape
    given = x @ wx + b
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    hidden, cells, gates = np.empty((steps, n, HIDDEN)), np.empty((steps, n, HIDDEN)), np.empty((steps, n, 4 * HIDDEN))
    for t in range(steps):
        z = given[t] + h @ wh
        g = gates[t]
        g[:, :3 * HIDDEN] = _sigmoid(z[:, :3 * HIDDEN])  # input, forget, output
        g[:, 3 * HIDDEN:] = np.tanh(z[:, 3 * HIDDEN:])
        c = g[:, HIDDEN:2 * HIDDEN] * c + g[:, :HIDDEN] * g[:, 3 * HIDDEN:]
        h = g[:, 2 * HIDDEN:3 * HIDDEN] * np.tanh(c)
        hidden[t], cells[t] = h, c
    return hidden, (cells, gates)


def _lstm_back(x, wx, wh, hidden, kept, up):
    """Gradients of the input and the three parameters, from those of ``hidden``."""
    cells, gates = kept
    dz = np.empty_like(gates)
    dh, dc = np.zeros_like(hidden[0]), np.zeros_like(hidden[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g = (gates[t][:, k * HIDDEN:(k + 1) * HIDDEN] for k in range(4))
        dh = dh + up[t]
        tc = np.tanh(cells[t])
        dc = dc + dh * o * (1 - tc * tc)
        before = cells[t - 1] if t else np.zeros_like(dc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o),
                                dc * i * (1 - g * g)], axis=1)
        dc = dc * f
        dh = dz[t] @ wh.T
    flat = dz.reshape(-1, 4 * HIDDEN)
    past = np.concatenate([np.zeros_like(hidden[:1]), hidden[:-1]]).reshape(-1, HIDDEN)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, past.T @ flat, flat.sum(axis=0)


def _turned(size, steps):
    """Index that reverses each sequence and leaves its padding where it is."""
    t = np.arange(steps)[:, None]
    return np.where(t < size, size - 1 - t, t)


def logits(model, x, size):
    """Scores (time, batch) of padded sequences of the given sizes."""
    turn = _turned(size, len(x))
    col = np.arange(x.shape[1])
    ahead, kept_f = _lstm(x, model["xf"], model["hf"], model["cf"])
    back, kept_b = _lstm(x[turn, col], model["xb"], model["hb"], model["cb"])
    joined = np.concatenate([ahead, back[turn, col], x], axis=2)
    return joined @ model["out"] + model["bias"], (turn, col, ahead, kept_f, back, kept_b, joined)


def gradient(model, x, size, label):
    """Loss (mean over labelled blocks) and its gradient; label -1: not trained on."""
    z, (turn, col, ahead, kept_f, back, kept_b, joined) = logits(model, x, size)
    known = label >= 0
    n = max(1, int(known.sum()))
    p = _sigmoid(z)
    loss = -np.where(label == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12))[known].sum() / n
    dz = np.where(known, p - label, 0.0) / n
    grad = {"out": (joined * dz[:, :, None]).sum(axis=(0, 1)), "bias": np.array([dz.sum()])}
    dj = dz[:, :, None] * model["out"]
    dx = dj[:, :, 2 * HIDDEN:].copy()
    more, grad["xf"], grad["hf"], grad["cf"] = _lstm_back(x, model["xf"], model["hf"], ahead, kept_f, dj[:, :, :HIDDEN])
    dx += more
    more, grad["xb"], grad["hb"], grad["cb"] = _lstm_back(
        x[turn, col], model["xb"], model["hb"], back, kept_b, dj[:, :, HIDDEN:2 * HIDDEN][turn, col])
    dx += more[turn, col]  # the index is its own inverse
    return loss, grad, dx


def _padded(vectors, size):
    x = np.zeros((int(size.max()), len(size), WIDTH))
    at = np.concatenate([[0], np.cumsum(size)])
    for k, n in enumerate(size):
        x[:n, k] = vectors[at[k]:at[k] + n]
    return x


def judge(model, blocks: Blocks, size):
    """Whether each block of the pages with ``size`` blocks is article text."""
    if model is None:
        return np.ones(int(size.sum()), bool)
    vectors = _vectors(model, blocks)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(len(vectors), bool)
    order = [k for k in np.argsort(size, kind="stable").tolist() if size[k]]
    while order:
        longest = int(size[order[-1]])
        some = order[-max(1, min(128, CELLS // longest)):]
        del order[-len(some):]
        own = size[some]
        z, _ = logits(model, _padded(np.concatenate([vectors[at[k]:at[k + 1]] for k in some]), own), own)
        for col, k in enumerate(some):
            out[at[k]:at[k + 1]] = z[:size[k], col] > 0
    return out


# --- training ----------------------------------------------------------------

def _pack(blocks, label, paths, rng):
    """One training sequence as bytes; a longer one by a window somewhere in it."""
    if len(blocks) > WINDOW:
        at = int(rng.integers(len(blocks) - WINDOW + 1))
        blocks, label = blocks[at:at + WINDOW], label[at:at + WINDOW]
    b = Blocks(blocks, paths)
    ids, off = _flat(b.path)
    out = io.BytesIO()
    np.savez(out, label=np.array(label, np.int8), path=ids, path_off=off, stat=b.stat, word=b.word, word_off=b.off)
    return out.getvalue()


def _sequences(batches):
    """Training sequences of each page: as it is, and in other dresses."""
    for b in batches:
        out = []
        for seed, page in zip(b.column("seed").to_pylist(), b.column("html").to_pylist(), strict=True):
            rng = np.random.default_rng([SEED, seed & 0xFFFFFFFF])
            paths = Paths()
            blocks = leaves(page, paths)
            label = [_by_rule(p, paths) for _, p, _ in blocks]
            texts = [t for (t, _, _), k in zip(blocks, label, strict=True) if k == 1][:WINDOW]
            if max(label, default=-1) >= 0:
                out.append(_pack(blocks, label, paths, rng))
            for _ in range(DRESSED if texts else 0):
                made, marks = _made_page(rng, texts[:int(rng.integers(1, len(texts) + 1))])
                blocks = leaves(made, paths)
                if len(blocks) == len(marks):
                    out.append(_pack(blocks, marks, paths, rng))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["sequence"])


def _weighted(table, ids, off, share):
    out = np.zeros((len(off) - 1, table.shape[1]))
    np.add.at(out, np.repeat(np.arange(len(off) - 1), np.diff(off)), table[ids] * share[:, None])
    return out


def fit(packed: list[bytes]):
    """The labeller, by Adam over mini-batches in an order set by ``SEED``;
    None without labelled blocks. Some path tokens and the words of some blocks
    are left out at random, so that no single sign is relied on."""
    rows = [dict(np.load(io.BytesIO(p))) for p in packed]
    if not rows:
        return None
    rng = np.random.default_rng(SEED)
    model = _fresh(rng)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            some = [rows[i] for i in order[lo:lo + BATCH]]
            size = np.array([len(r["label"]) for r in some])
            parts, sets = [], []
            for r in some:
                ps, ws = (np.repeat(1 / np.sqrt(np.maximum(n, 1)), n) for n in (np.diff(r["path_off"]), np.diff(r["word_off"])))
                ps *= rng.random(len(ps)) > 0.1
                ws *= np.repeat(rng.random(len(r["label"])) > 0.3, np.diff(r["word_off"]))
                sets.append((ps, ws))
                parts.append(np.concatenate([_weighted(model["path"], r["path"], r["path_off"], ps),
                                             _weighted(model["word"], r["word"], r["word_off"], ws), r["stat"]], axis=1))
            x = _padded(np.concatenate(parts), size)
            label = np.full(x.shape[:2], -1)
            for k, r in enumerate(some):
                label[:size[k], k] = r["label"]
            _, grad, dx = gradient(model, x, size, label)
            grad["path"], grad["word"] = np.zeros_like(model["path"]), np.zeros_like(model["word"])
            for k, (r, (ps, ws)) in enumerate(zip(some, sets, strict=True)):
                at = np.repeat(np.arange(size[k]), np.diff(r["path_off"]))
                np.add.at(grad["path"], r["path"], dx[at, k, :SIZE] * ps[:, None])
                at = np.repeat(np.arange(size[k]), np.diff(r["word_off"]))
                np.add.at(grad["word"], r["word"], dx[at, k, SIZE:2 * SIZE] * ws[:, None])
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model[k] -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def train(pages: DataFrame):
    """The labeller, from about ``SAMPLE`` different pages."""
    n = pages.count()
    seed = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", F.lit(SEED))
    some = pages.where("html is not null").select(seed.alias("seed"), "html") \
        .where(F.pmod("seed", F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1))))
    one = some.groupBy("seed").agg(F.min("html").alias("html"))  # repeated rows once
    return fit(sorted(r.sequence for r in one.mapInArrow(_sequences, "sequence binary").collect()))


def _extract(model):
    def run(batches):
        m = model.value
        for b in batches:
            for lo, hi, data, off in text_slices(b.column("html")):
                paths, blocks, size = Paths(), [], []
                for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    found = leaves(data[a:z].tobytes().decode("utf-8", "replace"), paths)
                    blocks += found
                    size.append(len(found))
                size = np.array(size)
                keep = judge(m, Blocks(blocks, paths), size) if blocks else np.zeros(0, bool)
                at = np.concatenate([[0], np.cumsum(size)])
                texts = ["\n".join(blocks[k][0] for k in range(at[p], at[p + 1]) if keep[k]) for p in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id").slice(lo, hi - lo), b.column("url").slice(lo, hi - lo), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame, model=None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; trains unless given a model."""
    model = model or train(pages.select("page_id", "url", "html"))
    kinds = dict(pages.dtypes)
    sent = pages.sparkSession.sparkContext.broadcast(model)
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract(sent), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


ship_by_value(__name__)
