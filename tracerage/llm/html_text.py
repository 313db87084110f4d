"""Main text of web pages by a linear-chain CRF over DOM leaf blocks (operator 10)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, worker_cache

#: HTML element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|title"
#: Elements that a start tag closes, and the elements that this doesn't reach through.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("article aside body div footer form header main nav ol section table td th ul".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s>/])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A run of text between block-level tags, with the tags and names it stands in, outermost first."""

    text: str
    tags: list[str]
    names: list[str]
    linked: int


def leaf_blocks(source: str) -> list[Block]:
    """The blocks of a page in order. Scripts, styles, titles and comments have none.

    Character references are decoded after the markup is cut; white space becomes one space.
    """
    stack: list[tuple[str, list[str]]] = []
    out: list[Block] = []
    parts: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, [t for t, _ in stack], [n for _, names in stack for n in names], linked))
        parts.clear()
        linked = 0

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    def imply(tags: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in SCOPE:
                return

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw)
        parts.append(text)
        if any(t == "a" for t, _ in stack[-4:]):
            linked += len(text.strip())

    for m in TOKEN.finditer(source):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m["end"]:
            close(tag)
            continue
        if tag in CLOSES_P:
            imply({"p"})
        if tag in IMPLIED:
            imply(IMPLIED[tag])
        if tag not in VOID and not m["more"].endswith("/"):
            names = [w for a in ATTRIBUTE.findall(m["more"]) for w in WORDS.findall(" ".join(a[1:]).lower())] if "=" in m["more"] else []
            stack.append((tag, names))
    if at < len(source):
        add(source[at:])
    flush()
    return out


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        outer = [t for t in b.tags if t not in INLINE]
        words = b.text.count(" ") + 1
        near = [outer[-1 - k] if k < len(outer) else "-" for k in range(2)]
        f = ["bias", f"tag={near[0]}", f"path={near[1]}>{near[0]}", f"len={min(len(b.text).bit_length(), 10)}", f"words={min(words.bit_length(), 7)}"]
        f += [f"in={t}" for t in set(outer)] + [f"name={w}" for w in set(b.names)]
        share = b.linked / len(b.text)
        f.append(f"link={'none' if not share else 'some' if share < 0.3 else 'most' if share < 0.9 else 'all'}")
        f.append(f"stop={b.text[-1] in '.!?…'}")
        f.append(f"marks={min(sum(map(b.text.count, '.,;')), 4)}")
        if any(c in b.text for c in "©|»›·"):
            f.append("sign")
        f.append("first" if i == 0 else "last" if i == n - 1 else "mid")
        f.append("top" if 4 * i < n else "low" if 4 * i >= 3 * n else "middle")
        out.append(f)
    return out


class Crf:
    """Two states (0 other, 1 main text), weights of features by state, of transitions and of the start."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def scores(self, features: list[list[str]]) -> np.ndarray:
        get, none = self.weights.get, (0.0, 0.0)
        out = np.zeros((len(features), 2))
        for i, f in enumerate(features):
            a = b = 0.0
            for name in f:
                x, y = get(name, none)
                a += x
                b += y
            out[i] = a, b
        return out

    def decode(self, features: list[list[str]]) -> list[int]:
        """The likeliest states (Viterbi)."""
        if not features:
            return []
        s = self.scores(features)
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:].tolist():
            to0, to1 = (a + m00 >= b + m10), (a + m01 > b + m11)
            back.append((0 if to0 else 1, 0 if to1 else 1))
            a, b = x + (a + m00 if to0 else b + m10), y + (a + m01 if to1 else b + m11)
        path = [int(b >= a)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    @staticmethod
    def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.3, shrink: float = 1e-4) -> Crf:
        """Maximum likelihood by adaptive gradient steps, page by page; gradients by forward and backward sums."""
        index: dict[str, int] = {}
        coded = [([[index.setdefault(n, len(index)) for n in f] for f in fs], np.array(ys)) for fs, ys in pages if fs]
        w, moves = np.zeros((len(index), 2)), np.zeros((2, 2))
        gw, gm = np.full(w.shape, 1e-6), np.full((2, 2), 1e-6)
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for k in rng.permutation(len(coded)):
                fs, ys = coded[k]
                s = np.stack([w[f].sum(0) for f in fs])
                n = len(s)
                fore, back = np.zeros((n, 2)), np.zeros((n, 2))
                fore[0] = s[0]
                for i in range(1, n):
                    fore[i] = s[i] + np.logaddexp(fore[i - 1][0] + moves[0], fore[i - 1][1] + moves[1])
                for i in range(n - 2, -1, -1):
                    nxt = moves + s[i + 1] + back[i + 1]
                    back[i] = np.logaddexp(nxt[:, 0], nxt[:, 1])
                total = np.logaddexp(*fore[-1])
                miss = np.exp(fore + back - total)
                miss[np.arange(n), ys] -= 1
                step_m = np.zeros((2, 2))
                for i in range(1, n):
                    step_m += np.exp(fore[i - 1][:, None] + moves + s[i] + back[i] - total)
                    step_m[ys[i - 1], ys[i]] -= 1
                gm += step_m**2
                moves -= rate * step_m / np.sqrt(gm)
                rows, at = np.concatenate(fs).astype(int), np.repeat(np.arange(n), [len(f) for f in fs])
                uniq, inv = np.unique(rows, return_inverse=True)
                g = np.zeros((len(uniq), 2))
                np.add.at(g, inv, miss[at])
                g += shrink * w[uniq]
                gw[uniq] += g**2
                w[uniq] -= rate * g / np.sqrt(gw[uniq])
        return Crf({n: tuple(w[i]) for n, i in index.items()}, moves)


#: Elements and names whose text is no article, as labels go: the guide for labelling pages. Fixed values.
OTHER_TAGS = {"nav", "aside", "footer", "form", "button", "select", "dialog", "menu"}
OTHER_NAMES = re.compile(r"(?:^|[-_])(?:comments?|commentlist|repl(?:y|ies)|discussion|ads?|advert|sponsored|promo|sidebar|widget|related|share|newsletter|subscribe|cookie|consent|gdpr|popup)(?:$|[-_])", re.I)
MARKED = r"(?i)<(article|main)[\s>]"


def labelled(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article; None if it doesn't. Reader comments in an article are none of it."""
    if not any(t in ("article", "main") for b in blocks for t in b.tags):
        return None
    return [int(any(t in ("article", "main") for t in b.tags) and not OTHER_TAGS & set(b.tags) and not any(OTHER_NAMES.search(n) for name in b.names for n in name.split())) for b in blocks]


#: Ways in which pages set their parts: containers by role, as (tag, class). Fixed values.
LAYOUTS = {
    "main": [("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry-content"), ("section", "story"), ("div", "article-body"), ("div", "main"), ("td", "text"), ("article", "post hentry")],
    "menu": [("nav", ""), ("ul", "menu"), ("div", "navbar"), ("div", "breadcrumb"), ("nav", "main-nav")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "top-bar")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "copyright")],
    "side": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("aside", "related"), ("div", "social share")],
    "notice": [("div", "cookie-notice"), ("div", "consent banner"), ("div", "notice"), ("div", "alert popup"), ("section", "gdpr")],
    "advert": [("div", "ad"), ("div", "advert"), ("div", "ads sponsored"), ("aside", "promo"), ("ins", "banner-ad")],
    "form": [("form", ""), ("form", "search"), ("form", "newsletter"), ("div", "login subscribe")],
    "comments": [("div", "comments"), ("section", "comment-list"), ("div", "comment"), ("ol", "commentlist"), ("div", "reader-comments"), ("section", "replies discussion")],
}


def laid_out(main: list[str], other: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A labelled page: a page's own texts set in a random layout."""
    pieces: list[tuple[str, int]] = []

    def draw(texts: list[str], most: int) -> list[str]:
        return [texts[int(rng.integers(len(texts)))] for _ in range(int(rng.integers(1, most + 1)))]

    def box(role: str, inner: str) -> str:
        tag, name = LAYOUTS[role][int(rng.integers(len(LAYOUTS[role])))]
        if rng.random() < 0.3:
            name = ""
        return f'<{tag} class="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    mark = lambda text, label: (pieces.append((text, label)), f"\x01{len(pieces) - 1}\x02{html.escape(text)}")[1]
    short = [" ".join(t.split()[: int(rng.integers(1, 6))]) for t in [*main, *other]]
    links = lambda: "<ul>" + "".join(f'<li><a href="#">{mark(t, 0)}</a></li>' for t in draw(short, 7)) + "</ul>"
    lines = lambda most: "".join(f"<p>{mark(' '.join(t.split()[:40]), 0)}</p>" for t in draw([*other, *main], most))
    plain = lambda: mark(" ".join(draw([*other, *main], 1)[0].split()[:20]), 0)

    def part(most: int) -> str:
        """Some words of the article, marked as such."""
        w = draw(main, 1)[0].split()
        at = int(rng.integers(len(w)))
        return mark(" ".join(w[at : at + int(rng.integers(1, most + 1))]), 1)

    def article_block(t: str) -> str:
        """A text of the article in one of the elements that articles have; lists, tables and captions hold parts of texts."""
        many = lambda open_, close, most: "".join(f"{open_}{part(14)}{close}" for _ in range(int(rng.integers(2, most + 1))))
        kind = rng.random()
        if kind < 0.58:
            return f"<p>{mark(t, 1)}</p>"
        if kind < 0.67:
            tag = ("ul", "ol")[int(rng.integers(2))]
            return f"<{tag}>{many('<li>', '</li>', 6)}</{tag}>"
        if kind < 0.73:
            return "<table>" + "".join(f"<tr>{many('<td>', '</td>', 3)}</tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>"
        if kind < 0.77:
            return f"<figure><img src='x'><figcaption>{part(16)}</figcaption></figure>"
        if kind < 0.80:
            return f"<dl>{many('<dt>', '</dt>', 2)}<dd>{part(20)}</dd></dl>"
        if kind < 0.89:
            return mark(t, 1)  # bare text in the container
        tag = ("h2", "h3", "pre", "blockquote", "div")[int(rng.integers(5))]
        return f"<{tag}>{part(8) if tag[0] == 'h' else mark(t, 1)}</{tag}>"

    inner, bare = "", rng.random() < 0.08
    for i, t in enumerate(main):
        if bare:
            inner += f"{mark(t, 1)}<br><br>"
        elif not i and rng.random() < 0.8:
            inner += f"<h1>{mark(t, 1)}</h1>"
        else:
            inner += article_block(t)
        if rng.random() < 0.05:
            inner += box(("advert", "side")[int(rng.integers(2))], plain())
    if rng.random() < 0.2:
        inner += box("comments", lines(4))
    middle = box("main", inner)
    before = [box("header", plain() if rng.random() < 0.5 else links()), box("menu", links()), box("notice", plain()), box("advert", plain()), box("form", plain())]
    after = [box("side", links() if rng.random() < 0.6 else lines(2)), box("comments", lines(5)), box("footer", f"&copy; {plain()}"), box("advert", plain()), box("form", plain()), box("notice", plain())]
    page = "".join(x for x in before if rng.random() < 0.55) + middle + "".join(x for x in after if rng.random() < 0.5)
    blocks = leaf_blocks(f"<html><body>{page}</body></html>")
    labels = []
    for b in blocks:
        numbers = [int(x) for x in re.findall("\x01(\\d+)\x02", b.text)]
        labels.append(pieces[numbers[0]][1] if numbers else 0)
        b.text = re.sub("\x01\\d+\x02", "", b.text) or "-"
        b.linked = min(b.linked, len(b.text))
    return blocks, labels


def fit(pages: DataFrame, most: int = 120, layouts: int = 6, longest: int = 400) -> Crf:
    """A CRF trained on about ``most`` pages (its bound) that mark their article, drawn by a hash.

    Each is taken as it is and in ``layouts`` random layouts of its own texts, so that the model
    also knows menus, notices, forms and comments that these pages don't have. Where no page marks
    its article, long blocks of other pages stand for articles, in random layouts only. Runs in one
    task; of a drawn page with more than ``longest`` blocks the first so many are taken.
    """
    rows = doc_columns(pages, "page_id", "html").where("html is not null").withColumn("marked", F.col("html").rlike(MARKED))
    counts = {r["marked"]: r["count"] for r in rows.groupBy("marked").count().collect()}
    rows = rows.where("marked" if True in counts else "not marked")
    bound = int(min(1.0, most / max(counts.get(True) or counts.get(False) or 0, 1)) * (1 << 20))
    drawn = rows.where(F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 20)) < bound).select("html", F.lit(0).alias("g"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, examples = np.random.default_rng(11), []
        for source in sorted(pdf["html"]):
            blocks = leaf_blocks(source)[:longest]
            labels = labelled(blocks)
            if labels is not None:
                examples.append((block_features(blocks), labels))
            else:
                labels = [int(len(b.text.split()) >= 15 and not b.linked) for b in blocks]
            main = [b.text for b, y in zip(blocks, labels, strict=True) if y]
            other = [b.text for b, y in zip(blocks, labels, strict=True) if not y] or ["-"]
            for _ in range(layouts if main else 0):
                b, y = laid_out(main, other, rng)
                examples.append((block_features(b), y))
        if not examples:
            return pd.DataFrame({"name": ["bias"], "a": [0.0], "b": [1.0]})
        model = Crf.train(examples)
        found = [(n, a, b) for n, (a, b) in model.weights.items()] + [(f"\0{i}", *model.moves[i]) for i in (0, 1)]
        return pd.DataFrame(found, columns=["name", "a", "b"])

    found = {r["name"]: (r["a"], r["b"]) for r in drawn.groupBy("g").applyInPandas(train, "name string, a double, b double").collect()}
    moves = np.array([found.pop("\0" + str(i), (0.0, 0.0)) for i in (0, 1)])
    return Crf(found, moves)


def main_text(source: str | None, model: Crf) -> str:
    blocks = leaf_blocks(source or "")
    return "\n\n".join(b.text for b, y in zip(blocks, model.decode(block_features(blocks)), strict=True) if y)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page from its whole html.

    Null or empty html gives an empty text. Rows stay one to one, repeated ones and null ids too;
    an empty table gives an empty table; other columns are ignored.
    """
    model = model or fit(pages)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            texts = [main_text(x.as_py(), sent.value) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return doc_columns(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
