r"""The main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Nodes (dom.read) are block elements and runs of text. Each has features of its subtree (characters, share
of links, characters a run, controls), of attribute words of itself and what is above it, of its depth and
place, and of its siblings and its parent. Boosted trees give every node the log-odds that main text is in
it. Decoding picks, among all choices in which nothing below a dropped node is kept, the one with the
greatest sum of log-odds: bottom-up the best sum with the node kept and with it dropped, then top-down.
So no ancestor and descendant contradict each other. Kept runs, in page order, are the text.

Pages have no labels. The trees learn from pages that are made of the table's own words: the bounded sample
of SAMPLE pages gives words and addresses, which are laid out anew in seeded layouts of which it is known
what is the article: marked-up or plain containers, menus, headers, footers, sidebars, notices, adverts,
forms and comments with or without telling names, left-out end tags. The fit takes a few seconds on the
driver, on MADE pages whatever the table's size; the model, some kB, goes along with the tasks that read
the pages in Arrow batches. Trees are symmetric: one test a level, so a batch's nodes run through all trees
as arrays.

Defined results: a null or empty page, or one without text, has an empty text; very long pages are read
whole; repeated rows are pages of their own; null page_ids and urls stay null; the sample prefers no page
(it follows a hash of the text), and a page over SAMPLE_BYTES is no part of it; an empty table gives no
rows; further columns are ignored (or kept, by extracted(), whatever their names).
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import dom
from pathloom.llm.rows import small
from pathloom.session import ship, spread

#: Bounds of the fit: pages of the sample, the bytes of each, and pages that are made of them.
SAMPLE, SAMPLE_BYTES, MADE = 64, 1 << 16, 450
TREES, DEPTH, RATE, BINS, CLIP = 50, 5, 0.25, 16, 6.0
_KINDS = {
    "run": [dom.RUN], "p": ["p"], "heading": [f"h{k}" for k in range(1, 7)], "list": ["ul", "ol", "dl", "menu"], "item": ["li", "dt", "dd"],
    "div": ["div"], "section": ["section"], "article": ["article"], "main": ["main"], "nav": ["nav"], "header": ["header"], "footer": ["footer"],
    "aside": ["aside"], "form": ["form", "fieldset", "search"], "table": ["table", "tbody", "tr", "td", "th"], "quote": ["blockquote", "pre", "figure"],
}
_KIND_OF = {tag: k for k, tags in enumerate(_KINDS.values()) for tag in tags}
_ABOVE = [k for k, name in enumerate(_KINDS) if name in ("article", "main", "nav", "header", "footer", "aside", "form", "list", "quote", "table")]
#: The column of features that tells a subtree's characters.
_CHARS = len(_KINDS) + len(_ABOVE) + 2 * (len(dom.GROUPS) + 1)


# features


def features(pages: list[dom.Page]) -> np.ndarray:
    """A row for each node of all pages: small whole numbers."""
    out = []
    for page in pages:
        n = len(page.tag)
        chars, linked, runs, controls = [0] * n, list(page.linked), [0] * n, list(page.controls)
        ends, kids = [0] * n, [[] for _ in range(n)]
        kind = [_KIND_OF.get(t, len(_KINDS)) for t in page.tag]
        below = [1 << k for k in kind]
        for i in range(n - 1, -1, -1):
            if page.text[i] is not None:
                chars[i], runs[i] = len(page.text[i]), 1
                ends[i] = page.text[i].endswith((".", "!", "?", "…", "。"))
            if i:
                p = page.parent[i]
                chars[p] += chars[i]
                linked[p] += linked[i]
                runs[p] += runs[i]
                controls[p] += controls[i]
                ends[p] += ends[i]
                below[p] |= below[i]
                kids[p].append(i)
        over, words, depth, before, seen = [0] * n, [0] * n, [0] * n, [0] * n, 0
        place, many = [0] * n, [1] * n
        for k in kids:
            k.reverse()
            for j, i in enumerate(k):
                place[i], many[i] = j, len(k)
        for i in range(n):
            p = page.parent[i]
            if i:
                over[i], words[i], depth[i] = over[p] | 1 << kind[p], words[p] | page.bits[p], depth[p] + 1
            before[i] = seen
            if page.text[i] is not None:
                seen += chars[i]
        whole = max(1, chars[0])
        log = lambda x: int(x).bit_length()
        share = lambda x, y: 20 * x // y if y else 0
        for i in range(n):
            p = max(page.parent[i], 0)
            left = kids[p][place[i] - 1] if i and place[i] else -1
            right = kids[p][place[i] + 1] if i and place[i] + 1 < many[i] else -1
            own, above = page.bits[i], words[i]
            row = [kind[i] == k for k in range(len(_KINDS))] + [over[i] >> k & 1 for k in _ABOVE]
            row += [own >> k & 1 for k in range(len(dom.GROUPS) + 1)] + [above >> k & 1 for k in range(len(dom.GROUPS) + 1)]
            row += [
                log(chars[i]), share(linked[i], chars[i]), log(runs[i]), log(chars[i] // max(1, runs[i])), min(controls[i], 20), share(chars[i], whole),
                share(chars[i], chars[p]), share(ends[i], runs[i]), min(depth[i], 30), min(place[i], 30), log(many[i]), min(many[i] - 1 - place[i], 30),
                log(chars[left]) if left >= 0 else -1, log(chars[right]) if right >= 0 else -1, share(linked[left], chars[left]) if left >= 0 else -1,
                kind[left] if left >= 0 else -1, share(before[i], whole), share(linked[p], chars[p]), log(chars[p]), log(chars[p] // max(1, runs[p])),
                below[i] >> _KIND_OF["article"] & 1, below[i] >> _KIND_OF["main"] & 1, below[0] >> _KIND_OF["article"] & 1, below[0] >> _KIND_OF["main"] & 1,
                below[i] >> _KIND_OF["form"] & 1, below[i] >> _KIND_OF["p"] & 1, kind[p],
            ]
            out.append(row)
    return np.array(out, np.int16)


# trees


@dataclass(frozen=True)
class Trees:
    """Symmetric trees: on each level one feature and threshold; 2 ** depth leaves."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of rows."""
        out = np.full(len(x), self.start)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            out += leaf[((x[:, feature] > threshold) << np.arange(len(feature))).sum(axis=1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosting with logistic loss: each tree fits gradients and second derivatives, from histograms of binned features.

    A tree sees half of the rows and of the features, drawn with a fixed seed.
    """
    draw = np.random.default_rng(1)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.asfortranarray(np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], axis=1).astype(np.int64))  # x > cuts[b] exactly if its bin is above b
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    start = float(np.log(mean / (1 - mean)))
    score, chosen = np.full(len(y), start), ([], [], [])
    usable = [f for f, c in enumerate(cuts) if len(c) and binned[:, f].any()]
    for _ in range(trees if usable else 0):
        p = 1 / (1 + np.exp(-score))
        half, seen = draw.random(len(y)) < 0.5, draw.permutation(usable)[: (len(usable) + 1) // 2].tolist()
        slope, curve, at = (y - p)[half], (p * (1 - p))[half], np.zeros(int(half.sum()), np.int64)
        some = {f: binned[half, f] for f in seen}
        whole = np.zeros(len(y), np.int64)
        fs, ts = [], []
        for level in range(depth):
            best = (-np.inf, 0, 0)
            for f in seen:
                bins = len(cuts[f]) + 1
                key, size = at * bins + some[f], (1 << level) * bins
                g = np.bincount(key, slope, size).reshape(-1, bins).cumsum(axis=1)
                h = np.bincount(key, curve, size).reshape(-1, bins).cumsum(axis=1)
                gain = (g[:, :-1] ** 2 / (h[:, :-1] + 1) + (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + 1)).sum(axis=0)
                b = int(gain.argmax())
                best = max(best, (float(gain[b]), -f, -b))
            f, b = -best[1], -best[2]
            at |= (some[f] > b).astype(np.int64) << level
            whole |= (binned[:, f] > b).astype(np.int64) << level
            fs.append(f)
            ts.append(cuts[f][b])
        leaf = rate * np.bincount(at, slope, 1 << depth) / (np.bincount(at, curve, 1 << depth) + 1)
        score += leaf[whole]
        for column, value in zip(chosen, (fs, ts, leaf)):
            column.append(value)
    return Trees(start, np.array(chosen[0], np.int64).reshape(-1, depth), np.array(chosen[1], np.int64).reshape(-1, depth), np.array(chosen[2]))


# decoding


def decoded(page: dom.Page, odds: np.ndarray) -> str:
    """The text of the runs that the best choice without contradictions keeps."""
    n = len(page.tag)
    worth = np.clip(odds, -CLIP, CLIP).tolist()
    filled, keep, drop = [t is not None for t in page.text], [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        if filled[i]:  # elements without text decide nothing
            filled[page.parent[i]] = True
            keep[i] += worth[i]
            drop[i] -= worth[i]
        keep[page.parent[i]] += max(keep[i], drop[i])
        drop[page.parent[i]] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and keep[i] > drop[i]
    return "\n\n".join(t for t, k in zip(page.text, kept) if k and t)


# pages with known articles

MARK = ""


class _Maker:
    """Pages laid out from a pool of words, with MARK before each block of the article."""

    def __init__(self, pool: list[str], seed: int):
        self.r, self.pool = random.Random(seed), pool

    def words(self, low: int, high: int) -> str:
        n = round(low * (high / low) ** self.r.random())
        at = self.r.randrange(len(self.pool))
        return " ".join(self.pool[(at + k) % len(self.pool)] for k in range(n))

    def sentence(self, low=3, high=60) -> str:
        return self.words(low, high) + self.r.choice([".", ".", ".", "", "!"])

    def link(self) -> str:
        return f'<a href="/{self.r.randrange(999)}">{self.words(1, 4)}</a>'

    def links(self, low=2, high=9) -> str:
        items = [self.link() for _ in range(self.r.randint(low, high))]
        return self.r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items), "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"])

    def named(self, tags: str, names: str, body: str, bare: float = 0.0) -> str:
        tag = self.r.choice(tags.split())
        if self.r.random() < bare:
            return f"<{tag}>{body}</{tag}>"
        a = self.r.choice(['class="{}"', 'id="{}"', 'class="x1 {}"', 'class="{} block"'])
        return f"<{tag} {a.format(self.r.choice(names.split()))}>{body}</{tag}>"

    def paragraph(self) -> str:
        text = MARK + self.sentence(1, 140)
        if self.r.random() < 0.15:
            parts = text.split(" ")
            k = self.r.randrange(len(parts))
            parts[k] = parts[k] if parts[k].startswith(MARK) else f"<a href='/x'>{parts[k]}</a>"
            text = " ".join(parts)
        return self.r.choice(["<p>{}</p>"] * 6 + ["<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<h2>{}</h2>", "<p class='lead'>{}</p>", "<section><p>{}</p></section>"]).format(text)

    def article(self, rich: bool) -> str:
        body = [self.paragraph() for _ in range(self.r.choice([1, 2, 3, 5, 8, 13, 21]))]
        if self.r.random() < 0.25:
            body.insert(self.r.randrange(len(body) + 1), "<ul>" + "".join(f"<li>{MARK}{self.sentence(2, 25)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
        if self.r.random() < 0.1:
            body.insert(self.r.randrange(len(body) + 1), "<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 5)}</td><td>{MARK}{self.words(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
        if self.r.random() < 0.8:
            title = f"<h1>{MARK}{self.words(2, 14)}</h1>"
            body.insert(0, title if self.r.random() < 0.8 else f"<header>{title}</header>")
        if rich:
            for junk in (self.advert, self.share, self.related, self.comments, self.notice):
                if self.r.random() < 0.2:
                    body.insert(self.r.randrange(1, len(body) + 1), junk())
        inside = "".join(body)
        kind = self.r.random()
        if kind < 0.45:
            return f"<article>{inside}</article>"
        if kind < 0.55:
            return f"<main><article>{inside}</article></main>"
        if kind < 0.65:
            return f"<main>{inside}</main>"
        if kind < 0.92:
            return self.named("div div section", "content main post post-content entry-content article-body story articleText main-content", inside)
        return f"<div>{inside}</div>" if kind < 0.97 else f"<table><tr><td>{inside}</td></tr></table>"

    def menu(self) -> str:
        return self.r.choice([lambda: f"<nav>{self.links()}</nav>", lambda: self.named("div ul", "menu nav navbar navigation main-menu breadcrumb", self.links()), lambda: f"<nav><p>{self.sentence(2, 12)}</p>{self.links()}</nav>"])()

    def header(self) -> str:
        inside = f"<h1>{self.words(1, 5)}</h1>" * self.r.randint(0, 1) + f"<p>{self.sentence(2, 14)}</p>" + (self.menu() if self.r.random() < 0.5 else "")
        return f"<header>{inside}</header>" if self.r.random() < 0.6 else self.named("div", "header masthead topbar branding site-header", inside)

    def footer(self) -> str:
        inside = self.r.choice([lambda: f"&copy; {self.words(1, 4)} &middot; {self.sentence(2, 25)}", lambda: f"<p>&copy; 2024 {self.sentence(2, 30)}</p>{self.links(1, 5)}", lambda: f"<p>{self.sentence(3, 40)}</p>" * self.r.randint(1, 3)])()
        return f"<footer>{inside}</footer>" if self.r.random() < 0.65 else self.named("div", "footer site-footer copyright colophon", inside)

    def sidebar(self) -> str:
        inside = f"<h3>{self.words(1, 4)}</h3>" + self.r.choice([self.links(), f"<p>{self.sentence(3, 60)}</p>" * self.r.randint(1, 4)])
        return f"<aside>{inside}</aside>" if self.r.random() < 0.5 else self.named("div section", "sidebar side rail widget right-sidebar", inside)

    def advert(self) -> str:
        inside = self.r.choice([self.sentence(3, 50), f"<p>{self.sentence(3, 50)}</p>" * self.r.randint(1, 3), f"<p>{self.sentence(3, 20)} {self.link()}</p>"])
        tags = "div div aside section" + " p" * ("<p" not in inside)
        return self.named(tags, "ad ads advert advertisement sponsored promo ad-slot banner-ad", inside)

    def notice(self) -> str:
        inside = self.r.choice([self.sentence(3, 40), f"<p>{self.sentence(3, 50)}</p><button>{self.words(1, 2)}</button>"])
        return self.named("div section aside", "notice cookie-notice cookie-banner consent alert popup gdpr", inside)

    def form(self) -> str:
        inside = f"<label>{self.words(1, 4)}</label><input name='q'><button>{self.words(1, 2)}</button>"
        inside = self.r.choice([inside, f"<p>{self.sentence(2, 30)}</p>{inside}", f"<h3>{self.words(1, 5)}</h3><p>{inside}</p><textarea></textarea>"])
        return f"<form>{inside}</form>" if self.r.random() < 0.8 else self.named("div", "search newsletter subscribe login", f"<form>{inside}</form>")

    def share(self) -> str:
        return self.named("div ul", "share social sharing follow", self.links(2, 5))

    def related(self) -> str:
        inside = f"<h3>{self.words(1, 4)}</h3>" + self.r.choice([self.links(), "".join(f"<div>{self.link()}<p>{self.sentence(3, 25)}</p></div>" for _ in range(3))])
        return self.named("div section aside", "related related-posts recommended popular more-stories-related", inside)

    def comments(self) -> str:
        one = lambda: self.r.choice(["<div class='comment'><b>{}</b><p>{}</p></div>", "<li><p>{1}</p></li>", "<p>{1}</p>", "<article><p>{1}</p></article>"]).format(self.words(1, 2), self.sentence(2, 90))
        inside = f"<h2>{self.words(1, 4)}</h2>" * self.r.randint(0, 1) + "".join(one() for _ in range(self.r.choice([1, 2, 4, 9])))
        return self.named("section div ol", "comments comment-list reader-comments discussion replies", inside)

    def page(self) -> str:
        rich, some = self.r.random() < 0.5, lambda share, part: part() if self.r.random() < share else ""
        article = self.article(rich) if self.r.random() > 0.03 else ""
        body = [some(0.7, self.menu), some(0.35, self.header), some(0.2, self.notice), some(0.5, self.advert), some(0.15, self.form), some(0.2, self.sidebar)]
        self.r.shuffle(body)
        after = [some(0.3, self.sidebar), some(0.3, self.comments), some(0.25, self.related), some(0.2, self.advert), some(0.2, self.form), some(0.15, self.share), some(0.15, self.notice)]
        self.r.shuffle(after)
        whole = "".join(body) + article + "".join(after) + some(0.75, self.footer) + some(0.1, self.notice)
        for _ in range(self.r.choice([0, 0, 1, 2])):
            whole = f"<div{self.r.choice(['', ' class=wrap', ' id=page', ' class=container'])}>{whole}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title></head><body>{whole}" + self.r.choice(["</body></html>", ""])


def trained(sample: list[str], made: int = MADE, seed: int = 13) -> Trees:
    """The trees from `made` pages laid out anew from the words of sample pages (HTML)."""
    pool = [w for html in sample for t in dom.read(html).text if t for w in t.split(" ")]
    pool = [w.replace("&", "&amp;").replace("<", "&lt;") for w in pool[:200_000]] + [f"word{k}" for k in range(200 if len(pool) < 200 else 0)]
    maker = _Maker(pool, seed)
    pages, labels = [], []
    for _ in range(made):
        page = dom.read(maker.page())
        label = [t is not None and MARK in t for t in page.text]
        page.text = [t and t.replace(MARK, "") for t in page.text]
        for i in range(len(label) - 1, 0, -1):
            label[page.parent[i]] |= label[i]
        pages.append(page)
        labels += label
    x, y = features(pages), np.array(labels, float)
    some = x[:, _CHARS] > 0  # elements without text teach nothing
    return fit(x[some], y[some])


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    read = [dom.read(html or "") for html in pages]
    odds, at, out = trees(features(read)) if read else np.zeros(0), 0, []
    for page in read:
        out.append(decoded(page, odds[at : at + len(page.tag)]))
        at += len(page.tag)
    return out


def learn(pages: DataFrame) -> Trees:
    """Trees for a table with a column html, from a bounded sample of its pages: of each remainder of their hashes the least hash."""
    fine = pages.select("html", F.xxhash64("html").alias("hash")).where(F.octet_length("html") <= SAMPLE_BYTES)
    least = [r.hash for r in fine.groupBy(F.pmod("hash", F.lit(SAMPLE)).alias("of")).agg(F.min("hash").alias("hash")).collect()]  # SAMPLE numbers
    found = fine.where(F.col("hash").isin(least)).groupBy("hash").agg(F.min("html").alias("html"))
    return trained([r.html for r in found.orderBy("hash").collect()])


def articles(pages: DataFrame, row: Column, trees: Trees | None = None) -> DataFrame:
    """(row, text, n_chars) of pages with a column html; row is a struct to carry."""
    ship(pages.sparkSession)
    trees = learn(pages) if trees is None else trees
    some = spread(pages.select(row.alias("row"), "html"))
    kind = T.StructType([some.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "html", 1 << 20):
            found = extract(batch.column("html").to_pylist(), trees)
            columns = [batch.column("row"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "n_chars"])

    return some.mapInArrow(run, kind)


def extracted(pages: DataFrame) -> DataFrame:
    """pages with all their columns in `row`, and the main text of html."""
    return articles(pages, F.struct(*[F.col(f"`{c}`") for c in pages.columns]))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return articles(pages, F.struct("page_id", "url")).select("row.page_id", "row.url", "text", "n_chars")


QUERIES = {"op13_article": op13}
ORACLES: dict[str, str] = {}
