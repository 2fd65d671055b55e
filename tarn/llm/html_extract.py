"""Main-text extraction by a graphical model on the page's tree.

Each node of a page's tree, a block or a run of text, is (or holds) main content or not. A node's
own features weigh for or against it, and potentials on each edge join a node to its
parent. As the graph is a tree, one pass of messages upward and one downward give every
node's exact marginal probability, in time linear in the page. The weights maximise the
likelihood of labelled pages; the gradient is the features' counts less their
expectations under the same marginals.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.dom import Page, read


class TreeModel:
    """weights: by feature, for content; edges: by kind of child and (parent, child) state."""

    def __init__(self, weights: dict[str, float] | None = None, edges: dict[tuple, float] | None = None):
        self.weights, self.edges = weights or {}, edges or {}

    def _kind(self, page: Page, i: int) -> str:
        return "text" if page.text[i] is not None else "block"

    def marginals(self, page: Page) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Each node's probability of content, and each edge's four joint probabilities (parent, child): 00, 01, 10, 11."""
        n, w = len(page.tag), self.weights
        own = [(1.0, math.exp(max(-30.0, min(30.0, sum(w.get(f, 0.0) for f in fs))))) for fs in page.features]
        pair = {k: tuple(math.exp(self.edges.get((k, a, b), 0.0)) for a in (0, 1) for b in (0, 1)) for k in ("text", "block")}
        kinds = [pair[self._kind(page, i)] for i in range(n)]
        below = list(own)  # a node's potential times its children's messages
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            e, (b0, b1) = kinds[i], below[i]
            m0, m1 = e[0] * b0 + e[1] * b1, e[2] * b0 + e[3] * b1
            up[i] = m0 / (m0 + m1), m1 / (m0 + m1)
            p0, p1 = below[page.parent[i]]
            p0, p1 = p0 * up[i][0], p1 * up[i][1]
            below[page.parent[i]] = p0 / (p0 + p1), p1 / (p0 + p1)
        chance, joint = [0.0] * n, [(0.0,) * 4] * n
        belief = [below[0]] * n
        for i in range(n):
            if i:
                p0, p1 = belief[page.parent[i]]
                p0, p1 = p0 / max(up[i][0], 1e-300), p1 / max(up[i][1], 1e-300)  # the parent without this child
                e, (b0, b1) = kinds[i], below[i]
                j = (p0 * e[0] * b0, p0 * e[1] * b1, p1 * e[2] * b0, p1 * e[3] * b1)
                total = sum(j)
                joint[i] = tuple(x / total for x in j)
                belief[i] = joint[i][0] + joint[i][2], joint[i][1] + joint[i][3]
            chance[i] = belief[i][1] / (belief[i][0] + belief[i][1])
        return chance, joint

    def fit(self, pages: list[Page], rounds: int = 100, rate: float = 0.4, ridge: float = 0.0003) -> TreeModel:
        """Adaptive gradient ascent on the penalised likelihood of the pages' truth."""
        seen: dict = defaultdict(float)
        for _ in range(rounds):
            slope: dict = defaultdict(float)
            for page in pages:
                chance, joint = self.marginals(page)
                for i, fs in enumerate(page.features):
                    rest = page.truth[i] - chance[i]
                    for f in fs:
                        slope[f] += rest
                    if i:
                        k, at = self._kind(page, i), 2 * page.truth[page.parent[i]] + page.truth[i]
                        for s in range(4):
                            slope[(k, s >> 1, s & 1)] += (s == at) - joint[i][s]
            for f, g in slope.items():
                place = self.edges if isinstance(f, tuple) else self.weights
                g = g / len(pages) - ridge * place.get(f, 0.0)
                seen[f] += g * g
                place[f] = place.get(f, 0.0) + rate * g / math.sqrt(seen[f] + 1e-12)
        return self

    def blocks(self, html: str | None) -> list[str]:
        """The main content's blocks in page order."""
        page = read(html or "")
        chance, _ = self.marginals(page)
        return [t for t, p in zip(page.text, chance, strict=True) if t is not None and p > 0.5]


WORDS = "lorem river stone walks over calm bright window table paper letters count every morning under the of and to in is that on with as by".split()


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Pages whose data-main attributes tell content (1) from the rest (0), in many layouts.

    They are drawn from a grammar of common layouts: where a page keeps its article, what
    stands around it and inside it, and how it is marked up.
    """
    rnd = random.Random(seed)

    def says(low: int, high: int) -> str:
        return " ".join(rnd.choices(WORDS, k=rnd.randint(low, high))).capitalize() + rnd.choice([".", ".", ".", "", "!"])

    def links(k: int) -> str:
        return "".join(f'<li><a href="#">{says(1, 3)}</a></li>' for _ in range(k))

    def marked(tag: str, names: list[str], inner: str, main: int) -> str:
        name = rnd.choice(names)
        attr = f' {rnd.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f'<{tag}{attr} data-main="{main}">{inner}</{tag}>'

    def around() -> str:
        kinds = [
            lambda: marked("nav", ["", "menu", "navbar"], f"<ul>{links(rnd.randint(2, 8))}</ul>", 0),
            lambda: marked("div", ["menu", "nav", "navigation"], f"<ul>{links(rnd.randint(2, 8))}</ul>", 0),
            lambda: marked("header", ["", "header", "masthead"], f"<h1>{says(1, 4)}</h1>" + (f"<p>{says(2, 8)}</p>" if rnd.random() < 0.5 else ""), 0),
            lambda: marked("aside", ["", "sidebar", "widget"], f"<h3>{says(1, 3)}</h3><p>{says(5, 40)}</p><ul>{links(3)}</ul>", 0),
            lambda: marked("div", ["sidebar", "side widget", "related"], f"<h3>{says(1, 3)}</h3><p>{says(5, 40)}</p>", 0),
            lambda: marked("div", ["ad", "ads", "advert", "banner", "promo", "sponsored"], rnd.choice([says(3, 30), f"<p>{says(3, 30)}</p>", f'<a href="#">{says(2, 9)}</a>']), 0),
            lambda: marked("div", ["cookie-notice", "consent", "notice", "alert", "popup", "newsletter"], rnd.choice([f"<p>{says(5, 30)}</p><button>OK</button>", says(5, 30)]), 0),
            lambda: marked("form", ["", "search", "login", "newsletter"], f"<label>{says(1, 3)}</label><input><p>{says(3, 12)}</p><button>{says(1, 2)}</button>", 0),
            lambda: marked("footer", ["", "footer"], rnd.choice([f"&copy; 2020 {says(2, 9)}", f"<p>&copy; {says(2, 9)}</p><p>{says(4, 20)}</p>", says(3, 14)]), 0),
            lambda: marked("div", ["footer", "copyright", "legal"], f"<p>{says(4, 20)}</p>", 0),
            lambda: marked(rnd.choice(["section", "div"]), ["comments", "comment-list", "discussion", "replies"], f"<h2>{says(1, 3)}</h2>" + "".join(f'<{t} class="comment"><p>{says(4, 50)}</p></{t}>' for t in [rnd.choice(["div", "article", "li"])] * rnd.randint(1, 4)), 0),
        ]
        return rnd.choice(kinds)()

    def body(plain: bool) -> str:
        parts = [f"<h1>{says(2, 9)}</h1>"] if rnd.random() < 0.8 else []
        short = rnd.random() < 0.25
        for _ in range(rnd.randint(1, 2 if short else 9)):
            text = says(1, 3) if short else says(*rnd.choice([(1, 6), (1, 40), (5, 40), (20, 120)]))
            parts.append(rnd.choice([
                f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text} <a href='#'>{says(1, 3)}</a> {says(2, 9)}</p>", f"<div>{text}</div>",
                f"<h2>{says(1, 6)}</h2>", f"<ul><li>{text}</li><li>{says(3, 14)}</li></ul>", f"<blockquote><p>{text}</p></blockquote>", f"<pre>{text}</pre>", f"<table><tr><td>{says(1, 4)}</td><td>{text}</td></tr></table>", text,
                f"<p><a href='#'>{says(2, 9)}</a></p><p>{text}</p>", f"<ul><li>{says(1, 6)}</li><li><a href='#'>{says(1, 4)}</a></li><li>{text}</li></ul>", f"<p>{text} <label>{says(1, 2)}</label> {says(1, 5)} <button>{says(1, 1)}</button> {says(1, 9)}</p>",
            ]))
            if not plain and rnd.random() < 0.12:
                parts.append(around())
        return "".join(parts)

    pages = []
    for i in range(n):
        style = i % 10
        if style == 9:
            bare = "".join(f'<p data-main="1">{says(*rnd.choice([(2, 6), (4, 60)]))}</p>' for _ in range(rnd.randint(1, 4)))
            pages.append([f'<div data-main="1">{says(3, 60)}</div>', f'<html><body data-main="1">{body(True)}</body></html>', bare, f"<html><body>{bare}</body></html>"][i // 10 % 4])
            continue
        before, after = "".join(around() for _ in range(rnd.randint(0, 4))), "".join(around() for _ in range(rnd.randint(0, 4)))
        if style < 4:
            main = marked("article", ["", "post", "entry", "article"], body(False), 1)
            main = rnd.choice([main, main, marked("main", ["", "content"], main, 1), f"<div>{main}</div>"])
        elif style < 6:
            main = marked("main", ["", "content", "page"], body(False), 1)
        else:
            main = marked("div", ["content", "article-body", "post", "entry-content", "main", "story", "", "", "x", "col wide"], body(False), 1)
        pages.append(f"<!DOCTYPE html><html><head><title>{says(2, 6)}</title></head><body>{before}{main}{after}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    return TreeModel().fit([read(x) for x in labelled_pages()])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """One row per row of pages: id_col, url_col, text, n_chars, n_blocks.

    text joins the main blocks by spaces, with character references decoded and white
    space inside a block made one space; empty if there are none. A null or empty page
    has an empty text; n_chars counts code points. A page is read whole, however long.
    Null ids and urls stay, repeated rows each get a row, an empty table gives an empty
    result. Other columns are ignored.
    """
    model = model or default_model()

    def extracted(frames):
        for frame in frames:
            found = [model.blocks(x) for x in frame["_html"]]
            yield pd.DataFrame({"_id": frame["_id"], "_url": frame["_url"], "text": [" ".join(x) for x in found], "n_blocks": [len(x) for x in found]})

    kind = pages.schema[id_col].dataType.simpleString()
    # ids travel as text, which keeps nulls and every type
    rows = pages.select(F.col(id_col).cast("string").alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    out = rows.mapInPandas(extracted, "_id string, _url string, text string, n_blocks long")
    return out.select(F.col("_id").cast(kind).alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
