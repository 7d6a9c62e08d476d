"""Main text of pages by a recurrent block labeller.

The labeller is trained on the driver, on a bounded set: ``made`` pages that a seeded generator lays out from words of
the corpus (article text among menus, headers, footers, sidebars, notices, adverts, forms and comments, under many tag
and class names), and at most ``sample`` pages of the table whose own sectioning elements say what is article text.
Pages are then parsed and labelled where they are read; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks_of
from .labeller import Features, Labeller

#: Names that pages give to their parts.
ASIDE = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "toc", "links", "tabs"],
    "header": ["header", "masthead", "top", "site header", "banner", "logo", "topbar"],
    "footer": ["footer", "site footer", "bottom", "colophon", "copyright", "legal"],
    "aside": ["sidebar", "side", "related", "widget", "popular", "trending", "recommended", "more", "teaser", "share", "social", "tags"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adbox", "banner ad"],
    "notice": ["notice", "cookie", "cookies", "consent", "gdpr", "alert", "modal", "popup", "overlay", "disclaimer", "message"],
    "form": ["form", "search", "login", "newsletter", "subscribe", "signup", "contact", "poll"],
    "comments": ["comments", "comment", "discussion", "replies", "reply", "respond", "disqus", "reader comments", "feedback"],
}
MAIN = ["article", "content", "main", "post", "entry", "entry content", "post body", "story", "text", "article body", "page content", "body"]
OUTSIDE = frozenset(["nav", "aside", "footer", "form", *(f".{w}" for names in ASIDE.values() for n in names for w in n.split()), "button", "select", "dialog", "menu"])
INSIDE = frozenset(["article", "main"])


def page_maker(words: list[str], seed: int):
    """A function that makes pages: markup, and for each block in order whether it is article text."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]

    def prose(lo: int, hi: int) -> str:
        n, out = int(r.integers(lo, hi + 1)), []
        while len(out) < n:
            k = int(r.integers(4, 16))
            sentence = [pick(words) for _ in range(min(k, n - len(out)))]
            sentence[0] = sentence[0].capitalize()
            if len(sentence) > 6 and r.random() < 0.5:
                sentence[3] += ","
            sentence[-1] += "."
            out += sentence
        return " ".join(out)

    def phrase(lo: int, hi: int) -> str:
        return " ".join(pick(words) for _ in range(int(r.integers(lo, hi + 1))))

    def attr(names: list[str]) -> str:
        name = pick(names).replace(" ", pick(["-", "_", " "]))
        return f' {pick(["class", "id", "class"])}="{name if r.random() < 0.7 else name + " " + pick(["wrap", "box", "inner", "c1", "block"])}"'

    def holder(tag: str, names: list[str], inner: str) -> str:
        own = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6
        name = "" if own and r.random() < 0.5 else attr(names)
        outer = tag if own else pick(["div", "section", "div", "ul" if inner.startswith("<li") else "div"])
        return f"<{outer}{name}>{inner}</{outer}>"

    def rest(kind: str) -> tuple[str, int]:
        """Markup that is not article text, and its number of blocks."""
        n = int(r.integers(1, 7))
        if kind == "nav":
            items = "".join(f'<li><a href="/{k}">{phrase(1, 3)}</a></li>' for k in range(n + 1))
            return holder(kind, ASIDE[kind], items if r.random() < 0.4 else f"<ul>{items}</ul>"), n + 1
        if kind == "aside":
            head = f"<h3>{phrase(1, 3)}</h3>"
            if r.random() < 0.5:
                return holder(kind, ASIDE[kind], head + "".join(f'<p><a href="/{k}">{phrase(3, 9)}</a></p>' for k in range(n))), n + 1
            return holder(kind, ASIDE[kind], head + "".join(f"<p>{prose(8, 40)}</p>" for _ in range(n))), n + 1
        if kind == "form":
            return holder(kind, ASIDE[kind], f'<label>{phrase(1, 4)}</label><input name="q"><p>{phrase(2, 12)}</p><button>{phrase(1, 2)}</button>'), 3
        if kind == "comments":
            each = [f"<div{attr(['comment', 'reply', 'comment body', 'c'])}><p>{prose(5, 60)}</p></div>" for _ in range(n)]
            return holder(kind, ASIDE[kind], f"<h4>{phrase(1, 3)}</h4>" + "".join(each)), n + 1
        if kind == "footer":
            return holder(kind, ASIDE[kind], f"&copy; {phrase(1, 2)} &middot; {prose(3, 18)}"), 1
        if kind == "header":
            return holder(kind, ASIDE[kind], f"<p>{phrase(1, 6)}</p><p>{phrase(2, 8)}</p>"), 2
        return holder(kind, ASIDE[kind], prose(3, 40) if r.random() < 0.6 else f"<p>{prose(3, 40)}</p>"), 1

    def make() -> tuple[str, list[bool]]:
        top, bottom = [], []
        for kind in ASIDE:
            if r.random() < 0.6:
                early = {"nav": 0.9, "header": 1.0, "footer": 0.0, "comments": 0.0, "aside": 0.4}.get(kind, 0.5)
                (top if r.random() < early else bottom).append(kind)
        parts, labels = [], []

        def put(kind: str) -> None:
            markup, n = rest(kind)
            parts.append(markup)
            labels.extend([False] * n)

        for kind in top:
            put(kind)
        tag = pick(["article", "article", "main", "div", "section", "div"])
        named = attr(MAIN) if tag in ("div", "section") or r.random() < 0.3 else ""
        parts.append(f"<{tag}{named}>")
        title = phrase(3, 12).capitalize()
        if r.random() < 0.85:
            parts.append(f"<h1>{title}</h1>")
            labels.append(True)
        for k in range(int(r.integers(0, 9))):
            u = r.random()
            if u < 0.1:
                parts.append(f"<h2>{phrase(1, 6).capitalize()}</h2>")
            elif u < 0.18:
                items = int(r.integers(1, 6))
                parts.append("<ul>" + "".join(f"<li>{prose(3, 20)}</li>" for _ in range(items)) + "</ul>")
                labels.extend([True] * (items - 1))
            elif u < 0.25:
                parts.append(f"<blockquote>{prose(5, 40)}</blockquote>")
            elif u < 0.35:
                parts.append(f"<p><b>{prose(2, 80)}<br>")
            elif u < 0.42:
                parts.append(f'<p>{prose(5, 30)} <a href="/x">{phrase(1, 5)}</a> {prose(3, 60)}</p>')
            else:
                parts.append(f"<p>{prose(*pick([(1, 2), (1, 6), (3, 25), (20, 90), (20, 200), (40, 200)]))}</p>")
            labels.append(True)
            if r.random() < 0.1:
                put(pick(["ad", "aside", "notice", "form"]))
        if r.random() < 0.12:
            put(pick(["comments", "aside"]))
        parts.append(f"</{tag}>")
        for kind in sorted(bottom, key=lambda k: k == "footer"):
            put(kind)
        return f"<html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>", labels

    return make


def own_labels(blocks: list[Block]) -> np.ndarray | None:
    """What the page's sectioning elements say; None if it has no article or main element."""
    if not any(INSIDE.intersection(b.path) for b in blocks):
        return None
    return np.array([bool(INSIDE.intersection(b.path)) and not OUTSIDE.intersection(b.path[max(map(b.path.index, INSIDE.intersection(b.path))) :]) for b in blocks])


def train_labeller(pages: DataFrame, *, made: int = 900, sample: int = 150, sample_chars: int = 20_000, epochs: int = 14, seed: int = 4) -> Labeller:
    """Labeller trained on ``made`` generated pages and at most ``sample`` pages of ``pages`` (their first ``sample_chars`` characters)."""
    rows = pages.where("html is not null")
    total = rows.count()
    near = F.pmod(F.xxhash64("html", F.lit(seed)), F.lit(1_000_000))
    rows = rows.where(near < int(min(1_000_000, 1 + 3_000_000 * sample / max(1, total))))
    seen = [blocks_of(r[0]) for r in rows.orderBy(near).limit(sample).select(F.substring("html", 1, sample_chars)).collect()]
    words = sorted({w for p in seen for b in p for w in b.text.lower().split()})
    words = [w.strip(".,") for w in words if re.fullmatch(r"\w+[.,]?", w)][:20_000] or ["lorem", "ipsum", "dolor", "sit", "amet"]
    make = page_maker(words, seed)
    pages_, labels = [], []
    for _ in range(made):
        markup, truth = make()
        blocks = blocks_of(markup)
        if len(blocks) == len(truth):
            pages_.append(blocks)
            labels.append(np.array(truth))
    for blocks in seen:
        own = own_labels(blocks)
        if own is not None:
            pages_.append(blocks)
            labels.append(own)
    model = Labeller()
    model.fit(pages_, labels, epochs)
    return model


def extract(pages: DataFrame, model: Labeller, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points), n_blocks, and the blocks kept (their places in the page).

    A null or empty html has empty text, and so has a page without article text. Repeated rows get equal results; null
    ids and urls stay null. A page of any length is read whole. Other columns are ignored.
    """
    weights = pages.sparkSession.sparkContext.broadcast(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.p = weights.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                parsed = [blocks_of(h.as_py()) if h.is_valid else [] for h in batch["html"]]
                good = own.scores(Features(parsed)) > 0 if any(parsed) else np.zeros(0, bool)
                texts, kept, at = [], [], 0
                for blocks in parsed:
                    mine = np.flatnonzero(good[at : at + len(blocks)])
                    at += len(blocks)
                    texts.append(" ".join(blocks[i].text for i in mine))
                    kept.append(mine)
                yield pa.RecordBatch.from_arrays(
                    [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([len(b) for b in parsed], pa.int64()), pa.array(kept, pa.list_(pa.int64()))],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "kept_blocks"],
                )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, kept_blocks array<long>")
