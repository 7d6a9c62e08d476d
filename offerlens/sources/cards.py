"""Offer cards of listing pages: one row per card, read in Arrow batches.

The parser only finds cards and their raw texts; prices, links and filters are
DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..dims import LISTING_CATEGORIES, SHOP_HOSTS
from ..functions import prices
from ..functions.features import absolute_url, link_id
from ..functions.numeric import strip
from ..functions.titles import crawl_is_gaming, first_word

VOID = {"img", "br", "hr", "input", "meta", "link", "source", "area", "base", "col", "embed", "track", "wbr"}
#: Open elements that a start tag ends.
ENDED_BY = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
FIELDS = ["title", "price_text", "price_label", "old_text", "discount", "href", "image", "image_late"]
CARD_SCHEMA = "url string, place int, " + ", ".join(f"{f} string" for f in FIELDS)


#: Cards of an output batch.
CARDS = 2000


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def walk(self):
        """Elements below, in document order; a stack of its own, so that nesting may be of any depth."""
        waiting = self.children[::-1]
        while waiting:
            child = waiting.pop()
            if isinstance(child, Element):
                yield child
                waiting += child.children[::-1]

    def text(self) -> str:
        """Text below; each element's own text is trimmed."""
        done: list[str] = []
        waiting: list[tuple[Element, int, list[str]]] = [(self, 0, [])]
        while waiting:
            element, at, parts = waiting.pop()
            while at < len(element.children) and isinstance(element.children[at], str):
                parts.append(element.children[at])
                at += 1
            if at < len(element.children):
                waiting += [(element, at + 1, parts), (element.children[at], 0, [])]
                continue
            own = "".join(parts).strip()
            (waiting[-1][2] if waiting else done).append(own)
        return done[0]

    def has(self, *classes: str) -> bool:
        own = (self.attrs.get("class") or "").split()
        return all(c in own for c in classes)

    def inside(self, test) -> bool:
        up = self.parent
        while up is not None:
            if test(up):
                return True
            up = up.parent
        return False


class Page(HTMLParser):
    """Element tree of one page; unclosed tags end with their parent, or where the next of their kind begins."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.feed(html or "")
        self.close()

    def cards(self, reader) -> list[dict]:
        """What a reader finds; the tree's links go afterwards, since parents and children hold each other until a collection."""
        found = reader(self.root)
        for e in [self.root, *self.root.walk()]:
            e.parent, e.children = None, []
        return found

    def handle_starttag(self, tag, attrs):
        if self.at.tag in ENDED_BY.get(tag, ()):
            self.at = self.at.parent
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        up = self.at
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def first(root: Element, *tests) -> Element | None:
    """First element that passes the first test with a match."""
    for test in tests:
        for e in root.walk():
            if test(e):
                return e
    return None


def _class_has(e: Element, part: str) -> bool:
    return part in e.attrs.get("class", "")


def _jumia(page: Element) -> list[dict]:
    out = []
    for card in (e for e in page.walk() if e.tag == "article" and e.has("prd")):
        name, price = first(card, lambda e: e.has("name")), first(card, lambda e: e.has("prc"))
        link = first(card, lambda e: e.tag == "a" and e.has("core"))
        old, cut = first(card, lambda e: e.has("old")), first(card, lambda e: e.has("tag", "_dsct"))
        img = first(card, lambda e: e.tag == "img")
        if name is None or price is None:
            continue
        out.append({
            "title": name.text(), "price_text": price.text(), "old_text": old.text() if old else None,
            "discount": cut.text() if cut else None, "href": link.attrs.get("href", "") if link else "",
            "image": img.attrs.get("src") if img else None, "image_late": img.attrs.get("data-src") if img else None,
        })
    return out


def _amazon(page: Element) -> list[dict]:
    out = []
    for card in (e for e in page.walk() if e.attrs.get("data-component-type") == "s-search-result" and e.tag == "div"):
        in_h2 = lambda e: e.inside(lambda u: u.tag == "h2")
        title = first(
            card, lambda e: e.tag == "span" and in_h2(e) and e.inside(lambda u: u.tag == "a"),
            lambda e: e.tag == "span" and in_h2(e),
        )
        price = first(card, lambda e: e.has("a-offscreen") and e.inside(lambda u: u.has("a-price")))
        whole = first(card, lambda e: e.has("a-price-whole"))
        link = first(card, lambda e: e.tag == "a" and in_h2(e), lambda e: e.tag == "a" and e.has("a-link-normal", "s-no-outline"))
        img = first(card, lambda e: e.tag == "img" and e.has("s-image"))
        if title is None:
            continue
        out.append({
            "title": title.text(), "price_text": price.text() if price else None,
            "price_label": whole.text() if whole else None, "href": link.attrs.get("href") if link else None,
            "image": img.attrs.get("src") if img else None,
        })
    return out


def _aliexpress(page: Element) -> list[dict]:
    kinds = ("search-card-item", "multi--card--", "product-container")
    is_item = lambda e: e.tag == "a" and "/item/" in e.attrs.get("href", "")
    cards = [e for e in page.walk() if e.tag == "div" and any(_class_has(e, k) for k in kinds)]
    cards = cards or [e for e in page.walk() if is_item(e)]
    out = []
    for card in cards:
        title = first(card, lambda e: e.tag == "h3" or (e.tag in ("div", "span") and _class_has(e, "title")))
        price = first(card, lambda e: e.has("lw_el"))
        link = first(card, is_item) or (card if card.attrs.get("href") else None)
        img = first(card, lambda e: e.tag == "img")
        out.append({
            "title": title.text() if title else "", "price_label": price.attrs.get("aria-label") if price else None,
            "price_text": price.text() if price else None, "href": link.attrs.get("href") if link else None,
            "image": img.attrs.get("src") if img else None, "image_late": img.attrs.get("data-src") if img else None,
        })
    return out


READERS = {"Jumia": _jumia, "Amazon": _amazon, "AliExpress": _aliexpress}


def read_cards(pages: DataFrame, shop: str) -> DataFrame:
    """Raw cards of ``pages(url, html)``; ``place`` counts them within their page.

    Pages are read one by one, and cards leave in batches of their own size, so that a task holds one page's tree beside the batch
    of pages that Spark sends.
    """
    reader = READERS[shop]
    kinds = {"url": pa.string(), "place": pa.int32(), **dict.fromkeys(FIELDS, pa.string())}

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), kinds.values())], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for url, html in zip(batch["url"], batch["html"]):
                name = url.as_py()
                found += [(name, i, *[card.get(f) for f in FIELDS]) for i, card in enumerate(Page(html.as_py()).cards(reader))]
                while len(found) >= CARDS:
                    yield table(found[:CARDS])
                    del found[:CARDS]
            if found:
                yield table(found)

    return pages.select("url", "html").mapInArrow(run, CARD_SCHEMA)


def _or_na(column):
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("N/A"))


def jumia_offers(pages: DataFrame, family: str = "laptop") -> DataFrame:
    """Offers of Jumia pages; card prices are digits only."""
    cards = read_cards(pages, "Jumia")
    out = cards.select(
        "url", "place", "title", prices.digits_price(F.col("price_text")).alias("price"),
        F.when(F.col("old_text").isNotNull(), prices.digits_price(F.col("old_text"))).alias("old_price"), "discount",
        first_word(F.col("title")).alias("brand"), F.lit("Jumia").alias("source"),
        # only the http test applies here, other links get the host in front
        F.when(F.col("href").startswith("http"), F.col("href"))
        .otherwise(F.concat(F.lit(SHOP_HOSTS["Jumia"]), F.col("href"))).alias("link"),
        F.coalesce(F.nullif(F.col("image_late"), F.lit("")), F.col("image"), F.lit("")).alias("image"),
        crawl_is_gaming(F.col("title"), ("gaming",) if family == "laptop" else ("gaming", "gamer")).alias("is_gaming"),
    )
    if family == "laptop":
        return out.drop("old_price", "discount")
    out = out.withColumn("category", F.lit(LISTING_CATEGORIES[family])).withColumn("in_stock", F.lit(True))
    if family == "mouse":
        return out.withColumn("product_id", link_id(F.col("link")))
    out = out.drop("old_price", "discount").withColumn("currency", F.lit("MAD"))
    return out.drop("is_gaming") if family in ("usb", "cooling") else out


def amazon_offers(pages: DataFrame, family: str = "laptop") -> DataFrame:
    """Offers of Amazon pages: laptop prices stay text, accessory prices are EUR numbers."""
    cards = read_cards(pages, "Amazon")
    host = SHOP_HOSTS["Amazon"]
    link = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(host), F.col("href")))
    if family == "laptop":
        text = F.coalesce("price_text", F.lit(""))
        price, currency = prices.card_price_text(text), prices.card_currency(text)
        words: tuple[str, ...] = ("gaming",)
    else:
        price = prices.card_accessory_price(strip(F.coalesce("price_text", "price_label")))
        currency, words = F.lit("EUR"), ("gaming", "gamer", "rog", "alienware")
    out = cards.select(
        "url", "place", "title", price.alias("price"), currency.alias("currency"),
        first_word(F.col("title")).alias("brand"), F.lit("Amazon").alias("source"),
        F.coalesce(F.when(F.col("href") != "", link), F.lit("N/A")).alias("link"), _or_na(F.col("image")).alias("image"),
        crawl_is_gaming(F.col("title"), words).alias("is_gaming"),
    )
    if family == "laptop":
        return out
    return out.withColumn("category", F.lit(LISTING_CATEGORIES[family])).withColumn("in_stock", F.lit(True))


def aliexpress_offers(pages: DataFrame, family: str = "laptop") -> DataFrame:
    """Offers of AliExpress pages; empty titles and the shop's own banners drop out."""
    cards = read_cards(pages, "AliExpress").where((F.col("title") != "") & ~F.col("title").contains("AliExpress"))
    raw = F.coalesce(F.nullif(F.col("price_label"), F.lit("")), F.col("price_text"))
    image = F.coalesce(F.nullif(F.col("image"), F.lit("")), F.nullif(F.col("image_late"), F.lit("")))
    image = F.when(image.startswith("//"), F.concat(F.lit("https:"), image)).otherwise(image)
    words = ("gaming",) if family == "laptop" else ("gaming", "gamer")
    out = cards.withColumn("_raw", raw).select(
        "url", "place", "title", prices.marketplace_price(F.col("_raw")).alias("price"),
        prices.detect_currency(F.col("_raw")).alias("currency"), first_word(F.col("title")).alias("brand"),
        F.lit("AliExpress").alias("source"),
        F.coalesce(F.when(F.col("href") != "", absolute_url(F.col("href"), SHOP_HOSTS["AliExpress"])), F.lit("N/A")).alias("link"),
        F.coalesce(image, F.lit("N/A")).alias("image"), crawl_is_gaming(F.col("title"), words).alias("is_gaming"),
    )
    if family == "laptop":
        return out
    return out.withColumn("category", F.lit(LISTING_CATEGORIES[family])).withColumn("in_stock", F.lit(True))
