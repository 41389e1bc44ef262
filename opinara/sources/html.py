"""Reviews from product pages: a small HTML reader per page, everything after it in native columns."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import strip
from opinara.functions.vocab import FURNITURE_PARTS, FURNITURE_STARTS, MONTHS, MONTHS_RO, REVIEW_CLASS_WORDS
from opinara.operators.ingest import first_rows

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    __slots__ = ("tag", "attrs", "classes", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.classes = (attrs.get("class") or "").split()

    def walk(self) -> Iterator[_Node]:
        """All nodes below, in the document's order; with a stack, as pages can be nested deeper than calls."""
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, _Node):
                yield c
                todo += c.children[::-1]

    def pieces(self) -> Iterator[str]:
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in ("script", "style"):
                todo += c.children[::-1]

    def text(self) -> str:
        return "".join(p.strip() for p in self.pieces())

    def inside(self, name: str) -> bool:
        node = self.parent
        while node is not None and name not in node.classes and name != node.tag:
            node = node.parent
        return node is not None


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


# Selectors, tried in order: tag, class, part of a class, attribute (name, value), or a class below another one.
_BY = {
    "tag": lambda n, x: n.tag == x,
    "class": lambda n, x: x in n.classes,
    "part": lambda n, x: x in (n.attrs.get("class") or ""),
    "attr": lambda n, x: n.attrs.get(x[0]) == x[1],
    "below": lambda n, x: x[1] in n.classes and n.inside(x[0]),
    "tag_class": lambda n, x: n.tag == x[0] and x[1] in n.classes,
    "tag_attr": lambda n, x: n.tag == x[0] and n.attrs.get(x[1]) == x[2],
    "has": lambda n, x: x in n.attrs,
    "below_tag": lambda n, x: n.tag == "p" and n.inside(x),
}
# Where the two shops' pages and others keep a product's name and its reviews.
NAMES = {
    "emag": [("tag_class", ("h1", "page-title")), ("tag_attr", ("h1", "itemprop", "name")), ("class", "page-title"), ("tag_class", ("h1", "product-title")), ("tag", "h1")],
    "cel": [("tag_class", ("h1", "product_title")), ("tag_attr", ("h1", "itemprop", "name")), ("class", "product-name"), ("tag", "h1")],
    "generic": [("tag", "h1")],
}
BLOCKS = {
    "emag": [("class", "product-review-item"), ("class", "js-review-item"), ("part", "product-review-item"), ("part", "js-review-item"), ("below", ("card-body", "review-comment-item")), ("class", "pdp-reviews-item"), ("class", "review-item"), ("class", "customer-review"), ("attr", ("itemprop", "review")), ("part", "ReviewItem"), ("class", "em-review-item")],
    "cel": [("class", "review"), ("class", "customer-review"), ("part", "review-item")],
}
BODIES = {
    "emag": [[("class", "js-review-body"), ("class", "review-body-container")], [("class", "product-review-body"), ("class", "review-text"), ("class", "review-body"), ("class", "review-content"), ("attr", ("itemprop", "reviewBody")), ("class", "customer-review-text")]],
    "cel": [[("class", "review-text"), ("class", "comment-text"), ("tag", "p")]],
}
# Parts of a review block that are no text, how such parts begin, and words of a specification.
META_CLASSES = ["product-review-author", "product-review-user", "product-review-head", "product-review-title", "review-meta", "star-rating", "product-review-user-avatar"]
BODY_STARTS = ("Detii", "Review", "stele", "Adauga", "clienti", "Spune", "Ai")
SPECIFICATION_WORDS = ["caracteristici", "specificatii", "detalii"]


def _first(node: _Node, selectors: list) -> _Node | None:
    """The first match of the first selector that has one."""
    for kind, x in selectors:
        for n in node.walk():
            if _BY[kind](n, x):
                return n
    return None


def _any(node: _Node, selectors: list) -> list[_Node]:
    """All nodes that match any selector, in the document's order."""
    return [n for n in node.walk() if any(_BY[kind](n, x) for kind, x in selectors)]


def _blocks(root: _Node, site: str, own: list | None) -> list[_Node]:
    if own:
        return _any(root, own)
    if site == "cel":
        return _any(root, BLOCKS["cel"])
    if site == "emag":
        for selector in BLOCKS["emag"]:
            if found := _any(root, [selector]):
                return found
        return [n for n in _any(root, [("class", "card-body")]) if len(n.text()) > 50 and not any(w in n.text().lower() for w in SPECIFICATION_WORDS)]
    return [n for word in REVIEW_CLASS_WORDS for n in [x for x in root.walk() if any(word in c.lower() for c in x.classes)][:20]]


def _body(block: _Node, site: str) -> _Node | None:
    for group in BODIES[site]:
        if found := _any(block, group):
            return found[0]
    if site == "emag":
        for n in block.walk():
            if n.tag in ("div", "p") and not any(m in " ".join(n.classes) for m in META_CLASSES):
                text = n.text()
                if len(text) >= 20 and not text.startswith(BODY_STARTS):
                    return n
    return None


def read_page(html: str | None, site: str, own: list | None = None) -> list[dict]:
    """A page's blocks as they stand: nothing is judged here."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    heading = _first(reader.root, NAMES[site])
    name, out = heading.text() if heading else "Unknown Product", []
    for pos, block in enumerate(_blocks(reader.root, site, own)):
        body = block if own or site == "generic" else _body(block, site)
        if body is None:
            continue
        title = _any(block, [("class", "product-review-title"), ("tag", "h3")]) if site == "emag" else []
        stars = _first(block, [("class", "star-rating")])
        rated = next((c for c in stars.classes if c.startswith("rated-")), None) if stars else None
        filled = [n for n in block.walk() if "star-filled" in n.classes or ("fa-star" in n.classes and "fa-star-o" not in n.classes and n.inside("rating-stars"))]
        data = _first(block, [("has", "data-rating")])
        near = _any(block, [("part", "rating"), ("part", "star")])
        out.append({"pos": pos, "product_name": name, "title": title[0].text() if title else None, "body": body.text(), "block_text": "".join(block.pieces()), "rated_class": rated, "filled": len(filled), "data_rating": data.attrs.get("data-rating") if data else None, "rating_text": "".join(near[0].pieces()) if near else None})
    return out


def detect_site(url: Column, site_type: Column) -> Column:
    """An explicit type wins, else the URL tells; anything but the two known shops is generic."""
    given = F.nullif(F.lower(site_type), F.lit(""))
    kind = F.coalesce(given, F.when(F.lower(url).contains("emag.ro"), "emag").when(F.lower(url).contains("cel.ro"), "cel"))
    return F.when(kind.isin("emag", "cel"), kind).otherwise("generic")


def parse_rating(site: Column) -> Column:
    """From the columns of read_page: a class rated-N, filled stars, data-rating, "N of 5" in the text (not clamped), else 5.

    cel: the first number near the stars, else 3; generic: 3.
    """
    clamp = lambda c: F.when(c.isNotNull(), F.least(F.lit(5), F.greatest(F.lit(1), c)))
    rated = F.expr("try_cast(nullif(regexp_extract(rated_class, '^rated-([+-]?[0-9]+)(?:-.*)?$', 1), '') AS INT)")
    data = F.expr("try_cast(try_cast(data_rating AS DOUBLE) AS INT)")
    said = F.expr("try_cast(nullif(regexp_extract(block_text, '([0-9])\\\\s*(?:out\\\\s*of\\\\s*5|/\\\\s*5|din\\\\s*5)', 1), '') AS INT)")
    emag = F.coalesce(clamp(rated), F.when(F.col("filled") > 0, clamp(F.col("filled").cast("int"))), clamp(data), said, F.lit(5))
    number = F.expr("try_cast(nullif(regexp_extract(rating_text, '([0-9]+)', 1), '') AS INT)")
    return F.when(site == "emag", emag).when(site == "cel", F.coalesce(clamp(number), F.lit(3))).otherwise(F.lit(3))


def parse_review_date(text: Column) -> Column:
    """'18 Dec 2025' or '18 decembrie 2025' in a text; an impossible day is tried by the next pattern, then null."""
    found = []
    for names in (MONTHS, MONTHS_RO):
        pattern = rf"(\d{{1,2}})\s+({'|'.join(names)})\s+(\d{{4}})"
        month = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, f"{i + 1:02d}")))
        parts = [F.regexp_extract(text, pattern, i) for i in (3, 2, 1)]
        stamp = F.concat_ws("-", parts[0], F.try_element_at(month, parts[1]), F.lpad(parts[2], 2, "0"))
        found.append(F.when(parts[0] != "", F.try_to_date(stamp, "yyyy-MM-dd")))
    return F.coalesce(*found)


def filter_candidates(df: DataFrame) -> DataFrame:
    """review_title and review_text of blocks that are reviews: not too short or long, no page furniture."""
    body = strip(F.regexp_replace("body", r"(?i)Review (cumparator|utilizator) eMAG", ""))
    use_title = (F.col("site") == "emag") & (body == "") & (F.coalesce("title", F.lit("")) != "")
    df = df.withColumns({"review_text": F.when(F.col("site") == "emag", F.when(use_title, F.col("title")).otherwise(body)).otherwise(F.col("body")), "review_title": F.when(use_title, F.lit(None)).otherwise(F.nullif("title", F.lit("")))})
    text, n = F.col("review_text"), F.char_length("review_text")
    furniture = F.lit(False)
    for s in FURNITURE_STARTS:
        furniture = furniture | text.startswith(s)
    for p in FURNITURE_PARTS:
        furniture = furniture | text.contains(p)
    furniture = furniture | text.rlike(r"^\d+%") | text.rlike(r"^\d+\s*stele?\(") | ~text.contains(" ")
    return df.where(F.when(F.col("site") == "emag", (n >= 20) & ~furniture).when(F.col("site") == "cel", n >= 10).otherwise(n.between(10, 1000)))


def extract_reviews(pages: DataFrame, now: Column, *, site_type: Column | None = None, blocks: list | None = None, most: int = 20) -> DataFrame:
    """(page_id, pos, product_name, review_title, review_text, rating, review_date, source) of pages (page_id, url, html).

    blocks: selectors to use instead of the site's own. Of a page's blocks the first `most` are looked at (for unknown sites: per
    class word). A missing date is `now`. Empty and broken pages give no rows.
    """
    site = detect_site(F.col("url"), site_type if site_type is not None else F.lit(None).cast("string"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [{"page_id": p, "site": s} | r for p, s, h in zip(pdf.page_id, pdf.site, pdf.html, strict=True) for r in read_page(h, s, blocks)]
            yield pd.DataFrame(rows, columns=["page_id", "site", "pos", "product_name", "title", "body", "block_text", "rated_class", "filled", "data_rating", "rating_text"])

    found = pages.select("page_id", site.alias("site"), "html").mapInPandas(read, "page_id long, site string, pos int, product_name string, title string, body string, block_text string, rated_class string, filled int, data_rating string, rating_text string")
    capped = first_rows(found, ["page_id"], "pos", most * (len(REVIEW_CLASS_WORDS) if blocks is None else 1)).where((F.col("site") == "generic") | (F.col("pos") < most))
    date = F.when(F.col("site") == "emag", F.coalesce(parse_review_date(F.col("block_text")).cast("timestamp_ntz"), now)).otherwise(now)
    return filter_candidates(capped).select("page_id", "pos", "product_name", "review_title", "review_text", parse_rating(F.col("site")).alias("rating"), date.alias("review_date"), F.col("site").alias("source"))
