"""Main text of web pages by two passes of rules over blocks of text.

A page is cut into blocks at its block-level tags. The first pass decides what it can from a block's length, its share of
stop words and its share of linked text, and from what the markup says outright: menus, footers, forms, adverts, comments. The second pass
gives each block that is still open the label of the nearest decided blocks. Blocks of many pages are judged together in arrays;
Spark deals out the pages, and only their markup goes to Python.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm._shared import kept, q

#: Function words of the languages that are looked for; a parameter.
STOP_WORDS = tuple(
    "a an and are as at be by for from has have he his in is it its not of on or that the their this to was were which with you"
    " au aux avec ce dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour qui que se sont sur un une"
    " als am auch auf aus bei das dem den der die ein eine er es für im ist mit nach nicht oder sich sie sind und von war wie wird zu zum"
    " al como con del el entre esta este ha las lo los más muy no para pero por si sin sobre su sus también una y".split()
)
#: Elements whose content is no text of the page, read up to their end tag.
_RAW = "script|style|noscript|template|textarea|title|iframe|noembed|noframes|xmp|svg|math|object|canvas|audio|video"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({_RAW})(?=[\s/>])(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|(?![\"'])))*+>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden|href|itemprop)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
#: A start tag that ends an open element of these names, if none of the others lies between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements and roles that are never the article.
_OUT_TAGS = {"nav", "aside", "footer", "menu", "dialog", "button", "select", "search", "head"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "dialog", "alertdialog", "alert", "search", "form", "menu", "menubar", "toolbar"}
#: Words of a class or an id that say so.
_OUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup promo promotion recommended related replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tagcloud toolbar topbar widget".split()
)
#: Names by which pages without such elements mark their article.
_ARTICLE_NAMES = {"article", "article-body", "article-content", "article-text", "content", "entry", "entry-content", "main", "main-content", "post", "post-body", "post-content", "story", "story-body"}
_COMMENTS = {"comment", "comments", "replies", "reply", "respond", "responses", "disqus"}
#: First words of names that only tell what else is there, and words that make a header the article's own.
_TELLS, _OWN = {"has", "have", "no", "not", "with", "without"}, {"article", "entry", "post", "content", "story", "main"}
_COMMENT_HEADING = re.compile(r"(?:\(?\d+\)?\s+)?(?:leave a |reader |user |\w+ )?(?:comments?|replies|kommentare?|commentaires?|comentarios?)(?:\s*[:(]?\s*\d*\s*\)?)", re.I)
_HEADING = re.compile("h[1-6]").fullmatch
_WORD = re.compile(r"[-_\s]+|(?<=[a-z0-9])(?=[A-Z])")


class _Frame:
    """An open block-level element: whether its text is out (`by_form`: unless an article is in it), and the article that it
    lies in (0: none, below 0: a page's main part, in which articles can be)."""

    __slots__ = ("article", "by_form", "out", "tag")

    def __init__(self, tag: str, out: bool, article: int, by_form: bool):
        self.tag, self.out, self.article, self.by_form = tag, out, article, by_form


def _words_say_out(value: str, only: set[str]) -> bool:
    """Whether a class or an id has a name of the page's frame; `post-header` and `has-sidebar` are none, `post-footer` is."""
    for name in value.split():
        words = [w.lower() for w in _WORD.split(name) if w]
        if words and words[0] not in _TELLS and (only.intersection(words) or only is _OUT_WORDS and words[-1] == "header" and not _OWN.intersection(words)):
            return True
    return False


def _open(tag: str, attributes: str, above: _Frame, number: int) -> _Frame:
    out, article, by_form = above.out, above.article, above.by_form
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes or "hidden" in attributes else {}
    role = a.get("role", "").lower()
    named = a.get("class", "") + " " + a.get("id", "")
    whole = tag in ("html", "body")
    main = tag == "main" or role == "main" or tag in ("div", "section", "td") and not article and not _ARTICLE_NAMES.isdisjoint(named.lower().split())
    if (main or tag == "article" or role == "article" or "articleBody" in a.get("itemprop", "")) and not whole:
        inner = tag == "article" and article > 0  # articles inside an article are its readers' comments
        if inner or out and not by_form or _words_say_out(named, _COMMENTS):
            return _Frame(tag, True, article, False)
        return _Frame(tag, False, -number if main and not article else number if tag == "article" or not article else article, False)
    form = tag in ("form", "fieldset")
    if not whole and not out and (tag in _OUT_TAGS or tag == "header" and not article or form or role in _OUT_ROLES or "hidden" in a and a["hidden"].lower() != "until-found" or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I) or _words_say_out(named, _OUT_WORDS)):
        return _Frame(tag, True, article, form)
    return _Frame(tag, out, article, by_form)


def blocks(page: str) -> list[tuple[str, int, bool, bool, int]]:
    """The blocks of a page in order: (text, article it lies in or 0, out by its markup, heading, linked characters)."""
    found: list[tuple[str, int, bool, bool, int]] = []
    stack = [_Frame("", False, 0, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, link, heading, number = 0, -1, "", 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                found.append((text, top.article, top.out, bool(heading), min(linked, len(text))))
                if heading and heading != "h1" and len(text) < 40 and _COMMENT_HEADING.fullmatch(text) and len(stack) > 1:
                    stack[-2].out = True  # what follows beside the heading are comments
                    found[-1] = (text, top.article, True, True, 0)
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal link, heading
        opened.subtract(f.tag for f in stack[depth:])
        del stack[depth:]
        if link >= depth:
            link = -1
        heading = ""

    def text_of(lo: int, hi: int) -> None:
        nonlocal linked
        if lo < hi:
            piece = page[lo:hi]
            if "&" in piece:
                piece = html.unescape(piece)
            parts.append(piece)
            if link >= 0:
                linked += len(piece.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        text_of(at, m.start())
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        tag, ends = name.lower(), bool(m[2] or m[5])
        if tag == "a":
            link = -1 if ends or "href" not in (m[4] or m[7] or "").lower() else len(stack)
        elif tag == "br":
            parts.append(" ")
        elif tag not in _BLOCKS:
            continue
        elif ends:
            flush()
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
        else:
            flush()
            if stack[-1].tag == "p" or _HEADING(stack[-1].tag) and _HEADING(tag):
                close(len(stack) - 1)
            names, walls = _CLOSES.get(tag, ((), ()))
            if any(opened[x] > 0 for x in names):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in names:
                        close(i)
                        break
                    if stack[i].tag in walls:
                        break
            if tag in _VOID:
                continue
            number += 1
            opened[tag] += 1
            stack.append(_open(tag, m[4] or m[7] or "", stack[-1], number))
            heading = tag if _HEADING(tag) else ""
    text_of(at, len(page))
    flush()
    return found


def _nearest(decided: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block the places of the last decided one before it and of the first behind it in its group, or -1.

    `group` ascends; blocks of a group stand together.
    """
    n = len(decided)
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(decided, place, -1))
    behind = np.minimum.accumulate(np.where(decided, place, n)[::-1])[::-1]
    first = np.searchsorted(group, group, "left")
    last = np.searchsorted(group, group, "right")
    return np.where(before >= first, before, -1), np.where(behind < last, behind, -1)


def judged(page: np.ndarray, article: np.ndarray, out: np.ndarray, heading: np.ndarray, chars: np.ndarray, links: np.ndarray, words: np.ndarray, stops: np.ndarray, *, short: int = 70, stop_share: float = 0.2, link_share: float = 0.5) -> np.ndarray:
    """Which blocks are main text; all arrays have an entry for each block, pages in order.

    First pass. Out: by markup, or linked by `link_share` (in an article: linked almost wholly). Main text: `short` characters
    or more of which `stop_share` of the words are stop words. Outside of articles, as long ones of fewer stop words are out.
    Second pass. What is open takes the label of the nearest decided block on either side, a heading that of the one
    behind it. In an article only decided blocks of that article count, and what lies between none or different ones is main text.
    Where a page marks its article, and there is text in it, nothing beside it is main text.
    """
    n = len(page)
    within = article != 0
    linked = links / np.maximum(chars, 1)
    bad = out | np.where(within, linked > 0.9, linked > link_share)
    good = ~bad & (chars >= short) & (stops >= stop_share * words)
    bad |= ~good & ~within & (chars >= short) & (stops < stop_share / 2 * words)
    decided = good | bad
    label = good.copy()
    # an article's blocks are a group of their own, wherever other blocks lie between them; the others are grouped by page
    order = np.lexsort((np.arange(n), article, page)) if n else np.arange(0)
    both = np.stack((page[order], article[order])) if n else np.zeros((2, 0), np.int64)
    inner = np.cumsum(np.r_[0, np.any(both[:, 1:] != both[:, :-1], axis=0)]) if n else np.zeros(0, np.int64)
    for sel, group, seen in ((within[order], inner, decided[order]), (~within, page, decided)):
        lab = label[order] if group is inner else label
        before, behind = _nearest(seen, group)
        place = np.arange(n)
        has_b, has_f = before >= 0, behind >= 0
        lab_b, lab_f = lab[np.maximum(before, 0)], lab[np.maximum(behind, 0)]
        near_b = has_b & (~has_f | (place - before < behind - place))
        if group is inner:
            head = heading[order] & (behind == place + 1) & ~lab_f
            new = ~(has_b & has_f & ~lab_b & ~lab_f) & ~head
            label[order] = np.where(sel & ~seen, new, lab)
        else:
            even = has_b & has_f & (place - before == behind - place)
            new = np.where(even, lab_b | lab_f, np.where(near_b, lab_b, lab_f))
            new = np.where(heading & has_f, lab_f, new)
            new = np.where(has_b | has_f, new, True)  # nothing on the page is decided
            label = np.where(sel & ~seen, new, label)
    marked = page[label & within]  # where an article is marked, the rest of the page is none
    return label & (within | ~np.isin(page, marked))


def _texts(pages: list[str | None], stop: frozenset[str]) -> list[str]:
    rows = [(i, *b) for i, p in enumerate(pages) if p for b in blocks(p)]
    if not rows:
        return [""] * len(pages)
    page, text, article, out, heading, links = zip(*rows, strict=True)
    counts = np.zeros((len(rows), 2), np.int64)
    for k, (t, o) in enumerate(zip(text, out, strict=True)):
        if not o:
            words = t.lower().split(" ")
            counts[k] = len(words), sum(w.strip(".,;:!?()\"'«»„“”") in stop for w in words)
    main = judged(np.array(page), np.array(article), np.array(out), np.array(heading), np.array([len(t) for t in text]), np.array(links), counts[:, 0], counts[:, 1])
    found: list[list[str]] = [[] for _ in pages]
    for k in np.flatnonzero(main).tolist():
        found[page[k]].append(text[k])
    return [" ".join(f) for f in found]


def main_text(pages: DataFrame, *, html_col: str = "html", keep: list[str] | None = None, stop_words: tuple[str, ...] = STOP_WORDS, slice_chars: int = 4 << 20) -> DataFrame:
    """The kept columns, `text` (main text, empty if there is none) and `n_chars` (its code points).

    Pages are judged one by one, so repeated rows get equal texts, and ties can't occur. A null or empty page has the empty text; a page
    without decided blocks keeps all that its markup doesn't put out. Tags that are never closed end with the element around them, or with the page. A very long page is read whole,
    in time and memory in proportion to its length; pages are taken `slice_chars` characters at a time. An empty table stays empty.
    """
    stop = frozenset(stop_words)

    @F.pandas_udf("string")
    def text_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts: list[str] = []
            some: list[str | None] = []
            size = 0
            for page in part.tolist():
                some.append(page)
                size += len(page) if page else 0
                if size >= slice_chars:
                    texts += _texts(some, stop)
                    some, size = [], 0
            yield pd.Series(texts + _texts(some, stop), dtype="str")

    own = [F.col(q(c)) for c in kept(pages, keep, ("text", "n_chars"))]
    return pages.select(*own, text_of(F.col(q(html_col)).cast("string")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op13_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])


#: What the rules come to on these tables, where every page marks its article.
OP13_SQL = r"""
WITH inner_html AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS h FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(h, '<(br|/?p|/?h1|/?li|/?ul|/?div)>', ' ', 'g'), '<[^<>]*>', '', 'g'), '<[a-z/][^<>]*$', '', 'g') AS t FROM inner_html),
decoded AS (SELECT page_id, url, replace(replace(replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&#x27;', '''', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp', chr(1)) AS t FROM plain),
spaced AS (SELECT page_id, url, trim(regexp_replace(replace(replace(t, chr(1) || ';', '&'), chr(1), '&'), '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text)::bigint AS n_chars FROM spaced
"""
