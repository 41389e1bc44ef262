import html
import random

import numpy as np
import pytest

from opinara.llm.html_text import STOP_WORDS, _texts, blocks, judged, main_text, op13_main_text

STOP = frozenset(STOP_WORDS)


def story(k):
    return f"Part {k} of the story is about the way that the people in the town have been in the habit of talking to it and the others."


def advert(k):
    return f"Thing {k} is the best of the goods that you have been waiting for in the last years and it is in the store for you and your own."


def text(page):
    return _texts([page], STOP)[0]


def brute_labels(page, article, out, heading, chars, links, words, stops):
    """The rules of `judged`, block by block."""
    n, label, decided = len(page), [], []
    for i in range(n):
        linked, within = links[i] / max(chars[i], 1), article[i] != 0
        bad = out[i] or (linked > 0.9 if within else linked > 0.5)
        good = not bad and chars[i] >= 70 and stops[i] >= 0.2 * words[i]
        bad = bad or (not good and not within and chars[i] >= 70 and stops[i] < 0.1 * words[i])
        label.append(good)
        decided.append(good or bad)
    got = list(label)
    for i in range(n):
        if decided[i]:
            continue
        group = [j for j in range(n) if page[j] == page[i] and (article[i] == 0 or article[j] == article[i])]
        at = group.index(i)
        before = next((k for k in range(at - 1, -1, -1) if decided[group[k]]), None)
        behind = next((k for k in range(at + 1, len(group)) if decided[group[k]]), None)
        b, f = before is not None and label[group[before]], behind is not None and label[group[behind]]
        if article[i]:
            got[i] = not (before is not None and behind is not None and not b and not f) and not (heading[i] and behind == at + 1 and not f)
        elif before is None and behind is None:
            got[i] = True
        elif behind is not None and (heading[i] or before is None):
            got[i] = f
        elif behind is None:
            got[i] = b
        else:
            got[i] = b or f if at - before == behind - at else b if at - before < behind - at else f
    marked = {p for p, a, g in zip(page, article, got, strict=True) if a != 0 and g}
    return [g and (a != 0 or p not in marked) for p, a, g in zip(page, article, got, strict=True)]


def test_labels_as_block_by_block():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 40, 400):
        page = np.sort(rng.integers(0, max(1, n // 12), n))
        article = np.where(rng.random(n) < 0.5, 0, rng.integers(-2, 3, n))
        out, heading = rng.random(n) < 0.2, rng.random(n) < 0.2
        chars = rng.integers(1, 160, n)
        links = np.where(rng.random(n) < 0.3, chars, 0)
        words = chars // 5 + 1
        stops = rng.binomial(words, rng.random(n) * 0.4) if n else words
        args = (page, article, out, heading, chars, links, words, stops)
        assert judged(*args).tolist() == [bool(x) for x in brute_labels(*args)]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<header><p>{advert(1)}</p></header><nav><a href=x>Home</a></nav><main><article class='post has-sidebar'><header class='entry-header'><h1>Headline</h1></header><p>{story(1)}<p>Short.<div class=ad>{advert(2)}</div><p>{story(2)}</p><ul><li>one<li>two</ul><footer>tags</footer></article><section id=comments><h2>3 Comments</h2><p>{advert(3)}</p></section></main><aside>{advert(4)}</aside><form>{advert(5)}</form><div id=cookie-notice>{advert(6)}</div>", f"Headline {story(1)} Short. {story(2)} one two"),
        (f"<div><a href=/>Home</a> | <a href=/b>About us</a></div><div><h1>Headline</h1><p>{story(1)}</p><p>Short.</p><p>{story(2)}</p></div><ul><li><a href=1>one two three</a><li><a href=2>four</a></ul><div>(c) 2020</div><h3>Comments</h3><p>{advert(2)}</p>", f"Headline {story(1)} Short. {story(2)}"),
        ("<nav><a href=x>x</a></nav><div class=ad>En laleenéelle la des et.</div><article><h1>De</h1><p><b>De.</b></article><footer>&copy; x</footer>", "De De."),
        (f"<article><h1>A &amp b&am</h1><p>{story(1)}<p>tail <b", f"A & b&am {story(1)} tail"),
        (f"<article><p>{story(1)}</p><article><p>{advert(1)}</p></article><p>{story(2)}</p><div style='display:none'>{advert(2)}</div></article>", f"{story(1)} {story(2)}"),
        (f"<form><div class=menu><a href=x>a</a></div><article><p>{story(1)}</p></article></form>", story(1)),
        (f"<div role=main><p>{story(1)}</p></div><p>after</p><div class=newsletter>{advert(1)}</div>", story(1)),
        (f"<div class='content'><h1>Head</h1><p>{'qx zw ' * 30}</p><p>{story(1)}</p></div><div>{advert(1)}</div>", f"Head {'qx zw ' * 30}{story(1)}"),
        (f"<p>{'qx zw ' * 30}</p><p>{story(1)}</p><h2>More</h2><p><a href=x>{advert(1)}</a></p>", story(1)),
        ("<p>a &lt; b, 1 < 2 &#233;&nbsp;x<!-- c --><p title='a>b'>q\t\n r<script>var t='</p>';</script>", "a < b, 1 < 2 é x q r"),
        ("<p>in<b>li</b>ne<br>break", "inline break"),
        ("<script>never closed <p>text", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_planted_pages(page, expected):
    assert text(page) == expected


def test_long_and_deep_pages_take_time_in_proportion():
    parts = [story(k) for k in range(20_000)]
    assert text("<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>") == " ".join(parts)
    assert text("<div>" * 20_000 + story(1) + "</p>" * 20_000) == story(1)
    assert len(blocks("<p class=\"a" * 20_000)) <= 1


def test_text_between_random_tags_is_whole():
    rng = random.Random(1)
    for _ in range(50):
        words = [f"w{rng.randrange(99)}<&" for _ in range(rng.randrange(1, 30))]
        page = "<article>" + "".join(f"{rng.choice(['<p>', '<div>', '</div>', '<li>', '</p>', '<td>', '<h2>'])}{html.escape(w)} " for w in words)
        assert text(page) == " ".join(words)


def test_query_and_odd_tables(spark):
    rows = op13_main_text(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert all(r.n_chars == len(r.text) for r in rows) and all(r.text for r in rows)
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "<p>😀 b</p>", "x"), (1, "u", "<p>😀 b</p>", "x")], "page_id long, url string, html string, text string")
    out = main_text(odd)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in out.collect()) == [("", 0), ("", 0), ("😀 b", 3), ("😀 b", 3)]
    assert main_text(odd.limit(0)).count() == 0
