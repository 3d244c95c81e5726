"""Main text of pages: markup rules, and repeats of a host against brute force."""

import random

import numpy as np
import pytest

from lorewell.llm import html_text

PAGES = "page_id long, url string, html string, text string, _key string, host string"


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, "clash", "k", "h") for i, u, h in rows], PAGES).repartition(3)
    out = {}
    for r in html_text.main_text(df).collect():
        assert r.n_chars == len(r.text)
        out.setdefault(r.page_id, []).append(r.text)
    return out


MARKUP = [
    ("İ" * 60 + "<script>x</script><article><p>after</p></article>", "after"),
    ("<article><p>a</p><SCRIPT>no</sCript ><p>b", "a\n\nb"),
    ("<div class='layout no-sidebar'><article><h1>t</h1><p>x</p></article></div>", "t\n\nx"),
    ("<form id=aspnet><div><article><p>x</p></article></div></form>", "x"),
    ("<article><div class='article-header'><h1>t</h1></div><div class='related-work'>r</div><p>x</p></article>", "t\n\nr\n\nx"),
    ("<article><div class='ad'>no</div><p>x</p><div class='comments'><article>no</article></div><form>no</form></article>", "x"),
    ("<article><p>a &amp; &eacute;&#233;<br>b<p>c</article><footer>no</footer>", "a & éé b\n\nc"),
    ("<article>1 < 2 <b>x</b> <!-- no > --> y</article>", "1 < 2 x y"),
    ("<article><a href='x>y'>l</a> <img alt=\"a > b\">z</article>", "l z"),
    ('<article>a <b title="x>c</b> d</article>', "a c d"),
    ("<main role=main><p>x</p></main>", "x"),
    (None, ""),
    ("", ""),
    ("<nav>only a menu</nav>", ""),
]


def test_markup(spark):
    got = texts(spark, [(i, f"http://h{i}/", h) for i, (h, _) in enumerate(MARKUP)])
    assert [got[i] for i in range(len(MARKUP))] == [[t] for _, t in MARKUP]


def test_broken_quotes_take_linear_time():
    for html in ('<a href="x ' * 50_000, "<a \">\" '" * 50_000 + " x", "<" * 200_000, "<p" * 100_000):
        html_text.blocks(html)


def brute(rows):
    """Texts by plain loops over every host's windows."""
    of_host = {}
    for _, url, html in rows:
        found = html_text.blocks(html or "")
        stream = [(t, w) for t, (z, x) in enumerate(found) if z != "article" for w in x.lower().split()]
        of_host.setdefault(url.split("/")[2], {})[tuple(w for _, w in stream)] = None
    out = {}
    for i, url, html in rows:
        streams = of_host[url.split("/")[2]]
        pages = {}
        for s in streams:
            for k in range(len(s) - html_text.RUN + 1):
                pages.setdefault(s[k : k + html_text.RUN], set()).add(s)
        need = min(html_text.MIN_PAGES, len(streams))
        found = html_text.blocks(html or "")
        stream = [(t, w) for t, (z, x) in enumerate(found) if z != "article" for w in x.lower().split()]
        words = tuple(w for _, w in stream)
        hit = set()
        for k in range(len(words) - html_text.RUN + 1):
            if need > 1 and len(pages[words[k : k + html_text.RUN]]) >= need:
                hit |= set(range(k, k + html_text.RUN))
        kept = []
        has_article = any(z == "article" for z, _ in found)
        for t, (z, x) in enumerate(found):
            mine = [k for k, (b, _) in enumerate(stream) if b == t]
            boiler = len(hit & set(mine)) >= html_text.COVERED * max(len(mine), 1)
            if z == "article" or (z == "doubt in article" or not has_article and z in ("open", "doubt")) and not boiler:
                kept.append(x)
        out.setdefault(i, []).append("\n\n".join(kept))
    return out


@pytest.mark.parametrize("hot,tokens", [(20_000, 500_000), (0, 500_000), (20_000, 30)])
def test_repeats_of_a_host(spark, monkeypatch, hot, tokens):
    monkeypatch.setattr(html_text, "HOT_PIECES", hot)
    monkeypatch.setattr(html_text, "SORT_TOKENS", tokens)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    line = lambda n: " ".join(word() for _ in range(n))
    menu, notice, quote, short = line(30), line(12), line(20), line(4)
    rows = []
    for i in range(24):
        host = f"http://h{i % 3}/{i}"
        parts = [f"<div>{menu}</div>" * (i % 5 != 0), f"<p>{line(rng.randrange(1, 40))}</p>", f"<p>{short}</p>"]
        parts += [f"<div class='page-notice'>{notice}</div>", f"<p>{quote}</p>" * (i in (3, 6)), f"<p>{line(9)} {notice}</p>"]
        if i % 4 == 0:
            parts = [f"<article><p>{quote}</p><div class='x-menu'>{notice}</div><p>{line(20)}</p></article>", *parts]
        rows.append((i, host, "".join(parts)))
    rows += [(100, "http://two/1", f"<p>{menu}</p><p>{line(9)}</p>"), (101, "http://two/2", f"<p>{menu}</p><p>{line(9)}</p>")]
    rows += [(102, "http://same/1", f"<p>{menu}</p>"), (103, "http://same/2", f"<p>{menu}</p>"), (103, "http://same/2", f"<p>{menu}</p>")]
    rows += [(104, "http://h0/none", None)]
    got, want = texts(spark, rows), brute(rows)
    assert got == want
    assert menu not in got[1][0] and menu in got[102][0] and quote in got[3][0] and got[100][0] == rows[24][2].split("<p>")[2][:-4]


def brute_articles(rows):
    """Texts of pages that have articles, by plain loops over every host's articles."""
    articles, out = {}, {}
    for i, url, html in rows:
        found = [x for z, x in html_text.blocks(html) if z == "article"]
        articles.setdefault(url.split("/")[2], {}).setdefault(tuple(w for x in found for w in x.lower().split()), []).append((i, found))
    for of_host in articles.values():
        on = {}
        for words in of_host:
            for k in range(len(words) - html_text.RUN + 1):
                on.setdefault(words[k : k + html_text.RUN], set()).add(words)
        need = max(html_text.MIN_ARTICLES, len(of_host) / 2)
        for words, pages in of_host.items():
            hit = set()
            for k in range(len(words) - html_text.RUN + 1):
                if len(on[words[k : k + html_text.RUN]]) >= need:
                    hit |= set(range(k, k + html_text.RUN))
            for i, found in pages:
                kept, gone, at = [], 0, 0
                for x in found:
                    n = len(x.split())
                    boiler = sum(k in hit for k in range(at, at + n)) >= html_text.COVERED * n
                    at, gone = at + n, gone + n * boiler
                    kept += [] if boiler else [x]
                out.setdefault(i, []).append("\n\n".join(found if gone > html_text.ARTICLE_SHARE * at else kept))
    return out


@pytest.mark.parametrize("part", [1_000_000, 1])
def test_repeats_judge_articles(spark, monkeypatch, part):
    monkeypatch.setattr(html_text, "PART_TOKENS", part)
    rng = random.Random(7)
    line = lambda n, of=400: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    notice, copied = line(14), line(80)
    rows = []
    for i in range(40):
        own = [f"<p>{line(rng.randrange(20, 60))}</p>" for _ in range(3)]
        mine = f"<p>{line(2)} {notice}</p>"
        rows += [
            (i, f"http://most/{i}", f"<nav>{line(9)}</nav><article><h1>{line(3)}</h1>{own[0]}{mine * (i % 3 != 0)}{own[1]}{own[2]}</article>"),
            (100 + i, f"http://few/{i}", f"<article>{own[1]}{own[2]}{mine * (i % 3 == 0)}{own[0]}</article>"),
            (200 + i, f"http://copies/{i}", f"<article><p>{copied}</p>{own[0]}</article><footer>{notice}</footer>"),
        ]
    rows += [(300 + i, f"http://small/{i}", f"<article><p>{line(90)}</p><p>{notice}</p></article>") for i in range(9)]
    rows += [(400 + i, "http://equal/", f"<article><p>{line(1, 1)} {copied}</p><p>{notice}</p></article>") for i in range(30)]
    got, want = texts(spark, rows), brute_articles(rows)
    assert got == want
    has = lambda a: sum(notice in got[i][0] for i in range(a, a + 40) if i in got)
    assert has(0) == 0 and has(100) == 14 and has(300) == 9 and has(400) == 30
    assert all(copied in got[200 + i][0] for i in range(40))


def test_often_strings():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 20):
        articles = [rng.integers(0, 2, rng.integers(1, 60)).astype(np.int32) for _ in range(n)]
        on = {}
        for k, a in enumerate(articles):
            for w in range(len(a) - html_text.RUN + 1):
                on.setdefault(tuple(a[w : w + html_text.RUN].tolist()), set()).add(k)
        want = [np.array(w, np.int32) for w, pages in on.items() if 2 * len(pages) >= n]
        hashes = [html_text._string_hashes(w, np.array([0, html_text.RUN]))[0][0] for w in want]
        assert sorted(html_text.often_strings(articles).tolist()) == sorted(hashes)
    assert not len(html_text.often_strings([np.zeros(3, np.int32)]))
