"""Elements inside a line, and long repeats on few pages."""

import random

from casemill.llm.html_text import ARTICLE, LONG, RUN, blocks, covered, main_text

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    rows = [(k, f"http://a.example/{k}", html) for k, html in enumerate(pages)]
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_elements_in_a_line():
    text = lambda html: [t for k, t in blocks(f"<article>{html}</article>") if k == ARTICLE]
    assert text('<p>Sales rose <a class="share">fast</a> in May.</p>') == ["Sales rose in May."]
    assert text("<p>Press <button>Go</button> or <label>Name <input></label> to start.</p>") == ["Press or to start."]
    assert text('<p>The <a class="share-price" href="x">share price</a> rose.</p>') == ["The share price rose."]
    assert text('<p>a <i class="ad">b <em>c</em></i> d <a class="nav"><div>e</div> f</a> g</p>') == ["a d", "g"]
    assert text('<p>a <a class="ad">b<p>c</p>') == ["a", "c"]
    assert text('<p>one <a class="ad">two</p><p>three</a> four</p>') == ["one", "three four"]
    assert text("<p>a<b>b</b><i>c</i></p>") == ["abc"]


def test_a_text_on_two_pages_stays(spark):
    rng = random.Random(5)
    paragraph = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(n))
    body = "".join(f"<p>{paragraph(60)}</p>" for _ in range(6))
    quotation, menu = paragraph(50), "home news sport weather travel music film books games"
    pages = [f"<div>{menu}</div>{body}<p>own ending {k}</p>" for k in range(2)]
    pages += [f"<div>{menu}</div><p>{paragraph(30)} {quotation} {paragraph(30)}</p>" for _ in range(2)]
    got = texts(spark, pages)
    plain = body.replace("<p>", "").replace("</p>", "\n")
    for k in (0, 1):
        assert got[k] == f"{plain}own ending {k}"
        assert got[k + 2] == pages[k + 2].split("<p>")[1].removesuffix("</p>")


def test_a_long_notice_on_many_pages_goes(spark):
    rng = random.Random(6)
    notice = " ".join(f"n{rng.randrange(1000)}" for _ in range(LONG + 30))
    got = texts(spark, [f"<div>{notice}</div><p>page {k} alone</p>" for k in range(12)])
    assert got == {k: f"page {k} alone" for k in range(12)}
    twice = texts(spark, [f"<div>{notice}</div><p>page {k % 2} alone</p>" for k in range(12)])  # copies of two pages
    assert twice == {k: f"{notice}\npage {k % 2} alone" for k in range(12)}


def test_covered():
    n = LONG + RUN
    assert covered([None] * 5, 12) == set() and covered([False, None], 9) == set(range(RUN))
    assert covered([False] * (n - RUN + 1), n) == set()
    assert covered([False] * 5 + [True] + [False] * (n - RUN - 5), n) == set(range(5, 5 + RUN))
    assert covered([False] * (LONG - RUN), 100) == set(range(LONG - 1))
