from casemill.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">Menu</a></ul></nav>
<!-- ad --><div class="top ad">Buy</div><article class="post"><header><h1>Head &amp; line</h1></header><p><b>Bold  text<br><p>First&nbsp;para <i>with</i> <a href="?a>b">link</a>.</p><script>x<1</script>
<div id="cookie-notice">We use cookies</div><ul><li>one<li>two</ul><form><p>Send</form><aside>More</aside><table><tr><td>a</td><td>b &lt; c</td></tr></table><div class="comments"><p>me too</div>&#233;nd</article><footer>&copy; x</footer>"""


def test_main_text(spark):
    menu = "<div>home news sport weather travel music film books games</div>"
    rows = [
        (1, "http://a.example/1", PAGE, 1),
        (1, "http://a.example/1", PAGE, 1),
        (2, None, None, 1),
        (3, "", "", 1),
        (4, "http://b.example/1", f"{menu}<p>unique words of the first page stand here now all alone</p>", 1),
        (5, "http://b.example/2", f"{menu}<p>other words</p>tail", 1),
        (5, "http://b.example/2", f"{menu}<p>other words</p>tail", 1),
        (6, "http://c.example/2", f"{menu}<p>own host", 1),
        (7, "http://d.example/", "<nav>only menu</nav>", 1),
        (8, "http://d.example/", "<article><p>" + "long text " * 50_000, 1),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, main_text(pages).collect()), key=str)
    article = "Head & line\nBold text\nFirst para with link.\none\ntwo\na\nb < c\nénd"
    home = "home news sport weather travel music film books games\nown host"
    texts = {1: article, 2: "", 3: "", 4: "unique words of the first page stand here now all alone", 5: "other words\ntail", 6: home, 7: "", 8: ("long text " * 50_000).strip()}
    assert got == sorted([(i, u, texts[i], len(texts[i])) for i, u, *_ in rows], key=str)
    assert main_text(pages.limit(0)).count() == 0


def test_surroundings_of_marked_pages_are_evidence(spark):
    menu = "home news sport weather travel music film books games"
    rows = [(i, f"http://mixed.example/{i}", f"<nav>{menu}</nav><article><p>text {i}</article>") for i in range(3)]
    rows += [(9, "http://mixed.example/9", f"<div>{menu}</div><p>own words"), (10, "http://else.example/", f"<div>{menu}</div>")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "text 0", 1: "text 1", 2: "text 2", 9: "own words", 10: menu}
