"""A second implementation on trees that are never parsed, odd markup, and names that say only a part."""

import random
import time
from collections import defaultdict
from html import escape

import numpy as np

from casemill.llm.html_text import ARTICLE, RUN, blocks, main_text, runs, suffix_runs

NAMES = {"": None, "body-text": None, "share-price": "doubt", "related-work": "doubt", "comment-on-law": "doubt", "comment-list": "around", "big cookie": "around", "ad-slot-3": "around"}
BLOCK, INLINE, ALWAYS = ("div", "section", "p", "ul"), ("span", "b"), ("nav", "aside", "footer", "form")
SCHEMA = "page_id long, url string, html string"


def tree(rng, words, menus, depth=0):
    children = []
    for _ in range(rng.randrange(1, 4)):
        roll = rng.random()
        if roll < 0.45 or depth > 2:
            children.append(rng.choice(menus) if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))))
        else:
            tag = rng.choice(INLINE if roll < 0.6 else ALWAYS if roll < 0.7 else BLOCK[:2])
            children.append((tag, rng.choice(list(NAMES)) if tag in ("div", "section", "span") else "", tree(rng, words, menus, depth + 1)))
    return children


def written(node):
    if isinstance(node, str):
        return escape(node)
    tag, name, children = node
    return f"<{tag}{f' class="{name}"' if name else ''}>{''.join(map(written, children))}</{tag}>"


def walked(node, kind, out):
    """Appends (kind, text) and None for a boundary."""
    if isinstance(node, str):
        out.append((kind, node))
        return
    tag, name, children = node
    inner = kind
    if kind == "around" or tag in ALWAYS:
        inner = "around"
    elif tag == "article":
        inner = "article"
    elif name and NAMES[name] == "around":
        inner = "around"
    elif name and NAMES[name] == "doubt" and kind == "article":
        inner = "doubt"
    edge = tag not in INLINE or inner != kind
    out += [None] * edge
    for c in children:
        walked(c, inner, out)
    out += [None] * edge


def expected_blocks(nodes):
    events, found, own = [], [], []
    for n in nodes:
        walked(n, "open", events)
    for e in [*events, None]:
        if e is None:
            text = " ".join("".join(t for _, t in own).split())
            if text:
                found.append((own[0][0], text))
            own = []
        else:
            own.append(e)
    return found


def brute(pages):
    seen, read = defaultdict(set), []
    tuples = lambda t: [tuple(t[i : i + RUN]) for i in range(max(1, len(t) - RUN + 1))] if t else []
    for page_id, host, nodes in pages:
        found = expected_blocks(nodes)
        read.append((page_id, host, found))
        for kind, text in found:
            if kind != "article":
                for r in tuples(text.split()):
                    seen[host, r].add("\n".join(t for _, t in found))
    out = []
    for page_id, host, found in read:
        has_article, kept = any(k in ("article", "doubt") for k, _ in found), []
        for kind, text in found:
            tokens, gone = text.split(), set()
            for i, r in enumerate(tuples(tokens)):
                if len(seen[host, r]) > 1:
                    gone |= set(range(i, i + len(r)))
            left = " ".join(t for i, t in enumerate(tokens) if i not in gone)
            if kind == "article" or kind == "doubt" and left:
                kept.append(text)
            elif kind == "open" and not has_article and left:
                kept.append(left)
        out.append((page_id, "\n".join(kept)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["&amp", "<x", "é"]
    menus = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 9, 14, 20)]
    pages = []
    for k in range(80):
        nodes = tree(rng, words, menus)
        if k % 3:
            nodes += [("article", rng.choice(["", "share-price", "ad"]), tree(rng, words, menus))] + tree(rng, words, menus)
        pages.append((k, f"h{k % 4}.example", nodes))
    pages += [(100 + k, h, n) for k, (_, h, n) in enumerate(pages[:6])]  # the same pages under other ids
    rows = [(k, f"http://{h}/{k}", "<html><body>" + "".join(map(written, nodes)) + "</body></html>") for k, h, nodes in pages]
    assert [b[1] for b in blocks(rows[1][2])] == [t for _, t in expected_blocks(pages[1][2])]
    got = sorted((r.page_id, r.text) for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(pages)


def test_suffix_arrays():
    rng = random.Random(12)
    streams = [[rng.choice("abc") for _ in range(rng.randrange(0, 40))] for _ in range(60)] + [list("abc"), list("abc"), ["abcabcab"]]
    hosts, pages = [f"h{k % 3}" for k in range(len(streams))], np.array([k % 7 for k in range(len(streams))])
    expected = defaultdict(set)
    for h, p, s in zip(hosts, pages.tolist(), streams):
        for r in runs(h, s):
            expected[r].add(p)
    found = suffix_runs(hosts, pages, streams)
    assert len(found[0]) == len(set(found[0]))
    assert {h: (a, b) for h, a, b in zip(found[0], found[1].tolist(), found[2].tolist())} == {h: (min(p), max(p)) for h, p in expected.items()}
    assert suffix_runs([], np.zeros(0, np.int64), [])[0] == []


def test_parts_of_names(spark):
    article = '<article><p>one</p><div class="share-price">Prices rose</div><section id="related-work">Others wrote</section><div class="comment-on-law">essay</div><div class="share-buttons">Send it</div></article>'
    for name, kind in (("reader-comments", 0), ("article-comments top", 0), ("post_comment-12", 0), ("sidebar-left", 0), ("comment-body", 0), ("commentary", ARTICLE), ("advice", ARTICLE), ("notice-period", 3), ("big notice", 0)):
        assert blocks(f'<article><div class="{name}">x</div></article>') == [(kind, "x")], name
    box = '<div class="newsletter-offer">Write to us and read more every week of the year</div>'
    rows = [(1, "http://a.example/1", article)] + [(k, f"http://b.example/{k}", f"<article><p>text {k}</p>{box}</article>") for k in (2, 3)] + [(4, "http://c.example/", f"<article><p>text</p>{box}</article>"), (None, "http://d.example/", "<article>no id</article>")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    offer = "Write to us and read more every week of the year"
    assert got == {1: "one\nPrices rose\nOthers wrote\nessay", 2: "text 2", 3: "text 3", 4: f"text\n{offer}", None: "no id"}


def test_odd_markup():
    text = lambda html: [t for _, t in blocks(html)]
    assert text("a < b <p title=it's>c</p><![CDATA[x > y]]>d<!doctype>e<!-- <p> -->f") == ["a < b", "c", "def"]
    assert text("<p>a<script>b</script >c<style>d") == ["ac"]
    assert text('<p>a<b title="x>y">c</b><i title="no end>d</i><u>e') == ["acde"]
    assert text("x<![CDATA[y") == ["x<![CDATA[y"] and text("x <a") == ["x <a"] and text("") == []
    assert blocks("<article><article class=comment>me</article>a</article>") == [(0, "me"), (ARTICLE, "a")]
    for part in ('<a title="', "<", "<p>", "<![CDATA[", "</b>", "<b>", "<!--", "<b><p>", "<a ='", "<b></i>", "<li><i>", "<script>"):
        start = time.time()
        blocks(part * (1_000_000 // len(part)))
        assert time.time() - start < 20, part
