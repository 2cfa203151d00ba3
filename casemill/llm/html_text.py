"""Operator 9: main text of web pages, by markup and by the suffix array of each host.

A page becomes blocks in page order. What stands inside article or main is the article, unless an element around it is
one of menus, headers, footers, forms and the like, or every part of a name it bears (class, id, role) says so. Two sorts of
blocks are left to the host's other pages: those of pages without an article, and blocks inside an article whose name
says so in part only (a "share-price" is no share button). For these the token streams of all blocks outside articles, and
of the blocks left open, are put together by host and their suffixes sorted: each piece of pages gets a suffix array by
prefix doubling, in which neighbours with a common prefix of RUN tokens are one run, and Spark merges the arrays of all
pieces by run. Runs on two distinct pages of a host are boilerplate; where they join to a repeat of LONG tokens or
more, longer than a menu or a notice, it is so only as far as its runs are on WIDE pages, so a page keeps a text that
one other page has too. In pages without an article the tokens that are covered go and the unique runs between them
stay; inside an article a block in doubt goes if all of it is covered. An article's other text is never searched: sites
repeat text inside articles that belongs there.

An element inside a line of text (a link, a button, a label) that means surroundings loses its own text and does not end
the block it is in; one whose name says so in part only is read like the text around it. Spans and bold text that
bear such a name count as boxes of their own.

Runs are compared by 128 bits of hash and reduced in their piece to the least and greatest page, so a host with a third
of all pages, and a run that is on all of them, are spread over tasks.

Cases: null and empty html, and pages of surroundings only, give an empty text. Repeated rows give repeated results; pages
of equal text count as one. A null or odd url is a host of its own. A null page_id is a page like any other. Extra columns
are not read. An empty table gives no rows. Very long pages are read whole, in time linear in their length: a
tag that the page's end cuts off inside a quoted value ends at its first ">", and so do the tags after it.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import looked_up, pieces, staged

#: Tokens of a run; a power of two.
RUN = 8
#: Tokens of a repeat that is no menu for being on two pages, and distinct pages that make it one. Pages are counted as
#: distinct bits of 63, which never counts too many.
LONG, WIDE = 40, 3

# Element names and words of class, id and role by meaning.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
AROUND_TAGS = frozenset("aside button canvas dialog embed footer form head iframe input label menu nav noscript object option select svg template textarea".split())
RAW_TAGS = frozenset("script style textarea title noscript template svg iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE_TAGS = frozenset("p b i a span em strong".split())
FLOWING_TAGS = frozenset("a abbr bdi bdo button cite code data del dfn em i input ins kbd label mark output q s samp select small strong sub sup time u var".split())
AROUND_WORDS = frozenset("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted related respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget contentinfo complementary".split())
#: Words that leave the meaning of the others in a name as it is.
NEUTRAL_WORDS = frozenset("action actions all area article articles bar block body bottom box button buttons card container content count desktop fixed float footer form global group header heading icon icons inline inner item items label large latest left link links list main mobile more new outer page panel popular post posts primary reader readers recent right row secondary section signup site slot small sticky stories story thread title top unit user users wrap wrapper".split())
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"=\s*([\"'])|>")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TAGS}
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[^\W\d_]+")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://([^/?#]*)", re.I)

AROUND, OPEN, ARTICLE, DOUBT = 0, 1, 2, 3


def tags(html: str):
    """(start, end, closing, tag, attributes) of all markup in order; the tag is empty where the markup and what it holds is skipped."""
    at, quoted, cdata = 0, True, True
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif cdata and html.startswith("<![CDATA[", at):
            end = html.find("]]>", at) + 3
            if end < 3:
                cdata = False
                continue
            yield at, end, False, "", ""
        elif html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at) + 1
            if not end:
                return
            yield at, end, False, "", ""
        elif name := NAME.match(html, at):
            end = name.end()
            while quoted:
                stop = STOP.search(html, end)
                if stop and not stop[1]:
                    end = stop.end()
                    break
                close = html.find(stop[1], stop.end()) if stop else -1
                quoted, end = close >= 0, close + 1
            if not quoted:
                end = html.find(">", name.end()) + 1
                if not end:
                    return
            tag, attributes = name[2].lower(), html[name.end() : end - 1]
            if tag in RAW_TAGS and not name[1]:
                close = RAW_END[tag].search(html, end)
                end = close.end() if close else len(html)
                yield at, end, False, "", ""
            else:
                yield at, end, bool(name[1]), tag, attributes
        else:
            end = at + 1
        at = end


def named_around(attributes: str) -> tuple[bool, bool]:
    """Whether a name (one word of class, id or role) means surroundings with all of its parts, and whether with one of them."""
    sure = hinted = False
    for m in NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = PARTS.findall(name)
            if not AROUND_WORDS.isdisjoint(parts):
                hinted = True
                sure = sure or all(p in AROUND_WORDS or p in NEUTRAL_WORDS for p in parts)
    return sure, hinted


def kind_inside(tag: str, attributes: str, kind: int) -> int:
    """The kind of an element's content, given the kind of what is around it."""
    if kind == AROUND or tag in AROUND_TAGS or tag == "header" and kind not in (ARTICLE, DOUBT):
        return AROUND
    if tag in ("article", "main") and kind == OPEN:
        return ARTICLE
    if tag in ("html", "body") or not attributes:
        return kind
    sure, hinted = named_around(attributes)
    return AROUND if sure else DOUBT if hinted and kind == ARTICLE else kind


def blocks(html: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page, in order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements with the kind of their content
    opened: Counter = Counter()
    text: list[str] = []
    muted: list[tuple[int, int, int]] = []  # elements in a line whose text goes: place on the stack, parts of text before, kind around
    kind, end = OPEN, 0

    def close():
        if muted:  # a block inside the line ends it
            _, before, around = muted[0]
            written(text[:before], around)
            del text[:before]
            muted[:] = [(at, 0, k) for at, _, k in muted]
        written(text, kind)
        text.clear()

    def written(parts: list[str], kind: int):
        block = " ".join(unescape("".join(parts)).split())
        if block:
            out.append((kind, block))

    def drop(at: int):
        nonlocal kind
        while muted and muted[-1][0] >= at:
            del text[muted.pop()[1] :]
        opened.subtract(t for t, _ in stack[at:])
        del stack[at:]
        kind = stack[-1][1] if stack else OPEN

    for start, stop, closing, tag, attributes in tags(html):
        text.append(html[end:start])
        end = stop
        if tag == "br":
            text.append(" ")
        if tag in ("", "br"):
            continue
        if closing:
            at = len(stack) - 1 if opened[tag] > 0 else -1
            while at >= 0 and stack[at][0] != tag:
                at -= 1
            after = stack[at - 1][1] if at > 0 else OPEN
            flows = at >= 0 and len(muted) > 0 and muted[-1][0] == at
            if tag in BLOCK_TAGS or at >= 0 and (after != kind and not flows or any(t in BLOCK_TAGS for t, _ in stack[at:])):
                close()
            if at >= 0:
                drop(at)
            continue
        inside = kind_inside(tag, attributes, kind)
        flows = tag in FLOWING_TAGS and inside != kind
        if flows and inside != AROUND:
            inside, flows = kind, False
        if tag in BLOCK_TAGS or inside != kind and not flows:
            close()
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in ("p", "li"):  # their end tags may be left out
            at = len(stack)
            while at and opened["p"] > 0 and stack[at - 1][0] in INLINE_TAGS:
                at -= 1
                opened[stack[at][0]] -= 1
            muted[:] = [m for m in muted if m[0] < at]  # the block before was closed above
            del stack[at:]
            kind = stack[-1][1] if stack else OPEN
            inside = kind_inside(tag, attributes, kind)
        if flows:
            muted.append((len(stack), len(text), kind))
        kind = inside
        stack.append((tag, kind))
        opened[tag] += 1
    text.append(html[end:])
    close()
    return out


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower().rpartition("@")[2] if m else ""


def run_hash(host: str, tokens: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(f"{host} {' '.join(tokens)}")


def runs(host: str, tokens: list[str]) -> list[bytes]:
    """Hashes of all runs of RUN tokens (of all tokens, if fewer) under the host."""
    return [run_hash(host, tokens[i : i + RUN]) for i in range(max(1, len(tokens) - RUN + 1))] if tokens else []


def suffix_runs(hosts: list[str], pages: np.ndarray, streams: list[list[str]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the streams, from the suffix arrays of their hosts: hash, least and greatest page, and a bit for every page of each.

    Prefix doubling ranks all suffixes by their first RUN tokens. In the order of (host, rank, page) neighbours of
    one rank have a common prefix of RUN tokens, or both are the whole of a shorter stream.
    """
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    if not sizes.sum():
        return [], *(np.zeros(0, np.int64) for _ in range(3))
    rank = pa.array([t for own in streams for t in own], pa.large_string()).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    owner, ends = np.repeat(np.arange(len(streams)), sizes), np.cumsum(sizes)
    at, last = np.arange(len(rank)), ends[owner]
    width = 1
    while width < RUN:
        after = np.where(at + width < last, rank[np.minimum(at + width, len(rank) - 1)], 0)
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1] + 1
        width *= 2
    host = np.unique(hosts, return_inverse=True)[1][owner]
    whole = np.flatnonzero((last - at >= RUN) | (at == last - sizes[owner]))
    page = pages[owner]
    order = whole[np.lexsort((page[whole], rank[whole], host[whole]))]
    new = np.flatnonzero(np.r_[True, (rank[order][1:] != rank[order][:-1]) | (host[order][1:] != host[order][:-1])])
    first, final = order[new], order[np.r_[new[1:], len(order)] - 1]
    hashes = [run_hash(hosts[k], streams[k][i : i + RUN]) for k, i in zip(owner[first].tolist(), (first - (ends - sizes)[owner[first]]).tolist())]
    return hashes, page[first], page[final], np.bitwise_or.reduceat(np.int64(1) << page[order] % 63, new)


def covered(shared: list[bool | None], n: int) -> set[int]:
    """The places of n tokens that are boilerplate. shared: for each run whether it is on WIDE pages, None where it is no repeat."""
    any_page, wide = set(), set()
    for i, on in enumerate(shared):
        if on is not None:
            any_page.update(range(i, min(i + RUN, n)))
        if on:
            wide.update(range(i, min(i + RUN, n)))
    gone, start = set(), None
    for i in range(n + 1):
        if i in any_page:
            start = i if start is None else start
        elif start is not None:
            repeat = range(start, i)
            gone.update(repeat if len(repeat) < LONG else wide.intersection(repeat))
            start = None
    return gone


PAGES = "page_id long, url string, text string, undecided array<struct<kind:int,text:string>>, run binary, a long, b long, bits long"
LEFT = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def read(batches):
        """A row for each page, with the blocks if some of them are left open, and a row for each run of each piece."""
        for batch in batches:
            for part in pieces(batch, "html"):
                texts, left, hosts, ids, streams = [], [], [], [], []
                for url, html in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    found = blocks(html or "")
                    inner = [(k, t) for k, t in found if k in (ARTICLE, DOUBT)]
                    undecided = inner if any(k == DOUBT for k, _ in inner) else [] if inner else [(k, t) for k, t in found if k == OPEN]
                    texts.append("\n".join(t for k, t in inner if k == ARTICLE))
                    left.append([{"kind": k, "text": t} for k, t in undecided])
                    own = [t.split() for k, t in found if k != ARTICLE]
                    hosts += [host_of(url)] * len(own)
                    ids += [xxhash.xxh64_intdigest("\n".join(t for _, t in found)) - 2**63] * len(own)
                    streams += own
                hashes, least, most, bits = suffix_runs(hosts, np.array(ids, np.int64), streams)
                n, m = part.num_rows, len(hashes)
                filled = [(part.column(0), pa.int64()), (part.column(1), pa.string()), (pa.array(texts, pa.string()), pa.string()), (pa.array(left, LEFT), LEFT)]
                more = [(pa.array(hashes, pa.binary()), pa.binary()), (pa.array(least), pa.int64()), (pa.array(most), pa.int64()), (pa.array(bits), pa.int64())]
                names = ["page_id", "url", "text", "undecided", "run", "a", "b", "bits"]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in filled] + [pa.nulls(n, t) for _, t in more], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, t) for _, t in filled] + [c for c, _ in more], names)

    def list_runs(batches):
        for batch in batches:
            rows, found = [], []
            for row, url, left in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = {h for b in left if b["kind"] != ARTICLE for h in runs(host_of(url), b["text"].split())}
                rows += [row] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.binary())], ["row", "run"])

    def settle(batches):
        for batch in batches:
            page_id, url, left, shared = (batch.column(k) for k in range(4))
            texts = []
            for u, found, hashes in zip(url.to_pylist(), left.to_pylist(), shared.to_pylist()):
                host, known, kept = host_of(u), {h["run"]: h["wide"] for h in hashes or ()}, []
                for block in found:
                    tokens, gone = block["text"].split(), set()
                    if block["kind"] != ARTICLE:
                        gone = covered([known.get(h) for h in runs(host, tokens)], len(tokens))
                    if block["kind"] == OPEN:
                        tokens = [t for i, t in enumerate(tokens) if i not in gone]
                    elif len(gone) == len(tokens):
                        continue
                    if tokens:
                        kept.append(" ".join(tokens))
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([page_id, url, pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = staged(pages.select("page_id", "url", "html").mapInArrow(read, PAGES).withColumn("row", F.monotonically_increasing_id()), "pages")
    decided, undecided = rows.where("run is null and size(undecided) = 0"), rows.where("run is null and size(undecided) > 0")
    # a run's hash holds its host
    shared = rows.where("run is not null").groupBy("run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.bit_or("bits").alias("bits")).where("a <> b").select("run", (F.bit_count("bits") >= WIDE).alias("wide"))
    own = staged(undecided.select("row", "url", "undecided").mapInArrow(list_runs, "row long, run binary"), "page-runs")
    common = looked_up(own, staged(shared, "shared-runs"), "run").groupBy("row").agg(F.collect_set(F.struct("run", "wide")).alias("shared"))
    settled = undecided.join(common, "row", "left").select("page_id", "url", "undecided", "shared").mapInArrow(settle, "page_id long, url string, text string")
    return decided.select("page_id", "url", "text").union(settled).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
