from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledger_mart.llm import common, html

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("x")).withColumn("host", F.lit("y")).withColumn("_row", F.lit(1))
    return {r["page_id"]: r["text"] for r in html.main_text(frame).collect()}


def blocks(markup):
    return html.Page(markup).found()[0]


@pytest.mark.parametrize(("markup", "want"), [
    ("<p>a<p>b", ["a", "b"]),
    ("<p>a <b>b</b>c\n\t d<br>e</p>", ["a bc d e"]),
    ("<article><h1>T &amp; &#233; &eacute;&nbsp;&lt;x&gt;</h1><p><b>one<br><p>two</article>", ["T & é é <x>", "one", "two"]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><th>3</table>", ["a", "b", "c", "1", "2", "3"]),
    ("<script>if (a<b) '<p>no</p>'</script><style>p{}</style><p>yes<!-- <p>no --> and</p><noscript>no</noscript>", ["yes and"]),
    ("<header>no</header><nav>no</nav><main><header><h1>T</h1></header><p>yes</p><aside>no</aside><form>no</form></main><footer>no</footer>", ["T", "yes"]),
    ("<div class='cookie-notice'>no</div><div class='article-body'>yes</div><div id=comments><p>no</p></div><div class='adBox'>no</div>", ["yes"]),
    ("<div hidden>no</div><div style='display: none'>no</div><div role=navigation>no</div><p>yes", ["yes"]),
    ("<p title='a > b' data-x=\"<p>\">yes</p>", ["yes"]),
    ("a < b <3 & c &copy d <p>e<![CDATA[<f>]]></p></p><a href='x", ["a < b <3 & c © d", "e<f>"]),
    ("<p>cut <b>off <i", ["cut off"]),
    ("<!doctype html><title>no</title>text<!-- open", ["text"]),
    ("", []),
    ("<p> \n </p>", []),
])
def test_blocks(markup, want):
    assert blocks(markup) == want


@pytest.mark.parametrize("rows", [0, 10**6])
def test_templates_go_and_repeated_articles_stay(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "SMALL_ROWS", rows)  # of templates that go to all tasks
    rng = random.Random(1)
    body = lambda i: f"<p>{' '.join(rng.choices('some words of page number that differ'.split(), k=30))} {i}</p>"
    rows, want = [], {}
    for host, start in (("a.example.org", 0), ("b.example.org", 100)):
        for i in range(start, start + 20):
            text = body(i)
            rows.append((i, f"https://{host.upper()}/{i}", f"<html><body><div><span>Our site</span> <a href=/>home</a></div><div class=text>{text}</div><div>Seen on {host}</div></body></html>"))
            want[i] = text[3:-4]
    same = "<body><div>Our site</div><article><h1>Same</h1><p>Same text</p></article></body>"
    rows += [(200 + i, "http://c.example.org/", same) for i in range(10)]
    want |= {200 + i: "Same\nSame text" for i in range(10)}
    rows += [(300, None, "<p>no host</p>"), (301, "::", "<p>bad url</p>"), (302, "http://a.example.org", None), (303, "http://a.example.org", "")]
    want |= {300: "no host", 301: "bad url", 302: "", 303: ""}
    got = texts(spark, rows)
    assert got == want


def test_linked_lists_in_articles_go_if_they_recur(spark):
    rows = [(i, "http://d.example.org", f"<article><p>Text {i} of an article</p><div><a href=x>More</a> <a href=y>of this</a></div></article>") for i in range(6)]
    assert texts(spark, rows) == {i: f"Text {i} of an article" for i in range(6)}


def test_no_rows_null_and_repeated_ids(spark):
    assert texts(spark, []) == {}
    frame = spark.createDataFrame([(None, "http://x.example", "<p>a"), (1, "http://x.example", "<p>b"), (1, "http://x.example", "<p>b")], SCHEMA)
    rows = html.main_text(frame).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in rows) == [("1", "b", 1), ("1", "b", 1), ("None", "a", 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<div class=ad>", "</div>", "<article>", "</article>", "<!--", "-->", "<", ">", "&", "&lt;", "a", " ", "'", '"', "<a href=", "<script>", "</script>", "<table>", "<td>", "</table>", "<br/>", "\0", "é"]), max_size=40))
def test_any_markup_is_read(parts):
    page = html.Page("".join(parts))
    found, at, up, keys, contents, places = page.found()
    assert len(found) == len(at) and all(t == " ".join(t.split()) and t for t in found)
    assert set(keys) <= {*contents, *places} and len(up) == len(keys)
    assert all(-1 <= around < i for i, around in enumerate(up)) and all(-1 <= a < len(up) for a in at)
    assert html.staying(found, at, up, keys, set()) == found
    for gone in [*contents, *places]:
        assert html.staying(found, at, up, keys, {gone}) == naive_staying(page, {gone})


def naive_staying(page, gone):
    """All elements around each block, one by one."""
    kept = []
    inside = any(b[2] for b in page.blocks)
    for text, element, article in page.blocks:
        removed = False
        while element >= 0:
            removed |= page.keys[element] in gone
            element = page.up[element]
        kept += [text] if (article or not inside) and not removed else []
    return kept


def test_very_long_page(spark):
    many = "".join(f"<p>{i} word</p>" for i in range(20_000))
    got = texts(spark, [(1, "http://x.example", f"<article>{many}</article>")])
    assert got[1] == "\n".join(f"{i} word" for i in range(20_000))


def test_copies_of_a_page_are_one_page(spark):
    """Crawled again or mirrored, without an article: the main text stays, the template goes."""
    page = lambda text: f"<body><div><span>Our site</span></div><div><p>{text}</p></div></body>"
    rows = [(i, f"http://e.example.org/{i}", page("Equal text of some length")) for i in range(6)]
    rows += [(i, "http://e.example.org/", page(f"Own text {i}")) for i in range(10, 18)]
    assert texts(spark, rows) == {i: "Equal text of some length" if i < 10 else f"Own text {i}" for i, *_ in rows}


@pytest.mark.parametrize("few", [0, 10**6])
def test_templates_of_some_pages_of_a_large_host_go(spark, monkeypatch, few):
    monkeypatch.setattr(html, "FEW", few, raising=False)
    monkeypatch.setattr(html, "HEAVY", 10)
    rows, want = [], {}
    for i in range(100):
        more = "<p>Buy our yearly box now</p>" * (i % 20 == 1) + "<div><i>Seen in the paper</i></div>" * (i % 5 == 2)
        rows.append((i, "http://f.example.org/", f"<body><div><p>Text {i}</p>{more}<p>End {i}</p></div></body>"))
        want[i] = f"Text {i}\nEnd {i}"
    assert texts(spark, rows) == want


@pytest.mark.parametrize("few", [0, 10**6])
def test_what_recurs_in_articles(spark, monkeypatch, few):
    """A labelled set: content that several articles share stays, lists of links and what is on most pages in one place go."""
    monkeypatch.setattr(html, "FEW", few)
    rows, want = [], {}
    for i in range(40):
        stays = ["Overview", f"Text {i} of an article.", "Yes", "1", "Released under the MIT License."]
        table = "<table><tr><th>Yes</th><td>1</td></tr></table>"
        links = "<ul><li><a href=a>First of our texts</a><li><a href=b>Second of them</a></ul>"
        body = [f"<h2>{stays[0]}</h2>", f"<p>{stays[1]}</p>", table, f"<p>{stays[4]}</p>"]
        keep = [0, 1, 2, 3, 4] if i % 4 == 0 else [1, 2, 3, 4] if i % 4 == 1 else [1]
        shown = [body[0]] * (0 in keep) + [body[1]] + [body[2], body[3]] * (2 in keep)
        shown.insert(1, links * (i % 10 < 3))
        shown.append("<div class=x>Read on with our free app</div>" * (i % 5 > 0))  # on 32 of 40 pages
        rows.append((i, "http://g.example.org/", f"<body><article>{''.join(shown)}</article></body>"))
        want[i] = "\n".join(stays[k] for k in keep)
    assert texts(spark, rows) == want


def test_removal_equals_a_naive_version(spark):
    """Pages of random parts against counts and removal written down plainly."""
    rng = random.Random(4)
    parts = ["<p>same words</p>", "<div><b>part</b> two</div>", "<ul><li><a>x y</a><li><a>z z</a></ul>", "<p>{0} own</p>", "<p>{1} some</p>", "loose", "</div>", "<div>"]
    rows = []
    for i in range(120):
        inner = "".join(rng.choices(parts, k=rng.randint(1, 7))).replace("{0}", str(i)).replace("{1}", str(i % 9))
        rows.append((i, f"http://{rng.choice('ab')}.example.org/", f"<article>{inner}</article>" if rng.random() < 0.5 else f"<main>{inner}" if rng.random() < 0.2 else inner))
    pages = {i: (html.host_of(u), html.Page(h)) for i, u, h in rows}
    versions, seen = {}, {}
    for host, page in pages.values():
        version = tuple(page.found()[0])
        versions.setdefault(host, set()).add(version)
        for key, place in zip(page.keys, page.by_place):
            if key is not None:
                seen.setdefault((host, key, place), set()).add(version)
    gone = {}
    for (host, key, place), on in seen.items():
        if len(on) >= 4 and (not place or 2 * len(on) > len(versions[host])):
            gone.setdefault(host, set()).add(key)
    want = {i: "\n".join(naive_staying(page, gone.get(host, set()))) for i, (host, page) in pages.items()}
    assert texts(spark, rows) == want


@pytest.mark.parametrize("markup", [
    "<b>" * 50_000 + "x", "<div>x" * 50_000, "<div>x" * 25_000 + "</i>" * 50_000, "<p><button>" + "<b>" * 25_000 + "<div>" * 25_000 + "y",
    "<ul>" + "<li><ul>x" * 25_000, "<table><tr><td>" * 20_000 + "<br></p>" * 20_000, "<article>" * 30_000 + "z" + "</article>" * 30_000,
])
def test_deep_nesting_takes_time_in_proportion(markup):
    import time

    start = time.process_time()
    found = html.Page(markup).found()
    html.staying(*found[:4], set(found[4][:1]))
    assert time.process_time() - start < 8
