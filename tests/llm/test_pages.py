"""Pages with wrapper elements around their article, labelled and not."""

import html
import re

import pytest

from pulsegrid.llm import html_content

WORDS = "Some words of the article that are long enough to win."
NAV = "<div class='links'><ul><li>Home</li><li>About</li></ul></div>"
WRAPPED = "<body><div id='page'><div class='wrapper content-with-sidebar'>%s%s<div class='legal'>all rights</div></div></div></body>"


def text_of(spark, html_rows, labelled):
    d = spark.createDataFrame(list(enumerate(html_rows)), "page_id long, html string").selectExpr("page_id", "'u' as url", "html")
    fitted = html_content.weights(d) if labelled is None else html_content.weights(
        spark.createDataFrame(list(enumerate(labelled)), "page_id long, html string"))
    return [r.text for r in sorted(html_content.extract(d, fitted=fitted).collect(), key=lambda r: r.page_id)], fitted


@pytest.mark.parametrize("mark", ["article", "main"])
def test_wrappers_are_not_boilerplate(spark, mark):
    labelled = [WRAPPED % (NAV, f"<{mark}><h1>T {i}</h1><p>{WORDS}</p></{mark}>") for i in range(30)]
    plain = [WRAPPED % (NAV, f"<div><h1>T {i}</h1><p>{WORDS}</p></div>") for i in range(5)]
    got, (_, learned) = text_of(spark, labelled + plain, labelled)
    assert got == [f"T {i}\n{WORDS}" for i in [*range(30), *range(5)]]
    assert {".links", ".legal"} <= learned and not learned & {".page", ".wrapper"}


def test_wrapper_named_like_boilerplate_holds_a_labelled_article():
    page = f"<body><form><div class='sidebar'><p class=ad>buy</p><article><p>{WORDS}</p></article></div></form></body>"
    assert html_content.main_text(page, {}, set()) == WORDS


def test_classes_around_and_outside_are_not_learned(spark):
    labelled = [f"<div class='row'>menu</div><div class='row'><article><p>{WORDS}</p></article></div>" for _ in range(30)]
    got, (_, learned) = text_of(spark, [f"<div class='row'><p>{WORDS}</p></div>"], labelled)
    assert got == [WORDS] and ".row" not in learned


def test_page_that_lies_in_passed_over_elements():
    assert html_content.main_text(f"<nav>Home</nav><div class='layout-sidebar'><p>{WORDS}</p></div>", {}, set()) == WORDS


@pytest.mark.parametrize("page,want", [
    ("<div><p class='ad'>Buy<p>first</p><p>second</p></div>", "first\nsecond"),
    ("<p class=ad><b>Buy</b> now<div>first</div><p>second", "first\nsecond"),
    ("<ul><li class='share'>x<li>item<li>other</ul><p>end</p>", "item\nother\nend"),
    ("<ul><li>item<li class='share'>x<ul><li>y<li>z</ul></ul><p>end</p>", "item\nend"),
    ("<div><ul><li class='share'>x</ul><p>end</p></div>", "end"),
    ("<dl><dt class=ad>x<dd>one<dt>two<dd class=ad>y</dl><p>end", "one\ntwo\nend"),
    ("<table><tr><td class=ad>x<td>one<tr class=ad><td>y<table><tr><td>z</table><tr><td>two</table><p>end", "one\ntwo\nend"),
    ("<table><thead class=ad><tr><th>h<tbody><tr><td>one</table>", "one"),
    ("<section><div class='ad'>x<p>y</section><p>end</p>", "end"),
    ("<div class='ad'><div>x</div><p>y</p></div><p>end</p>", "end"),
    ("<head><meta charset=utf-8><body><p>end</p></body>", "end"),
    ("<div class=ad>a<span>b</div><span class=ad>c<div>d</span><p>end</p>", "end")])
def test_end_tags_left_out(page, want):
    assert html_content.main_text(page, {}, set()) == want


def test_article_after_unclosed_blocks_has_no_ancestors_among_them():
    uses = html_content.tag_uses("<div class=a><ul><li class=b>x<li class=b>y</ul><p class=c>z<div class=d><article><p>t</div><p class=e>u")
    assert [uses[k] for k in (".a", ".b", ".c", ".d", ".e")] == [[0, 0, 1], [0, 2, 0], [0, 1, 0], [0, 0, 1], [0, 1, 0]]


def test_deep_pages_stay_linear():
    page = "<i><div class=ad>" + "<b><div>" * 60_000 + "</i></b>" * 60_000
    assert html_content.main_text(page, {}, set()) == ""


def renamed(page):
    """The page without any name that says what an element is for."""
    page = re.sub(r"(</?)(nav|footer|article|header|aside|section|main)\b", r"\1div", page)
    return page.replace('class="ad"', 'class="zz"')


def article_of(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


def test_scan_alone_finds_the_article_without_telling_names(spark):
    """Held-out pages whose elements have neutral names: no list of names can find the region, only the scan."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    tags, learned = html_content.weights(pages.where("page_id % 2 = 0"))
    held_out = [r.html for r in pages.where("page_id % 2 = 1").collect()]
    for change in (lambda p: p, renamed):
        alone = 0
        for page in held_out:
            blocks = html_content._blocks(change(page), tags, learned)
            start, end = html_content._region(blocks)
            alone += "\n".join(b[0] for b in blocks[start:end]) == article_of(page)
        assert alone >= 0.99 * len(held_out)
    assert sum(html_content.main_text(renamed(p), tags, learned) == article_of(p) for p in held_out) >= 0.99 * len(held_out)


def test_region_wins_by_scores():
    tags = {"a": -16.0, "li": -16.0, "p": 0.0}
    page = f"<div><li><a>Home</a></li><li><a>News and more of it</a></li><p>{WORDS}</p><p>More.</p><li><a>Legal words</a></li></div>"
    assert html_content.main_text(page, tags, set()) == f"{WORDS}\nMore."
    inside = f"<div><p>{WORDS}</p><aside>a note</aside><p>{WORDS}</p></div>"
    assert html_content.main_text(inside, tags, set()) == f"{WORDS}\n{WORDS}"
    longer = f"<div><p>short one</p><li></li><li></li><div class=comments><p>{WORDS} {WORDS}</p></div></div>"
    assert html_content.main_text(longer, tags, set()) == "short one"


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "u", f"<p>{WORDS}</p>", 5, "x", "y", 2.0), (None, None, None, 5, "x", "y", 2.0)],
                              "page_id long, url string, html string, n_chars int, text string, key string, _h double")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_content.extract(d).collect()), key=str)
    assert got == [(1, "u", WORDS, len(WORDS)), (None, None, "", 0)]
