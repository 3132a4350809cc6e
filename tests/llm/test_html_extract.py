import html
import re
import time

import pytest

from seriesloom.llm.html_extract import PARSED, _parse, extract_main_text, page_text, template_subtrees

text = page_text


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";x(1)</script></head><body>
    <header>site</header><nav><ul><li>menu</li></ul></nav><!-- c <p>no</p> --><div class="ad">buy</div>
    <article><h1>Head &amp; shoulders</h1><p>One <b>two</b>
       three<br>four</p><p>five<p>six<aside>side</aside><div class="share-buttons">tweet</div>
    <form><input>sign up</form><ul><li>a<li>b &lt;c&gt;</ul><table><tr><td>1<td>2<tr><td>3</table>
    <div id="comments"><p>troll</p></div></article><footer>&copy;</footer></body></html>"""
    assert text(page).split("\n") == ["Head & shoulders", "One two three four", "five", "six", "a", "b <c>", "1 2", "3"]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "</p></div>", "<p></p>", "<a href='>x", "<nav>x</nav>"])
def test_broken_and_empty_pages(page):
    assert text(page or "") in ("", "<", "<p", "x", "<a href='>x")


def test_main_then_content_then_body():
    assert text("<main><p>a</p></main><p>b</p>") == "a"
    assert text("<div id=content><p>a</p></div><p>b</p>") == "a"
    assert text("<div><p>a</p></div>b") == "a\nb"


def test_templates_of_a_host_go(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"http://h.example/{i}", f"<body><div><p>Follow the shop for offers</p></div><section><p>Own text number {i}.</p></section></body>"))
        rows.append((100 + i, f"http://other{i}.example/", f"<body><div><p>Follow the shop for offers</p></div><p>page {i}</p></body>"))
        rows.append((200 + i, "http://copies.example/", "<body><div><p>One article</p></div></body>"))
    rows += [(300, None, "<p>x</p>"), (301, "http://[bad", None), (None, "http://h.example/1", rows[0][2])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    out = extract_main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len({r[0] for r in rows}) and out.count() == len(rows)
    assert got[3]["text"] == "Own text number 3."
    assert got[103]["text"] == "Follow the shop for offers\npage 3"
    assert got[205]["text"] == "One article"
    assert got[300]["text"] == "x" and got[301]["text"] == "" and got[301]["n_chars"] == 0
    assert got[None]["text"] == "Own text number 0."


def test_templates_without_telling_names_go_and_articles_stay(spark):
    """Every page: a strip of links with other labels, a box of words, an article in a wrapper; the hosts' boxes differ."""
    rows = []
    for h in range(2):
        for i in range(10):
            links = "".join(f'<a href="/{i}/{j}">label {i * j} of {h}</a>' for j in range(4))
            box = f"<div class=x{i}><span>Words of host {h}</span> that stand <b>everywhere</b>.</div>"
            inner = f"<p>A passage that many pages share.</p><p>Body {h} {i}.</p><div><p>Printed by host {h}</p></div>"
            page = f"<body><div>{links}</div>{box}<div><h1>Head {h} {i}</h1><p>Lead {i}.</p>" + ("" if i % 2 else f"<article>{inner}</article>") + f"</div><section>Stamp {h} {i}</section></body>"
            rows.append((h * 100 + i, f"https://host{h}.example/{i}", page))
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for h in range(2):
        for i in range(10):
            want = f"Head {h} {i}\nLead {i}.\nStamp {h} {i}" if i % 2 else f"A passage that many pages share.\nBody {h} {i}."
            assert got[h * 100 + i] == want


def test_templates_are_found_on_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    parsed = pages.select("page_id", "url", "html").mapInArrow(_parse, PARSED).cache()
    found = template_subtrees(parsed).collect()
    hosts = {r["host"] for r in found}
    by_host = {r["host"]: r["n"] for r in parsed.select("host", "page").distinct().groupBy("host").count().withColumnRenamed("count", "n").collect()}
    assert hosts == {h for h, n in by_host.items() if n >= 5}
    parsed.unpersist()


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p>x</p><article class="post has-sidebar"><p>A</p></article>', "A"),
        ('<div id="search-engines-history"><p>Old engines</p></div>', "Old engines"),
        ('<div class="share price"><p>Shares rose</p></div>', "Shares rose"),
        ('<article><p>a</p><div class="share price">b</div><blockquote class="notice">c</blockquote></article>', "a\nb\nc"),
        ('<article><p>one two</p><div class="notice">n</div><div class="share"><a>t</a></div><div id="comments-list">long long long comment</div></article>', "one two"),
        ('<div class="main-sidebar"><p>all of the text</p></div>', "all of the text"),
        ('<main><nav>m</nav><p>a&#58;</p><dialog>d</dialog><span hidden>h</span><div role="Search">s</div></main><article></article>', "a:"),
    ],
)
def test_names_never_take_articles_or_most_of_the_text(page, want):
    assert text(page) == want


def test_deep_and_long_pages_take_linear_time(spark):
    deep = "<div>" * 10000 + "".join(f"w{i}</div>" for i in range(10000))
    unclosed = "<p><b><i>" * 20000 + "end"
    wide = "<article>" + "<p>one two</p>" * 100000 + "</article>"
    start = time.perf_counter()
    assert text(deep).count("\n") == 9999 and text(unclosed) == "end" and text(wide).count("\n") == 99999
    assert time.perf_counter() - start < 8
    df = spark.createDataFrame([(1, "http://a.example", deep), (2, "http://a.example", wide)], "page_id long, url string, html string")
    assert {r["page_id"]: r["n_chars"] for r in extract_main_text(df).collect()} == {1: len(text(deep)), 2: len(text(wide))}


def test_test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert got[r["page_id"]] == want


def test_empty_table(spark):
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


STORY = "The story itself stands here and is told at some length, longer than all that surrounds it. "


@pytest.mark.parametrize(
    "html, want",
    [
        (f'<main><p>{STORY}</p><article class="teaser">Card</article></main>', STORY.strip()),
        (f'<main><p>{STORY}</p><article class="reply-1">{STORY * 3}</article></main>', STORY.strip()),
        (f"<main><h1>Title</h1><article><p>{STORY}</p></article></main>", f"Title\n{STORY.strip()}"),
        (f'<div class="entry">one</div><p>{STORY}</p>', f"one\n{STORY.strip()}"),
        (f"<form><div><article><p>{STORY}</p></article></div></form>", STORY.strip()),
        (f'<form action="x"><div><p>{STORY}</p></div><div class="sidebar">links</div></form>', STORY.strip()),
        (f"<article><p>{STORY}</p><form><p>write to us</p></form></article>", STORY.strip()),
        (f"<p>{STORY}</p><form><p>subscribe</p></form>", STORY.strip()),
        (f"<main><p>{STORY}Once more.</p><article>{STORY}</article></main>", f"{STORY}Once more.\n{STORY.strip()}"),
        (f"<div>{STORY * 6}</div><article>Card</article>", (STORY * 6).strip()),
        ("a < b and <3 are no tags<p>x", "a < b and <3 are no tags\nx"),
    ],
)
def test_regions_are_chosen_by_what_they_hold(html, want):
    assert page_text(html) == want


@pytest.mark.parametrize("piece", ["<b 'x ", "<b 'x \">", "<a ' > \" ", "<p title='", "< ", "<!-- ", "</"])
def test_time_is_linear_in_unbalanced_quotes(piece):
    import time

    start = time.perf_counter()
    page_text(piece * (192_000 // len(piece)))
    assert time.perf_counter() - start < 2


def test_a_quote_without_end_hides_nothing_after_it():
    assert page_text("<p class='x>one</p><p>two</p>") == "one\ntwo"


def test_ranks_by_characters():
    from seriesloom.llm.html_extract import TITLE, main_ranks

    assert main_ranks({3: 100, 2: 50, TITLE: 5, 0: 30}) == [3, TITLE]
    assert main_ranks({3: 10, 2: 50}) == [2, TITLE] and main_ranks({3: 30, 2: 50}) == [2, 3, TITLE]
    assert main_ranks({3: 10, 0: 500}) == [0, 1] and main_ranks({1: 40, 0: 60}) == [1] and main_ranks({1: 4, 0: 60}) == [0, 1]
