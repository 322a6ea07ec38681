from graphloom.llm import html

LONG = "This is the first paragraph of the article, and it is about the way that the world is made, with all of the words that a paragraph should have in it."
ALSO = "It was the habit of the town to have the market on the square, and for this there were a lot of reasons that nobody could name any more."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_menus_notices_adverts_and_comments_go():
    text = html.main_text(
        page(
            f"""<div id="cookie-notice">We use cookies, and this is the text of the notice that is on top of the page for all of the readers.</div>
        <header><h1>The site of the town</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News of the day</a></li></ul></nav>
        <div class="breadcrumbs"><a href="#">A</a> &gt; <a href="#">B</a></div><aside class="x"><p>{LONG}</p></aside>
        <div class="content"><h2>The market &amp; the square</h2><p>{LONG}<p>Short one.<p>{ALSO}</div>
        <div class="ad-banner"><p>Buy the best of all the things that are in the shop for the least of the money that you have.</p></div>
        <form><label>Your name</label><input name=a><p>{LONG}</p></form><section id="comments"><p>I think that this is the best of the articles that I have read in the year.</p></section>
        <div class="sidebar">See also</div><footer>&copy; 2020 The firm</footer>""",
            "<style>p{color:red}</style><script>var a = '<p>no</p>';</script>",
        )
    )
    assert text == "\n\n".join(["The market & the square", LONG, "Short one.", ALSO])


def test_the_named_article_is_kept_whole():
    body = f"<nav><a href=1>x</a></nav><div class='ad'>{LONG}</div><article><h1>A title</h1><p><b>To&nbsp;to.<br><p>{LONG}</p><p>Ünï &eacute; &#x41;&#66;</p></article><footer>f</footer>"
    assert html.main_text(page(body)) == f"A title\n\nTo to.\n\n{LONG}\n\nÜnï é AB"


def test_short_blocks_take_their_neighbours_label():
    body = f"<div><p>{LONG}</p><p>Between.</p><p>{ALSO}</p></div><div><p><a href=1>One link</a></p><p>tail</p><p><a href=2>Another link</a></p></div>"
    assert html.main_text(page(body)) == f"{LONG}\n\nBetween.\n\n{ALSO}"


def test_names_that_say_what_a_region_has():
    for name in ("main-content with-sidebar", "has-sidebar", "post no-comments", "content without-footer wide"):
        assert html.main_text(f"<div class='{name}'><p>{LONG}</p><p>{ALSO}</p></div>") == f"{LONG}\n\n{ALSO}"
    for name in ("sidebar", "left-sidebar", "noticeboard notice"):
        assert html.main_text(f"<p>{LONG}</p><div class='{name}'><p>{ALSO}</p></div>") == LONG


def test_odd_markup():
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text(f"<p>{LONG}<p>a < b && c <3</p>") == f"{LONG}\n\na < b && c <3"
    assert html.main_text(f"<p>{LONG}</p><!-- <p>no</p> --><p title=\"a > b\">{ALSO}</p>") == f"{LONG}\n\n{ALSO}"
    assert html.main_text(f"<p>{LONG}</p><script>never closed <p>{ALSO}") == LONG
    assert html.main_text(f"<p>{LONG}<br>same<br><br>next one of the parts</p>").split("\n\n") == [f"{LONG} same", "next one of the parts"]
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000
    assert html.main_text(deep) == LONG
    assert html.main_text("<p>" + "The words of it are many. " * 40_000 + "</p>").count("many") == 40_000


def test_the_rules_and_not_a_tag_find_the_article(sf_dir):
    import duckdb

    pages = [h for (h,) in duckdb.sql(f"select html from '{sf_dir.replace('0.001', '0.01')}/pages.parquet'").fetchall()]
    for tag in ("div", "section", 'div class="content"'):
        other = [h.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>") for h in pages]
        assert sum(html.main_text(a) == html.main_text(b) for a, b in zip(pages, other, strict=True)) >= 0.95 * len(pages)


def test_evidence_against_and_for_a_block():
    menu = "<ul><li>Home</li><li>News</li></ul>"
    assert html.main_text(page(f"<nav><a href=1>x</a></nav><main>{menu}<h1>A title</h1><p>{LONG}</p><p>{ALSO}</p></main>")) == f"A title\n\n{LONG}\n\n{ALSO}"
    assert html.main_text(page(f'<article><div class="post-header"><h1>A title</h1></div><p>{LONG}</p></article>')) == f"A title\n\n{LONG}"
    assert html.main_text(page(f"<header><h1>The site</h1></header><article><header><h1>A title</h1></header><p>{LONG}</p></article>")) == f"A title\n\n{LONG}"
    assert html.main_text(page(f"<div><p>{LONG}</p><p>Copyright law is what this is about, and it is hard.</p><p>{ALSO}</p></div><p>© 2020 The firm</p>")).endswith(ALSO)
    assert "Copyright law" in html.main_text(page(f"<div><p>{LONG}</p><p>Copyright law is what this is about.</p><p>{ALSO}</p></div>"))
    more = f'<article><p>{LONG}</p><p><a href="1">Read this as well, it is by the same author</a></p><p>{ALSO}</p></article><div><p>{ALSO} Twice.</p></div><footer>x</footer>'
    assert html.main_text(page(more)) == f"{LONG}\n\n{ALSO}"


def test_languages_without_listed_stop_words():
    one = "Сегодня утром в городе открылась новая библиотека, где каждый может найти себе книгу по душе и остаться читать."
    two = "Жители рассказали, что ждали этого события несколько лет, потому что старое здание давно нуждалось в ремонте."
    assert html.main_text(page(f"<nav><a href=1>Дом</a></nav><p>{one}</p><p>{two}</p><footer>Контакты</footer>")) == f"{one}\n\n{two}"
    han = "今天早上，城里开了一座新的图书馆，每个人都可以在那里找到自己喜欢的书，并且可以坐下来读。"
    assert html.main_text(page(f"<div class='ad'>{han}</div><div><h1>图书馆</h1><p>{han}</p></div>")) == f"图书馆\n\n{han}"


def test_work_grows_with_the_length():
    import time

    n = 100_000
    pages = ["<span>" * n + "</p>" * n, "<span>" * n + "<p></p>" * n, "<table>" + "<span>" * n + "</p>" * n, "<a " * n, "<a b='" * n, "<p><b>x" * n, '<a title="' * n + ">", "<!--" * n]
    for p in pages:
        begin = time.perf_counter()
        html.main_text(p)
        assert time.perf_counter() - begin < 20  # quadratic work would take many minutes
    assert html.main_text("<span>" * n + f"<p>{LONG}</p>") == LONG


def test_frames(spark):
    rows = [(1, "u", page(f"<p>{LONG}</p>"), 5), (None, None, None, 5), (2, "v", "", 5), (1, "u", page(f"<p>{LONG}</p>"), 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted(map(tuple, html.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html.extract(pages.limit(0)).count() == 0


def test_fixture_pages(spark, sf_dir):
    """Every article of the fixture, as its markup has it."""
    import html as entities
    import re

    from graphloom.llm.queries import op1_html_extraction

    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split("</?(?:p|h1)>", body)]
        want[r.page_id] = "\n\n".join(p for p in parts if p)
    assert {r.page_id: r.text for r in op1_html_extraction(spark, sf_dir).collect()} == want
