from siftwork.llm import html

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li>Menu</li></ul></nav><header>Site</header><div class="ad">Buy</div>
<article><h1>Head &amp; tail</h1><p>One  <b>two<br>three<p>Four &lt;five&gt; &#233;<ul><li>six<li>seven</ul>
<aside>Beside</aside><form>Form</form><div id="comments"><p>A reader</p></div><table><tr><td>a<td>b</table></article>
<footer>&copy; Foot</footer>"""


def test_article_text():
    assert html.Page(PAGE).text() == "Head & tail\nOne two three\nFour <five> é\nsix\nseven\na b"


def test_odd_sources():
    for source in ("", "plain text", "<", "<p", "a < b", "<p>x", "</p></div>", "<article>", "<p class='x>y</p>", "<!-- open", "<script>", "<div>" * 3000 + "deep"):
        html.Page(source).text()
    assert html.Page("plain &amp; text").text() == "plain & text"
    assert html.Page("<div>" * 3000 + "deep").text() == "deep"
    assert html.Page("<p>a</p><![CDATA[b]]>").text() == "a\nb"


def test_deep_nests():
    for n in (300, 20_000):
        for tag in ("div", "b"):
            nest = f"<{tag}>" * n + "in" + f"</{tag}>" * n
            assert html.Page(f"<article><p>a</p>{nest}<p>z</p></article>after").text().split() == ["a", "in", "z"]
            # What is deep inside is skipped as elsewhere, and ends that fit nothing end nothing.
            deep = html.Page("<article><p>a</p>" + f"<{tag}>" * n + "<nav>menu</nav><form>form</form><p>in</p>" + "</i>" * n + "<p>z</p>")
            assert deep.text().split() == ["a", "in", "z"]
    # A template around a deep nest takes all of it along.
    page = html.Page("<div>" + "<div>" * 300 + "in" + "</div>" * 301 + "<p>z</p>")
    assert page.text({page.trees[0][0]}) == "z"


def test_templates_go_and_copied_articles_stay(spark):
    rows = [(k, f"http://h.com/{k}", f"<body><div><p>Welcome to our place</p></div><div><p>Own text {k}</p></div></body>") for k in range(30)]
    rows += [(100 + k, f"http://g.com/{k}", "<article><p>Copied on every page</p></article>") for k in range(30)]
    rows += [(200 + k, f"http://g.com/b{k}", f"<article><div class='x'><p>Read our letter</p></div><p>Text {k}</p></article>") for k in range(60)]
    rows += [(300, None, None), (301, "http://h.com/1", ""), (301, "http://h.com/1", "")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(df).collect()}
    assert len(got) == len(rows) - 1
    assert all(got[k][0] == f"Own text {k}" for k in range(30))
    assert all(got[100 + k][0] == "Copied on every page" for k in range(30))
    assert all(got[200 + k][0] == f"Text {k}" for k in range(60))
    assert got[300] == ("", 0) and got[301] == ("", 0)


def test_names_say_what_they_mean():
    wrap = lambda attrs, tag="div": html.Page(f"<body><{tag} {attrs}><article><p>In</p></article></{tag}></body>").text()
    assert wrap("class='content has-sidebar'") == wrap("class='sidebar'") == wrap("id=comments") == "In"
    inside = lambda attrs: html.Page(f"<article><p>a</p><div {attrs}>b</div></article>").text()
    for kept in ("class='cookie-recipe'", "id='share-price'", "class='recommended'", "style='display: block'", "title='hidden'", "data-id='ads'", "class='adventure shared'"):
        assert inside(kept) == "a\nb", kept
    for gone in ("class=ad", "class='x ad-slot-2'", "id='shareButtons'", "class='comment-list'", "hidden", "style='color:red;display:none'", "aria-hidden='true'", "role='navigation'", "class='cookie-notice'"):
        assert inside(gone) == "a", gone
    assert html.Page("<article><p>a</p><p hidden>b</p></article>").text() == "a"


def test_readers_articles_are_not_main():
    page = "<article><p>Main</p></article><div id='comments'><article class='comment'><p>A reader</p></article></div><article class=comment><p>Another</p></article>"
    assert html.Page(page).text() == "Main"


def test_recurring_subtrees_with_neutral_names(spark):
    """Boilerplate in neutral elements inside articles goes by counting alone; counts are held against counting by hand."""
    rows = []
    for k in range(40):
        promo = "<div class='c17'><p>Join us today</p><p>It is free</p></div>" if k % 4 else ""
        tail = "<p>All rights are ours</p>"
        some = "<p>Seen on some</p>" if k % 8 == 0 else ""
        rows.append((k, f"http://site.org/{k}", f"<article><h1>Title {k}</h1>{promo}<p>Own text {k}</p>{some}{tail}</article>"))
    rows += [(100 + k, "http://site.org/copy", rows[3][2]) for k in range(100)]  # copies of one page count once
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    parsed = {r[2]: html.Page(r[2]) for r in rows}
    assert len({p.text() for p in parsed.values()}) == 40
    seen = {}
    for page in parsed.values():
        for h, _ in page.candidates():
            seen[h] = seen.get(h, 0) + 1
    want = {h for h, n in seen.items() if n >= max(html.IN_ARTICLE[0], html.IN_ARTICLE[1] * 40)}
    found = {h for r in html.templates(df.selectExpr("'site.org' AS host", "html")).collect() for h in r.hashes}
    assert found == want and want
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    for k in range(40):
        assert got[k] == f"Title {k}\nOwn text {k}" + ("\nSeen on some" if k % 8 == 0 else "")
    assert got[100] == "Title 3\nOwn text 3"


def test_long_pages():
    long = "<p>" + "word &amp; " * 300_000 + "</p>" + "<p>x</p>" * 20_000
    text = html.Page(f"<article>{long}</article>").text()
    assert len(text) == len("word & " * 300_000) - 1 + 2 * 20_000


def test_empty(spark):
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
