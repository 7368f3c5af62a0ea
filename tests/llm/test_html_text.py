import html
import re

from pyspark.sql import Row

from weblog.llm import html_text as ht

SF = "/root/testdata/sf0.001"

ARTICLE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies <button>OK</button></div><!-- <p>no</p> -->
<div class="layout with-sidebar"><article class="post"><h1>A  &amp; B</h1><p>One<br>two &lt;3&#33; caf&eacute;
<p>Three <b>bold</b>ly.</p><div class="ad">Buy!</div><form><input name=q>Search</form><ul><li>x<li>y</ul>
<section id="comments"><article class="comment"><p>First!</p></article></section></article>
<aside><article><p>Teaser</p></article></aside></div><footer>&copy; Site</footer></body></html>"""


def test_article():
    text, _ = ht.main_text(ht.Lines(ARTICLE).lines, None)
    assert text == "A & B\nOne two <3! café\nThree boldly.\nx\ny"


def test_pages_without_article_lose_shared_lines():
    page = "<body><div>Top links</div><div>{}</div><div>Read more</div><div>All rights</div>"
    a, b = (ht.Lines(page.format(x)).lines for x in ("Own story.", "Another one."))
    assert ht.main_text(a, b) == ("Own story.", 3)
    assert ht.main_text(a, None)[0] == "Top links\nOwn story.\nRead more\nAll rights"


def test_common_lines_are_a_longest_subsequence():
    import random
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = ht.common_lines(a, b)
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in rest for i in sorted(got))


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    want = {}
    for r in pages:
        inner = re.search("<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        want[r.page_id] = "\n".join(x for x in blocks if x)
    got = ht.op7_html_text(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(pages)
    assert all(r.n_chars == len(r.text) for r in got)


def test_rows_and_pairs(spark, monkeypatch):
    page = "<body><div>Menu</div><div>Story {}</div><div>End</div>"
    rows = [Row(page_id=i, url=f"http://Host/{i}", html=page.format(i), text="x") for i in range(8)]
    rows += [Row(page_id=20, url="http://other/1", html=page.format("alone"), text="x"),
             Row(page_id=21, url="http://same/1", html=page.format("same"), text="x"),
             Row(page_id=21, url="http://same/1", html=page.format("same"), text="x"),
             Row(page_id=None, url=None, html=None, text=None), Row(page_id=22, url="::bad", html="", text=""),
             Row(page_id=23, url="http://long/", html="<p>" + "w " * 100000, text="")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for most in (1000, 3):
        monkeypatch.setattr(ht, "MOST", most)
        got = ht.extract(pages).collect()
        assert len(got) == len(rows)
        by = {r.page_id: r.text for r in got}
        # Only pages that share a group are paired; with parts, a part may hold one page.
        assert all(by[i] == f"Story {i}" or most == 3 and by[i] == f"Menu\nStory {i}\nEnd" for i in range(8))
        assert by[20] == "Menu\nStory alone\nEnd" and by[21] == "Menu\nStory same\nEnd"
        assert by[None] == by[22] == "" and by[23] == ("w " * 100000).strip()
    assert ht.extract(pages.limit(0)).count() == 0


def whole_host_texts(rows):
    """Texts and shared lines of all rows by (page_id, html), each host sorted as a whole."""
    from collections import defaultdict
    hosts, want = defaultdict(list), []
    for r in rows:
        host, _, path = r.url.removeprefix("http://").partition("/")
        hosts[host.lower()].append(("/" + path, r.page_id, r.html))
    for pages in hosts.values():
        pages.sort()
        lines = [ht.Lines(h).lines for _, _, h in pages]
        for i, (_, page_id, html_) in enumerate(pages):
            other = next((x for x in reversed(lines[:i]) if x != lines[i]), None)
            if other is None:
                other = next((x for x in lines[i:] if x != lines[i]), None)
            want.append((page_id, html_, *ht.main_text(lines[i], other)))
    return sorted(want)


def test_texts_are_those_of_the_whole_host_however_it_is_cut(spark, monkeypatch):
    # Sections of a host share lines with their neighbours only; one host begins and one ends with a long run of
    # equal pages, one holds nothing else, and one has all pages under one URL.
    page = "<body><div>Site</div><div>Section {}</div><div>Story {}</div><div>End {}</div>"
    rows, same = [], "<body><div>Not found</div><div>Site</div>"
    for i in range(40):
        rows += [(f"hot/{i // 8}/{i:02}", page.format(i // 8, i, i // 8)), (f"one/", page.format(i // 8, i, i // 8)),
                 (f"begins/{i:02}", same if i < 17 else page.format(i // 8, i, i // 8)),
                 (f"ends/{i:02}", same if i > 23 else page.format(i // 8, i, i // 8)),
                 (f"middle/{i:02}", same if 5 < i < 33 else page.format(i // 8, i, i // 8)), (f"equal/{i:02}", same)]
    rows = [Row(page_id=k, url=f"http://{u}", html=h) for k, (u, h) in enumerate(rows)]
    rows += [rows[0], rows[0], rows[-1]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    html_of = {r.page_id: r.html for r in rows}
    want = whole_host_texts(rows)
    for most in (1, 3, 7, 1000):
        monkeypatch.setattr(ht, "MOST", most)
        got = ht.extract(pages).collect()
        assert sorted((r.page_id, html_of[r.page_id], r.text, r.n_shared) for r in got) == want, most
    assert any(t.startswith("Story") for _, _, t, _ in want)


def text_of(page):
    return ht.main_text(ht.Lines(page).lines, None)[0]


def test_names_that_are_no_boilerplate():
    page = """<body><article id="social-impact"><h2 id="related-work">Work</h2><section id="notice-period"><p id="share">A
        <a id="ads">B</a></section><div class="section" id="menu-plans">C</div><div class="ad">no</div><div id="sidebar">no</div>
        <section id="comments">no</section><section class="related">no</section></article>"""
    assert text_of(page) == "Work\nA B\nC"
    assert text_of("<main><h1 id=menu>M</h1><section id=related-work>W</section><div class=share>no</div></main>") == "M\nW"
    for name in ("layout with-sidebar", "page has-menu", "layout--no-sidebar"):
        assert text_of(f"<body><div class='{name}'><p>Story</p><div class=sidebar>no</div></div>") == "Story"


def test_a_wrapper_is_no_boilerplate_where_nothing_else_is_left():
    page = "<div class='{}'><nav>no</nav><div class=menu>no</div><p>A long story is told here.</p></div><div class=footer>no</div>"
    for name in ("sidebar-layout", "modal", "search-page"):
        assert text_of(page.format(name)) == "A long story is told here."
        assert text_of(f"<div class=notice-page>{page.format(name)}</div>") == "A long story is told here."
    assert text_of("<p>Story</p>" + page.format("sidebar-layout")) == "Story"
    assert text_of(page.format("comments")) == text_of("<nav>no</nav>") == ""
    deep = "<div class=sidebar>" * 3000 + "Story"
    assert text_of(deep) == "Story"
