from pyspark.sql import functions as F

from cairn.llm.html_text import Page, extract

DDL = "page_id long, url string, html string"


def test_rules():
    x = """<html><head><title>T</title><body class="has-sidebar"><header>Site</header><div id="cookie-notice">We use</div><div class="sidebar">side</div><main><h1>A &amp; B</h1><p>One
 two&nbsp;three<br>four<p>Five <b>six</b><ul><li>x<li>y</ul><form>f<input></form><!-- c > --><section class="comments"><p>reader</p></section><div class=adverts>z</div><script>if(a<b)"</p>"</script></main><footer>end"""
    assert Page(x).text() == "A & B\nOne two three four\nFive six\nx\ny"
    assert Page('a<b x="1').text() == "a"
    assert Page('<p>1 < 2 & 3 &lt; 4 &#233; &eacute;</p><a href="x>y">l</a>').text() == "1 < 2 & 3 < 4 é é\nl"
    assert Page("").text() == "" and Page("<!-- open").text() == "" and Page("<script>x").text() == ""
    assert Page('<nav>m</nav><article class="post"><header><h1>Ti</h1></header>x<aside>no</aside></article><p>after</p>').text() == "Ti\nx"
    assert Page("<p><b>a<br><p>b</p></b>").text() == "a\nb"
    assert Page("<div>" * 3000 + "deep").text() == "deep"


def test_templates_go_and_articles_stay(spark):
    rows = []
    for i in range(40):
        body = f"<div><ul><li>Home</li><li>Topics</li></ul></div><div><p>Unique words {i} of page</p><p>{'Shared passage' if i % 8 == 0 else f'own {i}'}</p></div><div>About this site</div>"
        rows.append((i, "http://Host.example/a", f"<html><body>{body}</body></html>"))
    for i in range(40, 80):  # one article copied over a site is no template
        rows.append((i, "http://copies.example/a", "<article><p>The very same article.</p></article>"))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, DDL)).collect()}
    assert got[0] == "Unique words 0 of page\nShared passage" and got[1] == "Unique words 1 of page\nown 1"
    assert all(got[i] == "The very same article." for i in range(40, 80))


def test_odd(spark):
    rows = [(None, None, None), (1, "", ""), (1, "not a url", "<p>x</p>"), (1, "http://h/", " \n "), (2, "http://h/", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, DDL).withColumn("text", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("hashes", F.lit(2))
    got = extract(df).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id is None} == {""} and max(r.n_chars for r in got) == 249_999
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract(df.limit(0)).count() == 0


def test_whole_articles_are_kept():
    assert Page('<body><form id="aspnetForm"><input><label>Find</label><article><p>The text</p></article><button>x</button></form>').text() == "The text"
    assert Page("<p>a</p><form><p>Your mail</p><input></form>").text() == "a"
    assert Page('<main><h1>Head</h1><p>Many words of a real text</p></main><article class="card">teaser</article>').text() == "Head\nMany words of a real text"
    assert Page("<main><h1>Head</h1><p>Many words of a real text</p><article>teaser one</article></main>").text() == "Head\nMany words of a real text"
    x = "".join(f'<section class="{c}"><p>{c}</p></section>' for c in ("related-work", "notice-board", "share-price")) + '<div id="search-algorithms">s</div>'
    assert Page(f"<article>{x}<div class='related-posts'>r</div><div class='share'>s</div></article>").text() == "related-work\nnotice-board\nshare-price\ns"


def test_deep_markup_takes_linear_time():
    import time

    t = time.process_time()
    assert Page("<div>" * 100_000 + "<p>deep<b>er" + "</div>" * 100_000).text() == "deeper"
    assert time.process_time() - t < 4


def test_templates_equal_a_count_by_hand(spark):
    import random
    from collections import Counter

    from cairn.llm.html_text import MIN_PAGES, SHARE_PAGE

    r = random.Random(3)
    rows = []
    for i in range(200):
        common_ = "".join(f"<div><p>part {k}</p></div>" for k in range(6) if r.random() < (0.1, 0.25, 0.29, 0.33, 0.6, 1.0)[k])
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<body>{common_}<div><p>own text {i}</p></div></body>"))
    got = {x.page_id: x.text for x in extract(spark.createDataFrame(rows, DDL)).collect()}
    seen, pages = Counter(), Counter()
    for i, _, source in rows:
        pages[i % 3] += 1
        seen.update((i % 3, h) for h in set(Page(source).hashes().values()))
    for i, _, source in rows:
        gone = {h for (host, h), n in seen.items() if host == i % 3 and n >= MIN_PAGES and n >= SHARE_PAGE * pages[host]}
        assert got[i] == Page(source).text(gone)
