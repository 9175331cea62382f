import html
import re

from framewright.llm import html_extract as H

SF = "/root/testdata/sf0.1"


def texts(page):
    return H.main_text(page, {})


def simple(page):
    """What the pages of the test tables hold, by patterns that fit them only."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", article)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p) if "<br>" in p else re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_articles_of_test_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in H.op1_html_extract(spark, SF).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == simple(r.html), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_markup():
    assert texts("<article><p>a<b>b</b> c&amp;d &eacute;&#x41;&lt;p&gt;</p>\n<p>x\n\t y<br>z</article>") == "ab c&d éA<p>\n\nx y z"
    assert texts("<body><nav>n</nav><main>m<script>if (a</b/) '</main>'</script><!-- <p>c --> t</main>foot</body>") == "m t"
    assert texts("<main><p title='a>b'>one<p>two<ul><li>three<li>four</ul>five</main>") == "one\n\ntwo\n\nthree\n\nfour\n\nfive"
    assert texts("<article>a<aside>b</aside>c<div class='ad-box'>d</div><section id=comments>e</section><form>f</form>g</article>") == "a\n\nc\n\ng"
    assert texts("<article><header><h1>T</h1></header>x 1 < 2 && 3 > 2</article>") == "T\n\nx 1 < 2 && 3 > 2"
    assert texts("<") == "<" and texts(None) == texts("") == texts("<style>x") == ""
    assert texts("plain text") == "plain text" and texts("<article><p>a &am b &quo") == "a &am b &quo"
    assert texts("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>end") == "deep\n\nend"


def test_letters_that_grow_in_lower_case():
    assert texts("<article><p>" + "İ" * 12 + "<script>x</script>HELLO WORLD paragraph</article>") == "İ" * 12 + "HELLO WORLD paragraph"


def test_elements_without_end():
    for name in ("svg", "object", "select", "math", "iframe"):
        assert texts(f"<article><p>one<{name}><b>no</b><p>two<div>three</div></article>") == "one\n\ntwo\n\nthree", name
    assert texts("<article><p>one<script>rest <p>two") == "one"


def test_whole_names_count():
    keep = "<p class=share-price>a</p><div id='related-work'>b</div><section class='notice-board x'>c</section><div class='adverts-of-1900'>d</div>"
    drop = "<div class='x share-buttons'>1</div><div id=site-footer>2</div><p class='ad_box ad-2'>3</p><div class=related-posts>4</div><div class=comments>5</div>"
    assert texts(f"<article>{keep}{drop}</article>") == "a\n\nb\n\nc\n\nd"


def test_pages_without_article_tags_give_the_same(spark):
    """The template alone finds what the article element marks."""
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    from pyspark.sql import functions as F

    bare = pages.withColumn("html", F.regexp_replace("html", "</?article[^>]*>", ""))
    want = {r.page_id: r.text for r in H.extract(pages).collect()}
    got = {r.page_id: r.text for r in H.extract(bare).collect()}
    assert sum(got[i] == want[i] for i in want) == len(want)


def rows(n=8):
    out = []
    for i in range(n):
        menu = "".join(f"<li><a href=/{k}>item {k} of {i}</a></li>" for k in range(3))
        out.append((i, f"http://a.example/{i}", f"<html><body><div>Welcome to our site</div><ul>{menu}</ul><div><p>story {i} begins</p><p>and {i * i} ends</p></div><div>All rights reserved</div></body></html>", "x", i))
    return out


def test_template_of_pages_without_article(spark):
    df = spark.createDataFrame(rows() + [(50, "http://b.example/1", "<div>Welcome to our site</div><p>alone</p>", None, None), (51, None, None, None, None), (52, "http://b.example/1", "", None, None), (3, *rows()[3][1:])], "page_id long, url string, html string, text string, host int")
    got = H.extract(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 12 and all(by[i] == f"story {i} begins\n\nand {i * i} ends" for i in range(8))
    assert by[50] == "Welcome to our site\n\nalone" and by[51] == by[52] == ""
    assert got[0].host is not None and H.extract(df.limit(0)).count() == 0


def test_classes(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, x string, y int")
    t = H.templates(df).collect()
    frame = {r.token for r in t if r.kind == "tag" and r.depth == 0}
    nested = [{r.token for r in t if r["class"] == c} for c in {r["class"] for r in t if r.depth == 1 and r.kind == "tag"}]
    assert ">html>body>ul" in frame and ">html>body>ul>li" not in frame
    assert any({">html>body>ul>li", ">html>body>ul>li>a", "/>html>body>ul>li"} <= c for c in nested)
    assert {r.token.rpartition(">#")[0] for r in t if r.kind == "text"} == {">html>body>div"}


def test_shuffled_templates(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, x string, y int")
    plain = {r.page_id: r.text for r in H.extract(df).collect()}
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    assert {r.page_id: r.text for r in H.extract(df).collect()} == plain


def extracted(spark, pages):
    """Texts of pages of one host."""
    df = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(H.extract(df).collect(), key=lambda r: r.page_id)]


def test_template_decides_in_articles(spark):
    """A notice without a name that would tell is left out of articles; headings and paragraphs that repeat, and articles that are alike, stay."""
    page = "<html><body><article><h1>Report</h1><div>Tell your friends</div><p>Of.</p><p>story {0} is long enough to be an article, with {1}</p><p>and it ends</p></article></body></html>"
    want = "Report\n\nOf.\n\nstory {0} is long enough to be an article, with {1}\n\nand it ends"
    assert extracted(spark, [page.format(i, "words " * 20 + str(i)) for i in range(6)]) == [want.format(i, "words " * 20 + str(i)) for i in range(6)]
    alike = "<article><h1>T</h1><div>All of these articles say the very same in a long text</div><p>{0}</p></article>"
    assert extracted(spark, [alike.format(i) for i in range(6)]) == [f"T\n\nAll of these articles say the very same in a long text\n\n{i}" for i in range(6)]


def test_copies_are_no_template(spark):
    page = "<html><body><h1>Title</h1><div>the only text</div><p>of this host</p><!-- {0} --><script>track({0})</script></body></html>"
    assert extracted(spark, [page.format(i) for i in range(5)]) == ["Title\n\nthe only text\n\nof this host"] * 5


def test_layouts_on_less_than_half_of_the_pages(spark):
    pages = [f"<html><body><div class=l{i % 3}><div>Layout {i % 3} says hello</div><p>story {i}</p><span>x</span><b>{i}</b></div></body></html>" for i in range(15)]
    assert extracted(spark, pages) == [f"story {i}\n\nx{i}" for i in range(15)]


def test_slots_of_one_path(spark):
    """A list is no menu for standing under a menu's path: the heading between them makes two slots."""
    menu = "".join(f"<li><a href=/{k}>a section of the site, number {k}</a></li>" for k in range(9))
    pages = [f"<html><body><ul>{menu}<li>here</li></ul><h2>How {i}</h2><ul><li>take {i}</li><li>stir {i * i}</li></ul></body></html>" for i in range(5)]
    assert extracted(spark, pages) == [f"How {i}\n\ntake {i}\n\nstir {i * i}" for i in range(5)]


def test_order_of_classes(spark):
    """Of a class, tokens that aren't in one order on all pages are no template, and a host's other tokens stay one."""
    moved = ["<i>moved</i>", ""]
    pages = [f"<html><body>{moved[i % 2]}<h4>Welcome</h4><h5>Hello</h5>{moved[1 - i % 2]}<div>story {i}</div></body></html>" for i in range(8)]
    df = spark.createDataFrame([(i, "http://a.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    tags = {r.token for r in H.templates(df).collect() if r.kind == "tag" and r.depth == 0}
    assert {">html", ">html>body", ">html>body>h4", ">html>body>h5", "/>html>body"} <= tags
    assert not tags & {">html>body>i", "/>html>body>i"}
    assert H._out_of_order([1, 2, 9, 3, 4]) == [2] and H._out_of_order([5, 1, 2]) == [0] and H._out_of_order([1, 2]) == []


def test_paths_are_bounded():
    tags, blocks = H.parse("<div class=x>" * 2000 + "deep")
    assert len(set(tags)) == 2000 and max(map(len, tags)) <= H.PATH_CHARS and blocks[0][3] == "deep"


def test_classes_that_cross(spark):
    """Of two classes that interleave on some pages, one isn't nested in the other and is told apart by gaps instead."""
    one, two, both = "<i>a</i><u>b</u>", "<b>c</b><s>d</s>", "<i>a</i><b>c</b><u>b</u><s>d</s>"
    pages = [f"<html><body><h4>Welcome</h4>{one if i < 5 else both if i < 9 else two}<div>story {i}</div></body></html>" for i in range(11)]
    df = spark.createDataFrame([(i, "http://a.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    found = {}
    for r in H.templates(df).collect():
        if r.kind == "tag":
            found.setdefault(r["class"], set()).add(r.token.rpartition(">")[2])
    assert {"i", "u"} in found.values() and {"b", "s"} not in found.values() and {"b"} in found.values()
    assert H._crosses([1, 3], [2, 4]) and not H._crosses([1, 4], [2, 3]) and not H._crosses([2, 3], [1, 4]) and not H._crosses([1, 2], [3, 4])
