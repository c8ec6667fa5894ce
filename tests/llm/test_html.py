"""Operator 1 on the test pages and on made ones."""

import html
import random
import re

from chronolex.llm import html_text


def test_op1(spark, data):
    import duckdb

    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{data}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in html_text.op1_template_text(spark, data).collect()}
    for page, url, source in pages:
        article = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[page]["url"], got[page]["text"], got[page]["n_chars"]) == (url, want, len(want))


def pages_of_one_host(n, shape):
    rnd = random.Random(1)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    bodies = [(" ".join(rnd.choices(words, k=12)), " ".join(rnd.choices(words, k=9))) for _ in range(n)]
    return [shape.format(*b) for b in bodies], ["\n\n".join(b) for b in bodies]


def test_template_without_telling_elements():
    pages, want = pages_of_one_host(12, "<html><body><div>Welcome to our site friends</div><div><p>{}</p><p>{}</p></div><div>All rights reserved by us</div></body></html>")
    assert html_text.texts(pages) == want
    assert html_text.texts(pages[:2])[0].startswith("Welcome")  # too few to tell


def test_copies_on_a_host_are_no_template():
    assert html_text.texts(["<article><p>the same article text here</p></article>"] * 20) == ["the same article text here"] * 20


def test_what_is_not_the_article():
    page = (
        "<head><title>t</title></head><header>top</header><nav>menu<div>more</div></nav><main><h1>Head</h1><p>One &amp; two<br>three&nbsp;four <b>bo</b>ld</p>"
        "<div class='cookie-notice'>cookies</div><form>ask</form><aside>side</aside><ul><li>x<li>y</ul><div id=comments><p>said</p></div><div class='ad'>buy</div></main><footer>foot</footer><script>var a='<p>no</p>';</script>"
    )
    assert html_text.texts([page]) == ["Head\n\nOne & two three four bold\n\nx\n\ny"]


def test_broken_pages():
    got = html_text.texts(["", "<p>a<!-- x", "a<b", "<script>x", "<nav>m</nav><p>x&lt;b&gt;", "</div></p>z", "<p>" * 3000 + "deep", "plain text"])
    assert got == ["", "a", "a<b", "", "x<b>", "z", "deep", "plain text"]


def test_odd_rows(spark):
    rows = [(1, None, None, "t"), (2, "no host", "<p>a</p>", "t"), (2, "no host", "<p>a</p>", "t"), (None, "http://h/x", "", "t"), (3, "http://h/x", "<p>" + "word " * 20_000 + "</p>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["url"], len(r["text"])) for r in html_text.main_text(df).collect())
    assert got == sorted([("1", None, 0), ("2", "no host", 1), ("2", "no host", 1), ("None", "http://h/x", 0), ("3", "http://h/x", 99_999)], key=lambda x: x[0])
    assert html_text.main_text(df.limit(0)).count() == 0


def test_classes_nest():
    row = lambda token, vector, place, words=0: {"token": token, "vector": vector, "place": 3 * place, "pages": 3, "words": words}
    outer, inner = [row(k, 7, x) for k, x in enumerate((0.0, 0.1, 0.9), 1)], [row(k, 8, x) for k, x in enumerate((0.3, 0.4, 0.5), 11)]
    crossing, few = [row(k, 9, x) for k, x in enumerate((0.2, 0.35), 21)] + [row(23, 9, 0.45)], [row(31, 5, 0.6)]
    found = html_text.classes([*inner, *few, *outer, *crossing])
    assert [[r["token"] for r in c] for c in found] == [[1, 2, 3], [11, 12, 13]]
    assert [[r["token"] for r in c] for c in html_text.classes([row(31, 5, 0.6, words=2)])] == [[31]]  # a text counts as its words do


SHAPE = "<html><body><div class=x>Welcome to our site friends</div><table><tr><td><a href=/>Home page of ours</a></td><td class=c><h2>{}</h2><p>{}</p></td></tr></table><div>All rights reserved by us</div></body></html>"


def test_any_partitions_give_the_same_texts(spark):
    """Hosts without telling elements, over many partitions or one; a page of another kind and an empty one among them change nothing."""
    bodies, want = pages_of_one_host(150, SHAPE)
    rows = [(k, "http://one.host/x", b) for k, b in enumerate(bodies)] + [(500, "http://one.host/login", "<html><body><form>name</form><p>Log in</p></body></html>"), (501, "http://one.host/e", None)]
    few, wanted = pages_of_one_host(12, SHAPE.replace("Home", "Start"))
    rows += [(1000 + k, "http://two.host/x", b) for k, b in enumerate(few)]
    expect = {**dict(enumerate(want)), 500: "Log in", 501: "", **{1000 + k: w for k, w in enumerate(wanted)}}
    for parts in (1, 37):
        found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()
        assert {r["page_id"]: r["text"] for r in found} == expect
        assert {r["page_id"] for r in found if not r["by_template"]} <= {500, 501}


def test_template_joined_by_salts(spark, monkeypatch):
    bodies, want = pages_of_one_host(40, SHAPE)
    rows = spark.createDataFrame([(k, "http://one.host/x", b) for k, b in enumerate(bodies)], "page_id long, url string, html string").repartition(5)
    monkeypatch.setattr(html_text, "BROADCAST", 0)
    assert {r["page_id"]: r["text"] for r in html_text.main_text(rows).collect()} == dict(enumerate(want))


def test_copies_without_telling_elements_stay():
    page = SHAPE.format("A title of note", "The same article text on each page here, longer than the rest of the page by far, as it should be.")
    assert "by far, as it should be." in html_text.texts([page] * 20)[0]


def test_test_pages_are_told_by_the_template(spark, data):
    found = html_text.main_text(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/pages.parquet")).collect()
    assert sum(r["by_template"] for r in found) >= 0.8 * len(found)


def test_text_of_the_template_inside_an_article():
    """Lines that stand on all pages of a host beside different articles are the template's, though they are inside the article; those of copies are not."""
    shape = "<html><body><nav>Menu of ours</nav><article><h1>{}</h1><p>{}</p><div>Please share this story</div><p>Subscribe to our letter today</p></article><footer>f</footer></body></html>"
    pages, want = pages_of_one_host(12, shape)
    assert html_text.texts(pages) == want
    assert html_text.texts(pages[:4])[0].endswith("letter today")  # too few different pages to tell
    assert html_text.texts([pages[0]] * 30)[0].endswith("letter today")
    assert html_text.texts(["<p>no article</p>", *pages]) == ["no article", *want]


def test_hosts_without_names(data):
    """The test pages with all names of elements and classes taken away: only sums over their hosts tell the article."""
    from collections import Counter, defaultdict

    import duckdb

    hosts = defaultdict(list)
    for url, source in duckdb.sql(f"SELECT url, html FROM '{data.replace('sf0.001', 'sf0.1')}/pages.parquet' ORDER BY page_id").fetchall():
        hosts[url.split("/")[2]].append(source)
    same = both = told = wanted = n = 0
    for pages in list(hosts.values())[:8]:
        plain = [re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", p)) for p in pages]
        for a, b in zip(html_text.texts(plain), html_text.texts(pages), strict=True):
            x, y = Counter(a.split()), Counter(b.split())
            same, n, both, told, wanted = same + (a == b), n + 1, both + (x & y).total(), told + x.total(), wanted + y.total()
    assert both >= 0.99 * told and both >= 0.999 * wanted and same > 0.85 * n
