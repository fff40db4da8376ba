"""HTML extraction on pages whose text is known from how they were made."""

import random

import pytest
from pyspark.sql import functions as F

from helixmill.llm import html_extract as he
from helixmill.llm.html_extract import Page, extract, extraction_report, site_templates

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, **options):
    out = extract(spark.createDataFrame(rows, SCHEMA), into="text", **options)
    return {r.page_id: r.text for r in out.collect()}


def site(host, n, seed, article=True):
    """Pages of a host: its frame has no telling tags or names, its articles are different; some quote one passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    menu = "".join(f'<li><a href="/{k}">{word()}</a></li>' for k in range(5))
    legal, quote = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(20))
    made = []
    for i in range(n):
        own = [" ".join(word() for _ in range(rng.randrange(5, 40))) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            own.insert(1, quote)
        body = "".join(f"<p>{x}" + rng.choice(["</p>", "\n"]) for x in own)
        body = f"<article>{body}</article>" if article else f"<div class=c{i}>{body}</div>"
        made.append((i, f"http://{host}/{i}?x={i}", f"<html><body><div id=x{i}><ul>{menu}</ul></div>{body}<div><table><tr><td>{legal}<td>{i % 3}</table></div><script>if (1 < 2) document.write('<p>no</p>')</script>", "\n\n".join(own)))
    return made


@pytest.mark.parametrize("most", [he.BROADCAST_TEMPLATES, 0])
def test_frames_without_names_go_by_recurrence(spark, monkeypatch, most):
    """Menu and legal lines of a site with no telling markup; the passage that a third of the pages quote stays."""
    monkeypatch.setattr(he, "HOT_PART", 1 / 8)
    rows = site("a.example", 40, 1, article=False) + [(100 + r[0], *r[1:]) for r in site("b.example", 24, 2, article=False)]
    want = {r[0]: r[3] for r in rows}
    assert texts(spark, [r[:3] for r in rows], broadcast_templates=most) == want
    alone = [(r[0], f"http://h{r[0]}.example/", r[2]) for r in rows]
    assert all(len(got) > len(want[i]) for i, got in texts(spark, alone, broadcast_templates=most).items())  # nothing recurs on a host of one page


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://c.example/{i}", "<body><div>one text</div><div>and another</div></body>") for i in range(30)]
    assert set(texts(spark, rows).values()) == {"one text\n\nand another"}


def test_near_copies_keep_their_paragraphs(spark):
    """A third of a host's pages share most paragraphs."""
    rows = [(i, f"http://d.example/{i}", "<article>" + "".join(f"<p>shared {k}</p>" for k in range(6)) + f"<p>own {i}</p></article>") for i in range(40)]
    got = texts(spark, rows)
    assert all(got[i] == "\n\n".join([*(f"shared {k}" for k in range(6)), f"own {i}"]) for i in got)


def test_repeated_boxes_inside_articles_go(spark):
    rows = [(i, f"http://e.example/{i}", f"<article><h1>Title {i}</h1><p>text {i}</p><div class=q7><p>Read our magazine</p></div><p>more {i}</p></article>") for i in range(12)]
    got = texts(spark, rows)
    assert got[3] == "Title 3\n\ntext 3\n\nRead our magazine\n\nmore 3" or got[3] == "Title 3\n\ntext 3\n\nmore 3"
    found = site_templates(spark.createDataFrame(rows, SCHEMA)).select("host", "n", "kind").collect()
    assert [tuple(r) for r in found] == [("e.example", 12, 1)] and got[3] == "Title 3\n\ntext 3\n\nmore 3"


def test_templates_of_earlier_pages(spark):
    early = spark.createDataFrame([r[:3] for r in site("a.example", 40, 1, article=False)], SCHEMA)
    late = [r for r in site("a.example", 60, 1, article=False) if r[0] == 55]
    assert texts(spark, [r[:3] for r in late], templates=site_templates(early)) == {55: late[0][3]}


FRAMED = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar no-ads">
<header><h2>Site</h2></header><nav>Menu<ul><li>One</ul></nav><div class="cookie-notice">We use cookies</div><div id="sidebarLeft">Side</div><form><label>Name</label><input></form>
<!-- <p>hidden</p> --><main><article itemscope><h1>A &amp; B</h1><p>First <b>bold</b>,<br>line&nbsp;two &lt;p&gt; <span class="ad-slot">Buy!</span>end<p>Second 1 < 2
<ul><li>x<li>y &#228;&#x1F600;</ul><aside>Pull</aside><table><tr><td>1<td>2<tr><td>3</table><div class="ad">Advert</div><iframe>no</iframe>
<section class="comments"><article class="comment"><p>First!</p></article></section></article></main>
<div role="complementary">More</div><footer>&copy; 2020</footer><script>var a = "</p><p>x";</script></body></html>"""


def test_named_parts_of_a_page():
    assert Page(FRAMED).main() == "A & B\n\nFirst bold, line two <p> end\n\nSecond 1 < 2\n\nx\n\ny ä😀\n\n1\n\n2\n\n3"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<div>b</div>c", "a\n\nb\n\nc"),
        ("<nav>menu<article><p>text</p></article>", "text"),  # a menu that nobody closes
        ("<form><div><article><p>text</p></article></div></form>", "text"),
        ("<main><p>in main</p></main><p>outside", "in main"),
        ("<div itemprop='articleBody'><p>in it</p></div><p>outside", "in it"),
        ("<article><header><h1>Title</h1><p>by me</p></header><p>text</article>", "Title\n\ntext"),
        ("<article>a<hr>b</div></p>c</article>", "a\n\nb\n\nc"),
        ('<p title="a > b" data-x=\'>\'>text</p>', "text"),
        ('<p>text<a href="never closed', "text"),
        ("<p>text <!-- never closed", "text"),
        ("<script>never closed <p>x", ""),
        ("<head><title>t</title><p>no body", "no body"),
        ("<P CLASS=Text>UP<SCRIPT>x</SCRIPT>PER</P>", "UP\n\nPER"),
        ("a &am b &amp c &ampd &unknown; &#0; &#55296;", "a &am b & c &d &unknown; � �"),
        ("<p>&lt;script&gt;x&lt;/script&gt;", "<script>x</script>"),
        ("<![CDATA[x]]>y <?php echo?>z", "y z"),
        ("<p>one<p>two <span class=advert>x<p>three", "one\n\ntwo\n\nthree"),
        ("<div class='ad-free content'><p>stays</div><div class='ad banner-top'>goes</div>", "stays"),
        ("<dl><dt>a<dd>b<dt>c</dl><select><option>o</select>", "a\n\nb\n\nc"),
        ("<body><div class=comment-list><div>x</div></div><textarea><p>y</textarea>z", "z"),
        ("\x00a b \n", "\x00a b"),
    ],
)
def test_markup(source, want):
    assert Page(source).main() == want


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "x", "<a " * 200_000, '<a "' * 200_000, '<a ">">' * 100_000, "<p>" * 200_000 + "x", "</div>" * 200_000, "<!--" * 200_000, "<li>" * 100_000, "<b>x" * 100_000, "<span class=ad>" * 100_000])
def test_long_broken_pages_take_linear_time(source):
    import time

    began = time.time()
    Page(source).main()
    assert time.time() - began < 10


def test_defined_cases(spark):
    rows = [(1, None, None), (1, None, None), (None, "no host", "<p>x"), (2, "http://h/", ""), (3, "http://h/", "<article></article>"), (4, "http://h/", "<p>" + "long text " * 300_000)]
    got = sorted(map(tuple, extraction_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    long = " ".join(["long text"] * 300_000)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (None, "no host", "x", 1), (2, "http://h/", "", 0), (3, "http://h/", "", 0), (4, "http://h/", long, len(long))], key=repr)
    assert extraction_report(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("most", [he.BROADCAST_TEMPLATES, 0])
def test_other_columns_pass(spark, most):
    names = ["host", "__host", "__html", "__templates", "a.b", "subtree", "Main_Text", "__salt", "salt"]
    pages = spark.createDataFrame([r[:3] for r in site("a.example", 8, 3)], SCHEMA).select("*", *[F.lit(str(k)).alias(c) for k, c in enumerate(names)])
    out = extract(pages, broadcast_templates=most)
    assert out.columns == [*[c for c in pages.columns if c != "Main_Text"], "main_text"]
    row = out.where("page_id = 2").first().asDict()
    assert row["a.b"] == "4" and row["__host"] == "1" and row["main_text"] == site("a.example", 8, 3)[2][3]
