"""Main text: elements that go or stay, mirrors, very long pages, neighbours over range boundaries."""

import random
import time

import pytest

from basketflow.llm import main_text


def text_of(html, *nearest):
    return main_text.main_text(main_text.lines(html), *[main_text.lines(x) for x in nearest])


@pytest.mark.parametrize("html,text", [
    # adverts, notices and hidden text in blocks of one line and inside sentences
    ("<article><p>One</p><p class='advert'>buy</p><p class='cookie-notice'>c</p><p hidden>h</p><h2 class=ad>x</h2><p>Two</p></article>", "One\n\nTwo"),
    ("<article><p>One <span class='ad'>AD <b>now</b> <span>x</span></span>more</p></article>", "One more"),
    ("<article><p>One <span class='ad'>AD<p>Two</p></article>", "One\n\nTwo"),
    ("<article><div>One <span class=ad><div>buy</div> it</span> more</div></article>", "One\n\nmore"),
    ("<article><p>One <span aria-hidden='true'>h</span>two</p><pre><span class='comment'># code</span></pre></article>", "One two\n\n# code"),
    # names of comments
    ("<article><p>Body</p></article><div id='respond' class='comment-respond'>Leave a comment</div>", "Body"),
    ("<article><p>Body</p><div id='respond' class='comment-respond'>Leave a comment</div></article>", "Body"),
    # a form round the page, its controls, and forms of fields
    ("<body><form><div class='content'><p>Body</p><label>Name</label><button>Go</button></div></form>", "Body"),
    ("<body><form id='aspnetForm'><input><p>Body</p></form></body>", "Body"),
    ("<body><p>Body text that is longer than the form below it, by far, so that it is the page.</p><form><h3>Write</h3><p>Yours</p></form>",
     "Body text that is longer than the form below it, by far, so that it is the page."),
    # prose around the innermost container
    ("<main><p>Intro</p><article><p>body</p></article><ul><li>tag</li></ul></main>", "Intro\n\nbody"),
    # formulas are part of their sentence, once
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be.</p></article>", "Let x=1 be."),
    # unclosed and foreign elements
    ("<article><p>One<p>Two</section></div><ul><li>a<li>b</ul></article>", "One\n\nTwo\n\na\n\nb"),
    ("", ""), ("<nav>only</nav>", ""), ("<p>&lt;b&gt;&nbsp; x\t\ny</p>", "<b> x y"),
])
def test_elements(html, text):
    assert text_of(html) == text


def test_mirrors_keep_their_text():
    page, other = "<p>menu</p><p>a body of some length</p>", "<p>menu</p><p>another body</p>"
    assert text_of(page, page) == "menu\n\na body of some length"            # only a mirror: nothing says what is template
    assert text_of(page, page, other) == "a body of some length"             # the other neighbour says it
    assert text_of(page, other, page) == "a body of some length"
    assert text_of("<article><div>equal line</div></article>", "<article><div>equal line</div></article>") == "equal line"


def test_long_common_subsequences_are_longest(monkeypatch):
    rng = random.Random(5)
    small = main_text._rising
    for n in range(40):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(250, 420))] for _ in range(2))
        got = sorted(main_text.common_subsequence(a, b))
        want = len(small([ord(x) for x in a], [ord(x) for x in b]))
        it = iter(b)
        assert len(got) == want and all(any(x == y for y in it) for x in (a[i] for i in got))


def test_very_long_pages_are_fast():
    begin = time.perf_counter()
    equal, other = ["x"] * 100_000, ["x", "y"] * 50_000
    assert len(main_text.common_subsequence(equal, ["x"] * 99_000)) == 99_000
    assert len(main_text.common_subsequence(["z"] + equal[:20_000], other[:30_000] + ["q"])) == 15_000
    assert len(main_text.lines("<div>" * 100_000 + "text" + "</section>" * 100_000)) == 1
    assert main_text.lines("<form>" * 20_000 + "text") != []
    assert time.perf_counter() - begin < 20


SCHEMA = "page_id long, url string, html string"


def _site(n=60):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 3}.x/{i % 7}/{i}", f"<p>menu {i % 3}</p><p>own {i}</p><p>foot {i % 3}</p>") for i in range(n)]
    rows += [(i, "http://hot.x/p", f"<p>top</p><p>text {i % 5}</p>") for i in range(40)]
    rows += [(None, None, None), (None, "http://h0.x/1", None), (7, None, "<p>x</p>"), (8, "", ""), (5, "http://h1.x/a", "<p>menu 1</p><p>twice</p>"),
             (5, "http://h1.x/a", "<p>menu 1</p><p>twice</p>"), (9, "http://" + "l" * 3000 + "/" + "p" * 3000, "<p>long url</p>")]
    rng.shuffle(rows)
    return rows


def test_result_does_not_depend_on_partitions(spark):
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), {}
    pages = spark.createDataFrame(_site(), SCHEMA)
    try:
        for n in (1, 8, 211):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got[n] = sorted(map(str, main_text.extract_main_text(pages).coalesce(4).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[1] == got[8] == got[211] and len(got[1]) == len(_site())
    # brute force: all pages in one list
    order = sorted((r for r in _site(60) if r[1] and r[1].startswith("http://h1.x/") and r[0] != 5), key=lambda r: (r[1][11:], r[0]))
    assert all(f"text='own {r[0]}'" in "".join(got[1]) for r in order)


def test_empty_table_and_clashing_columns(spark):
    assert main_text.extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, "http://a/b", "<p>x</p>", "h", "p", "k", "t", 3)], SCHEMA + ", host string, path string, key string, text string, n_chars int")
    assert [tuple(r) for r in main_text.extract_main_text(rows).collect()] == [(1, "http://a/b", "x", 1)]
