"""Conversion cases; all cases of one option set are converted as one table."""

import pytest

from pagesmelt import to_markdown

BASE = "https://example.org/guide/part/"

# name: (html, expected Markdown without its final line break)
DEFAULT = {
    "empty": ("", ""),
    "plain_text": ("just text", "just text"),
    "article": (
        "<html><head><title>T</title><style>a{}</style><script>let x='<p>';</script></head><body>\n"
        "  <header>Site</header>\n  <main>\n    <h1>Big\n news</h1>\n    <p>One,   two.</p>\n"
        "    <img src='a.png' alt='A'>\n    <pre><code>f(\"x\")\n  y_z*</code></pre>\n  </main>\n"
        "</body></html>",
        f"Site\n\n# Big news\n\nOne, two.\n\n![A]({BASE}a.png)\n\n```\nf(\"x\")\n  y_z*\n```"),
    "inline": (
        "<p>a <b> bold </b>b<i>it</i> <del>d</del> <q>q</q> 2<sup>3</sup></p>",
        'a  **bold** b*it* ~~d~~ "q" 23'),
    "escapes": ("<p>a*b_c &lt;x&gt; # 1. -</p>", "a\\*b\\_c <x> # 1. -"),
    "code_spans": (
        "<p><code>a_b</code> <kbd>k</kbd> <code>x`y</code> <code> </code>.</p>",
        "`a_b` `k` `` x`y `` ."),
    "links": (
        "<p><a href='../api'>API</a> <a href='//h/p'> x </a><a name=n>anchor</a>"
        "<a href='#f' title='T \"q\"'>f</a> <a href='https://h/a_b'>https://h/a_b</a></p>",
        f"[API](https://example.org/guide/api)  [x](https://h/p) anchor"
        f"[f]({BASE}#f \"T \\\"q\\\"\") <https://h/a_b>"),
    "breaks": ("<p>a.<br>b   <br><br>c</p>d<hr>e", "a.\nb\n\nc\n\nd\n\n---\n\ne"),
    "unclosed_bold": (
        "<article><p><b>Top.<br><p>One.</p><p>Two.</article><footer>F</footer>",
        "**Top.\n\nOne.\n\nTwo.**\n\nF"),
    "lists": (
        "<p>i</p><ul>\n<li>one</li>\n<li><p>two</p><p>more</p>"
        "<ol start='9'><li>x</li><li>y<ul><li>z</li></ul></li></ol></li>\n</ul>after",
        "i\n\n* one\n* two\n\n  more\n\n  9. x\n  10. y\n      + z\n\nafter"),
    "quotes": (
        "<blockquote><p>a</p><p>b</p><ul><li>c</li></ul></blockquote>d",
        "> a\n>\n> b\n>\n> * c\n\nd"),
    "list_in_quote_in_list": (
        "<ul><li>t<blockquote>q<ul><li>u<br>v</li></ul></blockquote></li></ul>",
        "* t\n  > q\n  > + u\n  >   v"),
    "definition": ("<dl><dt>T</dt><dd>one<p>two</p></dd></dl>", "T\n:   one\n\n    two"),
    "table": (
        "<table>\n<tr><th>A</th><th>B</th></tr>\n<tr><td>1<br>2</td><td><p>x</p></td></tr></table>",
        "| A | B |\n| --- | --- |\n| 1 2 | x |"),
    "table_without_head": (
        "<table><tbody><tr><td>a</td><td colspan=2></td></tr><tr><td>b</td></tr></tbody></table>",
        "|  |  |  |\n| --- | --- | --- |\n| a |  | |\n| b |"),
    "table_with_thead": (
        "<table><caption>C</caption><thead><tr><td>h</td></tr></thead>"
        "<tbody><tr><td>v</td></tr></tbody></table>",
        "C\n\n| h |\n| --- |\n| v |"),
    "code_language_below": (
        "<pre>x<!-- c --><b></b><code class='language-rb'>a</code><code class='language-go'>b"
        "</code></pre><p>m</p><pre class='language-c'>n</pre><code class='language-js'>z</code>",
        "```rb\nxab\n```\n\nm\n\n```c\nn\n```\n\n`z`"),
    "code_language": (
        "<pre><code class='x LANG-c++'>a</code></pre><pre data-lang='sql'>b</pre>"
        "<pre class='language-py;x'>c</pre>",
        "```c++\na\n```\n\n```sql\nb\n```\n\n```\nc\n```"),
    "fence_edges": ("<pre>\n\n  a\n\n\n\nb  \n \n</pre>", "```\n  a\n\nb\n```"),
    "hidden": (
        "<p>keep</p><p hidden>h</p><p aria-hidden=TRUE>a</p><p style='COLOR:red; Display : none'>d"
        "</p><p style='visibility:hidden'>v</p><nav role=Navigation>n<p role=banner>m</p></nav>"
        "<nav>plain nav</nav><p class='shared-context'>stays</p><p class='addon'>stays too</p>",
        "keep\n\nplain nav\n\nstays\n\nstays too"),
    "noise": (
        "<div id=top-ad>1</div><div class='x cookie_banner'>2<p class=share-buttons>3</p></div>"
        "<div class='Social-Share'>4</div><p id=advert>5</p>left<p id=add>6</p>", "left\n\n6"),
    "empties": (
        "<h2> <span> </span></h2><a href=x>\n</a><img alt=' ' src=y><p> </p><div><b> </b></div>"
        "<ul></ul>text<a href=i><img alt=I src=i.png></a>",
        f"text[![I]({BASE}i.png)]({BASE}i)"),
    "emptied_heading": ("<h2><img alt='' src=x></h2>a", "##\n\na"),
    "no_body_title_stays": ("<title>T</title><p>a</p>", "T\n\na"),
    "entities": ("<p>&amp;amp; &copy; &#8212; &#x41; &#150; &nope; &lt", "&amp; © — A – &nope &lt"),
    "adjacent_texts": ("<p>a <!-- c --><span hidden>x</span> b</p><p>c</p> <div class=ad>x</div> d",
                       "a  b\n\nc\n\nd"),
    "inline_block": ("<h2>a<p>b</p><div>c</div></h2>", "## a b c"),
    "stray_end_tags": ("</div><p>a</b></p></p>b", "a\n\nb"),
    "reserved_characters": (
        "<p>a\ufdd2b\ufdd7</p><pre>\ufdd0\n c\ufdd1\n</pre><ul><li>\ufdd5x<br>\ufdd6</li></ul>",
        "a\ufdd2b\ufdd7\n\n```\n\ufdd0\n c\ufdd1\n```\n\n* \ufdd5x\n  \ufdd6"),
    "code_in_lists_and_quotes": (
        "<ul><li>a<pre>\n\nx\n\n  y \n\n</pre>b</li></ul><blockquote><pre>\n<b>\n z</b>\n</pre></blockquote>",
        "* a\n\n  ```\n  x\n\n    y\n  ```\n\n  b\n\n> ```\n>  z\n> ```"),
    "prefixes_after_quotes": (
        "<ul><li>a<blockquote>b<ul><li>c<blockquote>d<br>e</blockquote>f</li></ul><p>g</p></blockquote>"
        "<p>h</p></li><li>i<p>j</p></li></ul><blockquote>k<p>l</p></blockquote><dl><dd>m<p>n</p></dd></dl>",
        "* a\n  > b\n  > + c\n  >   > d\n  >   > e\n  >\n  >   f\n  >\n  > g\n\n  h\n* i\n\n  j\n\n"
        "> k\n>\n> l\n\n:   m\n\n    n"),
    "quote_in_a_cell": (
        "<table><tr><td><blockquote>a<p>b</p></blockquote></td></tr></table><ul><li>c<p>d</p></li></ul>",
        "|  |\n| --- |\n| a b |\n\n* c\n\n  d"),
    "unknown_sections": (
        "<p>a<![what[x]]>b</p><![ y>c<!-- d --><![if gte mso 9]>e<![endif]><![CDATA[f]]><p>g", "ab\n\ncef\n\ng"),
}


def convert(spark, cases, **options):
    rows = [(number, BASE, html) for number, (html, _) in enumerate(cases.values())]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {row.page_id: row.markdown for row in to_markdown(frame, **options).collect()}
    return {name: found[number] for number, name in enumerate(cases)}


@pytest.fixture(scope="module")
def default(spark):
    return convert(spark, DEFAULT)


@pytest.mark.parametrize("name", DEFAULT)
def test_default(default, name):
    assert default[name] == DEFAULT[name][1] + "\n"


POLICY = "<p>See <a href='/g'>the <b>guide</b></a>.</p><p><img src=d.png alt=' Dia '> end</p>"


@pytest.mark.parametrize("links, images, expected", [
    ("text", "alt", "See the **guide**.\n\nDia end\n"),
    ("strip", "strip", "See .\n\nend\n"),
    ("keep", "strip", "See [the **guide**](https://example.org/g).\n\nend\n"),
])
def test_policies(spark, links, images, expected):
    assert convert(spark, {"p": (POLICY, "")}, links=links, images=images)["p"] == expected


def test_front_matter(spark):
    yaml = pytest.importorskip("yaml")
    html = ("<html lang=ja><meta property='og:title' content='A: \"b\" #1 '>"
            "<link rel='x canonical' href='/c'><meta name=date content='2024-01-02'>"
            "<body><p>Text.</p>")
    both = convert(spark, {"m": (html, ""), "none": ("<p>x</p>", "")}, front_matter=True)
    _, head, body = both["m"].split("---\n", 2)
    assert yaml.safe_load(head) == {
        "title": 'A: "b" #1', "canonical_url": "https://example.org/c",
        "published_time": "2024-01-02", "language": "ja"}
    assert body == "\nText.\n"
    assert both["none"] == "---\n{}\n---\n\nx\n"


def test_unknown_option(spark):
    with pytest.raises(ValueError, match="links"):
        convert(spark, {"p": ("x", "")}, links="drop")


def test_null_html_keeps_its_row(spark):
    frame = spark.createDataFrame(
        [(1, "u", None), (2, "u", "<div class=ad>all dropped</div>")],
        "page_id long, url string, html string")
    for options in ({}, {"links": "text", "images": "strip"}, {"content": "auto"}):
        found = to_markdown(frame, **options).orderBy("page_id").collect()
        assert [(row.page_id, row.markdown) for row in found] == [(1, "\n"), (2, "\n")]


def test_without_urls_links_stay(spark):
    frame = spark.createDataFrame([(1, "<a href='../x'>y</a>")], "page_id long, html string")
    assert to_markdown(frame).first().markdown == "[y](../x)\n"


def test_deep_and_long_pages(spark):
    count = 4000
    pages = {
        "open": "<body>" + "".join(f"<p>w{n}" for n in range(count)),
        "flat": "".join(f"<p>w{n}</p>" for n in range(count)),
        "spaces": "<p>a" + " " * 300000 + "b</p>",
    }
    found = convert(spark, {name: (html, "") for name, html in pages.items()})
    text = "\n\n".join(f"w{n}" for n in range(count)) + "\n"
    assert found["open"] == text and found["flat"] == text and found["spaces"] == "a b\n"


def test_invariants_and_partitioning(spark):
    from checks.derived import pages
    frame = pages(spark, "/root/testdata/sf0.001")
    one = {r.page_id: r.markdown for r in to_markdown(frame.coalesce(1)).collect()}
    many = {r.page_id: r.markdown for r in to_markdown(frame.repartition(7)).collect()}
    assert one == many and len(one) == frame.count()
    for text in one.values():
        assert text.endswith("\n") and not text.endswith("\n\n")
        assert "\n\n\n" not in text and " \n" not in text
