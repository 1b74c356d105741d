"""Pages, responses and captures derived from the given tables, for what ``pages`` lacks.

Every document becomes one page around its whole text; which features a page has follows from
``doc_id``.  The SQL the results are compared with never sees this HTML: it states what the
conversion must yield from the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesmelt.sources.readers import read_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(
        spark, f"{sf_dir}/pages.parquet", spark.sparkContext.defaultParallelism)


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _when(step: int, html: str, otherwise: str = "''") -> str:
    return f"CASE WHEN doc_id % {step} = 0 THEN concat({html}) ELSE {otherwise} END"


_HEAD = f"""concat(
  '<!DOCTYPE html><html lang="', lang, '"><head>',
  {_when(2, "'<meta property=\"og:title\" content=\"Doc ', doc_id, ': a &quot;b&quot;\">'",
         "concat('<title>Doc ', doc_id, '</title>')")},
  {_when(3, "'<meta name=\"description\" content=\" About ', doc_id, ' \">'")},
  {_when(4, "'<link rel=\"canonical\" href=\"/d/', doc_id, '\">'")},
  '<meta name="author" content=""><meta property="article:author" content="A', doc_id, '">',
  '<meta name="date" content="2024-01-02"></head>')"""

_MAIN = f"""concat(
  '<main id="m', doc_id, '"><h1>Doc ', doc_id, '</h1><h2> </h2><a href="/empty"> </a>',
  '<p>', {_ESCAPED}, '</p>',
  {_when(6, "'<img src=\"i/', doc_id, '.png\" alt=\"Image ', doc_id, '\">'",
         "concat('<img src=\"spacer.png\" alt=\"\">')")},
  '<p>See <a href="../x/', doc_id, '?q=1#f">link ', doc_id, '</a>.</p>',
  {_when(7, "'<pre><code class=\"hl language-python\">x = ', doc_id, '\\n    y = 2</code></pre>'")},
  {_when(8, "'<table><tr><th>K</th><th>V</th></tr><tr><td>', doc_id, '</td><td>b</td></tr></table>'")},
  '</main>')"""

_BODY = f"""concat(
  '<body><header role="banner">Top ', doc_id, '</header>',
  {_when(5, "'<p hidden>hidden ', doc_id, '</p><div style=\"display: none\"><p>styled</p></div>',"
            "'<p aria-hidden=\"TRUE\">aria</p><div role=\"Dialog\">dialog</div>'")},
  '<div class="cookie-note wide">cookies</div>', {_MAIN},
  {_when(10, "'<div class=\"post\"><p>Second part ', doc_id, ', with words to rank. And more of "
             "them, to be long enough to count.</p></div>'")},
  '<p class="shared-context">Kept ', doc_id, '.</p><div id="ad-slot">Buy</div></body></html>')"""

_SHELL = f"""concat('<html><body><div id="root"></div><noscript>', {_ESCAPED},
  '</noscript><p>Please enable JavaScript to view ', doc_id, '.</p></body></html>')"""

SITE = "concat('https://site', doc_id % 7, '.example/docs/', doc_id, '/page.html')"


def derived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, html``: one page per document, a ninth of them empty app shells."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    documents = documents.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    return documents.selectExpr(
        "doc_id AS page_id", f"{SITE} AS url",
        f"CASE WHEN doc_id % 9 = 0 THEN {_SHELL} ELSE concat({_HEAD}, {_BODY}) END AS html")


def derived_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a raw response in one of four charsets and media types."""
    return pages(spark, sf_dir).selectExpr(
        "page_id AS ord", "url",
        "CASE WHEN page_id % 3 = 0 THEN concat(url, '/moved') END AS final_url",
        """CASE page_id % 6 WHEN 0 THEN 'text/html; charset=UTF-8' WHEN 1 THEN 'TEXT/HTML'
           WHEN 2 THEN 'text/html;charset="utf-16be"' WHEN 3 THEN 'application/pdf'
           WHEN 4 THEN 'application/xhtml+xml; q=1; charset=utf8' END AS content_type""",
        "'' AS content_encoding",
        """CASE WHEN page_id % 6 = 2 THEN encode(html, 'UTF-16BE') ELSE encode(html, 'UTF-8') END
           AS body""")


def derived_captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests, static captures and rendered captures, with failures of each kind."""
    source = derived_pages(spark, sf_dir)
    requests = source.selectExpr("page_id AS ord", "url")
    static = source.selectExpr(
        "page_id AS ord", "CASE WHEN page_id % 11 <> 0 THEN html END AS html",
        "CASE WHEN page_id % 11 = 0 THEN 'HTTP Error 500' END AS error",
        "CASE WHEN page_id % 4 = 0 THEN concat(url, '?to=', page_id) END AS final_url")
    rendered = source.selectExpr(
        "page_id AS ord", "concat('<p>rendered ', page_id, '</p>') AS html",
        "CAST(NULL AS string) AS error", "page_id % 13 = 0 AS nav_timed_out").where("ord % 33 <> 0")
    return requests, static, rendered


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered and nested lists, a quote around the whole text, a rule and a code block."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS page_id", f"""concat(
          '<ol start="', doc_id, '"><li>', source, '</li><li>', lang, '<ul><li>n ', doc_id,
          '</li></ul></li></ol><blockquote><p>', {_ESCAPED}, '</p><ul><li>q</li></ul></blockquote><hr>',
          '<pre data-lang="', lang, '">\n\n  x = ', doc_id, '  \n</pre>') AS html""")


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article around the whole text, and in it what does not belong there."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS page_id", f"""concat(
          '<body><div class="sidebar"><a href="/1">Side ', doc_id, '</a></div><article><h2>Head ', doc_id,
          '</h2><p>', {_ESCAPED}, '</p><p>Second part of page ', doc_id, ', long enough to be read, and ',
          'with more than one clause, so that it counts.</p><ul><li><a href="/2">the first related page',
          '</a></li><li><a href="/3">the second related page</a></li></ul><form><p>Sign up</p></form>',
          '<div class="promo"><p>Buy now</p></div></article></body>') AS html""")


def odd_markup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked sections no tokenizer knows, in the middle of a page; every twentieth has no markup."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS page_id", f"""CASE WHEN doc_id % 20 > 0 THEN concat(
          '<h1>Page ', doc_id, '</h1><![', source, '[x]]><p>', {_ESCAPED}, '</p><![ ',
          lang, '>end') END AS html""")


def role_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content in an element whose role says so, beside a class of the same label twice."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS page_id", f"""concat(
          '<div class="entry"><p>First ', doc_id, '.</p></div><section role="Main"><p>', {_ESCAPED},
          '</p><p>Role ', doc_id, ', and words enough, that no page is too short to be taken as ',
          'content by what it has.</p></section><div class="entry"><p>Last.</p></div>') AS html""")
