import random
from urllib.parse import unquote, urljoin

from pyspark.sql import functions as F

from pagesmelt.functions import (
    joined_output_path,
    output_name,
    percent_decode,
    resolve_srcset,
    resolve_url,
    text_trim,
    yaml_scalar,
)
from pagesmelt.functions.numbers import round_exact

BASES = ["https://h.example/products/page/?q=1#f", "https://h.example", "http://h/a/b?x",
         "https://h/a//b/", "", "mailto:x@y", "file:///a/b", "//h/x", None]
REFERENCES = ["", "#x", "?a=1", "../api", "//cdn/x", "a/../b/./c", "mailto:q", "javascript:void(0)",
              "data:x", "/abs/./x/..", "..", ".", "./", "g?y/./x", "HTTP://x/Y", "http:foo", " /sp",
              "a\nb", "/a//b", "x//y", "?", "#", "a b", "é/ü", "/..", "//h2", "x/..?q", "/?#"]


def test_resolve_url_agrees_with_the_standard_library(spark):
    pairs = [(base, ref) for base in BASES for ref in REFERENCES]
    rows = spark.createDataFrame(pairs, "base string, ref string").select(
        "base", "ref", resolve_url("base", "ref").alias("found")).collect()
    wrong = [(r.base, r.ref, r.found) for r in rows if r.found != urljoin(r.base or "", r.ref)]
    assert wrong == []


def test_resolve_srcset(spark):
    frame = spark.createDataFrame(
        [("https://h/p/q/", "a.png 480w, , /b.png   2x,../c.png")], "b string, s string")
    assert frame.select(resolve_srcset("b", "s")).first()[0] == (
        "https://h/p/q/a.png 480w, https://h/b.png 2x, https://h/p/c.png")


def test_output_names(spark):
    expected = {
        "https://h/some/deep/page": "page.md", "https://h/p.html?a=b.c#d/e": "p.md",
        "https://h": "index.md", "https://h/": "index.md", "https://h/a/b//": "b.md",
        "https://h/%E3%81%82.x.html": "あ.x.md", "https://h/.hidden": "index.md",
        "https://h/a%2Fb": "a/b.md", "https://h/a+b%zz": "a+b%zz.md", "http://h/a b": "a b.md",
    }
    rows = spark.createDataFrame([(url,) for url in expected], "url string").select(
        "url", output_name(F.col("url")).alias("name")).collect()
    assert {r.url: r.name for r in rows} == expected
    path = spark.range(1).select(joined_output_path(F.lit("out/"), F.lit("a.md"))).first()[0]
    assert path == "out/a.md"


def test_percent_decode(spark):
    texts = ["a%20b", "+%2B", "%zz%4", "%E3%81%82", "100%", "%25zz"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", percent_decode(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [unquote(t) for t in texts]


def test_text_trim_is_unicode_wide(spark):
    texts = ["\xa0 a　", "\x1c\x85b ", "​c", "", " \t\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        text_trim(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [t.strip() for t in texts]


def test_yaml_scalars_read_back(spark):
    import pytest
    yaml = pytest.importorskip("yaml")
    texts = ["Example", "a: b", "yes", "12", "2024-01-02", "#x", "tab\tx", 'q"\\', "é ü", "- a",
             "null", "~", " lead", "trail ", "a\nb", "x y", "%", "@a", "true", "a #b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", yaml_scalar(F.col("t")).alias("y")).collect()
    assert [yaml.safe_load("k: " + r.y)["k"] for r in rows] == texts


def test_round_exact(spark):
    random.seed(5)
    numbers = [2.675, 0.0025, 0.6505, 0.125, 0.985, 0.0, 1.0, 3134.1749999999997]
    numbers += [random.randint(0, 10 ** 6) / 1000 for _ in range(3000)]
    numbers += [random.randint(1, 5000) * (1 - random.random()) for _ in range(3000)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n double").select(
        "n", round_exact("n", 2).alias("two"), round_exact("n", 3).alias("three")).collect()
    assert all(r.two == round(r.n, 2) and r.three == round(r.n, 3) for r in rows)
