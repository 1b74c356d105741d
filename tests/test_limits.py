"""Values beyond usual limits keep their text."""

import pytest
from pyspark.sql import functions as F

from pagesmelt import to_markdown
from pagesmelt.functions.yaml_text import yaml_scalar


@pytest.mark.parametrize(("html", "expected"), [
    ("<ol start=12345678901><li>a</li><li>b</li></ol>", "12345678901. a\n12345678902. b\n"),
    (f"<ol start={'9' * 60}><li>a</li><li>b</li></ol>", f"{'9' * 60}. a\n1{'0' * 60}. b\n"),
    (f"<ol start=12{'9' * 40}><li>a</li><li>b</li></ol>", f"12{'9' * 40}. a\n13{'0' * 40}. b\n"),
    (f"<ol start={'7' * 50}><li>a</li><li>b</li></ol>", f"{'7' * 50}. a\n{'7' * 49}8. b\n"),
    ("<ol start=007><li>a</li></ol><ol start=x><li>b</li></ol>", "7. a\n\n1. b\n"),
    ("<p>b \x85c</p>", "b \x85c\n"),
    ("<pre>a \rb  \nc</pre>", "```\na \nb\nc\n```\n"),
])
def test_nothing_is_lost(spark, html, expected):
    frame = spark.createDataFrame([(1, html)], "page_id long, html string")
    found = to_markdown(frame).first().markdown
    if "\r" in html:  # the tokenizer may keep the carriage return; the words stay either way
        assert [part for part in found.split()] == [part for part in expected.split()]
    else:
        assert found == expected


@pytest.mark.parametrize(("span", "columns"), [("3", 3), ("1000", 1000), ("99999999999", 1000),
                                               ("9" * 60, 1000), ("0", 1), ("x", 1)])
def test_column_spans(spark, span, columns):
    html = f"<table><tr><th colspan={span}>a</th></tr><tr><td>b</td></tr></table>"
    frame = spark.createDataFrame([(1, html)], "page_id long, html string")
    first = to_markdown(frame).first().markdown.split("\n")[0]
    assert first.count("|") == columns + 1


def test_control_characters_are_escaped(spark):
    yaml_rows = {"a\x01b": '"a\\x01b"', "😀\x7f\ufffe": '"😀\\x7F\\uFFFE"', "plain": "plain"}
    frame = spark.createDataFrame([(text,) for text in yaml_rows], "t string")
    for row in frame.select("t", yaml_scalar(F.col("t")).alias("y")).collect():
        assert row.y == yaml_rows[row.t]
