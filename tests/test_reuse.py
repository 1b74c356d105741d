"""One parse for many uses: page lengths, bucketed tables of parsed pages, observed totals."""

import pytest
from pyspark.sql import functions as F

from pagesmelt import parse_pages, to_markdown
from pagesmelt.operators.nodes import read_parsed, write_parsed
from pagesmelt.operators.reports import batch_summary, observed_batch, page_stats
from pagesmelt.plans.convert import convert_parsed, markdown_documents

PAGES = [
    (1, "http://h/a", "<h1>A</h1><p>x <a href='/y'>y</a> <b>z"), (2, "http://h/b", ""),
    (3, "http://h/c", None), (4, "http://h/d", "<ul><li>ä</li><li>😀</li></ul>")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def executed(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_lengths_come_from_the_parse(spark, pages, tmp_path):
    pages.write.parquet(str(tmp_path / "pages"))
    stats = page_stats(spark.read.parquet(str(tmp_path / "pages")))
    found = {r.page_id: (r.html_chars, r.markdown_chars, r.markdown_links) for r in stats.collect()}
    assert found == {1: (len(PAGES[0][2]), len("# A\n\nx [y](http://h/y) **z**\n"), 1),
                     2: (0, 1, 0), 3: (None, 1, 0), 4: (len(PAGES[3][2]), len("* ä\n* 😀\n"), 0)}
    plan = executed(stats)
    assert plan.count("ArrowEvalPython") == 1
    reads = [line for line in plan.splitlines() if "ReadSchema" in line and "html" in line.split("ReadSchema")[1]]
    assert len(reads) == 1


def test_bucketed_pages_are_not_dealt_out_again(spark, pages):
    parsed = parse_pages(pages.select("page_id", F.col("url").alias("base"), "html"), "base")
    spark.sql("DROP TABLE IF EXISTS parsed_pages")
    write_parsed(parsed, "parsed_pages", 4)
    try:
        kept = read_parsed(spark, "parsed_pages")
        expected = sorted(to_markdown(pages).collect())
        for options in ({}, {"content": "dom"}, {"links": "text", "images": "strip"}):
            frame = convert_parsed(kept, **options)
            plan = executed(frame)
            assert "Exchange" not in plan and "ArrowEvalPython" not in plan, plan
            assert "SelectedBucketsCount" in plan
        assert sorted(convert_parsed(kept).collect()) == expected
        # One page reads one bucket.
        plan = executed(convert_parsed(kept.where("page_id = 4")))
        assert "SelectedBucketsCount: 1 out of 4" in plan
        # Without its partitioning the mark does no harm.
        assert sorted(convert_parsed(kept.repartition(3)).collect()) == expected
    finally:
        spark.sql("DROP TABLE IF EXISTS parsed_pages")


def test_observed_totals_are_those_of_the_summary(spark):
    captures = spark.range(50).selectExpr("id AS ord", "CASE WHEN id % 7 = 0 THEN 'late' END AS error")
    watched, totals = observed_batch(captures)
    assert watched.where("ord < 60").count() == 50
    summary = batch_summary(captures).first().asDict()
    assert totals.get == {name: summary[name] for name in ("url_count", "ok_count", "failed_count")}


def test_partitions_of_parsed_pages_are_not_merged(spark, tmp_path):
    """A task of a conversion gets its share of the pages, not what packs into one advised size."""
    spark.range(64).selectExpr("id AS page_id", "'http://h/' AS url", "'<p>x' AS html").write.parquet(
        str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    for frame in (to_markdown(pages, content="dom"), markdown_documents(pages), page_stats(pages)):
        assert frame.groupBy(F.spark_partition_id()).count().count() == 4
        plan = executed(frame)
        assert plan.count("ArrowEvalPython") == 1
