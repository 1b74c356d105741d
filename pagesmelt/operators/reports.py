"""Aggregations and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagesmelt.fixed_values import MARKDOWN_LINK
from pagesmelt.functions.urls import joined_output_path, output_name
from pagesmelt.operators.clean import clean_nodes
from pagesmelt.operators.nodes import is_run, joined_length, node_rows, parse_pages, run_length
from pagesmelt.plans.convert import choices, root_rows, to_markdown_with_lengths

EXTRACTORS = ("full", "dom", "readability")


def output_collisions(urls: DataFrame, directory: str = ".") -> DataFrame:
    """Output paths more than one URL of a batch would be written to, sorted."""
    path = joined_output_path(F.lit(directory), output_name(F.col("url")))
    return (
        urls.select(path.alias("output_path"))
        .groupBy("output_path").count().where("count > 1")
        .select("output_path", F.col("count").alias("url_count")).orderBy("output_path"))


def link_count(markdown: Column) -> Column:
    return F.regexp_count(markdown, F.lit(MARKDOWN_LINK))


def page_stats(pages: DataFrame, **options) -> DataFrame:
    """Size of the input and the output of every page, and the links in the output.

    The HTML is read once: its length is taken while it is parsed.  Addresses are a second, narrow read.
    """
    converted = to_markdown_with_lengths(pages, **options).select(
        "page_id", "html_chars", F.length("markdown").alias("markdown_chars"),
        link_count(F.col("markdown")).alias("markdown_links"))
    # A left join: an inner one would filter one of the two uses of the shared exchange.
    paths = pages.select("page_id", F.col("url").alias("path"))
    return converted.join(paths, "page_id", "left").select(
        "page_id", "path", "html_chars", "markdown_chars", "markdown_links")


def extraction_quality(
    pages: DataFrame, extractors: tuple[str, ...] = EXTRACTORS
) -> DataFrame:
    """What each extractor keeps of each page: text, headings, code, tables and images."""
    parsed = parse_pages(pages.select("page_id", "html"))
    clean = clean_nodes(node_rows(parsed))

    def kept(extractor: str) -> DataFrame:
        chosen = None if extractor == "full" else choices(parsed, extractor)
        rows = root_rows(clean, chosen)
        length = run_length()

        def count(*tags: str) -> Column:
            return F.count_if(F.col("tag").isin(*tags))

        return rows.groupBy("page_id").agg(
            joined_length(F.coalesce(F.sum(length), F.lit(0)), F.count_if(is_run())).alias(
                "text_length"),
            count("h1", "h2", "h3").alias("headings"), count("pre", "code").alias("code_blocks"),
            count("table").alias("tables"), count("img").alias("images"),
        ).withColumn("extractor", F.lit(extractor))

    report = kept(extractors[0])
    for extractor in extractors[1:]:
        report = report.unionByName(kept(extractor))
    return report


def quality_means(quality: DataFrame) -> DataFrame:
    """Corpus means per extractor."""
    names = ("text_length", "headings", "code_blocks", "tables", "images")
    return quality.groupBy("extractor").agg(
        F.count("*").alias("pages"), *[F.avg(name).alias(f"mean_{name}") for name in names])


def marker_retention(outputs: DataFrame, markers: DataFrame) -> DataFrame:
    """Share of each case's markers its output contains.

    ``outputs`` holds ``case_id, output``; ``markers`` holds ``case_id, marker``.
    """
    found = F.contains("output", "marker").cast("int")
    return markers.join(outputs, "case_id").groupBy("case_id").agg(
        F.count("*").alias("markers"), F.avg(found).alias("marker_retention"))


def batch_summary(captures: DataFrame) -> DataFrame:
    """Counts and overall status; the failed URLs themselves are ``failed_captures``."""
    failed = F.col("error").isNotNull()
    return captures.agg(
        F.count("*").alias("url_count"), F.count_if(~failed).alias("ok_count"),
        F.count_if(failed).alias("failed_count")).withColumn(
        "failed", F.col("failed_count") > 0)


def observed_batch(captures: DataFrame, name: str = "batch") -> tuple[DataFrame, Observation]:
    """The captures as they are, and an observation of ``batch_summary``'s totals.

    The totals are there once any action has gone through the captures: ``observation.get``.
    """
    seen, failed = Observation(name), F.col("error").isNotNull()
    return captures.observe(
        seen, F.count("*").alias("url_count"), F.count_if(~failed).alias("ok_count"),
        F.count_if(failed).alias("failed_count")), seen


def failed_captures(captures: DataFrame) -> DataFrame:
    return captures.where("error IS NOT NULL").select("ord", "url", "error")


def capture_timing(metrics: DataFrame) -> DataFrame:
    """Timing rows followed by one row of means."""
    names = ("browser_launch_seconds", "navigation_seconds")
    detail = metrics.select("url", *names, F.lit(None).cast("string").alias("summary"))
    mean = metrics.agg(*[F.avg(name).alias(name) for name in names]).select(
        F.lit(None).cast("string").alias("url"), *names, F.lit("mean").alias("summary"))
    return detail.unionByName(mean)
