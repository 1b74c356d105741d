"""Pages to the node table every later operator works on."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmelt.functions.text import text_trim
from pagesmelt.functions.urls import (
    resolve_srcset_sql,
    resolve_url,
    resolve_url_sql,
    url_parts_sql,
)
from pagesmelt.operators import tagsoup

# Marks the key of a table whose buckets hold whole pages.
_TOGETHER = "pages_together"
NODE_FIELDS = tuple(field.name for field in tagsoup.NODE_TYPE)

# Executors need no copy of this package: the walker travels with the plan.
cloudpickle.register_pickle_by_value(tagsoup)


def parse_pages(
    pages: DataFrame, base_url: str | None = None, errors: bool = False
) -> DataFrame:
    """Replace ``html`` by ``nodes``, one array per page; null where the markup is refused.

    With ``base_url``, a column, every ``href``, ``src`` and ``srcset`` is made absolute.  With
    ``errors``, ``parse_error`` says why there are no nodes, from the same pass.
    Narrow: no shuffle, one row per page.  Parsing is the dear step, so the array is what gets
    shuffled and shared by the operators that read one page more than once.
    """
    walk = F.arrow_udf(tagsoup.walk_batches, tagsoup.WALKED_TYPE)
    others = [name for name in pages.columns if name not in ("html", "nodes")]
    walked = pages.select(*others, walk(F.col("html")).alias("_walked"))
    error = [F.col("_walked.error").alias("parse_error")] if errors else []
    parsed = walked.select(*others, F.col("_walked.nodes").alias("nodes"), *error)
    if base_url is None:
        return parsed
    split = parsed.selectExpr("*", f"{url_parts_sql(base_url)} AS _base")
    return split.select(
        *others, F.expr(_absolute_nodes(base_url)).alias("nodes"), *(["parse_error"] if errors else []))


def parse_failures(pages: DataFrame) -> DataFrame:
    """Pages of which nothing can be read, and why.

    Sections of an unknown kind (``<![x[``) are comments, as browsers have it, so what is left are
    pages without any HTML and what the tokenizer may still refuse.
    """
    parsed = parse_pages(pages.select("page_id", "html"), errors=True)
    return parsed.where("nodes IS NULL").select(
        "page_id", F.coalesce("parse_error", F.lit("no markup")).alias("error"))


def _absolute_nodes(base_url: str) -> str:
    """The ``nodes`` array with the URL attributes of its elements resolved."""
    attrs = f"""transform_values(n.attrs, (k, v) -> CASE
        WHEN k IN ('href', 'src') THEN {resolve_url_sql(base_url, 'v', '_base')}
        WHEN k = 'srcset' THEN {resolve_srcset_sql(base_url, 'v', '_base')} ELSE v END)"""
    fields = ", ".join(
        f"'{name}', " + (attrs if name == "attrs" else f"n.{name}") for name in NODE_FIELDS)
    return f"""
        CASE WHEN {base_url} IS NULL THEN nodes ELSE transform(nodes, n -> CASE
          WHEN map_contains_key(n.attrs, 'href') OR map_contains_key(n.attrs, 'src')
               OR map_contains_key(n.attrs, 'srcset')
          THEN named_struct({fields}) ELSE n END) END"""


def write_parsed(parsed: DataFrame, table: str, buckets: int) -> None:
    """Parsed pages as a table bucketed by ``page_id``, for several conversions of one corpus.

    Choose ``buckets`` for the corpus, a few hundred MB of nodes each.  What ``read_parsed``
    yields needs no exchange, parse or sort of whole pages again.
    """
    marked = F.col("page_id").alias("page_id", metadata={_TOGETHER: True})
    others = [name for name in parsed.columns if name != "page_id"]
    parsed.select(marked, *others).repartition(buckets, "page_id").write.bucketBy(
        buckets, "page_id").sortBy("page_id").format("parquet").saveAsTable(table)


def read_parsed(spark: SparkSession, table: str) -> DataFrame:
    """Parsed pages of a table that ``write_parsed`` wrote."""
    return spark.table(table)


def shared(parsed: DataFrame) -> DataFrame:
    """Parsed pages hash partitioned on ``page_id``: the exchange all operators reuse.

    The number of partitions is named, so that it holds: Spark would merge them up to 64 MB, which
    is the size of packed arrays; sorted node rows take some 27 times as much of a task's memory.
    A bucketed table is partitioned already; should a step in between have lost that, Spark
    itself deals the node rows out again.
    """
    pages = parsed.select("page_id", "nodes")
    if parsed.schema["page_id"].metadata.get(_TOGETHER):
        return pages
    partitions = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(partitions, "page_id")


def node_rows(parsed: DataFrame) -> DataFrame:
    """One row per element, text run or comment, hash partitioned on ``page_id``.

    The one exchange of a conversion moves whole pages, before they are exploded; windows and
    groupings on ``page_id`` further up add none.  Pages without nodes keep one row whose
    ``pre`` is null, so that no page is lost.
    """
    return shared(parsed).select("page_id", F.inline_outer("nodes"))


def page_links(pages: DataFrame, base_url: str = "url") -> DataFrame:
    """Every ``a`` with an ``href``: as written and absolute, numbered in document order."""
    links = parse_pages(pages.select("page_id", base_url, "html")).select(
        "page_id", base_url,
        F.posexplode(F.expr(
            "transform(filter(nodes, n -> n.tag = 'a' AND map_contains_key(n.attrs, 'href')), "
            "n -> n.attrs['href'])")).alias("link_no", "href"))
    return links.select(
        "page_id", "link_no", "href", resolve_url(base_url, "href").alias("resolved"))


def is_run() -> Column:
    """A node row that is readable, non-blank text."""
    return (F.col("kind") == "text") & ~F.col("raw") & (text_trim(F.col("text")) != "")


def run_length() -> Column:
    """Length of the trimmed text of a readable run, else null."""
    return F.when(is_run(), F.length(text_trim(F.col("text"))))


def joined_length(total: Column, runs: Column) -> Column:
    """Length of ``runs`` texts of ``total`` characters joined by single spaces."""
    return F.greatest(total + runs - 1, F.lit(0))


def with_closes(rows: DataFrame, closing: Column) -> DataFrame:
    """Add ``pos`` and, for the elements ``closing`` selects, a second row at their end.

    With opening and closing rows in one order, every subtree total is the difference of two
    running totals: linear in the page, however deeply unclosed tags nest.
    """
    return rows.withColumn(
        "pos",
        F.explode_outer(
            F.when((F.col("kind") == "elem") & closing, F.array("pre", "post"))
            .otherwise(F.array("pre"))))
