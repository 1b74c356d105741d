"""Tables the conversions start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesmelt.functions.text import text_trim

PAGES_SCHEMA = "page_id bigint, url string, html string"
RESPONSES_SCHEMA = (
    "ord bigint, url string, final_url string, content_type string, content_encoding string, "
    "body binary")
#: Ranges of buckets whose totals are put in one order.
GROUPS = 64
# Where one line ends and the next begins, for text read by Unicode rules.
_LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table of pages; with ``partitions`` spread over so many first.

    Parsing is the dear step: ask for partitions when the files are few.  Large tables split by
    themselves.
    """
    pages = spark.read.parquet(path)
    return pages if partitions is None else pages.repartition(partitions, "page_id")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSES_SCHEMA).parquet(path)


def read_html_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``ord, path, html`` for HTML files: named files of any suffix, and the ``*.html`` of directories.

    Files are numbered in the order of the arguments, those of a directory by name; a file named twice
    has two rows.  A path that does not exist is an error.  Contents are not moved for
    the numbering: places are found from the paths alone.
    """
    paths_of = spark._jvm.org.apache.hadoop.fs.Path
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    corpus = None
    for place, path in enumerate(paths):
        reader = spark.read.format("binaryFile")
        named = paths_of(path)
        if named.getFileSystem(settings).getFileStatus(named).isDirectory():
            reader = reader.option("pathGlobFilter", "*.html")
        files = reader.load(path).select(F.lit(place).alias("_argument"), "path", "content")
        corpus = files if corpus is None else corpus.unionByName(files)
    if corpus is None:
        raise ValueError("at least one path is needed")
    places = numbered(corpus.select("_argument", "path"), "_argument", "path")
    return corpus.join(places, ["_argument", "path"]).select(
        "ord", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def url_lines(lines: DataFrame) -> DataFrame:
    """URLs of a list: trimmed lines that are neither blank nor comments."""
    line = text_trim(F.col("line"))
    return lines.withColumn("url", line).where(
        (F.col("url") != "") & ~F.startswith("url", F.lit("#"))).drop("line")


def _ordered_groups(sizes: DataFrame, bucket: tuple[str, ...]) -> DataFrame:
    """Adds ``_group``: buckets fall into ``GROUPS`` ranges at most, in their order.

    Any bounds give the same numbers in the end.  These are drawn by hash, so that ranges
    hold about equally many buckets; they are a few rows and become part of the plan.
    """
    drawn = sizes.select(*bucket).orderBy(F.xxhash64(*bucket)).limit(GROUPS - 1).collect()
    kinds = dict(sizes.dtypes)
    bounds = F.array(*(
        F.struct(*(F.lit(row[name]).cast(kinds[name]).alias(name) for name in bucket))
        for row in drawn))
    return sizes.withColumn("_group", F.size(F.filter(
        bounds, lambda bound: bound < F.struct(*bucket))) if drawn else F.lit(0))


def numbered(rows: DataFrame, *bucket: str, within: str | None = None) -> DataFrame:
    """Adds ``ord``: places 0, 1, 2, … in the order of ``bucket`` columns, then ``within``.

    Buckets are bounded pieces of the input, such as file splits.  Their sizes are summed inside
    ranges of buckets, and only the totals of ranges, ``GROUPS`` of them, meet in one place; rows are
    numbered inside their bucket.  Nothing grows with the input in one task.
    Columns without a part in the order are handed through.
    """
    sizes = _ordered_groups(rows.groupBy(*bucket).count(), bucket)
    before, totals = 0, {}
    for group, total in sorted(sizes.groupBy("_group").agg(F.sum("count")).collect()):
        totals[group], before = before, before + total
    starts = F.create_map(*(F.lit(part) for pair in totals.items() for part in pair)) if totals else (
        F.create_map(F.lit(0), F.lit(0)))
    inside = F.sum("count").over(Window.partitionBy("_group").orderBy(*bucket).rowsBetween(
        Window.unboundedPreceding, -1))
    placed = sizes.select(*bucket, (
        F.coalesce(inside, F.lit(0)) + starts[F.col("_group")].cast("long")).alias("_start"))
    order = Window.partitionBy(*bucket).orderBy(within or F.lit(0))
    return rows.withColumn("_place", F.row_number().over(order) - 1).join(
        placed, [*bucket]).withColumn("ord", F.col("_start") + F.col("_place")).drop(
        "_start", "_place")


def read_url_list(spark: SparkSession, path: str | None = None, urls: Sequence[str] = ()) -> DataFrame:
    """``ord, url`` from literal URLs and then a UTF-8 file of one URL per line.

    Order and duplicates are kept.  Large files are split and read in parallel.
    """
    literal = spark.createDataFrame(
        [(0, 0, place, url) for place, url in enumerate(urls)],
        "source int, block long, pos long, url string")
    if path is None:
        return literal.select(F.col("pos").alias("ord"), "url")
    raw = spark.read.text(path).select(
        F.lit(1).alias("source"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_line"), "value")
    lines = raw.select(
        "source", "file", "block", "_line",
        F.posexplode(F.split("value", _LINE_BREAK)).alias("_part", "line"))
    listed = url_lines(lines).select(
        "source", "file", "block", F.struct("_line", "_part").alias("pos"), "url")
    given = literal.select(
        "source", F.lit("").alias("file"), "block",
        F.struct(F.col("pos").alias("_line"), F.lit(0).alias("_part")).alias("pos"), "url")
    return numbered(
        given.unionByName(listed), "source", "file", "block", within="pos").select("ord", "url")
