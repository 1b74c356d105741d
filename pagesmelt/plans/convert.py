"""Whole conversions: pages in, Markdown and decisions out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesmelt.fixed_values import REASON_FULL, REASON_NO_CANDIDATE, REASON_READABILITY
from pagesmelt.functions.urls import joined_output_path, output_name
from pagesmelt.functions.yaml_text import front_matter as front_matter_text
from pagesmelt.functions.yaml_text import iso_timestamp
from pagesmelt.operators.candidates import (
    CANDIDATE_TYPE,
    content_candidates,
    dom_choice,
    dom_reason,
    is_acceptable,
)
from pagesmelt.operators.clean import clean_nodes
from pagesmelt.operators.metadata import page_metadata
from pagesmelt.operators.nodes import node_rows, parse_pages, shared
from pagesmelt.operators.readability import readability_choice
from pagesmelt.operators.render import apply_policies, render_markdown

LINKS = ("keep", "text", "strip")
IMAGES = ("keep", "alt", "strip")
CONTENT = ("full", "dom", "readability", "auto")


def _check(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {value!r}")


def with_base_url(pages: DataFrame) -> DataFrame:
    """Pages with ``base_url``: where a capture ended up, else the URL asked for."""
    if "base_url" in pages.columns:
        return pages
    if "final_url" in pages.columns:
        return pages.withColumn("base_url", F.coalesce("final_url", "url"))
    if "url" in pages.columns:
        return pages.withColumn("base_url", F.col("url"))
    return pages.withColumn("base_url", F.lit(None).cast("string"))


def _aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join of two tables of the same parsed pages on ``page_id``, without another exchange.

    Spark infers a filter against null keys for ``right`` alone.  Pushed below the shared exchange,
    it would make the two sides differ and the pages be parsed twice; no filter moves past a
    projection that numbers rows, so it stays above.
    """
    held = F.monotonically_increasing_id() >= 0
    return left.join(right.select("page_id", *(
        F.when(held, F.col(name)).alias(name) for name in right.columns if name != "page_id")),
        "page_id", "left")


def choices(parsed: DataFrame, content: str) -> DataFrame:
    """Decisions and, as ``roots``, the subtrees to convert; null means the full page.

    ``cuts`` are subtrees inside the roots that do not belong to the article.
    Pages without any candidate have no row; ``extraction_decisions`` adds them.
    """
    _check("content", content, CONTENT[1:])
    clean = clean_nodes(node_rows(parsed))
    dom = dom_choice(content_candidates(clean))
    best, own = F.col("best"), F.lit(None).cast(CANDIDATE_TYPE)
    own_roots = own_cuts = F.lit(None).cast("array<int>")
    after_readability = content in ("readability", "auto")
    if after_readability:
        dom = dom.join(readability_choice(root_rows(clean)), "page_id", "full")
        own, own_roots, own_cuts = F.col("own"), F.col("own_roots"), F.col("own_cuts")
    by_own = F.coalesce(is_acceptable(own), F.lit(False))
    by_dom = F.coalesce(is_acceptable(best), F.lit(False))
    return dom.select(
        "page_id",
        F.when(by_own, F.lit("readability")).when(by_dom, best["selector"]).otherwise(
            F.lit("full")).alias("selected"),
        F.when(by_own, F.lit(REASON_READABILITY)).otherwise(
            dom_reason(after_readability)).alias("reason"),
        F.when(by_own, F.array(own)).otherwise(F.col("candidates")).alias("candidates"),
        F.when(by_own, own_roots).when(by_dom, F.array("root_pre")).alias("roots"),
        F.when(by_own, own_cuts).alias("cuts"))


def extraction_decisions(pages: DataFrame, content: str = "auto") -> DataFrame:
    """Mode, selected root, reason and candidates (best first) for every page."""
    _check("content", content, CONTENT)
    none = F.array().cast(f"array<{CANDIDATE_TYPE}>")
    every = pages.select("page_id", F.lit(content).alias("requested_mode"))
    if content == "full":
        return every.select(
            "*", F.lit("full").alias("selected"), F.lit(REASON_FULL).alias("reason"),
            none.alias("candidates"))
    chosen = choices(parse_pages(pages), content)
    return every.repartition("page_id").join(chosen, "page_id", "left").select(
        "page_id", "requested_mode",
        F.coalesce("selected", F.lit("full")).alias("selected"),
        F.coalesce("reason", F.lit(REASON_NO_CANDIDATE)).alias("reason"),
        F.coalesce("candidates", none).alias("candidates"))


def root_rows(clean: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Node rows below the chosen roots; below ``body``, or all of them, for a full page.

    The row of the page itself always stays.  Each root, and each of the optional ``cuts`` inside
    them, becomes a mark just before its element, and the lists are gone before rows are sorted, so
    that many roots cost no more than many nodes.
    """
    page = Window.partitionBy("page_id")
    itself = F.coalesce(F.col("kind") == "page", F.lit(True))
    body = F.min(F.when(F.col("tag") == "body", F.struct("pre", "post"))).over(page)
    rows = clean.withColumn("_body", body)
    in_page = itself | F.col("_body").isNull() | F.col("pre").between(
        F.col("_body")["pre"], F.col("_body")["post"])
    if chosen is None:
        return rows.where(in_page).drop("_body")
    cuts = F.col("cuts") if "cuts" in chosen.columns else F.lit(None).cast("array<int>")
    lists = chosen.select("page_id", "roots", cuts.alias("cuts"))

    def marks(name: str, is_cut: bool) -> Column:
        named = F.transform(F.coalesce(F.col(name), F.array().cast("array<int>")), lambda pre: F.struct(
            pre.alias("pre"), F.lit(is_cut).alias("cut")))
        return F.when(F.col("kind") == "page", named)

    own = F.array(F.lit(None).cast("struct<pre:int,cut:boolean>"))
    marked = (
        _aligned(rows, lists)
        .withColumn("_chosen", F.col("roots").isNotNull())
        .withColumn("_mark", F.explode(F.coalesce(
            F.concat(own, marks("roots", False), marks("cuts", True)), own)))
        .drop("roots", "cuts")
        .withColumn("pre", F.coalesce("_mark.pre", "pre")))
    in_order = page.orderBy("pre", F.col("_mark").isNull())
    told = (F.col("kind") == "elem") & F.lag("_mark.cut").over(in_order).isNotNull()
    as_cut = F.lag("_mark.cut").over(in_order)

    def reach(condition: Column) -> Column:
        return F.max(F.when(condition, F.col("post"))).over(
            in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    below = F.coalesce(F.col("_reach") >= F.col("pre"), F.lit(False))
    cut = F.coalesce(F.col("_cut_reach") >= F.col("pre"), F.lit(False))
    return (
        marked.withColumns({"_root": told & ~as_cut, "_cut": told & as_cut})
        .withColumns({"_reach": reach(F.col("_root")), "_cut_reach": reach(F.col("_cut"))})
        .where(F.col("_mark").isNull() & F.when(~F.col("_chosen"), in_page).otherwise(
            itself | (below & ~cut)))
        .drop("_body", "_chosen", "_mark", "_root", "_cut", "_reach", "_cut_reach"))


def convert_parsed(
    parsed: DataFrame, *, links: str = "keep", images: str = "keep", content: str = "full",
    front_matter: bool = False, fetched_at: str | None = None, language: Column | None = None,
) -> DataFrame:
    """``(page_id, markdown)`` for parsed pages; every page gets a row."""
    _check("links", links, LINKS)
    _check("images", images, IMAGES)
    _check("content", content, CONTENT)
    clean = clean_nodes(node_rows(parsed), links, images)
    chosen = None if content == "full" else choices(parsed, content)
    rows = apply_policies(root_rows(clean, chosen), links, images)
    rendered = render_markdown(rows, language)
    if not front_matter:
        return rendered
    heads, metadata = page_metadata(shared(parsed)), F.col("metadata")
    if fetched_at is not None:
        # Read apart from the nodes: what is carried along would make the sides differ.
        times = parsed.select("page_id", iso_timestamp(F.col(fetched_at)).alias("_fetched"))
        heads = heads.join(times, "page_id", "left")
        metadata = metadata.withField("fetched_at", F.col("_fetched"))
    return _aligned(heads, rendered).select(
        "page_id", F.concat(front_matter_text(metadata), "markdown").alias("markdown"))


def page_lengths(parsed: DataFrame) -> DataFrame:
    """``page_id, html_chars`` of parsed pages, null without nodes; no second look at the HTML."""
    # A plain nodes[0] would be taken out below the shared exchange, which then would not be shared.
    return shared(parsed).selectExpr("page_id", """
        cast(array_join(transform(slice(nodes, 1, 1), n -> n.attrs['html_chars']), '') AS int)
        AS html_chars""")


def to_markdown_with_lengths(pages: DataFrame, **options) -> DataFrame:
    """``page_id, html_chars, markdown`` in one pass over the pages, by one exchange."""
    based = with_base_url(pages).select("page_id", "base_url", "html")
    parsed = parse_pages(based, "base_url")
    return _aligned(page_lengths(parsed), convert_parsed(parsed, **options)).select(
        "page_id", "html_chars", "markdown")


def to_markdown(pages: DataFrame, **options) -> DataFrame:
    """Convert a table of pages: ``page_id``, ``html`` and, for links, ``url``.

    Options: ``links`` keep|text|strip, ``images`` keep|alt|strip, ``content``
    full|dom|readability|auto, ``front_matter``, ``fetched_at`` (a timestamp column's name) and
    ``language`` (a Column naming the language of a code block).
    """
    based = with_base_url(pages)
    wanted = ["page_id", "base_url", "html"]
    if options.get("fetched_at"):
        wanted.append(options["fetched_at"])
    return convert_parsed(parse_pages(based.select(*wanted), "base_url"), **options)


def markdown_documents(pages: DataFrame, directory: str = ".", **options) -> DataFrame:
    """Markdown with the page's URL and output path, ready for the Markdown sink.

    Captures with an ``error`` or without HTML give no document; ``failed_captures`` and
    ``parse_failures`` list them.
    """
    pages = pages.where("html IS NOT NULL")
    if "error" in pages.columns:
        pages = pages.where("error IS NULL")
    named = pages.select(
        "page_id", "url", joined_output_path(F.lit(directory), output_name(F.col("url"))).alias(
            "output_path"))
    return named.join(to_markdown(pages, **options), "page_id").select(
        "page_id", "url", "output_path", "markdown")
