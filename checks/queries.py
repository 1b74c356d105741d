"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.derived import (
    article_pages,
    derived_captures,
    derived_pages,
    derived_responses,
    listing_pages,
    odd_markup_pages,
    pages,
    role_pages,
    table,
)
from pagesmelt.fixed_values import HEADING_TAGS
from pagesmelt.functions import (
    front_matter,
    joined_output_path,
    output_name,
    resolve_srcset,
)
from pagesmelt.functions.text import SPACE_SQL
from pagesmelt.operators import clean as cleaning
from pagesmelt.operators.candidates import content_candidates, rank_candidates
from pagesmelt.operators.captures import (
    content_type_error,
    decode_responses,
    header_charset,
    meaningful_pages,
    select_captures,
    sniffed_charset,
)
from pagesmelt.operators.metadata import page_metadata
from pagesmelt.operators.nodes import (
    is_run,
    node_rows,
    page_links,
    parse_failures,
    parse_pages,
)
from pagesmelt.operators.render import code_language
from pagesmelt.operators.reports import (
    batch_summary,
    capture_timing,
    extraction_quality,
    failed_captures,
    marker_retention,
    output_collisions,
    page_stats,
    quality_means,
)
from pagesmelt.plans.convert import (
    choices,
    extraction_decisions,
    markdown_documents,
    root_rows,
    to_markdown,
    with_base_url,
)
from pagesmelt.sources.readers import numbered, url_lines
from pagesmelt.sources.writers import candidate_lines, decision_lines

Query = Callable[[SparkSession, str], DataFrame]


def _parsed(frame: DataFrame) -> DataFrame:
    return parse_pages(frame.select("page_id", "html"))


def _clean(frame: DataFrame) -> DataFrame:
    return cleaning.clean_nodes(node_rows(_parsed(frame)))


def _joined_text(rows: DataFrame) -> DataFrame:
    """Readable text per page, runs joined by one space."""
    run = F.expr(f"btrim(text, {SPACE_SQL})")
    return rows.withColumn("_run", F.when(is_run(), run)).groupBy("page_id").agg(
        F.expr("coalesce(listagg(_run, ' ') WITHIN GROUP (ORDER BY pre), '')").alias("text"))


def url_list(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "CAST(page_id / 1000 AS int) AS block",
        "posexplode(array(concat('# page ', page_id), concat('  ', url, '\\t'), '   ', url)) "
        "AS (part, line)")
    listed = url_lines(lines).withColumn("pos", F.struct("page_id", "part"))
    return numbered(listed, "block", within="pos").select("ord", "url")


def url_sources(spark, sf_dir):
    """A list of events' addresses first, then the pages' own, in one order."""
    first = table(spark, sf_dir, "events").where("event_id % 50 = 0").selectExpr(
        "0 AS source", "CAST(event_id / 5000 AS int) AS block", "event_id AS pos",
        "concat('http://events.example/', event_id) AS url")
    second = table(spark, sf_dir, "pages").selectExpr(
        "1 AS source", "CAST(page_id / 1000 AS int) AS block", "page_id AS pos", "url")
    return numbered(first.union(second), "source", "block", within="pos").select(
        "ord", "source", "url")


def output_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", joined_output_path(
        F.lit("out/"), output_name(F.col("url"))).alias("output_path"))


def collisions(spark, sf_dir):
    return output_collisions(
        table(spark, sf_dir, "documents").selectExpr(
            "concat('http://host', doc_id % 10, '.example/', source, '/a%20b+', doc_id % 50, "
            "'.v1.html?q=', doc_id) AS url"), "out")


def resolve_links(spark, sf_dir):
    return page_links(pages(spark, sf_dir))


def srcset(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat('https://example.com/', source, '/p', doc_id, '/?x=1') AS base",
        "concat('s', doc_id, '.png 480w , ,/assets/', doc_id, '.png   960w,../up.png,"
        "//cdn.example/', doc_id, '.png 2x') AS srcset",
    ).select("doc_id", resolve_srcset("base", "srcset").alias("srcset"))


def charset_sniff(spark, sf_dir):
    bodies = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", """encode(concat(CASE doc_id % 5
            WHEN 0 THEN '<META charset = "ISO-8859-1">' WHEN 1 THEN ''
            WHEN 2 THEN concat('<meta http-equiv="x" content="text/html; charset=', lang, '-8">')
            WHEN 3 THEN concat('<!--', repeat('é', 3000), '--><meta charset=late>')
            ELSE '<meta charset=''utf-8''/>' END, text), 'UTF-8') AS body""",
        """CASE doc_id % 3 WHEN 0 THEN 'text/html; Charset="KOI8-R"' WHEN 1 THEN 'text/html'
           END AS content_type""")
    return bodies.select(
        "doc_id", header_charset(F.col("content_type")).alias("declared"),
        sniffed_charset(F.col("body")).alias("sniffed"))


def content_type_gate(spark, sf_dir):
    responses = table(spark, sf_dir, "documents").selectExpr("doc_id", """
        CASE doc_id % 7 WHEN 0 THEN 'text/html' WHEN 1 THEN ' TEXT/HTML ; charset=x'
          WHEN 2 THEN 'application/xhtml+xml' WHEN 3 THEN concat('application/', source)
          WHEN 4 THEN 'text' WHEN 5 THEN '' END AS content_type""")
    return responses.select(
        "doc_id", content_type_error(F.col("content_type")).alias("error"))


def responses_decoded(spark, sf_dir):
    return decode_responses(derived_responses(spark, sf_dir))


def meaningful(spark, sf_dir):
    return meaningful_pages(derived_pages(spark, sf_dir))


def meaningful_given(spark, sf_dir):
    return meaningful_pages(pages(spark, sf_dir))


def _selected(spark, sf_dir, method, strict):
    requests, static, rendered = derived_captures(spark, sf_dir)
    return select_captures(requests, static, rendered, method=method, strict=strict)


def _capture_query(method, strict):
    def query(spark, sf_dir):
        return _selected(spark, sf_dir, method, strict).select(
            "ord", "url", "method", "error", "final_url",
            F.coalesce(F.length("html"), F.lit(0)).alias("html_chars"))
    return query


def summary(spark, sf_dir):
    return batch_summary(_selected(spark, sf_dir, "auto", True))


def failures(spark, sf_dir):
    return failed_captures(_selected(spark, sf_dir, "auto", True))


def node_counts(spark, sf_dir):
    return _parsed(pages(spark, sf_dir)).selectExpr("inline(nodes)").where(
        "kind = 'elem'").groupBy("tag").agg(F.count("*").alias("elements"))


def clean_text(spark, sf_dir):
    return _joined_text(_clean(pages(spark, sf_dir)))


def noise_dropped(spark, sf_dir):
    rows = node_rows(_parsed(pages(spark, sf_dir)))
    element = F.col("kind") == "elem"
    judged = rows.withColumn("cut", cleaning.in_marked_subtree(cleaning.is_seed()))
    return judged.groupBy("page_id").agg(
        F.count_if(element & cleaning.is_drop_tag()).alias("tag_seeds"),
        F.count_if(element & cleaning.is_noise()).alias("noise_seeds"),
        F.count_if(F.col("cut") & is_run()).alias("dropped_runs"),
        F.count_if(~F.col("cut") & is_run()).alias("kept_runs"))


def hidden_dropped(spark, sf_dir):
    rows = node_rows(_parsed(derived_pages(spark, sf_dir)))
    element = F.col("kind") == "elem"
    judged = rows.withColumn("cut", cleaning.in_marked_subtree(cleaning.is_seed()))
    return judged.groupBy("page_id").agg(
        F.count_if(element & cleaning.is_hidden()).alias("hidden"),
        F.count_if(element & cleaning.has_dropped_role()).alias("roles"),
        F.count_if(element & cleaning.is_noise()).alias("noise"),
        F.count_if(~F.col("cut") & (F.col("tag") == "p")).alias("paragraphs_left"))


def empty_pruned(spark, sf_dir):
    rows = cleaning.drop_noise(node_rows(_parsed(derived_pages(spark, sf_dir))))

    def counts(frame, name):
        return frame.groupBy("page_id").agg(
            F.count_if(F.col("tag").isin(*HEADING_TAGS)).alias(f"headings_{name}"),
            F.count_if(F.col("tag") == "a").alias(f"links_{name}"),
            F.count_if(F.col("tag") == "img").alias(f"images_{name}"))

    return counts(rows, "before").join(counts(cleaning.drop_empty(rows), "after"), "page_id")


def _metadata(frame):
    based = with_base_url(frame).select("page_id", "base_url", "html")
    return page_metadata(parse_pages(based, "base_url"))


def metadata(spark, sf_dir):
    return _metadata(derived_pages(spark, sf_dir)).select("page_id", "metadata.*").drop(
        "fetched_at")


def metadata_given(spark, sf_dir):
    return _metadata(pages(spark, sf_dir)).selectExpr(
        "page_id", "metadata.title", "metadata.language")


def metadata_fetched(spark, sf_dir):
    """Page titles with the time of the event that has the page's number."""
    times = table(spark, sf_dir, "events").selectExpr("event_id AS page_id", "ts AS fetched_at")
    timed = pages(spark, sf_dir).select("page_id", "html").join(times, "page_id", "left")
    return page_metadata(parse_pages(timed), fetched_at="fetched_at").selectExpr(
        "page_id", "metadata.fetched_at")


def front_matter_text(spark, sf_dir):
    return _metadata(derived_pages(spark, sf_dir)).select(
        "page_id", front_matter(F.col("metadata")).alias("front_matter"))


def candidates(spark, sf_dir):
    return content_candidates(_clean(pages(spark, sf_dir))).drop("rank", "pre", "post")


def candidate_rank(spark, sf_dir):
    ranked = rank_candidates(content_candidates(_clean(derived_pages(spark, sf_dir))))
    return ranked.drop("pre", "post")


def decision(spark, sf_dir):
    return extraction_decisions(pages(spark, sf_dir), "dom").select(
        "page_id", "requested_mode", "selected", "reason",
        F.size("candidates").alias("candidate_count"))


def decision_text(spark, sf_dir):
    return decision_lines(extraction_decisions(pages(spark, sf_dir), "dom"))


def candidate_text(spark, sf_dir):
    return candidate_lines(extraction_decisions(derived_pages(spark, sf_dir), "dom"))


def content_root_text(spark, sf_dir):
    parsed = _parsed(pages(spark, sf_dir))
    clean = cleaning.clean_nodes(node_rows(parsed))
    return _joined_text(root_rows(clean, choices(parsed, "dom")))


def readability_root(spark, sf_dir):
    return extraction_decisions(pages(spark, sf_dir), "readability").selectExpr(
        "page_id", "selected", "reason", "candidates[0].text_length AS text_length")


def article_choice(spark, sf_dir):
    """The article extracted, after what does not belong to it went."""
    return extraction_decisions(article_pages(spark, sf_dir), "readability").selectExpr(
        "page_id", "selected", "reason", "candidates[0].text_length AS text_length",
        "candidates[0].paragraphs AS paragraphs", "candidates[0].link_density AS link_density",
        "candidates[0].structural_elements AS structural_elements")


def article_markdown(spark, sf_dir):
    return to_markdown(article_pages(spark, sf_dir), content="auto")


def role_choice(spark, sf_dir):
    return extraction_decisions(role_pages(spark, sf_dir), "dom").selectExpr(
        "page_id", "selected", "candidates.selector AS selectors").withColumn(
        "selectors", F.array_join(F.sort_array("selectors"), " "))


def role_markdown(spark, sf_dir):
    """The subtree a label names."""
    return to_markdown(role_pages(spark, sf_dir), content="dom")


def lists_markdown(spark, sf_dir):
    return to_markdown(listing_pages(spark, sf_dir))


def language_hook(spark, sf_dir):
    """Code blocks whose language a rule of the caller names."""
    return to_markdown(
        listing_pages(spark, sf_dir), language=F.concat(F.lit("x-"), F.col("attrs")["data-lang"]))


def odd_markup(spark, sf_dir):
    return to_markdown(odd_markup_pages(spark, sf_dir))


def unreadable(spark, sf_dir):
    return parse_failures(odd_markup_pages(spark, sf_dir))


def _given_markdown(**options):
    def query(spark, sf_dir):
        return to_markdown(pages(spark, sf_dir), **options)
    return query


def _derived_markdown(**options):
    def query(spark, sf_dir):
        return to_markdown(derived_pages(spark, sf_dir), **options)
    return query


def documents_out(spark, sf_dir):
    return markdown_documents(pages(spark, sf_dir), "out")


def code_languages(spark, sf_dir):
    nodes = _parsed(derived_pages(spark, sf_dir)).selectExpr("page_id", "inline(nodes)")
    return nodes.where("tag = 'code'").select(
        "page_id", code_language(F.col("attrs")).alias("language"))


def stats(spark, sf_dir):
    return page_stats(pages(spark, sf_dir))


def stats_json(spark, sf_dir):
    return page_stats(pages(spark, sf_dir)).select(
        "page_id", F.to_json(F.struct(
            "path", "html_chars", "markdown_chars", "markdown_links")).alias("line"))


def quality(spark, sf_dir):
    return extraction_quality(pages(spark, sf_dir), ("full", "dom"))


def quality_all(spark, sf_dir):
    return quality_means(extraction_quality(pages(spark, sf_dir)))


def retention(spark, sf_dir):
    source = pages(spark, sf_dir)
    markers = source.selectExpr(
        "page_id AS case_id",
        "explode(array('</p>', '# ', concat('](', regexp_extract(url, '^([a-z]+://[^/]*)', 1)), "
        "concat('page ', page_id))) AS marker")
    outputs = to_markdown(source).withColumnsRenamed(
        {"page_id": "case_id", "markdown": "output"})
    return marker_retention(outputs, markers)


def timing(spark, sf_dir):
    metrics = table(spark, sf_dir, "events").selectExpr(
        "concat('https://example.com/', event_id) AS url", "value AS browser_launch_seconds",
        "CAST(user_id AS double) / 8 AS navigation_seconds")
    return capture_timing(metrics).select(
        "url", F.round("browser_launch_seconds", 6).alias("browser_launch_seconds"),
        F.round("navigation_seconds", 6).alias("navigation_seconds"), "summary")


QUERIES: dict[str, Query] = {
    "url_list": url_list,
    "url_sources": url_sources,
    "output_path": output_path,
    "output_collisions": collisions,
    "resolve_links": resolve_links,
    "srcset": srcset,
    "charset_sniff": charset_sniff,
    "content_type_gate": content_type_gate,
    "decode_responses": responses_decoded,
    "meaningful_pages": meaningful,
    "meaningful_given_pages": meaningful_given,
    "select_capture": _capture_query("auto", False),
    "select_capture_strict": _capture_query("auto", True),
    "select_capture_http": _capture_query("http", False),
    "select_capture_browser": _capture_query("browser", True),
    "batch_summary": summary,
    "failed_captures": failures,
    "node_counts": node_counts,
    "clean_text": clean_text,
    "noise_dropped": noise_dropped,
    "hidden_dropped": hidden_dropped,
    "empty_pruned": empty_pruned,
    "page_metadata": metadata,
    "page_metadata_given": metadata_given,
    "page_metadata_fetched": metadata_fetched,
    "front_matter": front_matter_text,
    "candidates": candidates,
    "candidate_rank": candidate_rank,
    "candidate_lines": candidate_text,
    "extraction_decision": decision,
    "decision_lines": decision_text,
    "content_root_text": content_root_text,
    "readability_root": readability_root,
    "article_choice": article_choice,
    "article_markdown": article_markdown,
    "role_choice": role_choice,
    "role_markdown": role_markdown,
    "lists_markdown": lists_markdown,
    "language_hook": language_hook,
    "odd_markup": odd_markup,
    "unreadable_pages": unreadable,
    "markdown_full": _given_markdown(),
    "markdown_dom": _given_markdown(content="dom"),
    "markdown_auto": _given_markdown(content="auto"),
    "markdown_links_text": _given_markdown(links="text"),
    "markdown_links_strip": _given_markdown(links="strip"),
    "markdown_documents": documents_out,
    "markdown_derived": _derived_markdown(),
    "markdown_derived_dom": _derived_markdown(content="dom"),
    "markdown_front_matter": _derived_markdown(front_matter=True),
    "images_alt": _derived_markdown(images="alt"),
    "images_strip": _derived_markdown(images="strip", links="text"),
    "code_language": code_languages,
    "page_stats": stats,
    "page_stats_json": stats_json,
    "extraction_quality": quality,
    "quality_means": quality_all,
    "marker_retention": retention,
    "capture_timing": timing,
}
