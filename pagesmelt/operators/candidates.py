"""Scored content candidates and the choice of the element to convert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesmelt.fixed_values import (
    CONTENT_CLASS,
    CONTENT_TAGS,
    MAX_DENSITY_DISCOUNT,
    MAX_LINK_DENSITY,
    MIN_STRUCTURE,
    MIN_TEXT_LENGTH,
    PARAGRAPH_POINTS,
    PUNCTUATION,
    PUNCTUATION_POINTS,
    REASON_DOM,
    REASON_DOM_AFTER_READABILITY,
    REASON_LINK_DENSITY,
    REASON_NO_CANDIDATE,
    REASON_NO_STRUCTURE,
    REASON_TOO_SHORT,
    STRUCTURE_POINTS,
    STRUCTURE_TAGS,
)
from pagesmelt.functions.numbers import round_exact
from pagesmelt.functions.text import class_tokens
from pagesmelt.operators.nodes import is_run, joined_length, run_length, with_closes

FEATURES = ("text_length", "paragraphs", "link_density", "punctuation", "structural_elements")
CANDIDATE_TYPE = (
    "struct<selector:string,score:double,text_length:int,paragraphs:int,link_density:double,"
    "punctuation:int,structural_elements:int>"
)


def is_main_role() -> Column:
    return F.coalesce(F.lower(F.col("attrs")["role"]) == "main", F.lit(False))


def candidate_rank() -> Column:
    """Which rule makes an element a candidate first (1, 2, 3), null when none does."""
    by_class = F.exists(class_tokens(F.col("attrs")), lambda token: token.rlike(CONTENT_CLASS))
    return F.when(F.col("kind") == "elem", F.when(F.col("tag").isin(*CONTENT_TAGS), 1)
                  .when(F.size("attrs") > 0, F.when(is_main_role(), 2).when(by_class, 3)))


def running_totals(rows: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Running totals in document order; differences of them are subtree features.

    A link nested in another counts for both, so a text weighs as much as links enclose it.
    ``links_open`` is needed to take out the links outside the subtree.
    """
    frame = f"(PARTITION BY {', '.join(keys)} ORDER BY pos ROWS UNBOUNDED PRECEDING)"

    def total(value: str) -> Column:
        return F.expr(f"coalesce(sum({value}) OVER {frame}, 0)")

    def count(condition: str) -> Column:
        return F.expr(f"count_if(pos = pre AND {condition}) OVER {frame}")

    structure = ", ".join(f"'{tag}'" for tag in STRUCTURE_TAGS)
    measured = rows.withColumns({
        "_len": run_length(),
        "_stops": F.when(is_run(), F.regexp_count("text", F.lit(PUNCTUATION))),
        "t_links_open": total(
            "CASE WHEN tag = 'a' THEN CASE WHEN pos = pre THEN 1 ELSE -1 END END")})
    return measured.withColumns({
        "t_chars": total("_len"),
        "t_runs": count("_len IS NOT NULL"),
        "t_weighted": total("(_len + 1) * t_links_open"),
        "t_links": count("tag = 'a' AND has_text"),
        "t_paragraphs": count("tag = 'p'"),
        "t_structure": count(f"tag IN ({structure})"),
        "t_punctuation": total("_stops")}).drop("_len", "_stops")


def _grown(name: str) -> Column:
    return F.max(name) - F.min(name)


def subtree_totals(
    totals: DataFrame, *keep: str, keys: tuple[str, ...] = ("page_id",), more: tuple[str, ...] = ()
) -> DataFrame:
    """One row per element that has an opening and a closing row in ``totals``.

    ``keep`` names columns of the opening row to hand through.  The grouping is on
    ``(page_id, pre)`` and reuses the ``page_id`` partitioning.
    """
    opening = F.col("pos") == F.col("pre")
    at_open = [F.max(F.when(opening, F.col(name))).alias(name) for name in keep]
    # Counters already hold the element's own contribution at its opening row; the running
    # totals never fall, so closing minus opening row leaves out the element itself.
    grouped = totals.groupBy(*keys, "pre").agg(
        F.max("post").alias("post"),
        *at_open,
        F.max(F.when(opening, F.col("t_links_open"))).alias("_outer_links"),
        *[_grown(name).alias(name) for name in
          ("t_chars", "t_runs", "t_links", "t_paragraphs", "t_structure", "t_punctuation", *more)],
        (F.max(F.when(~opening, F.col("t_weighted")))
         - F.max(F.when(opening, F.col("t_weighted")))).alias("_weighted"))
    return grouped.withColumn(
        "t_link_chars",
        F.col("_weighted") - F.col("_outer_links") * (F.col("t_chars") + F.col("t_runs"))
        - F.col("t_links")).drop("_weighted", "_outer_links", "t_links")


def with_features(totals: DataFrame) -> DataFrame:
    """Turn summed counters into the candidate features and the score."""
    density = F.expr(
        "CASE WHEN text_length > 0 THEN t_link_chars / text_length ELSE 1.0D END")
    points = F.expr(
        f"text_length + paragraphs * {PARAGRAPH_POINTS} + punctuation * {PUNCTUATION_POINTS} "
        f"+ structural_elements * {STRUCTURE_POINTS}")
    return (
        totals
        .withColumns({
            "text_length": joined_length(F.col("t_chars"), F.col("t_runs")).cast("int"),
            "paragraphs": F.col("t_paragraphs").cast("int"),
            "punctuation": F.col("t_punctuation").cast("int"),
            "structural_elements": F.col("t_structure").cast("int")})
        .withColumn("_density", density)
        .withColumn("_score", points * (
            1 - F.least(F.col("_density"), F.lit(MAX_DENSITY_DISCOUNT))))
        .withColumns({
            "score": round_exact("_score", 2), "link_density": round_exact("_density", 3)})
        .drop("_density", "_score", "t_chars", "t_runs", "t_link_chars", "t_paragraphs", "t_structure",
              "t_punctuation"))


def is_acceptable(candidate: Column | None = None) -> Column:
    def field(name: str) -> Column:
        return F.col(name) if candidate is None else candidate[name]

    return (
        (field("text_length") >= MIN_TEXT_LENGTH)
        & (field("link_density") <= MAX_LINK_DENSITY)
        & ((field("paragraphs") > 0) | (field("structural_elements") >= MIN_STRUCTURE)))


def content_candidates(clean: DataFrame) -> DataFrame:
    """Candidates with order, label and features.

    Links and candidates get closing rows; two windows in the order of one sort give the
    running totals, one grouping the features.  No exchange beyond the one below ``clean``.
    """
    ranked = clean.withColumn("rank", candidate_rank())
    events = with_closes(ranked, F.col("rank").isNotNull() | (F.col("tag") == "a"))
    totals = running_totals(events).where(F.col("rank").isNotNull())
    featured = with_features(subtree_totals(
        totals.withColumn("id", F.col("attrs")["id"])
        .withColumn("classes", F.array_join(class_tokens(F.col("attrs")), "."))
        .withColumn("main_role", is_main_role()),
        "rank", "tag", "id", "classes", "main_role"))
    ordered = featured.withColumn(
        "cand_ord", F.row_number().over(Window.partitionBy("page_id").orderBy("rank", "pre")) - 1)
    label = (
        F.when(F.col("id") != "", F.concat("tag", F.lit("#"), "id"))
        .when(F.col("classes") != "", F.concat("tag", F.lit("."), "classes"))
        .when(F.col("main_role"), F.concat("tag", F.lit('[role="main"]')))
        .otherwise(F.concat("tag", F.lit("["), F.col("cand_ord").cast("string"), F.lit("]"))))
    return ordered.select(
        "page_id", "cand_ord", "rank", "pre", "post", label.alias("selector"), "score", *FEATURES)


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Adds ``place``: 1 is best; equal scores keep candidate order."""
    return candidates.withColumn("place", F.row_number().over(
        Window.partitionBy("page_id").orderBy(F.desc("score"), "cand_ord")))


def dom_choice(candidates: DataFrame) -> DataFrame:
    """One row per page with candidates: ranking, best candidate and the element it names.

    The label decides which element is taken, so a repeated label maps to its first bearer.
    """
    row = F.struct(
        (-F.col("score")).alias("_s"), F.col("cand_ord"), F.col("pre"), F.col("post"),
        F.struct(
            "selector", "score", "text_length", "paragraphs", "link_density", "punctuation",
            "structural_elements").alias("candidate"))
    ranked = candidates.groupBy("page_id").agg(
        F.array_sort(F.collect_list(row)).alias("_ranked"))
    best = F.col("best")["selector"]
    bearers = F.filter("_ranked", lambda c: c["candidate"]["selector"] == best)
    first = F.array_min(F.transform(
        bearers, lambda c: F.struct(c["cand_ord"], c["pre"], c["post"])))
    return (
        ranked
        .withColumn("best", F.col("_ranked")[0]["candidate"])
        .withColumn("_root", first)
        .select(
            "page_id", "best",
            F.transform("_ranked", lambda c: c["candidate"]).alias("candidates"),
            F.col("_root")["pre"].alias("root_pre"), F.col("_root")["post"].alias("root_post")))


def dom_reason(after_readability: bool) -> Column:
    """Why the best candidate, the struct column ``best``, is taken or not."""
    best = F.col("best")
    density = round_exact("best.link_density", 2)
    return (
        F.when(best.isNull(), F.lit(REASON_NO_CANDIDATE))
        .when(best["text_length"] < MIN_TEXT_LENGTH,
              F.format_string(REASON_TOO_SHORT, best["text_length"]))
        .when(best["link_density"] > MAX_LINK_DENSITY,
              F.format_string(REASON_LINK_DENSITY, density))
        .when(~is_acceptable(best), F.lit(REASON_NO_STRUCTURE))
        .otherwise(F.lit(REASON_DOM_AFTER_READABILITY if after_readability else REASON_DOM)))
