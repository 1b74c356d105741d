"""Removal of non-content: seeds by tag and attributes, then whole subtrees at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesmelt.fixed_values import (
    DROP_ROLES,
    DROP_TAGS,
    HEADING_TAGS,
    HIDDEN_STYLE,
    NOISE_TOKEN,
)
from pagesmelt.functions.text import class_tokens, text_trim
from pagesmelt.operators.nodes import is_run


def _in_order() -> Window:
    """From the start of the page to this node."""
    return Window.partitionBy("page_id").orderBy("pre").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)


def _backward() -> Window:
    """From this node to the end of the page, as a running frame over the reversed order."""
    return Window.partitionBy("page_id").orderBy(F.desc("pre")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)


def is_drop_tag() -> Column:
    return F.col("tag").isin(*DROP_TAGS)


def is_hidden() -> Column:
    """``hidden``, ``aria-hidden=true`` or an inline style that hides."""
    attrs = F.col("attrs")
    return (
        F.map_contains_key(attrs, "hidden")
        | F.coalesce(F.lower(attrs["aria-hidden"]) == "true", F.lit(False))
        | F.coalesce(attrs["style"].rlike(HIDDEN_STYLE), F.lit(False)))


def has_dropped_role() -> Column:
    return F.coalesce(F.lower(F.col("attrs")["role"]).isin(*DROP_ROLES), F.lit(False))


def is_noise() -> Column:
    """An advert, cookie or sharing token as the id or as one of the classes."""
    attrs = F.col("attrs")
    return F.coalesce(F.lower(attrs["id"]).rlike(NOISE_TOKEN), F.lit(False)) | F.exists(
        class_tokens(attrs), lambda token: F.lower(token).rlike(NOISE_TOKEN))


def is_seed() -> Column:
    """Every rule that looks at the element alone, as one predicate."""
    by_attribute = (F.size("attrs") > 0) & (is_hidden() | has_dropped_role() | is_noise())
    return (F.col("kind") == "elem") & (is_drop_tag() | by_attribute)


def in_marked_subtree(seed: Column) -> Column:
    """True for seeds and everything below them.

    Subtrees nest or are disjoint, so a node lies in a marked one exactly when the furthest end
    of the marked elements seen so far is behind it.  One running maximum, no self join.
    """
    reach = F.max(F.when(seed, F.col("post"))).over(_in_order())
    return F.coalesce(reach >= F.col("pre"), F.lit(False))


def drop_subtrees(rows: DataFrame, seed: Column) -> DataFrame:
    return rows.withColumn("_cut", in_marked_subtree(seed)).where(~F.col("_cut")).drop("_cut")


def _next_position(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("pre"))).over(_backward())


def drop_noise(rows: DataFrame) -> DataFrame:
    return drop_subtrees(rows, is_seed())


def _prints() -> Column:
    """A node that puts something into the Markdown whatever it contains."""
    element = F.col("kind") == "elem"
    return ((F.col("kind") == "text") & (text_trim(F.col("text")) != "")) | (
        element & F.col("tag").isin("hr", "q", "td", "th", "tr", "video"))


def _is_decorative() -> Column:
    return F.coalesce(
        (F.col("tag") == "img")
        & (text_trim(F.coalesce(F.col("attrs")["alt"], F.lit(""))) == ""), F.lit(False))


def drop_empty(rows: DataFrame, prints: Column | None = None) -> DataFrame:
    """Remove links and headings without text or image, then images without ``alt``.

    An element is empty when the next text (or image) in document order lies behind its end.
    Adds ``has_text`` for elements, which link statistics need, and ``has_atom`` for those with
    anything to print below them.
    """
    if prints is None:
        prints = _prints() | ((F.col("tag") == "img") & ~_is_decorative())
    judged = rows.withColumns({
        "_text_at": _next_position(is_run()),
        "_image_at": _next_position(F.col("tag") == "img"),
        "_atom_at": _next_position(prints)})

    def below(name: str) -> Column:
        # Looking backward the row itself is included, which for an element is its own start.
        return F.coalesce(F.col(name) < F.col("post"), F.lit(False))

    empty = F.col("tag").isin("a", *HEADING_TAGS) & ~below("_text_at") & ~below("_image_at")
    marked = judged.withColumns({
        "has_text": below("_text_at"),
        "has_atom": below("_atom_at"),
        "_empty": F.coalesce(empty, F.lit(False))})
    return drop_subtrees(marked, F.col("_empty")).where(~_is_decorative()).drop(
        "_text_at", "_image_at", "_atom_at", "_empty")


def clean_nodes(rows: DataFrame, links: str = "keep", images: str = "keep") -> DataFrame:
    """Node rows that may reach the Markdown.

    The policies remove nothing here; they only decide what counts as printed (``has_atom``).
    """
    link = (F.col("kind") == "elem") & (F.col("tag") == "a")
    marks = {"_cut": in_marked_subtree(is_seed())}
    if links == "strip":
        marks["_in_link"] = in_marked_subtree(link)
    kept = rows.withColumns(marks).where(~F.col("_cut")).drop("_cut")
    prints = _prints()
    if images != "strip":
        prints = prints | ((F.col("tag") == "img") & ~_is_decorative())
    if links == "strip":
        prints = prints & ~F.col("_in_link")
    return drop_empty(kept, prints).drop("_in_link")
