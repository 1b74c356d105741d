"""Page metadata, read straight from the parsed array: no explode and no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesmelt.fixed_values import (
    LINK_CANONICAL,
    META_AUTHOR,
    META_DESCRIPTION,
    META_PUBLISHED,
    META_TITLE,
)
from pagesmelt.functions.text import SPACE_SQL
from pagesmelt.functions.yaml_text import iso_timestamp


_HEAD = "filter(nodes, n -> n.tag IN ('meta', 'title', 'h1', 'link', 'html'))"


def _first(condition: str, field: str) -> str:
    return f"try_element_at(filter(_head, n -> {condition}), 1).{field}"


def _trimmed(expression: str) -> str:
    return f"nullif(btrim({expression}, {SPACE_SQL}), '')"


def _meta(*keys: tuple[str, str]) -> str:
    """Trimmed content of the first tag for each key; a blank one yields to the next key."""
    contents = [
        _first(f"n.tag = 'meta' AND n.attrs['{attribute}'] = '{value}'", "attrs['content']")
        for attribute, value in keys
    ]
    return f"coalesce({', '.join(_trimmed(content) for content in contents)})"


def _text_below(tag: str) -> str:
    """Readable text in the first element with this tag, runs joined by one space."""
    element = f"try_element_at(filter(_head, n -> n.tag = '{tag}'), 1)"
    return f"""
      transform(array({element}), e -> CASE WHEN e IS NOT NULL THEN nullif(array_join(filter(
        transform(
          filter(nodes, n -> n.kind = 'text' AND NOT n.raw AND n.pre > e.pre AND n.pre < e.post),
          n -> btrim(n.text, {SPACE_SQL})), t -> t <> ''), ' '), '') END)[0]
    """


def page_metadata(parsed: DataFrame, *, fetched_at: str | None = None) -> DataFrame:
    """``page_id`` and a struct of seven nullable strings for every parsed page.

    ``fetched_at`` names a timestamp column.  The canonical URL is absolute when the pages were
    parsed with a base URL, else as written.  Hidden elements count, as nothing is dropped yet.
    The few nodes that can matter are filtered out of the array once, in a projection of their
    own.
    """
    carried = [fetched_at] if fetched_at else []
    heads = parsed.select("page_id", *carried, "nodes", F.expr(_HEAD).alias("_head"))
    found = heads.selectExpr(
        "page_id", *carried,
        f"coalesce({_meta(*META_TITLE)}, {_text_below('title')}, "
        f"{_text_below('h1')}) AS title",
        f"{_meta(*META_DESCRIPTION)} AS description",
        _first(f"n.tag = 'link' AND contains(n.attrs['rel'], '{LINK_CANONICAL}')", "attrs")
        + " AS _canonical",
        f"{_meta(*META_AUTHOR)} AS author",
        f"{_meta(*META_PUBLISHED)} AS published_time",
        f"{_trimmed(_first("n.tag = 'html'", "attrs['lang']"))} AS language")
    fetched = F.lit(None).cast("string") if fetched_at is None else iso_timestamp(F.col(fetched_at))
    return found.select(
        "page_id",
        F.struct(
            "title", "description", F.expr(_trimmed("_canonical['href']")).alias("canonical_url"), "author",
            "published_time", "language", fetched.alias("fetched_at")).alias("metadata"))
