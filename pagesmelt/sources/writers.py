"""Tables the conversions end in.  Rows are written where they are; no sorting, no collecting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesmelt.operators.reports import failed_captures, output_collisions


def write_markdown(
    documents: DataFrame, path: str, *, mode: str = "errorifexists", pages: DataFrame | None = None,
) -> None:
    """Parquet of ``output_path, markdown`` and what identifies the page.

    Paths that two pages would share reject the batch; all of them are written beside the output, to
    ``<path>-collisions``.  Give the table of ``pages`` the documents come from, and they are
    checked there, before anything is converted.
    """
    clashes = output_collisions((documents if pages is None else pages).select("url"), "")
    if not clashes.isEmpty():
        listed = f"{path.rstrip('/')}-collisions"
        clashes.write.mode("overwrite").parquet(listed)
        count = documents.sparkSession.read.parquet(listed).count()
        raise ValueError(f"output filename collision: {count} paths, listed in {listed}")
    documents.write.mode(mode).parquet(path)


def write_decisions(decisions: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    decisions.select("page_id", "requested_mode", "selected", "reason").write.mode(mode).parquet(
        path)


def candidate_lines(decisions: DataFrame) -> DataFrame:
    """One text line per candidate, best first, numbers as people read them."""
    return decisions.select("page_id", F.posexplode("candidates").alias("place", "c")).select(
        "page_id", "place", F.format_string(
            "candidate: selector=%s score=%.2f text=%d paragraphs=%d links=%.3f "
            "punctuation=%d structure=%d",
            "c.selector", "c.score", "c.text_length", "c.paragraphs", "c.link_density",
            "c.punctuation", "c.structural_elements").alias("line"))


def decision_lines(decisions: DataFrame) -> DataFrame:
    return decisions.select("page_id", F.format_string(
        "extraction: mode=%s selected=%s reason=%s", "requested_mode", "selected", "reason"
    ).alias("line"))


def write_candidates(decisions: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    candidate_lines(decisions).write.mode(mode).parquet(path)


def write_page_stats(stats: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    stats.write.mode(mode).json(path)


def write_errors(captures: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    failed_captures(captures).write.mode(mode).parquet(path)
