"""Web page corpora to Markdown, metadata and extraction tables on Spark."""

from pagesmelt.operators.captures import decode_responses, meaningful_pages, select_captures
from pagesmelt.operators.metadata import page_metadata
from pagesmelt.operators.nodes import node_rows, page_links, parse_pages
from pagesmelt.plans.convert import (
    extraction_decisions,
    markdown_documents,
    to_markdown,
)

__all__ = [
    "decode_responses", "extraction_decisions", "markdown_documents", "meaningful_pages",
    "node_rows", "page_links", "page_metadata", "parse_pages", "select_captures", "to_markdown",
]
