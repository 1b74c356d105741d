"""Column functions built from Spark expressions only."""

from pagesmelt.functions.text import class_tokens, collapse_space, text_trim
from pagesmelt.functions.urls import (
    resolve_srcset_sql,
    resolve_url_sql,
    joined_output_path,
    output_name,
    percent_decode,
    resolve_srcset,
    resolve_url,
)
from pagesmelt.functions.yaml_text import front_matter, iso_timestamp, yaml_scalar

__all__ = [
    "class_tokens", "collapse_space", "front_matter", "iso_timestamp", "joined_output_path",
    "output_name", "percent_decode", "resolve_srcset", "resolve_url", "text_trim", "yaml_scalar",
]
