"""Flat YAML front matter as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA_FIELDS = (
    "title", "description", "canonical_url", "author", "published_time", "language", "fetched_at",
)

# A plain scalar: starts with a letter, ends in no space, holds nothing YAML gives a meaning to.
_PLAIN = r"^\p{L}(?:[\p{L}\p{N} _./()%+-]*[\p{L}\p{N}_./()%+-])?$"
# Control characters without a short escape of their own.
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x80-\x84\x86-\x9f\x{FFFE}\x{FFFF}]"
# --- fixed values: words YAML reads as something other than text ------------------------------
_RESERVED = ("y", "n", "yes", "no", "on", "off", "true", "false", "null")


def yaml_scalar(column: Column) -> Column:
    """Text as a YAML scalar: bare when that is safe, else double quoted."""
    quoted = F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x85", "\\N"),
                         ("\xa0", "\\_"), ("\u2028", "\\L"), ("\u2029", "\\P")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(escaped))
    def escaped_control(character: Column) -> Column:
        code = F.ascii(character)
        return F.when(~character.rlike(_CONTROL), character).otherwise(F.when(
            code > 255, F.concat(F.lit("\\u"), F.hex(code))).otherwise(
            F.concat(F.lit("\\x"), F.lpad(F.hex(code), 2, "0"))))

    quoted = F.when(quoted.rlike(_CONTROL), F.array_join(F.transform(
        F.regexp_extract_all(quoted, F.lit("(?s)."), F.lit(0)), escaped_control), "")).otherwise(quoted)
    plain = column.rlike(_PLAIN) & ~F.lower(column).isin(*_RESERVED)
    return F.when(plain, column).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))


def front_matter(metadata: Column) -> Column:
    """The YAML block for a metadata struct, fields in declared order, nulls left out."""
    lines = [
        F.when(metadata[name].isNotNull(),
               F.concat(F.lit(f"{name}: "), yaml_scalar(metadata[name])))
        for name in METADATA_FIELDS
    ]
    body = F.concat_ws("\n", *lines)
    return F.concat(
        F.lit("---\n"), F.when(body == "", F.lit("{}")).otherwise(body), F.lit("\n---\n\n"))


def iso_timestamp(column: Column) -> Column:
    """ISO 8601 with the UTC offset; microseconds only when there are any."""
    utc = F.to_utc_timestamp(column, F.current_timezone()).cast("timestamp_ntz")
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(utc, "SSSSSS")
    return F.concat(
        whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")),
        F.lit("+00:00"))
