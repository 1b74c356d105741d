"""Raw responses to captures, and the choice between static and rendered captures."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmelt.fixed_values import (
    HTML_MEDIA_TYPES,
    JS_SHELL_MARKERS,
    META_CHARSET,
    MIN_VISIBLE_PARAGRAPHS,
    MIN_VISIBLE_TEXT,
    MIN_VISIBLE_TEXT_IN_ROOT,
    SNIFF_BYTES,
)
from pagesmelt.functions.text import SPACE_SQL, collapse_space
from pagesmelt.operators import bodies
from pagesmelt.operators.nodes import parse_pages

cloudpickle.register_pickle_by_value(bodies)

METHODS = ("auto", "http", "browser")
# --- fixed values: names of the charsets Spark decodes itself ---------------------------------
_UTF8 = ("utf-8", "utf8", "utf_8", "u8", "cp65001")
_LATIN1 = ("iso-8859-1", "iso8859-1", "latin-1", "latin1", "latin_1", "l1", "8859")


def media_type(content_type: Column) -> Column:
    """Lower-cased type without parameters; a missing or malformed one is plain text."""
    name = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.when(F.regexp_count(name, F.lit("/")) == 1, name).otherwise(F.lit("text/plain"))


def content_type_error(content_type: Column) -> Column:
    """Null for HTML, else why the response cannot be converted."""
    name = media_type(content_type)
    return F.when(
        ~name.isin(*HTML_MEDIA_TYPES), F.concat(F.lit("unsupported content type: "), name))


def header_charset(content_type: Column) -> Column:
    found = F.lower(F.regexp_extract(
        content_type, r"""(?i);\s*charset\s*=\s*["']?([^\s;"']*)""", 1))
    return F.nullif(found, F.lit(""))


def sniffed_charset(body: Column) -> Column:
    """The charset a ``meta`` tag declares near the start; bytes are read one to one."""
    start = F.decode(F.substring(body, 1, SNIFF_BYTES), "iso-8859-1")
    return F.nullif(F.regexp_extract(start, META_CHARSET, 1), F.lit(""))


def charset(content_type: Column, body: Column) -> Column:
    """Header first, then the ``meta`` tag, then UTF-8."""
    return F.coalesce(header_charset(content_type), sniffed_charset(body), F.lit("utf-8"))


def decode_responses(responses: DataFrame) -> DataFrame:
    """Captures from ``url, final_url, content_type, content_encoding, body``.

    Python sees only bodies Spark cannot handle itself: compressed ones, and charsets other
    than UTF-8 and Latin-1.  All others pass as nulls, in the same scan.  A response that cannot
    be decoded becomes a row with ``error``; no other row is affected.
    """
    inflate = F.arrow_udf(bodies.inflate, bodies.INFLATED)
    decode = F.arrow_udf(bodies.decode, bodies.DECODED)
    others = [name for name in responses.columns
              if name not in ("content_type", "content_encoding", "body", "final_url")]
    gated = responses.withColumns({
        "_gate": content_type_error(F.col("content_type")),
        "_encoding": F.lower(F.coalesce("content_encoding", F.lit("")))})
    packed = F.col("_gate").isNull() & F.col("_encoding").isin("gzip", "deflate")
    unpacked = gated.withColumn("_packed", inflate(
        F.when(packed, F.col("body")), F.when(packed, F.col("_encoding"))))
    payload = unpacked.withColumn("_body", F.when(
        F.col("_gate").isNull(), F.coalesce("_packed.body", F.when(
            F.col("_packed.error").isNull(), F.col("body")))))
    named = payload.withColumn("_charset", charset(F.col("content_type"), F.col("_body")))
    name = F.lower("_charset")
    foreign = F.col("_body").isNotNull() & ~name.isin(*_UTF8, *_LATIN1)
    decoded = named.withColumn("_other", decode(
        F.when(foreign, F.col("_body")), F.when(foreign, F.col("_charset"))))
    html = (
        F.when(name.isin(*_UTF8), F.make_valid_utf8(F.col("_body").cast("string")))
        .when(name.isin(*_LATIN1), F.decode("_body", "iso-8859-1"))
        .otherwise(F.col("_other.html")))
    return decoded.select(
        *others, html.alias("html"),
        F.coalesce("_gate", "_packed.error", "_other.error").alias("error"),
        F.coalesce("final_url", "url").alias("final_url"), F.lit("http").alias("method"))


def visible_text(nodes: str = "nodes") -> Column:
    """Readable text outside scripts, styles, templates and noscript, white space collapsed."""
    return collapse_space(F.expr(f"""
        array_join(filter(transform(
          filter({nodes}, n -> n.kind = 'text' AND NOT n.raw AND NOT n.inert),
          n -> btrim(n.text, {SPACE_SQL})), t -> t <> ''), ' ')"""))


def is_js_shell(text: Column) -> Column:
    """The text asks for JavaScript."""
    lowered = F.lower(text)
    found = F.lit(False)
    for marker in JS_SHELL_MARKERS:
        found = found | F.contains(lowered, F.lit(marker))
    return found


def with_meaningful(parsed: DataFrame) -> DataFrame:
    """Adds ``meaningful``: enough visible text or structure to convert the static capture.

    Works on the parsed array of each page; no explode, no shuffle.
    """
    facts = parsed.withColumns({
        "_text": visible_text(),
        "_root": F.expr("exists(nodes, n -> n.kind = 'elem' AND NOT n.inert AND "
                        "(n.tag IN ('main', 'article') OR n.attrs['role'] = 'main'))"),
        "_paragraphs": F.expr("size(filter(nodes, n -> n.tag = 'p' AND NOT n.inert))")})
    size = F.length("_text")
    enough = (
        (size >= MIN_VISIBLE_TEXT) | (F.col("_root") & (size >= MIN_VISIBLE_TEXT_IN_ROOT))
        | (F.col("_paragraphs") >= MIN_VISIBLE_PARAGRAPHS))
    return facts.withColumn(
        "meaningful", F.coalesce(~is_js_shell(F.col("_text")) & enough, F.lit(False))
    ).drop("_text", "_root", "_paragraphs")


def meaningful_pages(pages: DataFrame) -> DataFrame:
    """``page_id`` and whether the page can be converted as it stands."""
    return with_meaningful(parse_pages(pages.select("page_id", "html"))).select(
        "page_id", "meaningful")


def select_captures(
    requests: DataFrame, static: DataFrame, rendered: DataFrame, *, method: str = "auto",
    strict: bool = False,
) -> DataFrame:
    """One capture for every request, in any order; ``ord`` keeps the place.

    ``requests`` holds ``ord, url``; ``static`` and ``rendered`` hold ``ord, html, error`` and
    ``final_url`` or ``nav_timed_out``.  ``auto`` takes a static capture that is meaningful and
    falls back to the rendered one.  URLs may repeat, so ``ord`` is the join key.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}; got {method!r}")
    late = F.coalesce("nav_timed_out", F.lit(False)) & F.lit(strict)
    browser = rendered.select(
        "ord",
        F.when(~late, F.col("html")).alias("b_html"),
        F.when(late, F.lit("navigation timed out")).otherwise(F.col("error")).alias("b_error"),
        F.lit(True).alias("b_seen"))
    b_error = F.coalesce("b_error", F.when(
        F.col("b_seen").isNull() | F.col("b_html").isNull(), F.lit("no rendered capture")))
    if method == "browser":
        joined = requests.join(browser, "ord", "left")
        return joined.select(
            "ord", "url", F.when(b_error.isNull(), F.col("b_html")).alias("html"),
            b_error.alias("error"), F.when(b_error.isNull(), F.col("url")).alias("final_url"),
            F.lit("browser").alias("method"))
    http = static.select(
        "ord", "html", F.col("error").alias("h_error"), F.col("final_url").alias("h_final_url"))
    if method == "http":
        joined = requests.join(http, "ord", "left")
        h_error = F.coalesce("h_error", F.when(
            F.col("html").isNull(), F.lit("no static capture")))
        return joined.select(
            "ord", "url", F.when(h_error.isNull(), F.col("html")).alias("html"),
            h_error.alias("error"),
            F.when(h_error.isNull(), F.coalesce("h_final_url", "url")).alias("final_url"),
            F.lit("http").alias("method"))
    judged = with_meaningful(parse_pages(http.withColumn("h_html", F.col("html")))).drop("nodes")
    usable = F.coalesce(F.col("h_error").isNull() & F.col("meaningful"), F.lit(False))
    kept = judged.select(
        "ord", F.when(usable, F.col("h_html")).alias("h_html"), usable.alias("usable"),
        "h_final_url")
    joined = requests.join(kept, "ord", "left").join(browser, "ord", "left")
    static_wins = F.coalesce("usable", F.lit(False))
    return joined.select(
        "ord", "url",
        F.when(static_wins, F.col("h_html")).when(b_error.isNull(), F.col("b_html")).alias("html"),
        F.when(~static_wins, b_error).alias("error"),
        F.when(static_wins, F.coalesce("h_final_url", "url")).when(
            b_error.isNull(), F.col("url")).alias("final_url"),
        F.when(static_wins, F.lit("http")).otherwise(F.lit("browser")).alias("method"))
