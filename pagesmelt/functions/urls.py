"""URL expressions.  ``parse_url`` is not used: it rejects URLs that occur in real pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the URL pattern of RFC 3986, appendix B, and the schemes with relative paths -
_URL_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_HIERARCHICAL = (
    "", "file", "ftp", "gopher", "http", "https", "imap", "itms", "mms", "nntp", "prospero",
    "rtsp", "rtsps", "rtspu", "sftp", "shttp", "svn", "svn+ssh", "wais", "ws", "wss",
)


# Scheme, authority with its slashes, path, query and fragment of the tidied URLs.
_SPLIT = r"""
    transform(array(regexp_replace(regexp_replace({url}, r'[\t\r\n]', ''), r'^[\x00-\x20]+', '')),
      u_ -> named_struct(
        'scheme', lower(regexp_extract(u_, r'{pattern}', 1)),
        'site', regexp_extract(u_, r'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)', 1),
        'path', regexp_extract(u_, r'{pattern}', 3),
        'query', nullif(regexp_extract(u_, r'{pattern}', 4), '?'),
        'fragment', nullif(regexp_extract(u_, r'{pattern}', 5), '#')))[0]
"""
# Path of the reference against the base, before dot segments: a relative one replaces the
# base's last segment, and a merged path keeps no empty segment inside.
_MERGED = r"""
    CASE WHEN startswith(r_.path, '/') THEN r_.path
         ELSE regexp_replace(
           concat(CASE WHEN b_.path = '' THEN '/' ELSE regexp_replace(b_.path, r'[^/]*$', '') END,
                  r_.path), r'(?<=.)/{2,}', '/') END
"""
_UNDOTTED = r"""
    transform(array(split(path_, '/', -1)),
      s_ -> transform(
        array(aggregate(
          slice(s_, 2, greatest(size(s_) - 1, 0)), cast(array() AS array<string>),
          (kept_, x_) -> CASE WHEN x_ = '.' THEN kept_
                            WHEN x_ = '..' THEN slice(kept_, 1, greatest(size(kept_) - 1, 0))
                            ELSE concat(kept_, array(x_)) END)),
        kept_ -> concat('/', array_join(kept_, '/'),
          CASE WHEN s_[size(s_) - 1] IN ('.', '..') AND size(kept_) > 0 THEN '/' ELSE '' END))[0])[0]
"""


def url_parts_sql(url: str) -> str:
    """SQL text for the struct of a URL's parts."""
    return _SPLIT.format(url=url, pattern=_URL_PARTS)


def resolve_url_sql(base: str, reference: str, base_parts: str | None = None) -> str:
    """SQL text that resolves ``reference`` against ``base``, both SQL expressions.

    Each URL is taken apart once and bound to a lambda variable, so that the expression stays
    small.  ``base_parts`` names a column that already holds the parts of the base.
    """
    base_parts = base_parts or url_parts_sql(base)
    reference_parts = url_parts_sql(reference)
    schemes = ", ".join(f"'{scheme}'" for scheme in _HIERARCHICAL)
    return f"""
    CASE WHEN coalesce({base}, '') = '' THEN {reference}
         WHEN {reference} = '' THEN {base}
         ELSE transform(
           array(named_struct('b', {base_parts}, 'r', {reference_parts})),
           u_ -> transform(array(named_struct(
             'b', u_.b, 'r', u_.r,
             'head', concat(CASE WHEN u_.b.scheme = '' THEN '' ELSE concat(u_.b.scheme, ':') END,
                            CASE WHEN u_.r.site = '' THEN u_.b.site ELSE u_.r.site END),
             'tail', concat(coalesce(u_.r.query, ''), coalesce(u_.r.fragment, '')))),
             v_ -> CASE
               WHEN (v_.r.scheme <> '' AND v_.r.scheme <> v_.b.scheme)
                    OR v_.b.scheme NOT IN ({schemes}) THEN {reference}
               WHEN v_.r.site <> '' THEN concat(v_.head, v_.r.path, v_.tail)
               WHEN v_.r.path = '' THEN concat(
                 v_.head, v_.b.path,
                 CASE WHEN coalesce(v_.r.query, '') = '' THEN coalesce(v_.b.query, '')
                      ELSE v_.r.query END, coalesce(v_.r.fragment, ''))
               ELSE concat(v_.head, transform(
                 array(transform(array(v_), w_ -> transform(array(w_.b), b_ -> transform(
                   array(w_.r), r_ -> {_MERGED})[0])[0])[0]),
                 path_ -> CASE WHEN path_ RLIKE r'(?:^|/)[.]{{1,2}}(?:/|$)' THEN {_UNDOTTED}
                              ELSE path_ END)[0], v_.tail) END)[0])[0] END
    """


def resolve_url(base: str, reference: str) -> Column:
    """Resolve a reference against a base URL as a browser would; no base leaves it alone.

    Both arguments are SQL expressions, such as a column name or ``attrs['href']``.
    """
    return F.expr(resolve_url_sql(base, reference))


def resolve_srcset_sql(base: str, srcset: str, base_parts: str | None = None) -> str:
    """SQL text that resolves every image of a ``srcset`` list, keeping the size descriptors."""
    space = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
    return f"""
    CASE WHEN {base} IS NULL THEN {srcset} ELSE array_join(transform(
      filter(transform(split({srcset}, ','), c_ -> filter(split(c_, r'{space}'), t_ -> t_ <> '')),
             parts_ -> size(parts_) > 0),
      parts_ -> array_join(concat(array({resolve_url_sql(base, 'parts_[0]', base_parts)}),
                                 slice(parts_, 2, size(parts_))), ' ')), ', ') END
    """


def resolve_srcset(base: str, srcset: str) -> Column:
    return F.expr(resolve_srcset_sql(base, srcset))


def _tidy(url: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def percent_decode(column: Column) -> Column:
    """Percent-decode, leaving ``+`` and malformed escapes as they stand."""
    guarded = F.regexp_replace(
        F.replace(column, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.instr(column, "%") > 0, F.try_url_decode(guarded)).otherwise(column)


def output_name(url: Column) -> Column:
    """The ``.md`` file name for a page: its last path segment, or ``index.md``."""
    path = F.rtrim(F.regexp_extract(_tidy(url), _URL_PARTS, 3), F.lit("/"))
    segment = percent_decode(F.regexp_extract(path, r"(?s)([^/]*)$", 1))
    stem = F.regexp_replace(segment, r"(?s)\.[^.]*$", "")
    return F.when(stem == "", F.lit("index.md")).otherwise(F.concat(stem, F.lit(".md")))


def joined_output_path(directory: Column, name: Column) -> Column:
    """``name`` inside ``directory``; an absolute name (from ``%2F``) stands on its own."""
    return F.when(name.startswith("/"), name).when(
        directory.isin("", "."), name
    ).otherwise(F.concat(F.regexp_replace(directory, r"/+$", ""), F.lit("/"), name))
