"""What the queries must yield, as DuckDB SQL on the given tables.

The SQL takes strings apart or, for pages derived from documents, states the expected result
from the columns; it shares neither the node table nor any expression with the library.
"""

from __future__ import annotations

# --- pages as given -----------------------------------------------------------------------------
_UNESCAPED = (
    "replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), "
    "'&quot;', '\"'), '&quot', '\"'), '&amp;', '&'), '&amp', '&')")
_ESCAPED = "replace(replace({0}, '*', '\\*'), '_', '\\_')"


def _plain(text: str) -> str:
    return _UNESCAPED.format(text)


def _mark(text: str) -> str:
    return _ESCAPED.format(_plain(text))


# The parts every given page has: navigation links, article with a heading, footer.
_PARTS = r"""
parts AS (
  SELECT page_id, url, html,
    regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
    regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav,
    regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article,
    regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS footer,
    regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
    regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1
  FROM pages)
"""


def _resolved(origin: str, href: str) -> str:
    """An absolute-path reference: an empty query or fragment disappears."""
    return (f"{origin} || regexp_replace(regexp_replace({href}, '#$', ''), "
            "'^([^?#]*)\\?(#|$)', '\\1\\2')")


def _segments(html: str) -> str:
    """Trimmed, non-empty texts between tags."""
    return (f"list_filter(list_transform(regexp_split_to_array({html}, '<[^>]*>'), "
            f"lambda t: trim({_plain('t')}, E' \\n\\t\\r')), lambda t: t <> '')")


_VISIBLE = (
    r"regexp_replace(regexp_replace(html, '(?s)<(style|script)>.*?</(style|script)>|<!--.*?-->"
    r"""|<div class="ad">.*?</div>', '<x>', 'g'), '^<!DOCTYPE[^>]*>', '')""")

_CANDIDATE = r"""
cand AS (
  SELECT page_id, s,
    coalesce(list_sum(list_transform(s, lambda t: length(t))) + len(s) - 1, 0)::INT AS text_length,
    len(regexp_extract_all(article, '<p>'))::INT AS paragraphs,
    coalesce(list_sum(list_transform(
      s, lambda t: len(regexp_extract_all(t, '[.!?。！？]')))), 0)::INT AS punctuation,
    CASE WHEN list_contains({segments_h1}, '') THEN 0 ELSE len({segments_h1}) END::INT AS structural_elements
  FROM (SELECT *, {segments} AS s FROM parts)),
scored AS (
  SELECT *, CASE WHEN text_length > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS link_density,
    round((text_length + 80 * paragraphs + 12 * punctuation + 40 * structural_elements)
          * CASE WHEN text_length > 0 THEN 1.0 ELSE 0.1 END, 2)::DOUBLE AS score
  FROM cand),
decided AS (
  SELECT *, CASE WHEN text_length < 80
      THEN 'best candidate is too short (' || text_length || ' characters)'
      WHEN paragraphs = 0 AND structural_elements < 2
      THEN 'best candidate lacks paragraph and document structure'
      ELSE 'highest-quality DOM candidate' END AS reason
  FROM scored)
""".replace("{segments_h1}", _segments("h1")).replace("{segments}", _segments("article"))


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _nav(link: str) -> str:
    """The navigation list; every page has one link per list item."""
    return f"""
    coalesce(array_to_string(list_transform(
      regexp_extract_all(nav, '(?s)<a href="[^"]*">.*?</a>'), lambda a: {link}), chr(10)), '')"""


_HREF = _plain("regexp_extract(a, '^<a href=\"([^\"]*)\"', 1)")
_LABEL = _mark("trim(regexp_extract(a, '(?s)>(.*)</a>$', 1))")
_LINK_KEEP = f"'* [' || {_LABEL} || '](' || {_resolved('origin', _HREF)} || ')'"
_LINK_TEXT = f"'* ' || {_LABEL}"

def _blocks(html: str) -> str:
    """Each <p> starts a block; <b> opens bold that stays open to the end."""
    return f"""
    array_to_string(list_filter(list_transform(
      regexp_split_to_array({html}, '<p>|</p>|<br>'),
      lambda b: CASE WHEN starts_with(b, '<b>')
        THEN '**' || {_mark("trim(substring(b, 4), E' ' || chr(10))")}
        ELSE {_mark("trim(b, E' ' || chr(10))")} END), lambda b: b <> ''), chr(10) || chr(10))
    || repeat('**', len(regexp_extract_all({html}, '<b>')))"""


_ARTICLE = f"""
    '# ' || replace({_mark("trim(h1, E' ' || chr(10))")}, chr(10), ' ') || chr(10) || chr(10) ||
    {_blocks("regexp_replace(article, '(?s)^<h1>.*?</h1>', '')")}"""
_FOOTER = _mark("trim(footer, E' ' || chr(10))")


def _page(nav: str) -> str:
    return f"""
    CASE WHEN ({nav}) <> '' THEN ({nav}) || chr(10) || chr(10) ELSE '' END
    || ({_ARTICLE}) || chr(10) || chr(10) || {_FOOTER} || chr(10)"""


# What the published heuristic makes of the given pages.  An article is a chain of <p><b>, each inside
# the one before it, with closed paragraphs between; credit goes to the article from the first <p>, and to
# each <b> from its paragraphs and the next <p>.  The best of them is the article or one <b>; without any
# credit it is the body, of which the list of links is cut.
_EXTRACTED = f"""
grp AS (
  SELECT page_id, g, rest, {_segments("part")} AS texts, list_transform(
    regexp_extract_all(part, '(?s)<p>(.*?)</p>', 1),
    lambda t: trim({_plain('t')}, E' \\n\\t\\r')) AS inner_texts
  FROM (SELECT page_id, g, gs[g] AS part, '<b>' || array_to_string(gs[g:], '<p><b>') AS rest
        FROM (SELECT page_id, gs, unnest(range(1, len(gs) + 1)) AS g
              FROM (SELECT page_id, string_split(article, '<p><b>')[2:] AS gs FROM parts)))),
tot AS (
  SELECT *, sum(len(texts)) OVER later AS runs, sum(len(inner_texts)) OVER later AS inner_count,
    count(*) OVER later AS groups,
    sum(list_sum(list_transform(texts, lambda t: length(t)))) OVER later AS chars,
    sum(list_sum(list_transform(texts, lambda t: length(t) - length(replace(t, ',', ''))))) OVER later
      AS commas,
    list_sum(list_transform(list_filter(inner_texts, lambda t: length(t) >= 25), lambda t:
      2 + length(t) - length(replace(t, ',', '')) + least(length(t) / 100, 3))) AS inner_credit
  FROM grp WINDOW later AS (PARTITION BY page_id ORDER BY g DESC)),
credits AS (
  SELECT *, chars + runs - 1 AS size, CASE WHEN chars + runs - 1 >= 25
    THEN 2 + commas + least((chars + runs - 1) / 100, 3) END AS credit
  FROM tot),
nodes AS (
  SELECT page_id, 0 AS g, 5 + credit AS points FROM credits WHERE g = 1
  UNION ALL
  SELECT page_id, g, coalesce(inner_credit + after, inner_credit, after)
  FROM (SELECT *, lead(credit) OVER (PARTITION BY page_id ORDER BY g) AS after FROM credits)),
best AS (
  SELECT page_id, g FROM nodes WHERE points IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY points DESC, g) = 1),
own AS (
  SELECT d.page_id, b.g, rest, CASE WHEN b.g IS NULL THEN coalesce(
        list_sum(list_transform(body, lambda t: length(t))) + len(body) - 1, 0)
      WHEN b.g = 0 THEN d.text_length ELSE size END::INT AS own_length,
    CASE WHEN b.g > 0 THEN inner_count + groups - 1 ELSE d.paragraphs END AS own_paragraphs,
    CASE WHEN b.g > 0 THEN 0 ELSE d.structural_elements END AS own_structure
  FROM decided d
  JOIN (SELECT page_id, list_concat({_segments("article")}, {_segments("footer")}) AS body FROM parts) p
    USING (page_id)
  LEFT JOIN best b ON b.page_id = d.page_id
  LEFT JOIN credits c ON c.page_id = b.page_id AND c.g = b.g),
extracted AS (
  SELECT d.*, g, rest, own_length, own_structure,
    coalesce(own_length >= 80 AND (own_paragraphs > 0 OR own_structure >= 2), false) AS ok
  FROM decided d LEFT JOIN own USING (page_id))
"""

_FULL = f"{_with(_PARTS)}, md AS (SELECT *, {_page(_nav(_LINK_KEEP))} AS markdown FROM parts)"

# --- pages derived from documents ------------------------------------------------------------
_DOC = r"""
d AS (
  SELECT doc_id, text, lang, source, doc_id % 9 = 0 AS shell,
    'https://site' || (doc_id % 7) || '.example' AS origin,
    replace(replace(trim(regexp_replace(regexp_replace(
      text, '[\t \r\n]*[\r\n][\t \r\n]*', chr(10), 'g'), '[\t ]+', ' ', 'g'), E' \n'),
      '*', '\*'), '_', '\_') AS body
  FROM documents)
"""
_NL = "chr(10) || chr(10)"


def _derived(image: str, link: str, dom: bool = False, head: str = "''") -> str:
    main = f"""
      '# Doc ' || doc_id || {_NL} || body || {_NL} || {image}
      || 'See ' || {link} || '.'
      || CASE WHEN doc_id % 7 = 0 THEN {_NL} || '```python' || chr(10) || 'x = ' || doc_id
              || chr(10) || '    y = 2' || chr(10) || '```' ELSE '' END
      || CASE WHEN doc_id % 8 = 0 THEN {_NL} || '| K | V |' || chr(10) || '| --- | --- |'
              || chr(10) || '| ' || doc_id || ' | b |' ELSE '' END"""
    post = ("'Second part ' || doc_id || ', with words to rank. And more of them, to be long "
            "enough to count.'")
    rest = f"""
      CASE WHEN doc_id % 10 = 0 THEN {_NL} || {post} ELSE '' END
      || {_NL} || 'Kept ' || doc_id || '.'"""
    full = f"({main}) || {rest}"
    if dom:
        chosen = (f"CASE best WHEN 'main' THEN ({main}) WHEN 'post' THEN {post} ELSE {full} END")
    else:
        chosen = full
    return f"""{head} || CASE WHEN shell THEN 'Please enable JavaScript to view ' || doc_id || '.'
      ELSE {chosen} END || chr(10) AS markdown"""


_IMAGE = ("CASE WHEN doc_id % 6 = 0 THEN '![Image ' || doc_id || '](' || origin || '/docs/' || "
          f"doc_id || '/i/' || doc_id || '.png)' || {_NL} ELSE '' END")
_IMAGE_ALT = f"CASE WHEN doc_id % 6 = 0 THEN 'Image ' || doc_id || {_NL} ELSE '' END"
_LINK = "'[link ' || doc_id || '](' || origin || '/docs/x/' || doc_id || '?q=1#f)'"

# Features of the two candidates a derived page can have, from the texts they are made of.
_SCORES = r"""
f AS (
  SELECT *, length(doc_id::VARCHAR) AS w,
    length(trim(text, E' \n')) AS tl, len(regexp_extract_all(text, '[.!?。！？]')) AS tp
  FROM d WHERE NOT shell),
c AS (
  SELECT doc_id, 1 AS rank, 0 AS cand_ord, 'main#m' || doc_id AS selector, 2 AS paragraphs,
    -- heading, text, See, link, full stop; code; four cells
    4 + w + 1 + tl + 1 + 3 + 1 + 5 + w + 1 + 1
      + CASE WHEN doc_id % 7 = 0 THEN 1 + 4 + w + 10 ELSE 0 END
      + CASE WHEN doc_id % 8 = 0 THEN 2 + 2 + 1 + w + 2 ELSE 0 END AS text_length,
    5 + w AS link_length, tp + 1 AS punctuation,
    1 + (doc_id % 7 = 0)::INT + (doc_id % 8 = 0)::INT AS structural_elements
  FROM f
  UNION ALL
  SELECT doc_id, 3, 1, 'div.post', 1,
    length('Second part , with words to rank. And more of them, to be long enough to count.') + w,
    0, 2, 0
  FROM f WHERE doc_id % 10 = 0),
s AS (
  SELECT *, printf('%.3f', link_length / text_length)::DOUBLE AS link_density,
    printf('%.2f', (text_length + 80 * paragraphs + 12 * punctuation + 40 * structural_elements)
          * (1 - least(link_length / text_length, 0.9::DOUBLE)))::DOUBLE AS score
  FROM c),
r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cand_ord) AS place FROM s)
"""
_BEST = """
b AS (
  SELECT d.*, CASE WHEN r.text_length < 80 OR r.link_density > 0.65 OR r.doc_id IS NULL THEN 'full'
                   WHEN r.cand_ord = 0 THEN 'main' ELSE 'post' END AS best
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND r.place = 1)
"""

_META = """
m AS (
  SELECT doc_id, lang, shell,
    CASE WHEN shell THEN NULL WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id || ': a "b"'
         ELSE 'Doc ' || doc_id END AS title,
    CASE WHEN NOT shell AND doc_id % 3 = 0 THEN 'About ' || doc_id END AS description,
    CASE WHEN NOT shell AND doc_id % 4 = 0 THEN origin || '/d/' || doc_id END AS canonical_url,
    CASE WHEN NOT shell THEN 'A' || doc_id END AS author,
    CASE WHEN NOT shell THEN '2024-01-02' END AS published_time,
    CASE WHEN NOT shell THEN lang END AS language
  FROM d)
"""
_FRONT = """
    '---' || chr(10) || CASE WHEN shell THEN '{}' ELSE
      CASE WHEN doc_id % 2 = 0 THEN 'title: "' || replace(title, '"', '\\"') || '"'
           ELSE 'title: ' || title END
      || CASE WHEN description IS NOT NULL THEN chr(10) || 'description: ' || description ELSE '' END
      || CASE WHEN canonical_url IS NOT NULL
              THEN chr(10) || 'canonical_url: "' || canonical_url || '"' ELSE '' END
      || chr(10) || 'author: ' || author || chr(10) || 'published_time: "2024-01-02"'
      || chr(10) || 'language: ' || language END || chr(10) || '---' || chr(10) || chr(10)"""

# --- captures derived from documents -----------------------------------------------------------
_CAPTURES = r"""
q AS (
  SELECT doc_id AS ord, origin || '/docs/' || doc_id || '/page.html' AS url,
    doc_id % 11 = 0 AS failed, shell, doc_id % 33 = 0 AS unseen, doc_id % 13 = 0 AS late
  FROM d)
"""


def _capture(strict: bool) -> str:
    problem = "CASE WHEN unseen THEN 'no rendered capture'"
    if strict:
        problem += " WHEN late THEN 'navigation timed out'"
    problem += " END"
    return f"""{_with(_DOC, _CAPTURES)},
    a AS (SELECT *, NOT failed AND NOT shell AS static, {problem} AS problem FROM q)
    """


def _auto(strict: bool) -> str:
    return f"""{_capture(strict)}
    SELECT ord, a.url, CASE WHEN static THEN 'http' ELSE 'browser' END AS method,
      CASE WHEN NOT static THEN problem END AS error,
      CASE WHEN static THEN a.url || CASE WHEN ord % 4 = 0 THEN '?to=' || ord ELSE '' END
           WHEN problem IS NULL THEN a.url END AS final_url,
      CASE WHEN static THEN h.html_chars
           WHEN problem IS NULL THEN length('<p>rendered </p>') + length(ord::VARCHAR)
           ELSE 0 END::INT AS html_chars
    FROM a LEFT JOIN ({_HTML_CHARS}) h ON h.doc_id = a.ord"""


# Length of the HTML around a document, from the lengths of its parts.
_HTML_CHARS = r"""
    SELECT doc_id, CASE WHEN doc_id % 9 = 0
      THEN length('<html><body><div id="root"></div><noscript></noscript><p>Please enable JavaScript to view .</p></body></html>') + e + w
      ELSE length('<!DOCTYPE html><html lang=""><head>') + length(lang)
        + CASE WHEN doc_id % 2 = 0 THEN length('<meta property="og:title" content="Doc : a &quot;b&quot;">') + w
               ELSE length('<title>Doc </title>') + w END
        + CASE WHEN doc_id % 3 = 0 THEN length('<meta name="description" content=" About  ">') + w ELSE 0 END
        + CASE WHEN doc_id % 4 = 0 THEN length('<link rel="canonical" href="/d/">') + w ELSE 0 END
        + length('<meta name="author" content=""><meta property="article:author" content="A"><meta name="date" content="2024-01-02"></head>') + w
        + length('<body><header role="banner">Top </header>') + w
        + CASE WHEN doc_id % 5 = 0 THEN length('<p hidden>hidden </p><div style="display: none"><p>styled</p></div><p aria-hidden="TRUE">aria</p><div role="Dialog">dialog</div>') + w ELSE 0 END
        + length('<div class="cookie-note wide">cookies</div>')
        + length('<main id="m"><h1>Doc </h1><h2> </h2><a href="/empty"> </a><p></p>') + 2 * w + e
        + CASE WHEN doc_id % 6 = 0 THEN length('<img src="i/.png" alt="Image ">') + 2 * w
               ELSE length('<img src="spacer.png" alt="">') END
        + length('<p>See <a href="../x/?q=1#f">link </a>.</p>') + 2 * w
        + CASE WHEN doc_id % 7 = 0 THEN length('<pre><code class="hl language-python">x =     y = 2</code></pre>') + 1 + w ELSE 0 END
        + CASE WHEN doc_id % 8 = 0 THEN length('<table><tr><th>K</th><th>V</th></tr><tr><td></td><td>b</td></tr></table>') + w ELSE 0 END
        + length('</main>')
        + CASE WHEN doc_id % 10 = 0 THEN length('<div class="post"><p>Second part , with words to rank. And more of them, to be long enough to count.</p></div>') + w ELSE 0 END
        + length('<p class="shared-context">Kept .</p><div id="ad-slot">Buy</div></body></html>') + w
      END AS html_chars
    FROM (SELECT doc_id, lang, length(doc_id::VARCHAR) AS w,
            length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS e
          FROM documents)
"""

_SECOND = ("'Second part of page ' || doc_id || ', long enough to be read, and with more than one clause, '"
           " || 'so that it counts.'")
_ROLE = ("'Role ' || doc_id || ', and words enough, that no page is too short to be taken as content by '"
         " || 'what it has.'")
_BODY_BLOCK = f"CASE WHEN body = '' THEN '' ELSE body || {_NL} END"


def _listing(language: str) -> str:
    return f"""{_with(_DOC)}
      SELECT doc_id AS page_id, doc_id || '. ' || source || chr(10) || (doc_id + 1) || '. ' || lang
        || chr(10) || repeat(' ', len((doc_id + 1)::VARCHAR) + 2) || '* n ' || doc_id || {_NL} || '> '
        || CASE WHEN body = '' THEN '' ELSE replace(body, chr(10), chr(10) || '> ') || chr(10) || '>'
             || chr(10) || '> ' END || '* q' || {_NL} || '---' || {_NL} || '```' || {language}
        || chr(10) || '  x = ' || doc_id || chr(10) || '```' || chr(10) AS markdown
      FROM d"""


ORACLES: dict[str, str] = {
    "url_list": """
      SELECT 2 * (n - 1) + k AS ord, url
      FROM (SELECT url, row_number() OVER (ORDER BY page_id) AS n FROM pages),
        (VALUES (0), (1)) v(k)""",
    "url_sources": """
      SELECT row_number() OVER (ORDER BY source, pos) - 1 AS ord, source, url
      FROM (SELECT 0 AS source, event_id AS pos, 'http://events.example/' || event_id AS url
            FROM events WHERE event_id % 50 = 0
            UNION ALL SELECT 1, page_id, url FROM pages)""",
    "article_choice": f"""
      SELECT doc_id AS page_id, 'readability' AS selected,
        'readability candidate passed quality checks' AS reason,
        (5 + len(doc_id::VARCHAR) + 1 + len({_SECOND})
          + CASE WHEN trim(text, E' \\n') = '' THEN 0 ELSE len(trim(text, E' \\n')) + 1 END)::INT
          AS text_length, 2 AS paragraphs, 0::DOUBLE AS link_density, 1 AS structural_elements
      FROM documents""",
    "article_markdown": f"""{_with(_DOC)}
      SELECT doc_id AS page_id, '## Head ' || doc_id || {_NL} || {_BODY_BLOCK} || {_SECOND} || chr(10)
        AS markdown FROM d""",
    "role_choice": """
      SELECT doc_id AS page_id, 'section[role="main"]' AS selected,
        'div.entry div.entry section[role="main"]' AS selectors FROM documents""",
    "role_markdown": f"""{_with(_DOC)}
      SELECT doc_id AS page_id, {_BODY_BLOCK} || {_ROLE} || chr(10) AS markdown FROM d""",
    "lists_markdown": _listing("lang"),
    "language_hook": _listing("'x-' || lang"),
    "odd_markup": f"""{_with(_DOC)}
      SELECT doc_id AS page_id, CASE WHEN doc_id % 20 = 0 THEN '' ELSE
        '# Page ' || doc_id || {_NL} || {_BODY_BLOCK} || 'end' END || chr(10) AS markdown FROM d""",
    "unreadable_pages": """
      SELECT doc_id AS page_id, 'no markup' AS error FROM documents WHERE doc_id % 20 = 0""",
    "output_path": r"""
      SELECT page_id, 'out/' || CASE WHEN stem = '' THEN 'index' ELSE stem END || '.md' AS output_path
      FROM (SELECT page_id, regexp_replace(url_decode(replace(regexp_extract(regexp_extract(
              url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1), '+', '%2B')),
              '\.[^.]*$', '') AS stem FROM pages)""",
    "output_collisions": """
      SELECT 'out/a b+' || (doc_id % 50) || '.v1.md' AS output_path, count(*) AS url_count
      FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "resolve_links": f"""{_with(_PARTS)}
      SELECT page_id, (n - 1)::INT AS link_no, href, {_resolved('origin', 'href')} AS resolved
      FROM (SELECT page_id, origin, n, {_plain("links[n]")} AS href
            FROM (SELECT page_id, origin, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links,
                    unnest(generate_series(1, len(regexp_extract_all(html, '<a href="')))) AS n
                  FROM parts))""",
    "srcset": """
      SELECT doc_id, 'https://example.com/' || source || '/p' || doc_id || '/s' || doc_id
        || '.png 480w, https://example.com/assets/' || doc_id || '.png 960w, https://example.com/'
        || source || '/up.png, https://cdn.example/' || doc_id || '.png 2x' AS srcset
      FROM documents""",
    "charset_sniff": """
      SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'koi8-r' END AS declared,
        CASE doc_id % 5 WHEN 0 THEN 'ISO-8859-1' WHEN 2 THEN lang || '-8' WHEN 4 THEN 'utf-8' END
          AS sniffed
      FROM documents""",
    "content_type_gate": """
      SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 1, 2) THEN NULL
        WHEN doc_id % 7 = 3 THEN 'unsupported content type: application/' || source
        ELSE 'unsupported content type: text/plain' END AS error
      FROM documents""",
    "decode_responses": """
      SELECT page_id AS ord, url, CASE WHEN page_id % 6 NOT IN (3, 5) THEN html END AS html,
        CASE page_id % 6 WHEN 3 THEN 'unsupported content type: application/pdf'
          WHEN 5 THEN 'unsupported content type: text/plain' END AS error,
        url || CASE WHEN page_id % 3 = 0 THEN '/moved' ELSE '' END AS final_url, 'http' AS method
      FROM pages""",
    "meaningful_pages": "SELECT doc_id AS page_id, doc_id % 9 <> 0 AS meaningful FROM documents",
    "meaningful_given_pages": f"""
      WITH t AS (SELECT page_id, html, array_to_string({_segments(
          "regexp_replace(html, '(?s)<(style|script)>.*?</(style|script)>', '<x>', 'g')")}, ' ')
          AS text FROM pages)
      SELECT page_id, NOT regexp_matches(lower(text), 'enable javascript|javascript is required|'
          || 'please turn on javascript')
        AND (length(regexp_replace(text, '\\s+', ' ', 'g')) >= 80
             OR len(regexp_extract_all(html, '<p>')) >= 2) AS meaningful
      FROM t""",
    "select_capture": _auto(False),
    "select_capture_strict": _auto(True),
    "select_capture_http": f"""{_capture(False)}
      SELECT ord, a.url, 'http' AS method, CASE WHEN failed THEN 'HTTP Error 500' END AS error,
        CASE WHEN NOT failed THEN a.url || CASE WHEN ord % 4 = 0 THEN '?to=' || ord ELSE '' END END
          AS final_url,
        CASE WHEN NOT failed THEN h.html_chars ELSE 0 END::INT AS html_chars
      FROM a LEFT JOIN ({_HTML_CHARS}) h ON h.doc_id = a.ord""",
    "select_capture_browser": f"""{_capture(True)}
      SELECT ord, url, 'browser' AS method, problem AS error,
        CASE WHEN problem IS NULL THEN url END AS final_url,
        CASE WHEN problem IS NULL THEN length('<p>rendered </p>') + length(ord::VARCHAR)
             ELSE 0 END::INT AS html_chars
      FROM a""",
    "batch_summary": f"""{_capture(True)}
      SELECT count(*) AS url_count, count(*) FILTER (static OR problem IS NULL) AS ok_count,
        count(*) FILTER (NOT static AND problem IS NOT NULL) AS failed_count,
        count(*) FILTER (NOT static AND problem IS NOT NULL) > 0 AS failed
      FROM a""",
    "failed_captures": f"""{_capture(True)}
      SELECT ord, url, problem AS error FROM a WHERE NOT static AND problem IS NOT NULL""",
    "node_counts": """
      SELECT tag, count(*) AS elements
      FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
      GROUP BY tag""",
    "clean_text": f"""
      SELECT page_id, array_to_string({_segments(_VISIBLE)}, ' ') AS text FROM pages""",
    "noise_dropped": f"""
      SELECT page_id,
        len(regexp_extract_all(html, '<(style|script|meta)[ >]')) AS tag_seeds,
        len(regexp_extract_all(html, 'class="ad"')) AS noise_seeds,
        len({_segments('''regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1)''')})
          AS dropped_runs,
        len({_segments(_VISIBLE)}) AS kept_runs
      FROM pages""",
    "hidden_dropped": """
      SELECT doc_id AS page_id,
        CASE WHEN doc_id % 9 <> 0 AND doc_id % 5 = 0 THEN 3 ELSE 0 END AS hidden,
        CASE WHEN doc_id % 9 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS roles,
        CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 2 END AS noise,
        CASE WHEN doc_id % 9 = 0 THEN 1 WHEN doc_id % 10 = 0 THEN 4 ELSE 3 END AS paragraphs_left
      FROM documents""",
    "empty_pruned": """
      SELECT doc_id AS page_id,
        CASE WHEN shell THEN 0 ELSE 2 END AS headings_before,
        CASE WHEN shell THEN 0 ELSE 2 END AS links_before,
        CASE WHEN shell THEN 0 ELSE 1 END AS images_before,
        CASE WHEN shell THEN 0 ELSE 1 END AS headings_after,
        CASE WHEN shell THEN 0 ELSE 1 END AS links_after,
        CASE WHEN NOT shell AND doc_id % 6 = 0 THEN 1 ELSE 0 END AS images_after
      FROM (SELECT doc_id, doc_id % 9 = 0 AS shell FROM documents)""",
    "page_metadata": f"""{_with(_DOC, _META)}
      SELECT doc_id AS page_id, title, description, canonical_url, author, published_time, language
      FROM m""",
    "page_metadata_given": f"""{_with(_PARTS)}
      SELECT page_id, coalesce(nullif(array_to_string({_segments('title')}, ' '), ''),
                               nullif(array_to_string({_segments('h1')}, ' '), '')) AS title,
        nullif(trim(regexp_extract(html, '<html lang="([^"]*)"', 1)), '') AS language
      FROM parts""",
    "page_metadata_fetched": """
      SELECT page_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
        || CASE WHEN date_part('microsecond', ts)::BIGINT % 1000000 <> 0
                THEN '.' || lpad((date_part('microsecond', ts)::BIGINT % 1000000)::VARCHAR, 6, '0')
                ELSE '' END || '+00:00' AS fetched_at
      FROM pages LEFT JOIN events ON event_id = page_id""",
    "front_matter": f"""{_with(_DOC, _META)}
      SELECT doc_id AS page_id, {_FRONT} AS front_matter FROM m""",
    "candidates": f"""{_with(_PARTS, _CANDIDATE)}
      SELECT page_id, 0 AS cand_ord, 'article[0]' AS selector, score, text_length, paragraphs,
        link_density, punctuation, structural_elements FROM scored""",
    "candidate_rank": f"""{_with(_DOC, _SCORES)}
      SELECT doc_id AS page_id, cand_ord, rank, selector, score, text_length::INT AS text_length,
        paragraphs, link_density, punctuation::INT AS punctuation, structural_elements, place
      FROM r""",
    "candidate_lines": f"""{_with(_DOC, _SCORES)}
      SELECT doc_id AS page_id, (place - 1)::INT AS place, 'candidate: selector=' || selector
        || ' score=' || printf('%.2f', score) || ' text=' || text_length || ' paragraphs='
        || paragraphs || ' links=' || printf('%.3f', link_density) || ' punctuation='
        || punctuation || ' structure=' || structural_elements AS line
      FROM r""",
    "extraction_decision": f"""{_with(_PARTS, _CANDIDATE)}
      SELECT page_id, 'dom' AS requested_mode,
        CASE WHEN starts_with(reason, 'best') THEN 'full' ELSE 'article[0]' END AS selected, reason,
        1 AS candidate_count FROM decided""",
    "readability_root": f"""{_with(_PARTS, _CANDIDATE)}, {_EXTRACTED}
      SELECT page_id, CASE WHEN ok THEN 'readability' WHEN starts_with(reason, 'best') THEN 'full'
          ELSE 'article[0]' END AS selected,
        CASE WHEN ok THEN 'readability candidate passed quality checks'
          WHEN starts_with(reason, 'best') THEN reason
          ELSE 'readability candidate failed quality checks; selected DOM candidate' END AS reason,
        CASE WHEN ok THEN own_length ELSE text_length END AS text_length
      FROM extracted""",
    "markdown_auto": f"""{_FULL}, {_CANDIDATE}, {_EXTRACTED}
      SELECT md.page_id, CASE WHEN ok AND g IS NULL THEN {_page("''")}
        WHEN ok AND g > 0 THEN {_blocks("rest")} || chr(10)
        WHEN starts_with(reason, 'best') AND NOT ok THEN markdown
        ELSE ({_ARTICLE}) || chr(10) END AS markdown
      FROM md JOIN extracted USING (page_id)""",
    "quality_means": f"""{_with(_PARTS, _CANDIDATE)}, {_EXTRACTED},
      body AS (SELECT *, {_segments("regexp_replace(" + _VISIBLE + ", '(?s)^.*?<body>', '')")} AS bs
               FROM parts),
      kept AS (
        SELECT e AS extractor, CASE WHEN e = 'readability' AND ok THEN own_length
            WHEN e = 'full' OR starts_with(reason, 'best')
            THEN coalesce(list_sum(list_transform(bs, lambda t: length(t))) + len(bs) - 1, 0)
            ELSE text_length END AS size,
          CASE WHEN e = 'readability' AND ok THEN own_structure ELSE structural_elements END AS headings
        FROM body JOIN extracted USING (page_id), (VALUES ('full'), ('dom'), ('readability')) v(e))
      SELECT extractor, count(*) AS pages, avg(size) AS mean_text_length, avg(headings) AS mean_headings,
        0::DOUBLE AS mean_code_blocks, 0::DOUBLE AS mean_tables, 0::DOUBLE AS mean_images
      FROM kept GROUP BY extractor""",
    "decision_lines": f"""{_with(_PARTS, _CANDIDATE)}
      SELECT page_id, 'extraction: mode=dom selected=' || CASE WHEN starts_with(reason, 'best')
        THEN 'full' ELSE 'article[0]' END || ' reason=' || reason AS line FROM decided""",
    "content_root_text": f"""{_with(_PARTS, _CANDIDATE)}
      SELECT p.page_id, array_to_string(CASE WHEN starts_with(reason, 'best')
          THEN {_segments("regexp_replace(" + _VISIBLE + ", '(?s)^.*?<body>', '')")} ELSE s END, ' ')
        AS text
      FROM parts p JOIN decided USING (page_id)""",
    "markdown_full": f"{_FULL} SELECT page_id, markdown FROM md",
    "markdown_dom": f"""{_FULL}, {_CANDIDATE}
      SELECT md.page_id, CASE WHEN starts_with(reason, 'best') THEN markdown
        ELSE ({_ARTICLE}) || chr(10) END AS markdown
      FROM md JOIN decided USING (page_id)""",
    "markdown_links_text": f"""{_with(_PARTS)}
      SELECT page_id, {_page(_nav(_LINK_TEXT))} AS markdown FROM parts""",
    "markdown_links_strip": f"""{_with(_PARTS)}
      SELECT page_id, {_page("''")} AS markdown FROM parts""",
    "markdown_documents": f"""{_FULL}
      SELECT page_id, url, 'out/' || CASE WHEN stem = '' THEN 'index' ELSE stem END || '.md'
          AS output_path, markdown
      FROM (SELECT *, regexp_replace(regexp_extract(regexp_extract(
              url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1), '\\.[^.]*$', '') AS stem
            FROM md)""",
    "markdown_derived": f"""{_with(_DOC)}
      SELECT doc_id AS page_id, {_derived(_IMAGE, _LINK, head="''")} FROM d""",
    "markdown_derived_dom": f"""{_with(_DOC, _SCORES, _BEST)}
      SELECT doc_id AS page_id, {_derived(_IMAGE, _LINK, dom=True)} FROM b""",
    "markdown_front_matter": f"""{_with(_DOC, _META)}
      SELECT doc_id AS page_id, {_derived(_IMAGE, _LINK, head=_FRONT)}
      FROM d JOIN (SELECT * EXCLUDE (lang, shell) FROM m) USING (doc_id)""",
    "images_alt": f"""{_with(_DOC)}
      SELECT doc_id AS page_id, {_derived(_IMAGE_ALT, _LINK)} FROM d""",
    "images_strip": f"""{_with(_DOC)}
      SELECT doc_id AS page_id, {_derived("''", "'link ' || doc_id")} FROM d""",
    "code_language": """
      SELECT doc_id AS page_id, 'python' AS language FROM documents
      WHERE doc_id % 9 <> 0 AND doc_id % 7 = 0""",
    "page_stats": f"""{_FULL}
      SELECT page_id, url AS path, length(html)::INT AS html_chars,
        length(markdown)::INT AS markdown_chars,
        len(regexp_extract_all(markdown, '\\[[^\\]]+\\]\\([^)]+\\)'))::INT AS markdown_links
      FROM md""",
    "page_stats_json": f"""{_FULL}
      SELECT page_id, '{{"path":"' || url || '","html_chars":' || length(html)
        || ',"markdown_chars":' || length(markdown) || ',"markdown_links":'
        || len(regexp_extract_all(markdown, '\\[[^\\]]+\\]\\([^)]+\\)')) || '}}' AS line
      FROM md""",
    "extraction_quality": f"""{_with(_PARTS, _CANDIDATE)},
      body AS (SELECT *, {_segments("regexp_replace(" + _VISIBLE + ", '(?s)^.*?<body>', '')")} AS bs
               FROM parts)
      SELECT b.page_id,
        (CASE WHEN e = 'full' OR starts_with(reason, 'best')
              THEN coalesce(list_sum(list_transform(bs, lambda t: length(t))) + len(bs) - 1, 0)
              ELSE text_length END)::BIGINT AS text_length,
        structural_elements::BIGINT AS headings, 0::BIGINT AS code_blocks, 0::BIGINT AS tables,
        0::BIGINT AS images, e AS extractor
      FROM body b JOIN decided USING (page_id), (VALUES ('full'), ('dom')) v(e)""",
    "marker_retention": f"""{_FULL}
      SELECT page_id AS case_id, 4 AS markers,
        (contains(markdown, '</p>')::INT + contains(markdown, '# ')::INT
         + contains(markdown, '](' || origin)::INT
         + contains(markdown, 'page ' || page_id)::INT) / 4 AS marker_retention
      FROM md""",
    "capture_timing": """
      SELECT 'https://example.com/' || event_id AS url, round(value, 6) AS browser_launch_seconds,
        round(user_id / 8, 6) AS navigation_seconds, NULL::VARCHAR AS summary FROM events
      UNION ALL
      SELECT NULL, round(avg(value), 6), round(avg(user_id / 8), 6), 'mean' FROM events""",
}
