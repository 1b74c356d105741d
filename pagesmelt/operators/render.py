"""Clean node rows to Markdown: events, then gaps between atoms, then one text per page.

Every element contributes codes and text at its opening and closing position.  *Atoms* (text,
images, table cells, code blocks) split the page into gaps.  Within a gap all closing markers stand
before all opening ones, so a gap becomes ``closers + separator + openers + atom`` and the
separator follows from the gap's codes alone.  Gaps are rows: codes, markers and texts stay in columns
of their own, and no character of a page can be taken for one of them.  All groups are within a
page, whose partitioning the node rows already have.

Lists, quotes and definitions put a prefix before the lines inside them.  It is a column width, a
running sum over the page, and for quotes the texts that a fold over their ends builds up.

The expressions are written as SQL text: they are long, and parse much faster than they build.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmelt.fixed_values import (
    BULLETS,
    CODE_CLASS,
    CODE_NAME,
    HEADING_TAGS,
    TRIMMED_BLOCKS,
    UNICODE_SPACE,
    VOID_TAGS,
)
from pagesmelt.functions.text import class_tokens, text_trim
from pagesmelt.operators.clean import drop_subtrees
from pagesmelt.operators.nodes import with_closes

# Gap codes.  Opening: ( [ { ask for 2, 1, 0 line breaks, o for a space, < is inline; all trim
# what follows.  Closing: ) ] } c > likewise, trimming what precedes.  2 1 u are line breaks
# without trimming (u adds one), r a <br>, s n white space in text, w a space that stays,
# . anything that keeps neighbouring white space apart.  Every event also says where it stands:
# x in running text, h in a heading, d in a table cell.

_MARKERS = {
    "b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "sub": "", "sup": "",
}
_TICKED = ("code", "kbd", "samp")
_CELLS = ("td", "th")
# Blocks that ask for a blank line on both sides, or a space inside headings and cells.
_PLAIN_BLOCKS = ("p", "div", "article", "section", "dl")
_VANISH_WHEN_EMPTY = (
    *_PLAIN_BLOCKS, *_MARKERS, *_TICKED, "a", "blockquote", "caption", "dd", "dt", "figcaption",
    "li", "ol", "pre", "table", "ul")
_INNER_EDGE = (*TRIMMED_BLOCKS, *HEADING_TAGS)
_OUTER_EDGE = (*_INNER_EDGE, "pre")


def _among(names) -> str:
    return "(" + ", ".join(f"'{name}'" for name in names) + ")"


_IS_HEADING = f"tag IN {_among(HEADING_TAGS)}"
_IS_CELL = f"tag IN {_among(_CELLS)}"
_SIBLINGS = "PARTITION BY page_id, parent"
_RUNNING = "PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING"
_NEAR = "PARTITION BY page_id ORDER BY pos"
_BEFORE = f"{_NEAR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _with(rows: DataFrame, **columns: str) -> DataFrame:
    return rows.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def apply_policies(rows: DataFrame, links: str = "keep", images: str = "keep") -> DataFrame:
    """Keep, unwrap or strip links; keep, replace or strip images."""
    if links == "text":
        rows = rows.where(F.coalesce(F.col("tag") != "a", F.lit(True)))
    elif links == "strip":
        rows = drop_subtrees(rows, (F.col("kind") == "elem") & (F.col("tag") == "a"))
    if images == "strip":
        rows = rows.where(F.coalesce(F.col("tag") != "img", F.lit(True)))
    elif images == "alt":
        image = (F.col("kind") == "elem") & (F.col("tag") == "img")
        rows = rows.withColumns({
            "text": F.when(image, text_trim(F.col("attrs")["alt"])).otherwise(F.col("text")),
            "kind": F.when(image, F.lit("text")).otherwise(F.col("kind")),
            "tag": F.when(~image, F.col("tag"))})
    return rows


def code_language(attrs: Column) -> Column:
    """The language one element declares by class or data attribute, null when none is safe."""
    by_class = F.try_element_at(
        F.filter(
            F.transform(class_tokens(attrs), lambda t: F.regexp_extract(t, CODE_CLASS, 1)),
            lambda name: name != ""),
        F.lit(1))

    def by_data(name: str) -> Column:
        value = text_trim(attrs[name])
        return F.when(value.rlike(CODE_NAME), value)

    return F.coalesce(by_class, by_data("data-language"), by_data("data-lang"))


def _with_siblings(rows: DataFrame) -> DataFrame:
    """What list items and table rows need to know about their siblings."""
    def number(condition: str, frame: str) -> str:
        return f"count_if({condition}) OVER ({_SIBLINGS}{frame})"

    so_far, everywhere = " ORDER BY pre ROWS UNBOUNDED PRECEDING", ""
    # Fixed value: the published converter lays out at most 1000 columns.  Digits beyond any type clamp too.
    span = ("CASE WHEN attrs['colspan'] RLIKE '^[0-9]+$' THEN int(greatest(1, least(1000, "
            "coalesce(try_cast(attrs['colspan'] AS decimal(38, 0)), 1000)))) ELSE 1 END")
    return _with(
        _with(rows, span=f"CASE WHEN {_IS_CELL} THEN {span} END"),
        elem_no=number("kind = 'elem'", so_far),
        li_no=number("tag = 'li'", so_far),
        n_tr=number("tag = 'tr'", everywhere),
        n_thead=number("tag = 'thead'", everywhere),
        n_td=number("tag = 'td'", everywhere),
        n_columns=f"sum(span) OVER ({_SIBLINGS})")


def _events(rows: DataFrame, language: Column | None) -> DataFrame:
    """Opening and closing rows with the depths of the elements that change rendering."""
    code = F.col("tag").isin("pre", "code")
    named = rows.withColumn(
        "language", F.when(code, code_language(F.col("attrs")) if language is None else language))
    events = with_closes(named, ~F.col("tag").isin(*VOID_TAGS))
    events = _with(events, ev=f"""
        CASE WHEN kind <> 'elem' THEN kind WHEN tag IN {_among(VOID_TAGS)} THEN 'void'
             WHEN pos = pre THEN 'open' ELSE 'close' END""")

    def depth(*tags: str) -> str:
        # How many such elements enclose this event, itself left out.
        step = (f"CASE WHEN tag IN {_among(tags)} THEN CASE ev WHEN 'open' THEN 1 "
                "WHEN 'close' THEN -1 END END")
        own = f"CASE WHEN tag IN {_among(tags)} AND ev = 'open' THEN 1 ELSE 0 END"
        return f"coalesce(sum({step}) OVER ({_RUNNING}), 0) - {own}"

    vanishing = f"kind = 'elem' AND NOT has_atom AND tag IN {_among(_VANISH_WHEN_EMPTY)}"
    deep = _with(
        events,
        in_pre=depth("pre"), in_ticked=depth(*_TICKED), in_heading=depth(*HEADING_TAGS),
        in_cell=depth(*_CELLS), in_li=depth("li"), in_ul=depth("ul"),
        _reach=f"max(CASE WHEN {vanishing} THEN post END) OVER ({_RUNNING})")
    # Elements that would print nothing go, with the white space inside them.
    return _with(
        deep.where("coalesce(_reach < pos, true)").drop("_reach"),
        inline="in_heading > 0 OR in_cell > 0",
        verbatim="in_pre > 0 OR in_ticked > 0")


def _with_neighbours(events: DataFrame) -> DataFrame:
    """Previous and next event other than blank text, and white space at block edges removed."""
    facts = ("named_struct('ev', ev, 'tag', tag, 'pre', pre, 'link', link, 'language', language, "
             "'elem_no', elem_no, 'n_thead', n_thead, 'n_td', n_td, 'n_columns', n_columns)")
    space = F.lit(UNICODE_SPACE)
    seen = _with(
        events.withColumn("blank", (F.col("ev") == "text") & (F.btrim("text", space) == "")),
        _fact=f"CASE WHEN NOT blank THEN {facts} END",
        _sibling="CASE WHEN NOT blank AND ev <> 'comment' "
                 "THEN named_struct('ev', ev, 'tag', tag) END")
    linked = _with(
        seen,
        prev=f"lag(_fact) IGNORE NULLS OVER ({_NEAR})",
        next=f"lead(_fact) IGNORE NULLS OVER ({_NEAR})",
        next_code=f"lead(CASE WHEN ev = 'open' AND tag = 'code' THEN struct(pos, language) END) "
                  f"IGNORE NULLS OVER ({_NEAR})",
        next_sibling=f"lead(_sibling) IGNORE NULLS OVER ({_NEAR})")
    inner, outer = _among(_INNER_EDGE), _among(_OUTER_EDGE)
    return _with(
        linked.drop("_fact", "_sibling"),
        trim_left=f"""coalesce((prev.ev IN ('close', 'void') AND prev.tag IN {outer})
                               OR (prev.ev = 'open' AND prev.tag IN {inner}), false)""",
        trim_right=f"""coalesce((next.ev IN ('open', 'void') AND next.tag IN {outer})
                                OR (next.ev = 'close' AND next.tag IN {inner}), false)""",
    ).where("NOT blank OR in_pre > 0 OR NOT (trim_left OR trim_right)")


def _text_fields(events: DataFrame) -> DataFrame:
    """Normalised text, its outer white space as codes, and what links and code ask of it."""
    normal = _with(events, _norm=r"""
        CASE WHEN ev = 'text' AND in_pre = 0 THEN regexp_replace(regexp_replace(
          text, r'(?<![\t \r\n])[\t ]*+[\r\n][\t \r\n]*+', '\n'), r'[\t ]+', ' ') END""")
    normal = _with(
        normal,
        core=r"CASE WHEN inline THEN replace(btrim(_norm, ' \n'), '\n', ' ') "
             r"ELSE btrim(_norm, ' \n') END",
        lead_code=r"CASE WHEN NOT trim_left THEN translate(regexp_extract(_norm, '^([ \n]?)', 1), "
                  r"'\n ', 'ns') ELSE '' END",
        trail_code=r"CASE WHEN NOT trim_right THEN translate("
                   r"CASE WHEN endswith(_norm, '\n') THEN '\n' WHEN endswith(_norm, ' ') THEN ' ' "
                   r"ELSE '' END, '\n ', 'ns') ELSE '' END")
    noted = _with(normal, note="""
        CASE WHEN ev = 'text' THEN named_struct(
          'autolink', coalesce(
            NOT verbatim AND prev.ev = 'open' AND prev.tag = 'a' AND next.ev = 'close'
            AND next.pre = prev.pre AND core = prev.link AND NOT contains(core, '*'), false),
          'ticks', CASE WHEN contains(core, '`') THEN array_max(transform(
            regexp_extract_all(core, '(`+)', 1), run -> length(run))) ELSE 0 END) END""")
    return _with(
        noted,
        note_after=f"lead(note) OVER ({_NEAR})", note_before=f"lag(note) OVER ({_NEAR})")


def _table_rules(events: DataFrame) -> DataFrame:
    """The rule lines above and below a table row, known from its first or last cell."""
    near = _with(events, _cell=f"""
        CASE WHEN tag = 'tr' THEN CASE WHEN ev = 'open' AND next.tag IN {_among(_CELLS)} THEN next
             WHEN ev = 'close' AND prev.tag IN {_among(_CELLS)} THEN prev END END""")
    line = "concat('| ', array_join(array_repeat('{0}', int(coalesce(_cell.n_columns, 0))), ' | '), ' |')"
    return _with(
        _with(near, _head="""
            coalesce(_cell.n_td = 0, true) OR (parent_tag = 'thead' AND n_tr = 1)"""),
        # The body's place in the table is known from the event before its first row.
        overline=f"""
            CASE WHEN tag = 'tr' AND ev = 'open' AND elem_no = 1 AND NOT _head AND (
                   parent_tag <> 'tbody' OR coalesce(prev.ev = 'open' AND prev.tag = 'tbody'
                     AND (prev.elem_no = 1 OR prev.n_thead = 0), false))
                 THEN concat({line.format('')}, '\\n', {line.format('---')}, '\\n')
                 ELSE '' END""",
        underline=f"""
            CASE WHEN tag = 'tr' AND ev = 'close' AND elem_no = 1 AND _head
                 THEN concat('\\n', {line.format('---')}) ELSE '' END""")


def _ordinal(start: str, number: str) -> str:
    """``start``, digits of any length, and ``number - 1`` added, as digits."""
    digits = f"regexp_replace({start}, '^0+(?=[0-9])', '')"
    head, tail = "left(d, length(d) - 18)", f"cast(right(d, 18) AS decimal(38, 0)) + {number} - 1"
    # What the last 18 digits carry over goes past the nines before them.
    carried = f"""
        concat(CASE WHEN {head} RLIKE '^9*$' THEN '1' ELSE concat(
          regexp_extract({head}, '^([0-9]*)[0-8]9*$', 1),
          int(regexp_extract({head}, '([0-8])9*$', 1)) + 1) END,
          repeat('0', length(regexp_extract({head}, '(9*)$', 1))))"""
    return f"""
        transform(array({digits}), d -> CASE
          WHEN length(d) <= 18 THEN string({tail})
          WHEN {tail} < 1000000000000000000BD THEN concat({head}, lpad(string({tail}), 18, '0'))
          ELSE concat({carried}, lpad(string({tail} - 1000000000000000000BD), 18, '0')) END)[0]"""


def _fragments(events: DataFrame) -> DataFrame:
    """Per event: gap codes, closing and opening marker, atom, code after the atom, column step."""
    marks = "CASE tag " + " ".join(
        f"WHEN '{tag}' THEN '{mark}'" for tag, mark in _MARKERS.items()) + " END"
    bullets = f"array({', '.join(repr(b) for b in BULLETS)})"
    facts = _with(
        events,
        _title="CASE WHEN attrs['title'] <> '' "
               "THEN concat(' \"', replace(attrs['title'], '\"', '\\\\\"'), '\"') ELSE '' END",
        _linked="coalesce(tag = 'a' AND NOT verbatim AND link <> '', false)",
        _note="CASE WHEN ev = 'open' THEN note_after ELSE note_before END",
        # A heading whose only image was decorative leaves just its marks.
        _bare=f"coalesce({_IS_HEADING} AND NOT inline AND NOT has_atom, false)",
        _bullet=f"""
            CASE WHEN tag = 'li' THEN CASE WHEN parent_tag = 'ol' THEN concat(
                CASE WHEN list_start RLIKE '^[0-9]+$' THEN {_ordinal('list_start', 'li_no')}
                     ELSE string(li_no) END, '. ')
              ELSE concat({bullets}[int(pmod(in_ul - 1, {len(BULLETS)}))], ' ') END END""")
    facts = _with(
        facts,
        _auto="_linked AND _title = '' AND coalesce(_note.autolink, false)",
        _tick=f"""CASE WHEN tag IN {_among(_TICKED)} THEN named_struct(
                    'mark', repeat('`', coalesce(_note.ticks, 0) + 1),
                    'pad', CASE WHEN _note.ticks > 0 THEN ' ' ELSE '' END) END""")

    def either(opening: str, closing: str) -> str:
        return f"CASE ev WHEN 'open' THEN '{opening}' ELSE '{closing}' END"

    blocks = _among((*_PLAIN_BLOCKS, "blockquote", "dd", "dt"))
    code = f"""
        CASE WHEN ev = 'text' THEN CASE WHEN in_pre > 0 THEN ''
                  WHEN blank AND lead_code = '' THEN 's' ELSE lead_code END
             WHEN ev IN ('comment', 'page') OR in_pre > 0 THEN '.'
             WHEN ev = 'void' THEN CASE tag WHEN 'hr' THEN '(' WHEN 'img' THEN ''
                  WHEN 'br' THEN CASE WHEN inline THEN 'w' ELSE 'r' END ELSE '.' END
             WHEN {_IS_CELL} THEN {either('', '}')}
             WHEN tag = 'tr' THEN CASE WHEN ev = 'open' THEN ''
                  WHEN underline <> '' THEN '}}' ELSE ']' END
             WHEN {_IS_HEADING} THEN CASE WHEN inline THEN '.' WHEN ev = 'open' THEN '('
                  WHEN _bare THEN '.' ELSE ')' END
             WHEN inline AND tag IN {blocks} THEN {either('o', 'c')}
             WHEN tag = 'dt' THEN {either('(', ']')}
             WHEN tag IN {_among((*_PLAIN_BLOCKS, 'figcaption', 'table'))} THEN {either('(', ')')}
             WHEN tag = 'caption' THEN {either('{', ')')}
             WHEN tag = 'pre' THEN {either('(', '')}
             WHEN tag = 'blockquote' THEN {either('[', ')')}
             WHEN tag IN ('li', 'dd') THEN {either('{', ']')}
             WHEN tag IN ('ul', 'ol') THEN CASE
                  WHEN in_li > 0 THEN {either('1', '}')} WHEN ev = 'open' THEN '2'
                  WHEN next_sibling.ev IN ('open', 'void', 'text')
                       AND coalesce(next_sibling.tag NOT IN ('ul', 'ol'), true) THEN 'u'
                  ELSE '.' END
             WHEN verbatim THEN '.'
             WHEN _linked OR tag IN {_among((*_MARKERS, *_TICKED))} THEN {either('<', '>')}
             WHEN tag = 'a' THEN {either('{', '}')}
             ELSE '.' END"""
    opener = f"""
        CASE WHEN ev <> 'open' OR in_pre > 0 THEN NULL
             WHEN {_IS_HEADING} AND NOT inline AND NOT _bare
               THEN concat(repeat('#', int(substring(tag, 2, 1))), ' ')
             WHEN tag = 'li' THEN _bullet
             WHEN tag = 'blockquote' AND NOT inline THEN '> '
             WHEN tag = 'dd' AND NOT inline THEN ':   '
             WHEN verbatim THEN NULL
             WHEN _auto THEN '<'
             WHEN _linked THEN '['
             WHEN tag IN {_among(_TICKED)} THEN concat(_tick.mark, _tick.pad)
             ELSE nullif({marks}, '') END"""
    closer = f"""
        CASE WHEN ev <> 'close' OR verbatim THEN NULL
             WHEN _auto THEN '>'
             WHEN _linked THEN concat('](', link, _title, ')')
             WHEN tag IN {_among(_TICKED)} THEN concat(_tick.pad, _tick.mark)
             ELSE nullif({marks}, '') END"""
    atom = f"""
        CASE WHEN ev = 'text' THEN CASE WHEN in_pre > 0 THEN text WHEN blank THEN NULL
                  WHEN verbatim OR note.autolink THEN core
                  ELSE replace(replace(core, '*', r'\\*'), '_', r'\\_') END
             WHEN ev IN ('comment', 'page') THEN NULL
             WHEN tag = 'img' THEN CASE WHEN inline THEN coalesce(attrs['alt'], '')
                  ELSE concat('![', coalesce(attrs['alt'], ''), '](', coalesce(link, ''), _title,
                              ')') END
             WHEN tag = 'br' THEN CASE WHEN in_pre > 0 THEN '\n' END
             WHEN tag = 'hr' THEN CASE WHEN in_pre = 0 THEN '---' ELSE '\n\n---\n\n' END
             WHEN {_IS_CELL} THEN CASE ev WHEN 'open' THEN ' ' ELSE repeat(' |', span) END
             WHEN tag = 'tr' THEN CASE ev WHEN 'open' THEN concat(overline, '|')
                  ELSE nullif(underline, '') END
             WHEN tag = 'pre' AND in_pre = 0 THEN CASE ev WHEN 'close' THEN '\n```' END
             WHEN tag = 'q' THEN '"'
             WHEN _bare AND ev = 'open' THEN repeat('#', int(substring(tag, 2, 1)))
             WHEN tag = 'video' AND NOT inline AND coalesce(link, attrs['poster'], '') <> '' THEN
               CASE ev WHEN 'open' THEN CASE WHEN coalesce(attrs['poster'], '') = '' THEN '['
                         WHEN coalesce(link, '') = '' THEN '![' ELSE '[![' END
                    ELSE concat(CASE WHEN attrs['poster'] <> ''
                                     THEN concat('](', attrs['poster'], ')') ELSE '' END,
                                CASE WHEN link <> '' THEN concat('](', link, ')') ELSE '' END) END
             END"""
    after = f"""
        CASE WHEN in_pre > 0 THEN ''
             WHEN ev = 'text' THEN CASE WHEN blank THEN '' ELSE trail_code END
             WHEN tag = 'hr' THEN ')'
             WHEN {_IS_CELL} AND ev = 'open' THEN '{{'
             WHEN tag = 'tr' AND ev = 'close' AND underline <> '' THEN ']'
             WHEN tag = 'pre' AND ev = 'close' THEN ')'
             WHEN _bare AND ev = 'open' THEN ')'
             ELSE '' END"""
    # The text of a code block is one atom with its fence, at the block's end.
    fence = """
        CASE WHEN tag = 'pre' AND ev = 'open' AND in_pre = 0 THEN concat('```', coalesce(
          CASE WHEN next_code.pos < post THEN next_code.language END, language, ''), '\n') END"""
    width = """
        CASE WHEN ev NOT IN ('open', 'close') OR inline OR in_pre > 0 THEN NULL
             WHEN tag = 'li' THEN length(_bullet)
             WHEN tag = 'blockquote' THEN 2
             WHEN tag = 'dd' THEN 4 END"""
    return _with(facts, _atom=atom, _width=width).selectExpr(
        "page_id", "pos",
        "CASE WHEN in_heading > 0 THEN 'h' WHEN in_cell > 0 THEN 'd' ELSE 'x' END AS place",
        f"{code} AS code", f"{opener} AS opener", f"{closer} AS closer",
        "CASE WHEN in_pre = 0 THEN CASE WHEN inline THEN replace(_atom, '\n', ' ') ELSE _atom END "
        "END AS atom",
        "CASE WHEN in_pre > 0 THEN _atom END AS verbatim", f"{fence} AS fence", f"{after} AS after",
        "CASE ev WHEN 'open' THEN _width ELSE -_width END AS step",
        "CASE WHEN tag = 'blockquote' AND _width > 0 THEN ev = 'open' END AS quotes")


def _gaps(fragments: DataFrame) -> DataFrame:
    """One row per gap: its codes, markers and atom, and the columns its lines start at."""
    placed = _with(
        fragments,
        gap=f"count(atom) OVER ({_BEFORE})",
        column=f"coalesce(sum(step) OVER ({_BEFORE}), 0)",
        quoted=f"count(quotes) OVER ({_BEFORE})",
        before=f"coalesce(lag(after) OVER ({_NEAR}), '')",
        final=f"lead(pos) OVER ({_NEAR}) IS NULL")
    packed = placed.selectExpr(
        "page_id", "pos", "gap", "atom", "atom IS NOT NULL OR final AS ends",
        "struct(concat(before, code) AS code, closer, opener, verbatim, fence, place) AS event",
        "CASE WHEN opener IS NOT NULL OR atom IS NOT NULL THEN struct(column, quoted) END AS place",
        "CASE WHEN quotes IS NOT NULL THEN struct(pos, quotes, column) END AS quote")
    # A window, as a grouping would sort and merge the rows twice; a gap is a handful of rows.
    whole = ("(PARTITION BY page_id, gap ORDER BY pos "
             "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    gathered = _with(
        packed,
        e=f"collect_list(event) OVER {whole}",
        first=f"first_value(place) IGNORE NULLS OVER {whole}",
        quotes=f"collect_list(quote) OVER {whole}")
    return gathered.where("ends").selectExpr(
        "page_id", "gap", "first", "place AS last", "quotes",
        "array_join(e.closer, '') AS closers", "array_join(e.opener, '') AS openers",
        "array_join(e.code, '') AS codes", "array_join(e.fence, '') AS fence",
        "array_join(e.verbatim, '') AS verbatim", "atom",
        # Where a gap stands is the outermost place it touches.
        "CASE WHEN array_contains(e.place, 'x') THEN 'x' WHEN array_contains(e.place, 'h') THEN 'h' "
        "ELSE 'd' END AS place")


def _separated(gaps: DataFrame) -> DataFrame:
    """Resolve each gap's codes to a number of line breaks and of spaces."""
    # White space of texts that became neighbours is one run of white space.
    gaps = _with(gaps, codes=r"""
        CASE WHEN codes = '' THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(
          codes, '[.]+', '.'), 's*n[sn]*', 'n'), 's+', 's') END""")
    # What the last trimming close leaves, what stands before the first trimming open, and what
    # that open asks for.
    gaps = _with(gaps, items=r"""
        CASE WHEN codes IN ('', '.') THEN '' ELSE translate(concat(
          CASE regexp_extract(codes, r'([)\]}c>])[^)\]}c>]*$', 1)
            WHEN ')' THEN '2' WHEN ']' THEN '1' WHEN 'c' THEN 'w'
            WHEN '>' THEN CASE WHEN codes RLIKE r'[swc][.>]*>[^)\]}c>]*$' THEN 's' ELSE '' END
            ELSE '' END,
          regexp_extract(codes,
            r'(?:^|(?<=[)\]}c>(\[{o<]))([^)\]}c>(\[{o<]*+)(?:[(\[{o<][^)\]}c>]*+)?$', 1),
          CASE regexp_extract(codes, r'^[^(\[{o<]*+([(\[{o<])', 1)
            WHEN '(' THEN '2' WHEN '[' THEN '1' WHEN 'o' THEN 'w'
            WHEN '<' THEN CASE WHEN codes RLIKE r'^[^(\[{o<]*+<[.<]*+[swo]' THEN 's' ELSE '' END
            ELSE '' END), '.', '') END""")
    spaces = "length(regexp_replace(items, '[^sw]', ''))"
    gaps = _with(gaps, breaks=r"""
        CASE WHEN items = '' THEN 0 WHEN contains(items, '2') THEN 2
             ELSE least(2, length(regexp_replace(
               regexp_replace(items, r'(?<=[1nru])[1n]+', ''), '[^1nru]', ''))) END""")
    # A code block has neither blank lines at its start nor white space at its end.
    stripped = (r"regexp_replace(regexp_replace(verbatim, r'\A[ \n]*\n', ''), "
                r"r'(?<![ \n])[ \n]++\z', '')")
    return gaps.selectExpr(
        "page_id", "gap", "first", "last", "quotes", "closers", "openers",
        f"""CASE WHEN items = '' THEN '' WHEN place = 'h' THEN ' '
                 WHEN place = 'd' THEN repeat(' ', breaks + {spaces})
                 WHEN breaks > 0 THEN concat(repeat('\n', breaks), translate(
                   regexp_extract(items, '([sw]*)$', 1), 'sw', '  '))
                 ELSE repeat(' ', {spaces}) END AS separator""",
        f"CASE WHEN fence <> '' THEN concat(fence, {stripped}, atom) ELSE coalesce(atom, '') END "
        "AS atom")


def _joined(gaps: DataFrame) -> DataFrame:
    """One text per page, with the prefixes of lists and quotes after its line breaks."""
    pages = gaps.groupBy("page_id").agg(
        F.expr("sort_array(collect_list(struct(gap, closers, separator, openers, atom, first, last)))"
               ).alias("gaps"),
        F.expr("sort_array(flatten(collect_list(CASE WHEN size(quotes) > 0 THEN quotes END)))"
               ).alias("quotes"))
    # The prefix after each start and end of a quote: filled or cut to its column, and its mark.
    prefixes = """
        aggregate(quotes, array(''), (done, q) -> array_append(done, CASE
          WHEN q.quotes THEN concat(rpad(element_at(done, -1), int(q.column), ' '), '> ')
          ELSE rpad(element_at(done, -1), int(q.column) - 2, ' ') END))"""

    def prefixed(text: str, place: str) -> str:
        prefix = f"rpad(prefixes[int({place}.quoted)], int({place}.column), ' ')"
        return (f"CASE WHEN {place}.column > 0 AND contains({text}, '\n') "
                f"THEN replace({text}, '\n', concat('\n', {prefix})) ELSE {text} END")

    return pages.selectExpr(
        "page_id", "gaps", f"CASE WHEN size(quotes) = 0 THEN array('') ELSE {prefixes} END AS prefixes"
    ).selectExpr("page_id", f"""
        array_join(transform(gaps, g -> concat(
          g.closers, {prefixed('g.separator', 'g.first')}, g.openers,
          {prefixed('g.atom', 'g.last')})), '') AS markdown""")


def tidy_markdown(markdown: Column) -> Column:
    """No trailing blanks, no run of blank lines, one final line break."""
    lines = F.regexp_replace(markdown, r"(?<![ \t])[ \t]++(?=\n|\z)", "")
    return F.concat(
        text_trim(F.regexp_replace(lines, r"\n{3,}", "\n\n")), F.lit("\n"))


def render_markdown(rows: DataFrame, language: Column | None = None) -> DataFrame:
    """``(page_id, markdown)`` for clean node rows that carry ``has_atom``.

    ``language`` replaces the rule that reads a code block's language from its attributes.
    """
    resolved = _with(rows, link="CASE tag WHEN 'a' THEN attrs['href'] WHEN 'img' THEN "
                                "attrs['src'] WHEN 'video' THEN attrs['src'] END")
    events = _with_neighbours(_events(_with_siblings(resolved), language))
    fragments = _fragments(_table_rules(_text_fields(events)))
    pages = _joined(_separated(_gaps(fragments)))
    return pages.select("page_id", tidy_markdown(F.col("markdown")).alias("markdown"))
