"""Boilerplate-aware extraction: the published readability heuristic as groupings and windows.

Paragraphs credit their parent fully and their grandparent by half; class and tag weights and
link density adjust the credit; the best element is joined by those of its siblings that look
like content.  Pages are judged twice, with and without the elements whose names make them
unlikely, and the stricter result counts when it is long enough.

Inside the article, forms, poor headings and blocks that look like navigation are cut out again, by
the statistics of their whole subtree.  One pass judges all of them; an inner block that goes is still
part of what its outer block is judged by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesmelt.fixed_values import (
    HEADING_TAGS,
    READABILITY_BLOCK_TAGS,
    READABILITY_CLASS_WEIGHT,
    READABILITY_FORM_TAGS,
    READABILITY_MAYBE,
    READABILITY_MIN_ARTICLE,
    READABILITY_MIN_PARAGRAPH,
    READABILITY_NEGATIVE,
    READABILITY_PARAGRAPH_TAGS,
    READABILITY_POSITIVE,
    READABILITY_TAG_POINTS,
    READABILITY_UNLIKELY,
    STRUCTURE_TAGS,
)
from pagesmelt.operators.candidates import running_totals, subtree_totals, with_features
from pagesmelt.operators.clean import in_marked_subtree
from pagesmelt.operators.nodes import is_run, with_closes

_KEYS = ("page_id", "strict")
_BLOCK_TAGS = ("a", "blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul")


def _among(names) -> str:
    return "(" + ", ".join(f"'{name}'" for name in names) + ")"


def _weight(name: str) -> str:
    return (f"CASE WHEN {name} RLIKE r'{READABILITY_NEGATIVE}' THEN -{READABILITY_CLASS_WEIGHT} "
            f"ELSE 0 END + CASE WHEN {name} RLIKE r'{READABILITY_POSITIVE}' "
            f"THEN {READABILITY_CLASS_WEIGHT} ELSE 0 END")


def _elements(rows: DataFrame) -> DataFrame:
    """Every element, in the strict and the lenient reading, with its subtree totals."""
    names = rows.withColumns({
        "_class": F.expr("coalesce(attrs['class'], '')"),
        "_id": F.expr("coalesce(attrs['id'], '')")})
    unlikely = F.expr(
        f"kind = 'elem' AND size(attrs) > 0 AND tag NOT IN ('html', 'body') "
        f"AND concat(_class, ' ', _id) RLIKE r'{READABILITY_UNLIKELY}' "
        f"AND NOT concat(_class, ' ', _id) RLIKE r'{READABILITY_MAYBE}'")
    twice = names.withColumn("_unlikely", in_marked_subtree(unlikely)).withColumn(
        "strict", F.expr("explode(CASE WHEN _unlikely THEN array(false) "
                         "ELSE array(true, false) END)"))
    points = "CASE " + " ".join(
        f"WHEN tag IN {_among(tags)} THEN {value}" for value, tags in
        READABILITY_TAG_POINTS.items()) + " ELSE 0 END"
    weighed = twice.withColumn("base", F.expr(
        f"CASE WHEN kind = 'elem' THEN {points} + {_weight('_class')} + {_weight('_id')} END"),
    ).withColumn("weight", F.expr(f"CASE WHEN kind = 'elem' THEN base - ({points}) END"))
    events = with_closes(weighed, F.lit(True))
    frame = f"(PARTITION BY {', '.join(_KEYS)} ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    run = F.when(is_run(), F.col("text"))
    totals = running_totals(events, _KEYS).withColumn("_run", run).withColumns({
        "t_commas": F.expr(f"coalesce(sum(regexp_count(_run, ',')) OVER {frame}, 0)"),
        "t_sentences": F.expr(f"count_if(_run RLIKE r'[.](?: |$)') OVER {frame}"),
        "t_blocks": F.expr(f"count_if(pos = pre AND tag IN {_among(_BLOCK_TAGS)}) OVER {frame}"),
        "t_images": F.expr(f"count_if(pos = pre AND tag = 'img') OVER {frame}"),
        "t_items": F.expr(f"count_if(pos = pre AND tag = 'li') OVER {frame}"),
        "t_inputs": F.expr(f"count_if(pos = pre AND tag = 'input' "
                           f"AND coalesce(attrs['type'] <> 'hidden', true)) OVER {frame}"),
        "t_embeds": F.expr(f"count_if(pos = pre AND tag = 'embed') OVER {frame}")})
    grouped = subtree_totals(
        totals.where(F.col("kind") == "elem"), "tag", "parent", "grandparent", "base", "weight",
        keys=_KEYS, more=("t_commas", "t_sentences", "t_blocks", "t_images", "t_items", "t_inputs",
                          "t_embeds"))
    chars = "greatest(t_chars + t_runs - 1, 0)"
    return grouped.withColumns({
        "length": F.expr(chars),
        "density": F.expr(f"CASE WHEN t_chars > 0 THEN t_link_chars / ({chars}) ELSE 0D END"),
        # A <div> that holds text but no block is a paragraph in all but name.
        "reads_as_p": F.expr("tag = 'p' OR (tag = 'div' AND t_blocks = 0)")})


def _scored(elements: DataFrame) -> DataFrame:
    """Elements with ``content_score``, null for those no paragraph credits."""
    tags = _among(READABILITY_PARAGRAPH_TAGS)
    credit = "2 + t_commas + least(length / 100, 3)"
    own = "struct(" + ", ".join(
        name for name in elements.columns if name not in (*_KEYS, "pre")) + ")"
    def row(target: str, carried: str, amount: str) -> str:
        return (f"named_struct('pre', {target}, 'own', {carried}, "
                f"'credit', CAST({amount} AS double))")

    itself, nothing = row("pre", "own", "NULL"), "CASE WHEN pre < 0 THEN own END"
    spread = elements.withColumn("own", F.expr(own)).selectExpr(*_KEYS, f"""
        inline(CASE WHEN (reads_as_p OR tag IN {tags}) AND length >= {READABILITY_MIN_PARAGRAPH}
          THEN array({itself}, {row('parent', nothing, credit)},
                     {row('grandparent', nothing, f'({credit}) / 2')})
          ELSE array({itself}) END)""")
    return (
        spread.groupBy(*_KEYS, "pre")
        .agg(F.max("own").alias("own"), F.sum("credit").alias("credit"))
        .where("own IS NOT NULL")
        .selectExpr(*_KEYS, "pre", "own.*",
                    "(own.base + credit) * (1 - own.density) AS content_score"))


# What goes from inside an article, as the published heuristic has it: its limits, in its order.
_POOR = f"""
    CASE WHEN tag IN {_among(READABILITY_FORM_TAGS)} THEN true
         WHEN tag IN {_among(HEADING_TAGS)} THEN weight < 0 OR density > 0.33
         WHEN tag NOT IN {_among(READABILITY_BLOCK_TAGS)} THEN false
         WHEN weight + coalesce(content_score, 0) < 0 THEN true
         WHEN t_commas >= 10 THEN false
         WHEN t_paragraphs > 0 AND t_images > 1 + t_paragraphs * 1.3 THEN true
         WHEN t_items - 100 > t_paragraphs AND tag <> 'ul' THEN true
         WHEN t_inputs > t_paragraphs / 3 THEN true
         WHEN length < {READABILITY_MIN_PARAGRAPH} AND (t_images = 0 OR t_images > 2) THEN true
         WHEN density > CASE WHEN weight < {READABILITY_CLASS_WEIGHT} THEN 0.2 ELSE 0.5 END THEN true
         ELSE (t_embeds = 1 AND length < 75) OR t_embeds > 1 END"""


def readability_choice(rows: DataFrame) -> DataFrame:
    """``own``, the article's features; ``own_roots`` and ``own_cuts``, where it stands and what it lost.

    Features count what is left after cutting.
    """
    best = (f"first_value(CASE WHEN content_score IS NOT NULL THEN "
            f"struct(content_score, pre, parent) END) OVER (PARTITION BY {', '.join(_KEYS)} "
            "ORDER BY content_score DESC NULLS LAST, pre "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    judged = _scored(_elements(rows)).withColumn("best", F.expr(best))
    # Without any scored element the article is the body.
    taken = """
        coalesce(CASE WHEN best IS NULL THEN tag = 'body'
             WHEN pre = best.pre THEN true
             WHEN parent <> best.parent THEN false
             WHEN content_score >= greatest(10, best.content_score * 0.2) THEN true
             WHEN NOT reads_as_p THEN false
             WHEN length > 80 THEN density < 0.25
             ELSE density = 0 AND t_sentences > 0 END, false)"""
    so_far = f"(PARTITION BY {', '.join(_KEYS)} ORDER BY pre ROWS UNBOUNDED PRECEDING)"
    placed = judged.withColumn("taken", F.expr(taken)).withColumn(
        "cut", F.expr(f"NOT taken AND coalesce(max(CASE WHEN taken THEN post END) OVER {so_far} > pre, "
                      f"false) AND {_POOR}"))
    # Of blocks in blocks only the outermost is a cut.
    before = so_far.replace("UNBOUNDED PRECEDING", "BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    parts = placed.withColumn(
        "sign", F.expr(f"CASE WHEN taken THEN 1 WHEN cut AND coalesce(max(CASE WHEN cut THEN post END) "
                       f"OVER {before} < pre, true) THEN -1 END")).where("sign IS NOT NULL")
    own = {"t_paragraphs": "int(tag = 'p')", "t_structure": f"int(tag IN {_among(STRUCTURE_TAGS)})"}
    articles = parts.groupBy(*_KEYS).agg(
        *(F.expr(f"sum(sign * ({name} + {own.get(name, '0')}))").alias(name) for name in (
            "t_chars", "t_runs", "t_link_chars", "t_paragraphs", "t_punctuation", "t_structure")),
        F.sort_array(F.collect_list(F.when(F.col("taken"), F.col("pre")))).alias("own_roots"),
        F.sort_array(F.collect_list(F.when(~F.col("taken"), F.col("pre")))).alias("own_cuts"))
    featured = with_features(articles).withColumn("own", F.expr(
        "struct('readability' AS selector, score, text_length, paragraphs, link_density, "
        "punctuation, structural_elements)"))
    return featured.groupBy("page_id").agg(F.max_by(
        F.struct("own", "own_roots", "own_cuts"),
        F.when(F.col("strict"), F.when(F.col("text_length") >= READABILITY_MIN_ARTICLE, 2)
               .otherwise(0)).otherwise(1)).alias("pick")).select(
        "page_id", "pick.own", "pick.own_roots", "pick.own_cuts")
