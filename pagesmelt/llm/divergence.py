"""Operator 12: how far the sources of a language stand from each other, term by term.

A table of 256 bytes lowers letters and turns every separator into a blank in one pass, so that
splitting the bytes gives the terms.  Counts leave Python summed over many texts; the audit itself is
sparse: terms a pair of sources lacks alike are never listed, their share follows from a formula.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmelt.llm.common import per_partition, written

# Term characters, the pseudo-count, the unit of a share, and the ranks reported.
SMOOTHING = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
#: Fewest documents of a language a kept term stands in.
LEAST_DOCS = 30
#: Counts a Python worker holds before it passes them on.
HELD_COUNTS = 300_000
#: About so many sources and terms meet in one block of pairs.
SOURCES_A_BLOCK, TERMS_A_BLOCK = 64, 4_096


def _place(byte: int) -> int:
    if 65 <= byte <= 90:
        return byte + 32
    return byte if 97 <= byte <= 122 or byte >= 128 else 32


TERM_BYTES = bytes(map(_place, range(256)))


def term_frequencies(text: str) -> Counter:
    """How often each term, as UTF-8, stands in one text."""
    return Counter(text.encode().translate(TERM_BYTES).split())


def _summed(batches: Iterable[dict]) -> Iterator[dict]:
    """Occurrences and documents of each term, by language and source, over many texts."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0
    for batch in batches:
        for text, *group in zip(batch["_text"], batch["lang"], batch["source"]):
            found = term_frequencies(text)
            summed = counts.setdefault(tuple(group), Counter())
            before = len(summed)
            summed.update(found)
            docs.setdefault(tuple(group), Counter()).update(found.keys())
            held += len(summed) - before
        if held >= HELD_COUNTS:
            yield from _listed(counts, docs)
            counts, docs, held = {}, {}, 0
    yield from _listed(counts, docs)


def _listed(counts: dict, docs: dict) -> Iterator[dict]:
    for (lang, source), found in counts.items():
        seen = docs[lang, source]
        yield {
            "lang": [lang] * len(found), "source": [source] * len(found),
            "term": [term.decode() for term in found], "n": list(found.values()),
            "docs": [seen[term] for term in found]}


def term_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, exact, one row each.

    Nulls in any of the three columns read as empty; other columns are not read.
    """
    read = docs.select(*(
        F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(alias)
        for name, alias in (("lang", "lang"), ("source", "source"), (text_column, "_text"))))
    found = per_partition(
        read, "lang string, source string, term string, n long, docs long", _summed)
    return found.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> Column:
    """``1 + floor(UNIT * (count + 5) / (total + 5 * V))``, exact; 0 where there is no term."""
    return F.expr(f"""
        CASE WHEN kept_terms = 0 THEN 0 ELSE 1 + (
          cast({UNIT} AS decimal(10, 0)) * cast({count} + {SMOOTHING} AS decimal(20, 0))
          div cast({total} + {SMOOTHING} * kept_terms AS decimal(20, 0))) END""")


def _distances(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block of terms, for each pair of sources of two blocks of sources.

    A row without a term names a source and its share of unseen terms.  Terms no row has add to a
    pair what its two shares of unseen terms differ by; that part is left out here.
    """
    named = rows[rows["term"].isna()]
    sources, unseen = named["source"].to_numpy(), named["p"].to_numpy(np.int64)
    seen = rows[rows["term"].notna()]
    terms, column = np.unique(seen["term"].to_numpy(), return_inverse=True)
    line = pd.Index(sources).get_indexer(seen["source"])
    shares = np.repeat(unseen[:, None], len(terms), axis=1)
    shares[line, column] = seen["p"].to_numpy(np.int64)
    low, high = group[2], group[3]
    block = named["block"].to_numpy()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out = []
    for k in left:
        others = right[right != k]
        apart = np.abs(shares[others] - shares[k]).sum(axis=1)
        apart -= len(terms) * np.abs(unseen[others] - unseen[k])
        out.append(pd.DataFrame({"source": sources[k], "item": sources[others], "extra": apart}))
        if low != high:
            out.append(pd.DataFrame({"source": sources[others], "item": sources[k], "extra": apart}))
    found = pd.concat(out) if out else pd.DataFrame({"source": [], "item": [], "extra": []})
    found["extra"] = found["extra"].astype("int64")
    return found.assign(lang=group[0])[["lang", "source", "item", "extra"]]


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language.

    Rows are dealt by blocks of terms and of pairs of sources, so that a task's share of the
    comparison is bounded however many sources or terms a language has.
    """
    blocks = "int(ceil(sources / {0}))".format(SOURCES_A_BLOCK)
    parts = "int(greatest(1, ceil(kept_terms / {0})))".format(TERMS_A_BLOCK)
    own = f"int(pmod(xxhash64(source), {blocks}))"
    named = groups.selectExpr(
        "lang", "source", "string(NULL) AS term", "unseen AS p", f"{own} AS block",
        f"{blocks} AS blocks", f"explode(sequence(0, {parts} - 1)) AS part")
    counted = rows.selectExpr(
        "lang", "source", "term", "p", f"{own} AS block", f"{blocks} AS blocks",
        f"int(pmod(xxhash64(term), {parts})) AS part")
    dealt = named.union(counted).selectExpr(
        "*", "explode(sequence(0, blocks - 1)) AS other").selectExpr(
        "lang", "source", "term", "p", "block", "part",
        "least(block, other) AS low", "greatest(block, other) AS high")
    extra = dealt.groupBy("lang", "part", "low", "high").applyInPandas(
        _distances, "lang string, source string, item string, extra long")
    unseen = groups.select("lang", "source", "unseen", "kept_terms")
    item = unseen.selectExpr("lang", "source AS item", "unseen AS item_unseen")
    return (
        extra.groupBy("lang", "source", "item").agg(F.sum("extra").alias("extra"))
        .join(unseen, ["lang", "source"]).join(item, ["lang", "item"])
        .selectExpr("lang", "source", "item",
                    "kept_terms * abs(unseen - item_unseen) + extra AS value"))


def audit_sources(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS,
    text_column: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets a source apart, in exact integers.

    Terms are runs of letters, A to Z lowered; each language keeps those in ``least_docs`` of its
    documents or more.  A group (language and source) gives each kept term the share
    ``1 + floor(10^9 (count + 5) / (N + 5 V))``; ``N`` and ``V`` are the group's occurrences of kept
    terms and their number.  Part ``pair`` lists the language's other sources by the
    sum of the differences of shares over all kept terms; part ``term`` the first ``top_terms`` terms
    whose share exceeds the language's.  Ranks go by value descending, then item by UTF-8.

    Null text, language and source read as empty, and form groups like others; groups without terms
    still have pairs; without kept terms all values are 0.  Repeated rows count as often as they
    stand.  Texts of any length are counted whole.  Ties are ordered by item.  An empty table gives
    no rows.  Columns beside ``lang``, ``source`` and the text are not read.

    Counts are summed in Python before they are shuffled by term, so a source or word that holds
    a third of all rows is a few rows a task.
    """
    counts = written(term_counts(docs, text_column))
    kept = written(counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
        .where(F.col("docs") >= least_docs).drop("docs"))
    rows = written(counts.drop("docs").join(kept, ["lang", "term"]))
    every = docs.select(*(
        F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("lang", "source"))).distinct()
    langs = every.groupBy("lang").agg(F.count("*").alias("sources")).join(
        kept.groupBy("lang").agg(
            F.count("*").alias("kept_terms"), F.sum("lang_n").alias("lang_total")),
        "lang", "left").na.fill(0, ["kept_terms", "lang_total"])
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(
        every.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
        .withColumn("unseen", _share("0", "total")))
    shares = rows.join(groups, ["lang", "source"]).withColumns({
        "p": _share("n", "total"), "q": _share("lang_n", "lang_total")})
    order = "PARTITION BY lang, source ORDER BY value DESC, item"
    terms = shares.where("p > q").selectExpr("lang", "source", "term AS item", "p - q AS value")
    ranked = [
        found.selectExpr(
            "lang", "source", f"'{part}' AS part", "item", "value",
            f"row_number() OVER ({order}) AS rank")
        for part, found in (("pair", _pairs(shares, groups)), ("term", terms))]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top_terms))
