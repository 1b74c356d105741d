"""Operator 11: phrases that stand together more often than their parts would, by SETM.

Relations of occurrences are kept sorted by document and position, nested by document: level k holds
where a frequent phrase of k words starts, with its words.  A merge join of a level with itself,
at adjacent positions of one piece, gives the candidates of the next; those are grouped and
counted by Spark over all documents, and the relation is semi-joined with the frequent groups
before it is extended again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pagesmelt.llm.common import per_partition, written

# Separators of pieces, and a phrase's most words.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
MOST_WORDS = 5
#: Fewest occurrences of a candidate, and how many a language reports.
LEAST, TOP = 100, 2_000
#: Bits of the map of frequent groups that is broadcast (8 MB), whatever the corpus.
MAP_BITS = 1 << 26
#: Counts a Python worker holds before it passes them on.
HELD_COUNTS = 120_000
#: Documents whose occurrences are joined and counted at a time.
BATCH_DOCS = 1_024
#: Counted groups a Python worker holds before it passes them on.
HELD_GROUPS = 1 << 19
#: Candidates of three words and more are first counted by place in a table of so many, whatever the
#: corpus, in parts of so many places, up to so many at a place.
FOLD_PLACES, FOLD_PART, FOLD_MOST = 1 << 24, 1 << 12, 127
#: Spark's own bitmaps hold so many bits a row.
_BUCKET_BITS = 1 << 15

_TO_MARK = bytes.maketrans(SEPARATORS, b"." * len(SEPARATORS))


def words_of(text: str) -> list[bytes]:
    """The words of one text, A to Z lowered, with a mark (a full stop) between its pieces."""
    return text.encode().lower().translate(_TO_MARK).replace(b".", b" . ").split()


def word_id(lang: str, word: bytes, seed: int) -> int:
    """A word of a language as a signed number of 64 bits; 0 stands for no word."""
    number = xxh3_64_intdigest(lang.encode() + b"\0" + word, seed)
    return (number or 1) - (1 << 64 if number >> 63 else 0)


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """64 well mixed bits of tuples of numbers, given as columns."""
    x = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ column.view(np.uint64)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def _place(columns: list[np.ndarray], places: int = MAP_BITS) -> np.ndarray:
    """Where tuples stand in the map of frequent groups, or in a table of so many places."""
    return (_mixed(columns) % np.uint64(places)).astype(np.int64)


_Groups = tuple[list[np.ndarray], np.ndarray]


def _distinct(columns: list[np.ndarray], counts: np.ndarray | None = None) -> _Groups:
    """Distinct tuples and how often each stands there, or the sums of their ``counts``."""
    _, first, line = np.unique(_mixed(columns), return_index=True, return_inverse=True)
    found = [column[first] for column in columns]
    if not all(np.array_equal(one[line], column) for one, column in zip(found, columns)):
        # Two tuples of the batch share all 64 bits.
        rows, line = np.unique(np.stack(columns), axis=1, return_inverse=True)
        found, line = list(rows), line.ravel()
    return found, np.bincount(line, counts, len(found[0])).astype(np.int64)


def _merged(held: list[_Groups]) -> _Groups:
    if len(held) == 1:
        return held[0]
    columns = [np.concatenate(one) for one in zip(*(columns for columns, _ in held))]
    return _distinct(columns, np.concatenate([counts for _, counts in held]))


# --- level 1: words -----------------------------------------------------------------------------

def _word_counts(batches: Iterable[dict], seed: int) -> Iterator[dict]:
    counts: dict[str, Counter] = {}

    def listed() -> Iterator[dict]:
        for lang, found in counts.items():
            found.pop(b".", None)
            yield {
                "lang": [lang] * len(found), "word": [word.decode() for word in found],
                "id": [word_id(lang, word, seed) for word in found], "n": list(found.values())}

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["_text"]):
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) >= HELD_COUNTS:
            yield from listed()
            counts = {}
    yield from listed()


def _frequent_words(read: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """Words counted and those frequent, under a seed by which no two words share a number."""
    seed = 0
    while True:
        counted = per_partition(
            read, "lang string, word string, id long, n long",
            lambda batches, seed=seed: _word_counts(batches, seed))
        words = written(counted.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")))
        if words.groupBy("id").count().where("count > 1").isEmpty():
            return words, written(words.where(F.col("n") >= least)), seed
        seed += 1


def _map_of(groups: DataFrame, names: list[str]) -> np.ndarray:
    """A map with the bits of all ``groups`` set; it may show others too, and never grows."""
    place = per_partition(
        groups.select(*names), "place long",
        lambda batches: (
            {"place": _place([np.array(batch[name], np.int64) for name in names]).tolist()}
            for batch in batches), rows=1 << 16)
    # Spark counts bits from 1.
    rows = place.select(F.expr("place + 1").alias("place")).groupBy(
        F.expr("bitmap_bucket_number(place)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for row in rows:
        start = (row["bucket"] - 1) * (_BUCKET_BITS // 8)
        bits[start:start + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _shown(bits: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    at = _place(columns, 8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class _Numbers(dict):
    """Numbers of the words of one language, 0 for those that are not frequent."""

    def of(self, words: list[bytes], number: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
        missing = {word for word in words if word not in self}
        if len(self) + len(missing) > HELD_COUNTS:
            frequent = {word: known for word, known in self.items() if known}
            self.clear()
            if len(frequent) < HELD_COUNTS // 2:
                self.update(frequent)
            missing = {word for word in words if word not in self}
        if missing:
            missing.discard(b".")
            self.update(zip(missing, number(list(missing)).tolist()))
            self[b"."] = 0
        return np.array([self[word] for word in words], np.int64)


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    """Lists of the given lengths, empty ones left out."""
    ends = np.concatenate([[0], np.cumsum(lengths[lengths > 0])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _occurrences(batches: Iterable[dict], bits, seed: int) -> Iterator[dict]:
    """Level 1: by document, the positions and numbers of words that may be frequent."""
    known: dict[str, _Numbers] = {}

    def number(lang: str, words: list[bytes]) -> np.ndarray:
        ids = np.array([word_id(lang, word, seed) for word in words], np.int64)
        return np.where(_shown(bits.value, [ids]), ids, 0)

    for batch in batches:
        places, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lang, text in zip(batch["lang"], batch["_text"]):
            found = known.setdefault(lang, _Numbers()).of(
                words_of(text), lambda words, lang=lang: number(lang, words))
            places.append(np.flatnonzero(found))
            ids.append(found[places[-1]])
        lengths = np.array([len(one) for one in places[1:]], np.int64)
        yield {"at": _lists(lengths, np.concatenate(places)),
               "w1": _lists(lengths, np.concatenate(ids))}


# --- levels 2 and up ----------------------------------------------------------------------------

def _extended(batch: pa.RecordBatch, level: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Merge join of a relation of ``level`` words with itself: a phrase, and the one a word on.

    Rows are lists by document, sorted by position; the result names its document's row.
    """
    at, *words = (batch.column(name).flatten().to_numpy() for name in (
        "at", *_names(level)))
    document = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("at").offsets.to_numpy()))
    follows = np.flatnonzero((at[1:] == at[:-1] + 1) & (document[1:] == document[:-1]))
    return (document[follows], at[follows],
            [one[follows] for one in words] + [words[-1][follows + 1]])


def _names(level: int) -> list[str]:
    return [f"w{k}" for k in range(1, level + 1)]


def _folded(batches: Iterable[pa.RecordBatch], level: int, most: int) -> Iterator[dict]:
    """Occurrences of candidates of ``level`` words by place, ``most`` at most, in parts of the table."""
    held = np.zeros(FOLD_PLACES, np.uint8)
    for batch in batches:
        _, _, words = _extended(batch, level - 1)
        place, many = np.unique(_place(words, FOLD_PLACES), return_counts=True)
        held[place] = np.minimum(held[place] + many, most)
    place = np.flatnonzero(held)
    part, lengths = np.unique(place // FOLD_PART, return_counts=True)
    if len(part):
        yield {"part": part, "place": _lists(lengths, (place % FOLD_PART).astype(np.int16)),
               "n": _lists(lengths, held[place].astype(np.int8))}


def _may_reach(relation: DataFrame, level: int, least: int) -> np.ndarray:
    """A map of the places at which candidates of ``level`` words occur ``least`` times together.

    A candidate with as many has its place shown, as it alone reaches them there; it may show others too.
    What a task has above ``FOLD_MOST`` need not be known: one such count is enough.
    """
    most = min(least, FOLD_MOST)

    def summed(table: pa.Table) -> pa.Table:
        place, n = (table.column(name).combine_chunks().flatten().to_numpy() for name in ("place", "n"))
        reached = np.bincount(place, n, FOLD_PART) >= most
        return pa.table({
            "part": table.column("part")[:1],
            "bits": pa.array([np.packbits(reached, bitorder="little").tobytes()], pa.binary())
        }).slice(0, int(reached.any()))

    rows = per_partition(
        relation, "part long, place array<smallint>, n array<tinyint>",
        lambda batches: _folded(batches, level, most), rows=BATCH_DOCS, columns=True,
    ).groupBy("part").applyInArrow(summed, "part long, bits binary").collect()
    bits = np.zeros(FOLD_PLACES // 8, np.uint8)
    for row in rows:
        start = row["part"] * (FOLD_PART // 8)
        bits[start:start + FOLD_PART // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _group_counts(batches: Iterable[pa.RecordBatch], level: int, may_reach=None) -> Iterator[dict]:
    """Candidates of ``level`` words over a relation one level below, counted.

    Those that the map ``may_reach`` does not show are left out.  A task sums what it finds for as long
    as that shortens it, so that a group leaves it once or a few times.
    """
    held: list[_Groups] = []
    for batch in batches:
        _, _, words = _extended(batch, level - 1)
        if may_reach is not None:
            shown = _shown(may_reach.value, words)
            words = [one[shown] for one in words]
        if len(words[0]):
            held.append(_distinct(words))
        if sum(len(counts) for _, counts in held) >= HELD_GROUPS:
            held = [_merged(held)]
            if len(held[0][1]) >= HELD_GROUPS // 2:
                yield dict(zip(_names(level), held[0][0])) | {"n": held[0][1]}
                held = []
    if held:
        columns, counts = _merged(held)
        yield dict(zip(_names(level), columns)) | {"n": counts}


def _kept(batches: Iterable[pa.RecordBatch], level: int, bits) -> Iterator[dict]:
    """The relation of ``level`` words, semi-joined with the map of frequent groups."""
    for batch in batches:
        document, at, words = _extended(batch, level - 1)
        if not len(at):
            continue
        shown = _shown(bits.value, words)
        lengths = np.bincount(document[shown], minlength=batch.num_rows)
        yield {name: _lists(lengths, column[shown])
               for name, column in zip(("at", *_names(level)), (at, *words))}


def _levels(read: DataFrame, least: int, most_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """Word counts, and by length the frequent phrases as ``w1..wk, n``."""
    spark = read.sparkSession
    words, frequent, seed = _frequent_words(read, least)
    groups = [frequent.selectExpr("id AS w1", "n")]
    relation = None
    for level in range(1, most_words):
        bits = spark.sparkContext.broadcast(_map_of(groups[-1], _names(level)))
        columns = "at array<int>, " + ", ".join(f"{name} array<long>" for name in _names(level))
        if relation is None:
            relation = written(per_partition(
                read, columns, lambda batches, bits=bits: _occurrences(batches, bits, seed)))
        else:
            relation = written(per_partition(
                relation, columns, lambda batches, level=level, bits=bits: _kept(
                    batches, level, bits), rows=BATCH_DOCS, columns=True))
        # Pairs are many more than places; of longer candidates most are too rare to be worth moving.
        reach = None if level == 1 else spark.sparkContext.broadcast(
            _may_reach(relation, level + 1, least))
        counted = per_partition(
            relation, ", ".join(f"{name} long" for name in _names(level + 1)) + ", n long",
            lambda batches, level=level + 1, reach=reach: _group_counts(batches, level, reach),
            rows=BATCH_DOCS, columns=True)
        groups.append(written(counted.groupBy(*_names(level + 1)).agg(
            F.sum("n").alias("n")).where(F.col("n") >= least)))
    return words, groups


# --- scores -------------------------------------------------------------------------------------

def _scored(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds ``l``, ``r`` and the product of the lowest-scoring cut.

    ``a * n`` is the same for all cuts of a candidate, so the lowest score is that of the largest
    product; but floors may tie, and then the first cut counts, so scores are compared.
    """
    cuts = candidates.select("phrase", "a", "n", F.explode(F.expr(
        "flatten(transform(sequence(1, size(phrase) - 1), k -> array("
        "struct(k AS cut, 'l' AS side, slice(phrase, 1, k) AS part), "
        "struct(k AS cut, 'r' AS side, slice(phrase, k + 1, size(phrase)) AS part))))")).alias("c")
    ).select("phrase", "a", "n", "c.*")
    counts = parts.selectExpr("phrase AS part", "a AS count")
    both = cuts.join(counts, "part").groupBy("phrase", "a", "n", "cut").agg(
        F.max(F.expr("CASE WHEN side = 'l' THEN count END")).alias("l"),
        F.max(F.expr("CASE WHEN side = 'r' THEN count END")).alias("r"))
    # Both products have at most 38 digits: 1000 a and n, l and r have 19 each.
    score = ("cast(1000 * a AS decimal(19, 0)) * cast(n AS decimal(19, 0)) "
             "div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    return both.groupBy("phrase", "a", "n").agg(F.min(F.struct(
        F.expr(score).alias("score"), "cut", "l", "r")).alias("best")).selectExpr(
        "phrase", "a", "n", "best.l", "best.r", "best.score")


def mine_phrases(
    docs: DataFrame, least: int = LEAST, top: int = TOP, most_words: int = MOST_WORDS,
    text_column: str = "text",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the strongest phrases of every language.

    Texts are lowered (A to Z), cut to pieces at ``.,;:!?`` and line ends, and to words at blanks and
    tabs.  ``n`` is a language's words, ``a`` a phrase's occurrences inside pieces, overlaps included.
    Candidates have 2 to ``most_words`` words and ``least`` occurrences; cut after some first
    words they score ``floor(1000 a n / (l r))``, and the lowest cut counts, the first among equals.
    Those inside a longer candidate that occurs as often are left out.

    Null texts read as empty, null languages as ``und``.  Repeated rows count as often as they stand.
    Very long texts are counted whole.  Ties of score and ``a`` go by the phrase's UTF-8 bytes.  An
    empty table gives no rows; other columns are not read.

    All counts are exact.  Only counts are shuffled, summed per batch before; a word or phrase with
    a third of all occurrences is a few rows a task.  The broadcast map of frequent groups has a
    fixed size; where it is too small it lets through more occurrences, whose groups
    the next count drops, and nothing else.  So has the table by which candidates of three words and
    more are counted before their words are moved.
    """
    read = docs.selectExpr(
        "coalesce(lang, 'und') AS lang", f"coalesce(`{text_column}`, '') AS _text")
    words, groups = _levels(read, least, most_words)
    parts = written(reduce(DataFrame.union, (
        group.select(F.array(*(c for c in group.columns if c != "n")).alias("phrase"),
                     F.col("n").alias("a"))
        for group in groups)))
    lang_of = words.selectExpr("lang", "word", "id")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    long = parts.where("size(phrase) > 1")
    # A phrase with as frequent a longer one has one that is a single word longer.
    inside = long.where("size(phrase) > 2").select("a", F.explode(F.expr(
        "array(slice(phrase, 1, size(phrase) - 1), slice(phrase, 2, size(phrase) - 1))")).alias(
        "phrase")).distinct()
    candidates = long.join(inside, ["phrase", "a"], "left_anti").join(
        lang_of.select(F.col("id").alias("_first"), "lang"),
        F.col("phrase")[0] == F.col("_first")).join(totals, "lang").select(
        "lang", "phrase", "a", "n")
    scored = _scored(candidates.drop("lang"), parts)
    spelled = scored.select(
        "*", F.posexplode("phrase").alias("place", "id")).join(lang_of, "id").groupBy(
        "phrase", "a", "n", "l", "r", "score", "lang").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(place, word))), "
               "w -> w.word), ' ')").alias("spelled"))
    return spelled.selectExpr(
        "lang", "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, spelled) AS _rank",
        "spelled AS phrase", "a", "l", "r", "n", "score").where(F.col("_rank") <= top).selectExpr(
        "lang", "cast(_rank AS long) AS rank", "phrase", "a", "l", "r", "n", "score")
