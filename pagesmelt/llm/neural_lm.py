"""Operator 3: texts scored by a log-bilinear model trained by noise-contrastive estimation.

The score of a word class after another is a product of two learned vectors plus a bias.  Classes
are the most frequent words, the end of a text, and one for all other words; inside that class a
word has its smoothed share.  Training needs no more than the counts of class pairs, which Spark
gathers from every training text, so the expected noise-contrastive objective is climbed exactly, in
numpy, on matrices of a fixed size.  One matrix product then normalises all contexts.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmelt.llm import common
from pagesmelt.llm.common import per_batch, written

#: Word classes with the end of a text and the class of other words; vector length; noise ratio.
CLASSES, LENGTH, NOISE = 1024, 32, 16
STEPS, RATE = 150, 0.05
#: Most frequent words whose counts every task has at hand, and the longest of them in bytes.  The counts
#: of all others are joined.
HEAD_WORDS, HEAD_BYTES = 250_000, 64
#: Stands for the end of a text; no word holds white space.
END = "\n"
SMOOTHING = 0.1


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower().split()


def held_out(id_column: str = "_id") -> Column:
    """Whether a row is kept from training: by the CRC of its id (null: as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over all texts, with the end of each; batches are summed before the shuffle."""
    def work(batch: dict) -> dict:
        counts = Counter(chain.from_iterable(words_of(text) for text in batch["_text"]))
        counts[END.encode()] = len(batch["_text"])
        return {"word": list(counts), "c": list(counts.values())}

    return per_batch(docs.select("_text"), "word string, c long", work).groupBy("word").agg(
        F.sum("c").alias("c"))


class Vocabulary:
    """The head of the word counts; the first ``CLASSES - 2`` words are classes of their own."""

    def __init__(self, head: list[tuple[str, int]], total: int, distinct: int, end: int):
        self.total, self.distinct = total, distinct
        self.rank = {word.encode(): place for place, (word, _) in enumerate(head)}
        counts = np.array([count for _, count in head], dtype=np.float64)
        own = min(len(head), CLASSES - 2)
        self.other, self.end = own, own + 1
        #: log10(c + 0.1) by rank, 0 for words without rank
        self.log_count = np.log10(np.append(counts, 1 - SMOOTHING) + SMOOTHING)
        self.class_of = np.minimum(np.arange(len(head) + 1), own)
        self.end_log_count = math.log10(end + SMOOTHING)
        self.log_all = math.log10(max(total + SMOOTHING * (distinct + 1), SMOOTHING))
        rest, kinds = total - end - counts[:own].sum(), distinct - own - (end > 0)
        self.log_other = math.log10(max(rest + SMOOTHING * (kinds + 1), SMOOTHING))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word; the one past the last for words without."""
        none = len(self.rank)
        return np.fromiter(
            map(self.rank.get, words, [none] * len(words)), dtype=np.int64, count=len(words))

    def steps(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes before and at each token; a text begins after an end."""
        classes = self.class_of[ranks]
        return np.append(self.end, classes), np.append(classes, self.end)


def count_pairs(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each class follows each: from all texts, a matrix of a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch: dict) -> dict:
        known, size = sent.value, sent.value.end + 1
        found = [np.empty(0, dtype=np.int64)]
        for text in batch["_text"]:
            before, at = known.steps(known.ranks(words_of(text)))
            found.append(before * size + at)
        pairs, counts = np.unique(np.concatenate(found), return_counts=True)
        return {"pair": pairs, "n": counts}

    rows = per_batch(docs.select("_text"), "pair long, n long", work).groupBy("pair").agg(
        F.sum("n").alias("n")).toArrow()
    size = vocabulary.end + 1
    pairs = np.zeros(size * size)
    pairs[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return pairs.reshape(size, size)


def train(pairs: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Log-probabilities (natural) of each class after each, from a noise-contrastive fit.

    The noise is the class distribution; its expected part of the objective is taken in full.  Adam
    steps on context vectors, a map between the two spaces, target vectors and biases.
    """
    size = len(pairs)
    seen = pairs.sum(axis=1)
    unigram = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * size)
    draw = np.random.default_rng(17)
    params = [draw.normal(0, 0.1, (size, LENGTH)), np.eye(LENGTH),
              draw.normal(0, 0.1, (size, LENGTH)), np.log(unigram)]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    scale = max(pairs.sum(), 1.0)
    data, noise = pairs / scale, NOISE * np.outer(seen / scale, unigram)
    offset = np.log(NOISE * unigram)
    for step in range(1, steps + 1):
        contexts, bridge, targets, bias = params
        made = contexts @ bridge
        chance = 1 / (1 + np.exp(np.clip(offset - made @ targets.T - bias, -40, 40)))
        slope = data * (1 - chance) - noise * chance
        back = slope @ targets
        slopes = [back @ bridge.T, contexts.T @ back, slope.T @ made, slope.sum(axis=0)]
        for k, change in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * change
            second[k] = 0.999 * second[k] + 0.001 * change ** 2
            moved = (first[k] / (1 - 0.9 ** step)) / (
                np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
            params[k] = params[k] + RATE * (1 - step / (steps + 1)) * moved
    contexts, bridge, targets, bias = params
    scores = contexts @ bridge @ targets.T + bias
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def _head(counts: DataFrame) -> Vocabulary:
    """The most frequent words, ``HEAD_WORDS`` at most: all those from some count on.

    The count comes from a histogram of counts (eight steps a doubling), so that no task sends more
    than its share of the head to the driver.  What is left is joined in Spark.
    """
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    end = counts.where(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    words = counts.where(F.col("word") != END).where(
        F.octet_length("word") <= HEAD_BYTES).withColumn(
        "_step", F.floor(8 * F.log2("c")).cast("int"))
    taken, least = 0, None
    for step, many in sorted(words.groupBy("_step").count().collect(), reverse=True):
        taken += many
        if taken > HEAD_WORDS:
            break
        least = step
    head = [] if least is None else words.where(F.col("_step") >= least).select("word", "c").collect()
    head.sort(key=lambda row: (-row.c, row.word))
    return Vocabulary([tuple(row) for row in head], total or 0, distinct, end)


def score_texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Per row ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words of a text and its end; null and empty texts have the end alone.  Rows whose
    id's CRC is a multiple of ten are kept from training; a null id counts as an empty text.  Both
    scores are log10; with no training rows all tokens are unknown.  Repeated rows each count.  The head
    and the pair matrix are of fixed size; all other counts stay in Spark and are joined.
    """
    docs = docs.selectExpr(f"`{id_column}` AS _id", f"`{text_column}` AS _text").withColumn(
        "held_out", held_out())
    seen = docs.where("NOT held_out")
    counts = written(count_words(seen))
    vocabulary = _head(counts)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(vocabulary)
    model = context.broadcast(train(count_pairs(seen, vocabulary)) / math.log(10))

    def work(batch: dict) -> dict:
        known, table = sent.value, model.value
        none = len(known.rank)
        out = {name: [] for name in ("n_tokens", "n_head", "n_other", "base", "score", "tail")}
        for text in batch["_text"]:
            words = words_of(text)
            ranks = known.ranks(words)
            before, at = known.steps(ranks)
            logs = known.log_count[ranks]
            other = ranks >= known.other
            missing = np.flatnonzero(ranks == none)
            tail = Counter([words[place] for place in missing.tolist()])
            out["n_tokens"].append(len(words) + 1)
            out["n_head"].append(len(words) - len(missing) + (known.total > 0))
            out["n_other"].append(int(other.sum()))
            out["base"].append(float(logs.sum()) + known.end_log_count)
            out["score"].append(float(table[before, at].sum() + logs[other].sum()))
            out["tail"].append([{"word": w.decode(), "n": n} for w, n in tail.items()])
        return {"_id": batch["_id"], "held_out": batch["held_out"]} | out

    kind = dict(docs.dtypes)["_id"]
    scored = written(per_batch(
        docs, f"_id {kind}, held_out boolean, n_tokens long, n_head long, n_other long, base double, "
        "score double, tail array<struct<word:string,n:long>>", work).withColumn(
        "_row", F.monotonically_increasing_id()))
    tail = scored.select("_row", F.inline("tail")).join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("tail_log"),
        F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("tail_known"))
    whole = scored.drop("tail").join(tail, "_row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return whole.select(
        F.col("_id").alias(id_column), "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + tail_log - F.col("n_tokens") * F.lit(vocabulary.log_all)).alias(
            "base_score"),
        (F.col("score") + tail_log - F.col("n_other") * F.lit(vocabulary.log_other)).alias("score"))


cloudpickle.register_pickle_by_value(common)
