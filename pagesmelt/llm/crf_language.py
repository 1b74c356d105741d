"""Operator 7: the language of texts by a linear-chain conditional random field over words.

A sentence is a chain; each word scores the languages by its affixes, its character n-grams and, if
training saw it, itself; learned transitions favour staying in a language.  Forward-backward gives each
word's language, also where a text switches, and a document takes the language of most of its words.
"""

from __future__ import annotations

import zlib
from itertools import accumulate, chain
from operator import add

import numpy as np
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesmelt.llm import common
from pagesmelt.llm.common import per_batch

#: About so many training documents of each language are read to fit the model.
SAMPLE_DOCS = 150
#: Feature weights; training words seen this often have a feature of their own.
BUCKETS, LEXICON_FROM = 1 << 17, 3
STEPS, RATE, DECAY = 40, 0.3, 1e-4
#: Words whose scores a Python worker keeps, and at most so many scores: fewer words of many languages.
KEPT_WORDS, KEPT_SCORES = 200_000, 1 << 23
#: Names of features whose buckets a Python worker keeps.
KEPT_NAMES = 200_000
#: Chains are taken side by side up to about so many scores of their words; a chain is never cut.
SCORES = 1 << 20
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SENTENCE = regex.compile(r"[.!?\n]+")
UNKNOWN = "und"


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence, in lower case; sentences without words are left out."""
    return [words for part in SENTENCE.split((text or "").lower()) if (words := WORD.findall(part))]


class _Buckets(dict):
    """Buckets of feature names, found once each; it starts again beyond ``KEPT_NAMES``."""

    def __missing__(self, name: str) -> int:
        if len(self) >= KEPT_NAMES:
            self.clear()
        found = self[name] = zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS
        return found


_BUCKET_OF = _Buckets()


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Buckets of the affixes, n-grams and, if known, the word itself.  Long words keep all of them."""
    marked = f"^{word}$"
    pairs = list(map(add, marked, marked[1:]))
    names = ["p" + word[:1], "p" + word[:2], "p" + word[:3],
             "s" + word[-1:], "s" + word[-2:], "s" + word[-3:],
             *pairs, *map(add, pairs, marked[2:])]
    if word in lexicon:
        names.append("w" + word)
    return list(map(_BUCKET_OF.__getitem__, names))


class Chains:
    """Chains of word numbers side by side, longest first, so that a step serves all at once."""

    def __init__(self, chains: list[np.ndarray]):
        lengths = np.array([len(chain) for chain in chains], dtype=np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        flat = np.concatenate([chains[k] for k in self.order] or [np.empty(0, dtype=np.int64)])
        starts = np.cumsum(lengths) - lengths
        #: chains that are at least so long, and their words there
        self.active = [int(n) for n in np.searchsorted(
            -lengths, -np.arange(1, lengths.max(initial=0) + 1), side="right")]
        self.at = [starts[:n] + place for place, n in enumerate(self.active)]
        self.words, self.lengths = flat, lengths

    def marginals(
        self, emission: np.ndarray, start: np.ndarray, move: np.ndarray, count_moves: bool = True):
        """Language probabilities of every word, and the expected number of each transition.

        ``emission`` has a positive row for each word; every step is scaled to sum one.
        """
        rows = emission[self.words]
        forward = np.empty_like(rows)
        for place, at in enumerate(self.at):
            ahead = start[None, :] if place == 0 else forward[self.at[place - 1][:len(at)]] @ move
            here = ahead * rows[at]
            forward[at] = here / here.sum(axis=1, keepdims=True)
        after = np.ones_like(rows)
        moves = np.zeros_like(move)
        for place in range(len(self.at) - 1, 0, -1):
            at = self.at[place]
            back = rows[at] * after[at]
            before = self.at[place - 1][:len(at)]
            if count_moves:
                ahead = forward[before]
                whole = ((ahead @ move) * back).sum(axis=1, keepdims=True)
                moves += move * ((ahead / whole).T @ back)
            here = back @ move.T
            after[before] = here / here.sum(axis=1, keepdims=True)
        found = forward * after
        return found / found.sum(axis=1, keepdims=True), moves


def grouped(chains: list[np.ndarray], most: int) -> list[range]:
    """Runs of chains with about ``most`` words together."""
    ends = np.cumsum([len(chain) for chain in chains]) // max(most, 1)
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(chains)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


class Sample:
    """Some training chains, their words and the features of these."""

    def __init__(self, chains: list[np.ndarray], golds: np.ndarray, listed: list[list[int]], size: int):
        known, flat = np.unique(np.concatenate(chains), return_inverse=True)
        ends = np.cumsum([len(chain) for chain in chains])
        self.laid = Chains(np.split(flat, ends[:-1]))
        self.listed = [listed[k] for k in known]
        owner = np.repeat(np.arange(len(known)), [len(one) for one in self.listed])
        buckets = np.concatenate([np.array(one) for one in self.listed])
        order = np.argsort(buckets, kind="stable")
        #: words in the order of their buckets, each bucket's first place, and the buckets
        self.owner = owner[order]
        self.buckets, self.first = np.unique(buckets[order], return_index=True)
        self.gold = golds[self.laid.order]
        self.wanted = np.zeros((len(known), size), dtype=np.float32)
        np.add.at(self.wanted, (self.laid.words, np.repeat(self.gold, self.laid.lengths)), 1)

    def slope(self, found: np.ndarray) -> np.ndarray:
        """What the marginals leave to be wanted, by bucket."""
        words = self.wanted.astype(np.float64)
        for k in range(words.shape[1]):
            words[:, k] -= np.bincount(self.laid.words, found[:, k], minlength=len(words))
        return np.add.reduceat(words[self.owner], self.first, axis=0)


class LanguageModel:
    """Weights, sent to the executors, where the scores of words are kept."""

    def __init__(self, languages: list[str], lexicon: frozenset[str]):
        self.languages, self.lexicon = languages, lexicon
        size = len(languages)
        self.weights = np.zeros((BUCKETS, size), dtype=np.float32)
        self.start = np.full(size, 1 / max(size, 1))
        self.move = np.full((size, size), 1 / max(size, 1))
        self.number: dict[str, int] = {}
        self.emission = np.empty((0, size))

    def emissions(self, listed: list[list[int]], weights: np.ndarray) -> np.ndarray:
        """Positive scores of words given by their features."""
        if not listed:
            return np.empty((0, len(self.languages)))
        ends = np.cumsum([len(one) for one in listed])
        flat = np.concatenate([np.array(one) for one in listed])
        sums = np.add.reduceat(weights[flat], np.append(0, ends[:-1]), axis=0).astype(np.float64)
        return np.exp(np.clip(sums - sums.max(axis=1, keepdims=True), -30, 0))

    def fit(self, texts: list[str], languages: list[str]) -> None:
        """Climb the conditional log-likelihood; all words of a text have its language."""
        number: dict[str, int] = {}
        chains, golds = [], []
        for text, language in zip(texts, languages):
            for words in sentences(text):
                chains.append(np.array([number.setdefault(w, len(number)) for w in words]))
                golds.append(self.languages.index(language))
        if not chains or len(self.languages) < 2:
            return
        listed = [features(word, self.lexicon) for word in number]
        size, golds = len(self.languages), np.array(golds)
        samples = [
            Sample([chains[k] for k in run], golds[run.start:run.stop], listed, size)
            for run in grouped(chains, SCORES // size)]
        stays = np.zeros((size, size))
        np.add.at(stays, (golds, golds), np.array([len(chain) for chain in chains]) - 1.0)
        weights = np.zeros((BUCKETS, size), dtype=np.float32)
        squares = np.full((BUCKETS, size), 1e-8, dtype=np.float32)
        change = np.empty_like(weights)
        bridge, bridge_squares = np.zeros((size, size)), np.full((size, size), 1e-8)
        total = float(sum(len(chain) for chain in chains))
        for _ in range(STEPS):
            np.multiply(weights, -DECAY / total, out=change)
            step, moves = np.exp(bridge), np.zeros((size, size))
            for sample in samples:
                emission = self.emissions(sample.listed, weights)
                found, here = sample.laid.marginals(emission, self.start, step)
                change[sample.buckets] += sample.slope(found) / total
                moves += here
            for k in range(0, BUCKETS, 1 << 12):
                rows = slice(k, k + (1 << 12))
                squares[rows] += change[rows] ** 2
                weights[rows] += RATE * change[rows] / np.sqrt(squares[rows])
            shift = (stays - moves) / total
            bridge_squares += shift ** 2
            bridge = np.clip(bridge + RATE * shift / np.sqrt(bridge_squares), -4, 4)
        self.weights = weights
        self.move = np.exp(bridge)

    def _numbered(self, chains: list[list[str]]) -> list[np.ndarray]:
        """The chains as numbers of words whose scores are at hand."""
        every = list(chain.from_iterable(chains))
        number = self.number
        missing = {word for word in every if word not in number}
        if len(self.number) + len(missing) > min(KEPT_WORDS, KEPT_SCORES // len(self.languages)):
            self.number, self.emission = {}, np.empty((0, len(self.languages)))
            missing = set(every)
        fresh = list(missing)
        self.number |= {word: len(self.emission) + k for k, word in enumerate(fresh)}
        self.emission = np.concatenate((self.emission, self.emissions(
            [features(word, self.lexicon) for word in fresh], self.weights)))
        numbers = np.fromiter(map(self.number.__getitem__, every), dtype=np.int64, count=len(every))
        ends = list(accumulate(map(len, chains), initial=0))
        return [numbers[a:b] for a, b in zip(ends, ends[1:])]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its share of the words, per text."""
        size = len(self.languages)
        cut = [sentences(text) for text in texts]
        chains, owners = [], []
        for owner, one in enumerate(cut):
            chains += one
            owners += [owner] * len(one)
        if not chains or not size:
            return [(UNKNOWN, 0.0)] * len(texts)
        mass = np.zeros((len(texts), size))
        for run in grouped(chains, SCORES // size):
            laid = Chains(self._numbered(chains[run.start:run.stop]))
            found, _ = laid.marginals(self.emission, self.start, self.move, False)
            place = np.repeat(np.array(owners[run.start:run.stop])[laid.order], laid.lengths)
            for k in range(size):
                mass[:, k] += np.bincount(place, found[:, k], minlength=len(texts))
        whole, best = mass.sum(axis=1), mass.argmax(axis=1)
        return [
            (self.languages[best[k]], float(min(mass[k, best[k]] / whole[k], 1.0)))
            if whole[k] else (UNKNOWN, 0.0) for k in range(len(texts))]


def fold(id_column: str = "_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4


def fit_language_model(docs: DataFrame) -> LanguageModel:
    """From about ``SAMPLE_DOCS`` training rows of each language, picked by a hash of the id.

    Every language of a training row is learned.  The weights grow with the number of languages, and the
    time of the fit with its square; chains are taken in groups, so scores of words do not add up.
    """
    labelled = docs.where("NOT held_out AND _lang IS NOT NULL AND _text IS NOT NULL")
    counts = labelled.groupBy("_lang").count().collect()
    shares = docs.sparkSession.createDataFrame(
        [(row._lang, min(1.0, SAMPLE_DOCS / row["count"])) for row in counts],
        f"_lang {dict(docs.dtypes)['_lang']}, share double")
    drawn = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # a row for each language, so texts stay where they are; the rank bounds rows that share an id
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(drawn, "_text"))
    rows = labelled.join(F.broadcast(shares), "_lang").where(drawn < F.col("share")).select(
        "_lang", "_text", rank.alias("rank")).where(F.col("rank") <= 4 * SAMPLE_DOCS).collect()
    rows = sorted((row._lang, row._text) for row in rows)
    seen: dict[str, int] = {}
    for _, text in rows:
        for words in sentences(text):
            for word in words:
                seen[word] = seen.get(word, 0) + 1
    lexicon = frozenset(word for word, count in seen.items() if count >= LEXICON_FROM)
    model = LanguageModel(sorted({row._lang for row in counts}), lexicon)
    model.fit([text for _, text in rows], [language for language, _ in rows])
    return model


def identify_languages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    language_column: str = "lang",
) -> DataFrame:
    """The id, ``held_out``, ``lang_pred`` and ``score`` of every row.

    Training reads rows with a text and a language whose id's CRC modulo 4 is not 2; prediction reads
    the text alone.  ``score`` is the predicted language's share of the words.  Null texts and texts
    without a letter, and all texts when no language is known, are ``und`` with score 0.  Repeated
    rows stay.  Narrow: the model goes to the executors and grows
    with the number of languages only; whole texts are read.
    """
    docs = docs.selectExpr(
        f"`{id_column}` AS _id", f"`{text_column}` AS _text", f"`{language_column}` AS _lang"
    ).withColumn("held_out", fold() == 2)
    sent = docs.sparkSession.sparkContext.broadcast(fit_language_model(docs))

    def work(batch: dict) -> dict:
        rows = []
        for start in range(0, len(batch["_text"]), 512):
            rows += sent.value.predict(batch["_text"][start:start + 512])
        return {"_id": batch["_id"], "held_out": batch["held_out"],
                "lang_pred": [row[0] for row in rows], "score": [row[1] for row in rows]}

    kind = dict(docs.dtypes)["_id"]
    return per_batch(
        docs.select("_id", "_text", "held_out"),
        f"_id {kind}, held_out boolean, lang_pred string, score double", work).withColumnRenamed(
        "_id", id_column)


cloudpickle.register_pickle_by_value(common)
