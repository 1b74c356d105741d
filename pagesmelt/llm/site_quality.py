"""Operator 5: quality and toxicity of documents by hierarchical empirical Bayes.

Two logistic classifiers give each document's own evidence.  Grouped over all documents it gives
rates for hosts and for paths below them: a host's rate is shrunk toward the global one, a path's toward
its host's, by a strength that is itself estimated from how much hosts differ.  A document's odds are
then its own, times those of its path over the global ones.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmelt.llm import common
from pagesmelt.llm.common import per_batch, written

#: Labelled documents the classifiers are fitted on, picked by a hash of the id.
SAMPLE_DOCS = 8_000
#: Words in at least so many documents of the sample may become features, by a test of association; at
#: most so many a head.
WORD_FROM, MOST_WORDS = 3, 2_000
STEPS, RATE, DECAY = 200, 0.2, 1e-4
#: Texts that are in a worker's memory at once.
BATCH_ROWS = 256
#: Rejected from this probability on.
REJECT_FROM = 0.5
#: Starts of words, of so many bytes, are tried like words.
STARTS = (4, 5, 6, 7)
HEADS = ("low_quality", "toxic")
#: Borders of the shares that describe a text's form.
BORDERS = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
# Letters and digits lower-cased, other ASCII to spaces.
FOLDED = bytes(
    byte if byte >= 0x80 or chr(byte).isalnum() else 0x20
    for byte in (bytes([b]).lower()[0] for b in range(256)))


def shape(text: str) -> list[str]:
    """The form of a text as binned shares: capitals, symbols, repetition."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    count = max(len(words), 1)
    of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    capitals, small = of[65:91].sum(), of[97:123].sum()
    shares = {
        "upper": sum([word.isupper() for word in words]) / count,
        "capitals": capitals / max(capitals + small, 1),
        "exclaimed": of[ord("!")] / count,
        "bars": of[ord("|")] / count,
        "symbols": of[list(b"#$%&*@^~<>{}[]=_+")].sum() / count,
        "digits": of[48:58].sum() / max(len(raw), 1),
        "same": sum([a == b for a, b in zip(words, words[1:])]) / count,
        "repeated": 1 - len(set(words)) / count,
        "common": max(Counter(words).values(), default=0) / count,
    }
    bins = [f"{name}:{np.searchsorted(BORDERS, value)}" for name, value in shares.items()]
    return [*bins, f"length:{min(len(words).bit_length(), 14)}", "bias"]


def words_of(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "replace").translate(FOLDED).split())


def starts_of(words: set[bytes], size: int) -> set[bytes]:
    """The first bytes of words that are longer, marked as a start."""
    return {b"^" + word[:size] for word in words if len(word) > size}


def different(texts: list[str]) -> list[int]:
    """Places of texts that are no near copies of earlier ones: no least hash of theirs is known."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for place, text in enumerate(texts):
        words = text.encode("utf-8", "replace").lower().split()
        grams = {b" ".join(words[k:k + 3]) for k in range(max(len(words) - 2, 1))}
        hashes = np.array([zlib.crc32(gram) for gram in grams], dtype=np.uint64)
        marks = {(k, int((hashes * np.uint64(odd) % np.uint64(2 ** 32)).min()))
                 for k, odd in enumerate((2654435761, 2246822519, 3266489917, 668265263))}
        if not marks & seen:
            kept.append(place)
        seen |= marks
    return kept


def names_of(text: str) -> set[bytes]:
    words = words_of(text)
    return words.union(*(starts_of(words, size) for size in STARTS))


class Tally:
    """In how many texts names, as CRCs, stand; of texts not yet counted it holds ``BATCH_ROWS``."""

    def __init__(self):
        self.texts, self.held = 0, []
        self.names, self.counts = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)

    def add(self, names: np.ndarray) -> None:
        self.texts += 1
        self.held.append(names)
        if len(self.held) >= BATCH_ROWS:
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct names in order, and their texts."""
        if self.held:
            names, counts = np.unique(np.concatenate(self.held), return_counts=True)
            self.names, place = np.unique(np.concatenate([self.names, names]), return_inverse=True)
            self.counts = np.bincount(
                place, np.concatenate([self.counts, counts]), len(self.names)).astype(np.int64)
            self.held = []
        return self.names, self.counts


def telling_numbers(every: Tally, wanted: Tally) -> np.ndarray:
    """Names, as CRCs, more frequent with the label than chance allows: a likelihood-ratio test of each.

    The threshold rises with the number of names tried.
    """
    total, own = every.texts, wanted.texts
    if own in (0, total):
        return np.empty(0, dtype=np.uint32)
    tried, n = every.sums()
    tried, n = tried[n >= WORD_FROM], n[n >= WORD_FROM].astype(np.float64)
    hits, counts = wanted.sums()
    a = np.zeros(len(tried))
    common, here, there = np.intersect1d(tried, hits, assume_unique=True, return_indices=True)
    a[here] = counts[there]
    cells = np.stack((a, n - a, own - a, total - own - n + a))
    expected = np.stack((n * own, n * (total - own), (total - n) * own,
                         (total - n) * (total - own))) / total
    ratio = 2 * (cells * np.log(np.maximum(cells, 1e-9) / np.maximum(expected, 1e-9))).sum(axis=0)
    good = (ratio >= 2 * np.log(max(len(tried), 1)) + 6) & (a / own > n / total)
    best = np.argsort(-ratio[good], kind="stable")[:MOST_WORDS]
    return np.sort(tried[good][best])


class Classifiers:
    """One weight per head for each feature; sent to the executors."""

    def __init__(self):
        self.weights: dict[bytes | str, np.ndarray] = {}
        self.telling: set[bytes] = set()

    def fit(self, texts: list[str], targets: np.ndarray) -> None:
        """Per head, AdaGrad on the regularised log-likelihood over telling words and the form."""
        kept = different(texts)
        texts, targets = [texts[k] for k in kept], targets[kept]
        tally, own_tallies = Tally(), [Tally() for _ in HEADS]
        for text, wanted in zip(texts, targets):
            found = np.unique(np.fromiter(map(zlib.crc32, names_of(text)), dtype=np.uint32))
            tally.add(found)
            for own_tally, hit in zip(own_tallies, wanted):
                if hit:
                    own_tally.add(found)
        told = [telling_numbers(tally, own_tally) for own_tally in own_tallies]
        every = set(np.concatenate(told).tolist()) if texts else set()
        spelled = [
            [name for name in sorted(names_of(text)) if zlib.crc32(name) in every] for text in texts]
        forms = [shape(text) for text in texts]
        self.weights, self.telling = {}, set()
        for head in range(len(HEADS)):
            wanted, own_names = targets[:, head], set(told[head].tolist())
            number: dict = {}
            rows = [
                [number.setdefault(name, len(number)) for name in
                 [*(word for word in words if zlib.crc32(word) in own_names), *form]]
                for words, form in zip(spelled, forms)]
            if not rows:
                continue
            flat = np.concatenate([np.array(row) for row in rows])
            owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
            own, squares = np.zeros(len(number)), np.full(len(number), 1e-10)
            for _ in range(STEPS):
                score = np.bincount(owner, own[flat], minlength=len(rows))
                miss = (wanted - 1 / (1 + np.exp(-np.clip(score, -30, 30)))) / len(rows)
                change = np.bincount(flat, miss[owner], minlength=len(own)) - DECAY * own
                squares += change ** 2
                own += RATE * change / np.sqrt(squares)
            for name, k in number.items():
                self.weights.setdefault(name, np.zeros(len(HEADS)))[head] = own[k]
                if isinstance(name, bytes):
                    self.telling.add(name)

    def logits(self, text: str | None) -> np.ndarray:
        known, total = self.weights, np.zeros(len(HEADS))
        told = names_of(text or "") & self.telling
        for name in (*told, *shape(text or "")):
            found = known.get(name)
            if found is not None:
                total += found
        return total


def fit_classifiers(docs: DataFrame, labels: DataFrame) -> Classifiers:
    """From at most ``SAMPLE_DOCS`` labelled documents; labels that are null count as good."""
    sample = labels.select(
        F.col("doc_id").alias("_id"), (F.coalesce("quality", F.lit(1)) == 0).alias("low"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("bad")).where("_id IS NOT NULL").groupBy(
        "_id").agg(F.max("low").alias("low"), F.max("bad").alias("bad")).orderBy(
        F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    rows = docs.select("_id", "_text").where("_text IS NOT NULL").join(
        F.broadcast(sample), "_id").limit(2 * SAMPLE_DOCS).collect()
    rows = sorted((row._id, row._text, row.low, row.bad) for row in rows)
    model = Classifiers()
    targets = np.array([row[2:] for row in rows], dtype=np.float64).reshape(-1, len(HEADS))
    model.fit([row[1] for row in rows], targets)
    return model


def _scored(docs: DataFrame, model: Classifiers, columns: list[str]) -> DataFrame:
    """``columns`` with each head's log-odds; rows with text only in ``_text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {field.name: field.dataType.simpleString() for field in docs.schema.fields}

    def work(batch: dict) -> dict:
        logits = np.array([sent.value.logits(text) for text in batch["_text"]]).reshape(-1, len(HEADS))
        return {name: batch[name] for name in columns} | {
            f"_{head}": logits[:, k] for k, head in enumerate(HEADS)}

    schema = ", ".join([*(f"`{name}` {kinds[name]}" for name in columns),
                        *(f"_{head} double" for head in HEADS)])
    return per_batch(docs, schema, work, rows=BATCH_ROWS)


def _chance(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _log_odds(rate: Column) -> Column:
    safe = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (F.lit(1.0) - safe))


def _strengths(hosts: DataFrame) -> tuple[list[float], list[float]]:
    """Per head the global rate, and the number of documents the prior of a host is worth.

    By moments: what hosts' rates vary beyond the spread that rates of their size have by chance.
    """
    sums = [F.sum(f"sum_{head}") / F.greatest(F.sum("n"), F.lit(1)) for head in HEADS]
    first = hosts.agg(F.sum("n").alias("n"), *(s.alias(h) for s, h in zip(sums, HEADS))).first()
    rates = [first[head] or 0.5 for head in HEADS]
    spread = hosts.agg(F.count("*").alias("hosts"), F.sum(1 / F.col("n")).alias("inverse"), *(
        F.sum((F.col(f"sum_{head}") / F.col("n") - rate) ** 2).alias(head)
        for head, rate in zip(HEADS, rates))).first()
    strengths = []
    for head, rate in zip(HEADS, rates):
        noise = rate * (1 - rate)
        between = ((spread[head] or 0) - noise * (spread["inverse"] or 0)) / max(spread["hosts"], 1)
        strengths.append(min(max(noise / max(between, 1e-9) - 1, 1.0), 1e6))
    return rates, strengths


def site_rates(scores: DataFrame) -> tuple[DataFrame, list[float]]:
    """Shrunk log-odds ``path_<head>`` of every host and path, less the global ones."""
    sums = [F.sum(_chance(F.col(f"_{head}"))).alias(f"sum_{head}") for head in HEADS]
    paths = written(scores.groupBy("_host", "_path").agg(F.count("*").alias("n"), *sums))
    hosts = paths.groupBy("_host").agg(
        F.sum("n").alias("n"), *(F.sum(f"sum_{head}").alias(f"sum_{head}") for head in HEADS))
    rates, strengths = _strengths(hosts)
    shrunk = hosts.select("_host", *(
        ((F.col(f"sum_{head}") + strength * rate) / (F.col("n") + strength)).alias(f"host_{head}")
        for head, rate, strength in zip(HEADS, rates, strengths)))
    return paths.join(shrunk, "_host").select("_host", "_path", *(
        (_log_odds((F.col(f"sum_{head}") + strength * F.col(f"host_{head}")) /
                   (F.col("n") + strength)) - _log_odds(F.lit(rate))).alias(f"path_{head}")
        for head, rate, strength in zip(HEADS, rates, strengths))), rates


def _judged(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with, per head, the combined probability."""
    model = fit_classifiers(docs, labels)
    scores = _scored(docs.select("_text", "_host", "_path"), model, ["_host", "_path"])
    sites, _ = site_rates(scores)
    scored = _scored(docs, model, [*columns, "_host", "_path"])
    joined = scored.join(written(sites), ["_host", "_path"], "left")
    return joined.select(*columns, *(
        _chance(F.col(f"_{head}") + F.coalesce(f"path_{head}", F.lit(0.0))).alias(f"p_{head}")
        for head in HEADS))


def _named(docs: DataFrame, host: str, path: str) -> list[Column]:
    return [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in (host, path)]


def judge_documents(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    host_column: str = "source", path_column: str = "lang",
) -> DataFrame:
    """The id, ``p_low_quality``, ``p_toxic`` and ``rejected`` of every row.

    Two passes over the texts: one for the rates of sites, from all documents, one for the decision.
    Sums per site are partial before the shuffle, so a host with a third of all rows is a few rows; what is
    broadcast is the model, of fixed size, and whatever Spark finds small.  Null hosts and paths are a
    site of their own; null and empty texts are judged by their form and site; labels of unknown or
    null ids, and nulls among them, tell nothing; repeated rows stay.
    """
    host, path = _named(docs, host_column, path_column)
    named = docs.select(
        F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"),
        host.alias("_host"), path.alias("_path"))
    judged = _judged(named, labels, ["_id"])
    return judged.select(
        F.col("_id").alias(id_column), *(f"p_{head}" for head in HEADS),
        (F.greatest(*(F.col(f"p_{head}") for head in HEADS)) >= REJECT_FROM).alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected; columns stay as they are.

    Texts travel with their rows and are joined with the sites' rates, not shuffled, as long as Spark
    finds that table small.
    """
    host, path = _named(docs, "source", "lang")
    places = {name: f"_c{k}" for k, name in enumerate(docs.columns) if name != "text"}
    named = docs.select(
        F.col("doc_id").alias("_id"), F.col("text").alias("_text"), host.alias("_host"),
        path.alias("_path"), *(F.col(f"`{name}`").alias(place) for name, place in places.items()))
    judged = _judged(named, labels, ["_text", *places.values()]).where(
        F.greatest(*(F.col(f"p_{head}") for head in HEADS)) < REJECT_FROM)
    return judged.select(*(
        F.col(places.get(name, "_text")).alias(name) for name in docs.columns))


cloudpickle.register_pickle_by_value(common)
