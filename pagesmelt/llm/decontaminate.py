"""Operator 8: benchmark passages in documents, by a suffix automaton of the normalised test items.

The automaton accepts every run of words of any item.  A document's words are streamed through it;
at each word it knows the longest run of item words that ends there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesmelt.llm import common
from pagesmelt.llm.common import per_batch, written

WINDOW = 10
#: Test items are taken in blocks of about this many bytes, so that no broadcast grows with them.
BLOCK_BYTES = 400_000
#: Texts that are in a worker's memory at once.
BATCH_ROWS = 256
#: Letters and digits lower-cased, other ASCII to spaces; bytes beyond ASCII belong to words.
FOLDED = bytes(
    byte if byte >= 0x80 or chr(byte).isalnum() else 0x20
    for byte in (bytes([b]).lower()[0] for b in range(256)))
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLDED).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items behind each window."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, self.number = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        paths = []
        for name, text in items:
            path = [self.number.setdefault(word, len(self.number) + 1) for word in words_of(text)]
            if path:
                paths.append((name, path))
                last = 0
                for word in path:
                    last = self._add(last, word)
        #: shortest run that can be a window; longer ones are looked at only
        self.shortest = min([window, *(len(path) for _, path in paths)])
        count = len(self.next)
        self.owners: list[set] = [set() for _ in range(count)]
        short: list[tuple] = [()] * count
        for name, path in paths:
            state = 0
            for place, word in enumerate(path):
                state = self.next[state][word]
                if place + 1 >= window:
                    # no other run ends in the states above, so the way up stays short
                    state = self._up(state)
                    self.owners[state].add(name)
            if len(path) < window:
                short[state] += ((len(path), name),)
        #: whole short items among the suffixes of a state, by a walk from the root down
        self.short = short
        for state in sorted(range(1, count), key=self.length.__getitem__):
            self.short[state] = self.short[self.link[state]] + short[state]

    def _up(self, state: int) -> int:
        """The state of the last ``window`` words of what ends in ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _copy(self, state: int, word: int, target: int) -> int:
        """Split ``target`` so that ``state`` and its suffixes reach one of their own length."""
        new = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = new
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = new
            state = self.link[state]
        return new

    def _add(self, last: int, word: int) -> int:
        """Extend the sequence that ends in ``last``; the state of the longer one."""
        known = self.next[last].get(word)
        if known is not None:
            fits = self.length[known] == self.length[last] + 1
            return known if fits else self._copy(last, word, known)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            if self.length[target] != self.length[state] + 1:
                target = self._copy(state, word, target)
            self.link[new] = target
        return new

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Runs ``[start, end)`` of hit words in order, apart from each other, and the items."""
        numbers = np.fromiter(
            map(self.number.get, words, [0] * len(words)), dtype=np.int64, count=len(words))
        known = np.concatenate(([False], numbers > 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        spans: list[tuple[int, int]] = []
        items: set = set()
        for start, end in edges[edges[:, 1] - edges[:, 0] >= self.shortest].tolist():
            state = length = 0
            for place, word in enumerate(numbers[start:end].tolist(), start + 1):
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                following = self.next[state].get(word)
                if following is None:
                    continue
                state, length = following, length + 1
                reach = 0
                if length >= self.window:
                    state, length = self._up(state), self.window
                    reach = self.window
                    items |= self.owners[state]
                for size, name in self.short[state]:
                    if size <= length:
                        reach = max(reach, size)
                        items.add(name)
                if reach:
                    begin = place - reach
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, place))
        return spans, items


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int, window: int):
    """Automata of bounded blocks of items, one after the other."""
    items = benchmark.select(
        F.col(item).cast("string").alias("_item"), F.col(text).alias("_text")).where(
        "_text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    for block in range(count):
        here = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(count)) == block)
        yield Automaton([tuple(row) for row in here.collect()], window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id",
    text_column: str = "text", item_column: str = "item_id", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``spans``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; a word
    inside any occurrence is hit.  ``spans`` are runs of hit words as ``start`` and ``end`` (exclusive)
    word numbers.  Narrow: no shuffle of documents; the items go to the executors in blocks of
    ``block_bytes``, each with one more pass of the same rows.  Null, empty and wordless texts and items
    have no words; equal items count under each id; an item without id makes hits but is not
    listed; repeated documents stay; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_column]
    schema = (
        f"_id {kind}, _text string, n_words long, items array<string>, "
        "spans array<struct<start:int,end:int>>")
    found = docs.selectExpr(
        f"`{id_column}` AS _id", f"`{text_column}` AS _text", "0L AS n_words",
        "cast(array() AS array<string>) AS items",
        "cast(array() AS array<struct<start:int,end:int>>) AS spans")
    for automaton in _blocks(benchmark, item_column, text_column, block_bytes, window):
        sent = docs.sparkSession.sparkContext.broadcast(automaton)

        def work(batch: dict, sent=sent) -> dict:
            counts, items, spans = [], [], []
            for text, known, before in zip(batch["_text"], batch["items"], batch["spans"]):
                words = words_of(text)
                here, names = sent.value.hits(words)
                runs = _merged([(s["start"], s["end"]) for s in before] + here)
                counts.append(len(words))
                items.append(sorted({*known, *(n for n in names if n is not None)}))
                spans.append([{"start": start, "end": end} for start, end in runs])
            return batch | {"n_words": counts, "items": items, "spans": spans}

        found = per_batch(found, schema, work)
    return found.select(
        F.col("_id").alias(id_column), "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"),
        "items", "spans")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and what stands between them."""
    places = [hit.span() for hit in WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:places[start][0]])
        at = places[end - 1][1]
    return "".join(out) + text[at:]


def remove_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.8,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without benchmark passages; the columns stay as they are.

    The hit words of all blocks of items, found on the same text, are cut out of ``text`` at once,
    again until no window of any block is left, so the result does not depend on ``block_bytes``;
    ``n_chars``, if there, is counted anew.  Documents with more than ``max_coverage`` of their words
    cut are dropped.  Null, empty and clean texts stay as they are.  With several blocks each round is
    written, and only documents cut in it go to the next.
    """
    fields = [field for field in docs.schema.fields if field.name != "text"]
    names = [f"_c{place}" for place in range(len(fields))]
    schema = ", ".join(
        f"{name} {field.dataType.simpleString()}" for name, field in zip(names, fields))
    schema = ", ".join([
        *([schema] if schema else []), "_text string", "_cut long", "_all long", "_hit boolean",
        "_spans array<struct<start:int,end:int>>"])
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(automaton) for automaton in _blocks(
        benchmark, "item_id", "text", block_bytes, window)]
    alone = len(blocks) == 1

    def one_round(found: DataFrame) -> DataFrame:
        for place, sent in enumerate(blocks, 1):
            def work(batch: dict, sent=sent, last=place == len(blocks)) -> dict:
                out = {name: [] for name in ("_text", "_cut", "_all", "_hit", "_spans")}
                for text, cut, length, known in zip(
                        batch["_text"], batch["_cut"], batch["_all"], batch["_spans"]):
                    words = words_of(text)
                    length = length or len(words)
                    spans = _merged(
                        [(s["start"], s["end"]) for s in known] + sent.value.hits(words)[0])
                    hit = bool(spans)
                    while last and spans:
                        cut += sum(end - start for start, end in spans)
                        text = without_spans(text, spans)
                        # further blocks see the cut text in the next round
                        spans = sent.value.hits(words_of(text))[0] if alone else []
                    row = (text, cut, length, hit, [{"start": s, "end": e} for s, e in spans])
                    for name, value in zip(out, row):
                        out[name].append(value)
                return batch | out

            found = per_batch(found, schema, work, rows=BATCH_ROWS)
        return found

    found = one_round(docs.select(
        *(F.col(f"`{field.name}`").alias(name) for name, field in zip(names, fields)),
        F.col("text").alias("_text"), F.lit(0).cast("long").alias("_cut"),
        F.lit(0).cast("long").alias("_all"), F.lit(False).alias("_hit"),
        F.expr("cast(array() AS array<struct<start:int,end:int>>)").alias("_spans")))
    if not alone:
        found = written(found)
        clean, todo = found.where("NOT _hit"), found.where("_hit")
        while not todo.isEmpty():
            found = written(one_round(todo))
            clean, todo = clean.union(found.where("NOT _hit")), found.where("_hit")
        found = clean
    kept = found.where(F.col("_cut") <= F.lit(max_coverage) * F.col("_all"))
    place = {field.name: F.col(name) for name, field in zip(names, fields)}
    if "n_chars" in place:
        place["n_chars"] = F.when(F.col("_cut") > 0, F.length("_text")).otherwise(
            place["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(
        *((F.col("_text") if name == "text" else place[name]).alias(name) for name in docs.columns))


cloudpickle.register_pickle_by_value(common)
