"""Operator 2: BPE encoding and decoding by a traversal of a trie of distinct words.

Every prefix of a word has one encoding, and that is the encoding of a shorter prefix plus one last
token.  So a trie node needs only its last token: the token ``t`` that ends there, is its own
encoding, and fits the last token before it (the two side by side stay unmerged).  Going
depth-first, all words below a node share the work above it.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from pagesmelt.llm import common, merges
from pagesmelt.llm.common import per_batch
from pagesmelt.llm.merges import Merges

#: Texts that are encoded at a time; all their ids are in memory at once.
BATCH_ROWS = 256
#: Words whose encoding a Python worker keeps; it starts again beyond.
KEPT_WORDS = 200_000
# Fixed value: how the tokenizer file splits a normalised text; the white space class is spelled out.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")

#: Characters outside ranges in which all Unicode versions agree.
UNCERTAIN = regex.compile(r"[^\x00-\u036F\u0391-\u0481\u2000-\u2027\u20AC]")


class TrieEncoder:
    """Encodes words of one tokenizer file; part of what is sent to the executors."""

    def __init__(self, table: Merges):
        self.table = table
        #: token strings that are their own encoding, as they stand inside a word and at its end; no
        #: other token ever appears
        self.own: tuple[dict[str, int], dict[str, int]] = ({}, {})
        #: by its last three characters: length of the longest such token
        self.reach: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for name, place in table.ids.items():
            if table.merged(self._atoms(name)) == [place]:
                last = bool(table.suffix) and name.endswith(table.suffix) and name != table.suffix
                body = name.removesuffix(table.suffix) if last else name
                for at_end in {last, last or not table.suffix}:
                    self.own[at_end][body] = place
                    self.reach[at_end][body[-3:]] = max(
                        self.reach[at_end].get(body[-3:], 0), len(body))
        #: by left and right token, as one number
        self.fits: dict[int, bool] = {}
        #: by word its ids, four bytes each: a fifth of the room that ids and tokens take as texts
        self.kept: dict[str, bytes] = {}

    def _atoms(self, spelled: str) -> list[int]:
        """Single symbols of a spelled string; a word end belongs to the last one."""
        suffix = self.table.suffix
        if suffix and spelled.endswith(suffix) and spelled != suffix:
            body = spelled.removesuffix(suffix)
            return [self.table.ids[c] for c in body[:-1]] + [self.table.ids[body[-1] + suffix]]
        return [self.table.ids[c] for c in spelled]

    def _fit(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            both = self._atoms(self.table.names[left]) + self._atoms(self.table.names[right])
            if len(self.fits) >= KEPT_WORDS:
                self.fits.clear()
            known = self.fits[key] = self.table.merged(both) == [left, right]
        return known

    def _last(self, text: str, end: int, states: list[int], lengths: list[int], last: bool) -> None:
        """Set the state of the node at depth ``end``; the ``last`` symbol carries the word end.

        Exactly one token fits, so any order of trying is right; short ones are the most frequent.
        """
        own, reach = self.own[last], self.reach[last].get(text[max(0, end - 3):end], 2)
        for start in range(end - 1, max(0, end - reach) - 1, -1):
            token = own.get(text[start:end])
            if token is not None and (start == 0 or self._fit(states[start], token)):
                states[end], lengths[end] = token, end - start
                return
        raise ValueError(f"no token ends {text[:end]!r}")

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct, spelled, non-empty words.

        Sorted words list the leaves of their trie depth-first; ``states`` is the path from the
        root to the node at hand, and what a word shares with the one before is not done again.
        The last symbol carries the word end, so it is a node of its own.
        """
        found: dict[str, list[int]] = {}
        states, lengths, ready, previous = [0], [0], 0, ""
        for word in sorted(words):
            inner = len(word) - 1
            shared = len(os.path.commonprefix((previous, word)))
            depth = min(shared, ready, inner)
            while len(states) <= len(word):
                states.append(0)
                lengths.append(0)
            for end in range(depth + 1, inner + 1):
                self._last(word, end, states, lengths, False)
            ready, previous = inner, word
            self._last(word, inner + 1, states, lengths, True)
            ids, end = [], inner + 1
            while end:
                ids.append(states[end])
                end -= lengths[end]
            found[word] = ids[::-1]
            if inner + 1 > 10_000:
                del states[10_000:], lengths[10_000:]
                ready = min(ready, 9_999)
        return found

    def pieces(self, text: str) -> list[str]:
        """Normalised words and, as they are, special strings, in order."""
        out, at = [], 0
        for hit in self.table.specials.finditer(text):
            out += split(text[at:hit.start()])
            out.append(hit.group())
            at = hit.end()
        return out + split(text[at:] if at else text)

    def entries(self, texts: list[list[str]]) -> dict[str, bytes]:
        """By word: its ids as 32-bit integers."""
        kept = self.kept
        missing = {word for words in texts for word in words if word not in kept}
        if len(kept) + len(missing) > KEPT_WORDS:
            kept = self.kept = {}
            missing = {word for words in texts for word in words}
        plain = {self.table.spelled(word): word for word in missing if word not in self.table.special}
        for spelled, ids in self.encode_words(list(plain)).items():
            kept[plain[spelled]] = array("i", ids).tobytes()
        for word in missing & self.table.special.keys():
            kept[word] = array("i", [self.table.special[word]]).tobytes()
        return kept

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """Per text: ids and decoded text."""
        names = self.table.names
        for start in range(0, len(texts), BATCH_ROWS):
            cut = [self.pieces(text or "") for text in texts[start:start + BATCH_ROWS]]
            known = self.entries(cut)
            for words in cut:
                ids = np.frombuffer(b"".join([known[word] for word in words]), dtype=np.int32)
                yield ids, " ".join([names[place] for place in ids.tolist()])

    def rows(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Per text: number of tokens, ids and decoded text."""
        return [(len(ids), " ".join(map(str, ids.tolist())), decoded)
                for ids, decoded in self.encoded(texts)]


def split(text: str) -> list[str]:
    """Composed, lower case (character by character: no final form of sigma) and cut to words.

    Beyond Latin, Greek and Cyrillic letters the tables of Python and of the tokenizers library are
    of different Unicode versions; there the library's own normalisers and splitter are asked.
    """
    if UNCERTAIN.search(text) is None:
        return SPLIT.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
    from tokenizers import Regex, normalizers, pre_tokenizers

    steps = normalizers.Sequence(
        [normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
    cut = pre_tokenizers.Split(
        Regex(SPLIT.pattern.replace(r"\p{White_Space}", r"\s")), "removed", invert=True)
    return [word for word, _ in cut.pre_tokenize_str(steps.normalize_str(text))]


def encode_decode(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
    digests: bool = False,
) -> DataFrame:
    """Every text encoded without added special tokens, and decoded again.

    ``tokenizer`` is the path of a tokenizer file with word ends, read on the driver; the tables
    broadcast are of the file's size, whatever the corpus.  Columns: the id, ``n_tokens``, and
    ``ids`` (array) and ``decoded`` or, with ``digests``, their SHA-256.  Narrow: no shuffle.
    Null and empty texts have no tokens and decode to an empty text; repeated rows stay, other
    columns are not read.  A worker keeps at most ``KEPT_WORDS`` words.
    """
    encoder = docs.sparkSession.sparkContext.broadcast(TrieEncoder(Merges(tokenizer)))

    def work(batch: dict) -> dict:
        if digests:
            rows = encoder.value.rows(batch["_text"])
            digest = [[hashlib.sha256(row[k].encode()).hexdigest() for row in rows] for k in (1, 2)]
            return {"_id": batch["_id"], "n_tokens": [row[0] for row in rows],
                    "ids_sha256": digest[0], "decoded_sha256": digest[1]}
        ids, decoded = [], []
        for found, text in encoder.value.encoded(batch["_text"]):
            ids.append(found)
            decoded.append(text)
        return {"_id": batch["_id"], "n_tokens": list(map(len, ids)), "ids": ids, "decoded": decoded}

    kind = dict(docs.dtypes)[id_column]
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return per_batch(
        docs.selectExpr(f"`{id_column}` AS _id", f"`{text_column}` AS _text"),
        f"_id {kind}, n_tokens long, {rest}", work, rows=BATCH_ROWS).withColumnRenamed("_id", id_column)


for module in (common, merges):
    cloudpickle.register_pickle_by_value(module)
