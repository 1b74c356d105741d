"""Operator 9: token counts, with a shortcut for words that are one token.

Before any text is read, every string of the vocabulary is merged from its bytes: those that end as
one token, and that the tokenizer would not split further, are proved to count 1.  Only other
words of a text are merged.
"""

from __future__ import annotations

import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from pagesmelt.llm import common, merges
from pagesmelt.llm.common import per_batch
from pagesmelt.llm.merges import Merges

# Fixed value: how byte-level tokenizer files split a text; white space as the library has it.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Words that are not one token, whose counts a Python worker keeps; it starts again beyond.
KEPT_WORDS = 400_000


class TokenCounter:
    """Counts tokens of texts; sent to the executors, where it keeps counts of words."""

    def __init__(self, table: Merges):
        self.table = table
        self.single = frozenset(self._proved())
        self.more: dict[str, int] = {}

    def _proved(self):
        byte_of = {character: byte for byte, character in enumerate(self.table.characters)}
        for name, place in self.table.ids.items():
            try:
                word = bytes([byte_of[c] for c in name]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            whole = SPLIT.findall(word) == [word] and word not in self.table.special
            if whole and self.merged(name) == [place]:
                yield word

    def merged(self, spelled: str) -> list[int]:
        return self.table.merged([self.table.ids[c] for c in spelled])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.table.specials.search(text) is None:
            return self._plain(text)
        hits = list(self.table.specials.finditer(text))
        cuts = [0, *(place for hit in hits for place in hit.span()), len(text)]
        return len(hits) + sum(
            self._plain(text[cuts[k]:cuts[k + 1]]) for k in range(0, len(cuts), 2))

    def _plain(self, text: str) -> int:
        single, more = self.single, self.more
        words = SPLIT.findall(text)
        total = len(words)
        for word in words:
            if word in single:
                continue
            extra = more.get(word)
            if extra is None:
                if len(more) >= KEPT_WORDS:
                    more.clear()
                extra = more[word] = len(self.merged(self.table.spelled(word))) - 1
            total += extra
        return total


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every text.

    ``tokenizer`` is the path of a byte-level tokenizer file, read on the driver; what is
    broadcast is of the file's size, whatever the corpus.  Narrow: no shuffle.  Null and empty texts
    have no bytes and tokens; repeated rows stay, other columns are not read.
    """
    counter = docs.sparkSession.sparkContext.broadcast(TokenCounter(Merges(tokenizer)))

    def work(batch: dict) -> dict:
        texts = batch["_text"]
        counts = [counter.value.count(text) for text in texts]
        return {
            "_id": batch["_id"], "n_bytes": [len((text or "").encode()) for text in texts],
            "n_tokens": counts, "over_limit": [count > limit for count in counts]}

    kind = dict(docs.dtypes)[id_column]
    return per_batch(
        docs.selectExpr(f"`{id_column}` AS _id", f"`{text_column}` AS _text"),
        f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean",
        work).withColumnRenamed("_id", id_column)


for module in (common, merges):
    cloudpickle.register_pickle_by_value(module)
