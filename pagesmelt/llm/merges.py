"""Byte-pair merges of a tokenizer file, and its vocabulary, for use inside tasks."""

from __future__ import annotations

import heapq
import json

import regex

# How byte-level tokenizer files write the 256 bytes as printable characters.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Up to this many symbols a scan beats a heap.
SCAN_UP_TO = 40


def byte_characters() -> list[str]:
    """By byte, the character that stands for it."""
    rest = [byte for byte in range(256) if byte not in set(PRINTABLE)]
    table = {byte: chr(byte) for byte in PRINTABLE}
    table |= {byte: chr(256 + place) for place, byte in enumerate(rest)}
    return [table[byte] for byte in range(256)]


class Merges:
    """Vocabulary, merge ranks and special strings of one file.  Small and read-only."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {token["content"]: token["id"] for token in content["added_tokens"]}
        self.names = {place: name for name, place in (self.ids | self.special).items()}
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        #: left and right token to the merge's rank and its result
        self.ranks = {
            (self.ids[left], self.ids[right]): (rank, self.ids[left + right])
            for rank, (left, right) in enumerate(pairs)}
        self.characters = byte_characters()
        self.specials = regex.compile(
            "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")

    def spelled(self, word: str) -> str:
        """The word's UTF-8 bytes as the vocabulary writes them."""
        return "".join([self.characters[byte] for byte in word.encode("utf-8", "replace")])

    def merged(self, symbols: list[int]) -> list[int]:
        """Apply the merges, lowest rank first and leftmost among equals."""
        return self._scan(symbols) if len(symbols) <= SCAN_UP_TO else self._heap(symbols)

    def _scan(self, symbols: list[int]) -> list[int]:
        symbols, ranks = list(symbols), self.ranks
        while len(symbols) > 1:
            best = None
            for place in range(len(symbols) - 1):
                found = ranks.get((symbols[place], symbols[place + 1]))
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, place
            if best is None:
                break
            symbols[at:at + 2] = [best[1]]
        return symbols

    def _heap(self, symbols: list[int]) -> list[int]:
        symbols, count = list(symbols), len(symbols)
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        waiting: list[tuple[int, int, int, int, int]] = []

        def offer(place: int) -> None:
            follower = after[place]
            if place >= 0 and follower < count:
                found = self.ranks.get((symbols[place], symbols[follower]))
                if found is not None:
                    heapq.heappush(
                        waiting, (found[0], place, symbols[place], symbols[follower], found[1]))

        for place in range(count - 1):
            offer(place)
        while waiting:
            _, place, left, right, result = heapq.heappop(waiting)
            follower = after[place]
            if symbols[place] != left or follower >= count or symbols[follower] != right:
                continue
            symbols[place], symbols[follower] = result, -1
            after[place] = after[follower]
            if after[place] < count:
                before[after[place]] = place
            if before[place] >= 0:
                offer(before[place])
            offer(place)
        return [symbol for symbol in symbols if symbol >= 0]
