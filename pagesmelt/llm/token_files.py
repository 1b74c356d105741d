"""Operator 13: token ids as raw binary shards, with a minimal perfect hash from keys to places.

A shard is one file: the ids of its documents one after another, each ended by the end id, then a
footer that lists keys and lengths.  Spark's own text sink writes it, with the end id as its "line
end", so that commits, retries and remote stores are Spark's business; the bytes are no text.  The
index is a table of parts of some ten thousand keys.  In each, levels of bits give every key
a slot of its own, and the slot holds a fingerprint and the place of the key's first document.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagesmelt.llm.common import per_partition, shared_folder, written
from pagesmelt.llm.merges import Merges
from pagesmelt.llm.token_counts import SPLIT
from pagesmelt.llm.trie_bpe import UNCERTAIN

#: Closes each document; also 2 or 4 zero bytes, the sink's line end.
END_ID = 0
#: Bytes of text a shard holds, about.
SHARD_BYTES = 1 << 25
#: Keys a part of the index holds, about.
PART_KEYS = 1 << 15
#: Levels of bits after which a part counts as one with equal hashes.
MOST_LEVELS = 64
MAGIC = b"ids+keys"


class TextEncoder:
    """Encodes texts as the tokenizers library does.

    Where the file's ids ascend with its merges, a rank table gives the ids of texts whose characters
    all Unicode versions class alike.  Other texts, and those with special strings, go to the library.
    Nothing is kept between texts.
    """

    def __init__(self, path: str):
        self.path = path
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.ranked = _ranked(Merges(path))

    def __reduce__(self):
        return type(self), (self.path,)

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned little-endian numbers of the file's width."""
        if self.ranked is None or UNCERTAIN.search(text) or any(s in text for s in self.specials):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(text)
        return np.array(ids, self.dtype).tobytes()


def _ranked(table: Merges) -> tiktoken.Encoding | None:
    """A rank table for the file, where ids ascend with the merges."""
    made = [place for _, place in table.ranks.values()]
    if made != sorted(set(made)):
        return None
    byte_of = {character: byte for byte, character in enumerate(table.characters)}
    ranks = {bytes([byte_of[c] for c in name]): place for name, place in table.ids.items()
             if all(c in byte_of for c in name) and name not in table.special}
    return tiktoken.Encoding(
        "texts", pat_str=SPLIT.pattern, mergeable_ranks=ranks, special_tokens={})


def _footer(keys: list[str | None], sizes: list[int], width: int) -> bytes:
    spelled = [b"" if key is None else key.encode() for key in keys]
    lengths = np.array([-1 if k is None else len(s) for k, s in zip(keys, spelled)], "<i4")
    body = lengths.tobytes() + np.array(sizes, "<i8").tobytes() + b"".join(spelled)
    return body + np.array([len(keys), len(body), width], "<i8").tobytes() + MAGIC


def _parse(content: bytes) -> tuple[np.ndarray, list[str | None], np.ndarray]:
    """Ids, keys and lengths of one shard."""
    width = int.from_bytes(content[-len(MAGIC) - 10:-len(MAGIC) - 2], "little")
    if width != 2:
        width = int.from_bytes(content[-len(MAGIC) - 12:-len(MAGIC) - 4], "little")
    end = len(content) - width
    if content[end - len(MAGIC):end] != MAGIC:
        raise ValueError("not a shard of token ids")
    tail = end - len(MAGIC) - 24
    count, body, _ = np.frombuffer(content, "<i8", 3, tail)
    at = tail - int(body)
    lengths = np.frombuffer(content, "<i4", count, at)
    sizes = np.frombuffer(content, "<i8", count, at + 4 * count)
    names = at + 12 * int(count)
    ends = names + np.cumsum(np.maximum(lengths, 0), dtype=np.int64)
    keys = [None if size < 0 else content[stop - size:stop].decode()
            for size, stop in zip(lengths.tolist(), ends.tolist())]
    return np.frombuffer(content, f"<u{width}", at // width), keys, sizes


# --- the index ----------------------------------------------------------------------------------

def _mixed(one: np.ndarray, two: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of two hashes and a seed."""
    x = one.astype(np.uint64) + np.uint64(2 * seed + 1) * two.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _fingerprints(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (_mixed(one, two, 1 << 20) >> np.uint64(32)).astype("<u4")


def perfect_slots(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A slot from 0 for each of the distinct pairs of hashes, and the levels of bits that say so.

    On each level keys draw a place among twice as many; those alone there own its bit, the
    others go on to the next.  A key's slot is the rank of its bit.
    """
    slots, left = np.empty(len(one), np.int64), np.arange(len(one))
    levels, taken = [], 0
    while len(left):
        if len(levels) == MOST_LEVELS:
            raise ValueError("two keys have the same hashes")
        size = max(64, 2 * len(left))
        at = (_mixed(one[left], two[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        slots[left[alone]] = taken + np.cumsum(bits)[at[alone]] - 1
        taken += int(alone.sum())
        left = left[~alone]
        levels.append(bits)
    return slots, levels


def find_slots(one: np.ndarray, two: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slots of any keys; -1 for some that were never put in."""
    slots, left, taken = np.full(len(one), -1, np.int64), np.arange(len(one)), 0
    for level, bits in enumerate(levels):
        at = (_mixed(one[left], two[left], level) % np.uint64(len(bits))).astype(np.int64)
        own, ranks = bits[at], np.cumsum(bits)
        slots[left[own]] = taken + ranks[at[own]] - 1
        left, taken = left[~own], taken + int(ranks[-1])
    return slots


#: What a slot holds: file, place in its ids, ids and number of the key's first document, its rows.
_SLOT = {"file": "<i4", "offset": "<i8", "n_tokens": "<i8", "first": "<i8", "n_rows": "<i8"}
_INDEX = ("part int, n_keys long, level_sizes array<int>, bits binary, prints binary, "
          + ", ".join(f"{name}s binary" for name in _SLOT))


def _index_part(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    one, two = rows["h1"].to_numpy(), rows["h2"].to_numpy()
    slots, levels = perfect_slots(one, two)
    order = np.argsort(slots)
    out = {
        "part": group[0], "n_keys": len(rows), "level_sizes": [len(bits) for bits in levels],
        "bits": np.packbits(np.concatenate(levels)).tobytes(),
        "prints": _fingerprints(one, two)[order].tobytes()}
    for name, kind in _SLOT.items():
        out[f"{name}s"] = rows[name].to_numpy()[order].astype(kind).tobytes()
    return pd.DataFrame([out])


def _look_up(keys: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
    """The places of the keys of one part; no row for keys the index does not hold."""
    if not len(part) or not len(keys):
        return keys.iloc[:0].reindex(columns=["key", *_SLOT])
    entry = part.iloc[0]
    sizes = [int(size) for size in entry["level_sizes"]]
    bits = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=sum(sizes)).astype(bool)
    levels = np.split(bits, np.cumsum(sizes)[:-1])
    one, two = keys["h1"].to_numpy(), keys["h2"].to_numpy()
    slots = find_slots(one, two, levels)
    same = (slots >= 0) & (
        np.frombuffer(entry["prints"], "<u4")[np.maximum(slots, 0)] == _fingerprints(one, two))
    found = pd.DataFrame({"key": keys["key"].to_numpy()[same]})
    for name, kind in _SLOT.items():
        found[name] = np.frombuffer(entry[f"{name}s"], kind)[slots[same]]
    return found


@dataclass
class TokenFiles:
    """Shards of ids in ``folder``, their records and the index of their keys."""

    spark: SparkSession
    folder: str
    #: ``key, number, file, offset, start, n_tokens, ids_crc32`` of every document, read from the shards
    records: DataFrame
    index: DataFrame
    parts: int

    def _hashed(self, keys: DataFrame) -> DataFrame:
        return _with_hashes(keys.where("key IS NOT NULL").distinct(), self.parts)

    def look_up(self, keys: DataFrame) -> DataFrame:
        """``key, file, offset, n_tokens, first, n_rows`` of the ``key`` strings the index holds.

        Constant work a key.  A key that was never written is found once in 2^32 times, by
        a fingerprint that is equal by chance; the footers hold the keys themselves.
        """
        hashed = self._hashed(keys.select("key"))
        return hashed.groupBy("part").cogroup(self.index.groupBy("part")).applyInPandas(
            _look_up, "key string, file int, offset long, n_tokens long, first long, n_rows long")

    def documents(self, keys: DataFrame) -> DataFrame:
        """``key, start, n_tokens, ids_crc32`` of all documents of the keys, through the index."""
        named = self.look_up(keys).select(
            "key", F.explode(F.sequence("first", F.expr("first + n_rows - 1"))).alias("number"))
        return named.join(self.records, ["number", "key"]).select(
            "key", "start", "n_tokens", "ids_crc32")

    def fetch(self, keys: DataFrame) -> DataFrame:
        """``key, ids``: the ids of the first document of each key, end id included.

        Only the shards that hold one are sliced; a shard's keys are at most its documents.
        """
        wanted = self.look_up(keys).groupBy("file").agg(
            F.collect_list(F.struct("key", "offset", "n_tokens")).alias("wanted"))

        def slices(batches: Iterable[dict]) -> Iterator[dict]:
            for batch in batches:
                for content, asked in zip(batch["content"], batch["wanted"]):
                    ids, _, _ = _parse(content)
                    yield {"key": [one["key"] for one in asked], "ids": [
                        ids[one["offset"]:one["offset"] + one["n_tokens"]].astype(np.int64).tolist()
                        for one in asked]}

        return per_partition(
            _shards(self.spark, self.folder).join(wanted, "file").select("content", "wanted"),
            "key string, ids array<long>", slices, rows=1)


def _with_hashes(keys: DataFrame, parts: int) -> DataFrame:
    return keys.withColumns({
        "h1": F.xxhash64("key"), "h2": F.xxhash64("key", F.lit(1))}).withColumn(
        "part", F.expr(f"int(pmod(h1, {parts}))"))


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    """``file, content``: the shards by their number, which is their place in the order of keys."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(
        f"{folder}/shards").where("length > 0").select(
        F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("file"), "content")


def _read_back(batches: Iterable[dict]) -> Iterator[dict]:
    for batch in batches:
        for file, content in zip(batch["file"], batch["content"]):
            ids, keys, sizes = _parse(content)
            ends = np.cumsum(sizes)
            starts = (ends - sizes).tolist()
            yield {
                "key": keys, "file": [file] * len(keys), "place": list(range(len(keys))),
                "offset": starts, "n_tokens": sizes.tolist(),
                "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4").tobytes())
                              for a, b in zip(starts, ends.tolist())]}


def _with_starts(records: DataFrame) -> DataFrame:
    """Adds what comes before each record: ids and records of earlier files, by sums in two levels."""
    order = "ORDER BY {0} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    sums = records.groupBy("file").agg(
        F.sum("n_tokens").alias("ids"), F.count("*").alias("docs")).withColumn(
        "block", F.expr("file div 1024"))

    def before(rows: DataFrame, over: str, place: str) -> DataFrame:
        return rows.selectExpr(*(c for c in rows.columns if c not in ("ids", "docs")), *(
            f"coalesce(sum({name}) OVER ({over} {order.format(place)}), 0) AS {name}_{place}"
            for name in ("ids", "docs")))

    blocks = before(sums.groupBy("block").agg(
        F.sum("ids").alias("ids"), F.sum("docs").alias("docs")), "", "block")
    files = before(sums, "PARTITION BY block", "file").join(blocks, "block")
    return records.join(files, "file").selectExpr(
        "key", "docs_block + docs_file + place AS number", "file", "offset",
        "ids_block + ids_file + offset AS start", "n_tokens", "ids_crc32")


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, id_column: str = "doc_id",
    text_column: str = "text", shard_bytes: int = SHARD_BYTES,
) -> TokenFiles:
    """Encode every text whole, write shards in ascending order of the ids, read them back, index them.

    ``tokenizer`` is the path of a byte-level tokenizer file; each worker opens it.  Shards hold
    about ``shard_bytes`` of text; ids take 2 bytes where the vocabulary allows it, else 4.
    ``folder`` must be shared by all executors; without one, a new one in the checkpoint folder.

    Null and empty texts are the end id alone.  Documents without id come first and are in no index.
    Rows of one id stand next to each other, in the order in which they were read and then by text;
    the index points to the first and says how many there are.  Very long texts are one cell and are
    never cut.  An empty table gives no records.  Other columns are not read.

    One shuffle moves the texts, by ranges of ids; rows of one id may span several shards.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    read = docs.selectExpr(
        f"`{id_column}` AS id", "spark_partition_id() AS origin",
        f"coalesce(`{text_column}`, '') AS text")
    amount = read.agg(F.expr("coalesce(sum(octet_length(text) + 1), 0)")).first()[0]
    ordered = read.repartitionByRange(
        1 + int(amount) // shard_bytes, "id", "origin").sortWithinPartitions(
        "id", "origin", "text").selectExpr("cast(id AS string) AS key", "text")
    encoder = TextEncoder(tokenizer)
    end = np.array([END_ID], encoder.dtype).tobytes()

    def encoded(batches: Iterable[dict]) -> Iterator[dict]:
        keys, sizes = [], []
        for batch in batches:
            found = [encoder.encode(text) for text in batch["text"]]
            keys += batch["key"]
            sizes += [len(one) // len(end) + 1 for one in found]
            # The sink ends the last one.
            yield {"value": [end.join(found)]}
        yield {"value": [_footer(keys, sizes, len(end))]}

    per_partition(ordered, "value binary", encoded).selectExpr("cast(value AS string)").write.option(
        "lineSep", end.decode()).option("maxRecordsPerFile", 0).option("compression", "none").text(
        f"{folder}/shards")
    records = written(_with_starts(per_partition(
        _shards(spark, folder), "key string, file int, place int, offset long, n_tokens long, "
        "ids_crc32 long", _read_back, rows=1)))
    first = records.where("key IS NOT NULL").groupBy("key").agg(
        F.min(F.struct("number", "file", "offset", "n_tokens")).alias("at"),
        F.count("*").alias("n_rows")).selectExpr(
        "key", "at.file", "at.offset", "at.n_tokens", "at.number AS first", "n_rows")
    parts = 1 + records.count() // PART_KEYS
    index = _with_hashes(first, parts).drop("key").groupBy("part").applyInPandas(_index_part, _INDEX)
    index.write.parquet(f"{folder}/index")
    return TokenFiles(
        spark, folder, records, spark.read.schema(index.schema).parquet(f"{folder}/index"), parts)


def token_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """The id, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, found by its id."""
    name = options.get("id_column", "doc_id")
    kind = dict(docs.dtypes)[name]
    files = write_token_files(docs, tokenizer, **options)
    found = files.documents(docs.selectExpr(f"cast(`{name}` AS string) AS key"))
    unnamed = files.records.where("key IS NULL").select(*found.columns)
    return found.union(unnamed).selectExpr(
        f"cast(key AS {kind}) AS `{name}`", "start", "n_tokens", "ids_crc32")
