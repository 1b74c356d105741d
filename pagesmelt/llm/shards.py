"""Operator 4: documents into shards by a hierarchical weighted hash tree.

At every level a row draws among the children of the node it has reached; a child of weight ``w``
draws ``-ln(u) / w`` from a uniform hash of the row's id, its level and its own name, and the least
draw wins.  A child's share is its weight's share, and when the weight of one child grows, rows move only
into that child.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesmelt.llm.common import written

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]
#: Slots are numbered in so many parts of each shard.
PARTS = 4096


def even_tree(regions: int, racks: int, shards: int) -> Tree:
    """Shards 0, 1, ... of weight one, so many to a rack, racks to a region."""
    return {
        f"region{r}": {
            f"rack{k}": {(r * racks + k) * shards + s: 1.0 for s in range(shards)}
            for k in range(racks)} for r in range(regions)}


def grown_tree(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own: rows move only into it."""
    shard = 1 + max(s for racks in tree.values() for rack in racks.values() for s in rack)
    return tree | {f"region-of-{shard}": {"rack0": {shard: weight}}}


def _draw(key: Column, path: str, weight: float) -> Column:
    """An exponential draw of the given rate; 52 bits of a digest make it uniform in (0, 1)."""
    digest = F.md5(F.concat(key, F.lit(f"@{path}")).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2 ** 52))) / F.lit(float(weight))


def _least(draws: list[tuple[Column, Column]]) -> Column:
    """The outcome with the least draw; the first of the list in a tie."""
    if len(draws) == 1:
        return draws[0][1]
    numbered = [F.struct(draw.alias("d"), F.lit(place).alias("n"))
                for place, (draw, _) in enumerate(draws)]
    best = F.least(*numbered)["n"]
    choice = F.when(best == 0, draws[0][1])
    for place, (_, outcome) in enumerate(draws[1:], 1):
        choice = choice.when(best == place, outcome)
    return choice


def tree_shard(key: Column, tree: Tree) -> Column:
    """The shard of a key: down the levels by the least draw."""
    def rack_choice(region: str, rack: str, shards: dict[int, float]) -> Column:
        return _least([
            (_draw(key, f"{region}/{rack}/{shard}", weight), F.lit(shard))
            for shard, weight in shards.items()])

    def region_choice(region: str, racks: dict[str, dict[int, float]]) -> Column:
        return _least([
            (_draw(key, f"{region}/{rack}", sum(shards.values())), rack_choice(region, rack, shards))
            for rack, shards in racks.items()])

    return _least([
        (_draw(key, region, sum(sum(shards.values()) for shards in racks.values())),
         region_choice(region, racks)) for region, racks in tree.items()])


def assign_shards(
    docs: DataFrame, tree: Tree, grown: Tree | None = None, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    The law is ``key``: id and tree decide, so equal ids share a shard, and a null id is a key too.
    ``size`` is the text's UTF-8 bytes (null: none) plus 1, ``text_crc32`` the unsigned CRC of those
    bytes.  ``slot`` numbers a shard's rows from 0 without gaps, in order of the row's part (a hash),
    id and CRC; rows that agree in all are interchangeable.  A shard is numbered in ``PARTS`` parts: the
    rows before a part come from counts, a table of shards times parts whatever the data, so no task gets
    a whole shard.  Texts are read once and never shuffled; other columns are not read.
    """
    key = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    # The part takes the text in, so that rows that repeat an id are not one group.
    placed = written(
        docs.selectExpr(f"`{id_column}` AS _id", f"`{text_column}` AS _text").select(
            "_id",
            (F.coalesce(F.octet_length("_text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.coalesce("_text", F.lit("")).cast("binary")).alias("text_crc32"),
            tree_shard(key, tree).cast("int").alias("shard"),
            (tree_shard(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"))
        .withColumn("_part", F.crc32(F.concat_ws("/", key, "text_crc32").cast("binary")) % PARTS))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    before = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n")).select(
        "shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_part").orderBy("_id", "text_crc32", "size")
    return (
        placed.withColumn("_row", F.row_number().over(inside))
        .join(before, ["shard", "_part"])
        .select(
            F.col("_id").alias(id_column), "size", "text_crc32", F.lit("key").alias("law"),
            "shard", (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"),
            "grown_shard"))
