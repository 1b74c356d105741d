"""Operator 6: documents whose sets of word n-grams are alike, by a blocked sparse matrix product.

Documents are rows and n-grams columns of an incidence matrix; the product of the matrix with its
transpose counts overlaps.  Only the columns of a row's prefix are multiplied: with all n-grams in
one order, two rows that are alike share one in their first ``n - ceil(t * n) + 1``.  Spark blocks
the columns by hash.  Pairs whose sizes, or whose overlap within the prefixes and what lies beyond,
cannot reach the bound are discarded before whole sets are compared.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesmelt.llm import common
from pagesmelt.llm.common import components, per_batch, written

WIDTH, PERCENT = 3, 90
#: The heaviest columns, so many, of those with more entries than this go last in the order.  Any order
#: gives the same links; this one keeps shared passages out of the prefixes.
HEAVY_FROM, HEAVY_COLUMNS = 64, 65_536
#: Added to a heavy number, which so sorts last.
LATE = 1 << 62
#: So often the members of an open column are compared with one of them, drawn anew each time.
ROUNDS = 2
#: Open columns with more entries than this are multiplied in blocks of about so many documents.
DENSE_FROM, BLOCK = 32, 512
#: Columns of a block that are laid out at once.
CHUNK = 2048
#: Size of the filter for texts that are read again; a fuller one lets more through, never less.
FILTER_BITS = 1 << 25
#: Texts whose sets are in a worker's memory at once.
BATCH_ROWS = 512
#: Words whose hashes are kept within a batch.
KEPT_WORDS = 200_000
# Fixed odd multipliers, one per place of an n-gram.
PLACES = np.array(
    [int.from_bytes(hashlib.blake2b(b"place%d" % k, digest_size=8).digest(), "big") | 1
     for k in range(64)], dtype=np.uint64)


class Shingler:
    """Texts to sorted arrays of distinct n-gram numbers.

    A number is 4 bits that fall with the length of the n-gram's words, then 58 bits of hash: its
    order puts long, hence rare, n-grams first.
    """

    def __init__(self, width: int, heavy: np.ndarray):
        self.width, self.heavy = width, heavy
        self.kept: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        digest = hashlib.blake2b(word, digest_size=8).digest()
        found = self.kept[word] = int.from_bytes(digest, "big")
        return found

    def numbers(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.empty(0, dtype=np.int64)
        known = self.kept.get
        hashes = np.array([known(word) or self._hash(word) for word in words], dtype=np.uint64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = min(self.width, len(words))
        count = len(words) - width + 1
        grams = np.full(count, np.uint64(width), dtype=np.uint64)
        length = np.zeros(count, dtype=np.int64)
        for place in range(width):
            grams += hashes[place:place + count] * PLACES[place]
            length += sizes[place:place + count]
        rarity = (15 - np.minimum(length // 3, 15)).astype(np.uint64)
        return np.unique(((rarity << np.uint64(58)) | (grams >> np.uint64(6))).astype(np.int64))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of a batch; nothing stays in the worker's memory after it."""
        found = [self.numbers(text) for text in texts]
        self.kept.clear()
        return found

    def prefix(self, numbers: np.ndarray, percent: int) -> np.ndarray:
        """The first ``n - ceil(n * percent / 100) + 1`` numbers, the heavy ones marked and late."""
        if len(numbers) == 0:
            return numbers
        count = len(numbers) - math.ceil(len(numbers) * percent / 100) + 1
        if len(self.heavy):
            place = np.minimum(np.searchsorted(self.heavy, numbers), len(self.heavy) - 1)
            numbers = np.sort(np.where(self.heavy[place] == numbers, numbers + LATE, numbers))
        return numbers[:count]


def _signatures(docs: DataFrame, shingler: Shingler, percent: int) -> DataFrame:
    """``_id``, ``_key`` (a hash of the text), ``n``, ``fp`` (of the set) and ``prefix``."""
    sent = docs.sparkSession.sparkContext.broadcast(shingler)

    def work(batch: dict) -> dict:
        sets = sent.value.sets(batch["_text"])
        return {
            "_id": batch["_id"], "_key": batch["_key"], "n": [len(s) for s in sets],
            "fp": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            "prefix": [sent.value.prefix(s, percent) for s in sets]}

    kind = dict(docs.dtypes)["_id"]
    return per_batch(
        docs, f"_id {kind}, _key long, n int, fp binary, prefix array<long>", work, rows=BATCH_ROWS)


def _heavy(docs: DataFrame, shingler: Shingler, percent: int) -> np.ndarray:
    """The heaviest columns of all prefixes, ascending; bounded by ``HEAVY_COLUMNS``.

    Of a batch's columns those that repeat in it are counted on.
    """
    sent = docs.sparkSession.sparkContext.broadcast(shingler)

    def work(batch: dict) -> dict:
        shingler = sent.value
        prefixes = [shingler.prefix(shingler.numbers(text), percent) for text in batch["_text"]]
        shingler.kept.clear()
        grams, counts = np.unique(
            np.concatenate([*prefixes, np.empty(0, dtype=np.int64)]), return_counts=True)
        return {"gram": grams[counts > 1], "many": counts[counts > 1]}

    counted = per_batch(docs.select("_text"), "gram long, many long", work, rows=4 * BATCH_ROWS)
    rows = counted.groupBy("gram").agg(F.sum("many").alias("many")).where(
        F.col("many") > HEAVY_FROM).orderBy(
        F.desc("many"), "gram").limit(HEAVY_COLUMNS).select("gram").collect()
    return np.array(sorted(row.gram for row in rows), dtype=np.int64)


def _name(column: str) -> Column:
    """The id as a join key that is never null; with a hash of the text it tells rows apart."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_name")


def _near(a: Column, b: Column, percent: int) -> Column:
    """Sizes that can still reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose ``_key`` may be in ``wanted``, by a bitmap of fixed size: no text is moved."""
    place = F.pmod(F.col("_key"), F.lit(FILTER_BITS)) + 1
    bitmap = wanted.select(place.alias("place")).groupBy(
        F.bitmap_bucket_number("place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))
    bit = F.bitmap_bit_position(place)
    return (
        docs.withColumns({"_bucket": F.bitmap_bucket_number(place), "_at": bit})
        .join(F.broadcast(bitmap), "_bucket")  # FILTER_BITS bits at most
        .where("shiftright(cast(conv(hex(substring(_bits, cast(_at div 8 + 1 AS int), 1)), 16, 10) "
               "AS int), cast(_at % 8 AS int)) & 1 = 1")
        .drop("_bucket", "_bits", "_at"))


def _whole_sets(needed: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``(node, grams)``: all n-grams of the texts behind the nodes needed."""
    wanted = written(nodes.join(needed, "node").select("node", "_id", "_key"))
    texts = _only(docs, wanted).select(_name("_id"), "_key", "_text").join(
        wanted.select("node", _name("_id"), "_key"), ["_name", "_key"]).groupBy(
        "_name", "_key", "node").agg(F.first("_text").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(Shingler(width, np.empty(0, dtype=np.int64)))

    def work(batch: dict) -> dict:
        return {"node": batch["node"], "grams": sent.value.sets(batch["_text"])}

    return written(per_batch(
        texts.select("node", "_text"), "node long, grams array<long>", work, rows=BATCH_ROWS))


def overlaps(grams: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Product of the incidence matrices of the rows ``left`` and ``right``: how much each two share.

    Only n-grams of more than one row are laid out, ``CHUNK`` at a time.
    """
    row = np.repeat(np.arange(len(grams)), np.asarray(grams.value_lengths()))
    _, column, many = np.unique(
        np.asarray(grams.flatten()), return_inverse=True, return_counts=True)
    again = many[column] > 1
    row, column = row[again], (np.cumsum(many > 1) - 1)[column[again]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        low, high = np.searchsorted(column, (start, start + CHUNK))
        laid = np.zeros((len(grams), CHUNK), dtype=np.float32)
        laid[row[low:high], column[low:high] - start] = 1
        shared += laid[left] @ laid[right].T
    return shared


def _forest(node: np.ndarray, first: np.ndarray, second: np.ndarray) -> pa.Table:
    """As many edges as keep the nodes together that the given pairs of places join."""
    label = np.arange(len(node))
    while True:  # every node takes the least number around it until none changes
        before = label.copy()
        np.minimum.at(label, first, label[second])
        np.minimum.at(label, second, label[first])
        if (label == before).all():
            break
    moved = label != np.arange(len(node))
    return pa.table({"u": node[label[moved]], "v": node[moved]})


def _blocked(rows: DataFrame, group: str, *settled: Column) -> DataFrame:
    """Rows dealt to the pairs of blocks of their group, ``low`` and ``high``, that are not settled.

    Rows of a group that agree in a ``settled`` column, null aside, need no comparison with each other.
    The most of them make blocks of their own, which meet the other blocks only; a group without
    other rows is left out.
    """
    kinds = [one.alias(f"_settled_{k}") for k, one in enumerate(settled)]
    rows, names = rows.select("*", *kinds), rows.columns
    agreed = [
        rows.where(F.col(f"_settled_{k}").isNotNull()).groupBy(group, F.col(f"_settled_{k}").alias("value"))
        .agg(F.count("*").alias("many")).select(group, F.lit(k).alias("kind"), "value", "many")
        for k in range(len(settled))]
    most = reduce(DataFrame.union, agreed).groupBy(group).agg(
        F.max(F.struct("many", "kind", "value")).alias("most"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("all")).join(most, group, "left").withColumn(
        "many", F.coalesce("most.many", F.lit(0)))
    blocks = F.ceil((F.col("all") - F.col("many")) / BLOCK)
    sizes = sizes.where("all > many").select(
        group, "most", blocks.alias("blocks"), F.ceil(F.col("many") / BLOCK).alias("more"))
    apart = reduce(lambda a, b: a | b, (
        (F.col("most.kind") == k) & (F.col("most.value") == F.col(f"_settled_{k}"))
        for k in range(len(settled))))
    dealt = rows.join(sizes, group).withColumn("_apart", F.coalesce(apart, F.lit(False)))
    mine = F.when(F.col("_apart"), F.col("blocks") + F.pmod(F.xxhash64("node"), F.col("more"))).otherwise(
        F.pmod(F.xxhash64("node"), F.col("blocks")))
    last = F.when(F.col("_apart"), F.col("blocks")).otherwise(F.col("blocks") + F.col("more")) - 1
    return dealt.select(
        *names, mine.alias("mine"),
        F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")).select(
        *names, "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))


def _product(table: pa.Table, column: str):
    """Overlaps of a pair of blocks, and the places of their rows; same roots are of no interest."""
    node, root, mine, low, high = (
        table.column(name).to_numpy() for name in ("node", "root", "mine", "low", "high"))
    grams = table.column(column).combine_chunks()
    left, right = np.flatnonzero(mine == low[0]), np.flatnonzero(mine == high[0])
    shared = overlaps(grams, left, right).astype(np.float64)
    return node, grams, left, right, shared, root[left][:, None] != root[right][None, :]


def _dense_links(rest: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int):
    """Links between nodes that meet in columns of more than ``DENSE_FROM`` entries.

    First the prefixes of a column's nodes are multiplied: pairs that the bound lets through make
    clusters.  Then the whole sets of a cluster are.  Both go block by block, every pair of blocks is a
    product, and no more edges leave it than keep its nodes together.

    Near copies share many columns.  Nodes are compared in the largest one they have, ``first``; where two
    of the same ``first`` meet again, or two of one component, nothing is left to compare.
    """
    dense = rest.groupBy("gram").agg(F.count("*").alias("many")).where(F.col("many") > DENSE_FROM)
    entries = written(rest.join(dense, "gram").select("gram", "node", "root", "many"))
    first = entries.groupBy("node").agg(F.max(F.struct("many", "gram"))["gram"].alias("first"))
    columns = entries.select("gram", "node", "root").join(first, "node").join(
        nodes.select("node", "n", "prefix"), "node")

    def close(table: pa.Table) -> pa.Table:
        node, grams, left, right, shared, apart = _product(table, "prefix")
        n = table.column("n").to_numpy().astype(np.float64)
        ends = np.asarray(grams.offsets)
        last = np.asarray(grams.values)[ends[1:] - 1]
        beyond = n - np.diff(ends)
        bound = shared + np.where(
            last[left][:, None] <= last[right][None, :], beyond[left][:, None], beyond[right][None, :])
        a, b = n[left][:, None], n[right][None, :]
        apart &= (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)
        first, second = np.nonzero(apart & (bound * (100 + percent) >= (a + b) * percent))
        return _forest(node, left[first], right[second])

    def link(table: pa.Table) -> pa.Table:
        node, grams, left, right, shared, apart = _product(table, "grams")
        size = np.asarray(grams.value_lengths()).astype(np.float64)
        union = size[left][:, None] + size[right][None, :] - shared
        first, second = np.nonzero(apart & (shared * 100 >= union * percent))
        return _forest(node, left[first], right[second])

    elsewhere = F.when(F.col("first") != F.col("gram"), F.col("first"))
    edges = _blocked(columns, "gram", F.col("root"), elsewhere).groupBy(
        "gram", "low", "high").applyInArrow(close, "u long, v long")
    clusters = components(edges)
    members = written(clusters.select("node", F.col("root").alias("cluster")).join(
        rest.select("node", "root").distinct(), "node"))
    sets = _whole_sets(members.select("node"), nodes, docs, width)
    return written(
        _blocked(members.join(sets, "node"), "cluster", F.col("root")).groupBy(
            "cluster", "low", "high").applyInArrow(link, "u long, v long"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int):
    """The pairs ``(u, v)`` of nodes whose whole sets are alike.

    First the prefixes are compared: up to the lesser last number of the two, all that is shared is in
    both, so the overlap is at most that and what lies beyond.  The texts of the pairs that are left
    are read again for their whole sets.
    """
    part = nodes.select("node", "n", "prefix")
    left, right = (part.toDF(*(f"{side}_{name}" for name in part.columns)) for side in "ab")
    shared = F.size(F.array_intersect("a_prefix", "b_prefix"))
    beyond = F.when(
        F.element_at("a_prefix", -1) <= F.element_at("b_prefix", -1),
        F.col("a_n") - F.size("a_prefix")).otherwise(F.col("b_n") - F.size("b_prefix"))
    pairs = written(
        pairs.join(left, F.col("u") == F.col("a_node")).join(right, F.col("v") == F.col("b_node"))
        .where((shared + beyond) * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent)
        .select("u", "v"))
    sets = _whole_sets(
        pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, docs, width)
    left = sets.select(F.col("node").alias("u"), F.col("grams").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return written(pairs.join(left, "u").join(right, "v").where(
        both * 100 >= (F.size("a") + F.size("b") - both) * percent).select("u", "v"))


def _open_columns(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries with their new ``root``, of the columns in which components still meet."""
    placed = rows.drop("root").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    still = placed.groupBy("gram").agg(
        F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return written(placed.join(still.select("gram"), "gram"))


def similar_documents(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row ``_id``, ``_key`` (xxhash64 of the text), ``n_shingles``, ``component_id``, ``_root``.

    Texts are lower-cased (A-Z) and cut at ASCII white space; the set has the distinct runs of
    ``width`` words, or the whole sequence if it is shorter.  Rows link when 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest id reachable by links (null ids do not
    count).  Null, empty and wordless texts link with nothing.  Repeated rows are equal texts.

    Equal sets become one node first.  Then, ``ROUNDS`` times, the nodes of a column are compared with one
    of their size class and the next, and columns within one component are left.  Of the columns still
    open, the dense ones are multiplied block by block, which emits no pairs; in the others every pair
    of different components is compared.  No pair that could join two components is left out.
    """
    docs = docs.selectExpr(f"`{id_column}` AS _id", f"`{text_column}` AS _text").withColumn(
        "_key", F.xxhash64("_text"))
    heavy = _heavy(docs, Shingler(width, np.empty(0, dtype=np.int64)), percent)
    rows = written(_signatures(docs, Shingler(width, heavy), percent))
    nodes = written(
        rows.where("n > 0").groupBy("fp").agg(
            F.min(F.struct("_id", "_key")).alias("who"), F.min("_id").alias("least_id"),
            F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        .select("fp", "who.*", "least_id", "n", "prefix",
                F.monotonically_increasing_id().alias("node")))
    cells = nodes.select("node", F.explode("prefix").alias("gram"))
    shared = cells.groupBy("gram").agg(F.count("*").alias("many")).where("many > 1")
    size_class = F.floor(F.log("n") / F.lit(math.log(100 / percent)) + F.lit(1e-9))
    live = written(
        cells.join(shared.select("gram"), "gram").join(
            nodes.select("node", "n", size_class.alias("level")), "node"))

    links = tried = None
    rest = live.withColumn("root", F.col("node"))
    for turn in range(ROUNDS):
        lead = F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", F.lit(turn)))
        leads = rest.groupBy("gram", "level").agg(lead.alias("lead"))
        targets = leads.union(leads.select("gram", (F.col("level") - 1).alias("level"), "lead"))
        pairs = (
            rest.join(targets, ["gram", "level"]).where("root <> lead.root")
            .where(_near(F.col("n"), F.col("lead.n"), percent))
            .select(F.least("node", "lead.node").alias("u"),
                    F.greatest("node", "lead.node").alias("v")).distinct())
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = written(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        found = _verified(pairs, nodes, docs, width, percent)
        links = found if links is None else links.union(found)
        rest = _open_columns(rest, components(links))

    links = links.union(_dense_links(rest, nodes, docs, width, percent))
    sparse = rest.groupBy("gram").count().where(F.col("count") <= DENSE_FROM).select("gram")
    rest = _open_columns(rest.join(sparse, "gram"), components(links))
    a, b = rest.alias("a"), rest.alias("b")
    last = (
        a.join(b, "gram").where("a.node < b.node AND a.root <> b.root")
        .where(_near(F.col("a.n"), F.col("b.n"), percent))
        .select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
        .join(tried, ["u", "v"], "left_anti"))
    final = components(links.union(_verified(last, nodes, docs, width, percent)))

    reached = nodes.select("fp", "node", "least_id").join(final, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    groups = reached.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_set = reached.join(groups, "root").select("fp", "component_id", F.col("root").alias("_root"))
    return rows.select("_id", "_key", "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp")).join(
        by_set, "fp", "left").select(
        "_id", "_key", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"),
        "_root")


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of similar documents: the one of the smallest id.

    Rows without words link with nothing and stay; rows equal in id and text are one row.  Columns
    stay as they are.
    """
    found = similar_documents(docs, width, percent)
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_key"))).alias("first")
    stays = (
        found.where("n_shingles > 0").groupBy("_root").agg(first)
        .select("first._id", "first._key")
        .union(found.where("n_shingles = 0").select("_id", "_key").distinct())
        .select(_name("_id").alias("_stay_name"), F.col("_key").alias("_stay_key")))
    named = docs.select(
        *docs.columns, _name("doc_id").alias("_stay_name"), F.xxhash64("text").alias("_stay_key"))
    row = F.row_number().over(
        Window.partitionBy("_stay_name", "_stay_key").orderBy("_stay_key"))
    return named.join(stays, ["_stay_name", "_stay_key"], "left_semi").withColumn(
        "_stay_row", row).where("_stay_row = 1").select(*docs.columns)


cloudpickle.register_pickle_by_value(common)
