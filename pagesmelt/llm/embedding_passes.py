"""Operator 1: near-duplicate vectors by sorted projection passes.

A pass writes every vector, less its label's mean, as bits, the signs of its products with random
directions, and sorts by label and bits: vectors at a small angle agree in most bits, so they stand
near each other in some pass.  Each is compared with the neighbours in a window; verified pairs of
all passes are united.  The larger and the tighter a label, the more passes it gets; a label in which
passes would cost more than all pairs is compared whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesmelt.llm import common
from pagesmelt.llm.common import components, written

COSINE = 0.98
#: At least so many passes, more by ``_passes``.  Less the mean, a bit splits a label about in half, so
#: 48 bits tell more vectors apart than any label has.
PASSES, BITS, WINDOW = 16, 48, 32
#: Chance of missing a pair at the threshold that sets the number of passes.
MISSED = 1e-4
#: A sorted pass is cut in blocks of so many rows, each with the window before it.
CHUNK = 512
#: Members of one component are compared in blocks of about so many.
BLOCK = 512

VALID = """label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0
  AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))
  AND exists(embedding, x -> x <> 0)"""


def directions(pass_no: int, size: int) -> np.ndarray:
    """The same random directions in every task and run."""
    return np.random.default_rng([pass_no, size]).standard_normal((BITS, size))


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of length one in double precision; short ones padded, which keeps products."""
    sizes = np.asarray(vectors.value_lengths())
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    made = np.zeros((len(sizes), int(sizes.max(initial=0))))
    made[np.arange(made.shape[1])[None, :] < sizes[:, None]] = flat
    made /= np.abs(made).max(axis=1, keepdims=True)
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _passes(spread: Column, least: int, window: int, cosine: float) -> Column:
    """Passes for a label of ``rows`` vectors of which ``spread`` is left without the mean.

    A pair at the threshold stands, without the mean, at a wider angle.  A pass finds it if all the
    leading bits agree that leave half a window of vectors.
    """
    turned = F.greatest(F.lit(-1.0), 1 - (1 - cosine) / F.greatest(spread, F.lit(1e-12)))
    chance = F.pow(1 - F.acos(turned) / math.pi, F.log2(2 * F.col("rows") / window))
    needed = F.ceil(math.log(MISSED) / F.log1p(-F.greatest(chance, F.lit(1e-12))))
    return F.greatest(F.lit(least).cast("long"), needed)


def _label_plan(classes: DataFrame, least: int, window: int, cosine: float) -> DataFrame:
    """``(label, size, mean, passes)`` of each label; without passes if it is compared whole.

    Only labels of more rows than the fewest passes compare whole need a mean, one row for each
    component and batch.
    """
    kind = dict(classes.dtypes)["label"]
    counts = classes.groupBy("label", "size").agg(F.count("*").alias("rows"))
    large = counts.where(F.col("rows") > 2 * least * window)

    def sums(batches):
        for batch in batches:
            labels = batch.column("label").dictionary_encode()
            codes, sizes = labels.indices.to_numpy(), batch.column("size").to_numpy()
            units = unit_rows(batch.column("vector"))
            for code, size in sorted(set(zip(codes.tolist(), sizes.tolist()))):
                own = (codes == code) & (sizes == size)
                yield pa.RecordBatch.from_arrays(
                    [labels.dictionary.take(pa.array([code] * size)),
                     pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()),
                     pa.array(units[own, :size].sum(axis=0))],
                    names=["label", "size", "place", "total"])

    totals = classes.select("label", "size", "vector").join(
        large.select("label", "size"), ["label", "size"]).select("label", "size", "vector").mapInArrow(
        sums, f"label {kind}, size int, place int, total double")
    means = totals.groupBy("label", "size", "place").agg(F.sum("total").alias("total")).groupBy(
        "label", "size").agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("totals"))
    spread = F.lit(1.0) - F.expr("aggregate(mean, 0D, (s, x) -> s + x * x)")
    plan = large.join(means, ["label", "size"]).withColumn(
        "mean", F.expr("transform(totals, t -> t.total / rows)")).withColumn(
        "passes", _passes(spread, least, window, cosine))
    # all pairs of blocks move a row rows / BLOCK times, passes move it once each
    whole = F.when(F.col("passes") > 4 * least, F.col("passes") * BLOCK).otherwise(
        F.col("passes") * 2 * window)
    plan = plan.where(F.col("rows") > whole).select("label", "size", "mean", "passes")
    return written(counts.select("label", "size").join(plan, ["label", "size"], "left"))


def _keyed(classes: DataFrame) -> DataFrame:
    """A row for each vector and pass of its label, with the pass's bits as a number."""
    weights = 2 ** np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def add_keys(batches):
        for batch in batches:
            sizes, passes = (batch.column(n).to_numpy() for n in ("size", "passes"))
            keys = np.zeros((len(sizes), int(passes.max(initial=0))), dtype=np.int64)
            units = unit_rows(batch.column("vector"))
            units[np.arange(units.shape[1])[None, :] < sizes[:, None]] -= np.asarray(
                batch.column("mean").flatten())
            for size in np.unique(sizes):
                for k in range(int(passes[sizes == size].max())):
                    own = (sizes == size) & (passes > k)
                    keys[own, k] = (units[own, :size] @ directions(k, int(size)).T > 0) @ weights
            offsets = np.append(0, np.cumsum(passes)).astype(np.int32)
            flat = keys[np.arange(keys.shape[1])[None, :] < passes[:, None]]
            listed = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("node", "label", "vector", "size")), listed],
                names=["node", "label", "vector", "size", "keys"])

    kinds = dict(classes.dtypes)
    keyed = classes.select("node", "label", "vector", "size", "mean", "passes").mapInArrow(
        add_keys, f"node long, label {kinds['label']}, vector {kinds['vector']}, size int, "
        "keys array<long>")
    return keyed.select(
        "node", "label", "vector", "size", F.posexplode("keys").alias("pass_no", "key"))


def _window_links(keyed: DataFrame, window: int, cosine: float) -> DataFrame:
    """``(u, v)`` of linked neighbours, of all passes, from blocks of the sorted rows.

    Rows are numbered through all partitions, so that windows cross their borders.
    """
    count = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("pass_no", "label", "size", "key", "node")
    placed = written(
        keyed.repartitionByRange(count, *order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .select(
            "node", "vector", F.xxhash64("pass_no", "label", "size").alias("team"),
            F.shiftright("place", 33).alias("part"),
            F.col("place").bitwiseAND(2 ** 33 - 1).alias("row")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    at = F.col("row") + F.col("start")
    # a row also stands before the next block
    spread = placed.join(F.broadcast(starts), "part").select(
        "node", "vector", "team", at.alias("at"), F.explode(F.sequence(
            F.floor(at / CHUNK), F.floor((at + window) / CHUNK))).alias("block"))

    def compare(table: pa.Table) -> pa.Table:
        at = _column(table, "at")
        order = np.argsort(at, kind="stable")
        at, node, team = at[order], _column(table, "node")[order], _column(table, "team")[order]
        own = at >= _column(table, "block")[0] * CHUNK
        units = unit_rows(table.column("vector").combine_chunks())[order]
        fits = (at[:, None] > at[None, :]) & (at[:, None] - at[None, :] <= window)
        fits &= (team[:, None] == team[None, :]) & own[:, None]
        first, second = np.nonzero(fits & (units @ units.T >= cosine))
        return pa.table({"u": np.minimum(node[first], node[second]),
                         "v": np.maximum(node[first], node[second])})

    return spread.groupBy("block").applyInArrow(compare, "u long, v long").distinct()


def _block_pairs(members: DataFrame) -> DataFrame:
    """``members`` of each ``root`` in groups ``team, low, high``, one for every pair of blocks.

    A root's members are cut in blocks of about ``BLOCK``, so no group exceeds two blocks.  Roots of
    few members share groups.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    buckets = max(1, members.count() // BLOCK)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("mine")
    spread = members.join(sizes, "root").select("*", mine).select(
        *members.columns, "mine",
        F.when(F.col("blocks") > 1, F.col("root")).otherwise(
            -1 - F.pmod(F.xxhash64("root"), F.lit(buckets))).alias("team"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return spread.select(
        "*", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))


def _whole_links(members: DataFrame, cosine: float) -> DataFrame:
    """``(u, v)`` that connect what any pair of one ``root`` links: a forest for each pair of blocks."""
    def connect(table: pa.Table) -> pa.Table:
        node, root, mine = (_column(table, n) for n in ("node", "root", "mine"))
        units = unit_rows(table.column("vector").combine_chunks())
        close = (units @ units.T >= cosine) & (root[:, None] == root[None, :])
        if _column(table, "low")[0] != _column(table, "high")[0]:
            close &= mine[:, None] != mine[None, :]
        close |= close.T
        left, pairs = np.ones(len(node), dtype=bool), [np.empty((0, 2), dtype=np.int64)]
        for start in range(len(node)):
            front = [start] if left[start] else []
            left[start] = False
            while front:
                here = front.pop()
                new = np.flatnonzero(close[here] & left)
                left[new] = False
                front += new.tolist()
                pairs.append(np.stack((np.full(len(new), node[here]), node[new]), axis=1))
        found = np.concatenate(pairs)
        return pa.table({"u": found.min(axis=1), "v": found.max(axis=1)})

    return _block_pairs(members).groupBy("team", "low", "high").applyInArrow(
        connect, "u long, v long").distinct()


def _all_links(classes: DataFrame, roots: DataFrame, cosine: float) -> DataFrame:
    """``(node, links)``: rows linked with each member of a component, by all its members.

    Only counts leave a pair of blocks.
    """
    members = written(classes.join(roots, "node").select("node", "vector", "many", "root"))

    def count(table: pa.Table) -> pa.Table:
        node, root, many, mine = (_column(table, n) for n in ("node", "root", "many", "mine"))
        units = unit_rows(table.column("vector").combine_chunks())
        linked = np.zeros(len(node), dtype=np.int64)
        low, high = _column(table, "low")[0], _column(table, "high")[0]
        for start in range(0, len(node), CHUNK):
            here = slice(start, start + CHUNK)
            close = units[here] @ units.T >= cosine
            close &= root[here, None] == root[None, :]
            close &= node[here, None] != node[None, :]
            if low != high:  # each block of a pair sees the other one only
                close &= mine[here, None] != mine[None, :]
            linked[here] = close @ many
        return pa.table({"node": node, "links": linked})

    return _block_pairs(members).groupBy("team", "low", "high").applyInArrow(
        count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW,
) -> DataFrame:
    """Per row of ``vec_id, label, embedding``: ``n_links``, ``component_id`` and ``kept``.

    Rows of one label whose vectors have cosine (double precision) of at least ``cosine`` link; other
    columns are not read.  A null label, and a vector that is null, empty, zero or holds nulls, NaN or
    infinities, links with nothing; nor do vectors of different length.  ``n_links`` counts the other
    rows linked directly, equal vectors included; ``component_id`` is the smallest non-null id
    reachable, the own id without links.  Rows that repeat an id each count.

    Equal vectors become one class first.  At least ``passes`` passes, more for large and for tight
    labels, find the components; then the links of a component's members are counted against all
    members, block by block, so windows bound the search but not the counts.  That last step compares
    the square of a component's different vectors.
    """
    marked = vectors.select(
        "vec_id", "label", "embedding", F.expr(VALID).alias("valid")).withColumns({
            "h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(1), "embedding", "label")})
    classes = written(
        marked.where("valid").groupBy("h1", "h2").agg(
            F.first("label").alias("label"), F.first("embedding").alias("vector"),
            F.min("vec_id").alias("least_id"), F.count("*").alias("many"))
        .withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("vector")))
    planned = written(classes.join(
        _label_plan(classes, passes, window, cosine), ["label", "size"]))
    whole = planned.where("passes IS NULL").select(
        "node", "vector", F.xxhash64("label", "size").alias("root"))
    links = _window_links(_keyed(planned.where("passes IS NOT NULL")), window, cosine).union(
        _whole_links(whole, cosine))
    roots = written(components(links))
    links = _all_links(classes, roots, cosine)
    placed = classes.select("h1", "h2", "node", "least_id", "many").join(roots, "node", "left").join(
        links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = placed.join(least, "root").select(
        "h1", "h2", "component_id",
        (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = marked.select(
        "vec_id", *(F.when(F.col("valid"), F.col(name)).alias(name) for name in ("h1", "h2")))
    return rows.join(known, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


cloudpickle.register_pickle_by_value(common)
