"""What several operators share: intermediate tables, batches of texts, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: As crc32 in SQL: of the decimal digits of an id.
ID_CRC = "crc32(cast(cast(doc_id AS string) AS binary))"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session, where driver and executors are one machine, may go without one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir: local-cluster executors have own folders")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def written(frame: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: no lineage, and safe from lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def give_back() -> None:
    """Memory that this process freed goes back to the system, as far as its allocators can tell.

    Python workers stay between tasks, and what they hold counts against the executor.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def per_batch(
    frame: DataFrame, schema: str, work: Callable[[dict], dict], rows: int = 1 << 20,
) -> DataFrame:
    """Rows of ``work`` over Arrow batches, as columns of Python values in and out.

    At most ``rows`` at a time: a bound on memory where a row's result is large.  After each Arrow
    batch the memory freed goes back to the system.
    """
    kinds = StructType.fromDDL(schema)
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                out = work(whole.slice(start, rows).to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[name], arrow.field(name).type) for name in names], schema=arrow)
            out = whole = None
            give_back()

    return frame.mapInArrow(run, schema)


def per_partition(
    frame: DataFrame, schema: str, work: Callable[[Iterable], Iterable[dict]], rows: int = 256,
    columns: bool = False,
) -> DataFrame:
    """Rows of ``work`` over all of a task's batches, at most ``rows`` at a time, in their order.

    Batches come as lists of Python values or, with ``columns``, as Arrow columns; what is given
    back may be either or numpy.
    """
    kinds = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        cut = (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        for out in work(cut if columns else (b.to_pydict() for b in cut)):
            found = [out[field.name] for field in arrow]
            yield pa.RecordBatch.from_arrays([
                one.cast(field.type) if isinstance(one, pa.Array) else pa.array(one, field.type)
                for field, one in zip(arrow, found)], schema=arrow)

    return frame.mapInArrow(run, schema)


def _same(left: DataFrame, right: DataFrame) -> bool:
    fingerprint = [F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) AS decimal(38, 0))"))]
    return left.agg(*fingerprint).first() == right.agg(*fingerprint).first()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(u, v)`` of longs.

    The root is the smallest node reachable.  Large-star and small-star steps in turn: every
    node's greater neighbours, then all, move to its smallest neighbour.  The number of rounds grows
    with the logarithm of the longest path; hubs are met by partial minima and joins that
    Spark can split, never by gathering neighbours.
    """
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct())
    while True:
        both = now.select("u", "v").union(now.select("v", "u"))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = written(
            large.join(least, "u").select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct())
        if _same(now, small):
            roots = small.select(F.col("v").alias("node")).distinct()
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                roots.select("node", F.col("node").alias("root")))
        now = small
